"""The ``opN_<name>`` queries: each operator over its whole table with production
parameters, reduced to the contract's columns. ``QUERIES`` and ``ORACLE`` are
merged into the registry by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import chat_format as CF
from ebbtide.llm import periodic_runs as PR
from ebbtide.llm import spelling_variants as SV
from ebbtide.llm.common import table
from ebbtide.llm.language_id import held_in, language_id
from ebbtide.llm.lm_scoring import lm_scores
from ebbtide.llm.mixing import mix
from ebbtide.llm.multiset_hash import edited_fingerprints
from ebbtide.llm.packing import pack
from ebbtide.llm.plane_files import round_trip
from ebbtide.llm.quality_rules import quality_rules
from ebbtide.llm.simhash import simhash_groups
from ebbtide.llm.suffix_dedup import suffix_dedup
from ebbtide.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Production parameters of the mix: a domain for each source, node weights by
#: level, the share of all tokens to draw, and how often a document may be drawn.
DOMAINS = {**{f"src{k}": "web" for k in range(8)}, **{f"src{k}": "books" for k in range(8, 14)}}
MIX_WEIGHTS = {"domain": {"web": 5.0, "books": 3.0, "other": 2.0},
               "lang": {"en": 6.0, "de": 1.5, "fr": 1.5, "es": 1.0},
               "source": {"src0": 3.0, "src8": 2.0}}
MIX_BUDGET = 0.8
MIX_EPOCHS = 2


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIX_BUDGET, MIX_WEIGHTS, DOMAINS, MIX_EPOCHS)


def _cases(col: str, table: dict, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{float(v)!r}::DOUBLE"
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


def _fill_sql(name: str, nodes: str, keys: list[str]) -> str:
    """CTEs that share the budget of each parent out to its children (weight, cap)."""
    parent, own = ", ".join(["1", *keys[:-1]]), keys[-1]
    order = f"PARTITION BY {parent} ORDER BY cap / weight, {own}"
    before = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}1 AS (SELECT *, coalesce(sum(cap) OVER {before}, 0) AS bc, coalesce(sum(weight) OVER {before}, 0.0) AS bw,
  sum(weight) OVER (PARTITION BY {parent}) AS w, sum(cap) OVER (PARTITION BY {parent}) AS c FROM {nodes} WHERE weight > 0),
{name}2 AS (SELECT *, CASE WHEN budget >= c THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE),
    max((budget - bc) / greatest(w - bw, 1e-300::DOUBLE)) OVER (PARTITION BY {parent}) * weight) END AS x FROM {name}1),
{name}3 AS (SELECT *, CAST(floor(x + 1e-6::DOUBLE) AS BIGINT) AS f FROM {name}2),
{name} AS (SELECT *, f + CASE WHEN row_number() OVER (PARTITION BY {parent} ORDER BY CAST(f >= cap AS INTEGER), round(x - f, 6) DESC, {own})
    <= least(budget, c) - sum(f) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END AS share FROM {name}3)"""


ORACLE["op1_mixing"] = f"""
WITH r AS (SELECT doc_id, {_cases('source', DOMAINS, 'other')} AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS supply FROM r GROUP BY ALL),
base0 AS (SELECT *, supply * {MIX_EPOCHS} AS cap, {_cases('source', MIX_WEIGHTS['source'], 1.0)} AS weight FROM leaf),
langs0 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, {_cases('lang', MIX_WEIGHTS['lang'], 1.0)} AS weight FROM base0 GROUP BY domain, lang),
tops AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_cases('domain', MIX_WEIGHTS['domain'], 1.0)} AS weight,
    CAST(floor({MIX_BUDGET}::DOUBLE * (SELECT sum(supply) FROM leaf)) AS BIGINT) AS budget FROM langs0 GROUP BY domain),
{_fill_sql('top', 'tops', ['domain'])},
langs AS (SELECT l.*, t.share AS budget FROM langs0 l JOIN top t ON l.domain IS NOT DISTINCT FROM t.domain),
{_fill_sql('mid', 'langs', ['domain', 'lang'])},
bases AS (SELECT b.*, m.share AS budget FROM base0 b JOIN mid m ON b.domain IS NOT DISTINCT FROM m.domain AND b.lang IS NOT DISTINCT FROM m.lang),
{_fill_sql('low', 'bases', ['domain', 'lang', 'source'])},
plan AS (SELECT domain, lang, source, share // supply AS full_epochs, share % supply AS rest FROM low WHERE supply > 0 AND share > 0),
drawn AS (SELECT r.*, full_epochs, rest FROM r JOIN plan p ON r.domain IS NOT DISTINCT FROM p.domain
    AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source WHERE n > 0),
part AS (SELECT *, rest - (sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', doc_id, full_epochs, 0)), n
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n) AS room FROM drawn WHERE rest > 0)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(e AS INTEGER) AS epoch, n AS take_tokens
FROM drawn, unnest(range(0, full_epochs)) AS u(e)
UNION ALL
SELECT doc_id, domain, lang, source, n, CAST(full_epochs AS INTEGER), CAST(least(n, room) AS BIGINT) FROM part WHERE room > 0
"""


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(held_in(1, 3), F.lit(False))
    out = language_id(table(spark, sf_dir, "documents"), held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).drop("ids")


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


@query
def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), texts=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "distance")


@query
def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SV.spelling_variants(table(spark, sf_dir, "documents"))


ORACLE["op11_spelling_variants"] = SV.ORACLE_SQL


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.run_digests(PR.periodic_runs(PR.with_loops(table(spark, sf_dir, "documents"))))


@query
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CF.chat_round_trip(CF.with_planted(table(spark, sf_dir, "conversations")))


ORACLE["op13_chat_formatting"] = CF.ORACLE_SQL
