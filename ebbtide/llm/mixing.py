"""Mixing sources to target weights by hierarchical budgeting.

Documents form a tree domain -> language -> source. A token budget goes down the
tree by the weights of the nodes. A node that has fewer tokens (times the allowed
epochs) than its share is filled completely, and what it leaves goes to its
siblings by their weights; only what all children of a node cannot take together
goes to the node's own siblings, and so on up. Each leaf then selects its share as
a prefix of its tokens in a seeded order: whole epochs first, then a prefix of one
more epoch, whose order is another permutation.

All of it is DataFrame work. Budgets are windows over the tree's nodes (not over
documents). The prefix of a leaf is found without sorting the leaf: documents are
dealt by the leading bits of their order key into about sqrt(rows) buckets, bucket
totals (map-side combined) tell in which bucket the share ends, and only that
bucket's documents are put in order. So a leaf with a third of all rows costs its
last task about sqrt(rows) rows.

Edge cases: null text has no tokens; documents without tokens are never selected;
null domain, language or source is a node like any other; nodes with weight 0 get
nothing; a budget beyond the whole capacity selects all of it; repeated rows are
drawn one by one (equal rows in a tie are interchangeable); an empty table gives an
empty result; other columns are ignored by ``mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise

LEVELS = ["domain", "lang", "source"]
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def count_tokens(text: Column) -> Column:
    """Words separated by ASCII white space."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(t, WORD_SPLIT), "")).cast("long")


def _lookup(col: Column, table: Mapping[str, object], default, kind: str) -> Column:
    out = F.lit(default).cast(kind)
    for key, value in table.items():
        out = F.when(col.eqNullSafe(F.lit(key)), F.lit(value).cast(kind)).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Shares ``budget`` of each parent out to its children (columns weight, cap)
    as integers: adds ``share``."""
    by_ratio = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), F.col(name))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    d = nodes.where("weight > 0")
    d = d.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("_bc"),
                 F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("_bw"),
                 F.sum("weight").over(whole.orderBy(F.col("cap") / F.col("weight"), F.col(name))
                                      .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_w"),
                 F.sum("cap").over(whole).alias("_c"))
    # the fill level: the largest over "all children before this one are full"
    level = F.max((F.col("budget") - F.col("_bc")) / F.greatest(F.col("_w") - F.col("_bw"), F.lit(1e-300))).over(whole)
    d = d.select("*", level.alias("_level"))
    d = d.select("*", F.when(F.col("budget") >= F.col("_c"), F.col("cap").cast("double"))
                 .otherwise(F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight"))).alias("_x"))
    d = d.select("*", F.floor(F.col("_x") + 1e-6).cast("long").alias("_f"))
    # whole tokens: what the floors leave goes to the largest fractions
    d = d.select("*", (F.least("budget", "_c") - F.sum("_f").over(whole)).alias("_rest"),
                 F.row_number().over(whole.orderBy((F.col("_f") >= F.col("cap")).cast("int"),
                                                   F.desc(F.round(F.col("_x") - F.col("_f"), 6)), F.col(name))).alias("_k"))
    share = F.col("_f") + (F.col("_k") <= F.col("_rest")).cast("long")
    return d.withColumn("share", share).drop("_bc", "_bw", "_w", "_c", "_level", "_x", "_f", "_rest", "_k")


def leaf_budgets(rows: DataFrame, budget: float | int, max_epochs: int, weights: Mapping[str, Mapping[str, float]],
                 default: float = 1.0) -> DataFrame:
    """domain, lang, source, n_rows, supply and share for each leaf. ``budget``: a
    share of all tokens (float) or a number of tokens (int)."""
    leaves = rows.groupBy(*LEVELS).agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("supply"))
    leaves = materialise(leaves, "mixing-leaves")
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0]
    tokens = int(budget * total) if isinstance(budget, float) else int(budget)

    def weighted(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("weight", _lookup(F.col(name), weights.get(name, {}), default, "double"))

    base = weighted(leaves.withColumn("cap", F.col("supply") * max_epochs), "source")
    # a leaf without weight takes nothing, so its parent cannot count on it
    cap = F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).alias("cap")
    langs = weighted(base.groupBy("domain", "lang").agg(cap), "lang")
    domains = weighted(langs.groupBy("domain").agg(cap), "domain").withColumn("budget", F.lit(tokens).cast("long"))
    top = _fill(domains.withColumn("_root", F.lit(0)), ["_root"], "domain").select("domain", F.col("share").alias("budget"))
    mid = _fill(_inside(langs, top, ["domain"]), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    low = _fill(_inside(base, mid, ["domain", "lang"]), ["domain", "lang"], "source")
    return materialise(low.select(*LEVELS, "n_rows", "supply", "share"), "mixing-budgets")


def _inside(nodes: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    p = parents.withColumnsRenamed({k: f"_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & nodes[k].eqNullSafe(p[f"_{k}"])
    return nodes.join(p, cond).drop(*[f"_{k}" for k in keys])


def mix(docs: DataFrame, budget: float | int, weights: Mapping[str, Mapping[str, float]],
        domains: Mapping[str, str], max_epochs: int = 1, seed: int = 0, other_domain: str = "other") -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch and take_tokens (fewer than
    n_tokens where the leaf's share ends within the document) of each selected
    row; a document drawn in several epochs has a row for each. ``domains`` maps
    sources to domains, ``weights`` has node weights by level."""
    rows = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _lookup(F.col("source"), domains, other_domain, "string").alias("domain"),
        "lang", "source", count_tokens(F.col("text")).alias("n_tokens")), "mixing-rows")
    leaves = leaf_budgets(rows, budget, max_epochs, weights)
    plan = leaves.where("supply > 0 and share > 0").select(
        *LEVELS, F.expr("cast(share div supply as int)").alias("full"), (F.col("share") % F.col("supply")).alias("rest"),
        F.ceil(F.sqrt("n_rows")).cast("long").alias("n_buckets"))
    drawn = _inside(rows.where("n_tokens > 0"), plan, LEVELS)
    out = ["doc_id", *LEVELS, "n_tokens", "epoch", "take_tokens"]
    whole = (drawn.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
             .withColumn("take_tokens", F.col("n_tokens")).select(*out))
    part = drawn.where("rest > 0").withColumn("epoch", F.col("full"))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epoch"), F.lit(seed)))
    part = part.withColumn("key", key).withColumn("bucket", F.floor(
        F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("n_buckets") / F.lit(1 << 32)).cast("long"))
    sums = part.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("own"))
    before = F.sum("own").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("own")
    ends = (sums.withColumn("before", before).where("before < rest and before + own >= rest")
            .select(*LEVELS, F.col("bucket").alias("last"), "before"))
    part = _inside(part, materialise(ends, "mixing-ends"), LEVELS)
    early = part.where("bucket < last").withColumn("take_tokens", F.col("n_tokens")).select(*out)
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "n_tokens")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    late = (part.where("bucket = last").withColumn("left", F.col("rest") - F.col("before") - run).where("left > 0")
            .withColumn("take_tokens", F.least("n_tokens", "left")).select(*out))
    return whole.unionByName(early).unionByName(late)


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The selected documents with their own columns, whole (the one in which a
    leaf's share ends included), once for each epoch that draws them. Rows that
    share a doc_id, language and source are selected together."""
    chosen = mix(docs, **params).groupBy("doc_id", "lang", "source", "epoch").count().select(
        F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("source").alias("_s"))
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_d"]) & docs["lang"].eqNullSafe(chosen["_l"])
                     & docs["source"].eqNullSafe(chosen["_s"])).drop("_d", "_l", "_s")
