"""Quality rules: robust multivariate outliers per language and source.

Every document becomes a vector of transformed text statistics. For each
(lang, source) group a minimum-covariance-determinant (MCD) estimate of centre
and covariance is fitted by concentration steps: keep the share ``support`` of
the rows with the smallest Mahalanobis distance, re-estimate, repeat. Two
deterministic starts (robust z-scores; the covariance of their tanh) run side
by side and each group keeps the one with the smaller determinant. Rows whose
squared Mahalanobis distance exceeds ``cutoff`` are rejected.

Everything is a DataFrame expression: statistics are row-local, the estimates
are grouped aggregates with map-side combine (a group holding a third of all
rows sends one partial row per task), the Cholesky factor and the distance are
unrolled column arithmetic.

Documents that fail the base rules are rejected before the fit, so they do not
pull on the estimates.

Edge cases: null text counts as empty text (no words, so it fails the base
rules); null lang or source is a group value like any other; groups with fewer
than ``min_group`` rows are pooled by language, and then over all languages;
where even that pool is too small every row that passes the base rules is kept.
Repeated rows are judged one by one and get equal verdicts. An empty table
gives an empty result. Extra columns are ignored by ``text_statistics`` and
kept by ``quality_filter``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise

WORD_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Transformed statistics and the smallest standard deviation that the estimate
#: of each may have. Differences below a few floors are never an outlier, also
#: where most rows of a group share one value.
FEATURES = {
    "f_length": 1.0,       # log(1 + words)
    "f_word": 0.25,        # log(characters per word)
    "f_symbol": 0.35,      # log(1 + 100 * symbols per word character)
    "f_lines": 0.12,       # share of lines with words that repeat an earlier line
    "f_repeat": 0.08,      # share of words in repeated 5-word windows
}
NAMES = list(FEATURES)
P = len(NAMES)
SUPPORT = 0.75
STEPS = 4
MIN_GROUP = 50
#: Median of the chi-square distribution with 5 degrees of freedom (fixed value).
CHI2_MEDIAN = 4.3515
#: The 0.9999 quantile of the chi-square distribution with 5 degrees of freedom.
CUTOFF = 25.74


def text_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines and base_failed, all row-local."""
    keep = docs.columns if keep is None else keep
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(*keep, t.alias("_text"))
    d = d.select(*keep, "_text",
                 F.array_remove(F.split("_text", WORD_SPLIT), "").alias("_words"),
                 F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    n = F.size("_words")
    w = F.col("_words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)])))
    d = d.select(*keep,
                 n.cast("long").alias("n_words"),
                 F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                 F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 F.size("_lines").cast("long").alias("n_lines"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 F.coalesce(windows, F.array().cast("array<long>")).alias("_win"))
    base = [c for c in d.columns if c != "_win"]
    # only texts with a repeated window pay for the sort
    d = d.select(*base, F.when(
        F.size(F.array_distinct("_win")) < F.size("_win"),
        F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_srt"))
    s = F.col("_srt")
    d = d.select(*base, F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"]))
                                 | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))).alias("_rep"))
    covered = F.aggregate(
        F.sort_array(F.transform("_rep", lambda x: x["i"])),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["total"] + p + WINDOW - F.greatest(p, a["end"])).alias("total"),
                              (p + WINDOW).alias("end")))["total"]
    d = d.select(*base, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 10)
                        | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


#: What tells a row from others in ``quality_filter``.
ROW = ["doc_id", "lang", "source", "text_key"]


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words").cast("double")).alias("f_length"),
            F.log(chars / words).alias("f_word"),
            F.log1p(100.0 * F.col("n_symbols") / chars).alias("f_symbol"),
            (F.col("n_dup_lines") / lines).alias("f_lines"),
            (F.col("n_repeat_words") / words).alias("f_repeat")]


def _groups(v: DataFrame, min_group: int) -> DataFrame:
    """Adds the group columns (g_lang, g_source, g_level): the row's own group
    where it is large enough, else its language's small groups together, else
    all small groups together."""
    size = v.where(~F.col("base_failed")).groupBy("lang", "source").count()
    own = size.withColumn("own", F.col("count") >= min_group)
    lang = (own.where(~F.col("own")).groupBy("lang").agg(F.sum("count").alias("n"))
            .select(F.col("lang").alias("_l"), (F.col("n") >= min_group).alias("pool")))
    level = (own.join(lang, F.col("lang").eqNullSafe(F.col("_l")), "left")
             .select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                     F.when(F.col("own"), 0).when(F.col("pool"), 1).otherwise(2).alias("_level")))
    level = materialise(level, "quality-groups")
    out = v.join(level, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    lv = F.coalesce("_level", F.lit(2))
    return (out.withColumn("g_level", lv)
            .withColumn("g_lang", F.when(lv < 2, F.col("lang")))
            .withColumn("g_source", F.when(lv < 1, F.col("source")))
            .drop("_lang", "_source", "_level"))


GROUP = ["g_level", "g_lang", "g_source"]


def _join(left: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a per-group table; null group values match. Spark broadcasts it
    only below its size threshold."""
    right = small.withColumnsRenamed({k: f"_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_{k}"])
    return left.join(right, cond).drop(*[f"_{k}" for k in keys])


def _estimates(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Count, centre m0.. and the Cholesky factor l00, l10, l11, .. of the
    covariance (plus the squared floors) for each group."""
    aggs = [F.count("*").alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    e = rows.groupBy(*keys).agg(*aggs)
    return _cholesky(e)


def _cholesky(e: DataFrame) -> DataFrame:
    floors = list(FEATURES.values())
    for j in range(P):
        for i in range(j, P):
            s = F.col(f"c{i}{j}")
            if i == j:
                s = s + F.lit(floors[i] ** 2)
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            e = e.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return e.withColumn("logdet", logdet).drop(*[f"c{i}{j}" for i in range(P) for j in range(i + 1)])


def _distance(d: DataFrame, cols: list[str]) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        s = F.col(cols[i]) - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        d = d.withColumn(f"_y{i}", s / F.col(f"l{i}{i}"))
    d = d.withColumn("d2", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(P)), F.lit(0.0)))
    return d.drop(*[f"_y{i}" for i in range(P)])


def _concentrate(rows: DataFrame, keys: list[str], support: float) -> DataFrame:
    """The estimate from the ``support`` share of each group with the smallest d2."""
    q = rows.groupBy(*keys).agg(F.percentile_approx("d2", support, 10_000).alias("q"))
    return _estimates(_join(rows, q, keys).where(F.col("d2") <= F.col("q")), keys, NAMES)


def mcd_estimates(v: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Group columns, n, m0.., l00.. and ``scale`` (correction of the distances so
    that their median is that of a chi-square variable) for each group of ``v``."""
    floors = list(FEATURES.values())
    med = v.groupBy(*GROUP).agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"_md{i}") for i, c in enumerate(NAMES)])
    dev = _join(v, med, GROUP)
    mad = _join(dev, dev.groupBy(*GROUP).agg(*[
        F.percentile_approx(F.abs(F.col(c) - F.col(f"_md{i}")), 0.5, 10_000).alias(f"_ad{i}")
        for i, c in enumerate(NAMES)]), GROUP)
    z = [(F.col(c) - F.col(f"_md{i}")) / F.greatest(1.4826 * F.col(f"_ad{i}"), F.lit(floors[i]))
         for i, c in enumerate(NAMES)]
    zs = mad.select(*GROUP, *NAMES, *[x.alias(f"z{i}") for i, x in enumerate(z)])
    zcols = [f"z{i}" for i in range(P)]
    first = zs.select(*GROUP, *NAMES, F.lit(0).alias("start"),
                      sum((F.col(c) * F.col(c) for c in zcols), F.lit(0.0)).alias("d2"))
    bent = zs.select("*", *[F.tanh(c).alias(f"t{i}") for i, c in enumerate(zcols)])
    shape = _estimates(bent, GROUP, [f"t{i}" for i in range(P)])
    for i in range(P):  # the centre in z is the median, zero
        shape = shape.withColumn(f"m{i}", F.lit(0.0))
    second = _distance(_join(zs, shape, GROUP), zcols).select(*GROUP, *NAMES, F.lit(1).alias("start"), "d2")
    keys = [*GROUP, "start"]
    est = materialise(_concentrate(first.unionByName(second), keys, support), "quality-mcd")
    both = v.select(*GROUP, *NAMES, F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    for _ in range(steps):
        est = materialise(_concentrate(_distance(_join(both, est, keys), NAMES), keys, support), "quality-mcd")
    cols = [c for c in est.columns if c not in keys]
    best = est.groupBy(*GROUP).agg(F.min_by(F.struct(*cols), F.struct("logdet", "start")).alias("e")).select(*GROUP, "e.*")
    scale = (_distance(_join(v, best, GROUP), NAMES).groupBy(*GROUP)
             .agg(F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 10_000) / CHI2_MEDIAN).alias("scale")))
    return materialise(_join(best, scale, GROUP), "quality-mcd")


def quality_rules(docs: DataFrame, support: float = SUPPORT, steps: int = STEPS, cutoff: float = CUTOFF,
                  min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, lang, source, text_key, the statistics, base_failed, distance (null where no
    group is large enough) and kept, for each row of ``docs``."""
    rows = docs.select("doc_id", "lang", "source", "text", _text_key(F.col("text")).alias("text_key"))
    s = text_statistics(rows, keep=ROW)
    v = materialise(s.select("*", *_vector()), "quality-vectors")
    v = _groups(v, min_group)
    est = mcd_estimates(v.where(~F.col("base_failed")), support, steps).where(F.col("n") >= support * min_group)
    keep = [*ROW, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "base_failed"]
    e = est.withColumnsRenamed({k: f"_{k}" for k in GROUP})
    cond = F.lit(True)
    for k in GROUP:
        cond = cond & v[k].eqNullSafe(e[f"_{k}"])
    d = _distance(v.join(e, cond, "left"), NAMES)
    dist = F.col("d2") / F.col("scale")
    return d.select(*keep, dist.alias("distance"),
                    (~F.col("base_failed") & F.coalesce(dist <= cutoff, F.lit(True))).alias("kept"))


def quality_filter(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Rows that share a
    doc_id are told apart by text, language and source."""
    bad = quality_rules(docs, **params).where(~F.col("kept")).select(
        *[F.col(c).alias(f"_{c}") for c in ROW]).distinct()
    match = F.lit(True)
    for c in ROW[:-1]:
        match = match & docs[c].eqNullSafe(bad[f"_{c}"])
    return docs.join(bad, match & (_text_key(docs["text"]) == bad["_text_key"]), "left_anti")
