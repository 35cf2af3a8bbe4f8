"""Spelling variants: words within one edit of each other, by PartEnum signatures.

A word is seen as the multiset of its letters, a binary vector with one place for
each (letter, occurrence). One replaced letter moves the vector by a Hamming distance
of at most two between words of equal length; one inserted or deleted letter moves it
by exactly one, between lengths that differ by one. Partition and enumerate: the
letters are dealt to ``n`` partitions; vectors within distance ``k`` agree on all but
at most k of them, so for each choice of k partitions to leave out a word has one
exact signature, its letters in the others. Words that can be near share a signature,
so an equi-join on signatures finds every pair, and the edit distance verifies it.

Many words share their letters (anagrams, common syllables). Of two words one edit
apart the first or the last half is the same, so each signature is joined once with
the first half and once with the last half beside it: still exact, and the joined
groups are small. No group of rows is formed beyond the key of that join, which Spark
sorts, spills and splits where it is skewed.

A word's form is its most frequent near word if that is at least ``ratio`` times as
frequent; counts at least double along a chain of forms, so chains end within the
logarithm of the largest count and their ends are found by pointer doubling.

Everything is native SQL. Words are counted with map-side combine before the first
shuffle, so a word that makes up a third of all text is one row a task.

Edge cases: null and empty texts have no word; a null doc_id counts as an empty one in
the hash that damages runs; repeated rows count as often as they occur; words of any
length and texts of any length are taken whole; ties between forms go to the smaller
word in code-point order; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise

#: Partitions of the letters for words of equal length (two of them left out) and
#: for lengths that differ by one (one of them left out).
EQUAL_PARTS, OTHER_PARTS = 4, 3
MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 5, 3, 2, 97

_RANGE = "À-ÿ"
_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
#: Letters of words, in the order in which they are dealt to the partitions.
LETTERS = _UPPER.lower() + "".join(map(chr, range(0xC0, 0x100)))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id as text, run): every maximal run of letters, lower-cased, of at least
    ``MIN_LENGTH`` letters (shorter ones cannot become words)."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    found = d.select("doc", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z{_RANGE}]+"), F.lit(0))).alias("raw"))
    return found.where(F.length("raw") >= MIN_LENGTH).select("doc", lower_ascii(F.col("raw")).alias("run"))


def damaged(found: DataFrame) -> DataFrame:
    """(word): the runs, of which one in ``DAMAGE`` by hash of document and run has lost a letter."""
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(h % DAMAGE == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def signatures(vocab: DataFrame, parts: int, left_out: int, shorter: Column) -> DataFrame:
    """(key, word, n): the exact signatures of each word, ``shorter`` being the length
    of the shorter word of the pairs sought."""
    half = F.floor(shorter / 2).cast("int")
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    sides = [F.left("word", half), F.right("word", (shorter - half).cast("int"))]
    keys = []
    for drop in combinations(range(parts), left_out):
        gone = "".join(c for k, c in enumerate(LETTERS) if k % parts in drop)
        kept = F.translate("letters", gone, "")
        keys += [F.xxhash64(F.lit(f"{drop} {s}"), shorter, kept, side) for s, side in enumerate(sides)]
    return vocab.withColumn("letters", letters).select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words exactly one inserted, deleted or replaced
    letter apart, once."""
    size = F.length("word")

    def join(x: DataFrame, y: DataFrame, *more: Column) -> DataFrame:
        cond = F.col("x.key") == F.col("y.key")
        for m in (*more, F.levenshtein("x.word", "y.word", 1) == 1):
            cond = cond & m
        return x.alias("x").join(y.alias("y"), cond).select(
            F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b"))

    equal = signatures(vocab, EQUAL_PARTS, 2, size)
    replaced = join(equal, equal, F.col("x.word") < F.col("y.word"))
    inserted = join(signatures(vocab, OTHER_PARTS, 1, size), signatures(vocab, OTHER_PARTS, 1, size - 1),
                    F.length("x.word") + 1 == F.length("y.word"))
    return replaced.unionByName(inserted).groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def forms(vocab: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n)."""
    both = F.array(F.struct("a", "b", "n_b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    links = pairs.select(F.explode(both).alias("l")).select("l.*")
    best = links.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    return vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """Add root, the end of the chain of forms (the word itself without one). Each round
    doubles the length of the chain that is behind a word; only words with a form take part."""
    up = materialise(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        hop = up.alias("x").join(up.alias("y"), F.col("x.root") == F.col("y.word"), "left").select(
            "x.word", F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved"))
        hop = materialise(hop, "spelling-roots")
        up = hop.select("word", "root")
        if hop.where("moved").isEmpty():
            break
    return words.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the documents' texts."""
    vocab = materialise(vocabulary(damaged(runs(docs))), "spelling-vocabulary")
    words = materialise(forms(vocab, near_pairs(vocab)), "spelling-forms")
    return with_roots(words).select("word", "form", "root", "n", "n_near", "form_n")


# ---------------------------------------------------------------------------
# Oracle: near words by their deletion neighbourhoods, CRC-32 bit by bit
# ---------------------------------------------------------------------------
def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a string's UTF-8 bytes, for a row that
    is joined with the one-row table of ``CRC_TABLE``."""
    digits = "'0123456789ABCDEF'"
    data = (f"list_transform(range(strlen({text})), lambda k: (instr({digits}, hex(encode({text}))[2 * k + 1]) - 1) * 16 "
            f"+ instr({digits}, hex(encode({text}))[2 * k + 2]) - 1)")
    step = "lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform({data}, lambda x: x::BIGINT)), {step}), 4294967295)"


CRC_TABLE = ("crc_table AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), "
             "lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) AS r(i)))")

ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
raw AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z{_RANGE}]+')), '{_UPPER}', '{_UPPER.lower()}') AS run
        FROM documents),
once AS (SELECT doc, run, count(*) AS k FROM raw WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, k, {crc32_sql("doc || ':' || run")} AS h FROM once, crc_table),
vocab AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % {DAMAGE} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
    WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
cut AS MATERIALIZED (SELECT word, p, word[:p] || word[p + 2:] AS rest FROM vocab, unnest(range(length(word))) AS u(p)),
pairs AS (SELECT DISTINCT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.rest = y.rest AND x.p = y.p WHERE x.word <> y.word
    UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM vocab)
    UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM vocab)),
best AS (SELECT a, count(*) AS n_near, arg_max(b, (v.n, -rank)) AS b, max(v.n) AS n_b
    FROM pairs JOIN (SELECT *, row_number() OVER (ORDER BY word) AS rank FROM vocab) v ON v.word = b GROUP BY a),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN n_b >= {RATIO} * n THEN b END AS form,
    CASE WHEN n_b >= {RATIO} * n THEN n_b END AS form_n FROM vocab LEFT JOIN best ON a = word),
chain AS (SELECT word, coalesce(form, word) AS top, 0 AS depth FROM formed
    UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON f.word = c.top WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(top, depth) AS root FROM chain GROUP BY word) USING (word)
"""
