"""Chat formatting: event-sourced reconstruction, then rendering with a loss mask.

A chat log holds events, not messages: a message is opened, its text streams in as
deltas, an edit replaces it, a regeneration discards it and streams anew, and events
may be delivered more than once. ``reconstruct`` partitions the log by conversation,
turn and message, sorts by sequence number and folds: the last event that resets a
message (open, edit, regenerate) and the deltas after it are its text.

``format_chats`` renders the messages in order of turn,

    ### <role>: <text></turn>\\n

Control strings inside roles and texts are escaped so that neither ``###`` nor
``</turn>`` nor, in a role, ``:`` occurs there: a backslash is doubled, each ``#`` of
three or more becomes ``\\#``, ``</turn>`` becomes ``<\\/turn>``, a role's colon ``\\:``.
Dropping the backslash before any character restores the text. The loss mask lists the
places of the assistants' texts, without header and end mark. ``read_back`` parses the
output again.

Scale: the log is grouped by message, never by whole conversation, and superseded events
are dropped before texts are gathered. Rendered turns are range-partitioned by
(conversation, turn, role, digest of the text, message), so a conversation with a third
of all rows goes over many tasks, and are joined into parts of at most ``PART`` code
points in order. Reading back streams a conversation's parts in order through one task,
which holds one batch at a time: a digest of a whole conversation cannot be split.

Edge cases: null texts and roles are empty ones; a null conv_id is a conversation of its
own, a null turn comes before all others; rows with equal turns are ordered by role, then
by MD5 of the text; repeated rows are messages of their own; a text of any length is one
message and may exceed a part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise, partitions

#: Code points of a streamed delta, and of a part of the output (a longer turn is a part).
DELTA, PART = 160, 1 << 16
RESETS = ("open", "edit", "regenerate")
END = "</turn>"
LOSS_ROLE = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_EVENT = "array<struct<kind:string,text:string>>"


# ---------------------------------------------------------------------------
# The log
# ---------------------------------------------------------------------------
def log_events(rows: DataFrame) -> DataFrame:
    """The event log (conv_id, turn, message, seq, kind, role, text) of finished rows
    (conv_id, turn, role, text), as a chat service would have written it. By hash of
    conversation and turn a message streams in directly, or after a discarded draft that
    is regenerated, or as half a text that an edit completes; some events come twice."""
    h = F.crc32(F.concat_ws(":", "conv_id", "turn"))
    src = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                      F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "*", F.monotonically_increasing_id().alias("message"), h.alias("h"),
        F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % DELTA), F.lit(0)).alias("chunks"))
    none = F.array().cast(_EVENT)

    def one(kind: str, text: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text"))).cast(_EVENT)

    def deltas(chunks: Column) -> Column:
        return F.transform(chunks, lambda c: F.struct(F.lit("delta").alias("kind"), c.alias("text"))).cast(_EVENT)

    half = F.ceil(F.size("chunks") / 2).cast("int")
    draft = F.when(F.col("h") % 3 == 1, F.concat(deltas(F.transform(F.slice("chunks", 1, 2), F.reverse)), one("regenerate", F.lit(""))))
    edited = F.col("h") % 3 == 2
    streamed = F.when(edited, F.concat(deltas(F.slice("chunks", F.lit(1), half)), one("edit", F.col("text")))).otherwise(deltas(F.col("chunks")))
    src = src.withColumn("log", F.concat(one("open", F.lit("")), F.coalesce(draft, none), streamed))
    numbered = F.transform("log", lambda e, k: F.struct(k.cast("long").alias("seq"), e["kind"].alias("kind"), e["text"].alias("text")))
    src = src.select("conv_id", "turn", "message", "role", "h", numbered.alias("log"))
    again = F.when(F.col("h") % 5 == 0, F.slice("log", 1, 2)).otherwise(F.slice("log", 1, 0))
    return src.select("conv_id", "turn", "message", "role", F.explode(F.concat("log", again)).alias("e")).select(
        "conv_id", "turn", "message", "e.seq", "e.kind", "role", "e.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text) of each message of a log."""
    key = ["conv_id", "turn", "message"]
    reset = F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).over(Window.partitionBy(*key))
    live = log.withColumn("reset", reset).where(F.col("seq") >= F.col("reset"))
    parts = F.array_sort(F.collect_set(F.struct("seq", "text")))  # a set: repeated deliveries count once
    folded = live.groupBy(*key).agg(F.max("role").alias("role"), parts.alias("parts"))
    return folded.select(*key, "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


# ---------------------------------------------------------------------------
# Rendering
# ---------------------------------------------------------------------------
def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    marked = F.regexp_replace(doubled, "#(?=##)|(?<=#)#(?=#)|(?<=##)#", "\\\\#")
    return F.replace(marked, F.lit(END), F.lit("<\\/turn>"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_chats(messages: DataFrame, part_chars: int = PART) -> DataFrame:
    """(conv_id, part, formatted, mask) of the messages (conv_id, turn, message, role, text):
    the parts of a conversation in ascending order of ``part`` are its formatted text; mask
    has start and length of the assistants' texts in the part."""
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    turns = messages.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), "message",
        head.alias("head"), escape(F.col("text")).alias("body"))
    order = ["conv_id", "turn", "role", "digest", "message"]
    dealt = turns.repartitionByRange(partitions(messages.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, seq = TaskContext.get().partitionId(), 0
        conv, texts, mask, size, open_ = None, [], [], 0, False

        def part():
            nonlocal seq, texts, mask, size
            row = {"conv_id": [conv], "part": [task << 32 | seq], "formatted": ["".join(texts)], "mask": [mask]}
            seq, texts, mask, size = seq + 1, [], [], 0
            return row

        done: list[dict] = []
        for b in batches:
            for c, role, top, body in zip(*(b.column(k).to_pylist() for k in range(4))):
                n = len(top) + len(body) + len(END) + 1
                if open_ and (c != conv or size + n > part_chars):
                    done.append(part())
                conv, open_ = c, True
                if role == LOSS_ROLE:
                    mask.append({"start": size + len(top), "length": len(body)})
                texts += [top, body, END, "\n"]
                size += n
            yield from _batches(done)
            done = []
        if open_:
            yield from _batches([part()])

    return dealt.select("conv_id", "role", "head", "body").mapInArrow(
        run, "conv_id long, part long, formatted string, mask array<struct<start:long,length:long>>")


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
                    ("mask", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pydict({k: [v for r in rows for v in r[k]] for k in _PARTS.names}, schema=_PARTS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at code point {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation's turns and of its text under the loss mask, parsed
    from the formatted output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        rows: list[tuple] = []

        def close():
            turns, loss, n, chars, total = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for b in batches:
            for c, text, mask in zip(*(b.column(k).to_pylist() for k in range(3))):
                if state and c != conv:
                    close()
                if not state or c != conv:
                    conv, state = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                found = parse(text)
                state[0].update("".join([f"{role}\n{said}\n" for role, said in found]).encode())
                for m in mask:
                    said = unescape(text[m["start"]:m["start"] + m["length"]])
                    state[1].update(said.encode())
                    state[3] += len(said)
                state[2] += len(found)
                state[4] += len(text)
            if rows:
                yield _digests(rows)
                rows = []
        if state:
            close()
            yield _digests(rows)

    n = partitions(formatted.sparkSession)
    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.select("conv_id", "formatted", "mask").mapInArrow(run, READ)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)],
                                      names=[name for name, _ in fields])


def chat_round_trip(rows: DataFrame) -> DataFrame:
    """Rows to a log, the log to messages, messages to formatted text, and that read back."""
    log = materialise(log_events(rows), "chat-log")
    return read_back(materialise(format_chats(reconstruct(log)), "chat-formatted"))


#: The contract's conversation of control strings.
PLANTED_ID, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    planted = conversations.sparkSession.createDataFrame(
        [(PLANTED_ID, k, role, PLANTED_TEXT) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(planted)


ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {PLANTED_ID}, k, r, '{PLANTED_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
e AS (SELECT *, 4 + length(role) + 2 + length(text) + 8
      + len(regexp_extract_all(role || text, '\\\\')) + length(array_to_string(regexp_extract_all(text, '#{{3,}}'), ''))
      + length(array_to_string(regexp_extract_all(role, '#{{3,}}'), '')) + len(regexp_extract_all(role, ':'))
      + len(regexp_extract_all(role, '</turn>')) + len(regexp_extract_all(text, '</turn>')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
