"""Chat formatting from event logs.

A log has rows ``conv_id, turn, message_id, seq, role, kind, text``. Events of a message are
folded in the order of ``seq``: ``delta`` appends, ``edit`` replaces what is there,
``regenerate`` starts the message again. The log is dealt by message, not by conversation:
a fold never looks beyond its message, so a conversation that fills a third of the log is
spread over all tasks. Messages are rendered one segment each, in the order (turn,
message_id), and written with the span of the loss mask.

Template: ``<|turn|>role\\ntext<|end|>\\n``. In roles and texts a backslash is put behind every
``<``, ``[`` and ``\\``, which takes apart every control string (``<|end|>``, ``</s>``,
``[INST]``) and is undone by dropping the backslash behind these characters. A line feed in a
role is written ``<n``, which no escaped text contains.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm.columns import let
from forgeatlas.llm.common import store, table

TURN, END = "<|turn|>", "<|end|>\n"
LEARNED_ROLE = "assistant"
ROLE_BREAK = "<n"
_ESCAPED = re.compile(r"([<\[\\])\\")
_SEGMENT = re.compile(re.escape(TURN) + r"(.*?)\n(.*)" + re.escape(END), re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ROLE_BREAK))


def unescape_role(role: str) -> str:
    return unescape(role.replace(ROLE_BREAK, "\n"))


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id, turn, message_id, role, text`` of every message.

    Events with equal ``seq`` go by kind and text; a null ``seq`` comes first, a null kind is
    a delta, a null text is empty; the role is that of the first event that has one, else
    empty. Null keys are keys like any other. Unknown kinds are an error.
    """
    event = F.struct(
        "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role"
    )
    logs = events.groupBy("conv_id", "turn", "message_id").agg(F.sort_array(F.collect_list(event)).alias("log"))

    def final(log: Column) -> Column:
        known = F.forall(log, lambda e: e["kind"].isin("delta", "edit", "regenerate"))
        resets = F.transform(log, lambda e, i: F.when(e["kind"] != "delta", i).otherwise(0))
        kept = let(F.array_max(resets), lambda last: F.transform(F.filter(log, lambda e, i: i >= last), lambda e: e["text"]))
        return F.when(known, F.array_join(kept, "")).otherwise(F.raise_error(F.lit("unknown kind of event")))

    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return logs.select(
        "conv_id", "turn", "message_id",
        F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        let(F.col("log"), final).alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, message_id, segment, loss_start, loss_stop``; the mask (code points in
    the segment) is empty unless the role is learned."""
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    learned = F.col("role") == LEARNED_ROLE
    start = F.length(head).cast("long")
    return messages.select(
        "conv_id", "turn", "message_id",
        F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(learned, start).otherwise(0).cast("long").alias("loss_start"),
        F.when(learned, start + F.length(body)).otherwise(0).cast("long").alias("loss_stop"),
    )


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    found = _SEGMENT.fullmatch(segment)
    if found is None:
        raise ValueError("not a segment of this template")
    return unescape_role(found[1]), unescape(found[2])


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from rendered segments.

    A conversation is hashed in its order, which one task must do, but as a stream: the
    task holds a batch of segments and two hash states, whatever the length of the
    conversation.
    """
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message_id")
    dealt = dealt.select("conv_id", "segment", "loss_start", "loss_stop")
    kind = dealt.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done: list[tuple] = []
        key, turns, state, loss, loss_chars, chars = None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0

        def close() -> None:
            if turns:
                done.append((key, turns, state.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def out() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*done, strict=True) if done else [[]] * 6
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 1024):
                for conv, segment, start, stop in zip(*(c.slice(at, 1024).to_pylist() for c in batch.columns), strict=True):
                    if turns and conv != key:
                        close()
                        turns, state, loss, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                    role, text = parse_segment(segment)
                    key, turns, chars = conv, turns + 1, chars + len(segment)
                    state.update(f"{role}\n{text}\n".encode())
                    learned = unescape(segment[start:stop])
                    loss_chars += len(learned)
                    loss.update(learned.encode())
            yield out()
        close()
        if done:
            yield out()

    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return dealt.mapInArrow(run, schema)


def events_of(rows: DataFrame) -> DataFrame:
    """The event log of finished messages (``conv_id, turn, role, text``), as a chat service
    would have written it. Equal rows stay messages of their own.

    By a checksum of conversation and turn a message streams in as two deltas; begins with a
    draft that is regenerated; is written wrongly and then edited; or has a draft, a
    regeneration and an edit before its last delta. Every log folds to the text of its row."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    draft, wrong = F.concat(F.reverse(first), F.lit(" draft")), F.concat(F.lit("wrong "), second)

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(
            *(F.struct(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), part.alias("text")) for k, (kind, part) in enumerate(events))
        )

    logs = F.array(
        log(("delta", first), ("delta", second)),
        log(("delta", draft), ("regenerate", first), ("delta", second)),
        log(("delta", wrong), ("delta", draft), ("edit", text)),
        log(("delta", draft), ("regenerate", wrong), ("edit", first), ("delta", second)),
    )
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    way = F.pmod(F.crc32(key.cast("binary")), F.lit(4)).cast("int")
    marked = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message_id"))
    return marked.select(
        "conv_id", "turn", "message_id", "role", F.explode(F.get(logs, way)).alias("event")
    ).select("conv_id", "turn", "message_id", "event.seq", "role", "event.kind", "event.text")


def format_chats(events: DataFrame) -> DataFrame:
    """Rendered segments of an event log, see :func:`fold_events` and :func:`render`. Very
    long texts, repeated rows and ties have the results stated there; an empty log gives an
    empty table; other columns are not looked at."""
    return render(fold_events(events))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], rows.schema)
    return digests(store(format_chats(events_of(rows.unionByName(planted))), "chats"))


OP7_SQL = """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, length(role) + length(text) + 17
        + length(regexp_replace(role || text, '[^<\\[\\\\]', '', 'g')) AS chars
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
