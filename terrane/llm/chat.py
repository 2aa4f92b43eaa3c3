"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. They fold, in order of their sequence
numbers, into messages: a message opens one, a delta is appended, an edit
replaces the text, a regeneration starts the text anew. Logs are partitioned by
conversation; a very long one is shared out by ranges of its turns, as an event
concerns one turn only. Each conversation is then rendered as one text with the
spans that are learned beside it, and read back from that text alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: What marks a turn in the rendered text.
START, END = "<|im_start|>", "<|im_end|>"
#: A turn: its role's line, a body without control strings, its end.
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n([^<]*(?:<(?!\|)[^<]*)*)" + re.escape(END) + "\n")
LEARNED = "assistant"
#: Turns of a conversation that fold together, and characters from which on a rendered text goes on in another row.
TURNS, CHUNK = 64, 1 << 20
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def escape(text: str) -> str:
    """A text without control strings: a backslash doubled, one put into each <|."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and start and length (code points) of what is learned in it."""
    head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(body) if role == LEARNED else 0


def read(rendered: str, loss: Sequence[tuple[int, int]] = ()) -> tuple[list[tuple[str, str]], str]:
    """Roles and texts of a rendered conversation, found by its marks, and all text under the spans of loss."""
    turns, at = [], 0
    for m in _TURN.finditer(rendered):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(rendered):
        raise ValueError(f"no turn begins at character {at}")
    return turns, "".join(unescape(rendered[s : s + n]) for s, n in loss)


def parse(rendered: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    turns, _ = read(rendered)
    if len(turns) != 1:
        raise ValueError("not a rendered turn")
    return turns[0]


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, text: the final messages of events (conv_id, turn, seq, kind, role, text).

    kind is message, delta, edit or regenerate. Events of a turn are taken by
    seq, then kind, role and text; part numbers its messages from 0, and what
    isn't a message concerns the last one. A delta, edit or regeneration before
    any message opens one. Null texts are empty, null roles are empty, null ids
    and turns are values like others; repeated events count each time. One
    message is held at a time.
    """

    def run(batches):
        at, part, role, text = None, 0, "", []
        out: list[tuple] = []

        def batch_of():
            cols = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "turn", "part", "role", "text"])

        def close():
            if at is not None:
                out.append((*at, part, role, "".join(text)))

        for batch in batches:
            for c, t, kind, r, x in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "kind", "role", "text"))):
                if (c, t) != at or kind == "message":
                    close()
                    part = part + 1 if (c, t) == at else 0
                    at, role, text = (c, t), r or "", [x or ""]
                elif kind == "delta":
                    text.append(x or "")
                else:  # an edit, or a regeneration: the text starts anew
                    role, text = r or role, [x or ""]
            if out:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), "seq", "kind", "role", "text"]
    dealt = events.select(*cols).repartition("conv_id", F.floor(F.col("turn") / TURNS)).sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, turn long, part long, role string, text string")


def _by_conversation(names: Sequence[str], start, add, end, schema: Sequence[tuple[str, pa.DataType]]):
    """Streams rows that come conversation by conversation: start() gives a state, add(state, *row) the rows it is done
    with, end(state) the last ones; conv_id is put before each."""
    fields = [("conv_id", pa.int64()), *schema]

    def batch_of(out):
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(cols, fields)], [n for n, _ in fields])

    def run(batches):
        nothing = object()
        at, state, out = nothing, None, []
        for batch in batches:
            for c, *row in zip(*(batch.column(k).to_pylist() for k in ("conv_id", *names))):
                if at is nothing or c != at:
                    if at is not nothing:
                        out += [(at, *x) for x in end(state)]
                    at, state = c, start()
                out += [(c, *x) for x in add(state, *row)]
            if out:
                yield batch_of(out)
        if at is not nothing:
            out += [(at, *x) for x in end(state)]
        if out:
            yield batch_of(out)

    return run


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, chunk, formatted and loss (spans of learned text in it) of each conversation of messages (conv_id, turn, part, role, text).

    A conversation is one text, and one row unless it is very long: once a text
    has CHUNK characters, its next turn begins another row. Turns go by turn,
    null first, then part. Rows come conversation by conversation, chunks in order.
    """

    def add(state, role, text):
        done = []
        if state["size"] >= CHUNK:
            done = end(state)
            state.update(chunk=state["chunk"] + 1, size=0, texts=[], loss=[])
        turn, start, n = render(role or "", text or "")
        if n:
            state["loss"].append({"start": state["size"] + start, "length": n})
        state["texts"].append(turn)
        state["size"] += len(turn)
        return done

    def end(state):
        return [(state["chunk"], "".join(state["texts"]), state["loss"])]

    run = _by_conversation(("role", "text"), lambda: {"chunk": 0, "size": 0, "texts": [], "loss": []}, add, end, [("chunk", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS)])
    dealt = messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return dealt.mapInArrow(run, "conv_id long, chunk long, formatted string, loss array<struct<start:long,length:long>>")


def digests(texts: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from rendered conversations.

    Turns are found by the marks in the text, what is learned by the mask. A
    digest of a conversation is a chain, so its text passes through one task;
    nothing but the hash states is held. in_order: texts are as rendered() makes
    them, and aren't dealt again.
    """

    def add(state, formatted, loss):
        turns, learned = read(formatted, [(x["start"], x["length"]) for x in loss])
        state["turns"] += len(turns)
        state["whole"].update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
        state["chars"] += len(learned)
        state["loss"].update(learned.encode())
        state["size"] += len(formatted)
        return []

    def end(state):
        return [(state["turns"], state["whole"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"])]

    start = lambda: {"turns": 0, "whole": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
    run = _by_conversation(("formatted", "loss"), start, add, end, [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    dealt = texts if in_order else texts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def event_log(rows: DataFrame) -> DataFrame:
    """conv_id, turn, seq, kind, role, text: rows (conv_id, turn, role, text) as a chat server's log would have them.

    What is learned is streamed: a first answer breaks off, is regenerated, and
    comes in two deltas. Other turns are drafted and then edited. Rows of one
    turn follow each other by role and text.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    first, rest = F.left(text, half), F.substr(text, half + 1)
    event = lambda step, kind, r, x: F.struct((F.col("nth") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), r.alias("role"), x.alias("text"))
    no, empty = F.lit(None).cast("string"), F.lit("")
    streamed = F.array(event(0, "message", role, empty), event(1, "delta", no, first), event(2, "regenerate", no, empty), event(3, "delta", no, first), event(4, "delta", no, rest))
    drafted = F.array(event(0, "message", role, rest), event(1, "delta", no, first), event(2, "edit", no, text))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(role, text)).cast("long")
    return rows.withColumn("nth", nth).select("conv_id", "turn", F.inline(F.when(role == LEARNED, streamed).otherwise(drafted)))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"{END}{START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(rendered(reconstruct(event_log(rows))), in_order=True)


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
marked AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 24 AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
