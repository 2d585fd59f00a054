"""Chat formatting with a grammar round trip (operator 4).

A turn is rendered as  <|turn|>role NEWLINE text <|end|> NEWLINE.  Rendered text is parsed again by a
deterministic parser and the recovered turns are compared with the source; a turn that does not come
back as it was is escaped, and the conversation rendered and parsed anew, until all are identical.

Escaping puts one backslash more after the first character of a control string, unescaping takes one
away, so it can be undone for any text, texts that look escaped included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TURN, END = "<|turn|>", "<|end|>"
#: Strings that no text may carry into the output as they are.
CONTROLS = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PLAIN = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def escape_role(role: str) -> str:
    """A role stands on one line: backslashes and line breaks are written out, then controls escaped."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def render(turns: list[tuple[str, str]], escaped: set[int]) -> str:
    return "".join(f"{TURN}{escape_role(r)}\n{escape(t) if i in escaped else t}{END}\n" for i, (r, t) in enumerate(turns))


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """role, text, and where the text stands in the output, of each turn; None where it is no output of render()."""
    turns, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        stop = text.find(END, line + 1) if line >= 0 else -1
        if not text.startswith(TURN, at) or stop < 0 or not text.startswith("\n", stop + len(END)):
            return None
        turns.append((unescape_role(text[at + len(TURN) : line]), unescape(text[line + 1 : stop]), line + 1, stop))
        at = stop + len(END) + 1
    return turns


def format_turns(turns: list[tuple[str, str]]) -> str:
    """Rendered so that parse() gives the same turns and no control string stands inside a text."""
    escaped = {i for i, (_, t) in enumerate(turns) if any(c in t for c in CONTROLS)}
    while True:
        text = render(turns, escaped)
        back = parse(text)
        if back is not None and [b[:2] for b in back] == turns:
            return text
        conflicts = {i for i, (_, t) in enumerate(turns) if unescape(t) != t or _PLAIN.search(t)}
        if conflicts <= escaped:
            raise ValueError("a conversation can't be rendered")
        escaped |= conflicts


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])
    now, turns, started = None, [], False
    ids, texts, spans = [], [], []

    def close() -> None:
        text = format_turns(turns)
        ids.append(now)
        texts.append(text)
        spans.append([x for role, _, a, b in parse(text) if role == LOSS_ROLE for x in (a, b)])

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if started and conv != now:
                close()
                turns = []
            now, started = conv, True
            turns.append((role or "", text or ""))
        if ids:
            yield pa.record_batch([ids, texts, spans], schema=schema)
            ids, texts, spans = [], [], []
    if started:
        close()
        yield pa.record_batch([ids, texts, spans], schema=schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The written table conv_id, formatted, loss_spans (begin and end of each assistant text, code points).

    Rows of a conversation stand by turn (null first), equal turns by role and text; repeated rows are
    turns of their own.  Null texts and roles are empty; rows of null conv_id are one conversation.  A
    conversation is read row by row from sorted rows, so a task holds one conversation at a time."""
    common.ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return common.write_table(rows.mapInArrow(_format, "conv_id long, formatted string, loss_spans array<long>"), "chat")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = parse(text)
            said = "".join(f"{r}\n{t}\n" for r, t, _, _ in turns)
            loss = "".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True))
            out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed again from its output."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -1, whose texts are made of control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_conversations(rows.unionByName(more)))
