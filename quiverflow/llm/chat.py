"""Chats from event logs: rows of a conversation, in order, are folded into messages and rendered.

Events: `message` begins a message with `text`; `delta` adds `text` to a message; `edit` replaces
a message's text; `regenerate` empties it, for the deltas that follow.  `target` is the message's number within
its conversation, or null for the latest.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
#: What stands for a control string inside a text or role, after a backslash; a backslash is doubled first.
CODES = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":", "n": "\n"}
LEARNED = "assistant"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\e")
    return text.replace(":", "\\c").replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: CODES[m[1]], text)


def fold(events: list[dict]) -> list[tuple[str, str]]:
    """(role, text) of each message.  An event whose target doesn't exist begins a message of its own."""
    roles: list[str] = []
    texts: list[list[str]] = []
    for e in events:
        kind, text = e["kind"] or "message", e["text"] or ""
        at = len(roles) - 1 if e["target"] is None else e["target"]
        if kind == "message" or not 0 <= at < len(roles):
            roles.append(e["role"] or "")
            texts.append([text])
        elif kind == "delta":
            texts[at].append(text)
        elif kind == "edit":
            texts[at] = [text]
        elif kind == "regenerate":
            texts[at] = []
        else:
            raise ValueError(f"unknown event {kind!r}")
    return [(r, "".join(t)) for r, t in zip(roles, texts, strict=True)]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted chat, and the spans (code points) that a model learns from."""
    out, at, mask = [], 0, []
    for role, text in messages:
        head, body = HEAD + escape(role, True) + MID, escape(text)
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Inverse of render."""
    turns = [x.removeprefix(HEAD).partition(MID) for x in formatted.split(TAIL)[:-1]]
    return [(unescape(role), unescape(text)) for role, _, text in turns]


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted, mask array<struct<start, end>> for each conversation.

    events: conv_id long, seq long, kind, role, text string, target int; more columns are ignored.  Events are
    taken by seq, nulls first; ties by kind ('message' before the rest), role and text, so that the result
    doesn't depend on the rows' places; repeated rows are repeated events.  A null role or text is
    empty, a null kind is 'message'; rows with a null conv_id make one conversation.  A conversation
    is one row of the result and so must fit into one; conversations are spread by conv_id.
    """
    import pyarrow as pa

    order = F.struct("seq", F.coalesce(F.col("kind") != "message", F.lit(False)).alias("late"), "kind", "role", "text", "target")
    logs = events.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("log"))

    def run(batches):
        mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches):
            done = [render(fold(log)) for log in b.column("log").to_pylist()]
            spans = [[{"start": s, "end": e} for s, e in m] for _, m in done]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([t for t, _ in done], pa.string()), pa.array(spans, mask)], ["conv_id", "formatted", "mask"])

    return logs.mapInArrow(run, "conv_id long, formatted string, mask array<struct<start: bigint, end: bigint>>")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts say when read back."""
    import pyarrow as pa

    def run(batches):
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for b in slices(batches):
            rows = []
            for formatted, mask in zip(b.column("formatted").to_pylist(), b.column("mask").to_pylist(), strict=True):
                turns, learned = parse(formatted), "".join(unescape(formatted[m["start"] : m["end"]]) for m in mask)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(formatted)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, pa.string() if k in (1, 3) else pa.int64()) for k, c in enumerate(cols))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(rows: DataFrame) -> DataFrame:
    """A finished turn (conv_id, turn, role, text) as its event."""
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("int").alias("target"))


#: The conversation that the query adds, made of the template's own control strings.
CONTROL = "\\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(events_of(rows.unionByName(own))))
