"""Chat formatting with Spark expressions only.

A conversation is formatted in windows of turns. The turns of a window are collected as structs and sorted, adjacent
turns of one role become one message, and the message's parts are joined with marks:

    <s> <|start|>role<|message|>text<|part|>text of the next turn<|end|> <|start|>...

(without the spaces). A control string that stands in a role or text gets a backslash after its first character, or one
more than it has there, as a quoted line of mail gets one more ``>``: it can't be read as a mark, and taking one backslash
away gives the text back. No control string holds its own first character a second time, so none can begin inside another
or across a mark. The loss mask is a list of spans over the formatted text: what the assistant says, without marks.

A window holds the turns with one ``turn div window`` (256 turns), so no task gathers a conversation of any length; each
window is a text of its own. Only digests over a whole conversation read it in order, as a stream.

Edge cases: null texts and roles are empty; a null turn comes before all others, in the first window; a null id is a
conversation of its own; equal turns are ordered by role and text, and repeated rows stay. An empty table gives no rows,
whatever other columns there are isn't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
BEGIN, START, MESSAGE, PART, END = "<s>", "<|start|>", "<|message|>", "<|part|>", "<|end|>"
#: Marks of this template and of others that a tokenizer may know; fixed values.
CONTROL = (BEGIN, "</s>", "[INST]", "[/INST]", START, MESSAGE, PART, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
TRAINED = "assistant"


#: The first character of a control string that follows, whatever backslashes stand between.
_HEAD = "|".join(f"{re.escape(f)}(?=\\\\*(?:{'|'.join(re.escape(c[1:]) for c in CONTROL if c[0] == f)}))" for f in sorted({c[0] for c in CONTROL}))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"({_HEAD})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_HEAD})\\\\", "$1")


def _merge(messages: Column, turn: Column) -> Column:
    """A turn joins the last message if it has its role, else it begins one."""
    n = F.size(messages)
    last = F.get(messages, n - 1)
    joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
    own = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
    return F.when(last["role"] == turn["role"], F.concat(F.slice(messages, F.lit(1), n - 1), F.array(joined))).otherwise(F.concat(messages, F.array(own)))


def _pieces(message: Column) -> Column:
    """What each text of a message is written with: marks before, the text, marks after."""
    head = F.concat(F.lit(START), message["role"], F.lit(MESSAGE))
    return F.transform(
        message["texts"],
        lambda text, i: F.struct(
            F.when(i == 0, head).otherwise(F.lit(PART)).alias("before"),
            text.alias("text"),
            F.when(i == F.size(message["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("after"),
            (message["role"] == TRAINED).alias("trained"),
        ),
    )


def _spans(pieces: Column) -> Column:
    """Where the trained texts stand: running lengths, folded over the pieces."""
    start = F.struct(F.lit(len(BEGIN)).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["before"])
        end = begin + F.length(p["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + F.length(p["after"])).alias("at"), F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def formatted(conversations: DataFrame, window: int = WINDOW) -> DataFrame:
    """(conv_id, window, text, loss_spans array<struct<start, end>>): a row for each window of a conversation."""
    turn = F.struct("turn", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / window), F.lit(0)).cast("long")
    c = conversations.select("conv_id", part.alias("window"), turn.alias("t"))
    c = c.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    none = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")
    c = c.select("conv_id", "window", F.aggregate("turns", none, _merge).alias("messages"))
    c = c.select("conv_id", "window", F.flatten(F.transform("messages", _pieces)).alias("pieces"))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), ""))
    return c.select("conv_id", "window", text.alias("text"), _spans(F.col("pieces")).alias("loss_spans"))


def read_back(out: DataFrame) -> DataFrame:
    """(conv_id, window, turns array<struct<role, text>>, losses array<string>, chars) from formatted text and spans alone."""
    cut = lambda marks: "|".join(map(re.escape, marks))
    messages = F.transform(F.slice(F.split("text", cut([START]), -1), 2, 1 << 30), lambda m: F.split(m, cut([MESSAGE, END]), -1))
    turns = F.transform(messages, lambda m: F.transform(F.split(F.get(m, F.lit(1)), cut([PART]), -1), lambda t: F.struct(unescape(F.get(m, F.lit(0))).alias("role"), unescape(t).alias("text"))))
    losses = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return out.select("conv_id", "window", F.flatten(turns).alias("turns"), losses.alias("losses"), F.length("text").cast("long").alias("chars"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and digests of each conversation, whose windows come in order: no more than a batch is held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, begun, kind = None, False, None
    n = loss = chars = 0
    said = learnt = None

    done: list[list] = []

    def row() -> None:
        done.append([key, n, said.hexdigest(), loss, learnt.hexdigest(), chars])

    def flush() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return got

    for b in batches:
        kind = b.column("conv_id").type
        for this, turns, spoken, trained, length in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n_turns", "said", "learnt", "chars")), strict=True):
            if not begun or this != key:
                if begun:
                    row()
                key, begun, n, loss, chars, said, learnt = this, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            said.update(spoken.encode())
            learnt.update(trained.encode())
            n, loss, chars = n + turns, loss + len(trained), chars + length
        if done:
            yield flush()
    if begun:
        row()
        yield flush()


def op11_chat(conversations: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted text, by the contract of the query."""
    id_type = conversations.schema["conv_id"].dataType
    probe = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(2).select(F.lit(-1).cast(id_type).alias("conv_id"), F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(formatted(rows))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    thin = back.select("conv_id", "window", F.size("turns").cast("long").alias("n_turns"), spoken.alias("said"), F.array_join("losses", "").alias("learnt"), "chars")
    one = thin.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return one.mapInArrow(_digests, f"conv_id {id_type.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
