"""Chat formatting: token-level assembly of conversations with a loss mask.

Every turn is encoded on its own: its role and its text are segments of ordinary tokens, and the
control marks around them are spliced in as reserved ids that no text can encode to:

    <s>  [INST] role [/INST] text </s>  [INST] role [/INST] text </s>  ...

Control strings inside a role or text are escaped by a backslash after their first character
(one more where there are some already), so an escaped text holds no control string and
``unescape`` gives back the original.  The loss mask is a prefix sum of +1 where an assistant's
text starts and -1 behind it; token offsets within a conversation are prefix sums of turn
lengths.  The output stays one row per turn: a conversation of any length is never one value.

Vocabulary: a byte-level BPE rank file, named by ``vocabulary`` (a path, or the name of a file of
the installed public vocabularies).  Byte-level encoding is reversible for every text.  Texts over
``PIECE`` characters are encoded in pieces, which bounds the encoder's work; a piece ends where the
vocabulary's own cutting ends a match, so that the ids are those of the whole text.

Defined results: a null text or role is an empty one; turns are ordered by turn (null first), then
role, then text, so repeated rows and equal turn numbers give every run the same order; a null
conversation id is a conversation of its own; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import ship

ship(__name__)

VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE = 20_000
LEARNED_ROLE = "assistant"
MARKS = ("<s>", "</s>", "[INST]", "[/INST]")
BEGIN, END, ROLE, SAYS = range(4)  # places of the marks; their ids follow the vocabulary's
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: str) -> str:
    return re.sub(CONTROL, r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return re.sub(ESCAPED, r"\1\2\3", text)


class Codec:
    """Ordinary tokens of a rank file plus reserved ids for the marks behind them."""

    def __init__(self, vocabulary: str):
        import base64
        import os

        import public_tokenizers
        import regex
        import tiktoken

        path = vocabulary if os.path.exists(vocabulary) else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.cutter = regex.compile(public_tokenizers.PATTERN)

    def mark(self, i: int) -> int:
        return self.first + i

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        start = 0
        for m in self.cutter.finditer(text):
            if m.end() - start >= PIECE:
                out += self.bpe.encode_ordinary(text[start:m.end()])
                start = m.end()
        return out + self.bpe.encode_ordinary(text[start:])

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode_bytes(ids.tolist()).decode("utf-8")


def _encoder(vocabulary: str, learned: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            ids, mask, sizes = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head, body = codec.encode(escape(role)), codec.encode(escape(text))
                turn = [codec.mark(ROLE), *head, codec.mark(SAYS), *body, codec.mark(END)]
                edge = np.zeros(len(turn) + 1, np.int8)
                if role == learned:
                    edge[len(head) + 2] += 1
                    edge[len(head) + 2 + len(body)] -= 1
                ids.append(turn)
                mask.append(np.cumsum(edge[:-1], dtype=np.int8))
                sizes.append(len(turn))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv_id", "turn", "role", "text")], pa.array(ids, pa.list_(pa.int32())),
                 pa.array(mask, pa.list_(pa.int8())), pa.array(sizes, pa.int64())],
                ["conv_id", "turn", "role", "text", "ids", "mask", "n_tokens"])
    return run


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY, learned: str = LEARNED_ROLE) -> DataFrame:
    """``conv_id, turn, role, text`` -> per turn ``conv_id, turn, place`` (1 ..), ``ids``, ``mask``
    (loss mask of each id), ``n_tokens`` and ``starts_at`` (offset in the conversation; its mark
    <s> is token 0 and belongs to the turn at place 1)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("mask", T.ArrayType(T.ByteType())), T.StructField("n_tokens", T.LongType())])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.mapInArrow(_encoder(vocabulary, learned), schema).withColumns(
        {"place": F.row_number().over(order).cast("long"), "before": before})
    begin = F.array(F.lit(reserved(vocabulary)[BEGIN]))
    first = lambda c, mark: F.when(F.col("place") == 1, F.concat(mark, c)).otherwise(F.col(c)).alias(c)
    return placed.select(
        "conv_id", "turn", "place", first("ids", begin), first("mask", F.array(F.lit(0).cast("byte"))),
        (F.col("n_tokens") + F.when(F.col("place") == 1, 1).otherwise(0)).alias("n_tokens"),
        F.when(F.col("place") == 1, 0).otherwise(F.col("before") + 1).cast("long").alias("starts_at"))


def reserved(vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of the marks."""
    codec = Codec(vocabulary)
    return [codec.mark(i) for i in range(len(MARKS))]


def _reader(vocabulary: str):
    def summary(conv, n, turns, loss, loss_chars, chars):
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        conv, n, turns, loss, loss_chars, chars = None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind = None
        for batch in batches:
            done = []
            kind = batch.schema.field("conv_id").type
            lists = batch.column("ids"), batch.column("mask")
            for i, (c, place) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("place").to_pylist(), strict=True)):
                if place == 1 and n:
                    done.append(summary(conv, n, turns, loss, loss_chars, chars))
                    n, turns, loss, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                conv = c
                ids, mask = (x[i].values.to_numpy() for x in lists)
                marks = ids - codec.first
                starts = np.flatnonzero(marks == ROLE) + 1
                says = np.flatnonzero(marks == SAYS)
                ends = np.flatnonzero(marks == END)
                for a, b, z in zip(starts, says, ends, strict=True):  # one turn here
                    role, text = unescape(codec.decode(ids[a:b])), unescape(codec.decode(ids[b + 1:z]))
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                plain = marks < 0
                learned = unescape(codec.decode(ids[(mask == 1) & plain]))
                loss.update(learned.encode())
                loss_chars += len(learned)
                chars += len(codec.decode(ids[plain])) + sum(len(MARKS[m]) for m in marks[~plain])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(list(zip(*done, strict=True)) or [[]] * 6,
                                                [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)
        if n:
            last = summary(conv, n, turns, loss, loss_chars, chars)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(last, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)
    return run


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, read from the ids alone: its turns' digest, the digest and
    length of the text under the loss mask, and the formatted length.  A task streams over its
    conversations turn by turn, whatever their length."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    sorted_ = (formatted.select("conv_id", "place", "ids", "mask").repartition(F.col("conv_id"))
               .sortWithinPartitions("conv_id", "place"))
    return sorted_.mapInArrow(_reader(vocabulary), f"conv_id {kind}, n_turns long, turns_sha256 string, "
                                                   "loss_chars long, loss_sha256 string, formatted_chars long")
