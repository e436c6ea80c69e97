"""Alignment of two tokenizers over a corpus.

Tasks tokenize blocks of documents (a slice of an Arrow batch, about ``BLOCK`` bytes) with both tokenizers and lay the
block's documents end to end. Token ends of each tokenizer are counted by byte position once for the whole block; where
both have an end, the text is cut. Running sums over the block give each token its group and, by differences at the
documents' ends, each document its numbers.

How often an id pair is linked is a sum over the corpus. Each block sends its distinct pairs with their counts, so a pair
that every document holds is one row a block. The sums go back to the blocks the same way and meet the links that the
block has kept in the shared folder. Nothing is broadcast; a group is a block, or all pairs of one B id, at most as many as
A has ids.

A long text is a block of its own. The byte-level vocabulary has its merges in the order of its ids; tasks then read it as
ranks, which is several times faster and gives the same tokens. Texts with characters outside blocks of Unicode on which
all versions of its splitting pattern agree, or with very long runs of one class, are encoded from the file itself.

Edge cases: null and empty texts, and texts that don't come back byte for byte from either tokenizer's tokens, have no
tokens: zeros and no groups. Null and repeated ids stay, a row each. An empty table gives no rows; other columns than id
and text aren't read. Strings of special tokens are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are laid end to end.
BLOCK = 4 << 20
#: Splits words, numbers, marks and white space; a fixed value of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Latin, Greek, Cyrillic, kana, Han and common punctuation, as ranges: all versions of the pattern agree on them.
COMMON = ((0x20, 0x7E), (0xA1, 0x236), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x400, 0x481), (0x2010, 0x2027), (0x2030, 0x2052), (0x3001, 0x3002), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xFF01, 0xFF01), (0xFF0C, 0xFF0C))
SPACES = (0x09, 0x0A, 0x0D, 0x20)
#: Class of each code point below 2**16: 0 uncommon, 1 common, 2 white space.
_CLASS = np.zeros(1 << 16, np.uint8)
for _low, _high in COMMON:
    _CLASS[_low : _high + 1] = 1
_CLASS[list(SPACES)] = 2
#: Longest runs of white space and of anything else that the pattern is given.
RUNS = {2: 500, 1: 5000}


def common(text: str) -> bool:
    """Whether a text may take the fast way."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points) or points.max() >= len(_CLASS):
        return not len(points)
    kinds = _CLASS[points]
    if not kinds.all():
        return False
    if len(kinds) < min(RUNS.values()):
        return True
    starts = np.flatnonzero(np.diff(kinds, prepend=0))
    lengths = np.diff(starts, append=len(kinds))
    return all(lengths[kinds[starts] == k].max(initial=0) < most for k, most in RUNS.items())


class ByteLevel:
    """A byte-level BPE of a ``tokenizers`` file; the text gets a space in front."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        vocab = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items() if i not in special}
        self.entries = [vocab.get(i, special.get(i, "").encode()) for i in range(max([*vocab, *special]) + 1)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ordered = all(spec["model"]["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocab) == 256 + len(merges)
        split = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={b: i for i, b in vocab.items()}, special_tokens={}) if ordered and split else None

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of space and text; None where they don't spell it. Ranks lose no byte."""
        text = " " + text
        if self.fast is not None and common(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        ids = np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return ids if spelled(self, ids) == text.encode() else None


class Pieces:
    """A sentencepiece model with byte fallback; it puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.entries = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("\u2581", " ").encode() for i in range(n) for s in (self.model.id_to_piece(i),)]

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of space and text; None where they don't spell it."""
        ids = self.model.encode(text, num_threads=1)
        return np.array(ids, dtype=np.int32) if b"".join(map(self.entries.__getitem__, ids)) == b" " + text.encode() else None


def spelled(t: ByteLevel | Pieces, ids: np.ndarray) -> bytes:
    return b"".join(map(t.entries.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteLevel | Pieces:
    """One for each path and worker."""
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


@dataclass
class Aligned:
    """Documents of a block, end to end. ``a`` and ``b`` are ids, ``a_group`` and ``b_group`` the group of each token;
    ``*_ends`` say where each document ends in tokens, groups or links. ``links`` are pairs of ids, A << 32 | B."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    group_ends: np.ndarray
    links: np.ndarray

    def groups(self, doc: int) -> list[tuple[list[int], list[int]]]:
        """The groups of one document."""
        g0, g1 = (self.group_ends[doc - 1] if doc else 0), self.group_ends[doc]
        cut = lambda ids, of: [x.tolist() for x in np.split(ids, np.searchsorted(of, np.arange(g0, g1 + 1)))[1:-1]]
        return list(zip(cut(self.a, self.a_group), cut(self.b, self.b_group), strict=True))

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document, '' for one without tokens: written for the whole block."""
        n_groups = int(self.group_ends[-1]) if len(self.group_ends) else 0
        if not n_groups:
            return [""] * len(self.group_ends)
        in_a, in_b = np.bincount(self.a_group, minlength=n_groups), np.bincount(self.b_group, minlength=n_groups)
        a_upto, b_upto = np.cumsum(in_a), np.cumsum(in_b)
        at_a = np.arange(len(self.a)) + (b_upto - in_b)[self.a_group]
        at_b = np.arange(len(self.b)) + a_upto[self.b_group]
        ids = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        # a token is written as its digits and a mark: strings with "," first, then with "|", then with ";"
        size = 1 << int(ids.max()).bit_length()
        ids[at_a[a_upto - 1]] += size
        ids[at_b[b_upto - 1]] += 2 * size
        text = _written(size).take(pa.array(ids))
        ends = np.frombuffer(text.buffers()[1], np.int32)[1:]
        out = text.buffers()[2]
        text, found, begin = memoryview(out), [], 0
        for a_end, b_end in zip(self.a_ends, self.b_ends, strict=True):
            end = int(ends[a_end + b_end - 1]) if a_end + b_end else 0
            found.append(hashlib.sha256(text[begin : end - 1]).hexdigest() if end > begin else "")
            begin = max(begin, end)
        return found


@functools.lru_cache(maxsize=4)
def _written(size: int) -> pa.StringArray:
    """Each id below ``size`` with each of the marks."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], pa.string())


def align(texts: list[str | None], a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> Aligned:
    """Tokens and groups of some documents, found for all of them at once."""
    none = np.zeros(0, dtype=np.int32)
    lists: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    sizes = []
    for text in texts:
        got = [t.ids(text) for t in (a, b)] if text else [None]
        if any(x is None for x in got):
            got = [none, none]
        lists[0].append(got[0])
        lists[1].append(got[1])
        sizes.append(1 + len(text.encode()) if len(got[0]) else 0)
    base = np.cumsum([0, *sizes])
    ids, ends, counts, doc_ends = [], [], [], []
    for t, own in zip((a, b), lists, strict=True):
        flat = np.concatenate([none, *own])
        # documents lie end to end, so running sums of token lengths are positions in the block
        end = np.cumsum(_lengths(t)[flat])
        ids.append(flat)
        ends.append(end)
        counts.append(np.bincount(end, minlength=int(base[-1]) + 1))
        doc_ends.append(np.cumsum([len(x) for x in own], dtype=np.int64))
    cut = (counts[0] > 0) & (counts[1] > 0)
    upto = np.cumsum(cut)
    links = ids[0][cut[ends[0]]].astype(np.int64) << 32 | ids[1][cut[ends[1]]]
    group = [upto[e - 1] for e in ends]
    return Aligned(ids[0], ids[1], group[0], group[1], doc_ends[0], doc_ends[1], upto[base[1:]], links)


def _lengths(t: ByteLevel | Pieces) -> np.ndarray:
    if not hasattr(t, "lengths"):
        t.lengths = np.array([len(e) for e in t.entries], dtype=np.int64)
    return t.lengths


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Slices of the batches (ids, texts) of about ``size`` bytes; a document counts 64 more than it has."""
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        block = np.cumsum(lengths) // size
        starts = [*np.flatnonzero(np.diff(block, prepend=-1)), len(block)] if len(block) else [0]
        for s, e in zip(starts, starts[1:], strict=False):
            part = batch.slice(s, e - s)
            yield part.column("doc_id"), part.column("text").to_pylist()


def aligned(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, block: int = BLOCK) -> DataFrame:
    """(doc_id, groups array<struct<a array<int>, b array<int>>>): the ids of each group of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for ids, texts in _blocks(batches, block):
            found = align(texts, tokenizer(a), tokenizer(b))
            rows = [[{"a": x, "b": y} for x, y in found.groups(i)] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], names=["doc_id", "groups"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")


def linked_blocks(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two tables that are written at once, since what a block is called must not change.

    A row for each document: its numbers, digest, and its links as places among the distinct pairs of its block. A row for
    each distinct pair of a block (block, at, pair, n) with its count.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, link array<int>"
    names = ["block", *(c.split()[0] for c in own.split(", ")), "at", "pair", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, (ids, texts) in enumerate(_blocks(batches, block)):
            found = align(texts, tokenizer(a), tokenizer(b))
            at, pairs = pd.factorize(found.links)
            ends = pa.array(np.concatenate([[0], found.group_ends]), pa.int32())
            values = [np.diff(x, prepend=0) for x in (found.a_ends, found.b_ends, found.group_ends)]
            columns = [ids, *map(pa.array, values), pa.array(found.digests(), pa.string()), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32)))]
            name = lambda n, i=i: pa.array(np.full(n, task << 32 | i, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([name(len(ids)), *columns, *(pa.nulls(len(ids), t) for t in (pa.int32(), pa.int64(), pa.int64()))], names=names)
            if len(pairs):
                counts = [np.arange(len(pairs), dtype=np.int32), pairs, np.bincount(at)]
                yield pa.RecordBatch.from_arrays([name(len(pairs)), *(pa.nulls(len(pairs), c.type) for c in columns), *map(pa.array, counts)], names=names)

    both = materialise(docs.select("doc_id", "text").mapInArrow(run, f"block bigint, {own}, at int, pair bigint, n bigint"), "aligned")
    return both.where("n_groups IS NOT NULL").select(*names[:-3]), both.where("n IS NOT NULL").select("block", "at", "pair", "n")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold an id pair, and whether no pair of its B id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    own = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))  # as many rows as A has ids, at most
    return counts.withColumn("best", F.col("n") == own)


def link_counts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document, from ``linked_blocks``."""
    known = pairs.select("block", "at", "pair").join(pair_counts(pairs), "pair").select(F.col("block").alias("owner"), "at", "n", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(own: pa.Table, counts: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        n, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        at = counts.column("at").to_numpy()
        n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        links = pc.list_flatten(own.column("link")).to_numpy()
        ends = np.cumsum(own.column("n_groups").to_numpy())
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[links])])[ends], prepend=0) for v in (best, n)]
        first = own.select(["doc_id", "n_a", "n_b", "n_groups"]).columns
        return pa.Table.from_arrays([*first, first[-1], *map(pa.array, sums), own.column("groups_sha256")], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return docs.groupBy("block").cogroup(known.groupBy("owner")).applyInArrow(run, schema)  # a group is a block


def op12_align(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES) -> DataFrame:
    """One row for each document, by the contract of the query."""
    return link_counts(*linked_blocks(docs, a, b))
