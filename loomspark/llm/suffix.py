"""Repeated-substring removal by blockwise suffix sorting with a difference cover.

Every byte that lies in a ``length``-byte string which also starts anywhere else is removed. Texts are UTF-8 bytes;
matches don't cross documents.

All suffixes of a corpus neither fit one machine nor a shuffle of its size, so they are sorted one bucket at a time,
after the difference cover has told which of them can tie at all:

1. Cover sample. ``D`` is a perfect difference set modulo 133: for any two places i and j some d < 133 puts both i + d
   and j + d into the cover. Two suffixes that agree on ``length`` bytes therefore agree on ``length - 132`` bytes at
   one and the same cover place. The sample suffixes (12 of 133) are named by those bytes, the names are dealt to
   buckets, each bucket is sorted on its own and the names that occur again go back to the chunks that hold them.
2. Remaining suffixes. Only suffixes with a repeated cover name ahead can be long ties. They are named by their
   ``length`` bytes, dealt to buckets and sorted in the same way; equal neighbours are repeats.
3. Each chunk marks the bytes of its repeated suffixes.

Names are fingerprints from running sums. For the cover a polynomial modulo 2**64 is enough (a false tie only adds a
candidate), cut to the bits that the corpus needs. The final names, which decide, are that polynomial and a second one
modulo the prime 2**31 - 1, 91 bits in all. Bases and the table of bytes are drawn anew for every run, so no texts can be
made to collide: any two different strings share the second name with a chance below ``length`` in 2**31, and the first
besides by chance in 2**60. Comparing names instead of bytes is what bounds a bucket's memory: it holds numbers and no
text. A name that a chunk holds many times is sent once, and the answer is a bit.

Exact copies are collapsed before texts are shuffled (each task sends a text once), so a group of copies weighs as
much as one text; the rows get their result by the digest of their text. Per chunk and bucket one row of packed
numbers is shuffled.

Edge cases: null texts are empty; texts shorter than ``length`` keep all bytes; a document that repeats itself loses
both places; repeated rows count as copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A perfect difference set: every residue modulo PERIOD is a difference of two of its members. Fixed values.
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
#: Bytes of text in a chunk, bytes hashed at a time, and bytes of text for a bucket of names.
CHUNK_BYTES, PART_BYTES, BUCKET_BYTES = 6 << 20, 2 << 20, 16 << 20

#: Prime of the second fingerprint: products of two residues fit 64 bits.
PRIME = (1 << 31) - 1


class Prints:
    """Fingerprints of substrings, from a seed that is drawn for a run and the same in all its tasks."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.table = draw.integers(0, (1 << 64) - 1, 256, dtype=np.uint64)
        self.base = int(draw.integers(1 << 62, 1 << 63)) * 2 + 1
        self.back = pow(self.base, -1, 1 << 64)
        self.small = np.arange(1, 257)
        self.small_base = int(draw.integers(1 << 20, PRIME - 1))
        self.small_back = pow(self.small_base, -1, PRIME)
        self.held: dict[int, np.ndarray] = {}

    def powers(self, base: int, n: int) -> np.ndarray:
        """base**0 ... base**(n - 1) modulo 2**64."""
        old = self.held.get(base)
        if old is None or len(old) < n:
            out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            out[0] = 1
            old = self.held[base] = np.cumprod(out)
        return old[:n]

    def residues(self, base: int, n: int) -> np.ndarray:
        """base**0 ... base**(n - 1) modulo PRIME, each step twice as many."""
        old = self.held.get(-base)
        if old is None or len(old) < n:
            old = np.ones(1, np.int64)
            while len(old) < max(n, 1 << 16):
                old = np.concatenate([old, old * pow(base, len(old), PRIME) % PRIME])
            self.held[-base] = old
        return old[:n]

    def running(self, data: np.ndarray) -> np.ndarray:
        """Running sums from which ``names`` reads the fingerprint of any substring."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers(self.base, len(data)), out=out[1:])
        return out

    def running_small(self, data: np.ndarray) -> np.ndarray:
        """The same for ``seconds``; a sum of residues of 2**32 bytes fits 63 bits."""
        out = np.zeros(len(data) + 1, np.int64)
        np.cumsum(self.small[data] * self.residues(self.small_base, len(data)) % PRIME, out=out[1:])
        return out

    def names(self, sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the ``size`` bytes at the given places; the last mixing step spreads the low bits."""
        x = (sums[at + size] - sums[at]) * self.powers(self.back, len(sums))[at]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x

    def seconds(self, sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Second fingerprints, independent of the first."""
        x = (sums[at + size] - sums[at]) % PRIME * self.residues(self.small_back, len(sums))[at] % PRIME
        return x.astype(np.uint32)


@functools.lru_cache(maxsize=2)
def prints(seed: int) -> Prints:
    """One for each run and worker: powers are kept."""
    return Prints(seed)


_IS_COVER = np.zeros(PERIOD, bool)
_IS_COVER[list(COVER)] = True


def cover_places(n_bytes: int, size: int) -> np.ndarray:
    """Cover places of a document at which ``size`` bytes remain."""
    last = n_bytes - size
    if last < 0:
        return np.empty(0, np.int64)
    rows = np.arange(last // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)
    flat = rows.ravel()
    return flat[flat <= last]


def _batches(texts: list[bytes], least: int) -> Iterator[list[int]]:
    """Indexes of the texts of at least ``least`` bytes, some PART_BYTES at a time."""
    part: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < least:
            continue
        part.append(i)
        size += len(t)
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class Names:
    """Membership in a sorted array of names."""

    def __init__(self, own: np.ndarray, bits: int, index_bits: int = 22):
        self.sorted, self.shift = own, np.uint64(bits - index_bits)
        self.index = np.zeros(1 << index_bits, bool)
        self.index[(own >> self.shift).astype(np.int64)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        if len(self.sorted):
            maybe = np.flatnonzero(self.index[(x >> self.shift).astype(np.int64)])
            y = x[maybe]
            at = np.minimum(np.searchsorted(self.sorted, y), len(self.sorted) - 1)
            out[maybe] = self.sorted[at] == y
        return out


def _pack(x: np.ndarray, second: np.ndarray | None = None) -> bytes:
    """Ascending names as differences, byte plane by byte plane: the high planes are zeros, which compress away."""
    steps = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    blob = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return blob if second is None else blob + second.astype("<u4").tobytes()


def _unpack(blob: bytes, second: bool) -> tuple[np.ndarray, np.ndarray | None]:
    flat = np.frombuffer(blob, np.uint8)
    n = len(flat) // (12 if second else 8)
    steps = np.ascontiguousarray(flat[: 8 * n].reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), flat[8 * n :].view("<u4") if second else None


class Distinct:
    """The distinct names among some, ascending: which they are, how often each occurs and where each name went."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None = None):
        order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
        a = first[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        if second is not None:
            b = second[order]
            new[1:] |= b[1:] != b[:-1]
        self.first, self.second = a[new], None if second is None else b[new]
        self.to = np.empty(len(a), np.int64)
        self.to[order] = np.cumsum(new) - 1
        self.counts = np.bincount(self.to, minlength=len(self.first))


def _cover_names(texts: list[bytes], length: int, seed: int, bits: int) -> np.ndarray:
    size, p = length - PERIOD + 1, prints(seed)
    out = []
    for part in _batches(texts, length):
        data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
        begins = np.cumsum([0] + [len(texts[i]) for i in part[:-1]])
        at = np.concatenate([b + cover_places(len(texts[i]), size) for b, i in zip(begins, part, strict=True)])
        out.append(p.names(p.running(data), at, size) >> np.uint64(64 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def candidates(cover: np.ndarray, at: np.ndarray, n_bytes: int, repeated: Names, length: int) -> np.ndarray:
    """Places of a document whose suffix may tie: a repeated name lies ahead among its cover places ``at``."""
    hit = at[repeated.has(cover)]
    if not len(hit):
        return hit
    marks = np.zeros(n_bytes + 2, np.int32)
    np.add.at(marks, np.maximum(hit - PERIOD + 1, 0), 1)
    np.add.at(marks, hit + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[: n_bytes - length + 1] > 0)


def _windows(texts: list[bytes], repeated: Names, length: int, seed: int, bits: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """(index of a text, its candidate places) of each text that has any, and both names of all these places in order."""
    size, p = length - PERIOD + 1, prints(seed)
    places, first, second = [], [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for part in _batches(texts, length):
        data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
        sums, begin, here = p.running(data), 0, []
        for i in part:
            at = cover_places(len(texts[i]), size)
            at = candidates(p.names(sums, begin + at, size) >> np.uint64(64 - bits), at, len(texts[i]), repeated, length)
            if len(at):
                places.append((i, at))
                here.append(begin + at)
            begin += len(texts[i])
        if here:
            at = np.concatenate(here)
            first.append(p.names(sums, at, length) >> np.uint64(64 - NAME_BITS))
            second.append(p.seconds(p.running_small(data), at, length))
    return places, np.concatenate(first), np.concatenate(second)


#: Bits of a first name; 31 more are the second's.
NAME_BITS = 60
_DEALT = "bucket int, chunk int, names binary, twice binary"
_HEARD = "chunk int, kind int, bucket int, again binary"


def cover_bits(n_bytes: int) -> int:
    """Bits of a cover name: enough that a name is repeated by chance once in 2**16 names."""
    return min(60, max(32, (n_bytes * len(COVER) // PERIOD).bit_length() + 16))


def _edges(own: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins in a chunk's ascending names; a bucket is a range of names."""
    to = ((own >> np.uint64(bits - 24)) * np.uint64(buckets)) >> np.uint64(24)
    return np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))


def _dealt(chunk: int, own: Distinct, bits: int, buckets: int) -> pd.DataFrame:
    """One row for each bucket: the names of a chunk, each once, and which of them it holds more than once."""
    edges = _edges(own.first, bits, buckets)  # a chunk sends a row for each bucket that it has names for: at most one a name
    seconds = lambda x, y: None if own.second is None else own.second[x:y]
    rows = [(b, chunk, _pack(own.first[x:y], seconds(x, y)), np.packbits(own.counts[x:y] > 1).tobytes()) for b in np.flatnonzero(np.diff(edges)).tolist() for x, y in [edges[b : b + 2]]]
    return pd.DataFrame(rows, columns=["bucket", "chunk", "names", "twice"])


def _sort_bucket(kind: int):
    """Sort the names of one bucket; each chunk hears, as bits, which of its names are repeated anywhere."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = [_unpack(b, kind == 1) for b in rows["names"]]
        sizes = [len(x) for x, _ in own]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(rows["twice"], sizes, strict=True)])
        every = Distinct(np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own]) if kind == 1 else None)
        again = (every.counts + np.bincount(every.to, weights=twice, minlength=len(every.counts)) > 1)[every.to]
        ends = np.cumsum(sizes)
        out = [(chunk, kind, bucket, np.packbits(again[e - n : e]).tobytes()) for chunk, bucket, e, n in zip(rows["chunk"], rows["bucket"], ends, sizes, strict=True) if again[e - n : e].any()]
        return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "again"])

    return run


def _repeated(own: Distinct, heard: pd.DataFrame, kind: int, bits: int, buckets: int) -> np.ndarray:
    """Which names of a chunk its buckets report as repeated."""
    edges = _edges(own.first, bits, buckets)
    hit = np.zeros(len(own.first), bool)
    heard = heard[heard["kind"] == kind]
    for b, again in zip(heard["bucket"], heard["again"], strict=True):
        x, y = edges[b], edges[b + 1]
        hit[x:y] = np.unpackbits(np.frombuffer(again, np.uint8), count=y - x).astype(bool)
    return hit


def removed(text: bytes, at: np.ndarray, length: int) -> tuple[int, int, str]:
    """(bytes removed, maximal removed runs, sha256 of what is left) for repeated suffixes at ``at``, ascending."""
    if not len(at):
        return 0, 0, hashlib.sha256(text).hexdigest()
    cut = np.flatnonzero(np.diff(at) > length)
    begins, ends = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + length
    left, last = hashlib.sha256(), 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        left.update(text[last:a])
        last = b
    left.update(text[last:])
    return int((ends - begins).sum()), len(begins), left.hexdigest()


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``.

    ``length`` must be more than the cover's period plus a few bytes (at least 141).
    """
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(8, math.ceil(total / chunk_bytes))
    buckets = max(16, math.ceil(total / BUCKET_BYTES))
    digest = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    own = docs.select(F.pmod(F.xxhash64(digest), F.lit(chunks)).cast("int").alias("chunk"), digest.alias("digest"), text.alias("data"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's texts, each once; a second row without text says that the task has seen a copy."""
        seen: set[bytes] = set()
        copied: dict[bytes, int] = {}
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (chunk, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if d in seen:
                    copied[d] = chunk
                else:
                    seen.add(d)
                    keep[i] = True
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, names=["chunk", "digest", "data"])
        rest = [pa.array(list(copied.values()), pa.int32()), pa.array(list(copied), pa.binary()), pa.nulls(len(copied), pa.binary())]
        yield pa.RecordBatch.from_arrays(rest, names=["chunk", "digest", "data"])

    dealt = own.mapInArrow(once, "chunk int, digest binary, data binary").groupBy("chunk")

    def texts_of(rows: pd.DataFrame) -> tuple[list[bytes], list[bytes], list[bool]]:
        """(digests, texts, whether there are copies) of a chunk."""
        held: dict[bytes, list] = {}
        for d, t in zip(rows["digest"], rows["data"], strict=True):
            x = held.setdefault(bytes(d), [None, 0])
            x[0], x[1] = t if x[0] is None else x[0], x[1] + 1
        keys = sorted(held)
        return keys, [bytes(held[k][0]) for k in keys], [held[k][1] > 1 for k in keys]

    seed, bits = secrets.randbits(64), cover_bits(total)

    def known(texts: list[bytes], heard: pd.DataFrame) -> tuple[list[tuple[int, np.ndarray]], Distinct]:
        """The candidate places of a chunk, and their names, from what it heard of its cover names."""
        own = Distinct(_cover_names(texts, length, seed, bits))
        repeated = Names(own.first[_repeated(own, heard, 0, bits, buckets)], bits)
        places, first, second = _windows(texts, repeated, length, seed, bits)
        return places, Distinct(first, second)

    def sample(rows: pd.DataFrame) -> pd.DataFrame:
        return _dealt(int(rows["chunk"].iloc[0]), Distinct(_cover_names(texts_of(rows)[1], length, seed, bits)), bits, buckets)

    def remaining(rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or heard.empty:
            return pd.DataFrame([], columns=["bucket", "chunk", "names", "twice"])
        return _dealt(int(rows["chunk"].iloc[0]), known(texts_of(rows)[1], heard)[1], NAME_BITS, buckets)

    def mark(rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if rows.empty:
            return pd.DataFrame(out, columns=["digest", "n_removed", "n_spans", "kept_sha256"])
        keys, texts, copied = texts_of(rows)
        places: dict[int, np.ndarray] = {}
        if not heard.empty:
            found, own = known(texts, heard)
            again, at_ = _repeated(own, heard, 1, NAME_BITS, buckets)[own.to], 0
            for i, at in found:
                places[i] = at[again[at_ : at_ + len(at)]]
                at_ += len(at)
        nothing = np.empty(0, np.int64)
        for i, (key, t) in enumerate(zip(keys, texts, strict=True)):
            at = np.arange(len(t) - length + 1) if copied[i] and len(t) >= length else places.get(i, nothing)
            out.append((key, *removed(t, at, length)))
        return pd.DataFrame(out, columns=["digest", "n_removed", "n_spans", "kept_sha256"])

    cover = dealt.applyInPandas(sample, _DEALT).groupBy("bucket").applyInPandas(_sort_bucket(0), _HEARD)
    rest = dealt.cogroup(cover.groupBy("chunk")).applyInPandas(remaining, _DEALT)
    final = rest.groupBy("bucket").applyInPandas(_sort_bucket(1), _HEARD)
    # one plan: the exchanges of texts and of cover names are made once and read again
    marked = dealt.cogroup(cover.union(final).groupBy("chunk")).applyInPandas(mark, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    thin = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), digest.alias("digest"))
    return thin.join(marked, "digest").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_suffix(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the whole table."""
    return repeated_bytes(docs).withColumnRenamed("id", "doc_id")
