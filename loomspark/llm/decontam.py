"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-cased words (runs of word characters). A document is contaminated by an item of ``n`` words if one of its
substrings is within ``max_edits * n`` word edits of it.

1. Windows. A window within that distance shares a word trigram with the item on a nearby diagonal (by the q-gram
   lemma; shorter items share a shorter gram), so windows of ``n`` words are laid at these places only.
2. CGK random walk: a window and an item of the same length walk the same random bits; edits become few mismatches.
3. LSH: a number of times, ``samples`` coordinates of the walk are compared; a match in any of these tables is a
   candidate. Long items with many edits agree on fewer coordinates, so the number of tables is found for each length:
   enough that ``recall`` of items with all their allowed edits match (``needed_tables``).
4. Every candidate is verified by exact edit distance (bit-parallel, over words). Once an item is found, its distance is
   taken over the whole document, so ``edits`` is the least there is.

The items are cut into blocks of at most ``block_bytes``; each block travels in the closure of its own Python pass, and
the passes follow each other in one stage. Documents are never shuffled.

Edge cases: null and empty texts are clean; null or empty items are skipped; of items with one id the nearest counts;
repeated rows are judged one by one.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

_WORDS = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _bits(symbols: np.ndarray, step: int, seed: int) -> np.ndarray:
    """The random bit of each symbol at a step of the walk."""
    with np.errstate(over="ignore"):
        x = (symbols.astype(np.int64).view(np.uint64) + np.uint64(seed * 1_000_003 + step + 1) * _MIX[0]) * _MIX[1]
        x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return (x >> np.uint64(63)).astype(np.int64)


def cgk(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """CGK embedding of equally long sequences (k, n) into (k, 3n); -2 pads."""
    k, n = rows.shape
    padded = np.concatenate([rows, np.full((k, 1), -2, rows.dtype)], axis=1)
    at, out, line = np.zeros(k, np.int64), np.empty((k, 3 * n), rows.dtype), np.arange(k)
    for j in range(3 * n):
        out[:, j] = padded[line, at]
        at = np.minimum(n, at + _bits(out[:, j], j, seed))
    return out


def best_distance(item: list[int], text: list[int]) -> int:
    """Least edit distance between ``item`` and any substring of ``text`` (Myers' bit vectors)."""
    m = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best = m
    for w in text:
        eq = places.get(w, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        hp, hm = down | (ones & ~(h | up)), up & h
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = (hp << 1) & ones
        hm = (hm << 1) & ones
        up, down = hm | (ones & ~(x | hp)), hp & x
        best = min(best, score)
    return best


@functools.cache
def _table_hits(n: int, max_edits: float, samples: int, trials: int, seed: int) -> np.ndarray:
    """For random items and copies with all allowed edits: the share of tables in which some window around the copy matches."""
    rng, slack = np.random.default_rng(seed), math.floor(max_edits * n)
    shifts, rows, items = range(-slack, slack + 1), [], []
    for t in range(trials):
        fresh = iter(range(10 * t * n + n, 10 * (t + 1) * n + n))  # words that occur nowhere else
        item = [next(fresh) for _ in range(n)]
        copy = list(item)
        for _ in range(slack):
            at = int(rng.integers(len(copy)))
            copy[at : at + 1] = ([next(fresh)], [], [copy[at], next(fresh)])[int(rng.integers(3))]
        text = [next(fresh) for _ in range(slack)] + copy + [next(fresh) for _ in range(n + slack)]
        rows += [text[slack + s : slack + s + n] for s in shifts]
        items += [item] * len(shifts)
    same = cgk(np.array(rows)) == cgk(np.array(items))
    picks = rng.integers(0, 3 * n, (samples, 256))
    match = np.ones((len(same), 256), bool)
    for pick in picks:
        match &= same[:, pick]
    return match.reshape(trials, len(shifts), 256).any(axis=1).mean(axis=1)


def needed_tables(n: int, max_edits: float, samples: int, recall: float, trials: int = 60, seed: int = 12) -> int:
    """Tables at which ``recall`` of copies of ``n`` words with all allowed edits match, by simulation of the walk.

    Lengths are rounded up to a grid of steps of a quarter.
    """
    size = 4
    while size < n:
        size = max(size + 1, size * 5 // 4)
    miss = 1 - _table_hits(size, max_edits, samples, trials, seed)
    tables = 1
    while (miss**tables).mean() > 0.75 * (1 - recall) and tables < 1024:
        tables = tables + max(1, tables // 8)
    return tables


class Index:
    """The tables of one block of items; ``tables`` gives their number by the length of an item."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float, samples: int, tables: dict[int, int], seed: int = 11):
        self.max_edits, self.vocab, self.items = max_edits, {}, []
        for key, text in items:
            if ids := [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]:
                self.items.append((key, ids))
        self.sets = [frozenset(ids) for _, ids in self.items]
        self.size = len(self.vocab) + 1  # under 2**20 for a block of a few MB: three words fit 60 bits
        grams: dict[int, list[tuple[int, int]]] = {}
        for i, (_, ids) in enumerate(self.items):
            q = self.gram(len(ids))
            for at in range(len(ids) - q + 1):
                grams.setdefault(self.code(ids[at : at + q]), []).append((i, at))
        self.grams = grams
        self.codes = {q: np.array(sorted(c for c in grams if c >> 60 == q), dtype=np.int64) for q in (1, 2, 3)}
        rng = np.random.default_rng(seed)
        self.classes = {}
        for n in {len(ids) for _, ids in self.items}:
            own = [i for i, (_, ids) in enumerate(self.items) if len(ids) == n]
            picks = rng.integers(0, 3 * n, (tables[n], samples))
            walks = cgk(np.array([self.items[i][1] for i in own], dtype=np.int64))
            found = [{} for _ in range(tables[n])]
            for t in range(tables[n]):
                for i, sig in zip(own, walks[:, picks[t]].tolist(), strict=True):
                    found[t].setdefault(tuple(sig), []).append(i)
            self.classes[n] = (picks, found)

    def gram(self, n: int) -> int:
        """Words of the longest shared gram that the q-gram lemma grants at this length."""
        slack = math.floor(self.max_edits * n)
        return next((q for q in (3, 2) if n - q + 1 - q * slack >= 1), 1)

    def code(self, ids: list[int]) -> int:
        out = 0
        for x in ids:
            out = out * self.size + x + 1
        return out + (len(ids) << 60)

    def leaks(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text its contaminating items: (least distance, words of the item) by id."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        get = self.vocab.get
        flat, starts = [], [0]
        for t in texts:
            flat += [get(w, -1) for w in words(t)]
            flat += (-2, -2)  # no gram crosses
            starts.append(len(flat))
        ids, begins = np.array(flat, dtype=np.int64), np.array(starts)
        places: dict[int, set[tuple[int, int, int]]] = {}
        for q, codes in self.codes.items():
            if not len(codes) or len(ids) < q:
                continue
            m = len(ids) - q + 1
            code, known = np.zeros(m, np.int64), np.ones(m, bool)
            for k in range(q):
                code = code * self.size + ids[k : k + m] + 1
                known &= ids[k : k + m] >= 0
            code += q << 60
            at = np.flatnonzero(known)
            at = at[np.isin(code[at], codes)]
            for p, c, d in zip(at.tolist(), code[at].tolist(), (np.searchsorted(begins, at, side="right") - 1).tolist(), strict=True):
                for i, off in self.grams[c]:
                    n = len(self.items[i][1])
                    slack = math.floor(self.max_edits * n)
                    low, high = starts[d], max(starts[d], starts[d + 1] - 2 - n)
                    for s in range(max(low, p - off - slack), max(low, min(high, p - off + slack)) + 1):
                        places.setdefault(n, set()).add((s, d, 0))
        for n, found in places.items():
            every = sorted(found)
            for k in range(0, len(every), 20_000):
                self._class(n, every[k : k + 20_000], ids, starts, out)
        return out

    def _class(self, n: int, wins: list[tuple[int, int, int]], ids: np.ndarray, starts: list[int], out: list[dict[int, tuple[int, int]]]) -> None:
        first, doc = np.array([w[0] for w in wins]), [w[1] for w in wins]
        ends = np.array([starts[d + 1] - 2 for d in doc])
        cols = first[:, None] + np.arange(n)[None, :]
        rows = np.where(cols < ends[:, None], ids[np.minimum(cols, len(ids) - 1)], -2)
        walks = cgk(rows)
        picks, tables = self.classes[n]
        slack = math.floor(self.max_edits * n)
        done: set[tuple[int, int]] = set()
        known: set[tuple[int, int]] = set()  # (document, item): its distance is exact
        for t, table in enumerate(tables):
            for w, sig in enumerate(map(tuple, walks[:, picks[t]].tolist())):
                for i in table.get(sig, ()):
                    if (w, i) in done:
                        continue
                    done.add((w, i))
                    if (doc[w], i) in known:
                        continue
                    key, item = self.items[i]
                    lo, hi = max(starts[doc[w]], first[w] - slack), min(ends[w], first[w] + n + slack)
                    region = ids[lo:hi].tolist()
                    if len(self.sets[i].difference(region)) > slack:  # each missing word costs an edit
                        continue
                    if best_distance(item, region) <= slack:
                        known.add((doc[w], i))
                        exact = (best_distance(item, ids[starts[doc[w]] : ends[w]].tolist()), n)
                        out[doc[w]][key] = min(exact, out[doc[w]].get(key, exact))


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items on the driver, one block of about ``block_bytes`` at a time."""
    some = items.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = some.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = some if n == 1 else some.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]


def flagged(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_edits: float = 0.2, recall: float = 0.95, samples: int = 3, block_bytes: int = 4 << 20, out_col: str = "leaks") -> DataFrame:
    """``docs`` plus ``leaks``: array<struct<item_id, edits, n_words>> of contaminating items, by item_id; empty if clean.

    A column of that name in ``docs`` is replaced.
    """
    kind = items.schema[item_id].dataType.simpleString()
    docs = docs.drop(out_col)
    out = docs
    made = []
    for k, block in enumerate(item_blocks(items, item_id, item_text, block_bytes)):
        if not block and k:
            continue
        tables = {n: needed_tables(n, max_edits, samples, recall) for n in {len(words(text)) for _, text in block} - {0}}
        name = fresh(out, f"{out_col}{k}")

        def run(batches: Iterator[pa.RecordBatch], block=block, tables=tables, name=name) -> Iterator[pa.RecordBatch]:
            index = Index(block, max_edits, samples, tables)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                found: list = []
                for at in range(0, len(texts), 256):
                    found += [[{"item_id": i, "edits": d, "n_words": n} for i, (d, n) in sorted(x.items())] for x in index.leaks(texts[at : at + 256].to_pylist())]
                key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
                column = pa.array(found, pa.list_(pa.struct([("item_id", key_type), ("edits", pa.int32()), ("n_words", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        out = out.mapInArrow(run, f"{schema}, `{name}` array<struct<item_id: {kind}, edits: int, n_words: int>>")
        made.append(name)
    return out.select(*docs.columns, F.array_sort(F.flatten(F.array(*made))).alias(out_col))


def op1_decontam(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, n_words: every contaminated document with each of its items."""
    found = flagged(docs.select("doc_id", "text"), items)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.edits", "leak.n_words")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leak, in one pass."""
    name = fresh(docs, "leaks")
    return flagged(docs, items, out_col=name, **options).where(F.size(name) == 0).drop(name)
