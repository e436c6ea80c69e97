"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint per document; fingerprints that differ in at most ``max_bits`` bits are linked. The bits
are cut into ``m`` blocks; two fingerprints that differ in ``k`` bits agree on at least ``m - k`` blocks, so each
fingerprint is keyed by every choice of ``m - k`` blocks and only rows with an equal key are compared.

Copies are collapsed before the join (one row per distinct fingerprint), a bucket emits a spanning forest of its
links rather than all pairs, and a bucket above ``hot_bucket`` rows is resolved by bit-flip neighbours, whose
number grows in proportion to the bucket. No link is lost in any of the cases.

``similar_classes`` and ``keep_similar`` link texts by a similarity instead of a number of bits: fingerprints are as
long as blocks are needed, so that texts whose sets of ``shingle`` words have Jaccard similarity ``similarity`` share a
block with probability ``recall`` or more; those that share one are verified by the Hamming distance of ``SKETCH`` bits.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; null ids take part, but a
component's id is the smallest non-null id (null if there is none); repeated rows give one output row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

BITS = 64


def shingle_hashes(data: bytes | None, shingle: int, seed: int = 42) -> list[int]:
    words = (data or b"").lower().split()  # both work on ASCII only, as the definition of a word asks
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return [digest(joined[a:b], seed) for a, b in spans]


def fingerprint(data: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the UTF-8 bytes of a text, over word shingles, repeats included."""
    hashes = shingle_hashes(data, shingle, seed)
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, digest, fp): ``fp`` is the fingerprint's bits as a signed long, ``digest`` the text's MD5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["id", "digest", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"), _digest(F.col(text_col)).alias("digest"))
    return thin.mapInArrow(run, f"id {kind}, digest binary, fp bigint")


def block_masks(m: int, max_bits: int) -> list[int]:
    """A mask for every choice of ``m - max_bits`` of ``m`` blocks."""
    edges = [BITS * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(pick) for pick in combinations(blocks, m - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _longs(values: list[int]) -> Column:
    """An array literal, folded by the optimiser."""
    return F.split(F.lit(",".join(str(_signed(v)) for v in values)), ",").cast("array<bigint>")


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected within ``max_bits`` in one bucket; at most one per member."""
    edges, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found = rest[near]
                edges += [(x, y) for y in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _bucket_links(max_bits: int):
    def flush(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a: list = []
        b: list = []
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        small = np.repeat(sizes <= 8, sizes)
        for lag in range(1, 8):  # small buckets of all keys at once
            same = (keys[lag:] == keys[:-lag]) & small[lag:]
            at = np.flatnonzero(same)
            at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= max_bits]
            a.append(fps[at])
            b.append(fps[at + lag])
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            if links := _forest(fps[s : s + n], max_bits):
                x = np.array(links, dtype=np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        cat = lambda parts: np.concatenate(parts).astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cat(a)), pa.array(cat(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
            if last:
                yield flush(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield flush(keys, fps)

    return run


def _flip_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links within ``max_bits`` by neighbours: x and y are that close iff some value lies within half of it of both.

    Rows within the smaller half hang together by that value, those within the larger half hang on one of them.
    Rows: a constant per fingerprint, whatever the size of its bucket.
    """
    low = max_bits // 2
    flips = lambda n: [sum(1 << i for i in pick) for k in range(n + 1) for pick in combinations(range(BITS), k)]
    at = lambda n: fps.select("fp", F.explode(_longs(flips(n))).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("c"))
    hubs = at(low).groupBy("c").agg(F.min("fp").alias("hub"))
    return at(max_bits - low).join(hubs, "c").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def links(fps: DataFrame, max_bits: int = 3, n_fps: int | None = None, hot_bucket: int = 20_000) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (column ``fp``) to connect all that are connected."""
    n = fps.count() if n_fps is None else n_fps
    m = next(m for m in (max_bits + 2, max_bits + 3, max_bits + 4, max_bits + 5) if m == max_bits + 5 or n <= 1 << (BITS * (m - max_bits) // m - 4))
    masks = block_masks(m, max_bits)
    keyed = fps.select("fp", F.posexplode(_longs(masks)).alias("i", "mask")).select(F.xxhash64("i", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_bucket).select("key")
    extra = None
    if not hot.isEmpty():
        hot = materialise(hot, "simhash-hot")  # at most one key for each hot_bucket rows
        extra = _flip_links(keyed.join(hot, "key", "left_semi").select("fp").distinct(), max_bits)
        keyed = keyed.join(hot, "key", "left_anti")
    found = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links(max_bits), "a bigint, b bigint")
    return found if extra is None else found.unionByName(extra)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node of ``edges`` (a, b).

    Each round takes the smallest root among neighbours, then the root's root; rounds grow with the logarithm of a
    component's width. Every round is written to the shared folder.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("x")).select("node", F.least("node", "x").alias("root")), "roots")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = now.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = low.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        step = materialise(step, "roots")
        now = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return now


#: Bits by which texts that share a block are verified, and blocks that are joined before all others.
SKETCH, FIRST_BLOCKS = 192, 6


def _disagree(similarity: float) -> float:
    """Expected share of differing bits between the fingerprints of two sets of that Jaccard similarity (and equal size)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def block_plan(n: int, similarity: float, recall: float) -> tuple[int, int, int]:
    """(bits of a block, blocks, differing bits of a sketch allowed) for ``n`` texts.

    Blocks are as wide as it takes that unrelated texts share one seldom, and as many as it takes that texts of the asked
    similarity share one with probability ``(1 + recall) / 2``; the sketch lets as large a part of them pass.
    """
    off, each = _disagree(similarity), (1 + recall) / 2
    width = max(16, n.bit_length())
    blocks = math.ceil(math.log(1 - each) / math.log(1 - (1 - off) ** width))
    z = next(z / 100 for z in range(1000) if 0.5 * (1 + math.erf(z / 100 / math.sqrt(2))) >= each)
    return width, blocks, math.floor(SKETCH * off + z * math.sqrt(SKETCH * off * (1 - off)))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wide_bits(data: bytes | None, shingle: int, longs: int) -> np.ndarray:
    """SimHash of ``64 * longs`` bits (as zeros and ones) over the distinct word shingles of a text."""
    hashes = np.unique(np.array(shingle_hashes(data, shingle), dtype=np.uint64))
    counts = np.zeros(64 * longs, np.int32)
    with np.errstate(over="ignore"):
        salts = _mixed(np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, len(hashes), 255):  # 255 ones fit a byte
        bits = np.unpackbits(_mixed(hashes[at : at + 255, None] ^ salts).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return (2 * counts > len(hashes)).astype(np.uint8)


def _node(fps: np.ndarray) -> np.ndarray:
    """One long for each sketch (rows of longs)."""
    out = np.zeros(len(fps), np.uint64)
    for i in range(fps.shape[1]):
        out = _mixed(out + fps[:, i])
    return out


def _sketch_links(max_bits: int):
    """For buckets of sketches (key, label, longs): pairs of labels that connect what is connected within ``max_bits``."""

    def far(x: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x).sum(axis=1, dtype=np.int64) > max_bits

    def flush(keys: np.ndarray, labels: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(keys), bool)  # equal sketches of one bucket stand together: each once
        new[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1]).any(axis=1)
        keys, labels, fps = keys[new], labels[new], fps[new]
        pairs = []
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        small = np.repeat(sizes <= 8, sizes)
        for lag in range(1, 8):  # small buckets of all keys at once
            at = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:] & (labels[lag:] != labels[:-lag]))
            at = at[~far(fps[at] ^ fps[at + lag])]
            pairs.append(np.stack([labels[at], labels[at + lag]], axis=1))
        for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            rest = np.arange(s + 1, s + n)
            queue = [s]
            while len(rest):
                x = queue.pop() if queue else None
                if x is None:
                    x, rest = int(rest[0]), rest[1:]
                apart = far(fps[rest] ^ fps[x])
                if not apart.all():
                    found = rest[~apart]
                    others = np.unique(labels[found])
                    others = others[others != labels[x]]
                    pairs.append(np.stack([np.full(len(others), labels[x]), others], axis=1))
                    queue += found.tolist()
                    rest = rest[apart]
        every = np.concatenate(pairs).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[2:]], axis=1)
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if last or (held and held[0][0][-1] != keys[0]):
                held.append((keys[:last], labels[:last], fps[:last]))
                yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((keys[last:], labels[last:], fps[last:]))
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """(id, digest, root) of each row: ``root`` names the class of texts that are connected by links of that similarity.

    ``FIRST_BLOCKS`` are joined first. The classes that they make are labels in the join of all other blocks, where every
    text is still compared: only pairs of different labels are put out, so a large class sends few of its links.
    """
    width, n_blocks, max_bits = block_plan(docs.count(), similarity, recall)
    longs = math.ceil(max(SKETCH, width * n_blocks) / 64)
    names = [f"f{i}" for i in range(SKETCH // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
        order = np.arange(1, n_blocks + 1, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            fps, blocks = np.zeros((batch.num_rows, len(names)), np.uint64), []
            for i, x in enumerate(batch.column(1)):
                bits = wide_bits(x.as_py(), shingle, longs)
                fps[i] = np.packbits(bits[:SKETCH], bitorder="little").view("<u8")
                key = fps[i].tobytes()
                if key in seen:  # a task sends the blocks of a fingerprint once
                    blocks.append(None)
                else:
                    seen.add(key)
                    cut = bits[: width * n_blocks].reshape(n_blocks, width).astype(np.uint64) @ powers
                    blocks.append(_mixed(cut ^ _mixed(order)).view(np.int64))
            longs_ = [pa.array(fps[:, k].view(np.int64)) for k in range(len(names))]
            node = pa.array(_node(fps).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), node, *longs_, pa.array(blocks, pa.list_(pa.int64()))], names=["id", "digest", "node", *names, "blocks"])

    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"), _digest(F.col(text_col)).alias("digest"))
    prints = thin.mapInArrow(run, f"id {kind}, digest binary, node bigint, {', '.join(n + ' bigint' for n in names)}, blocks array<bigint>")
    prints = materialise(prints, "sketches")
    sent = prints.where("blocks IS NOT NULL").select("node", *names, "blocks")
    linked = lambda keyed: connected_components(keyed.repartition("key").sortWithinPartitions("key", *names).mapInArrow(_sketch_links(max_bits), "a bigint, b bigint"))
    first = linked(sent.select(F.explode(F.slice("blocks", 1, FIRST_BLOCKS)).alias("key"), F.col("node").alias("label"), *names))
    first = first.withColumnRenamed("root", "label")
    named = sent.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    second = linked(named.select(F.explode(F.slice("blocks", FIRST_BLOCKS + 1, max(0, n_blocks - FIRST_BLOCKS))).alias("key"), "label", *names))
    out = prints.select("id", "digest", "node").join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return out.join(second.withColumnRenamed("node", "label"), "label", "left").select("id", "digest", F.coalesce("root", "label").alias("root"))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, hot_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest, fp) of each row, and (fp, component_id, root) of each fingerprint; ``root`` names its component."""
    prints = materialise(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    reps = materialise(prints.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    roots = connected_components(links(reps.select("fp"), max_bits, reps.count(), hot_bucket))
    linked = reps.join(roots.withColumnRenamed("node", "fp"), "fp")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("low"))
    named = linked.join(smallest, "root").select("fp", "low", "root")
    of = reps.join(named, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints, materialise(of, "classes")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, hot_bucket: int = 20_000) -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``; the class of a fingerprint holds all its copies."""
    prints, of = _classes(docs, id_col, text_col, shingle, max_bits, hot_bucket)
    return prints.join(of, "fp").select("id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of the whole table."""
    return components(docs).select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _first_of(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each root of ``classes`` (id, digest, root): the first by id (rows without an id last) and digest.

    A row is known by id and digest, so rows without an id and rows of one id in several classes are kept; rows equal in
    both are one row.
    """
    rows = classes.groupBy("root", "id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n")).alias("k"))
    key, mark = fresh(docs, "kept_id"), fresh(docs, "kept_digest")
    kept = materialise(first.select(F.col("k.id").alias(key), F.col("k.digest").alias(mark), F.col("k.n").alias("n")), "kept")
    out = docs.join(kept.select(key, mark), docs[id_col].eqNullSafe(kept[key]) & _digest(docs[text_col]).eqNullSafe(kept[mark]), "left_semi")
    return out if kept.where("n > 1").isEmpty() else out.withColumn(mark, _digest(F.col(text_col))).dropDuplicates([id_col, mark]).drop(mark)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, hot_bucket: int = 20_000) -> DataFrame:
    """One row of ``docs`` for each component of fingerprints within ``max_bits``."""
    prints, of = _classes(docs, id_col, text_col, shingle, max_bits, hot_bucket)
    return _first_of(docs, prints.join(of, "fp").select("id", "digest", "root"), id_col, text_col)


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class of ``similar_classes``, whose options these are."""
    return _first_of(docs, similar_classes(docs, id_col, text_col, **options), id_col, text_col)
