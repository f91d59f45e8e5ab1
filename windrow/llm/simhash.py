"""SimHash near-duplicates: sharded vantage-point trees over 64-bit fingerprints.

A bounded sample of distinct fingerprints shapes a top tree whose leaves are
shards. Each distinct fingerprint has one home shard, and visits every other
shard that its ball of `radius` bits can reach by the triangle inequality, so
each close pair meets in the home shard of one of its ends. Within a shard a
second vantage-point tree prunes the comparisons, and only a spanning forest of
the links leaves the task: a group of g near copies gives at most g - 1 rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .textkit import LOWER, column_bytes, cut, given_back, slim

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints that shape the top tree: a bounded sample, whatever the input.
SAMPLE = 8192
#: Fingerprints a shard is meant to be home to, and the least number of shards.
HOME, SHARDS = 65536, 64
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all k-word shingles of a text."""
    words = text.translate(LOWER).split()  # bytes.split() parts at 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return 0
    k = min(k, n)
    joined = b" ".join(words)  # so that a shingle is a slice
    lengths = np.fromiter(map(len, words), np.int64, n)
    at = np.cumsum(lengths + 1) - lengths - 1
    first, last = at[: n - k + 1].tolist(), (at + lengths)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n - k + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[counts * 2 > len(hashes)].sum(dtype=np.uint64))


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bits of runs of 64-bit hashes, which begin at `first`."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    sizes = np.diff(np.r_[first, len(hashes)])
    return ((counts * 2 > sizes[:, None]) * _BITS).sum(1, dtype=np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t) for t in column_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row for each row of docs; null text is empty, and empty text has fingerprint 0."""
    return slim(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(given_back(_fingerprints), "doc_id long, fp long")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage_tree(points: np.ndarray, leaves: int) -> list[tuple]:
    """A top tree of at most `leaves` leaves, as nodes (vantage, threshold, near, far) or (shard,)."""
    nodes: list[tuple] = []
    shards = 0

    def grow(own: np.ndarray, want: int) -> int:
        nonlocal shards
        at = len(nodes)
        nodes.append(())
        # the vantage point whose distances spread most keeps the overlap of the halves small
        if want > 1 and len(own) > 1:
            tries = own[np.linspace(0, len(own) - 1, min(16, len(own))).astype(int)]
            spreads = [hamming(own, t).std() for t in tries]
            vantage = tries[int(np.argmax(spreads))]
            d = hamming(own, vantage)
            split = int(np.median(d))
            if (d <= split).all():
                split = int(d.max()) - 1
            if split >= 0 and (d <= split).any() and (d > split).any():
                near, far = grow(own[d <= split], want // 2), grow(own[d > split], want - want // 2)
                nodes[at] = (int(vantage), split, near, far)
                return at
        nodes[at] = (shards,)
        shards += 1
        return at

    grow(points, max(1, leaves))
    return nodes


def route(points: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, at home): each point's own shard and those that its ball reaches."""
    found: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node: tuple, index: np.ndarray, home: np.ndarray) -> None:
        if not len(index):
            return
        if len(node) == 1:
            found.append((index, node[0], home))
            return
        d = hamming(points[index], np.uint64(node[0]))
        near, inside = d - radius <= node[1], d <= node[1]
        walk(nodes[node[2]], index[near], (home & inside)[near])
        far = d + radius > node[1]
        walk(nodes[node[3]], index[far], (home & ~inside)[far])

    walk(nodes[0], np.arange(len(points)), np.ones(len(points), bool))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate([f[0] for f in found]), np.concatenate([np.full(len(f[0]), f[1], np.int32) for f in found]), np.concatenate([f[2] for f in found])


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; labels hold each class's smallest index."""
    while True:
        x, y = labels[a], labels[b]
        keep = x != y
        if not keep.any():
            return
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def shard_forest(points: np.ndarray, home: np.ndarray, radius: int, leaf: int = 512, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, root of i) that span the pairs within `radius` bits of which one end is at home here; direct: (i, the least j within `radius` bits of i)."""
    labels = np.arange(len(points))
    block = 1 << 20

    def walk(queries: np.ndarray, own: np.ndarray) -> None:
        """Pairs of queries with own: own are the homes of this branch, queries all that can reach them."""
        if not len(queries) or not len(own):
            return
        vantage = points[own[len(own) // 2]]
        d = hamming(points[own], vantage) if len(own) > leaf else None
        if d is not None:
            split = int(np.median(d))
            if (d <= split).all():
                split = int(d.max()) - 1
            if split >= 0 and (d <= split).any():
                far = hamming(points[queries], vantage)
                walk(queries[far - radius <= split], own[d <= split])
                walk(queries[far + radius > split], own[d > split])
                return
        step = max(1, block // len(own))
        for i in range(0, len(queries), step):
            q = queries[i : i + step]
            x, y = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[own][None, :]) <= radius)
            if direct:
                np.minimum.at(labels, q[x], own[y])
                np.minimum.at(labels, own[y], q[x])
            else:
                _settle(labels, q[x], own[y])

    walk(np.arange(len(points)), np.flatnonzero(home))
    linked = np.flatnonzero(labels != np.arange(len(points)))
    return linked, labels[linked]


def links(marks: DataFrame, radius: int = RADIUS, direct: bool = False) -> DataFrame:
    """Edges (u, v) between the ids of distinct fingerprints (columns fp, id) that span all links within `radius` bits.

    direct: every edge is itself within `radius` bits, and each fingerprint that has another so near is in one, but edges may not span all links.
    """
    n = marks.count()
    shape = marks.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()  # SAMPLE rows at most
    leaves = max(SHARDS, 2 ** math.ceil(math.log2(max(1, n / HOME))))
    nodes = vantage_tree(np.unique(np.array([r["fp"] for r in shape], np.int64).view(np.uint64)), leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            index, shard, home = route(fp.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[index]), pa.array(ids[index]), pa.array(home)], names=["shard", "fp", "id", "home"])

    def pair(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        child, root = shard_forest(table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(zero_copy_only=False), radius, direct=direct)
        return pa.table({"u": pa.array(ids[child]), "v": pa.array(ids[root])})

    return marks.select("fp", "id").mapInArrow(given_back(deal), "shard int, fp long, id long, home boolean").groupBy("shard").applyInArrow(given_back(pair), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Documents whose fingerprints differ in at most `radius` bits are linked;
    component_id is the smallest doc_id reachable. Texts without words have
    fingerprint 0 and link like any other. A row with a null id keeps its
    fingerprint and gets the component of that fingerprint (null if no row of
    the component has an id). Repeated rows appear as often as they come; other columns do not
    matter; an empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    marks = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    marks = cut(marks)
    groups = connected_components(links(marks, radius))
    named = marks.join(groups.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
