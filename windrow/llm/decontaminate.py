"""Benchmark decontamination: q-gram lemma filter over diagonal bands, verified by banded alignment.

Texts and items are compared as bytes: ASCII letters lowered, every run of
other ASCII bytes one space. An item of m bytes occurs within k = floor(rate * m)
edits only if one band of k + 1 neighbouring diagonals, taken from overlapping
bands of twice that width, holds m - q + 1 - k q of its q-grams. Bands that
reach this bound are aligned within the edit budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import column_bytes, given_back, slim

Q = 8
#: Edits allowed for each byte of an item. At most 1 / Q, or the bound says nothing.
RATE = 0.1
#: Bytes of items in one broadcast block; a larger benchmark is taken block after block.
ITEM_BYTES = 4 << 20
_TABLE_BITS = 22

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))


def fold(text: bytes) -> bytes:
    """Lowered text whose runs of other ASCII bytes are single spaces, without them at the ends."""
    return b" ".join(text.translate(_FOLD).split())


def codes(block: np.ndarray) -> np.ndarray:
    """Each q-gram as one 64-bit number."""
    x = block.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step)) if len(x) > step else x[:0]
    return x


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class Items:
    """An index of the q-grams of a bounded block of items."""

    def __init__(self, ids: list[int], texts: list[bytes], rate: float = RATE):
        folded = [fold(t) for t in texts]
        kept = [(i, t) for i, t in zip(ids, folded, strict=True) if t]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.floor(self.length * rate).astype(np.int64)
        self.need = self.length - Q + 1 - self.edits * Q
        # an item too short for the bound is looked up as it is
        self.short = [j for j, n in enumerate(self.need) if n < 1]
        grams, item, place = [], [], []
        for j, t in enumerate(self.texts):
            if self.need[j] >= 1:
                g = codes(np.frombuffer(t, np.uint8))
                grams.append(g)
                item.append(np.full(len(g), j))
                place.append(np.arange(len(g)))
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.item = np.concatenate(item)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int64)
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slot(self.gram)] = True

    def candidates(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands that reach the bound."""
        grams = codes(np.frombuffer(text, np.uint8))
        at = np.flatnonzero(self.table[_slot(grams)])
        if not len(at) or not len(self.gram):
            return
        found = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        real = self.gram[found] == grams[at]
        at, found = at[real], found[real]
        if len(at) < self.need[self.need > 0].min():
            return
        counts = self.count[found]
        ends = np.cumsum(counts)
        posting = np.arange(ends[-1]) + np.repeat(self.first[found] - (ends - counts), counts)
        item, place, pos = self.item[posting], self.place[posting], np.repeat(at, counts)
        # few enough hits of an item anywhere rule the item out
        enough = np.bincount(item, minlength=len(self.ids)) >= np.maximum(self.need, 1)
        keep = enough[item]
        if not keep.any():
            return
        item, place, pos = item[keep], place[keep], pos[keep]
        longest = int(self.length.max())
        width = self.edits[item] + 1
        band = (pos - place + longest) // width + 1
        # band b covers the 2w diagonals from (b - 1) w on, so each run of w = k + 1 of them lies inside one band
        item, place, band = np.r_[item, item], np.r_[place, place], np.r_[band, band - 1]
        most = int(band.max()) + 1
        once = np.unique((item * most + band) * longest + place)  # an item's q-gram counts once in a band
        keys, total = np.unique(once // longest, return_counts=True)
        reached = total >= self.need[keys // most]
        for key in keys[reached].tolist():
            j, w = key // most, int(self.edits[key // most]) + 1
            low = (key % most - 1) * w - longest
            yield j, low, low + 2 * w - 1


def align(item: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of item in text between two diagonals, if within `most` edits.

    A diagonal is text position less item position. Rows are item bytes; the
    row's band is computed at once, insertions by a running minimum. Ties: the
    earliest end.
    """
    low, high = low - most, high + most
    width = high - low + 1
    d = np.arange(low, high + 1)
    far = most + 1
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    steps = np.arange(width)
    best = np.where((d >= 0) & (d <= n), 0, far).astype(np.int32)  # an occurrence may start on any diagonal
    origin = d.copy()
    for i, c in enumerate(item):
        at = d + i  # text position that this row's step eats
        ok = (at >= 0) & (at < n)
        same = np.zeros(width, bool)
        same[ok] = t[at[ok]] == c
        step = np.where(ok, best + ~same, far)
        up = np.r_[best[1:] + 1, far]  # the item's byte is missing in the text
        take = up < step
        new, start = np.where(take, up, step), np.where(take, np.r_[origin[1:], 0], origin)
        run = new - steps
        low_at = np.maximum.accumulate(np.where(run == np.minimum.accumulate(run), steps, 0))
        best = np.minimum(new[low_at] + (steps - low_at), far).astype(np.int32)
        origin = start[low_at]
        if best.min() > most:
            return None
    ends = d + len(item)
    best = np.where((ends >= 0) & (ends <= n), best, far)
    j = int(np.argmin(best))
    return (int(best[j]), max(0, int(origin[j])), int(ends[j])) if best[j] <= most else None


def occurrences(text: bytes, items: Items) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end in the folded text): the best occurrence of each item found in a text."""
    folded = fold(text)
    out: dict[int, tuple[int, int, int]] = {}
    for j, low, high in items.candidates(folded):
        if j in out and out[j][0] == 0:
            continue
        start = max(0, low - int(items.edits[j]))
        exact = folded.find(items.texts[j], start, high + int(items.edits[j]) + int(items.length[j]) + 1)
        found = (0, exact, exact + len(items.texts[j])) if exact >= 0 else align(items.texts[j], folded, low, high, int(items.edits[j]))
        if found and (j not in out or found < out[j]):
            out[j] = found
    for j in items.short:
        # too short for edits to mean anything: whole words, as they are
        at = (b" " + folded + b" ").find(b" " + items.texts[j] + b" ")
        if at >= 0:
            out[j] = (0, at, at + len(items.texts[j]))
    return [(j, *v) for j, v in sorted(out.items())]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end): each item's best occurrence in each document that holds it.

    start and end are bytes of the folded text. Every document is read whole
    against every item; the items are broadcast in blocks of at most ITEM_BYTES
    bytes, one pass over docs for each block. Null or empty texts and items match
    nothing; items too short for the bound match whole and unchanged. Repeated
    rows of docs give repeated rows; of rows of the benchmark with one id and
    text one counts. Rows with a null item id are ignored. Texts of any length are read whole, other columns of both
    tables are not read, whatever their names; an empty table of either gives an empty one.
    """
    if not 0 <= rate <= 1 / Q:
        raise ValueError(f"rate must be from 0 to {1 / Q}")
    rows = slim(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("n")).first()["n"] or 0
    blocks = int(size // ITEM_BYTES) + 1
    bench = bench.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    schema = "doc_id long, item_id long, edits long, start long, end long"
    out = None
    for b in range(blocks):
        own = bench.where(F.col("_block") == b).orderBy("item_id", "text").collect()  # about ITEM_BYTES at most
        items = Items([r["item_id"] for r in own], [r["text"].encode() for r in own], rate)
        held = rows.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)), strict=True):
                    found += [(doc, items.ids[j], e, a, z) for j, e, a, z in occurrences(text, items)] if text and items.ids else []
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "edits", "start", "end"])

        part = rows.mapInArrow(given_back(run), schema)
        out = part if out is None else out.union(part)
    return out


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
