"""Repeated byte strings across documents, by difference-cover sampling of suffixes.

For every pair of suffixes a difference cover D modulo V has an offset below V at
which both are sampled, so two equal strings of L bytes share a sampled suffix
with the same first L - V + 1 bytes. The work goes down in levels, like the
recursion on names:

1. Name the first L - V + 1 bytes of each sampled suffix. Names are sorted within
   a task's block of documents and dealt by range of the name; a name that comes from one
   document only is settled and drops out.
2. The remaining suffixes that can reach a shared name are taken in: their L-byte
   prefixes travel as runs of text, dealt by the least 20-byte name inside (equal prefixes
   have equal least names). There they are sorted by (prefix, doc_id) and
   neighbours compared: a prefix that follows one of a smaller doc_id is repeated.

Before both shuffles a task keeps one entry for each distinct name or run, so a
string that a third of all documents hold arrives once a task. Names are 64-bit
polynomial hashes, not ranks: only equality of prefixes matters here. Answers go
back to the block they came from as bits or spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Prefix, given_back, join_texts, parts, runs, sliding_min, slim, spread, text_blocks, total_bytes

LENGTH = 50
#: A difference cover: every residue modulo 21 is a difference of two of these.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SAMPLED = LENGTH - PERIOD + 1
#: Bytes of the names by which runs of suffixes are dealt.
LEAST = 20
#: Bytes of documents that a task treats together, and of text on which it hashes at once.
BLOCK, STEP = 12 << 20, 2 << 20
#: A null id is neither smaller nor larger than another.
NULL_ID = -(1 << 63)


def _planes(values: np.ndarray, level: int = 1) -> bytes:
    """Sorted unsigned numbers: differences, byte plane by byte plane, compressed."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values[:1] * 0)
    size = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, size).T).tobytes())


def _unplanes(blob: bytes, dtype) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel(), dtype=dtype)


class Block:
    """A task's bounded group of documents."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], seq: int):
        self.ids, self.texts = ids, texts
        self.data, self.start, self.size = join_texts(texts)
        print_ = hashlib.blake2b(ids.tobytes() + self.size.tobytes(), digest_size=8)
        print_.update(self.data)
        self.print = int.from_bytes(print_.digest(), "little", signed=True)
        self.number = (TaskContext.get().partitionId() << 24) + seq if TaskContext.get() else seq

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(self.data.tobytes())

    @staticmethod
    def unpack(ids: bytes, sizes: bytes, blob: bytes) -> Block:
        n = np.frombuffer(sizes, np.int64)
        data = zstandard.ZstdDecompressor().decompress(blob)
        ends = np.cumsum(n).tolist()
        return Block(np.frombuffer(ids, np.int64), [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], 0)

    def steps(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about STEP bytes."""
        at, n = 0, len(self.texts)
        ends = self.start + self.size
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, self.start[at] + STEP, "right")))
            yield at, to
            at = to

    def whole(self) -> np.ndarray:
        """One hash for each document's whole text."""
        return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in self.texts], np.uint64)

    def copies(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, id) of each text, and which documents repeat a text of this block under a larger id."""
        h = self.whole()
        known = np.flatnonzero(self.ids != NULL_ID)
        order = known[np.lexsort((self.ids[known], h[known]))]
        same = np.r_[False, h[order][1:] == h[order][:-1]][: len(order)]
        least = self.ids[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = np.zeros(len(h), bool)
        later[order] = self.ids[order] > least
        return h, later

    def samples(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, position, document) of each sampled suffix that is long enough; key is bucket << 32 | name."""
        keys, places, docs = [], [], []
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        for a, b in self.steps():
            lo, hi = int(self.start[a]), int(self.start[b - 1] + self.size[b - 1])
            prefix = Prefix(self.data[lo:hi])
            counts = np.maximum(0, self.size[a:b] - SAMPLED + 1)
            counts[self.ids[a:b] == NULL_ID] = 0
            rel = spread(np.zeros(b - a, np.int64), counts)
            doc = np.repeat(np.arange(a, b), counts)
            own = cover[rel % PERIOD]
            rel, doc = rel[own], doc[own]
            at = self.start[doc] - lo + rel
            h = prefix.slices(at, at + SAMPLED)
            keys.append(((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
            places.append(at + lo)
            docs.append(doc)
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(places), np.concatenate(docs)


def _names(block: Block, buckets: int):
    """Sorted distinct keys of a block, whether two documents hold each, and the samples behind them."""
    key, place, doc = block.samples(buckets)
    order = np.argsort(key, kind="stable")
    key, place, doc = key[order], place[order], doc[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    shared = np.minimum.reduceat(block.ids[doc], at) != np.maximum.reduceat(block.ids[doc], at) if len(at) else np.zeros(0, bool)
    return key[at], shared, np.cumsum(new) - 1, place, doc


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for i, (ids, texts) in enumerate(text_blocks(batches, BLOCK)):
        yield Block(ids, texts, i)


def _present(target: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(target, start, end) of the runs of sorted targets: work by what occurs, however many targets there are."""
    edges = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
    yield from zip(target[edges].tolist(), edges.tolist(), np.r_[edges[1:], len(target)].tolist(), strict=True)


def _first_pass(buckets: int):
    names = ["bucket", "block", "print", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            key, shared, _, _, _ = _names(block, buckets)
            bucket = (key >> np.uint64(32)).astype(np.int64)
            out = []
            for i, a, b in _present(bucket):
                out.append((i, block.number, block.print, _planes((key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), np.packbits(shared[a:b]).tobytes()))
            h, later = block.copies()
            to = (h >> np.uint64(40)).astype(np.int64) % buckets
            ask = np.flatnonzero(~later & (block.ids != NULL_ID))
            ask = ask[np.argsort(to[ask], kind="stable")]
            for i, a, b in _present(to[ask]):
                own = ask[a:b]
                out.append((buckets + i, block.number, block.print, h[own].tobytes() + block.ids[own].tobytes(), own.astype(np.int32).tobytes()))
            yield _batch(names, [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], out)

    return run


def _batch(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _meet_names(buckets: int):
    """For each bucket: which names come from more than one document, as bits for each block."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("block", "ascending")])
        bucket = rows.column("bucket")[0].as_py()
        block, prints = rows.column("block"), rows.column("print")
        a, b = rows.column("a").to_pylist(), rows.column("b").to_pylist()
        if bucket < buckets:
            values = [_unplanes(x, np.uint32) for x in a]
            counts = np.array([len(v) for v in values])
            flat = np.concatenate(values)
            flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(b, counts.tolist(), strict=True)]).astype(bool)
            order = np.argsort(flat, kind="stable")
            s = flat[order]
            same = s[1:] == s[:-1]
            twice = np.r_[False, same] | np.r_[same, False]
            hit = np.zeros(len(flat), bool)
            hit[order] = twice
            # a name that two documents of one block share counts for the other blocks' entries anyway: they are twice
            hit |= flags
            ends = np.cumsum(counts)
            bits = [np.packbits(hit[x:y]).tobytes() for x, y in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        else:
            halves = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in a]
            h = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in halves])
            ids = np.concatenate([np.frombuffer(x, np.int64) for _, x in halves])
            counts = np.array([len(x) // 8 for x, _ in halves])
            order = np.lexsort((ids, h))
            same = np.r_[False, h[order][1:] == h[order][:-1]]
            least = ids[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))]
            copy = np.zeros(len(h), bool)
            copy[order] = ids[order] > least
            ends = np.cumsum(counts)
            bits = [np.frombuffer(x, np.int32)[copy[e - n : e]].tobytes() for x, e, n in zip(b, ends.tolist(), counts.tolist(), strict=True)]
        return pa.table({"block": block, "print": prints, "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        yield _batch(["block", "print", "ids", "sizes", "texts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], [(block.number, block.print, block.ids.tobytes(), block.size.tobytes(), block.pack())])


def _opened(left: pa.Table, right: pa.Table, what: str) -> Block | None:
    """The block of a group; both sides must come from the same documents."""
    if left.num_rows != 1 or right.num_rows and set(right.column("print").to_pylist()) != set(left.column("print").to_pylist()):
        raise RuntimeError(f"the input's partitions changed between two reads of it ({what}); write it to a table first")
    return Block.unpack(*(left.column(c)[0].as_py() for c in ("ids", "sizes", "texts")))


def _second_pass(buckets: int, shares: int):
    """Runs of text whose L-byte prefixes may repeat, dealt by their least name; what the block itself settles."""
    names, types = ["part", "block", "print", "kind", "a", "b"], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("the input's partitions changed between two reads of it; write it to a table first")
        block = _opened(left, right, "names")
        number, stamp = left.column("block")[0].as_py(), left.column("print")[0].as_py()
        right = right.sort_by([("bucket", "ascending")])
        bucket, bits = np.array(right.column("bucket").to_pylist(), np.int64), right.column("bits").to_pylist()
        key, shared, back, place, doc = _names(block, buckets)
        hit, held = np.zeros(len(key), bool), {i: (a, b) for i, a, b in _present((key >> np.uint64(32)).astype(np.int64))}
        for i, x in zip(bucket.tolist(), bits, strict=True):
            if i < buckets:
                a, b = held[i]
                hit[a:b] = np.unpackbits(np.frombuffer(x, np.uint8), count=b - a)
        _, copy = block.copies()
        for i, x in zip(bucket.tolist(), bits, strict=True):
            if i >= buckets:
                copy[np.frombuffer(x, np.int32)] = True
        del key, shared
        # a suffix can repeat only if a shared name is sampled within its next V positions
        live = hit[back] & ~copy[doc]
        place, doc = place[live], doc[live]
        edge = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(edge, np.maximum(place - (PERIOD - 1), block.start[doc]), 1)
        np.add.at(edge, place + 1, -1)
        mask = np.cumsum(edge[:-1]) > 0
        del edge
        for i in np.flatnonzero(block.size > 0).tolist():  # too near the end of its document
            mask[max(int(block.start[i]), int(block.start[i] + block.size[i]) - LENGTH + 1) : int(block.start[i] + block.size[i])] = False
        first, last = runs(mask)
        del mask
        owner = np.searchsorted(block.start, first, "right") - 1
        # runs do not cross documents: the last L - 1 positions of each are off, or it is too short to have any
        out_start, out_len, out_least = [], [], []
        at = 0
        sizes = last - first
        heads = np.cumsum(sizes)
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(heads, heads[at] - sizes[at] + STEP, "right")))
            a, n = first[at:to], sizes[at:to]
            text = block.data[spread(a, n + LENGTH - 1)]
            least = sliding_min(Prefix(text).rolling(LEAST), LENGTH - LEAST + 1)
            begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
            least = least[spread(begin, n)]
            pos = spread(a, n)
            new = np.r_[True, (least[1:] != least[:-1]) | (pos[1:] != pos[:-1] + 1)]
            k = np.flatnonzero(new)
            out_start.append(pos[k])
            out_len.append(np.diff(np.r_[k, len(pos)]))
            out_least.append(least[k])
            at = to
        rows = []
        if out_start:
            start, length, least = map(np.concatenate, (out_start, out_len, out_least))
            owner = np.searchsorted(block.start, start, "right") - 1
            # equal starts of empty documents: the last document that starts there owns the bytes
            digest = np.zeros(len(start), np.uint64)
            for a, b in block.steps():
                lo, hi = int(block.start[a]), int(block.start[b - 1] + block.size[b - 1])
                own = (start >= lo) & (start < hi)
                if own.any():
                    digest[own] = Prefix(block.data[lo:hi]).slices(start[own] - lo, start[own] - lo + length[own] + LENGTH - 1)
            ids = block.ids[owner]
            order = np.lexsort((ids, digest))
            same = np.r_[False, digest[order][1:] == digest[order][:-1]]
            smallest = ids[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            later = np.zeros(len(start), bool)
            later[order] = ids[order] > smallest
            settled = np.flatnonzero(later)
            if len(settled):
                rows.append((-1 - number % shares, number, stamp, 0, np.stack([start[settled], length[settled]]).astype(np.int64).tobytes(), b""))
            ask = np.flatnonzero(~later)
            to = (least[ask] >> np.uint64(20)).astype(np.int64) % shares
            ask, to = ask[np.argsort(to, kind="stable")], np.sort(to, kind="stable")
            pack = zstandard.ZstdCompressor(level=3)
            for i, a, b in _present(to):
                own = ask[a:b]
                own = own[np.argsort(start[own], kind="stable")]
                gaps = np.diff(start[own], prepend=0).astype(np.uint32)
                names_of, which = np.unique(ids[own], return_inverse=True)
                head = np.concatenate([gaps, length[own].astype(np.uint32), which.astype(np.uint32)])
                text = block.data[spread(start[own], length[own] + LENGTH - 1)].tobytes()
                blob = pack.compress(np.ascontiguousarray(head.view(np.uint8).reshape(-1, 4).T).tobytes())
                rows.append((i, number, stamp, 1, np.array([len(own), len(blob), len(names_of)], np.int64).tobytes() + names_of.tobytes() + blob, pack.compress(text)))
        if copy.any():
            d = np.flatnonzero(copy & (block.size >= LENGTH))
            rows.append((-1 - number % shares, number, stamp, 0, np.stack([block.start[d], block.size[d] - LENGTH + 1]).astype(np.int64).tobytes(), b""))
        return pa.Table.from_batches([_batch(names, types, rows)])

    return run


def _meet_suffixes(table: pa.Table) -> pa.Table:
    """Sorts the L-byte prefixes of a part by (prefix, doc_id) and compares neighbours; settled spans pass through."""
    rows = table.to_pylist()
    out = [(r["block"], r["print"], r["a"]) for r in rows if r["kind"] == 0]
    asked = [r for r in rows if r["kind"] == 1]
    if asked:
        undo = zstandard.ZstdDecompressor()
        starts, lengths, ids, of, texts = [], [], [], [], []
        for i, r in enumerate(asked):
            n, size, k = np.frombuffer(r["a"][:24], np.int64).tolist()
            names_of = np.frombuffer(r["a"][24 : 24 + 8 * k], np.int64)
            raw = np.frombuffer(undo.decompress(r["a"][24 + 8 * k : 24 + 8 * k + size]), np.uint8)
            head = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
            starts.append(np.cumsum(head[:n]))
            lengths.append(head[n : 2 * n])
            ids.append(names_of[head[2 * n :]])
            of.append(np.full(n, i))
            texts.append(undo.decompress(r["b"]))
        start, length, doc, of = map(np.concatenate, (starts, lengths, ids, of))
        text = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(length + LENGTH - 1) - (length + LENGTH - 1)
        by = np.argsort(doc, kind="stable")
        begin, length, doc, start, of = begin[by], length[by], doc[by], start[by], of[by]
        at = spread(begin, length)
        hashes = Prefix(text).rolling(LENGTH)[at]
        who = np.repeat(doc, length)
        order = np.argsort(hashes, kind="stable")  # entries stand by doc_id, so equal prefixes do too
        same = np.r_[False, hashes[order][1:] == hashes[order][:-1]]
        least = who[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        repeated = np.zeros(len(order), bool)
        repeated[order] = who[order] > least
        entry = np.repeat(np.arange(len(length)), length)
        pos = np.repeat(start, length) + at - np.repeat(begin, length)
        hit = np.flatnonzero(repeated)
        if len(hit):
            new = np.flatnonzero(np.r_[True, (np.diff(entry[hit]) != 0) | (np.diff(hit) != 1)])
            s, n, o = pos[hit[new]], np.diff(np.r_[new, len(hit)]), of[entry[hit[new]]]
            for i in np.unique(o).tolist():
                own = o == i
                out.append((asked[i]["block"], asked[i]["print"], np.stack([s[own], n[own]]).astype(np.int64).tobytes()))
    return pa.Table.from_batches([_batch(["block", "print", "spans"], [pa.int64(), pa.int64(), pa.binary()], out)])


def _last_pass(with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("the input's partitions changed between two reads of it; write it to a table first")
        block = _opened(left, right, "spans")
        edge = np.zeros(len(block.data) + 1, np.int32)
        for x in right.column("spans").to_pylist():
            start, n = np.frombuffer(x, np.int64).reshape(2, -1)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + n + LENGTH - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i, text in enumerate(block.texts):
            a, n = int(block.start[i]), int(block.size[i])
            first, last = runs(gone[a : a + n])
            kept = block.data[a : a + n][~gone[a : a + n]].tobytes() if len(first) else text
            doc = int(block.ids[i]) if block.ids[i] != NULL_ID else None
            out.append((doc, n, int((last - first).sum()), len(first), hashlib.sha256(kept).hexdigest(), *((first.tolist(), last.tolist()) if with_text else ())))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_start", "span_end"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        m = 7 if with_text else 5
        return pa.Table.from_batches([_batch(names[:m], types[:m], out)])

    return run


def repeated_bytes(docs: DataFrame, with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, span_start, span_end]) for each row of docs.

    A byte is removed if a string of LENGTH bytes that covers it also starts in a
    document with a smaller id; spans are the maximal removed runs, as byte
    offsets. Null text is empty. A null id neither removes nor loses anything.
    Rows with equal ids do not remove from each other. An empty table gives an empty one. Texts of any
    length are whole; other columns are not read, whatever their names.
    docs must be a table or something else that reads the same in every pass; if
    its partitions change between two passes the query fails instead of returning wrong rows.
    """
    spark = docs.sparkSession
    rows = slim(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = total_bytes(rows)
    buckets, shares = parts(spark, size, 24 << 20), parts(spark, size, 6 << 20)
    names = rows.mapInArrow(given_back(_first_pass(buckets)), "bucket int, block long, print long, a binary, b binary")
    bits = names.groupBy("bucket").applyInArrow(given_back(_meet_names(buckets)), "block long, print long, bucket int, bits binary")
    packed = rows.mapInArrow(given_back(_packed), "block long, print long, ids binary, sizes binary, texts binary")
    asked = packed.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(given_back(_second_pass(buckets, shares)), "part int, block long, print long, kind int, a binary, b binary")
    spans = asked.groupBy("part").applyInArrow(given_back(_meet_suffixes), "block long, print long, spans binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", span_start array<long>, span_end array<long>" * with_spans
    return packed.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(given_back(_last_pass(with_spans)), schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
