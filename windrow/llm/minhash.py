"""Near copies by shingle Jaccard: SimHash fingerprints and banded min-hashes propose, the shingle sets decide.

Equal texts fold to one node first. SimHash comes first: each node's fingerprint of 64
majority bits meets one within NEAR bits by the vantage-point shards of `simhash`, and
the pairs whose sets confirm it make the first components. Pairs of 0.8 differ in some ten
bits, which no radius that prunes would reach, so min-hashes propose what is left: a
node's 80 min-hashes make 20 keys of four;
a pair of Jaccard s shares no key with probability (1 - s^4)^20, 3e-5 at 0.8 and
less above. In a few rounds each node meets the pivot of one of its keys, whose
confirmed links join most of a large group. Members of a key that are still in
unlike components then meet in tasks that compare them pair by pair, by size, by
signature (four bits of each of 160 min-hashes, which leave out a share of 3e-5 of the
pairs of 0.8 and nineteen in twenty of those of 0.6) and by whole sets of 32-bit hashes:
only links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .passages import _block_shingles, _document_shingles
from .textkit import LOWER, column_bytes, cut, given_back, mix, parts, slim

SIMILARITY = 0.8
#: Bits by which the fingerprints of a pair that SimHash proposes differ at most.
NEAR = 3
BANDS, DEPTH = 20, 4
#: Min-hashes of a signature, 16 of which share a long, and how many of them a similar pair has in common at least.
MARKS, COMMON = 160, 110
#: Rounds in which the members of a key meet one pivot before they meet each other.
PIVOTS = 3
#: Members of a key that one task compares.
SIDE = 4096
BLOCK = 1 << 20
_SEEDS = mix(np.arange(1, MARKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS + np.uint64(1)) | np.uint64(1)


def _node(text: bytes) -> int:
    """A hash of the words: texts that differ in white space or the case of A-Z only are equal."""
    return xxhash.xxh64_intdigest(b" ".join(text.translate(LOWER).split()))


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, keys and signature, fingerprint): BANDS keys and MARKS / 16 longs, and the SimHash, of each text of five words or more; shorter texts have only equal copies."""
    every, doc, _ = _block_shingles(texts)
    if not len(every):
        return np.zeros(0, np.int64), np.zeros((0, BANDS + MARKS // 16), np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    out = np.zeros((BANDS + MARKS // 16, len(first)), np.uint64)
    for i in range(MARKS):
        least = np.minimum.reduceat((every ^ _SEEDS[i]) * _FACTORS[i], first)
        if i < BANDS * DEPTH:
            out[i // DEPTH] = mix(out[i // DEPTH] + least + _SEEDS[i])
        out[BANDS + i // 16] |= (mix(least) >> np.uint64(60)) << np.uint64(4 * (i % 16))
    return doc[first], np.ascontiguousarray(out.T).view(np.int64), simhash.majority(mix(every), first).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), column_bytes(batch.column(1))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                size += len(texts[end])
                end += 1
            own = texts[at:end]
            keys: list = [None] * len(own)
            marks: list = [None] * len(own)
            prints: list = [None] * len(own)
            for i, k, fp in zip(*signatures(own), strict=True):
                keys[i], marks[i], prints[i] = k[:BANDS].tolist(), k[BANDS:].tolist(), int(fp)
            nodes = np.array([_node(t) for t in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at:end], pa.int64()), pa.array(nodes), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64())), pa.array(prints, pa.int64())], names=["doc_id", "node", "keys", "marks", "fp"])
            at = end


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            texts = column_bytes(batch.column(0).slice(i, 64))
            sets = [np.unique((_document_shingles(t) >> np.uint64(32)).astype(np.uint32)) for t in texts]
            nodes = np.array([_node(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "shingles"])


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(4)], names=["u", "v", "c", "d"])

    return run


def _settled(similarity: float):
    """Links between the members of each (key, block) that are in unlike components: pairs are compared where they meet and only links leave."""

    def run(table: pa.Table) -> pa.Table:
        key, block, node, n, c = (table.column(x).to_numpy() for x in ("key", "block", "node", "n", "c"))
        longs = table.column("marks").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
        raw = np.ascontiguousarray(longs).view(np.uint8).reshape(len(key), -1)
        marks = np.concatenate([raw & 15, raw >> 4], axis=1)
        blobs = table.column("shingles").combine_chunks()
        order = np.lexsort((node, block, key))
        edges = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (block[order][1:] != block[order][:-1]), True])
        out = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[lo:hi]
            label, size, grid = c[own].copy(), n[own], marks[own]
            for i in range(len(own) - 1):
                other = np.arange(i + 1, len(own))
                least = np.minimum(size[i], size[other]) >= similarity * np.maximum(size[i], size[other]) - 1e-9
                other = other[least & (label[other] != label[i])]
                other = other[(grid[other] == grid[i]).sum(1) >= COMMON]
                if not len(other):
                    continue
                x = np.frombuffer(blobs[int(own[i])].as_py(), np.uint32)
                for j in other.tolist():
                    if label[i] == label[j]:
                        continue
                    y = np.frombuffer(blobs[int(own[j])].as_py(), np.uint32)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                        out.append((max(node[own[i]], node[own[j]]), min(node[own[i]], node[own[j]])))
                        label[label == label[j]] = label[i]
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _merged(labelled: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """labelled with the components that the turn's links join; those deeper than 4 links below a root keep a label between."""
    up = links.groupBy("c").agg(F.min_by("d", F.struct(F.xxhash64("d", F.lit(turn)), "d")).alias("d"))
    for _ in range(2):
        above = up.select(F.col("c").alias("d"), F.col("d").alias("_up"))
        up = up.join(above, "d", "left").select("c", F.coalesce("_up", "d").alias("d"))
    return labelled.join(up, "c", "left").select("key", "node", "n", F.coalesce("d", "c").alias("c"))


def _last_links(labelled: DataFrame, traits: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the links that keys with members of several components still hide.

    A member goes to each such key of its with its signature and set; keys of more than SIDE members
    are cut into parts, every two of which meet in one block.
    """
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / SIDE).alias("_parts")).where("lo <> hi").select("key", "_parts")
    left = labelled.join(mixed, "key").withColumn("_p", F.pmod(F.xxhash64("node"), F.col("_parts")))
    left = left.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    left = cut(left.select("key", (F.least("_p", "_o") * F.col("_parts") + F.greatest("_p", "_o")).alias("block"), "node", "n", "c"))
    buckets = parts(labelled.sparkSession, int(left.agg(F.sum("n")).first()[0] or 0) * 4, 8 << 20)
    full = left.join(traits.select("node", "marks"), "node").join(sets.select("node", "shingles"), "node")
    return full.groupBy(F.pmod(F.xxhash64("key", "block"), F.lit(buckets)).alias("_bucket")).applyInArrow(given_back(_settled(similarity)), "u long, v long")


def _proposed(heads: DataFrame) -> DataFrame:
    """(u, uid, v, vid): pairs of nodes (node, id, fp) of one fingerprint, each with the least, and of these for each fingerprint one within NEAR bits."""
    firsts = cut(heads.groupBy("fp").agg(F.min(F.struct("node", "id")).alias("f")).select("fp", "f.node", "f.id"))
    same = heads.join(firsts.select("fp", F.col("node").alias("v"), F.col("id").alias("vid")), "fp").where("node <> v").select(F.col("node").alias("u"), F.col("id").alias("uid"), "v", "vid")
    near = simhash.links(firsts.select("fp", F.col("node").alias("id")), NEAR, direct=True).distinct()
    name = lambda n, i: firsts.select(F.col("node").alias(n), F.col("id").alias(i))
    return same.union(near.join(name("u", "uid"), "u").join(name("v", "vid"), "v").select("u", "uid", "v", "vid"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of each row of docs with an id.

    Documents are linked if the Jaccard similarity of their sets of five-word
    shingles is `similarity` or more (words are parted by ASCII white space and
    compared with A-Z lowered), or if their words are equal; component_id is
    the smallest doc_id reachable. A link is found where the texts' SimHash
    fingerprints are near or a key of min-hashes is equal. Null text is empty, and texts without words
    link to each other. Repeated rows appear as often as they come; an empty table gives an empty one.
    """
    rows = slim(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = cut(rows.mapInArrow(given_back(_signed), "doc_id long, node long, keys array<long>, marks array<long>, fp long"))
    heads = signed.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.first("fp").alias("fp"))
    traits = heads.where("keys is not null").select("node", "keys", "marks")
    members = heads.where("keys is not null").select("node", "id", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    members = cut(members.join(shared, "key"))
    close = cut(_proposed(heads.where("keys is not null").select("node", "id", "fp")))
    ends = close.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("uid").alias("id")), F.struct(F.col("v").alias("node"), F.col("vid").alias("id")))).alias("e")).select("e.node", "e.id")
    asked = members.select("node", "id").union(ends).withColumnRenamed("id", "doc_id").distinct()
    # an id can have rows of several texts: the set's own node decides
    sets = rows.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(given_back(_sets), "node long, n long, shingles binary")
    sets = cut(sets.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    members = members.select("key", "node").join(sets.select("node", "n"), "node")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
        return cut(pairs.join(x, "u").join(y, "v").select("u", "v", "c", "d", "x", "y").mapInArrow(given_back(_alike(similarity)), "u long, v long, c long, d long"))

    # known nodes of one component share c; a turn's links lead to components of lower rank, so they make a forest
    known = confirmed(close.select("u", "v", F.col("u").alias("c"), F.col("v").alias("d"))).select("u", "v")
    labelled = cut(members.join(connected_components(known), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c")))
    for turn in range(PIVOTS):
        # one pivot a key, and of a member's keys that have another component's pivot the one with most members
        rank = F.struct(F.xxhash64("c", F.lit(turn)), "c", "node")
        pivots = labelled.groupBy("key").agg(F.min_by(F.struct("node", "n", "c"), rank).alias("p"), F.count("*").alias("_k"))
        met = labelled.join(pivots, "key").where("c <> p.c")
        # sets whose sizes differ by more cannot be so similar
        met = met.where(F.least("n", "p.n") >= F.greatest("n", "p.n") * F.lit(similarity) - F.lit(1e-9))
        best = met.groupBy(F.col("node").alias("u")).agg(F.max_by(F.struct("c", F.col("p.node").alias("v"), F.col("p.c").alias("d")), F.struct("_k", "key")).alias("m"))
        links = confirmed(cut(best.select("u", "m.v", "m.c", "m.d")))
        known = known.union(links.select("u", "v"))
        labelled = cut(_merged(labelled, links, turn))
    known = known.union(cut(_last_links(labelled, traits, sets, similarity)))
    groups = connected_components(known).withColumnRenamed("component", "c")
    named = signed.select("doc_id", "node").join(groups, "node", "left").select("doc_id", F.coalesce("c", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "c").select("doc_id", "component_id")
