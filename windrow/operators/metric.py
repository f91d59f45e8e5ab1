"""Exact nearest rows by a metric index: routing nodes under super nodes, pages with covering radii and stored parent distances.

A bounded sample of pivots routes every vector to a node, by way of the nearest of some super
pivots; a node's vectors lie in pages, each with a centre, a covering radius, its distance to the
node's pivot and its entries in order of their distance to the centre. Pages of neighbouring nodes
make a group, queries of neighbouring nodes a block. A query's home is the node of lowest bound, and
of its first page come its first candidates. Then blocks visit groups in order of their bounds, in
rounds of 8, 64, ... groups. Each round, and each group within a task, tightens the distance of a
query's k-th best so far, and a node, page or entry that the triangle inequality puts beyond it is
not compared. Rounds go on until nothing is left in reach, so the answer is exact.

Blocks and groups meet in a Cartesian product, which reads both where they were written: no vector is
shuffled for a visit, however many pages a query has to see. What is shuffled is a query's k best of
a task that are no worse than its k-th best before the round, and once a round the blocks.

Largest inner products are nearest rows too: with B the largest norm, a vector x gets one coordinate
more, sqrt(B^2 - |x|^2), and a query the coordinate 0; then |q - x|^2 = |q|^2 + B^2 - 2 q.x.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sums import matrix

#: Vectors in a page, pivots at most (the driver and each task hold them), queries bounded at once.
PAGE, PIVOTS, QUERIES = 512, 4096, 256
#: Pages in a group and queries in a block at most, bytes of vectors in either, groups of a round against the round before.
GROUP, BLOCK, BYTES, GROWTH = 16, 4096, 1 << 22, 8
PAGES = pa.list_(pa.struct([("node", pa.int32()), ("slot", pa.int32()), ("parent", pa.float64()), ("radius", pa.float64()), *[(n, pa.binary()) for n in ("centre", "far", "ids", "vs")]]))
#: Relative slack of bounds for rounding; scores are compared exactly.
SLACK = 1e-6


def _lift(x: np.ndarray, bound: float | None) -> np.ndarray:
    return x if bound is None else np.hstack([x, np.sqrt(np.maximum(0, bound - (x * x).sum(1)))[:, None]])


def _flat(q: np.ndarray, bound: float | None) -> np.ndarray:
    return q if bound is None else np.hstack([q, np.zeros((len(q), 1))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integer-valued rows: doubles where they suffice, 64-bit or Python's integers beyond."""
    size = np.sqrt((q * q).sum(1).max() * (v * v).sum(1).max())
    if size < 2.0**52:
        return (q @ v.T).astype(np.int64)
    if size < 2.0**62 and max(np.abs(q).max(), np.abs(v).max()) < 2.0**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], object)
    return whole(q) @ whole(v).T


def _k_best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score, place from 0) of the k lowest scores of each row; ties to the smaller id."""
    order = np.lexsort((ids, scores, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[order][keep], scores[order][keep], place[keep]


class Block:
    """Queries with the scores that their candidates must not exceed (lowest first), and the best candidates that a task has met."""

    def __init__(self, index: Index, k: int, product: bool, counted, qids: bytes, qs: bytes, homes: bytes, limits: list | None):
        self.index, self.k, self.product, self.counted = index, k, product, counted
        self.ids, self.q = np.frombuffer(qids, np.int64), np.frombuffer(qs).reshape(-1, index.dim)
        self.homes = np.frombuffer(homes, np.int32)
        self.flat, self.square = _flat(self.q, index.bound), (self.q * self.q).sum(1)
        self.known = np.zeros(len(self.q), bool)
        self.bar, self.slack = np.zeros(len(self.q), np.int64 if product else float), np.full(len(self.q), np.inf)
        self.found, self.waiting = [], 0
        if limits:
            order = np.argsort(self.ids)
            at = order[np.searchsorted(self.ids, [r["query_id"] for r in limits], sorter=order)]
            self.limit(at, (-1 if product else 1) * np.array([r["score"] for r in limits], self.bar.dtype))

    def limit(self, rows: np.ndarray, scores: np.ndarray) -> None:
        """The k-th best scores so far of some rows, and the distances beyond which bounds rule out."""
        self.known[rows], self.bar[rows] = True, scores
        square = self.square[rows] + self.index.bound + 2 * scores.astype(float) if self.product else scores
        self.slack[rows] = np.sqrt(np.maximum(0, square)) * (1 + SLACK) + SLACK * self.index.scale

    def meet(self, pages: list[dict], home: bool) -> None:
        """Compares with a group's pages: in the home round each query with the first page of its home, later with all others, the nearest first."""
        far = _distances(self.flat, self.index.pivots[[p["node"] for p in pages]])
        own = np.stack([(self.homes == p["node"]) & (p["slot"] == 0) for p in pages], 1)
        if home:
            turns = [own]
        else:
            first = far.argmin(1)[:, None] == np.arange(len(pages))
            turns = [first & ~own, ~first & ~own]
        for turn in turns:
            for j, page in enumerate(pages):
                rows = np.flatnonzero(turn[:, j])
                if len(rows):
                    self.reach(page, rows, far[rows, j])
            self.settle()

    def reach(self, page: dict, rows: np.ndarray, far: np.ndarray) -> None:
        """Compares the rows that have a page in reach with its entries in reach."""
        # the page's stored distance to the node's pivot may rule it out without a comparison
        live = rows[np.abs(far - page["parent"]) - page["radius"] <= self.slack[rows]]
        if not len(live):
            return
        to = _distances(self.flat[live], np.frombuffer(page["centre"])[None])[:, 0]
        near = to - page["radius"] <= self.slack[live]
        live, to = live[near], to[near]
        # entries are sorted by distance to the centre: |d(q, c) - d(x, c)| bounds d(q, x); queries about as far from it share a range of entries
        order = np.argsort(to)
        live, to, entry, slack = live[order], to[order], np.frombuffer(page["far"]), self.slack[live[order]]
        ids, vs = np.frombuffer(page["ids"], np.int64), np.frombuffer(page["vs"]).reshape(-1, self.index.dim)
        lowest, highest = np.searchsorted(entry, to - slack, "left"), np.searchsorted(entry, to + slack, "right")
        step = min(QUERIES, max(16, len(live) // 16))
        for at in range(0, len(live), step):
            a, b = lowest[at : at + step].min(), highest[at : at + step].max()
            if a < b:
                self.compare(live[at : at + step], ids[a:b], vs[a:b])

    def compare(self, live: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Adds the entries that may be among the k best of rows."""
        q = self.q[live]
        if self.counted is not None:
            self.counted.add(len(q) * len(v))
        scores = -_products(v, q) if self.product else np.maximum(0, self.square[live][:, None] + (v * v).sum(1)[None] - 2 * q @ v.T)
        # without a limit, the k best and maybe the query itself
        bar, free = self.bar[live].astype(scores.dtype), ~self.known[live]
        if free.any():
            bar[free] = np.partition(scores[free], self.k, axis=1)[:, self.k] if len(v) > self.k + 1 else scores[free].max(axis=1)
        if not self.product:  # the product only proposes: what it puts clearly beyond the limit is not looked at again
            bar = bar * (1 + SLACK) + (SLACK * self.index.scale) ** 2
        i, j = np.nonzero(scores <= bar[:, None])
        other = ids[j] != self.ids[live[i]]
        i, j = i[other], j[other]
        step = max(1, BYTES // (8 * self.index.dim))
        for at in range(0, len(i), step):
            m, n = i[at : at + step], j[at : at + step]
            row = live[m]
            if self.product:
                score = scores[m, n]
                if max(abs(int(score.max())), abs(int(score.min()))) >= 1 << 63:
                    raise OverflowError("an inner product is too large for 64-bit integers")
                score = score.astype(np.int64)
            else:
                score = ((q[m] - v[n]) ** 2).sum(1)
                keep = np.isfinite(score) & (~self.known[row] | (score <= self.bar[row]))
                row, n, score = row[keep], n[keep], score[keep]
            self.found.append((row, ids[n], score))
            self.waiting += len(row)
            if self.waiting > 4 * self.k * len(self.q) + BYTES // 8:
                self.settle()

    def settle(self) -> None:
        """Only each row's k best candidates stay; a k-th one is the row's limit from here on."""
        if self.waiting:
            row, ids, scores, place = _k_best(*map(np.concatenate, zip(*self.found, strict=True)), self.k)
            last = place == self.k - 1
            self.limit(row[last], scores[last])
            self.found, self.waiting = [(row, ids, scores)], 0

    def rows(self, block: int) -> pa.RecordBatch:
        """(block, query_id, id, score) of the candidates."""
        self.settle()
        row, ids, scores = self.found[0] if self.found else (np.zeros(0, int), np.zeros(0, np.int64), self.bar[:0])
        columns = [pa.array(np.full(len(row), block, np.int32)), pa.array(self.ids[row]), pa.array(ids), pa.array(-scores if self.product else scores)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "query_id", "id", "score"])


class Index:
    """Groups of pages of (id, x array<double>) rows of one length; see `indexed`."""

    def __init__(self, groups: DataFrame, dim: int, bound: float | None, scale: float, pivots: np.ndarray, supers: np.ndarray, parent: np.ndarray, radius: np.ndarray, lowest: np.ndarray, highest: np.ndarray, keep: Callable):
        self.groups, self.dim, self.bound, self.scale, self.keep = groups, dim, bound, scale, keep
        self.pivots, self.supers, self.parent, self.radius, self.lowest, self.highest = pivots, supers, parent, radius, lowest, highest
        self.n_groups = int(highest.max()) + 1
        far = np.array([_distances(pivots[i : i + 1], supers[parent[i]][None])[0, 0] for i in range(len(pivots))]) + radius
        self.reach = np.array([far[(parent == s) & (radius >= 0)].max(initial=-1.0) for s in range(len(supers))])

    def __getstate__(self) -> dict:
        """What tasks need."""
        return {k: v for k, v in self.__dict__.items() if k not in ("groups", "keep")}

    def homes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, x) queries with their home: of the nodes with the lowest bound the one with the nearest pivot."""
        nodes = np.flatnonzero(self.radius >= 0)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                d = _distances(_flat(matrix(part.column(1), self.dim), self.bound), self.pivots[nodes])
                bounds = np.maximum(0, d - self.radius[nodes])
                home = nodes[np.where(bounds == bounds.min(1)[:, None], d, np.inf).argmin(1)]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *part.columns], names=["node", "id", "x"])

    def ordered(self, block: Block) -> list[int]:
        """The groups in reach of a block, in order of their bounds, then of the mean distance to their pivots."""
        least, total, n = np.full(len(self.pivots), np.inf), np.zeros(len(self.pivots)), np.zeros(len(self.pivots))
        for at in range(0, len(block.flat), QUERIES):
            flat, slack = block.flat[at : at + QUERIES], block.slack[at : at + QUERIES]
            top = _distances(flat, self.supers)
            for s in np.flatnonzero(self.reach >= 0).tolist():
                rows, nodes = np.flatnonzero(top[:, s] - self.reach[s] <= slack), np.flatnonzero((self.parent == s) & (self.radius >= 0))
                if len(rows):
                    d = _distances(flat[rows], self.pivots[nodes])
                    bounds = np.maximum(0, d - self.radius[nodes])
                    near = bounds <= slack[rows][:, None]
                    least[nodes] = np.minimum(least[nodes], np.where(near, bounds, np.inf).min(0))
                    total[nodes] += d.sum(0)
                    n[nodes] += len(d)
        best: dict[int, tuple[float, float]] = {}
        for node in np.flatnonzero(least < np.inf).tolist():
            for g in range(int(self.lowest[node]), int(self.highest[node]) + 1):
                best[g] = min(best.get(g, (np.inf, np.inf)), (least[node], total[node] / n[node]))
        return sorted(best, key=lambda g: (best[g], g))

    def visits(self, most: int, k: int, product: bool) -> Callable:
        """For blocks: the groups to visit in a round (`most` of those in reach and not done; for 0 those of the queries' homes, which stay to be done) and those done after it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                go, done = [], []
                for i in range(batch.num_rows):
                    r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                    if most:
                        old = set(r["done"])
                        go.append([g for g in self.ordered(Block(self, k, product, None, r["qids"], r["qs"], r["homes"], r["limits"])) if g not in old][:most])
                    else:
                        go.append(np.unique(self.lowest[np.frombuffer(r["homes"], np.int32)]).tolist())
                    done.append(sorted({*r["done"], *go[-1]}) if most else [])
                kept = [n for n in batch.schema.names if n != "done"]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(done, ints), pa.array(go, ints)], names=[*kept, "done", "groups"])

        return run

    def search(self, home: bool, k: int, product: bool, counted=None) -> Callable:
        """For pairs of a block and a group, those of a block together: (block, query_id, id, score) of each query's k best; a score is a squared distance or a product."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, block = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    own = batch.column("block")[i].as_py()
                    if own != at:
                        if block is not None:
                            yield block.rows(at)
                        at, block = own, Block(self, k, product, counted, *[batch.column(n)[i].as_py() for n in ("qids", "qs", "homes", "limits")])
                    block.meet(batch.column("pages")[i].as_py(), home)
            if block is not None:
                yield block.rows(at)

        return run


def indexed(rows: DataFrame, dim: int, keep: Callable[[DataFrame], DataFrame], bound: float | None = None, scale: float = 1.0, page: int = PAGE, pivots: int = PIVOTS) -> Index:
    """The index of rows (id, x array<double> of `dim` components); `keep` writes a table that later steps read more than once.

    Pivots are a sample of as many rows as there are pages, `pivots` at most; beyond that a node has
    several pages. A page's rows are dealt by a hash of their id, so that a node of any size spreads over tasks.
    Pages are numbered by super node and node, and so many that follow each other make a group.
    """
    n = rows.count()
    count = max(1, min(pivots, -(-n // page)))
    sample = np.array([r["x"] for r in rows.orderBy(F.xxhash64("id")).limit(count).select("x").collect()], float).reshape(-1, dim)
    chosen = np.unique(_lift(sample, bound), axis=0)
    rng = np.random.default_rng(0)
    supers = chosen[np.sort(rng.choice(len(chosen), max(1, int(np.sqrt(len(chosen)))), replace=False))]
    parent = _distances(chosen, supers).argmin(1)
    members = [np.flatnonzero(parent == s) for s in range(len(supers))]
    filled = np.array([len(m) > 0 for m in members])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _lift(matrix(batch.column(1), dim), bound)
            top = _distances(x, supers)
            top[:, ~filled] = np.inf
            home, node, far = top.argmin(1), np.zeros(len(x), np.int32), np.zeros(len(x))
            for s in np.unique(home).tolist():
                own = np.flatnonzero(home == s)
                d = _distances(x[own], chosen[members[s]])
                node[own], far[own] = members[s][d.argmin(1)], d.min(1)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(far), batch.column(0), batch.column(1)], names=["node", "far", "id", "x"])

    placed = keep(rows.select("id", "x").mapInArrow(assign, "node int, far double, id long, x array<double>"))
    sizes = {r["node"]: (r["n"], r["r"]) for r in placed.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}  # a row for each pivot
    radius = np.array([sizes.get(i, (0, -1.0))[1] for i in range(len(chosen))])
    share = np.array([-(-sizes.get(i, (0, 0))[0] // page) for i in range(len(chosen))])
    order = np.argsort(parent, kind="stable")
    start = np.zeros(len(chosen), int)
    start[order] = np.cumsum(share[order]) - share[order]
    per = max(1, min(GROUP, int(share.sum()) // GROUP, BYTES // (8 * dim * page)))
    n_groups = max(1, -(-int(share.sum()) // per))
    table = rows.sparkSession.createDataFrame([(i, int(s), int(at)) for i, (s, at) in enumerate(zip(share, start, strict=True))], "node int, share int, start int")
    dealt = placed.join(F.broadcast(table), "node").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("share").cast("long")).cast("int"))  # a row for each pivot
    dealt = dealt.select(F.floor((F.col("start") + F.col("slot")) / per).cast("int").alias("group"), "node", "slot", "far", "id", "x")

    def build(own: pa.Table) -> pa.Table:
        x, ids, far = matrix(own.column("x").combine_chunks(), dim), own.column("id").to_numpy(), own.column("far").to_numpy()
        lifted = _lift(x, bound)
        keys, which = np.unique(np.stack([own.column("node").to_numpy(), own.column("slot").to_numpy()], 1), axis=0, return_inverse=True)
        pages = []
        for i, (node, slot) in enumerate(keys.tolist()):
            rows = np.flatnonzero(which.ravel() == i)
            at = rows[np.argmin(((lifted[rows] - lifted[rows].mean(0)) ** 2).sum(1))]  # the row nearest to the middle
            d = np.sqrt(((lifted[rows] - lifted[at]) ** 2).sum(1))
            by = np.lexsort((ids[rows], d))
            blobs = {"centre": lifted[at], "far": d[by], "ids": ids[rows[by]], "vs": x[rows[by]]}
            pages.append({"node": node, "slot": slot, "parent": float(far[at]), "radius": float(d.max()), **{n: b.tobytes() for n, b in blobs.items()}})
        return pa.table({"group": own.column("group")[:1], "pages": pa.array([pages], PAGES)})

    groups = keep(dealt.repartition(_parts(n_groups, 16), "group").groupBy("group").applyInArrow(build, "group int, pages array<struct<node int, slot int, parent double, radius double, centre binary, far binary, ids binary, vs binary>>"))
    return Index(groups, dim, bound, scale, chosen, supers, parent, radius, start // per, (start + np.maximum(1, share) - 1) // per, keep)


def _parts(n: int, least: int) -> int:
    """Partitions for n groups or blocks: 8 in each, but `least` partitions where there are as many."""
    return max(1, -(-n // 8), min(n, least))


def blocks(index: Index, queries: DataFrame) -> tuple[DataFrame, int]:
    """(block, qids, qs, homes): the (id, x) queries in blocks of those with neighbouring homes, and the number of blocks."""
    dim = index.dim
    placed = index.keep(queries.select("id", "x").mapInArrow(index.homes, "node int, id long, x array<double>"))
    sizes = {r["node"]: r["n"] for r in placed.groupBy("node").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    counts = np.array([sizes.get(i, 0) for i in range(len(index.pivots))])
    n = int(counts.sum())
    size = max(1, min(BLOCK, max(QUERIES, n // 16), BYTES // (8 * dim)))
    order = np.argsort(index.parent, kind="stable")
    start = np.zeros(len(counts), int)
    start[order] = np.cumsum(counts[order]) - counts[order]
    table = queries.sparkSession.createDataFrame([(i, int(c), int(at)) for i, (c, at) in enumerate(zip(counts, start, strict=True)) if c], "node int, n long, start long")
    # a query's place among its node's is a hash: a node of any size spreads over blocks
    dealt = placed.join(F.broadcast(table), "node").select(F.floor((F.col("start") + F.pmod(F.xxhash64("id"), "n")) / size).cast("int").alias("block"), "node", "id", "x")

    def gather(own: pa.Table) -> pa.Table:
        blobs = {"qids": own.column("id").to_numpy(), "qs": matrix(own.column("x").combine_chunks(), dim), "homes": own.column("node").to_numpy()}
        return pa.table({"block": own.column("block")[:1], **{n: pa.array([b.tobytes()], pa.binary()) for n, b in blobs.items()}})

    count = -(-n // size)
    return index.keep(dealt.repartition(_parts(count, 16), "block").groupBy("block").applyInArrow(gather, "block int, qids binary, qs binary, homes binary")), count


def nearest(index: Index, queries: DataFrame, k: int, product: bool = False, counted=None) -> DataFrame:
    """(query_id, rank, id, score): each query's (id, x) k best rows but its own id; ties to the smaller id.

    score is the squared Euclidean distance, lowest first, or for product the inner product of integer-valued vectors, highest first.
    `counted` is an accumulator that gets the number of compared pairs.
    """
    score = "long" if product else "double"
    order = F.col("score").desc() if product else F.col("score")
    best = Window.partitionBy("query_id").orderBy(order, "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    found = f"block int, query_id long, id long, score {score}"
    asked, n_blocks = blocks(index, queries)
    asked = asked.withColumn("done", F.array().cast("array<int>"))
    near, most = queries.sparkSession.createDataFrame([], f"{found}, rank int"), 0
    while True:
        limits = near.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("limits"))
        limited = asked.select("block", "qids", "qs", "homes", "done").join(limits, "block", "left")
        asked = index.keep(limited.mapInArrow(index.visits(most, k, product), f"block int, qids binary, qs binary, homes binary, limits array<struct<query_id: long, score: {score}>>, done array<int>, groups array<int>"))
        if not asked.where(F.size("groups") > 0).count():
            return near.select("query_id", "rank", "id", "score")
        # a Cartesian product: each task reads some blocks and some groups where they were written
        left, right = asked.select("block", "qids", "qs", "homes", "limits", "groups").coalesce(_parts(n_blocks, 4)), index.groups.coalesce(_parts(index.n_groups, 16))
        met = left.join(right.hint("shuffle_replicate_nl"), F.array_contains("groups", F.col("group")))
        more = met.select("block", "qids", "qs", "homes", "limits", "pages").mapInArrow(index.search(most == 0, k, product, counted), found)
        near = index.keep(ranked(near.drop("rank").union(more)))
        most = max(1, most) * GROWTH


def firsts_of_copies(rows: DataFrame, keep: int) -> DataFrame:
    """(id, x) rows without those whose equals have `keep` smaller ids: no list of keep - 1 best rows can hold more of one vector."""
    w = Window.partitionBy("x").orderBy("id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
