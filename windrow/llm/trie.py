"""The prefix trie of conversations, by prefix doubling.

Every turn gets a number, then every aligned block of 2, 4, 8, ... turns one
from the numbers of its halves, each in one round of grouping and joining. The
prefix of d turns is the prefix without d's lowest binary digit followed by one
such block, so another round for each digit numbers all prefixes: equal numbers
are equal prefixes, the nodes of the trie. Sums over subtrees double too: each
round adds to a node what the nodes 2^k below it have gathered. No step depends
on how long a conversation is but for the number of rounds, its logarithm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import Tables, given_back

#: Equal turns of a conversation, or ids of a node's text, that stand in one row on the way.
BLOCK = 4096


def crc32(column: Column) -> Column:
    return F.crc32(column.cast("string"))


def numbered_turns(conversations: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, pos, turn_key, n_chars): each conversation's turns from 0 on, by turn (null first), then role and text.

    Null role and text are empty, rows without a conv_id have no conversation. Positions come from a range partitioning of all
    rows: a conversation may span partitions, whose earlier ones are counted. Equal rows travel as one with its count.
    turn_key is the SHA-256 of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        # the texts themselves stay where they are: their order is that of their first bytes, then of their hash
        F.concat(F.lpad(F.char_length(role).cast("string"), 10, "0"), F.substring(role, 1, 64)).alias("_role"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_key"),
        F.char_length(text).cast("long").alias("n_chars"),
    )
    order = ["conv_id", "turn", "_role", "turn_key"]
    some = turns.groupBy(*order, "n_chars").count()
    placed = tables.keep(some.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "_part").agg(F.sum("count").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("conv_id", "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order[1:]]).rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("_at", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(parts, ["conv_id", "_part"])
    start = at.select("conv_id", "turn_key", "n_chars", "count", (F.col("_base") + F.col("_at")).alias("_start"))
    blocks = start.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(BLOCK).cast("long"))))
    each = blocks.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("count"), F.col("_from") + BLOCK) - 1)))
    return tables.keep(each.select("conv_id", (F.col("_start") + F.col("_i")).alias("pos"), "turn_key", "n_chars"))


def rebuilt(turns: DataFrame, conversations: DataFrame, bundle: int, most: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Turns (as numbered_turns) of rebuilt conversations, and (conv_id, length) of all of them, turnless ones too.

    Conversation c starts with the first h turns of c - c % bundle, h = crc32(c) % most, and goes on with its own after its first h.
    """
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ids = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % bundle).alias("donor"), (crc32(F.col("conv_id")) % most).alias("h"))
    early = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "donor")
    opening = ids.join(early, "donor").where("pos < h").select("conv_id", "pos", "turn_key", "n_chars")
    given = opening.groupBy("conv_id").agg(F.count("*").alias("given"))
    # a conversation's own turns move by one number: join it to each turn from the small table of ids
    shift = ids.join(given, "conv_id", "left").select("conv_id", "h", (F.coalesce("given", F.lit(0)) - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn_key", "n_chars")
    all_turns = tables.keep(opening.union(own))
    lengths = ids.select("conv_id").join(all_turns.groupBy("conv_id").agg(F.count("*").alias("length")), "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"))
    return all_turns, tables.keep(lengths, "lengths")


def dense_names(rows: DataFrame, keys: list[str], tables: Tables, base: int = 1) -> tuple[DataFrame, int]:
    """Distinct keys with `name`, numbers from base on without a gap, and the next free number; one count a partition reaches the driver."""
    distinct = tables.keep(rows.select(*keys).distinct().withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).cast("int")
    starts: list[int] = []
    for r in sorted(distinct.groupBy(part.alias("p")).count().collect()):
        starts += [0] * (r["p"] - len(starts)) + [base]
        base += r["count"]
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), part + 1)
    return distinct.select(*keys, (first + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("name")), base


def prefix_names(turns: DataFrame, longest: int, tables: Tables) -> DataFrame:
    """(conv_id, depth, parent, name, n_chars) of each prefix of one turn or more; the empty prefix has the name 0.

    Equal prefixes, and only those, share a name; parent is the name of the prefix one turn shorter; n_chars is of the last turn.
    """
    levels = max(longest, 1).bit_length()
    names, _ = dense_names(turns, ["turn_key"], tables)
    blocks = [tables.keep(turns.join(names, "turn_key").select("conv_id", "pos", "name", "n_chars"))]  # of level j: pos counts blocks of 2^j turns
    for _ in range(1, levels):
        odd = F.col("pos") % 2 == 1
        pairs = blocks[-1].groupBy("conv_id", F.floor(F.col("pos") / 2).alias("pos")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b")).where("b is not null")
        pairs = tables.keep(pairs)
        names, _ = dense_names(pairs, ["a", "b"], tables)
        blocks.append(tables.keep(pairs.join(names, ["a", "b"]).select("conv_id", "pos", "name")))
    known, base = None, 1
    for j in reversed(range(levels)):
        # depths whose lowest digit is 2^j: an even block of level j behind a prefix named before (the empty one at 0)
        behind = blocks[j].where(F.col("pos") % 2 == 0).select("conv_id", (F.col("pos") * (1 << j)).alias("at"), F.col("name").alias("b"))
        first = behind.where("at = 0").withColumn("a", F.lit(0).cast("long"))
        later = behind.where("at > 0").join(known.select("conv_id", F.col("depth").alias("at"), F.col("name").alias("a")), ["conv_id", "at"]) if known is not None else first.limit(0)
        pairs = tables.keep(first.select("conv_id", "at", "a", "b").union(later.select("conv_id", "at", "a", "b")))
        names, base = dense_names(pairs, ["a", "b"], tables, base)
        found = tables.keep(pairs.join(names, ["a", "b"]).select("conv_id", (F.col("at") + (1 << j)).alias("depth"), "name"))
        known = found if known is None else known.union(found)
    parents = known.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent")).union(known.where("depth = 1").select("conv_id", "depth", F.lit(0).cast("long").alias("parent")))
    chars = blocks[0].select("conv_id", (F.col("pos") + 1).alias("depth"), "n_chars")
    return tables.keep(known.join(parents, ["conv_id", "depth"]).join(chars, ["conv_id", "depth"]).select("conv_id", "depth", "parent", "name", "n_chars"), "prefixes")


def subtree_sums(nodes: DataFrame, longest: int, columns: list[str], tables: Tables) -> DataFrame:
    """(name, *columns): each column summed over the node and all below it, in a round for each binary digit of the depth.

    nodes are (name, parent, depth, *columns); a parent that is not in the table stands above all of it.
    """
    state = tables.keep(nodes.select("name", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), *columns))
    for _ in range(max(longest, 1).bit_length()):
        add = state.where("up is not null").groupBy(F.col("up").alias("name")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        above = state.select(F.col("name").alias("up"), F.col("up").alias("_up")).where("_up is not null")
        state = tables.keep(state.join(add, "name", "left").join(above, "up", "left").select("name", F.col("_up").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]))
    return tables.keep(state.drop("up"), "sums")


def ids_hashes(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of the decimal conv_ids of each name, ascending and joined by commas.

    Ids meet sorted in range partitions as pieces of up to BLOCK; a name's pieces then pass through one hash in order,
    which holds no more than a piece at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["name", "first", "piece"])

        for batch in batches:
            for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (n != name or len(ids) == BLOCK):
                    yield piece()
                    ids = []
                name = n
                ids.append(i)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, done = None, None, []
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _named(done)
            done = []
        if state is not None:
            yield _named([(name, state.hexdigest())])

    def _named(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["name", "ends_sha256"])

    sorted_ids = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    parts = sorted_ids.mapInArrow(given_back(pieces), "name long, first long, piece string")
    return parts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(given_back(hashed), "name long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bundle: int = 100, most: int = 6) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role and text) of rebuilt conversations (see `rebuilt`); the root has depth 0.
    conv_id is its smallest member, n_leaves counts the childless nodes of its subtree, saved_tokens sums over the subtree what
    sharing saves, (n_convs - 1) times the code points of a node's last text, and ends_sha256 hashes the ids of the conversations that end there.
    Turns go by turn (null first); turns of one number by role (shorter first) and the hash of role and text. Null role and text are
    empty; rows without a conv_id take no part; repeated rows are turns of their own; conv_ids may be negative (c % bundle has c's sign, as in SQL).
    Texts of any length travel as a SHA-256, on which equality rests. Other columns are not read; an empty table has no node.
    """
    spark = conversations.sparkSession
    tables = Tables(spark, "trie")
    turns, lengths = rebuilt(numbered_turns(conversations, tables), conversations, bundle, most, tables)
    total = lengths.agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.min("conv_id").alias("least")).first()
    if not total["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    longest = int(total["longest"])
    prefixes = prefix_names(turns, longest, tables)
    root = spark.createDataFrame([(0, None, 0, int(total["least"]), int(total["n"]), 0)], "name long, parent long, depth long, conv_id long, n_convs long, n_chars long")
    nodes = prefixes.groupBy("name", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars")).select(*root.columns).union(root)
    nodes = tables.keep(nodes)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    nodes = tables.keep(nodes.join(children, "name", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "lone": F.coalesce("lone", F.lit(0))}), "nodes")
    # below a node of one member there is one leaf and nothing to save: only shared nodes need sums over their subtrees
    shared = nodes.where("n_convs > 1 or depth = 0").select("name", "parent", "depth", (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.col("lone")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    deepest = int(shared.agg(F.max("depth").alias("d")).first()["d"])
    sums = subtree_sums(shared, deepest, ["n_leaves", "saved_tokens"], tables)
    tables.clear()
    ends = lengths.where("length = 0").select(F.lit(0).cast("long").alias("name"), "conv_id").union(prefixes.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("name", "conv_id"))
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, "name", "left")
        .join(ids_hashes(ends), "name", "left")
        .join(above, "parent", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def op12_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, length(coalesce(role, '')), left(coalesce(role, ''), 64), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS donor,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
             lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), raw AS (
  SELECT i.conv_id, 0 AS own, t.pos, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.donor AND t.pos < i.h
  UNION ALL
  SELECT i.conv_id, 1, t.pos, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.pos >= i.h
), built AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text FROM raw
), p AS (
  SELECT conv_id, depth, length(text) AS n_chars, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM built
  UNION ALL
  SELECT conv_id, 0, 0, [] FROM ids
), l AS (
  SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1
), n AS MATERIALIZED (
  SELECT p.depth, prefix, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(n_chars) AS n_chars,
         coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE l.depth = p.depth), '') AS ends
  FROM p JOIN l USING (conv_id) GROUP BY p.depth, prefix
), m AS MATERIALIZED (
  SELECT p.conv_id AS member, p.depth, n.conv_id FROM p JOIN n USING (depth, prefix)
), k AS (
  SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1
), c AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE parent_conv_id IS NOT NULL GROUP BY 1, 2
), s AS (
  SELECT m.conv_id, m.depth, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.n_chars) AS saved
  FROM n LEFT JOIN c ON c.conv_id = n.conv_id AND c.depth = n.depth JOIN m ON m.member = n.conv_id AND m.depth <= n.depth GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, k.parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN k USING (conv_id, depth) LEFT JOIN c USING (conv_id, depth) JOIN s USING (conv_id, depth)
"""
