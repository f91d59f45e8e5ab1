"""Queries over contracts, sources and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contracts, ranks, relate
from ..sources import scratch, tables
from .registry import POSITIONS, events, query, rounded, samples, windows

SPEC = "0=Eyes Closed, 1=eyes-open, 2=N-Back 0, 3=N-Back 1, 4=N-Back 2, 5=MATB Easy, 6=MATB Hard"


@query("SELECT 'price is positive' AS rule, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS violations FROM orders UNION ALL SELECT 'known status', count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders UNION ALL SELECT 'has a customer', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders")
def order_contract(spark, sf_dir):
    o = tables.scan(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
    return contracts.violations(o, {"price is positive": F.col("o_totalprice") > 0, "known status": F.col("o_orderstatus").isin("F", "O"), "has a customer": F.col("o_custkey").isNotNull()})


@query("WITH e AS (SELECT * FROM events WHERE value > 98) SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN (SELECT DISTINCT event_type FROM e) t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = u.user_id AND e.event_type = t.event_type)")
def missing_grid_cells(spark, sf_dir):
    return contracts.missing_cells(events(spark, sf_dir).where("value > 98").select("user_id", "event_type"), ["user_id", "event_type"])


@query("WITH h AS (SELECT DISTINCT label AS value FROM embeddings WHERE label IS NOT NULL), w AS (SELECT unnest([0, 1, 2, 3, 4, 5, 42]) AS value) SELECT CAST(value AS INTEGER) AS value, 'unexpected' AS side FROM h WHERE value NOT IN (SELECT value FROM w) UNION ALL SELECT value, 'absent' FROM w WHERE value NOT IN (SELECT value FROM h)")
def unexpected_labels(spark, sf_dir):
    return contracts.unexpected(tables.scan(spark, sf_dir, "embeddings", "label"), "label", [0, 1, 2, 3, 4, 5, 42])


@query("SELECT name, count(*) AS n FROM (SELECT CASE label WHEN 0 THEN 'eyesclosed' WHEN 1 THEN 'eyesopen' WHEN 2 THEN 'nback0' WHEN 3 THEN 'nback1' WHEN 4 THEN 'nback2' WHEN 5 THEN 'matbeasy' WHEN 6 THEN 'matbhard' END AS name FROM embeddings) GROUP BY 1")
def named_labels(spark, sf_dir):
    return contracts.named(tables.scan(spark, sf_dir, "embeddings", "label"), "label", contracts.label_names(SPEC)).groupBy("name").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 0 WHEN i <= 4 THEN i ELSE -1 END AS state FROM events JOIN e USING (event_type)) SELECT CAST(state AS INTEGER) AS state, count(*) AS n FROM s GROUP BY 1")
def state_counts(spark, sf_dir):
    e = events(spark, sf_dir)
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(4).collect()]
    return e.groupBy(contracts.state_labels(F.col("user_id") % 2, F.col("event_type"), names).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT label, count(embedding) AS n, CAST(min(len(embedding)) AS BIGINT) AS shortest, CAST(max(len(embedding)) AS BIGINT) AS longest, count(*) FILTER (WHERE len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0) AS not_finite, round(max(list_max(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))))), 6) AS largest FROM embeddings GROUP BY 1")
def payload_audit(spark, sf_dir):
    return contracts.array_audit(windows(spark, sf_dir), "embedding", "label").withColumn("largest", rounded("largest"))


_HEX = "list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', h[i]) - 1) * CAST(pow(16, 8 - i) AS BIGINT)))"


@query(f"WITH r AS (SELECT 'nation' AS name, md5(concat_ws('|', n_name, CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR))) AS h FROM nation UNION ALL SELECT 'orders', md5(concat_ws('|', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderstatus)) FROM orders) SELECT name, count(*) AS n, CAST(sum({_HEX}) AS BIGINT) AS digest FROM r GROUP BY 1")
def handoff_manifest(spark, sf_dir):
    return contracts.manifest({"nation": tables.scan(spark, sf_dir, "nation", "n_name", "n_nationkey", "n_regionkey"), "orders": tables.scan(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus")})


@query("SELECT vec_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS montage, round(CAST(CASE WHEN label < 5 THEN embedding[1] ELSE embedding[2] END AS DOUBLE), 6) AS c0, round(CAST(CASE WHEN label < 5 THEN embedding[3] ELSE embedding[4] END AS DOUBLE), 6) AS c1, round(CAST(CASE WHEN label < 5 THEN embedding[9] ELSE embedding[10] END AS DOUBLE), 6) AS c2 FROM embeddings WHERE label IS NOT NULL")
def montage_union(spark, sf_dir):
    w = windows(spark, sf_dir)
    both = tables.union_sources([("a", w.where("label < 5"), [0, 2, 8]), ("b", w.where("label >= 5"), [1, 3, 9])], "embedding", "montage")
    return both.select("vec_id", "montage", *[rounded(F.col("embedding")[i].cast("double")).alias(f"c{i}") for i in range(3)])


@query("SELECT o_orderkey, TRY_CAST(nullif(split_part(o_orderpriority, '-', 1), '5') AS DOUBLE) AS level, TRY_CAST(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS bad FROM orders")
def coerced_numbers(spark, sf_dir):
    part = lambda i: F.split_part("o_orderpriority", F.lit("-"), F.lit(i))
    return tables.scan(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", tables.number(F.nullif(part(1), F.lit("5"))).alias("level"), tables.number(part(2)).alias("bad"))


@query("SELECT p_brand AS brand, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS layer, lower(p_type) AS role, replace(lower(p_name), ' ', '_') AS module, count(*) AS n FROM part GROUP BY 1, 2, 3, 4")
def module_names(spark, sf_dir):
    p = tables.scan(spark, sf_dir, "part", "p_brand", "p_type", "p_name")
    return p.groupBy(F.col("p_brand").alias("brand"), F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("layer"), F.lower("p_type").alias("role"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("module")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS payload FROM nation")
def json_payload(spark, sf_dir):
    return tables.scan(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("payload"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id % 5 IN (1, 2) AND user_id % 15 <> 1 AND event_type <> 'error' GROUP BY 1, 2")
def selected_subjects(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("group", F.col("user_id") % 5)
    chosen = relate.selected(e, "group", include=[1, 2]).where("user_id % 15 <> 1")
    return relate.selected(chosen, "event_type", exclude=["error"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0) WHERE o_orderstatus <> 'P' GROUP BY 1")
def partitioned_readback(spark, sf_dir):
    """A table written by partitions, appended to, with rows replaced, and read back through its partitions."""
    import uuid

    path = f"{scratch.shared_folder(spark)}/readback-{uuid.uuid4().hex}"
    o = tables.scan(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    contracts.append(o.where("o_orderkey % 2 = 0"), f"{path}/first", "o_orderstatus")
    contracts.append(o.where("o_orderkey % 2 = 1"), f"{path}/first", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    tables.write_table(tables.upsert(spark.read.parquet(f"{path}/first"), new, ["o_orderkey"]), f"{path}/second", "o_orderstatus")
    return spark.read.parquet(f"{path}/second").where("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


# matching


@query("WITH a AS (SELECT o_custkey % 20 AS run, o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_custkey % 20 AS run, o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0), d AS (SELECT coalesce(a.run, b.run) AS run, a.id AS x, b.id AS y FROM a FULL JOIN b ON a.run = b.run AND a.id = b.id) SELECT run, count(*) FILTER (WHERE y IS NULL) AS only_a, count(*) FILTER (WHERE x IS NULL) AS only_b, array_to_string(list_sort(list(x) FILTER (WHERE y IS NULL))[1:20], ',') AS first_a, array_to_string(list_sort(list(y) FILTER (WHERE x IS NULL))[1:20], ',') AS first_b FROM d GROUP BY 1 HAVING count(*) FILTER (WHERE x IS NULL OR y IS NULL) > 0")
def index_difference(spark, sf_dir):
    o = tables.scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((F.col("o_custkey") % 20).alias("run"), F.col("o_orderkey").alias("id"))
    d = relate.index_difference(o.where("id % 7 <> 0"), o.where("id % 11 <> 0"), "run", "id", 20)
    return d.withColumns({"first_a": F.array_join("first_a", ","), "first_b": F.array_join("first_b", ",")})


@query("WITH a AS (SELECT event_type, user_id % 4 AS arm, avg(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT * FROM a WHERE arm <> 3) SELECT a.event_type, a.arm, round(a.v, 6) AS v, CASE WHEN r.v IS NULL THEN 'missing' ELSE 'ok' END AS status, round((a.v - 20) / nullif(r.v - 20, 0), 6) AS retention FROM a LEFT JOIN r ON a.event_type = r.event_type AND a.arm = r.arm")
def retention_status(spark, sf_dir):
    a = events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 4).alias("arm")).agg(F.avg("value").alias("v"))
    out = relate.with_reference(a, a.where("arm <> 3"), ["event_type", "arm"], "v", 20.0)
    return out.select("event_type", "arm", rounded("v").alias("v"), "status", rounded("retention").alias("retention"))


@query("SELECT event_type, round(avg(value) FILTER (WHERE user_id % 3 = 0), 6) AS slow, round(avg(value) FILTER (WHERE user_id % 3 = 1), 6) AS fast, round(avg(value) FILTER (WHERE user_id % 3 = 2), 6) AS ambient, round(avg(value) FILTER (WHERE user_id % 3 = 0) / avg(value) FILTER (WHERE user_id % 3 = 2), 6) AS slow_to_ambient FROM events GROUP BY 1")
def pivoted_sources(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("source", F.element_at(F.array(*map(F.lit, ("slow", "fast", "ambient"))), (F.col("user_id") % 3 + 1).cast("int")))
    wide = e.groupBy("event_type").pivot("source", ["slow", "fast", "ambient"]).agg(F.avg("value"))
    return wide.select("event_type", *[rounded(c).alias(c) for c in ("slow", "fast", "ambient")], rounded(F.col("slow") / F.col("ambient")).alias("slow_to_ambient"))


@query("WITH u AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 95), e AS (SELECT DISTINCT event_type FROM events), p AS (SELECT a.event_type AS a, b.event_type AS b FROM e a JOIN e b ON a.event_type < b.event_type) SELECT a, b, (SELECT count(*) FROM (SELECT user_id FROM u WHERE event_type = a EXCEPT SELECT user_id FROM u WHERE event_type = b)) AS only_a, (SELECT count(*) FROM (SELECT user_id FROM u WHERE event_type = b EXCEPT SELECT user_id FROM u WHERE event_type = a)) AS only_b, (SELECT count(*) FROM (SELECT user_id FROM u WHERE event_type = a INTERSECT SELECT user_id FROM u WHERE event_type = b)) AS both FROM p")
def subject_composition(spark, sf_dir):
    return relate.composition(events(spark, sf_dir).where("value > 95"), "event_type", "user_id", tables.scan(spark, sf_dir, "events", "event_type"))


@query("WITH r AS (SELECT r_regionkey AS task, unnest([1, 2]) AS replicate FROM region) SELECT a.replicate AS r0, b.replicate AS r1, c.replicate AS r2, d.replicate AS r3, e.replicate AS r4 FROM r a, r b, r c, r d, r e WHERE a.task = 0 AND b.task = 1 AND c.task = 2 AND d.task = 3 AND e.task = 4")
def replicate_combinations(spark, sf_dir):
    runs = tables.scan(spark, sf_dir, "region", "r_regionkey").select(F.col("r_regionkey").alias("task"), F.explode(F.array(F.lit(1), F.lit(2))).alias("replicate"))
    return relate.combinations(runs, "task", "replicate", range(5))


@query("WITH e AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), v AS (SELECT user_id, epoch_us(ts) AS us, event_id, value, i FROM events JOIN e USING (event_type)), l AS (SELECT * FROM v WHERE i = 1), r AS (SELECT user_id, us, max(value) AS value FROM v WHERE i = 2 GROUP BY 1, 2) SELECT l.event_id, arg_min(r.value, (abs(l.us - r.us), r.us)) AS nearest, min(abs(l.us - r.us)) AS gap FROM l JOIN r USING (user_id) GROUP BY 1")
def nearest_match(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("at", F.unix_micros("ts"))
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    right = e.where(F.col("event_type") == names[-1]).groupBy("user_id", "at").agg(F.max("value").alias("value"))
    return relate.nearest(e.where(F.col("event_type") == names[0]).select("user_id", "at", "event_id"), right, "user_id", "at", "value").where("gap is not null").select("event_id", "nearest", "gap")


@query("WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS d2 FROM q JOIN embeddings c ON q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbour) AS rank FROM d) SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour, round(sqrt(d2), 5) AS distance FROM r WHERE rank <= 5")
def nearest_neighbours(spark, sf_dir):
    w = windows(spark, sf_dir)
    return relate.nearest_neighbours(w, w.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).withColumn("distance", rounded("distance", 5))


@query("WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS d FROM q JOIN embeddings c ON q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour) AS rank FROM d), k AS (SELECT query_id, max(d) FILTER (WHERE rank = 10) AS t FROM r GROUP BY 1), m AS (SELECT query_id, 1 / avg(ln(t / d)) AS dim FROM r JOIN k USING (query_id) WHERE rank < 10 AND d > 0 GROUP BY 1) SELECT count(*) AS n, round(avg(dim), 4) AS mean_dimension, round(median(dim), 4) AS median_dimension FROM m")
def intrinsic_dimension(spark, sf_dir):
    w = windows(spark, sf_dir)
    d = relate.intrinsic_dimension(relate.nearest_neighbours(w, w.where("vec_id % 20 = 0"), "vec_id", "embedding", 10), 10)
    return d.agg(F.count("*").alias("n"), rounded(F.avg("dimension"), 4).alias("mean_dimension"), rounded(F.median("dimension"), 4).alias("median_dimension"))


@query("WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 4 = 0), d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS d2 FROM q JOIN embeddings c ON q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbour) AS rank FROM d), s AS (SELECT query_id, list(neighbour) AS near FROM r WHERE rank <= 8 GROUP BY 1), o AS (SELECT query_id, near, lead(near, 2) OVER (ORDER BY query_id) AS later FROM s) SELECT query_id, round(len(list_intersect(near, later)) / len(list_distinct(list_concat(near, later))), 6) AS jaccard FROM o WHERE later IS NOT NULL")
def neighbour_overlap(spark, sf_dir):
    w = windows(spark, sf_dir)
    near = relate.nearest_neighbours(w, w.where("vec_id % 4 = 0"), "vec_id", "embedding", 8)
    return relate.neighbour_overlap(near, 2).withColumn("jaccard", rounded("jaccard"))


@query(f"WITH {POSITIONS}, d AS (SELECT user_id, t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t) AS p FROM t) SELECT count(*) AS n_rows, count(*) FILTER (WHERE p <> t + 1) AS out_of_place FROM d")
def ledger_positions(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("t")))
    return s.agg(F.count("*").alias("n_rows"), F.count_if(F.col("p") != F.col("t") + 1).alias("out_of_place"))


_SEAL = "CAST(sum(CAST('0x' || substr(h, {0}, 15) AS HUGEINT)) AS VARCHAR)"


@query(f"WITH r AS (SELECT 'nation' AS name, sha256(CAST(json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey) AS VARCHAR)) AS h FROM nation UNION ALL SELECT 'orders', sha256(CAST(json_object('o_custkey', o_custkey, 'o_orderkey', o_orderkey, 'o_orderstatus', nullif(o_orderstatus, 'P')) AS VARCHAR)) FROM orders) SELECT name, CAST(3 AS INTEGER) AS version, count(*) AS n, concat_ws('-', {', '.join(_SEAL.format(16 * i + 1) for i in range(4))}) AS digest FROM r GROUP BY 1")
def sealed_handoff(spark, sf_dir):
    """Tables handed off under a version and a seal of SHA-256 sums, loaded again and sealed once more."""
    import uuid

    path = f"{scratch.shared_folder(spark)}/handoff-{uuid.uuid4().hex}"
    orders = tables.scan(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    contracts.export({"nation": tables.scan(spark, sf_dir, "nation", "n_name", "n_nationkey", "n_regionkey"), "orders": orders}, path, 3)
    return contracts.seal(contracts.load(spark, path, 3), 3).select("name", "version", "n", "digest")


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders) SELECT l_orderkey, l_linenumber, position FROM lineitem JOIN o ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def ledger_lookup(spark, sf_dir):
    """The lines of large quantity with their order's place among its customer's, by a ledger that must have each order once."""
    o = ranks.places(tables.scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "position")
    lines = tables.scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").where("l_quantity > 45")
    return contracts.looked_up(lines.withColumnRenamed("l_orderkey", "o_orderkey"), o, ["o_orderkey"], "position").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "position")


@query("SELECT user_id, t, value, flag FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS flag FROM events) WHERE user_id % 50 = 7 AND value IS NOT NULL")
def recording_readback(spark, sf_dir):
    """Samples of some subjects written as text, a folder a subject, and read back with their checks."""
    import uuid

    path = f"{scratch.shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    s = samples(spark, sf_dir).where("user_id % 50 = 7 and value is not null").select("user_id", "t", "value", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("flag"))
    s.repartition("user_id").sortWithinPartitions("user_id", "t").write.partitionBy("user_id").csv(path, sep=";", header=True)
    read = tables.recording(spark, path, "t long, value double, flag int, user_id long", "t", ("flag",), ";")
    return read.select("user_id", "t", "value", "flag")
