"""Registered queries of operators for long series, many boxes and large traces.  Block sizes are small, so that the given
tables are cut into many blocks."""

from __future__ import annotations


from pyspark.sql import functions as F

from thicket.operators import analytics as an
from thicket.operators import boxes as bx
from thicket.operators import diagnostics as dg
from thicket.operators import posterior as po
from thicket.queries import FEATURES, ITEMS, LOG, items, log, query, r, table, xs
from thicket.queries_parts import place
from thicket.sources import dumps as du
from thicket.streaming.leaves import LeafSums

_BLOCK = 500

# -- one long series -------------------------------------------------------------------------------------------------


@query("SELECT event_id AS draw, round(sum(25.0 - value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) + 0.0 AS cum_regret FROM events")
def one_agent_regret(spark, sf):
    """The events as one agent's draws, in many blocks."""
    rows = table(spark, sf, "events").select(F.lit("one").alias("agent"), F.col("event_id").alias("draw"), F.lit(25.0).alias("best_mean"), F.col("value").alias("chosen_mean"))
    return an.cumulative_regret(rows, block_rows=_BLOCK).select("draw", r("cum_regret", 3).alias("cum_regret"))


@query(f"SELECT arm, t, round(sum(reward) OVER (PARTITION BY arm ORDER BY t ROWS UNBOUNDED PRECEDING) / sum(reward) OVER (PARTITION BY arm), 8) + 0.0 AS share FROM {LOG}")
def cumulative_weights(spark, sf):
    return an.cumulative_share(log(spark, sf), "reward", ["arm"], "t", block_rows=_BLOCK).select("arm", "t", r("share", 8).alias("share"))


@query("SELECT event_id, round(avg(ln(value + 1)) OVER (ORDER BY event_id ROWS BETWEEN 600 PRECEDING AND 600 FOLLOWING), 6) + 0.0 AS smooth FROM events")
def wide_moving_average(spark, sf):
    """A window of 1,201 rows over blocks of 500."""
    return an.moving_average(table(spark, sf, "events").withColumn("v", F.log1p("value")), [], "event_id", "v", 1201, block_rows=_BLOCK).select("event_id", r("smooth").alias("smooth"))


@query(
    "WITH i AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), k AS (SELECT unnest(range(-100, 101)) AS k), "
    "w AS (SELECT k, exp(-0.5 * power(k / CAST(25 AS DOUBLE), 2)) AS w FROM k), s AS (SELECT event_id, k, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS p, n FROM i, k) "
    "SELECT s.event_id, round(sum(w * b.value) / sum(w), 6) + 0.0 AS smooth FROM s JOIN w USING (k) JOIN i b ON b.i = if(p < s.n, p, 2 * s.n - 1 - p) GROUP BY 1"
)
def wide_gaussian_smoothing(spark, sf):
    """A reach of 100 rows to either side over blocks of 60."""
    return an.gaussian_smooth(table(spark, sf, "events"), [], "event_id", "value", 25.0, block_rows=60).select("event_id", r("smooth").alias("smooth"))


_FAR = [1, 2, 5, 10, 50, 100, 400, 800]


@query(" UNION ALL ".join(f"SELECT {k} AS lag, round(corr(value, before), 6) + 0.0 AS rho FROM (SELECT value, lag(value, {k}) OVER (ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL" for k in _FAR))
def far_autocorrelation(spark, sf):
    """800 lags of one chain over blocks of 500."""
    chain = table(spark, sf, "events").select(F.lit(0).alias("chain"), F.col("event_id").alias("draw"), "value")
    return dg.autocorrelation(chain, 800, block_rows=_BLOCK).where(F.col("lag").isin(_FAR)).select("lag", r("rho").alias("rho"))


# -- many boxes ------------------------------------------------------------------------------------------------------

_DEPTH = 13
_SPAN = ", ".join(f"min({c}) AS lo{k}, max({c}) AS hi{k}" for k, c in enumerate(FEATURES))
# a node of depth d splits feature d % 4 in the middle of its box; its place among the boxes of that feature are the bits of its path
_D = "length(bin(node + 1)) - 1"
_AT = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(({_D}) % 4, {_D}, 4), lambda j: ((node + 1) >> ({_D} - 1 - j)) & 1)), lambda a, b: 2 * a + b)"
_THR = f"CASE ({_D}) % 4 " + " ".join(f"WHEN {k} THEN lo{k} + (hi{k} - lo{k}) * (2 * {_AT} + 1) / power(2.0, ({_D}) // 4 + 1)" for k in range(4)) + " END"
_X = "CASE var " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(FEATURES)) + " END"


@query(
    f"WITH RECURSIVE x AS MATERIALIZED (SELECT {', '.join(FEATURES)}, count(*) AS n, sum(y) AS y FROM {ITEMS} GROUP BY ALL), "
    f"tree AS MATERIALIZED (SELECT node, ({_D}) % 4 AS var, {_THR} AS thr FROM range(0, {2**_DEPTH - 1}) t(node), (SELECT {_SPAN} FROM {ITEMS})), "
    f"walk AS (SELECT x.*, 0::BIGINT AS node_at FROM x UNION ALL SELECT walk.* EXCLUDE (node_at), if({_X} <= thr, 2 * node_at + 1, 2 * node_at + 2) FROM walk JOIN tree ON node = node_at) "
    f"SELECT node_at AS leaf, sum(n)::BIGINT AS n, round(sum(y), 2) + 0.0 AS total FROM walk WHERE node_at >= {2**_DEPTH - 1} GROUP BY 1"
)
def box_join_many_leaves(spark, sf):
    """8,192 leaves of a tree that halves the features' ranges in turn; rows find theirs by an index of cells."""
    rows = items(spark, sf)
    span = rows.agg(*[f(c).alias(n + str(k)) for k, c in enumerate(FEATURES) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    node = F.col("id")
    numbered = spark.range(2 ** (_DEPTH + 1) - 1).join(F.broadcast(span), F.lit(True))  # one row
    depth = F.length(F.bin(node + 1)) - 1
    bits = F.filter(F.transform(F.split(F.bin(node + 1), ""), lambda b, j: F.when((j > 0) & ((j - 1) % 4 == depth % 4), b.cast("long"))), lambda b: b.isNotNull())
    at = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: 2 * a + b)
    thr = F.coalesce(*[F.when(depth % 4 == k, F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (2 * at + 1) / F.pow(F.lit(2.0), F.floor(depth / 4) + 1)) for k in range(4)])
    nodes = numbered.select(node.alias("node"), F.when(depth < _DEPTH, depth % 4).otherwise(-1).alias("var"), thr.alias("thr"))
    joined = bx.join_boxes(rows, xs(), bx.leaf_boxes(nodes, [], len(FEATURES)))
    return joined.groupBy("leaf").agg(F.count("*").alias("n"), r(F.sum("y"), 2).alias("total"))


# -- sketches, files and streams ----------------------------------------------------------------------------------------


@query("SELECT event_type, hour(ts)::INT AS hour, quantile_disc(value, 0.1) AS lo, quantile_disc(value, 0.9) AS hi FROM events GROUP BY 1, 2")
def sketched_intervals(spark, sf):
    """Values as draws of four chains: a sketch a chain, merged; the draws inside its brackets give the exact quantiles."""
    e = table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour"), (F.col("user_id") % 4).alias("chain"), F.col("value").alias("f"))
    merged = po.merged_sketches(po.sketches(e, ["event_type", "hour", "chain"], k=4_000), ["event_type", "hour"])
    return po.exact_intervals(e, ["event_type", "hour"], merged, level=0.8, k=4_000).select("event_type", "hour", "lo", "hi")


_GROUPS = "(SELECT l_orderkey AS o, count(*) AS n, round(avg(l_quantity), 3) AS q, max(l_tax) AS t FROM lineitem GROUP BY 1)"


@query(
    f"SELECT node::BIGINT AS node, var::INT AS var, count(*) AS n, round(sum(thr), 3) AS thr, round(sum(leaf), 3) AS leaf FROM {_GROUPS}, LATERAL (SELECT * FROM (VALUES (0, 0, q, NULL, true), (1, -1, NULL, n / 8.0, true), "
    "(2, if(n % 2 = 0, 2, -1), if(n % 2 = 0, t, NULL), if(n % 2 = 0, NULL, 0.5), true), (5, -1, NULL, t, n % 2 = 0), (6, -1, NULL, -t, n % 2 = 0)) v(node, var, thr, leaf, there)) WHERE there GROUP BY 1, 2"
)
def dumped_forest(spark, sf):
    """A tree for each order, written as one JSON dump a line, read back and unfolded to nodes."""
    by = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 3).alias("q"), F.max("l_tax").alias("t"))
    number = lambda c: c.cast("double").cast("string")
    leaf = lambda at, v: F.concat(F.lit('{"nodeid":'), F.lit(at).cast("string"), F.lit(',"leaf":'), number(v), F.lit("}"))
    split = lambda at, f, t, a, b, below: F.concat(F.lit(f'{{"nodeid":{at},"split":"f{f}","split_condition":'), number(t), F.lit(f',"yes":{a},"no":{b},"children":['), *below, F.lit("]}"))
    inner = split(2, 2, F.col("t"), 3, 4, [leaf(3, F.col("t")), F.lit(","), leaf(4, -F.col("t"))])
    right = F.when(F.col("n") % 2 == 0, inner).otherwise(leaf(2, F.lit(0.5)))
    path = f"{place(spark)}/dumps"
    by.select(split(0, 0, F.col("q"), 1, 2, [leaf(1, F.col("n") / 8), F.lit(","), right])).write.text(path)
    nodes = du.boosted_nodes(du.read_dumps(spark, path), ["tree"])
    return nodes.groupBy("node", "var").agg(F.count("*").alias("n"), F.round(F.sum("thr"), 3).alias("thr"), F.round(F.sum("leaf"), 3).alias("leaf"))


_LEAF_OF = "if(value <= 10, 1, if(user_id % 2 = 0, 5, 6))"


@query(f"SELECT {_LEAF_OF}::INT AS leaf, count(*) AS n, round(sum(value), 3) + 0.0 AS s, round(sum(value * value), 2) + 0.0 AS s2 FROM events GROUP BY 1")
def streamed_leaf_sums(spark, sf):
    """The events as a stream of files, in two runs of one query: sums by leaf, appended by batch and compacted."""
    path = place(spark)
    e = table(spark, sf, "events").select(F.when(F.col("value") <= 10, 1).when(F.col("user_id") % 2 == 0, 5).otherwise(6).alias("leaf"), "value", "event_id")
    value = F.col("value")
    state = LeafSums(spark, f"{path}/state", ["leaf"], {"s": value, "s2": value * value}, compact_every=3)
    halves = e.withColumn("late", F.col("event_id") > e.agg(F.percentile_approx("event_id", 0.5)).first()[0])
    for late in (False, True):
        halves.where(F.col("late") == late).drop("late").repartitionByRange(4, "event_id").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        state.start(stream, f"{path}/at").awaitTermination()
    return state.read().select("leaf", "n", r("s", 3).alias("s"), r("s2", 2).alias("s2"))
