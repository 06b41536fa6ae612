"""Registered queries of the library's operators over the given tables, and their SQL.

Bindings: lineitem is a regression table (quantity, discount, tax and month to price), labels with documents a binary
one, embeddings a ten-class one, and events a bandit log (type to arm, value to reward).  Floats are rounded on both
sides.  Queries that draw random numbers have no SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import columns as fc
from thicket.operators import analytics as an
from thicket.operators import diagnostics as dg
from thicket.operators import forest as fo
from thicket.operators import metrics as me
from thicket.operators import posterior as po
from thicket.operators import preprocess as pp
from thicket.operators import sampling as sa
from thicket.operators import stats as st
from thicket.sources.files import table
from thicket.sources.scenarios import SCENARIOS, signal
from thicket.streaming import simulate as sm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def r(c, digits: int = 6):
    """Rounded, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


# -- bindings --------------------------------------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_discount", "l_tax", "month"]
SQL_X = ["l_quantity", "l_discount", "l_tax", "month"]
ITEMS = "(SELECT l_returnflag, l_quantity, l_discount, l_tax, CAST(month(l_shipdate) AS DOUBLE) AS month, l_extendedprice AS y FROM lineitem) items"
FOREST = [
    {0: fo.split(0, 25.0), 1: fo.split(1, 0.05), 2: fo.leaf(0.3), 3: fo.leaf(-0.2), 4: fo.leaf(0.1)},
    {0: fo.split(2, 0.04), 1: fo.leaf(-0.15), 2: fo.leaf(0.05)},
    {0: fo.split(3, 6.0), 1: fo.leaf(0.02), 2: fo.split(0, 40.0), 5: fo.leaf(-0.04), 6: fo.leaf(0.08)},
]
TREE = FOREST[0]


def draws_of(n: int = 8) -> list[list[fo.Tree]]:
    """A literal trace: the forest with moved thresholds and values."""
    out = []
    for k in range(n):
        moved = [{i: fo.leaf(v.leaf * (1 + 0.1 * k)) if v.var < 0 else fo.split(v.var if k % 3 else (v.var + k) % 4, v.thr * (1 + 0.05 * k)) for i, v in t.items()} for t in FOREST]
        out.append(moved[: 3 if k % 2 else 2])
    return out


TRACE = draws_of()


def items(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select("l_returnflag", "l_quantity", "l_discount", "l_tax", F.month("l_shipdate").cast("double").alias("month"), F.col("l_extendedprice").alias("y"))


def xs() -> list:
    return [F.col(c) for c in FEATURES]


def with_x(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.array(*xs()))


ARMS = ["click", "error", "purchase", "signup", "view"]
_ARM_SQL = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
LOG = f"(SELECT event_id AS t, {_ARM_SQL} AS arm, value AS reward, CAST(user_id % 7 AS DOUBLE) / 7.0 AS x0, CAST(hour(ts) AS DOUBLE) / 24.0 AS x1, user_id, ts FROM events) log"


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    arm = F.array_position(F.array(*map(F.lit, ARMS)), F.col("event_type")).cast("int") - 1
    return e.select(F.col("event_id").alias("t"), arm.alias("arm"), F.col("value").alias("reward"), (F.col("user_id") % 7 / F.lit(7.0)).alias("x0"), (F.hour("ts") / F.lit(24.0)).alias("x1"), "user_id", "ts")


CHAINS = "(SELECT user_id % 4 AS chain, event_id AS draw, value FROM events) chains"


def chains(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select((F.col("user_id") % 4).alias("chain"), F.col("event_id").alias("draw"), "value")


# -- sources and preparation ---------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n, 4 AS p FROM {ITEMS}")
def dataset_shape(spark, sf):
    return with_x(items(spark, sf)).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p"))


@query(
    "SELECT feature, round(unnest(list_sort(list_distinct(q))), 6) + 0.0 AS threshold FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, quantile_cont({f}, [{', '.join(str(k / 20) for k in range(20))}]) AS q FROM {ITEMS}" for f in FEATURES)
    + ")"
)
def quantile_thresholds(spark, sf):
    found = pp.quantile_thresholds(items(spark, sf), FEATURES, 20)
    rows = [(f, float(v)) for f, q in zip(FEATURES, found, strict=True) for v in q]
    return spark.createDataFrame(rows, "feature string, threshold double").withColumn("threshold", r("threshold"))


@query(f"SELECT 'l_tax' AS feature, unnest(list_sort(list_distinct(list(l_tax)))) AS threshold FROM {ITEMS}")
def all_unique_thresholds(spark, sf):
    return pp.unique_values(items(spark, sf), "l_tax")


@query("SELECT l_returnflag, round(avg(CAST(CAST(l_discount AS FLOAT) AS DOUBLE)), 6) + 0.0 AS d, sum(CASE WHEN CAST(CAST(l_discount AS FLOAT) AS DOUBLE) <= 0.05 THEN 1 ELSE 0 END)::BIGINT AS n FROM lineitem GROUP BY 1")
def float32_features(spark, sf):
    f = F.col("l_discount").cast("float").cast("double")
    return items(spark, sf).groupBy("l_returnflag").agg(r(F.avg(f)).alias("d"), F.sum((f <= 0.05).cast("long")).alias("n"))


_MM = f"(SELECT i.*, min(y) OVER () AS lo, max(y) OVER () AS hi FROM {ITEMS.replace(' items', ' i')}) m"


@query(f"SELECT l_returnflag, round(min((y - lo) / (hi - lo) - 0.5), 6) + 0.0 AS low, round(avg((y - lo) / (hi - lo) - 0.5), 6) + 0.0 AS mean, round(max((y - lo) / (hi - lo) - 0.5), 6) + 0.0 AS high FROM {_MM} GROUP BY 1")
def minmax_transform(spark, sf):
    prep = pp.Preprocessor(["l_tax"], "y", 2).fit(items(spark, sf))
    return prep.transform(items(spark, sf), "z").groupBy("l_returnflag").agg(r(F.min("z")).alias("low"), r(F.avg("z")).alias("mean"), r(F.max("z")).alias("high"))


@query(f"SELECT l_returnflag, round(avg(y), 3) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def minmax_backtransform(spark, sf):
    prep = pp.Preprocessor(["l_tax"], "y", 2).fit(items(spark, sf))
    z = prep.transform(items(spark, sf), "z").withColumn("back", prep.backtransform(F.col("z")))
    return z.groupBy("l_returnflag").agg(r(F.avg("back"), 3).alias("mean"))


@query("SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS idx FROM documents")
def label_encode(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return pp.encode_labels(docs, "lang", pp.vocabulary(docs, "lang"))


@query("SELECT doc_id, lang AS label FROM documents")
def label_decode(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    words = pp.vocabulary(docs, "lang")
    return pp.decode_labels(pp.encode_labels(docs, "lang", words), "idx", words).select("doc_id", "label")


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def ordinal_codes(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return pp.encode_labels(c, "c_mktsegment", pp.vocabulary(c, "c_mktsegment"), "code").select("c_custkey", "code")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) + 0.0 AS first FROM embeddings")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", r(F.get("e", 0) / fc.norm(F.col("e"))).alias("first"))


def _encoded(kind: str, width: int) -> str:
    if kind == "one-hot":
        parts = ["x0", "x1", *[f"CASE WHEN arm = {a} THEN 1.0 ELSE 0.0 END" for a in range(5)]]
    else:
        parts = [f"CASE WHEN arm = {a} THEN x{k} ELSE 0.0 END" for a in range(5) for k in range(2)]
    return ", ".join(f"round(CAST({p} AS DOUBLE), 6) + 0.0 AS e{k}" for k, p in enumerate(parts[:width]))


def _arm_rows(spark, sf, kind, width):
    made = log(spark, sf).withColumn("e", pp.encode_arm(F.array("x0", "x1"), F.col("arm"), 5, 2, kind))
    return made.select("t", *[r(F.get("e", k)).alias(f"e{k}") for k in range(width)])


@query(f"SELECT t, {_encoded('one-hot', 7)} FROM {LOG}")
def encode_one_hot(spark, sf):
    return _arm_rows(spark, sf, "one-hot", 7)


@query(f"SELECT t, {_encoded('multi', 10)} FROM {LOG}")
def encode_multi(spark, sf):
    return _arm_rows(spark, sf, "multi", 10)


def _all_arms(rows):
    made = rows.drop("arm").withColumn("x", F.array("x0", "x1"))
    return pp.encode_all_arms(made, "x", 5, 2, "multi").select("t", F.col("arm").cast("long").alias("arm"), *[r(F.get("encoded", k)).alias(f"e{k}") for k in range(10)])


@query(f"SELECT t, a AS arm, {_encoded('multi', 10).replace('arm = ', 'a = ')} FROM {LOG}, (SELECT unnest(range(5)) AS a) arms")
def encode_all_arms(spark, sf):
    return _all_arms(log(spark, sf))


# -- forests ------------------------------------------------------------------------------------------------------------


@query(f"SELECT {fo.sql_leaf(TREE, SQL_X)} AS leaf, count(*) AS n FROM {ITEMS} GROUP BY 1")
def tree_traverse(spark, sf):
    var, thr, _ = fo.tree_columns(TREE)
    return with_x(items(spark, sf)).groupBy(fo.walk_leaf(var, thr, F.col("x"), fo.tree_depth(TREE)).alias("leaf")).agg(F.count("*").alias("n"))


@query(f"SELECT l_returnflag, round(avg({fo.sql_value(TREE, SQL_X)}), 6) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def tree_evaluate(spark, sf):
    return items(spark, sf).groupBy("l_returnflag").agg(r(F.avg(fo.case_value(TREE, xs()))).alias("mean"))


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(lo + (hi - lo) * ({fo.sql_forest(FOREST, SQL_X)} + 0.5)), 3) + 0.0 AS mean FROM {_MM} GROUP BY 1")
def forest_evaluate(spark, sf):
    prep = pp.Preprocessor(["l_tax"], "y", 2).fit(items(spark, sf))
    made = fo.with_draws(with_x(items(spark, sf)), [FOREST]).withColumn("f", prep.backtransform(F.get("draws", 0)))
    return made.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg("f"), 3).alias("mean"))


@query(f"SELECT l_returnflag, round(avg({fo.sql_forest(FOREST, SQL_X, [0, 2])}), 6) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def forest_all_except(spark, sf):
    return items(spark, sf).groupBy("l_returnflag").agg(r(F.avg(fo.case_forest(FOREST, xs(), all_except=[1]))).alias("mean"))


def _box_rows() -> list[tuple]:
    return [(leaf, *[v for lo, hi in box for v in (max(lo, -1e300), min(hi, 1e300))]) for leaf, box in fo.boxes(TREE, 4)]


@query(
    f"SELECT leaf, count(*) AS n, round(avg(y), 3) + 0.0 AS mean FROM {ITEMS} JOIN (VALUES "
    + ", ".join(f"({', '.join(repr(v) for v in row)})" for row in _box_rows())
    + ") b(leaf, a0, b0, a1, b1, a2, b2, a3, b3) ON l_quantity > a0 AND l_quantity <= b0 AND l_discount > a1 AND l_discount <= b1 AND l_tax > a2 AND l_tax <= b2 AND month > a3 AND month <= b3 GROUP BY 1"
)
def leaf_path_join(spark, sf):
    names = ["leaf", *[f"{s}{k}" for k in range(4) for s in "ab"]]
    box = F.broadcast(spark.createDataFrame(_box_rows(), f"leaf int, {', '.join(f'{n} double' for n in names[1:])}"))
    on = F.lit(True)
    for k, c in enumerate(FEATURES):
        on = on & (F.col(c) > F.col(f"a{k}")) & (F.col(c) <= F.col(f"b{k}"))
    return items(spark, sf).join(box, on).groupBy("leaf").agg(F.count("*").alias("n"), r(F.avg("y"), 3).alias("mean"))


@query(
    "SELECT t1, l1, t2, l2, count(*) AS n FROM (SELECT " + ", ".join(f"{fo.sql_leaf(t, SQL_X)} AS k{k}" for k, t in enumerate(FOREST)) + f" FROM {ITEMS}) z, "
    "LATERAL (SELECT * FROM (VALUES (0, k0), (1, k1), (2, k2)) a(t1, l1), (VALUES (0, k0), (1, k1), (2, k2)) b(t2, l2)) GROUP BY ALL"
)
def leaf_basis_gram(spark, sf):
    """The Gram matrix of the leaf basis: rows that are in two leaves, from each row's own leaves."""
    parts = F.array(*[F.struct(F.lit(k).alias("t"), fo.case_leaf(t, xs()).alias("l")) for k, t in enumerate(FOREST)])
    a = items(spark, sf).select(parts.alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    pairs = a.select(F.explode("p").alias("a"), "p", "n").select("a", F.explode("p").alias("b"), "n")
    return pairs.groupBy(F.col("a.t").alias("t1"), F.col("a.l").alias("l1"), F.col("b.t").alias("t2"), F.col("b.l").alias("l2")).agg(F.sum("n").alias("n"))


def _count_sql(where: str = "") -> str:
    parts = []
    for k, t in enumerate(FOREST):
        for node in sorted(t):
            below = [leaf for leaf in fo.leaves(t) if fo._below(leaf, node)]
            parts.append(f"SELECT {k} AS tree, {node} AS node, count(*) AS n FROM {ITEMS} WHERE {fo.sql_leaf(t, SQL_X)} IN ({', '.join(map(str, below))}){where}")
    return " UNION ALL ".join(parts)


@query(_count_sql())
def node_counts(spark, sf):
    return fo.node_counts(fo.leaf_rows(items(spark, sf), FOREST, xs(), []), 3)


@query(_count_sql())
def node_counts_append(spark, sf):
    """Counts of two parts of the rows, added."""
    all_rows = items(spark, sf)
    parts = [fo.node_counts(fo.leaf_rows(all_rows.where(c), FOREST, xs(), []), 3) for c in ("l_returnflag = 'A'", "l_returnflag <> 'A'")]
    return parts[0].unionByName(parts[1]).groupBy("tree", "node").agg(F.sum("n").alias("n"))


@query(f"SELECT min(n) > 0 AS valid, min(n) AS least FROM (SELECT l, count(*) AS n FROM (SELECT {fo.sql_leaf(TREE, SQL_X)} AS l FROM {ITEMS}) GROUP BY l)")
def split_validity(spark, sf):
    counted = fo.node_counts(fo.leaf_rows(items(spark, sf), [TREE], xs(), []), 3).where(F.col("node").isin(fo.leaves(TREE)))
    return counted.agg((F.min("n") > 0).alias("valid"), F.min("n").alias("least"))


# -- statistics ------------------------------------------------------------------------------------------------------------

SIGMA2, FSIGMA2 = 0.08, st.leaf_prior_sd2(2.0, 3)
_OTHER = fo.sql_forest(FOREST, SQL_X, [1, 2])
_RES = f"(SELECT {fo.sql_leaf(TREE, SQL_X)} AS leaf, (y - lo) / (hi - lo) - 0.5 - {_OTHER} AS e FROM {_MM}) res"


def residuals(spark, sf):
    prep = pp.Preprocessor(["l_tax"], "y", 2).fit(items(spark, sf))
    rows = prep.transform(items(spark, sf), "z")
    return rows.select(fo.case_leaf(TREE, xs()).alias("leaf"), (F.col("z") - fo.case_forest(FOREST, xs(), all_except=[0])).alias("e"))


_STATS = f"(SELECT leaf, count(*) AS n, sum(e) AS r, sum(e * e) AS q FROM {_RES} GROUP BY 1) s"


@query(f"SELECT leaf, n, round(r, 4) + 0.0 AS r, round(q, 4) + 0.0 AS q FROM {_STATS}")
def leaf_resid_sums(spark, sf):
    return st.leaf_stats(residuals(spark, sf), F.col("e")).select("leaf", "n", r("r", 4).alias("r"), r("q", 4).alias("q"))


# a tree for each supplier: the root splits, and its children as the number of the supplier's items and its own are divisible
_NODES = (
    "SELECT 'tree' || s AS tree, ((s // 3) % 2)::INT AS chain, (s // 3)::INT AS draw, node::INT AS node, var::INT AS var, if(var < 0, NULL, (n * 7 + node) % 50)::DOUBLE AS thr, if(var < 0, (n + node) % 10 / CAST(10 AS DOUBLE), NULL) AS leaf "
    "FROM (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1), LATERAL (SELECT * FROM (VALUES (0, s % 4, true), (1, if(n % 2 = 0, n % 3, -1), true), (2, if(s % 3 = 0, 3, -1), true), "
    "(3, -1, n % 2 = 0), (4, -1, n % 2 = 0), (5, -1, s % 3 = 0), (6, -1, s % 3 = 0)) t(node, var, there)) WHERE there"
)
_DEPTH = "(ceil(log2(node + 2)) - 1)"


def nodes(spark, sf):
    """(tree, chain, draw, node, var, thr, leaf)."""
    s, n, node, var = (F.col(c) for c in ("s", "n", "node", "var"))
    by = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"))
    even, third = n % 2 == 0, s % 3 == 0
    kinds = [s % 4, F.when(even, n % 3).otherwise(-1), F.when(third, F.lit(3)).otherwise(-1), *[F.when(even, -1)] * 2, *[F.when(third, -1)] * 2]
    each = by.select("s", "n", F.posexplode(F.array(*[k.cast("int") for k in kinds])).alias("node", "var")).where("var is not null")
    draw = F.floor(s / 3).cast("int")
    thr, leaf = F.when(var >= 0, ((n * 7 + node) % 50).cast("double")), F.when(var < 0, (n + node) % 10 / F.lit(10.0))
    return each.select(F.concat(F.lit("tree"), s).alias("tree"), (draw % 2).alias("chain"), draw.alias("draw"), "node", "var", thr.alias("thr"), leaf.alias("leaf"))


@query(f"SELECT tree, round(sum(CASE WHEN var = -1 THEN ln(1 - exp(ln(0.95) - 2.0 * ln(1 + {_DEPTH}))) ELSE ln(0.95) - 2.0 * ln(1 + {_DEPTH}) END), 6) + 0.0 AS log_prior FROM ({_NODES}) GROUP BY 1")
def tree_log_prior(spark, sf):
    return st.log_prior(nodes(spark, sf)).select("tree", r("log_prior").alias("log_prior"))


@query(f"SELECT tree, round(sum(CASE WHEN var = -1 THEN ln(1 - exp({_DEPTH} * ln(0.45))) ELSE {_DEPTH} * ln(0.45) END), 6) + 0.0 AS log_prior FROM ({_NODES}) GROUP BY 1")
def tree_log_prior_quick_decay(spark, sf):
    return st.log_prior(nodes(spark, sf), 0.45, quick_decay=True).select("tree", r("log_prior").alias("log_prior"))


_LM = f"-0.5 * (sum(ln(n / {SIGMA2 / FSIGMA2!r} + 1)) + (sum(q) - sum(r * r / n) + sum(r * r / n / (n / {SIGMA2 / FSIGMA2!r} + 1))) / {SIGMA2!r})"


@query(f"SELECT round({_LM}, 3) + 0.0 AS log_marginal FROM {_STATS}")
def log_marginal_gaussian(spark, sf):
    return st.log_marginal(st.leaf_stats(residuals(spark, sf), F.col("e")), SIGMA2, FSIGMA2).select(r("log_marginal", 3).alias("log_marginal"))


@query(f"SELECT leaf, round(r / (n + {SIGMA2 / FSIGMA2!r}), 6) + 0.0 AS mean, round({SIGMA2!r} / (n + {SIGMA2 / FSIGMA2!r}), 8) + 0.0 AS var FROM {_STATS}")
def leaf_posterior(spark, sf):
    made = st.leaf_posterior(st.leaf_stats(residuals(spark, sf), F.col("e")), SIGMA2, FSIGMA2)
    return made.select("leaf", r("mean").alias("mean"), r("var", 8).alias("var"))


@query(f"SELECT (3.0 + count(*)) / 2 AS shape, round((0.3 + sum(e * e)) / 2, 4) + 0.0 AS scale FROM {_RES}")
def sigma2_posterior_params(spark, sf):
    return st.sigma2_posterior(residuals(spark, sf), F.col("e"), 3.0, 0.1).select("shape", r("scale", 4).alias("scale"))


_GROWN = fo.split_leaf(TREE, 2, 3, 6.0)


def _marginal_sql(tree) -> str:
    rows = f"(SELECT {fo.sql_leaf(tree, SQL_X)} AS leaf, (y - lo) / (hi - lo) - 0.5 - {_OTHER} AS e FROM {_MM})"
    return f"(SELECT {_LM} FROM (SELECT leaf, count(*) AS n, sum(e) AS r, sum(e * e) AS q FROM {rows} GROUP BY 1))"


def _prior_sql(tree) -> str:
    part = " UNION ALL ".join(f"SELECT {i} AS node, {n.var} AS var" for i, n in sorted(tree.items()))
    return f"(SELECT sum(CASE WHEN var = -1 THEN ln(1 - exp(ln(0.95) - 2.0 * ln(1 + {_DEPTH}))) ELSE ln(0.95) - 2.0 * ln(1 + {_DEPTH}) END) FROM ({part}))"


def _mh(spark, sf, old, new, transition, forth, back):
    prep = pp.Preprocessor(["l_tax"], "y", 2).fit(items(spark, sf))
    rows = prep.transform(items(spark, sf), "z").withColumn("e", F.col("z") - fo.case_forest(FOREST, xs(), all_except=[0]))
    basis = rows.select("e", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), fo.case_leaf(t, xs()).alias("leaf")) for k, t in enumerate((old, new))])).alias("p")).select("e", "p.which", "p.leaf")
    sign = F.when(F.col("which") == 1, 1.0).otherwise(-1.0)
    marginal = st.log_marginal(st.leaf_stats(basis, F.col("e"), ("which", "leaf")), SIGMA2, FSIGMA2, ("which",)).agg(F.sum(sign * F.col("log_marginal")).alias("m"))
    prior = st.log_prior(st.node_table(spark, {"0": old, "1": new})).agg(F.sum(F.when(F.col("tree") == "1", F.col("log_prior")).otherwise(-F.col("log_prior"))).alias("p"))
    both = marginal.join(F.broadcast(prior), F.lit(True))
    return both.select(r(st.log_mh_ratio(F.col("p"), F.col("m"), F.lit(transition), forth, back), 3).alias("log_ratio"))


_FORTH = math.log(3) - math.log(2)  # three leaves before; two terminal splits after
_BACK = math.log(2) - math.log(3)


@query(f"SELECT round({_prior_sql(_GROWN)} - {_prior_sql(TREE)} + {_marginal_sql(_GROWN)} - {_marginal_sql(TREE)} + {_FORTH!r}, 3) + 0.0 AS log_ratio")
def mh_ratio_grow(spark, sf):
    return _mh(spark, sf, TREE, _GROWN, _FORTH, 0.25, 0.25)


@query(f"SELECT round({_prior_sql(TREE)} - {_prior_sql(_GROWN)} + {_marginal_sql(TREE)} - {_marginal_sql(_GROWN)} + {_BACK!r}, 3) + 0.0 AS log_ratio")
def mh_ratio_prune(spark, sf):
    return _mh(spark, sf, _GROWN, TREE, _BACK, 0.25, 0.25)


@query(
    f"WITH n AS ({_NODES}) SELECT tree, sum(CASE WHEN var = -1 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(CASE WHEN var <> -1 THEN 1 ELSE 0 END)::BIGINT AS n_splits, "
    "sum(CASE WHEN (SELECT count(*) FROM n c WHERE c.tree = n.tree AND c.var = -1 AND c.node IN (2 * n.node + 1, 2 * n.node + 2)) = 2 THEN 1 ELSE 0 END)::BIGINT AS n_terminal FROM n GROUP BY 1"
)
def transition_counts(spark, sf):
    return st.terminal_counts(nodes(spark, sf))


@query(f"SELECT round(stddev_pop(y), 3) + 0.0 AS sigma_hat FROM {ITEMS}")
def sigma_hat_naive(spark, sf):
    return st.sigma_hat_naive(items(spark, sf), "y").select(r("sigma_hat", 3).alias("sigma_hat"))


@query(f"SELECT round(sqrt((1 - regr_r2(y, l_quantity)) * var_pop(y)), 2) + 0.0 AS sigma_hat, round(regr_slope(y, l_quantity), 3) + 0.0 AS slope FROM {ITEMS}")
def sigma_hat_linear(spark, sf):
    coef, sd = st.ols(items(spark, sf), [F.col("l_quantity")], F.col("y"))
    return spark.createDataFrame([(round(sd, 2) + 0.0, round(coef[1], 3) + 0.0)], "sigma_hat double, slope double")


# -- classification -----------------------------------------------------------------------------------------------------------

BINARY = "(SELECT l.doc_id, l.quality, least(0.999, greatest(0.001, d.n_chars / (d.n_chars + 800.0))) AS p, ln(d.n_chars + 1.0) - 6.5 AS f FROM labels l JOIN documents d ON l.doc_id = d.doc_id) b"


def binary(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("n_chars") / (F.col("n_chars") + 800.0)))
    return j.select("doc_id", "quality", p.alias("p"), (F.ln(F.col("n_chars") + 1.0) - 6.5).alias("f"))


@query(
    f"SELECT CASE WHEN f <= 0 THEN 1 ELSE 2 END AS leaf, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS r_h, round(sum((doc_id % 7 + 1) / 4.0 * exp(0.1 * f)), 4) + 0.0 AS s_h FROM {BINARY} GROUP BY 1"
)
def logistic_leaf_stats(spark, sf):
    rows = binary(spark, sf).withColumn("leaf", F.when(F.col("f") <= 0, 1).otherwise(2))
    made = st.logistic_leaf_stats(rows, 1, (F.col("doc_id") % 7 + 1) / 4.0, 0.1 * F.col("f"), "quality")
    return made.select("leaf", "r_h", r("s_h", 4).alias("s_h"))


_SCORES = "(SELECT vec_id, c, CAST(embedding[c + 1] AS DOUBLE) * 4 AS f FROM embeddings, (SELECT unnest(range(10)) AS c) k) s"


def scores(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("e"))
    return e.select("vec_id", F.posexplode("e").alias("c", "f")).withColumn("f", F.col("f") * 4)


@query(f"SELECT vec_id, c, round(exp(f) / sum(exp(f)) OVER (PARTITION BY vec_id), 6) + 0.0 AS p FROM {_SCORES}")
def softmax_proba(spark, sf):
    return scores(spark, sf).select("vec_id", F.col("c").cast("long").alias("c"), r(fc.softmax(F.col("f"), "vec_id")).alias("p"))


@query(f"SELECT vec_id, CAST(arg_max(c, f) AS INTEGER) AS predicted FROM {_SCORES} GROUP BY 1")
def class_argmax(spark, sf):
    return po.argmax_class(scores(spark, sf), ["vec_id"], "c", "f")


@query("SELECT doc_id, round(" + fc.NORMAL_CDF_SQL.format(x="f") + f", 6) + 0.0 AS p, CAST(f >= 0 AS INTEGER) AS predicted FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * abs(f) / sqrt(2.0)) AS t FROM {BINARY})")
def probit_proba(spark, sf):
    p = fc.normal_cdf(F.col("f"))
    return binary(spark, sf).select("doc_id", r(p).alias("p"), (p >= 0.5 - 1e-9).cast("int").alias("predicted"))


@query(f"SELECT round(avg(CASE WHEN (p >= 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy, round(-avg(CASE WHEN quality = 1 THEN ln(p) ELSE ln(1 - p) END), 6) + 0.0 AS log_loss FROM {BINARY}")
def classification_metrics(spark, sf):
    return me.classification_metrics(binary(spark, sf), F.col("quality"), F.col("p")).select(r("accuracy").alias("accuracy"), r("log_loss").alias("log_loss"))


@query(
    f"SELECT round((sum(CASE WHEN quality = 1 THEN rk ELSE 0 END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))), 6) + 0.0 AS auc "
    f"FROM (SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM {BINARY})"
)
def auc_rank(spark, sf):
    return me.auc(binary(spark, sf), F.col("quality"), F.col("p")).select(r("auc").alias("auc"))


@query(f"SELECT round(sum(n * gap) / sum(n), 6) + 0.0 AS ece, round(max(gap), 6) + 0.0 AS mce FROM (SELECT least(floor(p * 5), 4) AS b, count(*) AS n, abs(avg(p) - avg(quality)) AS gap FROM {BINARY} GROUP BY 1)")
def calibration_ece_mce(spark, sf):
    return me.calibration(binary(spark, sf), F.col("quality"), F.col("p")).select(r("ece").alias("ece"), r("mce").alias("mce"))


# -- posterior -----------------------------------------------------------------------------------------------------------------

_DRAWS = [fo.sql_forest(f, SQL_X) for f in TRACE]
_LIST = "[" + ", ".join(_DRAWS) + "]"


def drawn(spark, sf):
    return fo.with_draws(with_x(items(spark, sf)), TRACE)


@query(f"SELECT draw, round(avg(f), 6) + 0.0 AS mean, round(min(f), 6) + 0.0 AS low FROM (SELECT unnest({_LIST}) AS f, unnest(range({len(TRACE)})) AS draw FROM {ITEMS}) GROUP BY 1")
def posterior_f(spark, sf):
    long = po.long_draws(drawn(spark, sf), [])
    return long.groupBy(F.col("draw").cast("long").alias("draw")).agg(r(F.avg("f")).alias("mean"), r(F.min("f")).alias("low"))


@query(f"SELECT l_returnflag, round(avg(list_avg({_LIST})), 6) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def posterior_mean(spark, sf):
    return po.posterior_mean(drawn(spark, sf)).groupBy("l_returnflag").agg(r(F.avg("mean")).alias("mean"))


_CHAINED = f"(SELECT l_returnflag, unnest({_LIST}) AS f, unnest([0, 0, 0, 0, 0, 1, 1, 1]) AS chain, unnest([0, 1, 2, 3, 4, 0, 1, 2]) AS draw FROM {ITEMS}) z"


def chained(spark, sf):
    long = po.long_draws(drawn(spark, sf), ["l_returnflag"])
    return long.withColumn("chain", (F.col("draw") >= 5).cast("int")).withColumn("draw", F.col("draw") - 5 * F.col("chain"))


@query(f"SELECT l_returnflag, round(avg(f), 6) + 0.0 AS mean FROM (SELECT l_returnflag, chain, avg(f) AS f FROM {_CHAINED} GROUP BY 1, 2) GROUP BY 1")
def multichain_mean(spark, sf):
    return po.pooled_mean(chained(spark, sf), ["l_returnflag"]).select("l_returnflag", r("mean").alias("mean"))


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(f), 6) + 0.0 AS mean FROM {_CHAINED} WHERE chain * 5 + draw < 7 GROUP BY 1")
def multichain_trim(spark, sf):
    return po.trimmed(chained(spark, sf), 5, 7).groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg("f")).alias("mean"))


_Q = "list_sort(" + _LIST + ")"


@query(f"SELECT l_returnflag, round(avg(list_aggregate({_LIST}, 'quantile_cont', 0.025)), 6) + 0.0 AS lo, round(avg(list_aggregate({_LIST}, 'quantile_cont', 0.975)), 6) + 0.0 AS hi FROM {ITEMS} GROUP BY 1")
def posterior_interval(spark, sf):
    return po.intervals(drawn(spark, sf)).groupBy("l_returnflag").agg(r(F.avg("lo")).alias("lo"), r(F.avg("hi")).alias("hi"))


_Z = "(y - 50000.0) / 100000.0"


@query(
    f"SELECT round(avg(CASE WHEN z >= lo AND z <= hi THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS coverage, round(avg(hi - lo), 6) + 0.0 AS length FROM (SELECT {_Z} AS z, list_aggregate({_LIST}, 'quantile_cont', 0.025) AS lo, list_aggregate({_LIST}, 'quantile_cont', 0.975) AS hi FROM {ITEMS})"
)
def interval_coverage(spark, sf):
    made = po.coverage(po.intervals(drawn(spark, sf)), (F.col("y") - 50000.0) / 100000.0)
    return made.select(r("coverage").alias("coverage"), r("length").alias("length"))


@query(f"SELECT l_returnflag, round(avg({_DRAWS[5]}), 6) + 0.0 AS f FROM {ITEMS} GROUP BY 1")
def predict_trace_k(spark, sf):
    return fo.with_draws(with_x(items(spark, sf)), [TRACE[5]]).groupBy("l_returnflag").agg(r(F.avg(F.get("draws", 0))).alias("f"))


@query(f"SELECT draw, count(DISTINCT tree) AS trees FROM ({_NODES}) WHERE draw > (SELECT max(draw) FROM ({_NODES})) - 5 GROUP BY 1")
def range_post(spark, sf):
    """The trees of the last five draws."""
    trace = nodes(spark, sf)
    return po.last_draws(trace, trace.agg(F.max("draw")).first()[0] + 1, 5).groupBy("draw").agg(F.count_distinct("tree").alias("trees"))


_HIST = f"(SELECT d.draw, v.var, count(n.node) AS n FROM (SELECT DISTINCT draw FROM ({_NODES})) d CROSS JOIN (SELECT unnest(range(4)) AS var) v LEFT JOIN ({_NODES}) n ON n.draw = d.draw AND n.var = v.var GROUP BY 1, 2) h"


def histogram(spark, sf):
    return po.split_histogram(nodes(spark, sf), 4)


@query(f"SELECT CAST(draw AS INTEGER) AS draw, CAST(var AS INTEGER) AS var, n FROM {_HIST}")
def split_histogram(spark, sf):
    return histogram(spark, sf)


@query(f"SELECT CAST(var AS INTEGER) AS var, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS inclusion FROM {_HIST} GROUP BY 1")
def inclusion_probability(spark, sf):
    return po.inclusion_probability(histogram(spark, sf)).select("var", r("inclusion").alias("inclusion"))


@query(f"SELECT CAST(var AS INTEGER) AS var, round(sum(n) / (SELECT sum(n) FROM {_HIST}), 6) + 0.0 AS frequency FROM {_HIST} GROUP BY 1")
def inclusion_frequency_split(spark, sf):
    return po.inclusion_frequency(histogram(spark, sf), "split").select("var", r("frequency").alias("frequency"))


@query(f"SELECT CAST(var AS INTEGER) AS var, round(avg(n / a), 6) + 0.0 AS frequency FROM (SELECT var, n, sum(n) OVER (PARTITION BY draw) AS a FROM {_HIST}) WHERE a > 0 GROUP BY 1")
def inclusion_frequency_per_draw(spark, sf):
    return po.inclusion_frequency(histogram(spark, sf), "per_draw").select("var", r("frequency").alias("frequency"))


@query(f"SELECT CAST(var AS INTEGER) AS var, round(avg(f), 6) + 0.0 AS frequency FROM (SELECT draw % 2 AS chain, var, sum(n) / sum(sum(n)) OVER (PARTITION BY draw % 2) AS f FROM {_HIST} GROUP BY 1, 2) GROUP BY 1")
def inclusion_multichain(spark, sf):
    made = po.chain_frequency(po.split_histogram(nodes(spark, sf), 4, ("chain", "draw")))
    return made.select("var", r("frequency").alias("frequency"))


@query(f"SELECT round(sqrt(avg((p - z) * (p - z))), 6) + 0.0 AS rmse, round(avg(abs(p - z)), 6) + 0.0 AS mae, round(1 - sum((p - z) * (p - z)) / (var_pop(z) * count(*)), 6) + 0.0 AS r2 FROM (SELECT {_Z} AS z, {_DRAWS[0]} AS p FROM {ITEMS})")
def regression_metrics(spark, sf):
    rows = items(spark, sf).select(((F.col("y") - 50000.0) / 100000.0).alias("z"), fo.case_forest(TRACE[0], xs()).alias("p"))
    made = me.regression_metrics(rows, F.col("z"), F.col("p"))
    return made.select(r("rmse").alias("rmse"), r("mae").alias("mae"), r("r2").alias("r2"))


# -- diagnostics ---------------------------------------------------------------------------------------------------------------------

_BY = f"(SELECT chain, avg(value) AS m, var_samp(value) AS v, var_pop(value) AS vp, count(*) AS n FROM {CHAINS} GROUP BY 1) c"


@query(f"SELECT round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) + 0.0 AS psrf FROM {_BY}")
def psrf_classic(spark, sf):
    return dg.psrf(chains(spark, sf)).select(r("psrf").alias("psrf"))


@query(f"SELECT round((var_samp(m) + avg(vp) * avg(n) / (avg(n) - 1)) / avg(vp), 6) + 0.0 AS psrf FROM {_BY}")
def psrf_paper(spark, sf):
    return dg.psrf_population(chains(spark, sf)).select(r("psrf").alias("psrf"))


@query(
    f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY draw) AS i, count(*) OVER (PARTITION BY chain) AS n FROM {CHAINS}), "
    "a AS (SELECT chain, avg(value) AS m, var_samp(value) / count(*) AS s FROM p WHERE i <= floor(n * 0.1) GROUP BY 1), b AS (SELECT chain, avg(value) AS m, var_samp(value) / count(*) AS s FROM p WHERE i > n - floor(n * 0.5) GROUP BY 1) "
    "SELECT a.chain, round((a.m - b.m) / sqrt(a.s + b.s), 6) + 0.0 AS z FROM a JOIN b ON a.chain = b.chain"
)
def geweke(spark, sf):
    return dg.geweke(chains(spark, sf)).select("chain", r("z").alias("z"))


_LAGS = 12
_AC = f"(SELECT chain, lag, corr(value, before) AS rho FROM (" + " UNION ALL ".join(f"SELECT chain, {k} AS lag, value, lag(value, {k}) OVER (PARTITION BY chain ORDER BY draw) AS before FROM {CHAINS}" for k in range(1, _LAGS + 1)) + ") WHERE before IS NOT NULL GROUP BY 1, 2) ac"


@query(f"SELECT chain, lag, round(rho, 6) + 0.0 AS rho FROM {_AC}")
def autocorrelation(spark, sf):
    return dg.autocorrelation(chains(spark, sf), _LAGS).select("chain", "lag", r("rho").alias("rho"))


@query(
    f"SELECT n.chain, round(n.n / (1 + 2 * coalesce(s.s, 0)), 4) + 0.0 AS ess FROM (SELECT chain, count(*) AS n FROM {CHAINS} GROUP BY 1) n LEFT JOIN "
    f"(SELECT chain, sum(rho) AS s FROM (SELECT chain, rho, min(rho) OVER (PARTITION BY chain ORDER BY lag) AS low FROM {_AC}) WHERE low >= 0 GROUP BY 1) s ON n.chain = s.chain"
)
def ess_initial_positive(spark, sf):
    return dg.effective_size(chains(spark, sf), _LAGS).select("chain", r("ess", 4).alias("ess"))


@query(
    f"SELECT coalesce(move, 'overall') AS move, sum(s)::BIGINT AS selected, sum(p)::BIGINT AS proposed, sum(a)::BIGINT AS accepted, round(sum(a) / sum(p), 6) + 0.0 AS acceptance, round(sum(p) / sum(s), 6) + 0.0 AS proposal "
    f"FROM (SELECT event_type AS move, 1 AS s, CAST(value > 5 AS INTEGER) AS p, CAST(value > 20 AS INTEGER) AS a FROM events) GROUP BY ROLLUP (move)"
)
def move_acceptance_rollup(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("move"), F.lit(1).cast("long").alias("selected"), (F.col("value") > 5).cast("long").alias("proposed"), (F.col("value") > 20).cast("long").alias("accepted"))
    made = dg.move_rates(e)
    return made.select("move", "selected", "proposed", "accepted", r("acceptance").alias("acceptance"), r("proposal").alias("proposal"))


# -- scenarios -----------------------------------------------------------------------------------------------------------------------


# The SQL is written out here, apart from the library's expressions, over lists of features.

_UNIT = "(CAST(((((event_id % 1000003) * (7919 + 104 * (2 * j + 1)) + 104729 + 15485 * (j + 1) + 31 * 42) % 999983) * 48271 + 37 * j + 42) % 1000033 AS DOUBLE) + 0.5) / 1000033"
_GAUSS = f"list_transform(range(0, {{p}}), lambda k: sqrt(-2 * ln({_UNIT.replace('j', '(2 * k)')})) * cos(2 * pi() * {_UNIT.replace('j', '(2 * k + 1)')}))"
_SHARED = f"sqrt(-2 * ln({_UNIT.replace('j', '1994')})) * cos(2 * pi() * {_UNIT.replace('j', '1995')})"


def _uniforms(p: int, low: str = "0", width: str = "1") -> str:
    return f"list_transform(range(0, {p}), lambda j: {low} + {width} * ({_UNIT}))"


_DOT = "list_sum(list_transform(range(1, 6), lambda j: x[j] * (1 + ((j - 1) * 37 % 41) / CAST(10.25 AS DOUBLE))))"
_TOTAL = "(x[1] + x[2] + x[3] + x[4] + x[5])"
_NEAR = "CASE WHEN list_sum(list_transform(x, lambda v: power(v - 0.5, 2))) < CAST(0.09 AS DOUBLE) THEN 2 ELSE 8 END"
_RISE = "(4 / ((1 + exp(6 - 12 * x[1])) * (1 + exp(6 - 12 * x[2]))))"
_FRIED = "list_transform(range(0, 4), lambda j: [0, 40 * pi(), 0, 1][j + 1] + [100, 520 * pi(), 1, 10][j + 1] * (" + _UNIT + "))"
_IMPEDANCE = "(x[2] * x[3] - 1 / (x[2] * x[4]))"
_FACTOR = f"list_transform({_GAUSS}, lambda z: sqrt(CAST(0.99 AS DOUBLE)) * z + 0.1 * {_SHARED})"
_KUNZEL = "list_sum(list_transform(range(0, 10), lambda k: x[k + 1] * round(-15 + 30 * CAST(((k + 1) * 7919 * {seed} + 31 * k * k) % 1009 AS DOUBLE) / 1009, 6)))"

#: Features as a list x of the event's id, and the target from it.
SCENARIO_SQL = {
    "linear": (_uniforms(5), _DOT),
    "sparse_linear": (_uniforms(5), "x[2] + x[1]"),
    "piecewise_flat": (_uniforms(5), f"0.5 * (CASE WHEN {_TOTAL} >= 0.7 THEN 1 ELSE 0 END - CASE WHEN {_TOTAL} < 0.3 THEN 1 ELSE 0 END)"),
    "heteroscedastic": (_uniforms(5), _DOT),
    "nonoverlapping": (_uniforms(5), _NEAR),
    "overlapping": (_uniforms(5), _NEAR),
    "spiky": (_uniforms(5), f"CASE WHEN event_id % 10 = floor(10 * ({_UNIT.replace('event_id', '(event_id // 10 * 10)').replace('j', '1999')})) THEN 10 ELSE 0 END"),
    "smooth": (_uniforms(5), f"exp(-20 * power({_DOT} - 2, 2))"),
    "cyclic": (_uniforms(5, "0", "10"), f"sin({_DOT})"),
    "distribution_shift_train": (_uniforms(5, "0", "0.5"), _DOT),
    "distribution_shift_test": (_uniforms(5, "0.5", "0.5"), _DOT),
    "multimodal": (_uniforms(5), _NEAR),
    "imbalanced": (_uniforms(5, "CASE WHEN event_id % 10 = 9 THEN 2 ELSE 0 END"), _DOT),
    "piecewise_linear": (_uniforms(5), f"CASE WHEN {_TOTAL} >= 0.7 THEN 3 - {_TOTAL} WHEN {_TOTAL} >= 0.3 THEN 1 + 3 * {_TOTAL} ELSE 2 * {_TOTAL} END"),
    "tied_x": (f"list_transform({_uniforms(5)}, lambda v: CAST(trunc(v * 50) AS DOUBLE) / 50)", _DOT),
    "tied_y": (_uniforms(5), f"round_even({_DOT}, 1)"),
    "friedman1": (_uniforms(5), "10 * sin(pi() * x[1] * x[2]) + 20 * power(x[3] - 0.5, 2) + 10 * x[4] + 5 * x[5]"),
    "friedman2": (_FRIED, f"sqrt(power(x[1], 2) + power({_IMPEDANCE}, 2))"),
    "friedman3": (_FRIED, f"atan2({_IMPEDANCE}, x[1])"),
    "linear_additive": (_GAUSS.replace("{p}", "10"), "0.2 * x[1] - x[2] + 0.6 * x[3] - 0.9 * x[4] + 0.85 * x[5]"),
    "smooth_additive": (_GAUSS.replace("{p}", "10"), "0.2 * power(x[1], 2) - x[2] + 0.6 * cos(x[3]) - 0.9 * sqrt(abs(x[4])) + 0.85 * sin(x[5])"),
    "dgp_1": (_GAUSS.replace("{p}", "3"), "if(x[1] > 0.1, if(x[2] > 0.7, 12, 9), if(x[3] > -0.2, 3, 6))"),
    "dgp_2": (_GAUSS.replace("{p}", "7"), "if(x[1] > 0.1, if(x[2] > 0.7, if(x[4] > 0.1, 12, 9), if(x[5] > 0.1, 3, 4)), if(x[3] > -0.2, if(x[6] > 0.2, 3, 4), if(x[7] > 0.15, 2, 1)))"),
    "low_lei_candes": (_FACTOR.replace("{p}", "10"), _RISE),
    "high_lei_candes": (_FACTOR.replace("{p}", "100"), _RISE),
    "lss": (_FACTOR.replace("{p}", "10"), "2 * (x[1] < 0 AND x[3] > 0)::INT - 3 * (x[5] > 0 AND x[6] > 1)::INT + 0.8 * (x[3] < 1.5 AND x[5] < 1)::INT"),
    "piecewise_linear_kunzel": (_FACTOR.replace("{p}", "10"), f"if(x[10] > 4, {_KUNZEL.replace('{seed}', '1')}, if(x[10] < -4, {_KUNZEL.replace('{seed}', '2')}, {_KUNZEL.replace('{seed}', '3')}))"),
    "sum": (f"list_transform(list_zip(range(0, 20), {_GAUSS.replace('{p}', '20')}), lambda z: if(z[1] < 10, z[2], sqrt(CAST(0.9999 AS DOUBLE)) * z[2] + 0.01 * ({_GAUSS.replace('{p}', '20').replace('lambda k', 'lambda q').replace('* k', '* q')})[z[1] - 9]))", "list_sum(x)"),
    "tree": (_uniforms(10), "if(x[1] > 0.4, if(x[4] > 0.2, if(x[5] > 0.8, 0.6, 0.4), 0.9), if(x[2] > 0.6, 0.3, if(x[3] > 0.5, 0.7, 0.1)))"),
}


def _scenario(name: str):
    shown = min(3, SCENARIOS[name].features)
    xs_sql, y_sql = SCENARIO_SQL[name]
    cols = ", ".join(f"round(CAST(x[{k + 1}] AS DOUBLE), 5) + 0.0 AS x{k}" for k in range(shown))
    sql = f"SELECT event_id AS row_id, {cols}, round(CAST({y_sql} AS DOUBLE), 4) + 0.0 AS y FROM (SELECT event_id, {xs_sql} AS x FROM events)"

    def run(spark, sf):
        made = signal(table(spark, sf, "events"), name, row="event_id")
        return made.select("row_id", *[r(f"x{k}", 5).alias(f"x{k}") for k in range(shown)], r("y", 4).alias("y"))

    query(sql, f"scenario_{name}")(run)


for _name in SCENARIOS:
    _scenario(_name)


_F1 = f"SELECT {SCENARIO_SQL['friedman1'][1]} AS y FROM (SELECT {SCENARIO_SQL['friedman1'][0]} AS x FROM events)"


def _friedman(spark, sf):
    return signal(table(spark, sf, "events"), "friedman1", row="event_id")


@query(f"SELECT round(var_pop(y), 4) + 0.0 AS variance FROM ({_F1})")
def signal_variance(spark, sf):
    return _friedman(spark, sf).agg(r(F.var_pop("y"), 4).alias("variance"))


@query(f"SELECT round(sqrt(var_pop(y) / 4.0), 5) + 0.0 AS sd FROM ({_F1})")
def snr_noise_sd(spark, sf):
    from thicket.sources.scenarios import noise_sd

    return spark.createDataFrame([(round(noise_sd(_friedman(spark, sf), snr=4.0), 5) + 0.0,)], "sd double")


# -- bandits ---------------------------------------------------------------------------------------------------------------------------

_Z3 = ["x0", "x1", "1.0"]
_B_SQL = ", ".join(f"round(sum({_Z3[i]} * {_Z3[j]}), 4) + 0.0 AS b_{i}_{j}" for i in range(3) for j in range(i, 3))
_M_SQL = ", ".join(f"round(sum({_Z3[i]} * reward), 3) + 0.0 AS m_{i}" for i in range(3))


def statistics(spark, sf):
    rows = log(spark, sf).withColumn("x", F.array("x0", "x1")).withColumnRenamed("arm", "action")
    return sm.linear_statistics(rows, 2)


@query(f"SELECT arm AS action, {_B_SQL}, {_M_SQL} FROM {LOG} GROUP BY 1")
def linear_agent_stats(spark, sf):
    s = statistics(spark, sf)
    return s.select("action", *[r(c, 4 if c.startswith("b") else 3).alias(c) for c in s.columns if c != "action"])


# the closed-form inverse of a symmetric 3 x 3 matrix
_INV = (
    "SELECT action, m_0, m_1, m_2, det, (d * f - e * e) / det AS i00, (c * e - b * f) / det AS i01, (b * e - c * d) / det AS i02, (a * f - c * c) / det AS i11, (b * c - a * e) / det AS i12, (a * d - b * b) / det AS i22 FROM "
    "(SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM (SELECT arm AS action, sum(x0 * x0) + 1 AS a, sum(x0 * x1) AS b, sum(x0) AS c, sum(x1 * x1) + 1 AS d, sum(x1) AS e, count(*) + 1.0 AS f, "
    f"sum(x0 * reward) AS m_0, sum(x1 * reward) AS m_1, sum(reward) AS m_2 FROM {LOG} GROUP BY 1))"
)


@query(
    f"SELECT CAST(action AS INTEGER) AS action, px AS probe, round(px * (i00 * m_0 + i01 * m_1 + i02 * m_2) + 0.5 * (i01 * m_0 + i11 * m_1 + i12 * m_2) + (i02 * m_0 + i12 * m_1 + i22 * m_2) "
    f"+ sqrt(px * px * i00 + 0.25 * i11 + i22 + 2 * (px * 0.5 * i01 + px * i02 + 0.5 * i12)), 4) + 0.0 AS score FROM ({_INV}), (SELECT unnest([0.0, 0.25, 1.0])::DOUBLE AS px) p"
)
def linear_ucb_scores(spark, sf):
    from thicket.streaming.agents import LinearAgent

    agent = LinearAgent.from_sums(sm.gather_statistics(statistics(spark, sf), 2, 5), kind="ucb")
    rows = [(a, px, round(float(v), 4) + 0.0) for px in (0.0, 0.25, 1.0) for a, v in enumerate(agent.scores([px, 0.5]))]
    return spark.createDataFrame(rows, "action int, probe double, score double")


@query(f"SELECT arm, t, round(sum(25.0 - reward) OVER (PARTITION BY arm ORDER BY t ROWS UNBOUNDED PRECEDING), 3) + 0.0 AS cum_regret FROM {LOG}")
def cumulative_regret(spark, sf):
    rows = log(spark, sf).withColumn("best_mean", F.lit(25.0)).withColumnRenamed("reward", "chosen_mean")
    return an.cumulative_regret(rows, keys=("arm",), order="t").select("arm", "t", r("cum_regret", 3).alias("cum_regret"))


_T = "(SELECT event_id + 2 AS t FROM events) ts"


def steps(spark, sf):
    """The steps of a log: one for each event, from 2."""
    return table(spark, sf, "events").select((F.col("event_id") + 2).alias("t"))



@query(f"SELECT t, {', '.join(f'CAST({fc.REFRESH_SQL[s].format(t='t')} AS BIGINT) AS {s}' for s in fc.SCHEDULES)}, " + " AND ".join([f"CAST({fc.REFRESH_SQL['log'].format(t='t')} AS BIGINT) > CAST({fc.REFRESH_SQL['log'].format(t='(t - 1)')} AS BIGINT)"]) + f" AS due FROM {_T}")
def refresh_schedule(spark, sf):
    at = fc.refresh_index
    return steps(spark, sf).select("t", *[at(F.col("t"), s).alias(s) for s in fc.SCHEDULES], (at(F.col("t"), "log") > at(F.col("t") - 1, "log")).alias("due"))


@query(f"SELECT t, floor(power(ceil(0.57 * sqrt(t)) / CAST(0.57 AS DOUBLE), 2))::BIGINT + 1 - t AS steps FROM {_T}")
def steps_to_refresh(spark, sf):
    from thicket.streaming.agents import steps_to_refresh as wait

    @F.pandas_udf("long")
    def left(t: pd.Series) -> pd.Series:
        return t.map(lambda k: wait(int(k), "sqrt"))

    return steps(spark, sf).select("t", left("t").alias("steps"))


@query(f"SELECT t, CAST(least(2000, greatest(100, ceil(0.2 * t))) AS INTEGER) AS bins, CAST(greatest(100, least(500, t * 3)) AS INTEGER) AS draws FROM {_T}")
def adaptive_max_bins(spark, sf):
    return steps(spark, sf).select("t", fc.max_bins(F.col("t")).alias("bins"), fc.draws_needed(F.col("t"), F.lit(2), 500).alias("draws"))


@query(f"SELECT min(n) >= 5 AS enough, min(n) AS least FROM (SELECT a, count(arm) AS n FROM (SELECT unnest(range(6)) AS a) arms LEFT JOIN {LOG} ON arm = a GROUP BY 1)")
def data_sufficiency(spark, sf):
    return an.sufficient(log(spark, sf), 6)


_FG = f"(SELECT draw, sum(least(0.5, mx)) AS s FROM (SELECT t, draw, max(x0 * (draw + 1) / 4.0 - x1 * a / 5.0 + 0.01 * draw * a) AS mx FROM {LOG}, (SELECT unnest(range(6)) AS draw) d, (SELECT unnest(range(5)) AS a) arms GROUP BY 1, 2) GROUP BY 1) fg"


def feel_good(spark, sf):
    """S of each draw; the best arm and the draws stay inside the row, so that only sums are shuffled."""
    f = lambda d, a: F.col("x0") * (d + 1) / 4.0 - F.col("x1") * a / 5.0 + 0.01 * d * a
    return an.feel_good(log(spark, sf), [[f(d, a) for a in range(5)] for d in range(6)])


@query(f"SELECT CAST(draw AS INTEGER) AS draw, round(s, 3) + 0.0 AS s FROM {_FG}")
def feel_good_score(spark, sf):
    return feel_good(spark, sf).select("draw", r("s", 3).alias("s"))


_FGP = f"(SELECT draw, exp(0.01 * s - max(0.01 * s) OVER ()) / sum(exp(0.01 * s - m)) OVER () AS p FROM (SELECT draw, s, max(0.01 * s) OVER () AS m FROM {_FG})) p"


@query(f"SELECT CAST(draw AS INTEGER) AS draw, round(p, 6) + 0.0 AS p FROM {_FGP}")
def feel_good_softmax(spark, sf):
    s = feel_good(spark, sf).withColumn("one", F.lit(1))
    return s.select("draw", r(fc.softmax(0.01 * F.col("s"), "one")).alias("p"))


@query(f"SELECT round(1 / sum(p * p), 5) + 0.0 AS ess FROM {_FGP}")
def feel_good_ess(spark, sf):
    s = feel_good(spark, sf).withColumn("one", F.lit(1)).withColumn("p", fc.softmax(0.01 * F.col("s"), "one"))
    return s.agg(r(1 / F.sum(F.col("p") * F.col("p")), 5).alias("ess"))


@query(f"SELECT arm, count(*) AS n, sum(CASE WHEN arm = t % 5 THEN 1 ELSE 0 END)::BIGINT AS matched, round(avg(CASE WHEN arm = t % 5 THEN reward END), 4) + 0.0 AS value FROM {LOG} GROUP BY 1")
def replay_match(spark, sf):
    hit = F.col("arm") == F.col("t") % 5
    return log(spark, sf).groupBy("arm").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("matched"), r(F.avg(F.when(hit, F.col("reward"))), 4).alias("value"))


@query(f"SELECT h AS hour, arm, round(count(*) / 10.0, 6) + 0.0 AS share FROM (SELECT hour(ts) AS h, arm FROM {LOG}) GROUP BY 1, 2")
def logged_frequency(spark, sf):
    rows = log(spark, sf).withColumn("hour", F.hour("ts").cast("long"))
    return an.arm_share(rows, "hour", "arm", 10).select("hour", "arm", r("share").alias("share"))


@query(f"SELECT arm, round(avg(reward), 4) + 0.0 AS mean, round(stddev_samp(reward), 4) + 0.0 AS sd, round(quantile_cont(reward, 0.025), 4) + 0.0 AS lo, round(quantile_cont(reward, 0.975), 4) + 0.0 AS hi FROM {LOG} GROUP BY 1")
def ope_summary(spark, sf):
    made = an.bootstrap_summary(log(spark, sf), "reward", ["arm"])
    return made.select("arm", *[r(c, 4).alias(c) for c in ("mean", "sd", "lo", "hi")])


@query(f"SELECT arm, round(count(*) / (SELECT count(*) FROM events), 6) + 0.0 AS share FROM {LOG} GROUP BY 1")
def policy_arm_share(spark, sf):
    one = log(spark, sf).agg(F.count("*").alias("all"))
    return log(spark, sf).groupBy("arm").agg(F.count("*").alias("n")).join(F.broadcast(one), F.lit(True)).select("arm", r(F.col("n") / F.col("all")).alias("share"))


@query(f"SELECT t, arm - CASE WHEN (SELECT min(arm) FROM {LOG} WHERE arm > 0) = 1 THEN 1 ELSE 0 END AS action FROM {LOG} WHERE arm > 0")
def rebase_actions(spark, sf):
    return sm.rebased(log(spark, sf).where("arm > 0").withColumnRenamed("arm", "action")).select("t", "action")


# -- analytics -------------------------------------------------------------------------------------------------------------------------

FINAL = "(SELECT 'S' || (user_id % 3) AS scenario, event_type AS agent, value AS regret FROM events) fin"


def final(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("scenario"), F.col("event_type").alias("agent"), F.col("value").alias("regret"))


@query(f"SELECT agent, {', '.join(f'''round(avg(CASE WHEN scenario = 'S{k}' THEN regret END), 4) + 0.0 AS S{k}''' for k in range(3))} FROM {FINAL} GROUP BY 1")
def regret_summary_pivot(spark, sf):
    made = an.final_pivot(final(spark, sf), "regret", "agent", "scenario", ["S0", "S1", "S2"])
    return made.select("agent", *[r(f"S{k}", 4).alias(f"S{k}") for k in range(3)])


@query(f"SELECT scenario, agent, round(avg(regret), 4) + 0.0 AS mean, round(stddev_pop(regret), 4) + 0.0 AS sd FROM {FINAL} GROUP BY 1, 2")
def regret_mean_sd(spark, sf):
    return an.final_summary(final(spark, sf), "regret", ["scenario", "agent"]).select("scenario", "agent", r("mean", 4).alias("mean"), r("sd", 4).alias("sd"))


_REL = f"(SELECT m.scenario, m.agent, m.m / b.m AS rel FROM (SELECT scenario, agent, avg(regret) AS m FROM {FINAL} GROUP BY 1, 2) m JOIN (SELECT scenario, avg(regret) AS m FROM {FINAL} WHERE agent = 'click' GROUP BY 1) b ON m.scenario = b.scenario) rel"


@query(f"SELECT agent, round(count(*) / sum(1 / rel), 6) + 0.0 AS hmean, round(stddev_samp(rel), 6) + 0.0 AS sd, count(*) AS n, round(stddev_samp(rel) / sqrt(count(*)), 6) + 0.0 AS se FROM {_REL} GROUP BY 1")
def relative_performance_hmean(spark, sf):
    made = an.relative_performance(final(spark, sf), "click")
    return made.select("agent", r("hmean").alias("hmean"), r("sd").alias("sd"), "n", r("se").alias("se"))


@query(f"SELECT scenario, agent, round(avg(regret), 4) + 0.0 AS mean FROM (SELECT * FROM {FINAL} UNION ALL SELECT 'Average', f.agent, f.regret / b.m FROM {FINAL.replace(' fin', ' f')} JOIN (SELECT scenario, avg(regret) AS m FROM {FINAL} WHERE agent = 'click' GROUP BY 1) b ON f.scenario = b.scenario) GROUP BY 1, 2")
def average_scenario(spark, sf):
    return an.with_average(final(spark, sf), "click").groupBy("scenario", "agent").agg(r(F.avg("regret"), 4).alias("mean"))


@query(f"SELECT scenario, agent, CAST(place AS INTEGER) AS place FROM (SELECT scenario, agent, row_number() OVER (PARTITION BY scenario ORDER BY avg(regret), agent) AS place FROM {FINAL} GROUP BY 1, 2) WHERE place <= 2")
def topn_agents(spark, sf):
    mean = an.final_summary(final(spark, sf), "regret", ["scenario", "agent"])
    return an.top_agents(mean, 2).select("scenario", "agent", "place")


_MOM = f"(SELECT scenario, agent, avg(regret) AS m, var_samp(regret) AS v, count(*) AS n FROM {FINAL} GROUP BY 1, 2)"


@query(f"SELECT a.scenario, a.agent AS a1, b.agent AS a2, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) + 0.0 AS t FROM {_MOM} a JOIN {_MOM} b ON a.scenario = b.scenario AND a.agent < b.agent")
def pairwise_self_join(spark, sf):
    p = an.pairs_of_agents(final(spark, sf))
    return p.select("scenario", "a1", "a2", r((F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")), 5).alias("t"))


@query()
def win_tie_lose(spark, sf):
    return an.win_tie_lose(final(spark, sf)).select("scenario", "a1", "a2", r("p").alias("p"), "outcome")


_CURVE = f"(SELECT arm, t + 1 AS t, sum(reward + 1) OVER (PARTITION BY arm ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM {LOG}) cu"


@query(
    f"WITH c AS (SELECT * FROM {_CURVE}), f AS (SELECT arm, regr_slope(ln(v), ln(t)) AS b, regr_intercept(ln(v), ln(t)) AS la, regr_slope(v, ln(t)) AS k, regr_intercept(v, ln(t)) AS i FROM c GROUP BY 1), "
    "s AS (SELECT c.arm, any_value(b) AS b, any_value(k) AS k, count(*) AS n, sum(pow(v - exp(la + b * ln(t)), 2)) AS rp, sum(pow(v - i - k * ln(t), 2)) AS rl FROM c JOIN f ON c.arm = f.arm GROUP BY 1) "
    "SELECT arm, round(b, 5) + 0.0 AS power, round(k, 2) + 0.0 AS slope, round(n * ln(rp / n) + 4, 3) + 0.0 AS aic_power, round(n * ln(rl / n) + 4, 3) + 0.0 AS aic_log, CASE WHEN n * ln(rp / n) < n * ln(rl / n) THEN 'power' ELSE 'log' END AS best FROM s"
)
def growth_fit_aic(spark, sf):
    rows = an.running(log(spark, sf).withColumn("v1", F.col("reward") + 1), "v1", ["arm"], "t", "v").withColumn("t", F.col("t") + 1)
    made = an.growth_fits(rows.select("arm", "t", "v"), "t", "v", ["arm"])
    return made.select("arm", r("power", 5).alias("power"), r("slope", 2).alias("slope"), r("aic_power", 3).alias("aic_power"), r("aic_log", 3).alias("aic_log"), "best")


@query(f"SELECT arm, t, round(avg(reward) OVER (PARTITION BY arm ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) + 0.0 AS smooth FROM {LOG}")
def moving_average(spark, sf):
    return an.moving_average(log(spark, sf), ["arm"], "t", "reward", 7).select("arm", "t", r("smooth", 5).alias("smooth"))


@query(f"SELECT chain, round(avg(CASE WHEN arm = 2 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share, coalesce(sum(CASE WHEN arm <> before THEN 1 ELSE 0 END), 0)::BIGINT AS changes FROM (SELECT user_id % 4 AS chain, arm, lag(arm) OVER (PARTITION BY user_id % 4 ORDER BY t) AS before FROM {LOG}) GROUP BY 1")
def first_split_changes(spark, sf):
    rows = log(spark, sf).select((F.col("user_id") % 4).alias("chain"), F.col("t").alias("draw"), F.col("arm").alias("var"))
    return an.first_split(rows, 2).select("chain", r("share").alias("share"), F.col("changes").cast("long").alias("changes"))


@query(f"SELECT t FROM {LOG} WHERE t = 10 OR t = 9999 OR (t > 10 AND CAST(floor(sqrt(t)) AS BIGINT) * CAST(floor(sqrt(t)) AS BIGINT) = t)")
def checkpoint_steps(spark, sf):
    return log(spark, sf).where(an.logged_step(F.col("t"), 9999)).select("t")


@query(
    "WITH a AS (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders) SELECT * FROM (SELECT 'priority' AS factor, o_orderpriority AS level, round(avg(o_totalprice), 2) + 0.0 AS mean FROM orders JOIN (SELECT s FROM a GROUP BY 1 HAVING count(*) > 1) g ON o_orderstatus = g.s GROUP BY 2 "
    "UNION ALL SELECT 'status', o_orderstatus, round(avg(o_totalprice), 2) + 0.0 FROM orders JOIN (SELECT p FROM a GROUP BY 1 HAVING count(*) > 1) g ON o_orderpriority = g.p GROUP BY 2)"
)
def factor_contrast(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return an.factor_means(o, ["priority", "status"], "o_totalprice").select("factor", "level", r("mean", 2).alias("mean"))


@query("SELECT DISTINCT agent, regexp_extract(agent, '_m=?([^_]+)', 1) AS m, regexp_extract(agent, '_enc=?([^_]+)', 1) AS enc FROM (SELECT 'Trees_m=' || (user_id % 3 * 50) || '_enc=' || event_type AS agent FROM events)")
def agent_factors(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("Trees_m="), (F.col("user_id") % 3 * 50).cast("string"), F.lit("_enc="), F.col("event_type")).alias("agent")).distinct()
    return an.parse_factors(e, "agent", ["m", "enc"])


@query("SELECT c.c_custkey, coalesce(v.views, 0) AS views FROM customer c LEFT JOIN (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND hour(ts) = 20 GROUP BY 1) v ON c.c_custkey = v.user_id")
def hourly_views_left_join(spark, sf):
    views = table(spark, sf, "events").where((F.col("event_type") == "view") & (F.hour("ts") == 20))
    return an.hits_by_key(table(spark, sf, "customer").select("c_custkey"), views, "c_custkey", "user_id", "views")


@query("SELECT c_custkey, c_nationkey, s_nationkey AS c_nationkey_b FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def attribute_mismatch(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return an.mismatches(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), s, "c_custkey", ["c_nationkey"]).select("c_custkey", "c_nationkey", "c_nationkey_b")


@query("SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey AND o.o_orderkey % 25 = n.n_nationkey WHERE o.o_totalprice > c.c_acctbal")
def consistent_join(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    both = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, (c["c_nationkey"] == n["n_nationkey"]) & (o["o_orderkey"] % 25 == n["n_nationkey"]))
    return both.where("o_totalprice > c_acctbal").select("o_orderkey", "c_mktsegment")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority, month(o_orderdate) AS month FROM orders")
def dedup_contexts(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.month("o_orderdate").cast("long").alias("month")).dropDuplicates()


@query(f"SELECT h AS ctx, a AS arm, round(coalesce(p, 0.5), 6) + 0.0 AS p FROM (SELECT DISTINCT user_id % 40 AS h FROM events) c, (SELECT unnest(range(6)) AS a) arms LEFT JOIN (SELECT user_id % 40 AS hh, arm, avg(CASE WHEN reward > 20 THEN 1.0 ELSE 0.0 END) AS p FROM {LOG} GROUP BY 1, 2) s ON s.hh = c.h AND s.arm = arms.a")
def empirical_arm_outcome(spark, sf):
    arms = spark.range(6).select(F.col("id").cast("int").alias("arm"))
    made = an.empirical_outcome(log(spark, sf).withColumn("ctx", F.col("user_id") % 40), ["ctx"], "arm", F.col("reward") > 20, arms)
    return made.select("ctx", F.col("arm").cast("long").alias("arm"), r("p").alias("p"))


@query("SELECT m, k FROM (SELECT unnest(range(1, 60)) AS m), (SELECT unnest(range(1, 6)) AS k) EXCEPT SELECT DISTINCT p_size, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) FROM part")
def tuning_antijoin(spark, sf):
    grid = spark.range(1, 60).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("k"))
    done = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("m"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("k"))
    return an.not_yet_run(grid, done, ["m", "k"])


# -- sampling ----------------------------------------------------------------------------------------------------------------------------

_U0, _U1, _U4 = (sa.uniform_sql("event_id", k, 5) for k in (0, 1, 4))


@query(f"SELECT CAST(least(floor(({_U0}) * 5), 4) AS INTEGER) AS fold, count(*) AS n, round(avg(value), 4) + 0.0 AS mean FROM events GROUP BY 1")
def kfold(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(sa.fold(F.col("event_id"), 5, 5).alias("fold")).agg(F.count("*").alias("n"), r(F.avg("value"), 4).alias("mean"))


@query(f"SELECT count(*) FILTER (WHERE {_U1} >= 0.25) AS train, count(*) FILTER (WHERE {_U1} < 0.25) AS test FROM events")
def train_test_split(spark, sf):
    train, test = sa.split(table(spark, sf, "events"), "event_id", 0.25, 5)
    return train.agg(F.count("*").alias("train")).join(F.broadcast(test.agg(F.count("*").alias("test"))), F.lit(True))


@query(f"SELECT k, CAST(row_number() OVER (ORDER BY {sa.uniform_sql('k', 2, 9)}, k) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT draw::BIGINT AS k FROM ({_NODES}))")
def posterior_queue(spark, sf):
    """The order in which the draws of the suppliers' trees are used up."""
    return sa.permutation(nodes(spark, sf).select(F.col("draw").cast("long").alias("k")).distinct(), [], "k", 9)


_W = "[1.0, 0.5, 2.0, 0.25, 3.25]"


@query(f"SELECT event_id, CAST(least(4, (({_U4}) * 7.0 > 1.0)::INT + (({_U4}) * 7.0 > 1.5)::INT + (({_U4}) * 7.0 > 3.5)::INT + (({_U4}) * 7.0 > 3.75)::INT) AS INTEGER) AS pick FROM events")
def weighted_choice(spark, sf):
    w = F.array(*[F.lit(v) for v in (1.0, 0.5, 2.0, 0.25, 3.25)])
    return table(spark, sf, "events").select("event_id", sa.choose_weighted(w, sa.uniform(F.col("event_id"), 4, 5)).cast("int").alias("pick"))


@query(f"SELECT event_id, CAST(({_U4}) * (1 + exp(1.0) + exp(-1.0)) > 1 AS INTEGER) + CAST(({_U4}) * (1 + exp(1.0) + exp(-1.0)) > 1 + exp(1.0) AS INTEGER) AS pick FROM events")
def softmax_choice(spark, sf):
    scores_ = F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0))
    return table(spark, sf, "events").select("event_id", sa.choose_softmax(scores_, sa.uniform(F.col("event_id"), 4, 5)).cast("int").alias("pick"))


@query(f"SELECT event_id, event_type, CAST(least(floor(({_U0}) * 3), 2) AS INTEGER) AS pick FROM events")
def uniform_choice(spark, sf):
    pick = sa.choose(F.array(F.lit(0), F.lit(1), F.lit(2)), sa.uniform(F.col("event_id"), 0, 5))
    return table(spark, sf, "events").select("event_id", "event_type", pick.cast("int").alias("pick"))


@query()
def bootstrap_means(spark, sf):
    b = sa.bootstrap(table(spark, sf, "events").select("event_id", "value"), "event_id", 20, 5)
    by = b.groupBy("round").agg((F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("mean"))
    return an.bootstrap_summary(by.withColumn("all", F.lit(1)), "mean", ["all"]).select(r("mean", 4).alias("mean"), r("sd", 4).alias("sd"), r("lo", 4).alias("lo"), r("hi", 4).alias("hi"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 3 AS VARCHAR) AS due, hour(o_orderdate + INTERVAL 20 HOUR) AS hour, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS VARCHAR) AS parsed FROM orders")
def datetime_parts(spark, sf):
    text = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")
    stamp = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", fc.days_after(stamp, 3).cast("string").alias("due"), fc.local_hour(stamp, "UTC", 20).cast("long").alias("hour"), fc.parsed_time(text).cast("string").alias("parsed"))


@query(f"SELECT draw, round(sqrt(avg((f - z) * (f - z))), 6) + 0.0 AS rmse FROM (SELECT unnest({_LIST}) AS f, unnest(range({len(TRACE)})) AS draw, {_Z} AS z FROM {ITEMS}) GROUP BY 1")
def rmse_by_draw(spark, sf):
    long = po.long_draws(drawn(spark, sf).withColumn("z", (F.col("y") - 50000.0) / 100000.0), ["z"])
    made = me.regression_metrics(long, F.col("z"), F.col("f"), ("draw",))
    return made.select(F.col("draw").cast("long").alias("draw"), r("rmse").alias("rmse"))


# -- models (random draws: no SQL) -------------------------------------------------------------------------------------------------------

def _fit(spark, sf, rows=None, **options):
    """Friedman's function of the features of all events, or of `rows` of them."""
    from thicket.plans.model import fit

    rows = _friedman(spark, sf) if rows is None else rows
    return fit(rows, [f"x{k}" for k in range(5)], "y", seed=1, max_bins=20, **({"n_trees": 20, "ndpost": 50, "nskip": 50} | options))


@query()
def trees_posterior_mean(spark, sf):
    """Posterior mean, 95 % interval and coverage of a fitted model over all rows, by group."""
    model = _fit(spark, sf)
    made = po.intervals(po.posterior_mean(model.posterior_f(_friedman(spark, sf))))
    grouped = made.withColumn("part", F.col("row_id") % 3)
    inside = ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double")
    return grouped.groupBy("part").agg(F.count("*").alias("n"), r(F.avg("mean"), 4).alias("mean"), r(F.avg(F.col("hi") - F.col("lo")), 4).alias("length"), r(F.avg(inside), 4).alias("coverage"), r(F.sqrt(F.avg((F.col("mean") - F.col("y")) ** 2)), 4).alias("rmse"))


@query()
def mcmc_fit_regression(spark, sf):
    model = _fit(spark, sf, chains=2)
    return model.trace.where("draw >= 0").groupBy("chain").agg(F.count("*").alias("draws"), r(F.avg("sigma2"), 6).alias("sigma2"))


def _class_rows(spark, sf):
    return _friedman(spark, sf).withColumn("label", F.when(F.col("y") > 14, "high").otherwise("low"))


@query()
def mcmc_fit_probit(spark, sf):
    from thicket.plans.model import fit

    model = fit(_class_rows(spark, sf), [f"x{k}" for k in range(5)], "label", "probit", seed=1, max_bins=20, n_trees=20, ndpost=40, nskip=40)
    made = model.predict(_class_rows(spark, sf))
    return made.groupBy("label", "prediction_label").agg(F.count("*").alias("n"))


@query()
def mcmc_fit_logistic(spark, sf):
    from thicket.plans.model import fit

    rows = _friedman(spark, sf).withColumn("label", F.when(F.col("y") > 17, "high").when(F.col("y") > 12, "mid").otherwise("low"))
    model = fit(rows, [f"x{k}" for k in range(5)], "label", "logistic", seed=1, max_bins=10, n_trees=5, ndpost=20, nskip=30)
    made = model.predict_proba(_friedman(spark, sf))
    return made.agg(F.count("*").alias("n"), *[r(F.avg(F.get("proba", k)), 4).alias(f"p{k}") for k in range(3)])


@query()
def posterior_predict(spark, sf):
    model = _fit(spark, sf)
    made = model.posterior_predict(_friedman(spark, sf), "row_id", 3)
    return made.agg(F.count("*").alias("n"), r(F.avg(po.array_mean(F.col("predicted"))), 4).alias("mean"))


@query()
def multichain_fit(spark, sf):
    model = _fit(spark, sf, chains=4, ndpost=60)
    return model.inclusion_frequency().select("var", r("frequency").alias("frequency"))


@query()
def rank_rhat_ess(spark, sf):
    model = _fit(spark, sf, chains=4, ndpost=120)
    return model.diagnostics(_friedman(spark, sf), "row_id")


@query()
def update_fit(spark, sf):
    """The model of four fifths of the rows goes on over the fifth that is appended."""
    rows = _friedman(spark, sf)
    model = _fit(spark, sf, rows.where("row_id % 5 <> 0"))
    return model.update(rows.where("row_id % 5 = 0"), 20).trace.groupBy("draw").agg(F.count("*").alias("states"))


@query()
def prior_predictive(spark, sf):
    from thicket.sources.prior import prior_predictive as draw

    return draw(spark, table(spark, sf, "events").count(), 3, n_trees=20, latent=True).select("row_id", *[r(f"x{k}").alias(f"x{k}") for k in range(3)], r("f").alias("f"), r("y").alias("y"))


@query()
def bandit_simulate(spark, sf):
    agents = {"random": {"agent": "random"}, "ucb": {"agent": "linear", "kind": "ucb"}, "ts": {"agent": "linear", "kind": "ts", "v": 0.3}}
    made = sm.compare(spark, {"linear": {"kind": "linear", "features": 4, "arms": 3}, "step": {"kind": "step", "features": 3, "arms": 3}}, agents, 3, 100)
    return an.running(made, "regret", ["scenario", "sim", "agent"], "draw", "cum_regret").where("draw = 100").select("scenario", "sim", "agent", r("cum_regret").alias("cum_regret"))


@query()
def linear_ts_draws(spark, sf):
    import numpy as np

    from thicket.streaming.agents import LinearAgent

    agent = LinearAgent.from_sums(sm.gather_statistics(statistics(spark, sf), 2, 5), kind="ts", seed=3)
    d = agent.draws(np.array([[0.0, 0.5], [1.0, 0.5]]), 200)
    return spark.createDataFrame([(p, a, float(d[:, p, a].mean()), float(d[:, p, a].std())) for p in range(2) for a in range(5)], "probe int, arm int, mean double, sd double")


@query()
def replay_agents(spark, sf):
    rows = log(spark, sf).select("t", F.array("x0", "x1").alias("x"), F.col("arm").alias("action"), "reward")
    specs = {"ucb": {"agent": "linear", "arms": 5, "features": 2, "kind": "ucb"}, "random": {"agent": "random", "arms": 5, "features": 2}}
    return sm.replay(rows, specs).groupBy("agent").agg(F.count("*").alias("events"), F.sum("matched").alias("matched"))
