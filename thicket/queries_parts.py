"""More registered queries: sources and sinks, special functions, edits of trees, literal models and their files, chains,
agents and experiments.  What is random appears by facts that hold for every draw; the SQL states them apart from the
library's expressions."""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from thicket.functions import columns as fc
from thicket.functions import special as sp
from thicket.operators import analytics as an
from thicket.operators import diagnostics as dg
from thicket.operators import forest as fo
from thicket.operators import gram as gr
from thicket.operators import long_traces as lt
from thicket.operators import posterior as po
from thicket.operators import preprocess as pp
from thicket.operators import sampling as sa
from thicket.plans.chain import CONTRARY, LogisticChain, Proposer, RegressionChain, Settings, logistic_shape
from thicket.plans.chain import Tree as ChainTree
from thicket.queries import _NODES, CHAINS, FEATURES, FOREST, ITEMS, LOG, TRACE, TREE, _fit, _friedman, chains, final, items, log, nodes, query, r, table, with_x, xs
from thicket.sources import files as fi
from thicket.sources.prior import heatmap
from thicket.sources.scenarios import SCENARIOS, generate, grid
from thicket.streaming import agents as ag
from thicket.streaming import simulate as sm


def values(rows: list[tuple], names: str) -> str:
    """SQL of literal rows."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, row)) + ')' for row in rows)}) t({names})"


def place(spark) -> str:
    """A folder of its own beside the stored tables."""
    root = fi.stored(spark.range(1), "place").inputFiles()[0].rsplit("/", 2)[0]
    return f"{root}/query-{uuid.uuid4().hex}"


# -- sources and sinks -------------------------------------------------------------------------------------------------

_COUNTS = {"friedman2": 4, "friedman3": 4, "linear_additive": 10, "smooth_additive": 10, "dgp_1": 3, "dgp_2": 7, "low_lei_candes": 10, "high_lei_candes": 100, "lss": 10, "piecewise_linear_kunzel": 10, "sum": 20, "tree": 10}


@query(f"SELECT name, features, (SELECT count(*) FROM events)::INT AS n FROM ({values([(n, _COUNTS.get(n, 5)) for n in sorted(SCENARIOS)], 'name, features')})")
def scenario_shapes(spark, sf):
    """Each scenario with a row for each event."""
    n = table(spark, sf, "events").count()
    made = {name: generate(spark, name, n, noise=0.1) for name in sorted(SCENARIOS)}
    return spark.createDataFrame([(name, len(df.columns) - 2, df.count()) for name, df in made.items()], "name string, features int, n int")


# a mesh of as many points as there are events, or some fewer
_MESH = "(SELECT i, b FROM (SELECT floor(sqrt(count(*)))::BIGINT AS b FROM events), LATERAL (SELECT unnest(range(b * b)) AS i))"


def _bins(spark, sf) -> int:
    return math.isqrt(table(spark, sf, "events").count())


@query(f"SELECT i AS row_id, round((i % b) / (b - 1)::DOUBLE, 6) + 0.0 AS x0, round((i // b) / (b - 1)::DOUBLE, 6) + 0.0 AS x1 FROM {_MESH}")
def grid_points(spark, sf):
    bins = _bins(spark, sf)
    return grid(spark, bins * bins, 2, bins).select("row_id", r("x0").alias("x0"), r("x1").alias("x1"))


_PLANE = [{0: fo.split(0, 0.5), 1: fo.leaf(0.25), 2: fo.split(1, 0.2), 5: fo.leaf(-1.0), 6: fo.leaf(0.75)}, {0: fo.split(1, 0.9), 1: fo.leaf(0.125), 2: fo.leaf(2.0)}]


_PX, _PY = "(i % b) / (b - 1)::DOUBLE", "(i // b) / (b - 1)::DOUBLE"


@query(f"SELECT i AS row_id, if({_PX} <= 0.5, 0.25, if({_PY} <= 0.2, -1.0, 0.75))::DOUBLE + if({_PY} <= 0.9, 0.125, 2.0)::DOUBLE AS f FROM {_MESH}")
def forest_heatmap(spark, sf):
    return heatmap(spark, _PLANE, _bins(spark, sf)).select("row_id", "f")


@query("SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) + 0.0 AS total FROM embeddings")
def array_codec(spark, sf):
    @F.pandas_udf("array<float>")
    def back(v: pd.Series) -> pd.Series:
        return pd.Series([fi.array_from_json(fi.array_to_json(np.asarray(a, dtype=np.float32))) for a in v])

    e = table(spark, sf, "embeddings").select("vec_id", back("embedding").alias("e"))
    d = F.col("e").cast("array<double>")
    return e.select("vec_id", F.size("e").cast("long").alias("n"), r(F.get(d, 0)).alias("first"), r(F.aggregate(d, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_ONE = "if(l_quantity <= 25, if(l_discount <= 0.05, -0.2, 0.1), 0.3)::DOUBLE"
_SUM3 = f"({_ONE} + if(l_tax <= 0.04, -0.15, 0.05)::DOUBLE + if(month <= 6, 0.02, if(l_quantity <= 40, -0.04, 0.08))::DOUBLE)"


@query(f"SELECT l_returnflag, round(sum({_SUM3}), 4) + 0.0 AS total FROM {ITEMS} GROUP BY 1")
def forest_json(spark, sf):
    back = fo.from_json(fo.to_json(FOREST))
    return items(spark, sf).groupBy("l_returnflag").agg(r(F.sum(fo.case_forest(back, xs())), 4).alias("total"))


@query("SELECT event_id, true AS same FROM events")
def generator_codec(spark, sf):
    """A generator for each event, written as text and read back: both go on alike."""

    @F.pandas_udf("boolean")
    def same(ids: pd.Series) -> pd.Series:
        pairs = ((rng, fi.generator_from_json(fi.generator_to_json(rng))) for rng in (np.random.default_rng([11, k]) for k in ids))
        return pd.Series([rng.random() == again.random() for rng, again in pairs], dtype=bool)

    return table(spark, sf, "events").select("event_id", same("event_id").alias("same"))


@query("SELECT user_id, '{\"n\": ' || count(*) || ', \"ids\": [' || min(event_id) || ', ' || max(event_id) || ']}' AS text FROM events GROUP BY 1")
def builtin_values(spark, sf):
    """Each user's NumPy numbers as built-in ones, which JSON takes."""

    @F.pandas_udf("string")
    def text(n: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(fi.plain({"n": np.int64(a), "ids": np.array([b, c])})) for a, b, c in zip(n, low, high, strict=True)], dtype=str)

    by = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    return by.select("user_id", text("n", "low", "high").alias("text"))


@query("SELECT kind, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS kind)")
def file_formats(spark, sf):
    nation, path, out = table(spark, sf, "nation").select("n_nationkey", "n_name"), place(spark), None
    for kind in ("csv", "json", "orc", "parquet"):
        (nation.write.option("header", "true") if kind == "csv" else nation.write).format(kind).save(f"{path}/{kind}")
        back = fi.read(spark, f"{path}/{kind}", kind, "n_nationkey long, n_name string").select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT n_nationkey::BIGINT AS k, (n_nationkey * 3)::BIGINT AS v, (n_nationkey >= 10)::INT AS run FROM nation")
def experiment_resume(spark, sf):
    keys, path = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k")), f"{place(spark)}/results"
    fi.resumed(spark, keys.where("k < 10"), path, ["k"], lambda p: p.select("k", (F.col("k") * 3).alias("v"), F.lit(0).alias("run")))
    return fi.resumed(spark, keys, path, ["k"], lambda p: p.select("k", (F.col("k") * 3).alias("v"), F.lit(1).alias("run")))


@query("SELECT event_type AS scenario, (user_id % 3)::BIGINT AS sim, 'a' || (user_id % 2) AS agent, event_id AS draw, round(value, 4) + 0.0 AS regret FROM events")
def simulation_json(spark, sf):
    e = table(spark, sf, "events")
    sim = e.select(F.col("event_type").alias("scenario"), (F.col("user_id") % 3).alias("sim"), F.concat(F.lit("a"), (F.col("user_id") % 2).cast("string")).alias("agent"), F.col("event_id").alias("draw"), F.col("value").alias("regret"), F.lit(0.0).alias("secs"))
    path = f"{place(spark)}/sims"
    sm.to_json_lines(sim, path)
    return sm.read_json_lines(spark, path).select("scenario", "sim", "agent", "draw", r("regret", 4).alias("regret"))


_DUMP = [
    {"nodeid": 0, "split": "f0", "split_condition": 25.0, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": -0.5}, {"nodeid": 2, "split": "f3", "split_condition": 6.0, "yes": 3, "no": 4, "children": [{"nodeid": 3, "leaf": 0.25}, {"nodeid": 4, "leaf": 0.125}]}]},
    {"nodeid": 0, "split": "f0", "split_condition": 50.0, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": 0.0625}, {"nodeid": 2, "leaf": 4.0}]},
]
_BOOSTED = "(if(l_quantity < 25, -0.5, if(month < 6, 0.25, 0.125)) + if(l_quantity < 50, 0.0625, 4.0))::DOUBLE"


@query(f"SELECT l_returnflag, count(*) AS n, round(sum({_BOOSTED}), 4) + 0.0 AS total FROM {ITEMS} GROUP BY 1")
def boosted_forest(spark, sf):
    return items(spark, sf).groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum(fo.case_forest(fo.from_boosted(_DUMP), xs())), 4).alias("total"))


_TENTH = "if((leaf * 10)::INT = 0, '0', '0.' || (leaf * 10)::INT)"
_RULE = f"if(var < 0, '= ' || {_TENTH}, 'x' || var || ' <= ' || thr::INT)"
# the place of a heap number in preorder, by its path
_PATH = "CASE node WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 2 THEN 4 WHEN 5 THEN 5 ELSE 6 END"


@query(f"SELECT tree, string_agg(repeat('| ', (ceil(log2(node + 2)) - 1)::INT) || '#' || node || ' ' || {_RULE}, chr(10) ORDER BY {_PATH}) AS text FROM ({_NODES}) GROUP BY 1")
def tree_listing(spark, sf):
    return fo.texts(nodes(spark, sf), ["tree"], fo.to_text)


_BOX = f"'  n' || node || ' [label=\"' || if(var < 0, {_TENTH} || '\", shape=box];', 'x' || var || ' <= ' || thr::INT || '\"];')"


@query(
    f"WITH n AS ({_NODES}), e AS (SELECT tree, node, side, '  n' || node || ' -> n' || (2 * node + side) || ' [label=\"' || if(side = 1, 'yes', 'no') || '\"];' AS l FROM n, (SELECT unnest([1, 2]) AS side) WHERE var >= 0) "
    f"SELECT tree, 'digraph tree {{' || chr(10) || string_agg({_BOX}, chr(10) ORDER BY node) || chr(10) || any_value(ls) || chr(10) || '}}' AS text FROM n JOIN (SELECT tree, string_agg(l, chr(10) ORDER BY node, side) AS ls FROM e GROUP BY 1) USING (tree) GROUP BY 1"
)
def tree_dot(spark, sf):
    return fo.texts(nodes(spark, sf), ["tree"], fo.to_dot)


# -- functions -----------------------------------------------------------------------------------------------------------

# parameters from each event
_QUANTILE = "(SELECT event_id, value / (value + 50) AS q, (2 + 2 * (user_id % 3))::INT AS df FROM events WHERE value > 0)"


@query(f"SELECT event_id, df, round(q, 9) + 0.0 AS back, round(CASE WHEN df = 2 THEN -2 * ln(1 - q) END, 6) AS x FROM {_QUANTILE}")
def chi2_quantiles(spark, sf):
    """The distribution function of even degrees is a finite sum, which leads back from each quantile."""

    @F.pandas_udf("double")
    def quantile(q: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(sp.chi2_ppf_all(q.to_numpy(dtype=float), df.to_numpy(dtype=float)))

    e = table(spark, sf, "events").where("value > 0").select("event_id", (F.col("value") / (F.col("value") + 50)).alias("q"), (2 + 2 * (F.col("user_id") % 3)).cast("int").alias("df"))
    h = F.col("x") / 2
    back = 1 - F.exp(-h) * (1 + F.when(F.col("df") > 2, h).otherwise(0.0) + F.when(F.col("df") > 4, h * h / 2).otherwise(0.0))
    return e.withColumn("x", quantile("q", "df")).select("event_id", "df", r(back, 9).alias("back"), F.when(F.col("df") == 2, F.round("x", 6)).alias("x"))


def _by_rows(made, kind: str = "double", rows: int = 256):
    """A column function of NumPy arrays that takes some rows at a time."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        parts = [made(*(x.to_numpy(dtype=float)[k : k + rows] for x in (a, b, c))) for k in range(0, len(a), rows)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run


_ORDERS = "(SELECT event_id, value / 10 + CAST(0.3 AS DOUBLE) AS x, user_id % 3 + CAST(0.5 AS DOUBLE) AS v FROM events WHERE value >= 0)"


@query(f"SELECT event_id, round(0.5 * ln(pi() / (2 * x)) - x + ln(CASE v WHEN 0.5 THEN 1 WHEN 1.5 THEN 1 + 1 / x ELSE 1 + 3 / x + 3 / (x * x) END), 5) + 0.0 AS k FROM {_ORDERS}")
def bessel_of_half_orders(spark, sf):
    bessel = _by_rows(lambda v, x, _: sp.log_bessel_k(v, x))
    x, v = F.col("value") / 10 + F.lit(0.3), F.col("user_id") % 3 + F.lit(0.5)
    return table(spark, sf, "events").where("value >= 0").select("event_id", r(bessel(v, x, F.lit(0.0)), 5).alias("k"))


_W = "sqrt(chi * psi)"
_GIG = "(SELECT event_id, CAST([0.5, 1.5, -0.5][user_id % 3 + 1] AS DOUBLE) AS eta, if(user_id % 3 < 2 AND user_id % 7 = 0, 0, value / 5 + CAST(0.1 AS DOUBLE)) AS chi, user_id % 5 + CAST(0.2 AS DOUBLE) AS psi FROM events WHERE value >= 0)"


@query(
    f"SELECT event_id, round(CASE WHEN chi = 0 THEN lgamma(eta) + eta * ln(2 / psi) ELSE ln(2) + 0.5 * ln(pi() / (2 * {_W})) - {_W} + CASE WHEN eta = 1.5 THEN ln(1 + 1 / {_W}) ELSE 0 END + eta / 2 * ln(chi / psi) END, 5) + 0.0 AS z FROM {_GIG}"
)
def inverse_gaussian_normaliser(spark, sf):
    u, norm = F.col("user_id"), _by_rows(lambda e, c, p: sp.log_gig_norm(e, c, p))
    eta = F.element_at(F.array(F.lit(0.5), F.lit(1.5), F.lit(-0.5)), (u % 3 + 1).cast("int"))
    chi = F.when((u % 3 < 2) & (u % 7 == 0), F.lit(0.0)).otherwise(F.col("value") / 5 + F.lit(0.1))
    return table(spark, sf, "events").where("value >= 0").select("event_id", r(norm(eta, chi, u % 5 + F.lit(0.2)), 5).alias("z"))


@query("SELECT event_id, round(ln(exp(value / 10) + exp(-value / 5)), 6) + 0.0 AS z FROM events")
def log_add_exp(spark, sf):
    return table(spark, sf, "events").select("event_id", r(fc.log_add_exp(F.col("value") / 10, -F.col("value") / 5)).alias("z"))


@query("SELECT l_suppkey, n, round(n / CAST(6.125 AS DOUBLE) + 0.5, 6) + 0.0 AS c, round(n / CAST(6.125 AS DOUBLE), 6) + 0.0 AS d FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def logistic_leaf_shape(spark, sf):
    """As many trees as a supplier has items."""
    c, d = logistic_shape(F.col("n"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).select("l_suppkey", "n", r(c).alias("c"), r(d).alias("d"))


_MOMENTS = [(0.5, 2.0, 3.0), (1.5, 1.0, 1.0), (-0.5, 1.0, 2.0), (3.0, 0.0, 2.0), (-4.0, 2.0, 0.0)]


@query("SELECT (user_id % 5)::INT AS kind, count(*) AS n, true AS near FROM events GROUP BY 1")
def inverse_gaussian_draws(spark, sf):
    """A draw for each event, by one of five parameters: their means against the closed form."""

    @F.pandas_udf("double")
    def draw(ids: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([float(sp.draw_gig(np.random.default_rng([5, i]), *_MOMENTS[k])) for i, k in zip(ids, kinds, strict=True)], dtype=float)

    means = [math.exp(float(sp.log_gig_norm(e + 1, c, p)) - float(sp.log_gig_norm(e, c, p))) for e, c, p in _MOMENTS]
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).cast("int").alias("kind"))
    s = e.withColumn("x", draw("event_id", "kind")).groupBy("kind").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev("x").alias("d"))
    want = F.element_at(F.array(*map(F.lit, means)), F.col("kind") + 1)
    return s.select("kind", "n", (F.abs(F.col("m") - want) < 5 * F.col("d") / F.sqrt("n")).alias("near"))


# -- analytics -------------------------------------------------------------------------------------------------------------

_BAND = "(SELECT event_type AS agent, hour(ts)::INT AS draw, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1, 2)"


@query(f"SELECT agent, draw, n, round(m, 6) + 0.0 AS mean, round(m - 2 * s, 5) + 0.0 AS low, round(m + 2 * s, 5) + 0.0 AS high FROM {_BAND}")
def mean_curve_band(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("agent"), F.hour("ts").alias("draw"), "value")
    return an.curve_band(e, "value", ["agent"], widths=2.0).select("agent", "draw", "n", r("mean").alias("mean"), r("low", 5).alias("low"), r("high", 5).alias("high"))


_GROWN_SQL = f"(SELECT agent, draw + 1 AS t, sum(m + 1) OVER (PARTITION BY agent ORDER BY draw) AS v FROM {_BAND})"


@query(
    f"WITH c AS (SELECT * FROM {_GROWN_SQL}), f AS (SELECT agent, regr_slope(ln(v), ln(t)) AS b, regr_intercept(ln(v), ln(t)) AS la, regr_slope(v, ln(t)) AS k, regr_intercept(v, ln(t)) AS i FROM c GROUP BY 1), "
    "s AS (SELECT agent, count(*) AS n, sum(power(v - exp(la + b * ln(t)), 2)) AS rp, sum(power(v - i - k * ln(t), 2)) AS rl FROM c JOIN f USING (agent) GROUP BY 1) "
    "SELECT agent, round(b, 6) + 0.0 AS power, round(n * ln(rp / n) + 4, 4) + 0.0 AS aic_power, round(n * ln(rl / n) + 4, 4) + 0.0 AS aic_log, if(n * ln(rp / n) < n * ln(rl / n), 'power', 'log') AS best FROM s JOIN f USING (agent)"
)
def complexity_frame(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("agent"), F.hour("ts").alias("draw")).agg((F.avg("value") + 1).alias("v"))
    grown = an.running(e, "v", ["agent"], "draw", "regret").withColumn("draw", F.col("draw") + 1)
    return an.complexity(grown, "regret", ["agent"]).select("agent", r("power").alias("power"), r("aic_power", 4).alias("aic_power"), r("aic_log", 4).alias("aic_log"), "best")


_SMOOTH = (
    "WITH d AS (SELECT event_type, day(ts)::INT AS d, avg(value) AS m FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d), "
    "k AS (SELECT unnest(range(-6, 7)) AS k), s AS (SELECT a.event_type, a.d, k, ((a.i + k) % (2 * n) + 2 * n) % (2 * n) AS p, n FROM i a, k), t AS (SELECT *, if(p < n, p, 2 * n - 1 - p) AS j FROM s) "
    "SELECT t.event_type, t.d AS day, round(sum(exp(-0.5 * power(k / CAST(1.5 AS DOUBLE), 2)) * b.m) / sum(exp(-0.5 * power(k / CAST(1.5 AS DOUBLE), 2))), 6) + 0.0 AS smooth FROM t JOIN i b ON b.event_type = t.event_type AND b.i = t.j GROUP BY 1, 2"
)


@query(_SMOOTH)
def gaussian_smoothing(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("m"))
    return an.gaussian_smooth(daily, ["event_type"], "day", "m", 1.5).select("event_type", "day", r("smooth").alias("smooth"))


@query("SELECT event_type AS move, count(*) AS n, sum((value > 5)::INT)::BIGINT AS hits FROM events WHERE NOT (user_id % 2 = 0 AND event_type = 'view') AND NOT (user_id % 2 = 1 AND event_type = 'click') GROUP BY 1")
def merged_move_counts(spark, sf):
    """Two tables of counts, each of which lacks a key of the other."""
    e = table(spark, sf, "events").withColumn("hit", (F.col("value") > 5).cast("long"))
    halves = [e.where(f"user_id % 2 = {k} and event_type <> '{gone}'").groupBy(F.col("event_type").alias("move")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits")) for k, gone in ((0, "view"), (1, "click"))]
    return an.merged_counts(*halves, "move", ["n", "hits"])


# Student's quantile from the normal one, by its expansion in 1 / df
_Z95 = 1.959963984540054
_CRIT = f"({_Z95} + {(_Z95**3 + _Z95) / 4!r} / df + {(5 * _Z95**5 + 16 * _Z95**3 + 3 * _Z95) / 96!r} / (df * df) + {(3 * _Z95**7 + 19 * _Z95**5 + 17 * _Z95**3 - 15 * _Z95) / 384!r} / (df * df * df))"
_PAIRS = "(SELECT a.event_type AS a1, b.event_type AS a2, a.m - b.m AS d, a.v / a.n AS va, b.v / b.n AS vb, a.n AS na, b.n AS nb FROM m a JOIN m b ON a.event_type < b.event_type)"


@query(
    f"WITH m AS (SELECT event_type, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, d / sqrt(va + vb) AS t, power(va + vb, 2) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS df FROM {_PAIRS}) "
    f"SELECT a1, a2, round(t, 5) + 0.0 AS t, (CASE WHEN abs(t) <= {_CRIT} THEN 0 WHEN t < 0 THEN 1 ELSE -1 END)::INT AS outcome FROM p"
)
def welch_outcomes(spark, sf):
    e = table(spark, sf, "events").select(F.lit("S").alias("scenario"), F.col("event_type").alias("agent"), F.col("value").alias("regret"))
    p = an.win_tie_lose(e)
    return p.select("a1", "a2", r((F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")), 5).alias("t"), "outcome")


_U3 = "(CAST((((((event_id * 64 + k) % 1000003) * 8647 + 166824) % 999983) * 48271 + 116) % 1000033 AS DOUBLE) + 0.5) / 1000033"
_POISSON = " + ".join(f"(u > {v})::INT" for v in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676))


@query(f"SELECT k::INT AS round, sum(c)::BIGINT AS copies, count(*) FILTER (c > 0) AS kept, round(sum(value * c) / sum(c), 6) + 0.0 AS mean FROM (SELECT k, value, {_POISSON} AS c FROM (SELECT k, value, {_U3} AS u FROM events, range(20) t(k))) GROUP BY 1")
def bootstrap_rounds(spark, sf):
    b = sa.bootstrap(table(spark, sf, "events").select("event_id", "value"), "event_id", 20, 5)
    return b.groupBy("round").agg(F.sum("copies").alias("copies"), F.count("*").alias("kept"), r(F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("mean"))


# -- diagnostics: rank-normalised R-hat by its definition ---------------------------------------------------------------------

# fixed values: Acklam's rational approximation of the normal quantile
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _horner(c: tuple[float, ...], x: str) -> str:
    out = f"CAST({c[0]!r} AS DOUBLE)"
    for v in c[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


_TAIL = f"{_horner(_C, 'w')} / {_horner((*_D, 1.0), 'w')}"
_MID = f"(u - 0.5) * {_horner(_A, 'power(u - 0.5, 2)')} / {_horner((*_B, 1.0), 'power(u - 0.5, 2)')}"
_INV = f"CASE WHEN u < 0.02425 OR u > 0.97575 THEN if(u < 0.5, 1, -1) * {_TAIL} ELSE {_MID} END"


@query(
    f"WITH p AS (SELECT chain, value, row_number() OVER (PARTITION BY chain ORDER BY draw) - 1 AS i FROM {CHAINS}), l AS (SELECT min(n) AS l FROM (SELECT count(*) AS n FROM p GROUP BY chain)), "
    "s AS (SELECT 2 * chain + (i >= l // 2)::INT AS c, value FROM p, l WHERE i < l AND (i < l // 2 OR i >= l - l // 2)), m AS (SELECT median(value) AS m FROM s), "
    "f AS (SELECT c, 'bulk' AS kind, value AS v FROM s UNION ALL SELECT c, 'fold', abs(value - m) FROM s, m), "
    "k AS (SELECT kind, c, (rank() OVER (PARTITION BY kind ORDER BY v) + (count(*) OVER (PARTITION BY kind, v) - 1) / 2 - 0.375) / (count(*) OVER (PARTITION BY kind) + 0.25) AS u FROM f), "
    f"z AS (SELECT kind, c, {_INV} AS z FROM (SELECT *, sqrt(-2 * ln(least(u, 1 - u))) AS w FROM k)), b AS (SELECT kind, c, avg(z) AS m, var_samp(z) AS v, count(*) AS n FROM z GROUP BY 1, 2) "
    "SELECT round(max(r), 4) + 0.0 AS rhat FROM (SELECT kind, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS r FROM b GROUP BY kind)"
)
def rank_rhat(spark, sf):
    found = lt.rank_rhats(chains(spark, sf).withColumn("one", F.lit(1)), ["one"], block_rows=1000)
    return found.select(r("rhat", 4).alias("rhat"))


# -- edits of trees ----------------------------------------------------------------------------------------------------------

_EDITS = {
    "split_leaf": (fo.split_leaf(TREE, 2, 3, 6.0, 0.7, -0.7), "if(l_quantity <= 25, if(l_discount <= 0.05, -0.2, 0.1), if(month <= 6, 0.7, -0.7))"),
    "prune_split": (fo.prune_split(TREE, 1, 0.15), "if(l_quantity <= 25, 0.15, 0.3)"),
    "prune_root": (fo.prune_split(TREE, 0, 0.4, recursive=True), "0.4"),
    "change_split": (fo.change_split(TREE, 0, 2, 0.03), "if(l_tax <= 0.03, if(l_discount <= 0.05, -0.2, 0.1), 0.3)"),
    "swap_split": (fo.swap_split(TREE, 0, 1), "if(l_discount <= 0.05, if(l_quantity <= 25, -0.2, 0.1), 0.3)"),
    "set_leaf": (fo.set_leaf(TREE, 2, 0.9), "if(l_quantity <= 25, if(l_discount <= 0.05, -0.2, 0.1), 0.9)"),
    "stump": ({0: fo.leaf(0.0)}, "0.0"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS edit, l_returnflag, round(sum(({sql})::DOUBLE), 4) + 0.0 AS total FROM {ITEMS} GROUP BY 2" for k, (_, sql) in _EDITS.items()))
def tree_edits(spark, sf):
    sums = items(spark, sf).groupBy("l_returnflag").agg(*[r(F.sum(fo.case_value(t, xs())), 4).alias(k) for k, (t, _) in _EDITS.items()])
    return sums.select("l_returnflag", F.explode(F.array(*[F.struct(F.lit(k).alias("edit"), F.col(k).alias("total")) for k in _EDITS])).alias("e")).select("e.edit", "l_returnflag", "e.total")


@query(f"SELECT tree, greatest(8, power(2, length(bin(max(node) + 1))))::INT AS size, count(*) AS nodes FROM ({_NODES}) GROUP BY 1")
def heap_sizes(spark, sf):
    """The arrays of each supplier's tree: their size, and the nodes that they hold."""
    shown = fo.texts(nodes(spark, sf), ["tree"], lambda t: f"{len(fo.heap(t)[0])} {sum(v != fo.ABSENT for v in fo.heap(fo.from_heap(*fo.heap(t)))[0])}")
    part = F.split("text", " ")
    return shown.select("tree", F.get(part, 0).cast("int").alias("size"), F.get(part, 1).cast("long").alias("nodes"))


_CHAIN_TREE = ChainTree({0: (0, 25.0), 2: (1, 6.0)}, {1: -0.5, 5: 0.25, 6: 1.0}, np.zeros(0, dtype=np.int64))
_ITEM_LEAF = "if(l_quantity <= 25, 1, if(month <= 6, 5, 6))"


@query(f"SELECT {_ITEM_LEAF}::INT AS leaf, count(*) AS n, round(sum(CASE {_ITEM_LEAF} WHEN 1 THEN -0.5 WHEN 5 THEN 0.25 ELSE 1.0 END), 2)::DOUBLE AS total, true AS kept FROM {ITEMS} GROUP BY 1")
def appended_rows(spark, sf):
    """A tree of a chain over some rows of each batch takes the others: the old keep their leaves, the new are routed."""

    def run(batches):
        for rows in batches:
            x = rows.to_numpy(dtype=float)
            some = _CHAIN_TREE.extend(x[: len(x) // 3], 0)
            both = some.extend(x, len(x) // 3)
            yield pd.DataFrame({"leaf": both.at, "value": both.values(), "kept": np.arange(len(x)) >= len(some.at)}).assign(kept=lambda d, s=some: d["kept"] | (d["leaf"].to_numpy() == np.resize(s.at if len(s.at) else [-1], len(d))))

    routed = items(spark, sf).select("l_quantity", "month").mapInPandas(run, "leaf int, value double, kept boolean")
    return routed.groupBy("leaf").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("kept").alias("kept"))


# -- literal models -----------------------------------------------------------------------------------------------------------


def _packed(forest):
    return [[(i, n.var, 0.0 if math.isnan(n.thr) else n.thr, 0.0 if math.isnan(n.leaf) else n.leaf) for i, n in sorted(t.items())] for t in forest]


def literal(spark, kind: str = "regression", low: float = 0.0, high: float = 100000.0, categories: int = 1):
    """A model of two chains of four draws; the forests of a second category are those of the draws turned around."""
    from thicket.plans import model as mo

    rows = [(k // 4, 0, k % 4, c, 0.5 + 0.1 * k, None, _packed(TRACE[k] if c == 0 else TRACE[::-1][k])) for k in range(8) for c in range(categories)]
    prep = pp.Preprocessor(FEATURES, "y", 2, low, high, [[] for _ in FEATURES])
    return mo.Model(kind, prep, Settings(n_trees=3, ndpost=8, nskip=0), 2, 0, spark.createDataFrame(rows, mo.TRACE), spark.createDataFrame([], mo.MOVES), None, categories)


_F = [fo.sql_forest(f, FEATURES) for f in TRACE]
_LIST8 = f"[{', '.join(_F)}]"


def _by_flag(df, value, digits=3):
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg(value), digits).alias("mean"))


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(100000 * (list_avg({_LIST8}) + 0.5)), 3) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def model_files(spark, sf):
    """A model of several chains, written, read back and evaluated."""
    from thicket.plans.model import Model

    path = f"{place(spark)}/model"
    literal(spark).save(path)
    return _by_flag(Model.load(spark, path).predict(items(spark, sf)), "prediction")


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(100000 * ({_F[5]} + 0.5)), 3) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def posterior_sample(spark, sf):
    """A schedule that has all weight on one draw."""
    return _by_flag(literal(spark).posterior_sample(items(spark, sf), lambda k: float(k == 5), 3), "f")


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(100000 * (list_avg([{', '.join(_F[:3] + _F[4:])}]) + 0.5)), 3) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def model_without_a_draw(spark, sf):
    return _by_flag(literal(spark).without(3).posterior_f(items(spark, sf)).withColumn("m", po.array_mean(F.col("draws"))), "m")


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(least(1, greatest(0, 3 * (list_avg({_LIST8}) + 0.5) - 1))), 6) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def clipped_probability(spark, sf):
    """A regression of 0 and 1 whose scale leads beyond both."""
    made = literal(spark, low=-1.0, high=2.0).predict_proba(items(spark, sf))
    return _by_flag(made.withColumn("p", F.get("proba", 1)), "p", 6)


_SIG = ", ".join(f"1 / (1 + exp({a} - {b}))" for a, b in zip(_F, _F[::-1], strict=True))


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(list_avg([{_SIG}])), 6) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def logistic_posterior(spark, sf):
    made = literal(spark, "logistic", categories=2).predict_proba(items(spark, sf))
    return _by_flag(made.withColumn("p", F.get("proba", 1)), "p", 6)


def of_suppliers(spark, sf):
    """A model whose draws are the suppliers' trees, three a draw, in two chains; its trace is derived by Spark."""
    from thicket.plans import model as mo

    node = F.struct("node", "var", F.coalesce("thr", F.lit(0.0)).alias("thr"), F.coalesce("leaf", F.lit(0.0)).alias("leaf"))
    trees = nodes(spark, sf).groupBy("chain", "draw", "tree").agg(F.collect_list(node).alias("t")).groupBy("chain", "draw").agg(F.collect_list("t").alias("trees"))
    trace = trees.select("chain", F.lit(0).alias("shard"), "draw", F.lit(0).alias("category"), (0.5 + 0.1 * (F.col("draw") % 7)).cast("double").alias("sigma2"), F.lit(None).cast("array<double>").alias("s"), "trees")
    n = trace.count()
    return mo.Model("regression", pp.Preprocessor(FEATURES, "y", 2, 0.0, 100000.0, [[] for _ in FEATURES]), Settings(n_trees=3, ndpost=n, nskip=0), 2, 0, trace, spark.createDataFrame([], mo.MOVES))


_SIGMAS = "(SELECT DISTINCT (d % 2)::INT AS chain, d::INT AS draw, 0.5 + 0.1 * (d % 7) AS sigma2 FROM (SELECT l_suppkey // 3 AS d FROM lineitem))"


_FIXED = [("chains", "2"), ("kind", "regression"), ("max_bins", "2"), ("n_trees", "3"), ("nskip", "0"), ("tree_alpha", "0.95"), ("tree_beta", "2.0")]


@query(f"{values(_FIXED, 'name, value')} UNION ALL SELECT 'ndpost', count(*)::VARCHAR FROM {_SIGMAS}")
def model_params(spark, sf):
    keep = {"ndpost", *(k for k, _ in _FIXED)}
    return spark.createDataFrame([(k, str(v)) for k, v in of_suppliers(spark, sf).params().items() if k in keep], "name string, value string")



@query(f"SELECT k, true AS fitted FROM (SELECT count(*) AS n FROM {_SIGMAS}), LATERAL (SELECT unnest(range(n - 3, n)) AS k)")
def model_control(spark, sf):
    """The last three of a model's draws."""
    m = of_suppliers(spark, sf).set_ndpost(3)
    return spark.createDataFrame([(k, m.is_fitted) for k in m.range_post()], "k long, fitted boolean")


@query(f"SELECT chain, count(*) AS n, round(sum(sigma2), 6)::DOUBLE AS sigma2 FROM {_SIGMAS} GROUP BY 1")
def collected_by_chain(spark, sf):
    made = of_suppliers(spark, sf).collect(lambda g: g.groupby("chain", as_index=False).agg(n=("draw", "size"), sigma2=("sigma2", "sum")), "chain int, n long, sigma2 double")
    return made.select("chain", "n", r("sigma2").alias("sigma2"))


@query(f"SELECT chain, draw, round(sigma2::DOUBLE, 6) AS value FROM {_SIGMAS}")
def noise_chains(spark, sf):
    return of_suppliers(spark, sf).sigma_chains().select("chain", "draw", r("value").alias("value"))


@query(
    f"WITH n AS MATERIALIZED ({_NODES}), i AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, month(l_shipdate)::DOUBLE AS month FROM lineitem), "
    "x AS MATERIALIZED (SELECT l_returnflag, l_quantity, l_discount, l_tax, month, count(*) AS c FROM i GROUP BY ALL), "
    "a AS (SELECT x.*, tree, CASE var WHEN 0 THEN l_quantity WHEN 1 THEN l_discount WHEN 2 THEN l_tax ELSE month END <= thr AS l FROM x, n WHERE node = 0), "
    "b AS (SELECT a.*, n.node, n.leaf, n.var, CASE n.var WHEN 0 THEN l_quantity WHEN 1 THEN l_discount WHEN 2 THEN l_tax ELSE month END <= n.thr AS m FROM a JOIN n ON n.tree = a.tree AND n.node = if(l, 1, 2)), "
    "c AS (SELECT b.l_returnflag, b.c, coalesce(b.leaf, n.leaf) AS v FROM b LEFT JOIN n ON b.var >= 0 AND n.tree = b.tree AND n.node = if(m, 2 * b.node + 1, 2 * b.node + 2)) "
    "SELECT l_returnflag, round(sum(c * v) / (SELECT count(DISTINCT draw) FROM n), 4) + 0.0 AS total FROM c GROUP BY 1"
)
def chunked_posterior(spark, sf):
    """Means over the draws of the suppliers' trees, whose trace reaches the rows in three or four passes."""
    from thicket.operators import traces as tr

    m = of_suppliers(spark, sf)
    rows = with_x(items(spark, sf)).groupBy("l_returnflag", "x").agg(F.count("*").alias("n"))  # equal rows have one value
    made = tr.evaluated(rows, m.trace, F.lit(0), F.lit(1.0 / m.settings.ndpost), 1, "x", "f", pass_bytes=1 + tr.packed_bytes(m.trace) // 3)
    return made.groupBy("l_returnflag").agg(r(F.sum(F.col("n") * F.get("f", 0)), 4).alias("total"))


@query(f"SELECT count(*) AS n, true AS mean_near, true AS spread_near FROM {ITEMS}")
def predictive_noise(spark, sf):
    """Noise of predictive draws has mean 0 and the deviation of each draw's variance, within five standard errors."""
    m = literal(spark)
    made = items(spark, sf).select("*", F.monotonically_increasing_id().alias("row_id"))
    both = m.posterior_predict(m.posterior_f(made), "row_id", 4)
    noise = F.transform(F.arrays_zip("draws", "predicted"), lambda z: (z["predicted"] - z["draws"]) / 100000.0)
    s = both.select(noise.alias("e")).select(F.get("e", 3).alias("e")).agg(F.count("*").alias("n"), F.avg("e").alias("m"), F.stddev("e").alias("s"))
    sd = math.sqrt(0.8)
    return s.select("n", (F.abs("m") < 5 * sd / F.sqrt("n")).alias("mean_near"), (F.abs(F.col("s") / sd - 1) < 5 / F.sqrt(2 * F.col("n"))).alias("spread_near"))


@query(f"SELECT kind, count(*) AS n, true AS near FROM {ITEMS}, (SELECT unnest(['logistic', 'probit']) AS kind) GROUP BY 1")
def predictive_classes(spark, sf):
    """Shares of drawn classes against their mean probabilities, within five standard errors."""
    made = items(spark, sf).select("*", F.monotonically_increasing_id().alias("row_id"))
    out = None
    for kind, m in (("probit", literal(spark, "probit")), ("logistic", literal(spark, "logistic", categories=2))):
        both = m.posterior_predict(made, "row_id", 4, proba="proba")
        p = F.get("proba", 2) if kind == "probit" else F.get(F.get("proba", 2), 1)
        s = both.select(p.alias("p"), F.get("predicted", 2).alias("c")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("c").alias("c"))
        s = s.select(F.lit(kind).alias("kind"), "n", (F.abs(F.col("p") - F.col("c")) < 2.5 / F.sqrt("n")).alias("near"))
        out = s if out is None else out.unionByName(s)
    return out


# -- chains ------------------------------------------------------------------------------------------------------------------------


@query("SELECT chain::INT AS chain, 35 AS selected, true AS ordered, 3 AS draws, true AS proper FROM range(2) t(chain)")
def chain_bookkeeping(spark, sf):
    """Each of (4 + 3) sweeps over five trees selects a move; no move is accepted that was not proposed."""
    m = _fit(spark, sf, chains=2, n_trees=5, ndpost=6, nskip=4)
    moves = m.moves.groupBy("chain").agg(F.sum("selected").cast("int").alias("selected"), F.min((F.col("accepted") <= F.col("proposed")) & (F.col("proposed") <= F.col("selected"))).alias("ordered"))
    trace = m.trace.groupBy("chain").agg(F.count("*").cast("int").alias("draws"), F.min((F.col("sigma2") > 0) & (F.size("trees") == 5)).alias("proper"))
    return moves.join(trace, "chain")


@query("SELECT count(*) AS n, true AS explained, true AS covered FROM events WHERE event_id % 5 = 0")
def fitted_model(spark, sf):
    """Friedman's function with noise of deviation 1, fitted to four fifths of the rows: on the others the mean explains the
    greater part of it, and intervals of 90 % of predictive draws hold between 0.80 and 0.98 of the targets."""
    noise = sum((sa.uniform(F.col("row_id"), k, 11) for k in range(12)), F.lit(-6.0))
    rows = _friedman(spark, sf).withColumn("y", F.col("y") + noise)
    m, held = _fit(spark, sf, rows.where("row_id % 5 <> 0")), rows.where("row_id % 5 = 0")
    made = po.intervals(m.posterior_predict(m.predict(held, "mean"), "row_id", 3, "draws"), level=0.9)
    inside = ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double")
    s = made.agg(F.count("*").alias("n"), F.avg((F.col("mean") - F.col("y")) ** 2).alias("e"), F.var_pop("y").alias("v"), F.avg(inside).alias("c"))
    return s.select("n", (F.col("e") < 0.3 * F.col("v")).alias("explained"), F.col("c").between(0.8, 0.98).alias("covered"))


@query("SELECT kind, true AS better FROM (SELECT unnest(['logistic', 'probit']) AS kind)")
def fitted_classifiers(spark, sf):
    """Both classifiers are right on more than nine tenths of the rows."""
    from thicket.plans.model import fit

    rows = _friedman(spark, sf).withColumn("label", F.when(F.col("y") > 14, "high").otherwise("low"))
    out = None
    for kind, options in (("probit", {"n_trees": 20, "ndpost": 20, "nskip": 30}), ("logistic", {"n_trees": 10, "ndpost": 20, "nskip": 30})):
        m = fit(rows, [f"x{k}" for k in range(5)], "label", kind, seed=1, max_bins=20, **options)
        s = m.predict(rows).agg(F.avg((F.col("prediction_label") == F.col("label")).cast("double")).alias("a")).select(F.lit(kind).alias("kind"), (F.col("a") > 0.85).alias("better"))
        out = s if out is None else out.unionByName(s)
    return out


@query("SELECT draw, 2 AS states, (SELECT count(*) FROM events) AS n FROM range(0, 2) t(draw)")
def continued_after_loading(spark, sf):
    """A model of two chains over a part of the rows is written, read back, and goes on over all of them."""
    from thicket.plans.model import Model

    rows, path = _friedman(spark, sf), f"{place(spark)}/model"
    _fit(spark, sf, rows.where("row_id % 4 <> 0"), chains=2, n_trees=3, ndpost=2, nskip=2).save(path)
    m = Model.load(spark, path).update(rows.where("row_id % 4 = 0"), 4)
    return m.trace.where("draw >= 0").groupBy(F.col("draw").cast("long").alias("draw")).agg(F.count("*").cast("int").alias("states")).withColumn("n", F.lit(m.rows.count()))


_START = [{"nodeid": 0, "split": "f0", "split_condition": 0.5, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": -0.1}, {"nodeid": 2, "split": "f3", "split_condition": 0.25, "yes": 3, "no": 4, "children": [{"nodeid": 3, "leaf": 0.0}, {"nodeid": 4, "leaf": 0.2}]}]}]


@query(values([(0, 0, True), (1, -1, True), (2, 3, True), (5, -1, True), (6, -1, True)], "node, var, redrawn"))
def warm_start(spark, sf):
    """The first state has the boosted tree's rules; its leaves are redrawn."""
    m = _fit(spark, sf, boosted=_START, ndpost=2, nskip=0)
    first = m.trace.where("draw = -1").select(F.inline(F.get("trees", 0)))
    known = F.array(*[F.lit(v) for v in (-0.1, 0.0, 0.2)])
    return first.select("node", "var", ((F.col("var") >= 0) | ~F.array_contains(known, F.col("leaf"))).alias("redrawn"))


_BY_ARM = "events, (SELECT unnest([0, 1])::INT AS chain)"


def _by_arm(spark, sf):
    from thicket.plans.separate import fit_each

    e = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 7 / 7).alias("u"), (F.hour("ts") / 24).alias("h"), "value")
    return e, fit_each(e, "event_type", ["u", "h"], "value", chains=2, n_trees=3, ndpost=6, nskip=2, max_bins=5)


@query(f"SELECT event_type AS model, chain, 3::BIGINT AS draws, count(*) AS rows FROM {_BY_ARM} GROUP BY 1, 2")
def models_by_arm(spark, sf):
    return _by_arm(spark, sf)[1].effective()


@query("SELECT event_type, count(*) AS n, 5 AS models, 6 AS draws, true AS own FROM events GROUP BY 1")
def models_by_arm_batch(spark, sf):
    """Every row has the draws of all models, and its own model's are among them."""
    e, m = _by_arm(spark, sf)
    made = m.posterior_f_batch(m.posterior_f(e, "own"), "every")
    own = F.element_at("every", F.col("event_type"))
    return made.groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.size("every")).alias("models"), F.max(F.size("own")).alias("draws"), F.min(own == F.col("own")).alias("own"))


_S2, _F2 = 0.3, 0.25 / (4 * 5)
_PAIR = [{0: fo.split(2, 0.04), 1: fo.leaf(0.0), 2: fo.leaf(0.0)}, {0: fo.split(0, 25.0), 1: fo.leaf(0.0), 2: fo.leaf(0.0)}]


def _gram(spark, sf):
    return gr.leaf_gram(items(spark, sf), _PAIR, xs(), (F.col("y") - 50000.0) / 100000.0)


# two trees of two leaves: the first is eliminated by division, which leaves a matrix of two by two
_CELLS = (
    f"c AS (SELECT (l_tax > 0.04)::INT AS a, (l_quantity > 25)::INT AS b, (y - 50000.0) / CAST(100000 AS DOUBLE) AS z FROM {ITEMS}), k AS (SELECT a, b, count(*)::DOUBLE AS n, sum(z) AS s FROM c GROUP BY 1, 2), "
    f"d AS (SELECT a, sum(n) + {_S2 / _F2!r} AS d, sum(s) AS r FROM k GROUP BY 1), e AS (SELECT b, sum(n) + {_S2 / _F2!r} AS d, sum(s) AS r FROM k GROUP BY 1), "
    "m AS (SELECT k.a, any_value(d.d) AS d, any_value(d.r) AS r, sum(n) FILTER (b = 0) AS n0, sum(n) FILTER (b = 1) AS n1 FROM k JOIN d USING (a) GROUP BY 1), "
    "t AS (SELECT (SELECT d FROM e WHERE b = 0) - sum(n0 * n0 / d) AS s00, -sum(n0 * n1 / d) AS s01, (SELECT d FROM e WHERE b = 1) - sum(n1 * n1 / d) AS s11, "
    "(SELECT r FROM e WHERE b = 0) - sum(n0 * r / d) AS v0, (SELECT r FROM e WHERE b = 1) - sum(n1 * r / d) AS v1, sum(r * r / d) AS f, sum(ln(d)) AS l FROM m)"
)


@query(
    f"WITH {_CELLS} SELECT round(-0.5 * (l + ln(s00 * s11 - s01 * s01) - 4 * ln({_S2 / _F2!r}) + ((SELECT sum(z * z) FROM c) - f - (s11 * v0 * v0 - 2 * s01 * v0 * v1 + s00 * v1 * v1) / (s00 * s11 - s01 * s01)) / {_S2!r}), 3) + 0.0 AS many FROM t"
)
def marginal_of_many_trees(spark, sf):
    """The likelihood of two trees at once, from counts of pairs of leaves."""
    return spark.createDataFrame([(round(gr.log_marginal_many(_gram(spark, sf), _S2, _F2), 3) + 0.0,)], "many double")


@query(
    f"WITH {_CELLS}, w AS (SELECT (s11 * v0 - s01 * v1) / (s00 * s11 - s01 * s01) AS w0, (s00 * v1 - s01 * v0) / (s00 * s11 - s01 * s01) AS w1 FROM t) "
    "SELECT 0 AS tree, (a + 1)::INT AS leaf, round((r - n0 * w0 - n1 * w1) / d, 6) + 0.0 AS mean FROM m, w UNION ALL SELECT 1, 1, round(w0, 6) + 0.0 FROM w UNION ALL SELECT 1, 2, round(w1, 6) + 0.0 FROM w"
)
def leaves_of_many_trees(spark, sf):
    g = _gram(spark, sf)
    mean, _ = gr.leaf_posterior_many(g, _S2, _F2)
    return spark.createDataFrame([(t, k, round(float(v), 6) + 0.0) for (t, k), v in zip(g.columns, mean, strict=True)], "tree int, leaf int, mean double")


@query(values([("change", 0, True, "change"), ("grow", 1, True, "prune"), ("prune", -1, True, "grow"), ("swap", 0, True, "swap")], "move, splits, filled, undone"))
def proposals(spark, sf):
    """What each move does to the number of splits; no leaf is left without rows."""
    n = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").orderBy("s_suppkey").toPandas().to_numpy(dtype=float)
    rng = np.random.default_rng(1)
    cuts = [np.unique(np.quantile(n[:, k], np.linspace(0, 1, 10, endpoint=False))) for k in range(2)]
    proposer = Proposer(n, cuts, Settings(), rng)
    tree = ChainTree.stump(len(n))
    for leaf, var, cut in ((0, 0, 4), (1, 1, 4), (2, 1, 7)):
        tree = tree.grow(n, leaf, var, float(cuts[var][cut]))
    rows = []
    for move in ("grow", "prune", "change", "swap"):
        made = [m[0] for m in (proposer.propose(tree, move) for _ in range(60)) if m is not None]
        step = {len(t.rules) - len(tree.rules) for t in made}
        rows.append((move, step.pop() if len(step) == 1 else None, bool(made) and all(set(t.at.tolist()) == set(t.leaves) for t in made), CONTRARY[move]))
    return spark.createDataFrame(rows, "move string, splits int, filled boolean, undone string")


@query(values([("dirichlet", True), ("fixed noise", True), ("logistic", True), ("own move", True), ("own prior", True), ("probit noise", True), ("start", True), ("temperature", True)], "part, holds"))
def chain_parts(spark, sf):
    """Facts of single chains over the suppliers."""
    n = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_suppkey").toPandas().to_numpy(dtype=float)
    x, y = n[:, :2], (n[:, 2] - n[:, 2].min()) / np.ptp(n[:, 2]) - 0.5
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 10, endpoint=False))) for k in range(2)]
    run = lambda s, **k: [st for _, st in RegressionChain(x, y, cuts, s, 1, **k).run()]
    small = {"n_trees": 4, "ndpost": 5, "nskip": 3}
    hot = []
    heat = Settings(**small, temperature=lambda k: hot.append(k) or 1.0 + 1.0 / (k + 1))
    rows = [("temperature", len(run(heat)) == 5 and sorted(set(hot)) == list(range(8)) and heat.heat(1) == 1.5)]
    rows.append(("dirichlet", all(abs(st["s"].sum() - 1) < 1e-9 and (st["s"] > 0).all() for st in run(Settings(**small, dirichlet=True)))))
    rows.append(("fixed noise", {st["sigma2"] for st in run(Settings(**small, fixed_sigma2=0.02))} == {0.02}))
    signs = RegressionChain(x, np.where(y > 0, 1.0, 0.0), cuts, Settings(**small), 1, probit=True)
    rows.append(("probit noise", {st["sigma2"] for _, st in signs.run()} == {1.0}))
    classes = LogisticChain(x, (y > 0).astype(int), cuts, Settings(**small, moves={"grow": 0.5, "prune": 0.5}), 1, 2)
    rows.append(("logistic", all(len(st["trees"]) == 2 and len(st["trees"][0]) == 4 for _, st in classes.run())))
    start = RegressionChain(x, y, cuts, Settings(**small), 1).start()
    rows.append(("start", start["sigma2"] > 0 and all(t.leaves == {0: 0.0} for t in start["trees"])))
    seen = []
    run(Settings(**small, prior=lambda t, s: seen.append(t) or 0.0))
    rows.append(("own prior", len(seen) > 0))
    own = RegressionChain(x, y, cuts, Settings(**small, moves={"stay": 1.0}, proposals={"stay": lambda p, t: (t, 0.0)}), 1)
    list(own.run())
    rows.append(("own move", own.proposer.counts == {"stay": [32, 32, 32]}))
    return spark.createDataFrame([(k, bool(v)) for k, v in rows], "part string, holds boolean")


# -- agents and simulations ------------------------------------------------------------------------------------------------------------


@query("SELECT (i // 4)::INT AS round, (i % 4)::INT AS arm FROM range(24) t(i)")
def warm_rounds(spark, sf):
    """The first choices of a tree agent: in each round every arm once."""
    agent = ag.TreeAgent(4, 2, warm=6, seed=9)
    made = [agent.choose([0.0, 0.0]) for agent.t in range(1, 25)]
    return spark.createDataFrame([(k // 4, a) for k, a in enumerate(made)], "round int, arm int")


def _held(arms: int = 2) -> ag.TreeAgent:
    """An agent with a literal model for each arm: four draws of one split each."""
    agent = ag.TreeAgent(arms, 2, encoding="separate", feel_good=0.1, warm=0, n_trees=1, ndpost=4)
    none = np.zeros(0, dtype=np.int64)
    agent.models = [[[ChainTree({0: (k % 2, 0.5)}, {1: -0.25 + 0.1 * k, 2: 0.1 * a + 0.2 * k}, none)] for k in range(4)] for a in range(arms)]
    agent.ranges, agent.score = [(0.0, 1.0)] * arms, np.zeros(4)
    return agent


_SPLIT = "if((if(k % 2 = 0, u, h)) <= 0.5, -0.25 + 0.1 * k, greatest(0.2 * k, 0.1 + 0.2 * k))"


@query(f"SELECT k::INT AS draw, round(sum(least(0.5, CAST({_SPLIT} AS DOUBLE))), 5) + 0.0 AS score FROM (SELECT value / CAST(100 AS DOUBLE) AS u, hour(ts) / CAST(24 AS DOUBLE) AS h FROM events), range(4) t(k) GROUP BY 1")
def feel_good_running(spark, sf):
    """Scores of the draws over the contexts of all events: each batch adds to them, and so do the tasks' sums."""

    def run(batches):
        agent = _held()
        for rows in batches:
            agent.score = agent.score + agent._good(rows[["u", "h"]].to_numpy(dtype=float)).sum(axis=0)
        yield pd.DataFrame({"draw": range(len(agent.score)), "score": agent.score})

    x = table(spark, sf, "events").select((F.col("value") / 100).alias("u"), (F.hour("ts") / 24).alias("h"))
    return x.mapInPandas(run, "draw int, score double").groupBy("draw").agg(r(F.sum("score"), 5).alias("score"))


@query(values([(0, 0.5), (1, 0.5)], "feature, inclusion"))
def agent_inclusion(spark, sf):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(_held().inclusion())], "feature int, inclusion double")


@query("SELECT agent, step::INT AS step, true AS same FROM range(12) t(step), (SELECT unnest(['random', 'trees', 'ts', 'ucb']) AS agent)")
def agent_json(spark, sf):
    rng, rows = np.random.default_rng(3), []
    made = {"random": ag.RandomAgent(3, 2, seed=1), "ucb": ag.LinearAgent(3, 2, "ucb"), "ts": ag.LinearAgent(3, 2, "ts", seed=4), "trees": ag.TreeAgent(3, 2, warm=2, n_trees=3, ndpost=10, nskip=2, seed=2)}
    for name, agent in made.items():
        for _ in range(12):
            x = rng.random(2)
            agent.update(agent.choose(x), x, float(x[0]))
        again = ag.from_json(ag.to_json(agent))
        rows += [(name, k, agent.choose([0.1 * k, 0.5]) == again.choose([0.1 * k, 0.5])) for k in range(12)]
    return spark.createDataFrame(rows, "agent string, step int, same boolean")


_TREES = {
    "regression": {"kind": "regression", "encoding": "multi"}, "one-hot": {"kind": "regression", "encoding": "one-hot"}, "separate": {"kind": "regression", "encoding": "separate"},
    "logistic": {"kind": "logistic", "encoding": "multi"}, "feel-good": {"kind": "regression", "feel_good": 0.2, "feel_good_eta": 4.0}, "switching": None,
}


@query(values([(k, True, True, True, True) for k in sorted(_TREES)], "agent, warmed, refitted, chose, weighed"))
def tree_agents(spark, sf):
    """Agents of all kinds over 40 contexts: their first choices are the warm rounds, they refit on the schedule, choose arms
    that exist, and weigh as many draws as they hold."""
    rows = []
    for name, spec in sorted(_TREES.items()):
        small = {"warm": 5, "n_trees": 3, "ndpost": 10, "nskip": 3, "seed": 6}
        agent = ag.SwitchingAgent(2, 2, switch=25, late_chains=2, early={"n_trees": 2, "nskip": 2}, **small) if spec is None else ag.TreeAgent(2, 2, **spec, **small)
        rng, chosen = np.random.default_rng(8), []
        for _ in range(40):
            x = rng.random(2)
            chosen.append(agent.choose(x))
            agent.update(chosen[-1], x, float(x[chosen[-1]] > 0.5))
        if name == "feel-good" and agent.settings["fixed_sigma2"] != 1 / 8:
            chosen.append(-1)
        rows.append((name, chosen[:10] == agent.queue, agent.refits > 0 and agent.models is not None, set(chosen) <= {0, 1}, len(agent.weights()) == len(agent.models[0]) and agent.effective() <= len(agent.models[0]) + 1e-9))
    return spark.createDataFrame(rows, "agent string, warmed boolean, refitted boolean, chose boolean, weighed boolean")


@query("SELECT probe::INT AS probe, arm::INT AS arm, true AS sized FROM range(3) p(probe), range(2) a(arm)")
def agent_diagnostics(spark, sf):
    agent, rng = ag.TreeAgent(2, 2, warm=6, chains=2, seed=5, n_trees=5, ndpost=40, nskip=10), np.random.default_rng(2)
    for _ in range(30):
        x = rng.random(2)
        agent.update(agent.choose(x), x, float(x[0]))
    return ag.diagnose(spark, agent, rng.random((3, 2))).select("probe", "arm", (F.col("ess_bulk") > 0).alias("sized"))


_BUCKET = "(hour(ts) // 6)::DOUBLE"


@query(
    f"WITH h AS (SELECT DISTINCT {_BUCKET} AS h FROM events), s AS (SELECT {_BUCKET} AS h, arm, avg((reward > 20)::INT) AS p FROM {LOG.replace('user_id, ts FROM', 'user_id, ts FROM')} GROUP BY 1, 2) "
    "SELECT h.h AS context, a.arm::INT AS arm, round(coalesce(p, 0.5), 6) + 0.0 AS chance FROM h CROSS JOIN range(6) a(arm) LEFT JOIN s ON s.h = h.h AND s.arm = a.arm"
)
def scenario_of_a_log(spark, sf):
    """Contexts and chances that a scenario takes from the log; the sixth arm was never played."""
    rows = log(spark, sf).withColumn("h", F.floor(F.hour("ts") / 6).cast("double"))
    s = sm.scenario_of_log(rows, ["h"], "arm", F.col("reward") > 20, 6)
    return spark.createDataFrame([(float(c[0]), a, round(float(p), 6) + 0.0) for c, by in zip(s.contexts, s.chances, strict=True) for a, p in enumerate(by)], "context double, arm int, chance double")


@query("SELECT scenario, agent, 300::BIGINT AS steps, true AS proper FROM (SELECT unnest(['linear', 'step']) AS scenario), (SELECT unnest(['mine', 'random', 'ts', 'ucb']) AS agent)")
def bandit_comparison(spark, sf):
    """Regret is never negative and every step of every simulation is there, also of an agent made by a function of one's own."""
    own = lambda arms, features, seed: ag.RandomAgent(arms, features, seed=seed)
    agents = {"random": {"agent": "random"}, "ucb": {"agent": "linear", "kind": "ucb"}, "ts": {"agent": "linear", "kind": "ts", "v": 0.3}, "mine": {"factory": own}}
    made = sm.compare(spark, {"linear": {"kind": "linear", "features": 4, "arms": 3}, "step": {"kind": "step", "features": 3, "arms": 3}}, agents, 3, 100)
    return made.groupBy("scenario", "agent").agg(F.count("*").alias("steps"), F.min((F.col("regret") >= 0) & F.col("arm").between(0, 2)).alias("proper"))


@query("SELECT agent, count(*) AS events, true AS proper FROM events, (SELECT unnest(['logged', 'random', 'ucb']) AS agent) GROUP BY 1")
def replayed_events(spark, sf):
    """Every event is replayed once by every agent, and matches are those of its first choice."""
    rows = log(spark, sf).select("t", F.array("x0", "x1").alias("x"), F.col("arm").alias("action"), "reward")
    ucb = {"agent": "linear", "arms": 5, "features": 2, "kind": "ucb"}
    a = sm.replay(rows, {"ucb": ucb, "random": {"agent": "random", "arms": 5, "features": 2}})
    made = a.unionByName(sm.replay(rows, {"logged": ucb}, mode="logged"))
    right = F.when(F.col("agent") == "logged", F.col("matched") == 1).otherwise((F.col("matched") == 1) == (F.col("first") == F.col("action")))
    return made.groupBy("agent").agg(F.count("*").alias("events"), F.min(right).alias("proper"))


@query("SELECT agent, count(*) AS events, true AS learned FROM events, (SELECT unnest(['random', 'ucb']) AS agent) GROUP BY 1")
def streamed_events(spark, sf):
    """The replay as a stream over files of the log: agents live in the state of the operator."""
    path = place(spark)
    log(spark, sf).select("t", F.array("x0", "x1").alias("x"), F.col("arm").alias("action"), "reward").repartitionByRange(3, "t").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("t long, x array<double>, action int, reward double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    specs = {"ucb": {"agent": "linear", "arms": 5, "features": 2, "kind": "ucb"}, "random": {"agent": "random", "arms": 5, "features": 2}}
    writer = sm.replay_stream(stream, specs, mode="logged").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/at")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("agent").agg(F.count("*").alias("events"), (F.min("matched") == 1).alias("learned"))


@query(values([(4, 12), (8, 24), (10, 30)], "step, sums"))
def simulation_callbacks(spark, sf):
    """Steps at which metrics are told, and the number of choices until then."""
    told, calls = [], []
    agents = {n: ag.RandomAgent(2, 3, seed=k) for k, n in enumerate("abc")}
    sm.simulate(sm.LinearScenario(3, 2, seed=2), agents, 10, on_draw=lambda t, a: calls.append(t), on_metrics=lambda t, s: told.append((t, len(s) * len(calls))), every=4)
    return spark.createDataFrame(told, "step int, sums int")


@query("SELECT probe::INT AS probe, arm::INT AS arm, true AS near FROM range(2) p(probe), range(5) a(arm)")
def linear_posterior(spark, sf):
    """Means of Thompson draws against the means of the posterior, within five standard errors."""
    from thicket.queries import statistics

    agent = ag.LinearAgent.from_sums(sm.gather_statistics(statistics(spark, sf), 2, 5), kind="ts", seed=3)
    probes = np.array([[0.0, 0.5], [1.0, 0.5]])
    d, z = agent.draws(probes, 400), np.column_stack([probes, np.ones(2)])
    mean = np.array([z @ np.linalg.solve(agent.b[a], agent.m[a]) for a in range(5)]).T
    return spark.createDataFrame([(p, a, bool(abs(d[:, p, a].mean() - mean[p, a]) < 5 * d[:, p, a].std() / 20)) for p in range(2) for a in range(5)], "probe int, arm int, near boolean")


@query(values([("flat", 1.0), ("least squares", 1.0)], "model, best"))
def agent_of_any_model(spark, sf):
    """An agent with a model from outside: least squares, and a target with one value, for which no model is asked."""

    def least_squares(x, y, seed):
        w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        return lambda z, k: np.column_stack([np.ones(len(z)), z]) @ w

    rows = []
    for name, reward in (("least squares", float), ("flat", lambda a: 1.0)):
        agent = ag.make({"agent": "model", "fit": least_squares, "arms": 2, "features": 1, "warm": 4, "schedule": "sqrt"}, 3)
        for _ in range(60):
            a = agent.choose([0.5])
            agent.update(a, [0.5], reward(a))
        rows.append((name, round(max(float(np.ravel(agent.model(ag.encode(np.array([0.5]), a, 2, "multi"), 0))[0]) for a in range(2)), 6)))
    return spark.createDataFrame(rows, "model string, best double")


@query("SELECT t, round(x0, 6) + 0.0 AS e0, round(x1, 6) + 0.0 AS e1 FROM " + LOG)
def encode_separate(spark, sf):
    made = log(spark, sf).withColumn("e", pp.encode_arm(F.array("x0", "x1"), F.col("arm"), 5, 2, "separate"))
    return pp.encode_all_arms(made.drop("arm"), "e", 5, 2, "separate").select("t", r(F.get("encoded", 0)).alias("e0"), r(F.get("encoded", 1)).alias("e1"))


@query("SELECT count(*) AS n, true AS inside, true AS varied FROM events")
def prior_source(spark, sf):
    """Features of the grid lie in the unit cube, and targets stray from the forest's sum."""
    from thicket.sources.prior import prior_predictive

    made = prior_predictive(spark, table(spark, sf, "events").count(), 3, n_trees=20, latent=True)
    inside = (F.least("x0", "x1", "x2") >= 0) & (F.greatest("x0", "x1", "x2") <= 1)
    return made.agg(F.count("*").alias("n"), F.min(inside).alias("inside"), (F.stddev(F.col("y") - F.col("f")) > 0).alias("varied"))


@query(f"SELECT l_returnflag, round(avg((y - 900) / CAST(100000 AS DOUBLE) - 0.5), 6) + 0.0 AS mean FROM {ITEMS} GROUP BY 1")
def own_preprocessor(spark, sf):
    """A preprocessor of one's own: a range that is given, not fitted."""

    class Given(pp.Preprocessor):
        def fit(self, df):
            super().fit(df)
            self.low, self.high = 900.0, 100900.0
            return self

    made = Given(["l_tax"], "y", 2).fit(items(spark, sf)).transform(items(spark, sf), "z")
    return made.groupBy("l_returnflag").agg(r(F.avg("z")).alias("mean"))
