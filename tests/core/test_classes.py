"""Predictive classes: drawn where the forests are evaluated, many rows at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thicket.functions import special as sp
from thicket.functions.columns import normal_cdf
from thicket.operators import posterior as po
from thicket.operators import traces as tr
from thicket.operators.forest import vectors
from thicket.queries import items
from thicket.queries_parts import literal


@pytest.fixture(scope="module")
def rows(spark, sf):
    return items(spark, sf).select("*", F.monotonically_increasing_id().alias("row_id")).where("row_id % 3 = 0").cache()


@pytest.fixture(scope="module", params=["probit", "logistic"])
def model(spark, request):
    return literal(spark, request.param, categories=2 if request.param == "logistic" else 1)


def test_one_pass_makes_probabilities_and_classes(model, rows):
    made = model.posterior_predict(rows, "row_id", 4, proba="p")
    assert made.columns == [*rows.columns, "p", "predicted"]
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert model.posterior_predict(rows, "row_id", 4).columns == [*rows.columns, "predicted"]


def test_classes_are_those_of_the_probabilities(model, rows):
    made = model.posterior_predict(rows.repartition(3), "row_id", 4, proba="p").orderBy("row_id").toPandas()
    draw = po.predictive_binary if model.kind == "probit" else po.predictive_class
    from_columns = draw(model.proba(rows), "row_id", 4).orderBy("row_id").toPandas()
    assert len(made) == rows.count() and made["row_id"].tolist() == from_columns["row_id"].tolist()
    assert np.array_equal(np.stack(made["predicted"]), np.stack(from_columns["predicted"]))
    other = model.posterior_predict(rows, "row_id", 5).orderBy("row_id").toPandas()
    assert (np.stack(made["predicted"]) != np.stack(other["predicted"])).mean() > 0.2


def test_probabilities_follow_from_the_draws(model, rows):
    given = model.posterior_f(rows)
    if model.kind == "probit":
        given = given.withColumn("e", F.transform("draws", normal_cdf))
    else:
        one = lambda z: F.transform(z, lambda v: F.exp(v) / (F.exp(z[0]) + F.exp(z[1])))
        given = given.withColumn("e", F.transform("draws", one))
    got = model.proba(given, "p").select(F.flatten("p").alias("p") if model.kind == "logistic" else "p", F.flatten("e").alias("e") if model.kind == "logistic" else "e").toPandas()
    assert np.allclose(np.stack(got["p"]), np.stack(got["e"]), rtol=0, atol=1e-12)


def test_names_that_are_there_are_replaced(model, rows):
    made = model.posterior_predict(rows.withColumn("predicted", F.lit("old")).withColumn("p", F.lit(0)), "row_id", 4, proba="p")
    assert made.columns == [*rows.columns, "predicted", "p"]
    assert made.select(F.size("p").alias("p"), F.size("predicted").alias("c")).distinct().collect() == [(8, 8)]


def test_columns_made_of_sums_in_several_passes(spark, rows):
    trace = literal(spark).trace
    df = rows.select("row_id", F.array("l_quantity", "l_discount", "l_tax", "month").alias("x"))
    args = (df, trace, F.col("chain") * 4 + F.col("draw"), F.lit(1.0), 8, "x", "f")

    def make(batch, sums):
        return [tr.listed(sums[:, ::-1]), pa.array(vectors(batch.column(1))[:, 0])]

    plain = {r["row_id"]: r["f"] for r in tr.evaluated(*args).collect()}
    for pass_bytes in (tr.PASS_BYTES, 1 + tr.packed_bytes(trace) // 3):
        made = tr.evaluated(*args, pass_bytes, then=("back array<double>, q double", make))
        assert made.columns == ["row_id", "back", "q"]
        assert {r["row_id"]: r["back"][::-1] for r in made.collect()} == plain
        assert made.agg(F.sum("q")).first()[0] == rows.agg(F.sum("l_quantity")).first()[0]
    none = tr.evaluated(df, trace.where("draw > 99"), F.lit(0), F.lit(1.0), 2, "x", "f", then=("s array<double>", lambda batch, sums: [tr.listed(sums)]))
    assert none.count() == df.count() and none.first()["s"] == [0.0, 0.0]


def test_uniforms():
    keys = np.concatenate([np.arange(50_000), np.arange(50_000) + (7 << 33)])
    u = po.uniforms(keys, 4, 8)
    assert u.min() >= 0 and u.max() < 1 and len(np.unique(u)) == u.size
    assert abs(u.mean(axis=0) - 0.5).max() < 5 / np.sqrt(12 * len(u))
    counts = np.stack([np.bincount((c * 64).astype(int), minlength=64) for c in u.T])
    assert (((counts - len(u) / 64) ** 2).sum(axis=1) / (len(u) / 64)).max() < 63 + 5 * np.sqrt(126)
    with_next = [np.corrcoef(u[:-1, k], u[1:, k])[0, 1] for k in range(8)]
    between = np.corrcoef(u.T)[np.triu_indices(8, 1)]
    assert max(np.abs(with_next).max(), np.abs(between).max(), abs(np.corrcoef(u[:, 0], po.uniforms(keys, 5, 8)[:, 0])[0, 1])) < 5 / np.sqrt(len(u))
    assert np.array_equal(po.uniforms([3, -1, 2**63], 4, 8)[0], u[3])
    assert np.array_equal(po.uniforms(np.array([-1], np.int32), 4, 8), po.uniforms([-1], 4, 8))


def test_keys_of_other_types_and_rows_of_other_lengths(spark):
    df = spark.createDataFrame([(1, [0.2, 0.7]), (-2, [0.4]), (3, []), (4, [0.0, 1.0, 0.5])], "id long, proba array<double>")
    by = lambda d: [r["predicted"] for r in po.predictive_binary(d, "id", 1).collect()]
    want = [(po.uniforms([k], 1, len(p))[0] < p).astype(int).tolist() for k, p in df.collect()]
    assert by(df) == by(df.withColumn("id", F.col("id").cast("int"))) == by(df.withColumn("id", F.col("id").cast("decimal(20,0)"))) == want
    with pytest.raises(Exception, match="int"):
        po.predictive_binary(df.withColumn("id", F.lit(None).cast("long")), "id", 1).collect()


def test_classes_by_the_distribution_function():
    p = np.array([[[0.2, 0.3, 0.5]] * 6])
    u = np.array([[0.0, 0.19, 0.2, 0.49, 0.51, 0.999]])
    assert po.drawn_class(p, u).tolist() == [[0, 0, 1, 1, 2, 2]]
    assert po.drawn_class(2 * p, u).tolist() == [[0, 0, 1, 1, 2, 2]]  # weights that don't sum to 1
    assert po.drawn_class(np.ones((1, 1, 1)), np.array([[0.7]])).tolist() == [[0]]
    assert np.allclose(sp.softmax(np.array([[0.0, 1000.0], [-3.0, -3.0]])), [[0, 1], [0.5, 0.5]])
    x = np.linspace(-9, 9, 1001)
    assert np.abs(sp.normal_cdf_near(x) - sp.normal_cdf(x)).max() < 1.5e-7
