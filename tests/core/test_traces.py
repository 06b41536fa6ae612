import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_boxes import grown

from thicket.operators import forest as fo
from thicket.operators import traces as tr

TRACE = "k int, weight double, trees array<array<struct<node:int,var:int,thr:double,leaf:double>>>"


def rows_of(forest):
    return [[(i, n.var, n.thr, n.leaf) for i, n in deal_order(t)] for t in forest]


def deal_order(tree):
    """Nodes in no order at all."""
    nodes = list(tree.items())
    random.Random(len(nodes)).shuffle(nodes)
    return nodes


def value(forest, x):
    out = 0.0
    for tree in forest:
        i = 0
        while tree[i].var >= 0:
            i = 2 * i + 1 if x[tree[i].var] <= tree[i].thr else 2 * i + 2
        out += tree[i].leaf
    return out


@pytest.fixture(scope="module")
def trace(spark):
    deal = random.Random(6)
    draws = [(k // 2, [1.0, 0.25, -2.0][k % 3], [grown(deal, deal.randrange(6), 2) for _ in range(3)]) for k in range(14)]
    draws.append((3, 0.5, [{0: fo.leaf(2.0)}]))
    df = spark.createDataFrame([(k, w, rows_of(f)) for k, w, f in draws], TRACE).repartition(3)
    return draws, df




def points(n=90):
    deal = random.Random(7)
    return [(i, [deal.uniform(-1, 2), deal.randrange(8) / 4]) for i in range(n)] + [(n, [float("nan"), float("inf")])]


@pytest.mark.parametrize(("pass_bytes", "chunk_bytes"), [(1 << 26, 1 << 23), (1 << 26, 600), (2500, 600), (1, 1)])
def test_one_pass_and_many_give_the_same(spark, trace, monkeypatch, pass_bytes, chunk_bytes):
    draws, given = trace
    monkeypatch.setattr(tr, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(tr, "BLOCK_BYTES", 64 * 8)
    rows = points()
    df = spark.createDataFrame(rows, "id int, x array<double>").repartition(3)
    got = tr.evaluated(df, given, F.col("k"), F.col("weight"), 7, "x", "f", pass_bytes)
    assert got.columns == ["id", "x", "f"]
    of = dict(rows)
    found = {r["id"]: r["f"] for r in got.collect()}
    assert set(found) == set(of)
    for i, f in found.items():
        want = np.zeros(7)
        for k, w, forest in draws:
            want[k] += w * value(forest, of[i])
        assert f == pytest.approx(want.tolist())


def test_broadcasts_stay_under_the_limit(trace):
    packed = tr.pack(trace[1], F.col("k"), F.col("weight"))
    n = packed.agg(F.sum(F.octet_length("blob"))).first()[0]
    assert tr.packed_bytes(trace[1]) == n
    passes = [[b for c in chunks for *_, b in c.value] for chunks in tr._passes(packed, 2500, False)]
    assert len(passes) > 1 and sum(len(b) for p in passes for b in p) == n
    assert all(len(p) == 1 or sum(map(len, p)) <= 2500 for p in passes)
    assert [len(p) for p in tr._passes(packed, 1, False)] == [1] * 15


@pytest.mark.parametrize("pass_bytes", [1 << 26, 2500])
def test_rows_meet_the_draws_of_their_group(spark, trace, pass_bytes):
    draws, given = trace
    rows = [(i, x, [None, "g0", "g1", "none"][i % 4]) for i, x in points(40)]
    df = spark.createDataFrame(rows, "id int, x array<double>, g string")
    of = F.concat(F.lit("g"), F.col("k") % 2)
    got = {r["id"]: r["f"] for r in tr.evaluated(df, given, F.floor(F.col("k") / 2), F.col("weight"), 4, "x", "f", pass_bytes, of, "g").collect()}
    for i, x, g in rows:
        want = np.zeros(4)
        for k, w, forest in draws:
            want[k // 2] += w * value(forest, x) if g == f"g{k % 2}" else 0.0
        assert got[i] == pytest.approx(want.tolist())


def test_without_draws_or_rows(spark, trace):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "id int, x array<double>")
    assert tr.evaluated(df, trace[1].where("k > 99"), F.col("k"), F.col("weight"), 2, "x", "f").first()["f"] == [0.0, 0.0]
    assert tr.evaluated(df.where("id > 1"), trace[1], F.col("k"), F.col("weight"), 7, "x", "f").count() == 0


def test_broken_trees():
    a = lambda *v: np.array(v)
    with pytest.raises(ValueError):
        tr.pack_forest(a(0, 0), a(0, 1), a(0, -1), a(0.5, 0.0), a(0.0, 1.0))
    assert tr.PackedForest(tr.pack_forest(*[np.zeros(0)] * 5))(np.zeros((2, 1))).tolist() == [0.0, 0.0]
