import random

import pytest
from pyspark.sql import functions as F

from thicket.operators import boxes as bx
from thicket.operators import forest as fo

NODES = "tree int, node long, var int, thr double"


def grown(deal, depth, features):
    """A random tree; thresholds are coarse, so that rows lie on them and some boxes are empty."""
    tree, todo = {}, [(0, 0)]
    while todo:
        i, d = todo.pop()
        if d == depth or (d and deal.random() < 0.2):
            tree[i] = fo.leaf(float(i))
            continue
        tree[i] = fo.split(deal.randrange(features), deal.randrange(8) / 4)
        todo += [(2 * i + 1, d + 1), (2 * i + 2, d + 1)]
    return tree


def nodes_of(spark, forest):
    rows = [(k, i, n.var, n.thr) for k, t in enumerate(forest) for i, n in t.items()]
    return spark.createDataFrame(rows, NODES)


def leaf_of(tree, x):
    i = 0
    while tree[i].var >= 0:
        v = x[tree[i].var]
        i = 2 * i + 1 if v is not None and v == v and v <= tree[i].thr else 2 * i + 2
    return i


def points(deal, n):
    rows = [(k, *(deal.choice([deal.randrange(9) / 4, deal.uniform(-1, 3)]) for _ in range(3))) for k in range(n)]
    return rows + [(n, None, 1.0, 1.0), (n + 1, float("nan"), 0.0, None), (n + 2, float("inf"), float("-inf"), 0.25), rows[0]]


@pytest.mark.parametrize("cells", [None, 1, 7, 5000])
def test_every_row_meets_the_leaf_that_its_tree_sends_it_to(spark, cells):
    deal = random.Random(4)
    forest = [grown(deal, d, 3) for d in (0, 1, 4, 7)]
    rows = points(deal, 150)
    boxes = bx.leaf_boxes(nodes_of(spark, forest), ["tree"], 3)
    made = bx.join_boxes(spark.createDataFrame(rows, "id int, a double, b double, c double"), [F.col(c) for c in "abc"], boxes, cells)
    assert made.columns == ["id", "a", "b", "c", "tree", "leaf"]
    got = sorted((r["id"], r["tree"], r["leaf"]) for r in made.collect())
    assert got == sorted((r[0], k, leaf_of(t, r[1:])) for r in rows for k, t in enumerate(forest))


def test_boxes_are_those_of_the_tree(spark):
    deal = random.Random(9)
    tree = grown(deal, 5, 3)
    got = {r["leaf"]: [(r[f"lo_{f}"], r[f"hi_{f}"]) for f in range(3)] for r in bx.leaf_boxes(nodes_of(spark, [tree]), ["tree"], 3).collect()}
    inf = float("inf")
    want = {i: [(None if lo == -inf else lo, None if hi == inf else hi) for lo, hi in box] for i, box in fo.boxes(tree, 3) if all(lo < hi for lo, hi in box)}
    assert got == want


def test_no_nested_loop_and_the_same_by_shuffle(spark, monkeypatch):
    deal = random.Random(5)
    forest = [grown(deal, 6, 3)]
    rows = spark.createDataFrame(points(deal, 100), "id int, a double, b double, c double")
    boxes = bx.leaf_boxes(nodes_of(spark, forest), ["tree"], 3)
    x = [F.col(c) for c in "abc"]
    sent = bx.join_boxes(rows, x, boxes)
    monkeypatch.setattr(bx, "BOXES_AT_ONCE", 3)
    dealt = bx.join_boxes(rows, x, boxes)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (sent, dealt)]
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)
    assert sorted(map(tuple, sent.select("id", "leaf").collect())) == sorted(map(tuple, dealt.select("id", "leaf").collect()))


def test_cells_follow_the_bounds(spark):
    rows = [(k, None, None, k / 100, (k + 1) / 100) for k in range(100)]
    boxes = spark.createDataFrame(rows, "leaf int, lo_0 double, hi_0 double, lo_1 double, hi_1 double")
    found = bx.Cells.of(boxes, 2)
    assert found.cuts[0] == [] and 80 < len(found.cuts[1]) <= 200
    met = boxes.select(F.size(found.of_box()).alias("n"))
    assert met.agg(F.max("n")).first()[0] <= 3


def test_without_rows_or_boxes(spark):
    empty = spark.createDataFrame([], "id int, a double")
    boxes = bx.leaf_boxes(spark.createDataFrame([(0, 0, -1, None)], NODES), ["tree"], 1)
    assert bx.join_boxes(empty, [F.col("a")], boxes).count() == 0
    assert bx.join_boxes(spark.createDataFrame([(1, 2.0)], "id int, a double"), [F.col("a")], boxes.where("leaf < 0")).count() == 0
    assert bx.join_boxes(spark.createDataFrame([(1, 2.0)], "id int, a double"), [F.col("a")], boxes).first()["leaf"] == 0
