import json
import math
import random

import pytest
from pyspark.sql import functions as F

from thicket.operators import forest as fo
from thicket.operators import posterior as po
from thicket.sources import dumps as du
from thicket.streaming.leaves import LeafSums


def dumped(deal, depth, ids):
    here = next(ids)
    if depth == 0 or deal.random() < 0.2:
        return {"nodeid": here, "leaf": deal.uniform(-1, 1)}
    a, b = dumped(deal, depth - 1, ids), dumped(deal, depth - 1, ids)
    children = [a, b] if deal.random() < 0.5 else [b, a]
    name = deal.choice([{"split": f"f{deal.randrange(5)}"}, {"split": deal.randrange(5)}, {"split_feature": deal.randrange(5)}])
    return {"nodeid": here, **name, "split_condition": deal.choice([0.5, -0.25, 0, 3, 1e-3, -7.5e10]), "yes": a["nodeid"], "no": b["nodeid"], "children": children}


def test_dumps_are_unfolded_as_by_recursion(spark, tmp_path):
    deal = random.Random(3)
    trees = [dumped(deal, k % 6, iter(range(10_000))) for k in range(40)]
    (tmp_path / "dump.txt").write_text("\n".join(map(json.dumps, trees)) + "\n\n")
    read = du.read_dumps(spark, str(tmp_path / "dump.txt"))
    got = {}
    for r in du.boosted_nodes(read, ["tree"]).collect():
        got.setdefault(r["tree"], {})[r["node"]] = fo.leaf(r["leaf"]) if r["var"] < 0 else fo.split(r["var"], r["thr"])
    assert [got[k] for k in sorted(got)] == fo.from_boosted(trees)


def test_the_next_double_below(spark):
    deal = random.Random(1)
    values = [0.0, 1.0, -1.0, 0.5, 2.0**-1022, -(2.0**-1022), 2.0**-1021, 5e-324, 2.0**1000, 1e308, -1e308] + [deal.uniform(-1, 1) * 10 ** deal.uniform(-300, 300) for _ in range(500)] + [s * 2.0**k for s in (1, -1) for k in range(-1020, 1020, 40)]
    got = spark.createDataFrame([(v,) for v in values], "t double").select("t", du.below(F.col("t")).alias("b")).collect()
    assert all(r["b"] == math.nextafter(r["t"], -math.inf) for r in got)


def test_broken_dumps(spark):
    bad = {"nodeid": 0, "split": 1, "split_condition": 1.0, "yes": 1, "no": 3, "children": [{"nodeid": 1, "leaf": 1.0}, {"nodeid": 2, "leaf": 1.0}]}
    with pytest.raises(Exception, match="lacks a child"):
        du.boosted_nodes(spark.createDataFrame([(1, json.dumps(bad))], "tree int, dump string"), ["tree"]).collect()
    assert du.boosted_nodes(spark.createDataFrame([(1, None)], "tree int, dump string"), ["tree"]).count() == 0
    with pytest.raises(Exception):
        du.boosted_nodes(spark.createDataFrame([(1, "{no")], "tree int, dump string"), ["tree"]).collect()


def test_json_forests(spark):
    forest = [{0: fo.split(1, 0.5), 1: fo.leaf(2.0), 2: fo.leaf(-1.0)}, {0: fo.leaf(3.0)}]
    df = spark.createDataFrame([("a", fo.to_json(forest)), ("b", None)], "model string, forest string")
    got = sorted(tuple(r) for r in du.json_nodes(df, ["model"]).collect())
    assert got == sorted(("a", t, i, n.var, n.thr, n.leaf) for t, tree in enumerate(forest) for i, n in tree.items())


# -- sketches -------------------------------------------------------------------------------------------------------------


def test_sketches_of_chains_and_chunks_merge_within_their_error(spark):
    k = 200
    df = spark.range(60_000).select((F.col("id") % 2).alias("row"), (F.col("id") % 3).alias("chain"), (F.col("id") % 1000 > 300).alias("chunk"), F.exp(F.sin(F.col("id").cast("double") * 12.9898) * 3).alias("f"))
    merged = po.merged_sketches(po.sketches(df, ["row", "chain", "chunk"], k=k), ["row"])
    for r in po.sketch_intervals(merged, 0.9).collect():
        own = sorted(x["f"] for x in df.where(F.col("row") == r["row"]).collect())
        for q, v in ((0.05, r["lo"]), (0.95, r["hi"])):
            rank = sum(x <= v for x in own) / len(own)
            assert abs(rank - q) <= po.rank_error(k) + 1e-4
    assert merged.agg(F.max(F.octet_length("sketch"))).first()[0] < 16 * 8 * k


def test_sketches_of_few_draws_are_exact(spark):
    df = spark.createDataFrame([(k % 3, float((k * 37) % 101)) for k in range(303)], "row int, f double")
    for r in po.sketch_intervals(po.merged_sketches(po.sketches(df, ["row"]), ["row"]), 0.8).collect():
        own = sorted(float((k * 37) % 101) for k in range(303) if k % 3 == r["row"])
        assert (r["lo"], r["hi"]) == (own[math.ceil(0.1 * 101) - 1], own[math.ceil(0.9 * 101) - 1])


# -- streams --------------------------------------------------------------------------------------------------------------


def test_a_stream_that_is_restarted_equals_the_batch(spark, tmp_path):
    rows = [(k, k % 4 if k % 11 else None, None if k % 7 == 0 else float(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, leaf int, r double")
    for part in range(6):
        df.where(F.col("id") % 6 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sums = {"s": F.col("r"), "s2": F.col("r") * F.col("r")}

    def state():
        return LeafSums(spark, str(tmp_path / "state"), ["leaf"], sums, compact_every=2)

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    failed, seen = [], []

    def breaks(batch, number):
        """The first run ends after a batch was written, but before it was committed."""
        state().append(batch, number)
        seen.append(number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    def run():
        return stream().writeStream.foreachBatch(breaks).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    run().awaitTermination()
    assert seen.count(2) == 2 and max(seen) >= 5
    got = {r["leaf"]: (r["n"], r["s"], r["s2"]) for r in state().read().collect()}
    want = {r["leaf"]: (r["n"], r["s"], r["s2"]) for r in state().partial(df).collect()}
    assert got == want
    state().append(df, 1)  # a batch that a base holds
    assert {r["leaf"]: r["n"] for r in state().read().collect()} == {k: v[0] for k, v in want.items()}
    assert json.loads(state().describe())["base"] is not None
    assert LeafSums(spark, str(tmp_path / "none"), ["leaf"], sums).read() is None
