import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm.common import mix64
from thicket.llm.mix import mix, mixed_order, period, schedule, units
from thicket.llm.shard import assign_shards, jump, sharded

DOCS = "doc_id long, text string, source string, shard string, slot string, block int"
ROWS = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"text é {i}", None if i % 5 == 0 else f"s{i % 3}", "x", "y", 1) for i in range(60)]
ROWS += [ROWS[3]] * 3 + [(None, "no id", "s1", "x", "y", 1)] * 2


def jump_by_hand(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_scalar_form_and_moves_rows_only_to_the_new_shard():
    keys = mix64(np.arange(3000, dtype=np.uint64))
    for n in (1, 2, 8, 9, 100):
        assert jump(keys, n).tolist() == [jump_by_hand(int(k), n) for k in keys]
    a, b = jump(keys, 8), jump(keys, 9)
    assert set(b[a != b]) == {8}
    assert abs((a != b).mean() - 1 / 9) < 0.03


def test_assign_shards(spark):
    got = assign_shards(spark.createDataFrame(ROWS, DOCS), 4, rows_per_block=7).collect()
    assert len(got) == len(ROWS)
    for shard in range(4):
        own = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        key = int(mix64(np.array([r["doc_id"] or 0], dtype=np.uint64))[0])
        assert (r["shard"], r["grown_shard"]) == (jump_by_hand(key, 4), jump_by_hand(key, 5))


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert assign_shards(empty).count() == 0
    assert mix(empty).count() == 0


def test_sharded_keeps_the_written_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "doc_id long, place long")
    docs.orderBy("place").write.parquet(str(tmp_path / "d"))
    got = sharded(spark.read.parquet(str(tmp_path / "d")), 3, rows_per_block=10).collect()
    for shard in range(3):
        own = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert [r["place"] for r in own] == sorted(r["place"] for r in own)


@pytest.mark.parametrize("shares", [{"a": 9, "b": 1}, {"a": 5, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}, {"x": 1}, {"a": 7, "b": 11, "c": 13, "d": 69}])
def test_period_keeps_each_source_within_one_block(shares):
    slots = period(shares)
    total = sum(shares.values())
    assert sorted(s for own in slots.values() for s in own) == list(range(total))
    for s, own in slots.items():
        for t in range(1, total + 1):
            assert abs(sum(x < t for x in own) - Fraction(shares[s], total) * t) < 1


def test_schedule_places_every_block_once_and_follows_renormalised_weights():
    blocks = {"a": 50, "b": 7, "c": 0, "d": 23}
    plan = schedule(blocks, {"a": 0.2, "b": 0.5, "c": 1.0, "d": 0.3}, 100)
    slots = {s: plan.slots(s, np.arange(n)) for s, n in blocks.items() if n}
    assert sorted(np.concatenate(list(slots.values()))) == list(range(80))
    end = max(slots["b"]) + 1  # b is used up first
    for s, w in (("a", 0.2), ("b", 0.5), ("d", 0.3)):
        for t in range(1, end + 1):
            assert abs((slots[s] < t).sum() - w * t) < 1 + 1e-9
    assert sum(units({"a": 1e-9, "b": 1.0, "c": 3.0}, 100).values()) == 100


@pytest.mark.parametrize("power", [0.5, 4.0])
def test_schedule_follows_targets_that_are_no_round_shares_to_within_one_block(power):
    rows = {"a": 200_000} | {f"s{k}": 21_000 for k in range(19)}
    blocks = {s: -(-n // 32) for s, n in rows.items()}
    weights = {s: float(n) ** power for s, n in rows.items()}
    plan = schedule(blocks, weights)
    slots = {s: plan.slots(s, np.arange(n)) for s, n in blocks.items()}
    assert sorted(np.concatenate(list(slots.values()))) == list(range(sum(blocks.values())))
    end = min(own.max() for own in slots.values()) + 1
    for s, own in slots.items():
        target = weights[s] / sum(weights.values()) * np.arange(1, end + 1)
        assert np.abs(np.searchsorted(own, np.arange(1, end + 1)) - target).max() < 1 + 1e-9


def test_mix_places_all_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = mix(docs, block_rows=4, rows_per_block=9).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    seen = {(r["source"], r["block"]): set() for r in got}
    for r in got:
        seen[(r["source"], r["block"])].add((r["slot"], r["place"]))
    for (source, block), places in seen.items():
        assert len({s for s, _ in places}) == 1
        n = sum(r["source"] == source and r["block"] == block for r in got)
        assert sorted(p for _, p in places) == list(range(n))
    slots = {s for places in seen.values() for s, _ in places}
    assert slots == set(range(len(seen)))


def test_weights_leave_the_others_for_later(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = mix(docs, {"s0": 1.0, None: 3.0}, block_rows=2).collect()
    late = [r["slot"] for r in got if r["source"] in ("s1", "s2")]
    assert len(got) == len(ROWS) and min(late) > max(r["slot"] for r in got if r["source"] in ("s0", None))


def test_mixed_order_returns_the_columns(spark):
    docs = spark.createDataFrame(ROWS, DOCS).select("doc_id", "source", "text")
    out = mixed_order(docs, block_rows=4)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert out.where(F.col("doc_id").isNull()).count() == 2


def test_mixed_order_does_not_depend_on_how_a_scan_is_planned(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"text {i}") for i in range(400)], "doc_id long, source string, text string")
    docs.repartition(8).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    want = {(r["slot"], r["place"]): r["doc_id"] for r in mix(read, block_rows=4).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = mixed_order(read, block_rows=4)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [r["doc_id"] for r in out.select("*").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [want[k] for k in sorted(want)]


def test_mixed_order_keeps_rows_that_share_a_place_in_a_file_or_have_none(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(50)], "doc_id long, source string")
    docs.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    twice = read.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    got = sorted(tuple(r) for r in mixed_order(twice, block_rows=4).collect())
    assert got == sorted((i, f"s{i % 3}", c) for i in range(50) for c in (0, 1))
    assert mixed_order(read.where("doc_id % 2 = 0"), block_rows=4).count() == 25
    assert mixed_order(docs.limit(7), block_rows=4).count() == 7
