import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from thicket.llm.resample import Buckets, Tournament, counted, drawn, gains, in_range, ranges, resample, scored, steps

SCHEMA = "doc_id long, text string, rank string, row int, score string"


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return words, [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def by_hand(rows, target, share=(5, 100), least=20, buckets=10_000):
    """The contract row by row."""
    of = lambda f: zlib.crc32(f) % buckets
    source, wanted = Counter(of(f) for _, t in rows for f in features(t)[1]), Counter(of(f) for t in target for f in features(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(f)] for f in found)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: len(able) * share[0] // share[1]], 1):
        r[4] = rank
    return out


def same(got, want):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted((tuple(w[:5]) for w in want), key=order)


def texts(n, seed=1):
    deal = random.Random(seed)
    words = ["ab", "x", "é" * 40, "word7", "q" * 100, "Zz!", "--", "İ", "日本", "a1,b2"]
    return [" ".join(deal.choice(words) for _ in range(deal.randint(0, 60))) for _ in range(n)]


def test_buckets_are_the_checksums_of_whole_features():
    given = [t.encode() for t in texts(150)] + [None, b"", b"z" * 3000, b"a " * 3000]
    of = Buckets(997, 3)
    for _ in range(2):
        n_words, owners, found = of.of(given)
        for t, raw in enumerate(given):
            words, want = features((raw or b"").decode())
            assert n_words[t] == len(words)
            assert [b for n in range(3) for b in found[n][owners[n] == t].tolist()] == [zlib.crc32(f) % 997 for f in want]
        of.forget()


def test_tournament_takes_the_least_heads_and_stops():
    deal = random.Random(2)
    for _ in range(300):
        runs = [sorted((deal.randint(0, 20), deal.randint(0, 3)) for _ in range(deal.randint(0, 8))) for _ in range(deal.randint(0, 9))]
        n = deal.randint(0, 40)
        assert list(Tournament(runs).take(n)) == sorted(sum(runs, []))[:n]


def test_ranges_are_even_whatever_is_frequent(spark):
    keys = np.array([(0, 5, k) for k in range(900)] + [(k % 7 - 3, k, 1000 + k) for k in range(600)])
    runs = []
    for run, at in enumerate(np.array_split(np.random.default_rng(0).permutation(1500), 4)):
        own = keys[at][np.lexsort(keys[at].T[::-1])]
        runs += [(*map(int, k), (run << 33) + place) for place, k in enumerate(own)]
    starts = ranges(spark.createDataFrame(runs, "down long, id long, row long, at long"), 1500, 100)
    part = in_range(keys, starts)
    assert [tuple(k) for k in starts] == sorted(tuple(k) for k in starts) and part.max() == 15
    assert part.tolist() == [sum(tuple(s) <= tuple(k) for s in starts.tolist()) for k in keys.tolist()]
    assert np.bincount(part).max() <= 100 + 4 * 6


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_draw(spark, range_rows):
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts(150))]
    rows += [(200, "common words " * 20, "x", 1, "y")] * 60 + [(None, "no id " * 15, "x", 1, "y"), (None, None, "x", 1, "y"), (300, "", "x", 1, "y"), (301, "w " * 2000, "x", 1, "y")]
    target = ["ab word7 x", None, "", "Zz zz ab"]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), (40, 100), range_rows=range_rows)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), by_hand([r[:2] for r in rows], target, (40, 100)))


def test_ties_go_to_the_smaller_id_and_null_ids_come_last(spark):
    rows = [(None, 5, 0), (9, 5, 1), (3, 5, 2), (3, 5, 3), (7, 6, 4), (1, 4, 5)]
    got = drawn(spark.createDataFrame(rows, "doc_id long, score long, row long"), (1, 1), 2).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(4, 1), (2, 2), (3, 3), (1, 4), (0, 5), (5, 6)]


def test_empty_tables(spark):
    empty, docs = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b " * 30, "x", 1, "y")], SCHEMA)
    assert resample(empty, empty).count() == 0
    same(resample(docs, empty, (1, 1)).collect(), by_hand([(1, "a b " * 30)], [], (1, 1)))
    assert resample(docs, docs).first()["rank"] is None  # a twentieth of one row


def test_counts_and_weights_are_of_all_texts(spark):
    rows = list(enumerate(texts(80, 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    n = counted(docs, 500, 2)
    want = Counter(zlib.crc32(f) % 500 for _, t in rows for f in features(t)[1] if f.count(b" ") < 2)
    assert n.tolist() == [want[b] for b in range(500)]
    gain = gains(n, np.ones(500, np.int64))
    got = {r["doc_id"]: r["weight"] for r in scored(docs, gain, 2, 1).collect()}
    assert got == {k: sum(int(gain[zlib.crc32(f) % 500]) for f in features(t)[1] if f.count(b" ") < 2) for k, t in rows}


def test_steps_hold_whole_texts():
    import pyarrow as pa

    given = ["a" * 700_000, None, "b" * 3_000_000, "", "c"]
    assert [x for part in steps(pa.array(given)) for x in part] == [None if t is None else t.encode() for t in given]


def test_given_documents(spark, sf):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    same(resample(docs, target, range_rows=3).collect(), want)
