"""Clashing names, collisions, brute-force forms of what SQL can't express, and what the operators share."""

import math
import random
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import common, jaccard, quality
from thicket.llm.ann import nearest
from thicket.llm.decontaminate import decontaminated
from thicket.llm.jaccard import Threshold, numbered_sets, one_of_each, shingle_set, similar_groups
from thicket.llm.mix import mix, mixed_order, schedule
from thicket.llm.quality import ABSTAIN, COMMON, Classifier, classify, filter_quality, fit, fit_labels, pattern, row_features, votes
from thicket.llm.shard import sharded, write_shards

CLASHING = ["doc_id", "text", "source", "__score", "__weak", "__node", "__n", "__prefix", "__rid", "__key", "__at", "__row", "__source", "__slot", "__holds_item", "__order", "a.b", "rid", "node", "n", "file", "row", "part", "c0", "key", "rank", "hit", "c1"]
TEXTS = [None, "", " \t\n", "the cat sat on the mat and it was happy there.", "a " * 3000, "one two three four five six seven eight nine ten"] * 2 + [f"w{k} x y z the w{k + 1} of q" for k in range(6)]


def clashing(spark, rows=None):
    rows = TEXTS if rows is None else rows
    data = [(None if k == 1 else k, t, None if k % 4 == 0 else f"s{k % 3}", *(f"{c}{k}" for c in CLASHING[3:])) for k, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING[3:])).repartition(2)


def as_set(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("step", ["classify", "filter", "one", "clean", "mix", "order", "shard"])
def test_columns_may_have_any_names(spark, step):
    docs = clashing(spark)
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    run = {
        "classify": lambda d: classify(d, fit(d)),
        "filter": lambda d: filter_quality(d, 0.0),
        "one": one_of_each,
        "clean": lambda d: decontaminated(d, items),
        "mix": lambda d: mix(d, block_rows=4),
        "order": lambda d: mixed_order(d, block_rows=4),
        "shard": lambda d: sharded(d, 3),
    }[step]
    out = run(docs)
    replaced = {"classify": ["__weak", "__score", "__keep"], "mix": ["block", "slot", "place"], "shard": ["shard", "slot"]}.get(step, [])
    kept = [c for c in CLASHING if c not in replaced]
    assert out.columns == kept + replaced
    got = out.select(*(f"`{c}`" for c in kept)).collect()
    every = as_set(docs.select(*(f"`{c}`" for c in kept)).collect())
    assert set(as_set(got)) <= set(every)
    if step in ("classify", "filter", "mix", "order", "shard"):
        assert as_set(got) == every
    empty = run(clashing(spark).limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_columns_that_an_operator_adds_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8)], "doc_id long, text string, source string, slot int, SHARD int")
    assert sharded(docs, 2).columns == ["doc_id", "text", "source", "shard", "slot"]
    assert mix(docs).columns == ["doc_id", "text", "source", "SHARD", "block", "slot", "place"]


def thue_morse(k, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << k))


def test_words_that_collide_in_polynomial_hashes_do_not_link(spark):
    x, y = thue_morse(10), thue_morse(10, "ba")
    docs = spark.createDataFrame([(1, f"one two three {x}"), (2, f"one two three {y}"), (3, f"one two three {y}")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_links_do_not_depend_on_hashes():
    r = random.Random(3)
    t = Threshold(6, 10)
    words = [thue_morse(8), thue_morse(8, "ba"), "x", "y", "É", "zz"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 12))).encode() for _ in range(60)] + [None, b"", b"x", b"X", b"x y"]
    plain = []
    for raw in texts:
        w = (raw or b"").lower().split()
        plain.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    for sets in (numbered_sets(texts, 2), [np.array(sorted({hash(g) for g in s})) for s in plain]):
        assert [len(s) for s in sets] == [len(s) for s in plain]
    sets = numbered_sets(texts, 2)
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])
    found = jaccard._answers([([7], [texts[0]], list(range(len(texts))), texts)], 2, t, 1.0).to_pydict()
    want = [k for k in range(len(texts)) if plain[k] and 10 * len(plain[0] & plain[k]) >= 6 * len(plain[0] | plain[k])]
    assert [y for y, linked in zip(found["y"], found["linked"], strict=True) if linked] == want


def test_numbers_of_shingles_survive_renumbering(monkeypatch):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randint(0, 400))).encode() for _ in range(40)]
    texts += texts[:5]
    for n in (1, 3, 7):  # seven words of thousands are beyond 62 bits
        for raw, s in zip(texts, numbered_sets(texts, n), strict=True):
            w = raw.split()
            assert len(s) == len({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}) * bool(w) == len(shingle_set(raw, n))
    monkeypatch.setattr(jaccard, "CHUNK", 30)
    again = numbered_sets(texts, 3)
    assert all(np.array_equal(a, b) for a, b in zip(again[:5], again[-5:], strict=True))


def edf(blocks, weights):
    """The slots of every block, slot by slot: of the released blocks the one that is due first."""
    left, slot, out = {s: n for s, n in blocks.items() if n}, 0, {s: [] for s in blocks}
    while left:
        whole = sum(Fraction(weights[s]) for s in left)
        share, begin, done = {s: Fraction(weights[s]) / whole for s in left}, slot, dict.fromkeys(left, 0)
        while all(done[s] < left[s] for s in left):
            ready = [s for s in left if math.floor(done[s] / share[s]) <= slot - begin]
            first = min(ready, key=lambda s: (math.ceil((done[s] + 1) / share[s]), s))
            out[first].append(slot)
            done[first] += 1
            slot += 1
        left = {s: n - done[s] for s, n in left.items() if n > done[s]}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_that_of_brute_force(seed):
    r = random.Random(seed)
    blocks = {f"s{k}": r.randint(0, 60) for k in range(r.randint(1, 7))}
    weights = {s: r.choice([r.random() + 1e-6, float(n + 1) ** 0.5, 1 / 3, 4e-4]) for s, n in blocks.items()}
    plan, want = schedule(blocks, weights), edf(blocks, weights)
    for s, n in blocks.items():
        if n:
            assert plan.slots(s, np.arange(n)).tolist() == want[s]


def test_schedule_stays_within_a_block_of_targets_over_many_slots():
    weights = {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "d": 4e-4}
    blocks = {"a": 300_000, "b": 300_000, "c": 300_000, "d": 1000}
    plan = schedule(blocks, weights)
    end = min(plan.slots(s, np.array([n - 1]))[0] for s, n in blocks.items()) + 1
    assert end > 890_000
    for s, n in blocks.items():
        t = np.arange(1, end + 1)
        done = np.searchsorted(plan.slots(s, np.arange(n)), t)
        assert np.abs(done - weights[s] / sum(weights.values()) * t).max() < 1 + 1e-6


def test_many_blocks_are_placed_by_a_table(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"s{k % 3}" if k % 7 else None) for k in range(200)], "doc_id long, source string")
    want = as_set(mix(docs, block_rows=3).collect())
    monkeypatch.setattr("thicket.llm.mix.BLOCKS_AT_ONCE", 10)
    assert as_set(mix(docs, block_rows=3).collect()) == want


def plain_votes(text):
    words = text.split()
    n = len(words)
    if n < 5:
        return (ABSTAIN,) * 9
    bad = lambda x: 0 if x else ABSTAIN
    letters = [c for c in text if c.isalpha()]
    visible = [c for c in text if not c.isspace()]
    odd = [c for c in visible if ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"-()?!"]
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    common = sum(w.lower().strip(".,;:!?'\"()") in COMMON for w in words) / n
    ends = sum(w[-1] in ".!?" for w in words) / n
    return (
        bad(sum(a == b for a, b in pairs) > 0.3 * len(pairs)),
        bad(sum("A" <= c <= "Z" for c in text) > 0.5 * max(1, len(letters))),
        bad(len(odd) > 0.08 * len(visible)),
        bad(text.count("!") > 0.2 * n),
        bad(len(lines) >= 4 and len(set(lines)) < 0.4 * len(lines)),
        bad(n >= 30 and len(set(pairs)) < 0.5 * len(pairs)),
        bad(sum(len(w) == 1 and w in set(odd) for w in words) > 0.2 * n),
        0 if common < 0.02 and n >= 30 else 1 if common > 0.1 else ABSTAIN,
        0 if ends < 0.005 and n >= 60 else 1 if 0.02 < ends < 0.5 else ABSTAIN,
    )


def by_rows(all_votes, rounds=200):
    """Expectation-maximisation row by row: shares of good rows by row."""
    q = [(sum(x == 1 for x in v) + 0.5) / (sum(x != ABSTAIN for x in v) + 1) for v in all_votes]
    for _ in range(rounds):
        good = (sum(q) + 1) / (len(q) + 2)
        chance = []
        for k in range(len(all_votes[0])):
            by_class = []
            for c in (0, 1):
                n = [[4.0, 1.0, 0.0][x] + 0.5 if c == 0 else [1.0, 4.0, 0.0][x] + 0.5 for x in range(3)]
                for v, p in zip(all_votes, q, strict=True):
                    n[v[k]] += p if c else 1 - p
                by_class.append([x / sum(n) for x in n])
            chance.append(by_class)
        new = []
        for v in all_votes:
            bad, fine = 1 - good, good
            for k, x in enumerate(v):
                bad, fine = bad * chance[k][0][x], fine * chance[k][1][x]
            new.append(fine / (bad + fine))
        moved, q = max(abs(a - b) for a, b in zip(new, q, strict=True)), new
        if moved < 1e-9:
            break
    return [good if all(x == ABSTAIN for x in v) else p for v, p in zip(all_votes, q, strict=True)]


def test_classifier_is_that_of_brute_force(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) = octet_length(text)").collect()]
    assert len(texts) > 50
    all_votes = [plain_votes(t) for t in texts]
    assert [votes(t.encode()) for t in texts] == all_votes
    counts = {}
    for v in all_votes:
        counts[pattern(v)] = counts.get(pattern(v), 0) + 1
    model = fit_labels(counts)
    assert [model.posterior[pattern(v)] for v in all_votes] == pytest.approx(by_rows(all_votes), abs=1e-6)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    fitted = fit(docs)
    assert fitted.labels.posterior == pytest.approx(model.posterior)
    for r in classify(docs, fitted).collect():
        at, value = row_features(texts[r["doc_id"]].encode(), quality.Features())
        z = float(fitted.weights.astype(np.float32)[at] @ value) + fitted.bias
        assert (r["__score"], r["__keep"]) == (pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5), r["__score"] >= 0.5)
        assert r["__weak"] == pytest.approx(model.posterior[pattern(all_votes[r["doc_id"]])], abs=1e-9)


def test_sample_of_the_scorer_is_bounded_whatever_is_repeated(spark, monkeypatch):
    buckets = quality.BUCKETS
    monkeypatch.setattr(quality, "train", lambda rows, target, copies: (np.full(buckets, len(rows)), float(copies.sum())))
    docs = spark.createDataFrame([(1, "the same words of a text here")] * 300 + [(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    model = fit(docs, sample_rows=40)
    assert isinstance(model, Classifier) and 0 < model.weights[0] <= 40 and abs(model.bias - 40) < 10


JUNK = "click here!!! click here!!! click here!!! buy now!!! $$$ $$$ $$$ buy now!!! " * 3
FINE = "The committee met in the morning and agreed that the river should be measured again before the spring."


@pytest.mark.parametrize("ids", [[1], [2], [3], [4, 5], range(7)])
def test_alike_rows_never_leave_the_scorer_untrained(spark, ids):
    """20,000 rows of one text, or of a few ids, get the posterior's verdict, whatever their hashes are."""
    n = 20_000 // len(ids)
    docs = spark.range(n).crossJoin(spark.createDataFrame([(k, JUNK) for k in ids], "doc_id long, text string")).select("doc_id", "text")
    model = fit(docs)
    assert model.weights.any()
    [(weak, keep)] = classify(docs, model).select("__weak", "__keep").distinct().collect()
    assert keep == (weak >= 0.5) and weak < 0.01


def test_a_class_of_very_many_rows_is_in_the_sample(spark):
    """Half of 30,000 rows are one text: it is judged as its votes say, and so are the others."""
    other = spark.range(15_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(FINE), F.lit(" Line "), F.col("id")).alias("text"))
    docs = other.unionByName(spark.range(15_000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(JUNK).alias("text")))
    model = fit(docs, sample_rows=500)
    got = {(r["doc_id"] == -1, r["__weak"] >= 0.5, r["__keep"]) for r in classify(docs, model).select("doc_id", "__weak", "__keep").distinct().collect()}
    assert all(weak == keep for _, weak, keep in got) and {a for a, *_ in got} == {True, False}


def test_ranks_of_hot_groups_and_alike_rows(spark):
    rows = [(0, 5)] * 400 + [(0, k) for k in range(100)] + [(1, None)] * 30 + [(2, 1)]
    df = spark.createDataFrame(rows, "g int, k int").repartition(3)
    got = common.ranked(df, "g", [F.col("k").asc_nulls_first()], "r", rows_per_block=20).collect()
    assert len(got) == len(rows)
    for g in (0, 1, 2):
        own = sorted((r["r"], -1 if r["k"] is None else r["k"]) for r in got if r["g"] == g)
        assert [a for a, _ in own] == list(range(len(own))) and [b for _, b in own] == sorted(b for _, b in own)


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k if k else None, f"t{k}", "x") for k in range(40)], "doc_id long, text string, shard string")
    write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["text"] for r in back.collect()) == sorted(f"t{k}" for k in range(40))
    want = {r["text"]: r["shard"] for r in sharded(docs.select("doc_id", "text"), 4).collect()}
    assert {r["text"]: r["shard"] for r in back.collect()} == want


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master, None))
        assert common.shared_dir(session(master, "file:///shared")) == "file:///shared"


def test_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        common.lean(spark)
        assert int(spark.conf.get(key)) == common.BATCH_BYTES
        sizes = spark.range(64).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).coalesce(1).mapInArrow(lambda it: ({"n": [b.num_rows]} and __import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()
        assert max(r["n"] for r in sizes) <= 8
        spark.conf.set(key, "1000")
        common.lean(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize(("size", "block_rows"), [("sf0.01", 4096), ("sf0.01", 128), ("sf0.1", 512)])
def test_recall_of_nearest_over_several_blocks(spark, size, block_rows):
    rows = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding")
    held = rows.toPandas()
    ids, x = held["vec_id"].to_numpy(), np.array([np.asarray(v, dtype=float) for v in held["embedding"]])
    asked = np.flatnonzero(ids % 20 == 0)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {int(ids[q]): set(ids[np.argsort(-s, kind="stable")[:20]].tolist()) for q, s in zip(asked, scores, strict=True)}
    got = {}
    for r in nearest(rows, rows.where("vec_id % 20 = 0"), block_rows=block_rows, query_rows=40).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.9
