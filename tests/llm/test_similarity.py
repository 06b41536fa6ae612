import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import jaccard
from thicket.llm.ann import Forest, nearest
from thicket.llm.decontaminate import contaminated, decontaminated
from thicket.llm.graph import components
from thicket.llm.jaccard import Answers, Threshold, one_of_each, shingle_set, shingle_sets, similar_groups
from thicket.llm.suffix_dedup import _span_batch, cut, prefix_hashes, remove_repeats, runs
from thicket.llm.suffix_dedup import Powers


def near_copies(seed, groups, size, words, edits, vocabulary=400):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(*words))]
        for _ in range(r.randint(*size)):
            t = list(base)
            for _ in range(r.randint(*edits)):
                if t:
                    t[r.randrange(len(t))] = f"e{r.randrange(vocabulary)}"
            out.append(" ".join(t))
    return out


TEXTS = [None, "", " \n\t", "one two", "One  TWO", "one two three", "É é", "a b c d", "a b c d e"] + near_copies(1, 12, (1, 7), (0, 60), (0, 4)) + near_copies(2, 1, (30, 30), (80, 80), (0, 3))
TEXTS += TEXTS[10:14] + ["x " * 3000]


def sets_of(text, n):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(sets, num, den):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "num", "den", "frequent"), [(4, 85, 100, 16), (2, 60, 100, 3)])
def test_similar_groups_are_the_components_of_brute_force(spark, monkeypatch, n, num, den, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "MEMBERS", 5)
    monkeypatch.setattr(jaccard, "MEETING", 6)
    monkeypatch.setattr(jaccard, "TOKENS", 900)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_shingles string")
    got = {r["doc_id"]: r for r in similar_groups(docs, n, num, den).collect()}
    sets = [sets_of(t, n) for t in TEXTS]
    want = brute_components(sets, num, den)
    assert len(got) == len(TEXTS)
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(s), want[i])


def test_one_of_each_keeps_the_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, cl boolean").coalesce(1)
    out = one_of_each(docs)
    assert out.columns == docs.columns
    sets = [sets_of(t, 5) for t in TEXTS]
    want = brute_components(sets, 80, 100)
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == [i for i in range(len(TEXTS)) if want[i] == i]


def test_similar_groups_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "q r s t"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in similar_groups(docs).collect())
    assert got == [("7", 1, "7"), ("7", 2, "7"), ("None", 0, "None"), ("None", 2, "7")]
    assert similar_groups(docs.limit(0)).count() == 0


def test_answers_derived_from_a_similar_set():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 300, 120).astype(np.uint64))
    group, members = Answers(), []
    for _ in range(6):
        s = np.unique(np.concatenate([r.choice(base, 100), r.integers(0, 300, 9).astype(np.uint64)]))
        members.append(s)
        group.add(s)
    for _ in range(20):
        y = np.unique(r.integers(0, 300, 90).astype(np.uint64))
        overlap, sizes = group.overlaps(y)
        assert overlap.tolist() == [len(np.intersect1d(m, y)) for m in members]
        assert sizes.tolist() == [len(m) for m in members]


def test_family_links_join_all_similar_sets():
    r = np.random.default_rng(4)
    t = Threshold(7, 10)
    for _ in range(40):
        base = np.unique(r.integers(0, 500, 60).astype(np.uint64))
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(30, len(base)), replace=False), r.integers(0, 500, r.integers(0, 9)).astype(np.uint64)])) for _ in range(25)]
        chunk = r.integers(0, 2, 25)
        links = []
        for i, j in ((0, 0), (0, 1), (1, 1)):
            at = [k for k in range(25) if chunk[k] in (i, j)]
            if len(at) > 1:
                links += [(at[x], at[y]) for x, y in jaccard.family_links([sets[k] for k in at], chunk[at] == i, chunk[at] == j, t)]
        parent = list(range(25))
        for x, y in links:
            assert t.similar(len(np.intersect1d(sets[x], sets[y])), len(sets[x]), len(sets[y]))
            parent = [parent[x] if p == parent[y] else p for p in parent]
        want = brute_components([set(map(int, s)) for s in sets], 7, 10)
        assert len(set(zip(parent, want, strict=True))) == len(set(parent)) == len(set(want))


PLACED = "tok long, rid long, n int, pos int, cl long, sets int, least_n int, most_n int"


def test_sets_that_share_only_late_prefix_tokens_do_not_meet(spark):
    # loose copies of one text, size 390: 60 tokens of their own come first, what follows is less than a link needs
    t = Threshold(80, 100)
    for m, first, want in ((20, 60, 0), (100, 60, 0), (20, 0, 190 * 18)):
        rows = [(tok, rid, 390, first + tok, rid, 1, 390, 390) for rid in range(m) for tok in range(18)]
        assert jaccard._met(spark.createDataFrame(rows, PLACED), t).count() == want


@pytest.mark.parametrize(("num", "den"), [(80, 100), (70, 100), (60, 100)])
def test_all_links_between_families_meet(spark, num, den):
    r, t = np.random.default_rng(num), Threshold(num, den)
    sets = []
    for _ in range(12):
        base = r.choice(300, r.integers(1, 70), replace=False)
        for _ in range(r.integers(1, 8)):
            kept = r.choice(base, r.integers(max(1, len(base) * 3 // 4), len(base) + 1), replace=False)
            sets.append(np.unique(np.concatenate([kept, r.integers(0, 300, r.integers(0, 4))])))
    family = [int(f) for f in r.integers(0, len(sets) // 2, len(sets))]
    count, rows = Counter(family), []
    for rid, (s, f) in enumerate(zip(sets, family, strict=True)):
        sizes = [len(x) for x, g in zip(sets, family, strict=True) if g == f]
        rows += [(int(tok), rid, len(s), pos, f, count[f], min(sizes), max(sizes)) for pos, tok in enumerate(s[: t.prefix(len(s))])]
    met = Counter()
    common = {}
    for x in jaccard._met(spark.createDataFrame(rows, PLACED), t).collect():
        met[x["k"], x["y"]] += 1
        assert common.setdefault((x["k"], x["y"]), x["common"]) == x["common"]
    links = 0
    for x, a in enumerate(sets):
        for y, b in enumerate(sets):
            k, f = family[x], family[y]
            if k != f and (-count[k], k) < (-count[f], f) and t.similar(len(np.intersect1d(a, b)), len(a), len(b)):
                links += 1
                assert met[k, y] >= common[k, y] >= 1
    assert links > 5


def test_threshold_prefix_loses_nothing():
    t = Threshold(85, 100)
    for size in range(1, 200):
        assert size - (t.prefix(size) - 1) >= 0.85 * size - 1e-9
    assert len(shingle_set(b"a b c", 4)) == 1


def test_shingle_sets_do_not_depend_on_how_texts_are_grouped(monkeypatch):
    r = random.Random(11)
    texts = [None if r.random() < 0.1 else " \n".join(r.choice(["A", "bb", "CcC", "\u00e9t\u00e9", "x" * 90]) for _ in range(r.randint(0, 40))).encode() for _ in range(60)]
    whole = list(shingle_sets(texts, 3))
    monkeypatch.setattr(jaccard, "CHUNK", 40)  # most texts are then hashed by pieces
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingle_sets(texts, 3), strict=True))
    for t, s in zip(texts, whole, strict=True):
        assert len(s) == len(sets_of((t or b"").decode(), 3))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, 100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[x] == root(x) for e in edges[:-1] if e[0] != e[1] for x in e)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def covered(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_suffix_sort_finds_every_repeat():
    r = random.Random(5)
    for _ in range(150):
        length = r.choice([5, 8, 20])
        letters = r.choice([b"ab", b"abc", bytes(range(97, 120))])
        parts = [bytes(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(3)]
        texts = [b"".join(r.choice(parts) if r.random() < 0.4 else bytes(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 6))]
        gram, powers, rows = max(1, length // 5), Powers(), []
        for d, t in enumerate(texts):
            if len(t) >= length:
                rows += [(int(h), d, int(s), int(n), int(o), False, t[s : s + n + length - 1]) for part in runs(t, length, gram, powers) for h, s, n, o in zip(*part, strict=True)]
        rows.sort(key=lambda x: x[0])
        gone = [np.zeros(len(t), bool) for t in texts]
        if rows:
            found = _span_batch(rows, length, gram).to_pydict()
            for d, a, b in zip(found["rid"], found["a"], found["b"], strict=True):
                gone[d][a:b] = True
        assert all((x == y).all() for x, y in zip(gone, covered(texts, length), strict=True))


@pytest.mark.parametrize("hot_runs", [10**6, 2])
def test_remove_repeats(spark, hot_runs):
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh é") for _ in range(90))
    texts = [None, "", "short", passage, passage, "z" * 300, passage[:39], "é" * 30]
    texts += ["".join(r.choice("abcdefgh é") for _ in range(r.randint(0, 120))) + passage[r.randint(0, 30) :] + "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 80))) for _ in range(25)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {row["doc_id"]: row for row in remove_repeats(docs, 40, hot_runs=hot_runs, kept_text=True).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, gone in enumerate(covered(raw, 40)):
        rest = bytes(b for b, g in zip(raw[i], gone, strict=True) if not g)
        stretches = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert tuple(got[i])[:5] == (i, len(raw[i]), int(gone.sum()), stretches, hashlib.sha256(rest).hexdigest())
        assert bytes(got[i]["kept"]) == rest
    assert remove_repeats(docs.limit(0), 40).count() == 0


def test_cut_and_prefix_hashes():
    assert cut(b"abcdefgh", [(4, 6), (0, 2), (1, 3), (6, 7)]) == (6, 2, b"dh")
    p = Powers()
    h = prefix_hashes(np.frombuffer(b"xabcyabc", np.uint8), p)
    with np.errstate(over="ignore"):
        assert (h[4] - h[1]) * p.down[1] == (h[8] - h[5]) * p.down[5]


def shingle_strings(text, n=5):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_decontamination_is_exact_containment(spark):
    r = random.Random(8)
    items = [(k, " ".join(f"i{r.randrange(50)}" for _ in range(r.randint(1, 70)))) for k in range(14)] + [(90, None), (91, ""), (92, "!!"), (93, "it's 'quoted' \\ here"), (3, "another text for the same id")]
    texts = [None, "", "It's QUOTED, here", "another text for the same id"]
    for _ in range(60):
        _, t = r.choice(items[:14])
        w = t.split()
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(f"d{r.randrange(40)}" for _ in range(r.randint(0, 200))) + "\n" + ", ".join(w).upper() + " tail")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string").coalesce(2)
    known = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for k, item in items:
            own = shingle_strings(item)
            if own and len(own & shingle_strings(t)) >= 0.8 * len(own) - 1e-9:
                want.add((i, k, len(own & shingle_strings(t)), len(own)))
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in contaminated(docs, known).collect()}
    assert got == want and len({i for i, *_ in want}) > 5
    left = decontaminated(docs, known)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(range(len(texts))) - {w[0] for w in want})
    assert contaminated(docs, known.limit(0)).count() == 0 and contaminated(docs.limit(0), known).count() == 0
    assert decontaminated(docs, known.limit(0)).count() == len(texts)


@pytest.mark.parametrize("at_once", [0, 2, 10**6])
def test_decontamination_by_broadcast_and_by_shuffle(spark, monkeypatch, at_once):
    from thicket.llm import common, decontaminate

    for module, name in ((decontaminate, "ITEMS_AT_ONCE"), (decontaminate, "VALUES_AT_ONCE"), (common, "ROWS_AT_ONCE")):
        monkeypatch.setattr(module, name, at_once)
    texts = [" ".join(f"i{k % 5}x{j}" for j in range(9)) for k in range(7)] + [None, ""]
    items = spark.createDataFrame([(None if k == 4 else k, t) for k, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(k + 10, None if t is None else f"a b {t} c") for k, t in enumerate(texts)] + [(10, f"a b {texts[0]} c")], "doc_id long, text string")
    got = contaminated(docs, items).collect()
    want = [(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] and i["text"] in (d["text"] or "")]
    assert sorted(map(str, ((r["doc_id"], r["item_id"]) for r in got))) == sorted(map(str, want)) and len(want) == 13
    assert sorted(r["doc_id"] for r in decontaminated(docs, items).collect()) == [17, 18]


def test_the_plan_does_not_grow_with_the_items(spark):
    docs = spark.createDataFrame([(k, f"one two three four five six w{k}") for k in range(50)], "doc_id long, text string")

    def planned(n):
        items = spark.range(n).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.lit("w3"), *(F.concat(F.lit(f"t{j}x"), "id") for j in range(12))).alias("text"))
        begun = time.perf_counter()
        made = contaminated(docs, items)
        return len(made._jdf.queryExecution().optimizedPlan().toString()), time.perf_counter() - begun, made.count()

    (few, _, a), (many, seconds, b) = planned(10), planned(30_000)
    assert abs(few - many) < 400 and seconds < 60 and a == b == 0


def test_nearest_on_every_row_is_brute_force(spark):
    g = np.random.default_rng(4)
    x = g.standard_normal((120, 8)) * g.uniform(0.2, 3, (120, 1))
    x[30:60] = x[30]
    rows = [(i, [float(v) for v in x[i]]) for i in range(120)]
    odd = [(500, None), (520, []), (540, [0.0] * 8), (560, [float("nan")] * 8), (580, [float("inf")] + [1.0] * 7), (600, [None] + [1.0] * 7), (620, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=7, share=1.0, block_rows=37, query_rows=3)
    table = {}
    for r in got.collect():
        table.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(table) == [0, 20, 40, 60, 80, 100]
    for q, found in table.items():
        scores = (x * x[q]).sum(axis=1)
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:7]
        assert [(i, s) for _, i, s in sorted(found)] == [(i, -m) for m, i in best]
        assert [k for k, _, _ in sorted(found)] == list(range(1, 8))
    assert nearest(vectors.limit(0), vectors).count() == 0 and nearest(vectors, vectors.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    got = nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0)).toPandas()
    all_rows = vectors.toPandas().sort_values("vec_id")
    x = np.array([np.asarray(v, dtype=np.float64) for v in all_rows["embedding"]])
    ids = all_rows["vec_id"].to_numpy()
    hits = total = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(own["vec_id"]))
        total += 20
    assert hits / total >= 0.9


def test_forest_takes_equal_rows_together():
    g = np.random.default_rng(5)
    x = np.concatenate([np.tile(g.standard_normal(6), (50, 1)), g.standard_normal((50, 6))])
    for cand in Forest(x, 6, 1).candidates(x[:3], 10):
        assert set(range(50)) <= set(cand.tolist())
