import math
from fractions import Fraction

import numpy as np
import pytest

from thicket.llm.whitening import DIGIT, EXACT_ROWS, LIMB, centred, digits, gram, limbs, whiten, whitener

SCHEMA = "vec_id long, embedding array<float>, component string, n string, x int"


def as_rows(vectors, ids=None):
    return [(k if ids is None else ids[k], v, "c", "n", 1) for k, v in enumerate(vectors)]


def takes_part(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def by_hand(vectors):
    """n, S, the exact covariance, and the integer vectors of those that take part."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] if takes_part(v) else None for v in vectors]
    fit = sorted({tuple(r) for r in x if r is not None})
    n, dims = len(fit), len(fit[0])
    s = [sum(r[k] for r in fit) for k in range(dims)]
    mean = [Fraction(t, n) for t in s]
    v = [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in fit) / n for j in range(dims)] for i in range(dims)]
    return n, s, v, x


def check(rows, vectors, ids, most=16):
    n, s, v, x = by_hand(vectors)
    exact = np.array([[float(c) for c in r] for r in v])
    values, basis = np.linalg.eigh(exact)
    values, basis = values[::-1], basis.T[::-1]
    kept = min(most, sum(values > values[0] * len(s) * np.finfo(float).eps))
    place = {i: k for k, i in enumerate(ids)}
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((ids[k], c) for k in range(len(x)) if x[k] is not None for c in range(1, kept + 1))
    w = np.full((len(x), kept), np.nan)
    for r in rows:
        own = x[place[r["vec_id"]]]
        assert (r["n"], int(r["deviation"])) == (n, sum((n * a - b) ** 2 for a, b in zip(own, s, strict=True)))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(exact), rel=1e-9)
        assert r["identity_error"] < 1e-9
        w[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    there = [k for k in range(len(x)) if x[k] is not None]
    want = np.array([[float(a - Fraction(b, n)) for a, b in zip(x[k], s, strict=True)] for k in there]) @ basis[:kept].T / np.sqrt(values[:kept])
    signs = np.sign((w[there] * want).sum(axis=0))
    assert np.allclose(w[there], want * signs, rtol=0, atol=1e-7 * np.abs(want).max())


@pytest.mark.parametrize("parts", [1, 5])
def test_vectors_with_all_that_may_be_in_them(spark, parts):
    rng = np.random.default_rng(parts)
    vectors = [rng.normal(0, [3, 1, 0.3, 0.1, 40], 5).astype(np.float32).tolist() for _ in range(60)]
    vectors += [vectors[3]] * 80 + [None, [], [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [1.0, 2.0, math.inf, 0.0, 0.0], [0.0] * 5, [-0.001, 0.0, 1e-30, 1 / 64, -1 / 64]]
    ids = [1000 - 3 * k for k in range(len(vectors))]
    check(whiten(spark.createDataFrame(as_rows(vectors, ids), SCHEMA).repartition(parts)).collect(), vectors, ids)
    check(whiten(spark.createDataFrame(as_rows(vectors, ids), SCHEMA), most=2).collect(), vectors, ids, 2)


def test_large_offsets_do_not_cancel(spark):
    """Spreads of some units far from zero: products of the raw integers would not fit 53 bits."""
    rng = np.random.default_rng(0)
    vectors = [(1e6 + rng.integers(0, 40, 4) / 4).tolist() for _ in range(90)]
    check(whiten(spark.createDataFrame(as_rows(vectors), SCHEMA)).collect(), vectors, list(range(90)))


def test_null_and_repeated_keys(spark):
    rows = [(None, [1.0, 2.0], "", "", 0), (None, [1.0, 2.0], "", "", 0), (7, [2.0, 5.0], "", "", 0), (7, [4.0, 1.0], "", "", 0)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] is None, r["component"]) for r in got) == [(a, c) for a in (False, True) for c in (1, 1, 2, 2)]
    assert {r["n"] for r in got} == {3}


def test_no_variance_and_empty_tables(spark):
    for vectors in ([], [None, [], [math.nan]], [[1.0, 2.0]] * 5):
        assert whiten(spark.createDataFrame(as_rows(vectors), SCHEMA)).collect() == []
    flat = whiten(spark.createDataFrame(as_rows([[1.0, 9.0, k / 8] for k in range(9)]), SCHEMA)).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)


def test_what_is_an_error(spark):
    with pytest.raises(ValueError, match="different lengths"):
        whiten(spark.createDataFrame(as_rows([[1.0], [1.0, 2.0]]), SCHEMA))
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame(as_rows([[1e30]]), SCHEMA)).collect()


def test_limbs_and_digits_are_exact():
    rng = np.random.default_rng(3)
    for bits in (3, LIMB, LIMB + 1, 40, 60):
        d = rng.integers(-(1 << bits), 1 << bits, (50, 3))
        cut = limbs(d)
        assert all(np.abs(c).max() < 1 << LIMB for c in cut)
        assert (sum(c.astype(np.int64).astype(object) << LIMB * k for k, c in enumerate(cut)) == d).all()
        assert (gram(iter([d, d[:7]]), 3) == d.astype(object).T @ d.astype(object) + d[:7].astype(object).T @ d[:7].astype(object)).all()
    for value in (0, -1, 2**140 + 5, -(2**140) - 5, 2**32):
        assert sum(k << DIGIT * at for at, k in enumerate(digits(value, 5))) == value


def test_full_blocks_of_the_largest_limbs_are_exact():
    most = (1 << LIMB) - 1
    d = np.full((EXACT_ROWS, 2), most)
    assert gram((d for _ in range(130)), 2).tolist() == [[130 * EXACT_ROWS * most**2] * 2] * 2
    wide = np.full((EXACT_ROWS, 2), (1 << 61) - 1)
    assert gram((wide for _ in range(70)), 2).tolist() == [[70 * EXACT_ROWS * ((1 << 61) - 1) ** 2] * 2] * 2


def test_centring_beyond_64_bits():
    x = np.array([[1 << 40, -5], [3, 1 << 41]])
    assert centred(x, 1 << 30, [7, 9]).tolist() == [[(1 << 70) - 7, -5 * (1 << 30) - 9], [3 * (1 << 30) - 7, (1 << 71) - 9]]


def test_whitening_of_other_tables(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame(as_rows([rng.normal(0, 2, 3).tolist() for _ in range(50)]), SCHEMA)
    w, apply = whitener(docs)
    got = {r["key"]: r["whitened"] for r in apply(docs.where("vec_id < 5")).collect()}
    want = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(docs).collect()}
    assert w.n == 50 and all(got[k] == pytest.approx([want[k, c] for c in (1, 2, 3)]) for k in range(5))
    assert whitener(docs.where("vec_id < 0"))[1](docs).count() == 0


def test_given_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 150").collect()
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    check(whiten(docs).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])
