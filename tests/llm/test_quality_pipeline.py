import importlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm.quality import ABSTAIN, LABELLERS, Classifier, classify, fit, fit_labels, pattern, train, unpack, votes


def test_patterns_round_trip():
    r = np.random.default_rng(1)
    for _ in range(100):
        v = tuple(int(x) for x in r.integers(0, 3, 5))
        assert tuple(unpack(pattern(v), 5)) == v


def test_expectation_maximisation_recovers_accuracies():
    r = np.random.default_rng(2)
    truth = r.random(20000) < 0.7
    accuracy, cover = [0.9, 0.75, 0.8, 0.65, 0.85], [0.8, 0.5, 0.6, 0.9, 0.3]
    counts, by_row = {}, []
    for t in truth:
        v = tuple(int(t if r.random() < a else not t) if r.random() < c else ABSTAIN for a, c in zip(accuracy, cover, strict=True))
        by_row.append(pattern(v))
        counts[by_row[-1]] = counts.get(by_row[-1], 0) + 1
    model = fit_labels(counts, 5)
    assert model.good == pytest.approx(0.7, abs=0.05)
    for k in range(5):
        assert model.chance[k, 1, 1] / model.chance[k, 1, :2].sum() == pytest.approx(accuracy[k], abs=0.06)
    guess = np.array([model.posterior[c] > 0.5 for c in by_row])
    assert (guess == truth).mean() > 0.87


def test_votes_and_empty_models():
    assert votes(b"") == (ABSTAIN,) * len(LABELLERS)
    assert votes(b"spam " * 100)[0] == 0 and votes(b"BUY!! NOW!! BUY!! NOW!! BUY!! THIS!!")[1] == 0
    assert fit_labels({}).posterior == {}
    assert not train([], np.zeros(0), np.zeros(0))[0].any()


def test_held_out_accuracy(spark, sf):
    big = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = classify(docs, fit(docs)).join(labels, "doc_id").select("__keep", "quality").toPandas()
    assert got["__keep"][got["quality"] == 1].mean() > 0.99
    assert (~got["__keep"][got["quality"] == 0]).mean() > 0.9


def test_classify_nulls_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "the cat sat on the mat and it was happy there.", "z"), (4, "a " * 20000, "z")], "doc_id long, text string, weak string")
    out = classify(docs, fit(docs))
    assert out.columns == ["doc_id", "text", "weak", "__weak", "__score", "__keep"]
    rows = out.collect()
    assert len(rows) == 4 and all(0 <= r["__score"] <= 1 for r in rows)
    empty = docs.limit(0)
    assert classify(empty, fit(empty)).count() == 0
    assert isinstance(fit(empty), Classifier)


def test_pipeline_stages(spark, sf, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5] > 0
    again = pipeline.run(spark, sf)
    a = sorted(map(tuple, docs.select("doc_id", "shard", "slot").collect()))
    b = sorted(map(tuple, again.select("doc_id", "shard", "slot").collect()))
    assert a == b


def test_clean_documents_stay(spark, sf):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    from corpus_pipeline import quality

    kept = quality(spark, docs, big)
    gone = labels.join(kept, "doc_id", "left_anti").count()
    assert gone <= 0.01 * labels.count()
    assert kept.where(F.col("text").isNull()).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    assert {m[1] for m in (re.match(r"(op\d+)_", n) for n in names) if m} == {f"op{k}" for k in range(1, 14)}
    assert set(entry.oracle_sql()) <= names


def test_every_byte_of_a_long_word_counts():
    from thicket.llm.quality import BUCKETS, Features, Scores, row_features, score

    head, features = b"x" * 64, Features()
    assert len(row_features(head + b"abc" * 100, features)[0]) > len(row_features(head, features)[0])
    known = Scores(np.random.default_rng(1).normal(size=BUCKETS))
    assert score(head + b"one tail".replace(b" ", b""), known, 0.0) != score(head + b"another", known, 0.0)
    at, value = row_features(b"a few short words here", features)
    assert len(at) > 5 and value[:-1].sum() == pytest.approx(2.0)
