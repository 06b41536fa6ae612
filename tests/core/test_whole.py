"""Registered queries that take the whole of their table."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thicket.plans.model import fit
from thicket.sources.scenarios import generate

SMALL = {"n_trees": 8, "ndpost": 12, "nskip": 10, "max_bins": 10}
FEATURES = [f"x{k}" for k in range(5)]


def test_all_arms_of_all_events_are_encoded(spark, sf):
    name = "encode_all_arms"
    got = sorted(tuple(r) for r in entry.queries()[name](spark, sf).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    assert len(got) == 5 * db.execute("SELECT count(*) FROM events").fetchone()[0]
    assert got == sorted(db.execute(entry.oracle_sql()[name]).fetchall())


FITS = ["mcmc_fit_regression", "mcmc_fit_probit", "mcmc_fit_logistic", "multichain_fit", "rank_rhat_ess", "trees_posterior_mean", "posterior_predict"]


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", FITS)
def test_models_are_fitted_to_all_rows(spark, sf, monkeypatch, name):
    def fit(df, *args, **options):
        raise Seen(df.count())

    monkeypatch.setattr("thicket.plans.model.fit", fit)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, sf)
    assert seen.value.args[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_update_appends_the_rows_that_were_not_fitted(spark, sf, monkeypatch):
    class Fitted:
        def __init__(self, rows):
            self.rows = rows

        def update(self, more, ndpost):
            ids = [r["row_id"] for df in (self.rows, more) for r in df.select("row_id").collect()]
            raise Seen(more.count(), len(ids), len(set(ids)))

    monkeypatch.setattr("thicket.plans.model.fit", lambda df, *args, **options: Fitted(df))
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    with pytest.raises(Seen) as seen:
        entry.queries()["update_fit"](spark, sf)
    more, ids, distinct = seen.value.args
    assert ids == distinct == n and 0 < more < n


def test_all_probes_are_diagnosed(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert entry.queries()["rank_rhat_ess"](spark, sf).select("row_id").distinct().count() == n


def test_rows_are_dealt_to_shards_only_when_asked_for(spark, monkeypatch):
    monkeypatch.setattr("thicket.plans.model.MOST_ROWS", 50, raising=False)
    data = generate(spark, "friedman1", 160, noise=0.2)
    assert fit(data, FEATURES, "y", seed=1, **SMALL).shards == 1


def test_importance_and_noise_are_of_all_shards(spark):
    m = fit(generate(spark, "friedman1", 160, noise=0.2), FEATURES, "y", chains=2, seed=1, shards=3, **SMALL)
    assert m.histogram().agg(F.sum("n")).first()[0] == m.nodes().where("var >= 0").count()
    want = {}
    for row in m.trace.where("draw >= 0").collect():
        want.setdefault((row["chain"], row["draw"]), []).append(row["sigma2"])
    got = {(row["chain"], row["draw"]): row["value"] for row in m.sigma_chains().collect()}
    assert got == pytest.approx({k: sum(v) / 3 for k, v in want.items()}) and all(len(v) == 3 for v in want.values())
