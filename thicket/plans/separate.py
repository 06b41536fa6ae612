"""A model for each value of a column, such as an arm: every (model, chain) is a task, and one pass over the rows
evaluates all models."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators import traces as tr
from thicket.plans import cells as ce
from thicket.plans.chain import LogisticChain, RegressionChain, Settings
from thicket.plans.model import NODE, _pack
from thicket.sources.files import stored

TRACE = f"model string, chain int, draw int, category int, sigma2 double, low double, high double, rows long, trees array<array<{NODE}>>"


@dataclass
class Models:
    """Models by name; the trace has a row for each model, chain, draw and category."""

    by: str
    features: list[str]
    target: str
    kind: str
    settings: Settings
    chains: int
    seed: int
    max_bins: int
    categories: int
    trace: DataFrame
    _held: dict | None = field(default=None, repr=False)

    def names(self) -> list[str]:
        return sorted(self._draws())

    def __len__(self) -> int:
        return len(self._draws())

    def __getitem__(self, name) -> DataFrame:
        """The trace of one model."""
        return self.trace.where(F.col("model") == str(name))

    def _draws(self) -> dict[str, tuple[float, float, list[tuple[int, int]]]]:
        """For each model its range and the (chain, draw) of its posterior draws, chain after chain: all that the driver
        gets of the trace."""
        if self._held is None:
            rows = self.trace.where("draw >= 0 and category = 0").select("model", "chain", "draw", "low", "high").collect()
            found: dict[str, list] = {}
            for r in sorted(rows, key=lambda r: (r["model"], r["chain"], r["draw"])):
                found.setdefault(r["model"], []).append(r)
            self._held = {name: (own[0]["low"], own[0]["high"], [(r["chain"], r["draw"]) for r in own[: self.settings.ndpost]]) for name, own in found.items()}
        return self._held

    def posterior_f_batch(self, df: DataFrame, out: str = "draws") -> DataFrame:
        """Adds a map from each model to its draws for the row: f on the target's axis (regression), the latent f
        (probit), or the probability of class 1 (logistic).  Rows are not moved."""
        return self._with(df, out, every=True)

    def posterior_f(self, df: DataFrame, out: str = "draws") -> DataFrame:
        """Adds the draws of the row's own model, null where there is none."""
        return self._with(df, out, every=False)

    def predict_batch(self, df: DataFrame, out: str = "means") -> DataFrame:
        """Adds a map from each model to its posterior mean for the row."""
        made = self.posterior_f_batch(df, out)
        return made.withColumn(out, F.transform_values(out, lambda _, v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)))

    def _with(self, df: DataFrame, out: str, every: bool) -> DataFrame:
        """The trace stays a table; its draws reach the rows packed, in chunks under a byte limit.  Where a row needs its own
        model only, it meets no other's draws."""
        spark, found = df.sparkSession, self._draws()
        if not found:
            return df.withColumn(out, F.create_map().cast("map<string,array<double>>") if every else F.lit(None).cast("array<double>"))
        n = self.categories if self.kind == "logistic" else 1
        sizes = {name: len(keys) * n for name, (_, _, keys) in found.items()}
        starts = dict(zip(sizes, np.cumsum([0, *sizes.values()])[:-1].tolist(), strict=True)) if every else dict.fromkeys(sizes, 0)
        places = [(name, c, d, starts[name] + k * n) for name, (_, _, keys) in found.items() for k, (c, d) in enumerate(keys)]
        at = F.broadcast(spark.createDataFrame(places, "__m string, __c int, __d int, __k int"))  # four values a draw
        there = self.trace.join(at, (F.col("model") == F.col("__m")) & (F.col("chain") == F.col("__c")) & (F.col("draw") == F.col("__d")))
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        rows = df.withColumns({"__x": x, "__own": F.col(self.by).cast("string")})
        columns = sum(sizes.values()) if every else max(sizes.values())
        made = tr.evaluated(rows, there, F.col("__k") + F.col("category"), F.lit(1.0), columns, "__x", "__f", of=F.col("model"), group=None if every else "__own")

        def draws(name: str) -> Column:
            low, high, keys = found[name]
            f = F.slice("__f", starts[name] + 1, sizes[name])
            if self.kind == "logistic":
                each = F.transform(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda k: F.slice(f, k * n + 1, n))
                return F.transform(each, lambda z: F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - F.get(z, 1))))
            if self.kind == "regression" and high > low:
                return F.transform(f, lambda v: F.lit(high - low) * (v + F.lit(0.5)) + F.lit(low))
            return f

        if every:
            value = F.create_map(*[c for name in sizes for c in (F.lit(name), draws(name))])
        else:
            value = F.coalesce(*[F.when(F.col("__own") == name, draws(name)) for name in sizes])
        return made.withColumn(out, value).drop(*({"__x", "__own", "__f"} - {out}))

    def refit(self, rows: DataFrame) -> Models:
        """The models of the groups in `rows` anew from these rows; the others stay as they are."""
        new = _run(rows, self.by, self.features, self.target, self.kind, self.settings, self.chains, self.seed + 1, self.max_bins, self.categories)
        kept = self.trace.join(F.broadcast(new.select("model").distinct()), "model", "left_anti")
        return replace(self, trace=stored(kept.unionByName(new), "models"), _held=None)

    def effective(self) -> DataFrame:
        """(model, chain, draws, rows)."""
        return self.trace.where("draw >= 0 and category = 0").groupBy("model", "chain").agg(F.count("*").alias("draws"), F.max("rows").alias("rows"))


def _run(df, by, features, target, kind, s: Settings, chains, seed, max_bins, categories) -> DataFrame:
    each = math.ceil(s.ndpost / chains)

    known = df.where(F.col(by).isNotNull() & F.col(target).isNotNull())
    for c in features:
        known = known.where(F.col(c).isNotNull())
    rows = known.select(F.col(by).cast("string").alias("model"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y"))
    whole = s.likelihood is not None or s.prior is not None or bool(s.proposals)
    parts, names, cuts, found, codes, scale, guesses = rows, [], {}, {}, None, 1.0, {}
    if not whole:
        places = F.array(*map(F.lit, np.linspace(0, 1, max_bins, endpoint=False).tolist()))
        quantiles = [F.percentile(F.get("x", k), places).alias(f"q{k}") for k in range(len(features))]
        found = {r["model"]: (r["low"], r["high"], [np.unique(r[f"q{k}"]) for k in range(len(features))]) for r in rows.groupBy("model").agg(F.min("y").alias("low"), F.max("y").alias("high"), *quantiles).collect()}
        cuts = {name: own[2] for name, own in found.items()} or {None: [np.zeros(0)] * len(features)}
        codes = ce.sizes(list(cuts.values()))
        if kind == "regression":
            ranges = rows.sparkSession.createDataFrame([(name, low, high) for name, (low, high, _) in found.items()], "model string, low double, high double")
            y = F.when(F.col("high") > F.col("low"), (F.col("y") - F.col("low")) / (F.col("high") - F.col("low")) - 0.5).otherwise(F.col("y"))
            rows = rows.join(F.broadcast(ranges), "model").select("model", "x", y.alias("y"))  # a row for each model
            scale = max([0.5, *(abs(low) for low, high, _ in found.values() if low == high)])
            guesses = ce.sigma_guesses(rows, "model", len(features)) if s.specification != "naive" and found else {}
        coded, names = ce.coded(rows, cuts, of="model")
        parts = ce.counted(coded, ["model", *names], scale) if kind == "regression" else coded.groupBy("model", *names, "y").agg(F.count("*").alias("n"))

    def over_rows(g: pd.DataFrame, child):
        """What may ask for single rows gets them."""
        x, y = np.stack(g["x"].to_numpy()).astype(float), g["y"].to_numpy(dtype=float)
        order = np.lexsort([*x.T[::-1], y])
        x, y = x[order], y[order]
        own = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, max_bins, endpoint=False))) for k in range(x.shape[1])]
        low, high = float(y.min()), float(y.max())
        if kind == "logistic":
            return LogisticChain(x, y.astype(int), own, s, child, categories), low, high, len(x)
        scaled = (y - low) / (high - low) - 0.5 if kind == "regression" and high > low else y
        return RegressionChain(x, scaled, own, s, child, kind == "probit"), low, high, len(x)

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        name, chain_id = str(key[0]), int(key[1])
        child = np.random.default_rng([seed, chain_id, *name.encode()])
        if whole:
            chain, low, high, size = over_rows(g, child)
        else:
            low, high, own = found[name]
            chain, size = ce.chain_of(g, names, own, kind, own, s, child, categories, scale, guesses.get(name), codes)[1], int(g["n"].sum())
        out = []
        for draw, state in chain.run(None, each, s.nskip):
            for c, trees in enumerate(state["trees"] if kind == "logistic" else [state["trees"]]):
                out.append((name, chain_id, draw, c, state["sigma2"], low, high, size, _pack(trees)))
        return pd.DataFrame(out, columns=["model", "chain", "draw", "category", "sigma2", "low", "high", "rows", "trees"])

    spread = parts.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    return stored(spread.groupBy("model", "chain").applyInPandas(fit, TRACE), "models")


def fit_each(df: DataFrame, by: str, features: list[str], target: str, kind: str = "regression", chains: int = 1, seed: int = 42, max_bins: int = 100, categories: int = 2, **settings) -> Models:
    """A model for each value of `by`, from its rows alone, with thresholds and a range of its own.

    Every (model, chain) is one task that holds the cells of the model's rows (the rows themselves with moves,
    a prior or a likelihood of one's own).  Rows with a null among by, features and target are
    left out.  Classes of a probit or logistic model are numbers from 0.
    """
    if kind not in ("regression", "probit", "logistic"):
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "logistic":
        settings = {"n_trees": 25, "moves": {"grow": 0.5, "prune": 0.5}} | settings
    s = Settings(**settings)
    return Models(by, features, target, kind, s, chains, seed, max_bins, categories, _run(df, by, features, target, kind, s, chains, seed, max_bins, categories))
