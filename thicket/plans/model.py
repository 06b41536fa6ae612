"""Sums of trees fitted by chains in parallel tasks; a model is a trace of posterior draws."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import special as sp
from thicket.operators import diagnostics as dg
from thicket.operators import forest as fo
from thicket.operators import posterior as po
from thicket.operators import traces as tr
from thicket.operators.preprocess import Preprocessor, decode_labels, encode_labels, vocabulary
from thicket.plans import cells as ce
from thicket.plans.chain import LogisticChain, RegressionChain, Settings, Tree
from thicket.plans.summed import Grid
from thicket.sources.files import stored

NODE = "struct<node:int,var:int,thr:double,leaf:double>"
TRACE = f"chain int, shard int, draw int, category int, sigma2 double, s array<double>, trees array<array<{NODE}>>"
MOVES = "chain int, shard int, move string, selected long, proposed long, accepted long"


def _pack(trees: list[Tree]) -> list[list[tuple]]:
    return [[(i, v, t, 0.0) for i, (v, t) in sorted(t_.rules.items())] + [(i, -1, 0.0, v) for i, v in sorted(t_.leaves.items())] for t_ in trees]


def _unpack(packed, x: np.ndarray | Grid) -> list[Tree]:
    out = []
    for nodes in packed:
        rules = {int(n[0]): (int(n[1]), float(n[2])) for n in nodes if n[1] >= 0}
        leaves = {int(n[0]): float(n[3]) for n in nodes if n[1] < 0}
        out.append(x.tree(rules, leaves) if isinstance(x, Grid) else Tree(rules, leaves, np.zeros(0, dtype=np.int64)).extend(x, 0))
    return out


@dataclass
class Model:
    """A fitted model.  `kind` is regression, probit or logistic; the trace has a row for each chain, shard, draw and
    category."""

    kind: str
    prep: Preprocessor
    settings: Settings
    chains: int
    seed: int
    trace: DataFrame
    moves: DataFrame
    words: DataFrame | None = None
    categories: int = 1
    shards: int = 1
    rows: DataFrame | None = field(default=None, repr=False)
    _found: list | None = field(default=None, repr=False)

    # -- trace ------------------------------------------------------------------------------------------------

    @property
    def per_chain(self) -> int:
        return math.ceil(self.settings.ndpost / self.chains)

    def _draws(self) -> list[tuple[int, int, float]]:
        """(chain, draw, noise variance) of the draws after the initial state, chain after chain; with shards the mean of
        their variances.  Three numbers a draw are all of the trace that the driver gets."""
        if self._found is None:
            rows = self.trace.where("draw >= 0 and category = 0").groupBy("chain", "draw").agg(F.avg("sigma2").alias("v")).collect()
            self._found = sorted((r["chain"], r["draw"], r["v"]) for r in rows)
        return self._found

    def _keys(self) -> list[tuple[int, int]]:
        """(chain, draw) of the posterior draws, chain after chain, as many as were asked for."""
        return [(c, d) for c, d, _ in self._draws()[: self.settings.ndpost]]

    def trace_length(self) -> int:
        return self.trace.where("chain = 0 and shard = 0 and category = 0").count()

    def params(self) -> dict:
        return self.settings.plain() | {"kind": self.kind, "chains": self.chains, "seed": self.seed, "max_bins": self.prep.max_bins}

    def nodes(self) -> DataFrame:
        """(chain, shard, draw, category, tree, node, var, thr, leaf)."""
        keys = ["chain", "shard", "draw", "category"]
        by_tree = self.trace.where("draw >= 0").select(*keys, F.posexplode("trees").alias("tree", "nodes"))
        return by_tree.select(*keys, "tree", F.inline("nodes"))

    # -- evaluation -------------------------------------------------------------------------------------------

    def _features(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in self.prep.features]))

    def _sums(self, df: DataFrame, places: list[tuple[int, int, int, float]], columns: int, out: str, then: tuple | None = None) -> DataFrame:
        """Adds an array of `columns` weighted sums of draws; places are (chain, draw, column, weight), and a draw's
        categories follow each other from its column on.  The trace stays a table: its draws are packed by tasks and
        reach the rows in chunks."""
        spark = df.sparkSession
        at = F.broadcast(spark.createDataFrame(places, "__c int, __d int, __k int, __w double"))  # four numbers a draw
        there = self.trace.join(at, (F.col("chain") == F.col("__c")) & (F.col("draw") == F.col("__d")))
        return tr.evaluated(self._features(df), there, F.col("__k") + F.col("category"), F.col("__w") / self.shards, columns, "__x", out, then=then).drop("__x")

    def _values(self, df: DataFrame, keys: list[tuple[int, int]], out: str, then: tuple | None = None) -> DataFrame:
        """Latent draws, for each all categories; with shards, the mean of the shards' draws (consensus)."""
        n = self.categories if self.kind == "logistic" else 1
        return self._sums(df, [(c, d, k * n, 1.0) for k, (c, d) in enumerate(keys)], len(keys) * n, out, then)

    def posterior_f(self, df: DataFrame, out: str = "draws", backtransform: bool = True) -> DataFrame:
        """Adds the posterior draws of f, an array for each row; for several categories an array of draws by category."""
        made = self._values(df, self._keys(), out)
        if self.kind == "logistic":
            draws = F.sequence(F.lit(0), F.lit(len(self._keys()) - 1))
            return made.withColumn(out, F.transform(draws, lambda k: F.slice(F.col(out), k * self.categories + 1, self.categories)))
        if self.kind != "regression" or not backtransform:
            return made
        factor, offset = self.prep.scale()
        return made.withColumn(out, F.transform(out, lambda z: z * F.lit(factor) + F.lit(offset)))

    def predict_trace(self, df: DataFrame, k: int, out: str = "f") -> DataFrame:
        """f of posterior draw k alone; logistic models give class probabilities."""
        key = self._keys()[k]
        made = self._values(df, [key], out)
        if self.kind == "logistic":
            return made.withColumn(out, _softmax(F.col(out)))
        value = F.get(out, 0)
        return made.withColumn(out, self.prep.backtransform(value) if self.kind == "regression" else value)

    def proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        """Class probabilities for each draw: of class 1 (probit), or of all classes (logistic)."""
        return self._classes(df, None, 0, out, None)

    def _classes(self, df: DataFrame, key: str | None, seed: int, proba: str | None, out: str | None) -> DataFrame:
        """Adds each draw's class probabilities, its drawn class for the row's key, or both: made where the draws are."""
        keys, logistic = self._keys(), self.kind == "logistic"
        shape = (-1, len(keys), self.categories) if logistic else (-1, len(keys))
        link, draw = (sp.softmax, po.drawn_class) if logistic else (sp.normal_cdf_near, po.drawn_binary)
        at = None if out is None else df.columns.index(key)

        def make(batch: pa.RecordBatch, f: np.ndarray) -> list[pa.Array]:
            p = link(f.reshape(shape))
            made = [] if proba is None else [tr.listed(p)]
            return made if at is None else [*made, tr.listed(draw(p, po.uniforms(po.whole_keys(batch.column(at)), seed, len(keys))))]

        named = [(name, mine, kind) for name, mine, kind in ((proba, "__p", "array<array<double>>" if logistic else "array<double>"), (out, "__c", "array<int>")) if name is not None]
        made = self._values(df, keys, "__f", (", ".join(f"{mine} {kind}" for _, mine, kind in named), make))
        return made.withColumns({name: F.col(mine) for name, mine, _ in named}).drop("__p", "__c")

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        """Mean probability of each class; a regression is clipped to [0, 1]."""
        if self.kind == "regression":
            p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__mean")))
            return self.predict(df, "__mean").withColumn(out, F.array(1 - p, p)).drop("__mean")
        made = self.proba(df, "__each")
        if self.kind == "probit":
            p = po.array_mean(F.col("__each"))
            return made.withColumn(out, F.array(1 - p, p)).drop("__each")
        one = lambda c: po.array_mean(F.transform("__each", lambda z: F.get(z, c)))
        return made.withColumn(out, F.array(*[one(c) for c in range(self.categories)])).drop("__each")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Posterior mean (regression), or the index of the likelier class and its label in out + "_label"."""
        if self.kind == "regression":
            # the mean of the chains' means, untrimmed with several chains: one weighted sum, without an array of draws
            found = self._draws() if self.chains > 1 else self._draws()[: self.settings.ndpost]
            sizes = Counter(c for c, _, _ in found)
            factor, offset = self.prep.scale()
            made = self._sums(df, [(c, d, 0, 1 / (sizes[c] * len(sizes))) for c, d, _ in found], 1, "__d")
            return made.withColumn(out, F.get("__d", 0) * F.lit(factor) + F.lit(offset)).drop("__d")
        made = self.predict_proba(df, "__p")
        best = F.array_position("__p", F.array_max("__p")).cast("int") - 1
        if self.kind == "probit":
            best = (F.get("__p", 1) >= 0.5).cast("int")
        made = made.withColumn(out, best).drop("__p")
        return decode_labels(made, out, self.words, f"{out}_label") if self.words is not None else made

    def posterior_predict(self, df: DataFrame, key: str, seed: int = 0, out: str = "predicted", proba: str | None = None) -> DataFrame:
        """Draws of new targets: noise of the same draw's variance on the scaled axis, or classes.  With `proba` the
        probabilities that classes are drawn from are added too, as by `proba()`, from the same evaluation."""
        if self.kind == "regression":
            sigma = [v for _, _, v in self._draws()[: self.settings.ndpost]]
            made = po.predictive(self.posterior_f(df, "__d", backtransform=False), key, sigma, seed, "__d", out)
            factor, offset = self.prep.scale()
            return made.withColumn(out, F.transform(out, lambda z: z * F.lit(factor) + F.lit(offset))).drop("__d")
        return self._classes(df, key, seed, proba, out)

    def sample(self, schedule: Callable[[int], float], seed: int) -> int:
        """A posterior draw chosen with weights schedule(k)."""
        w = np.array([schedule(k) for k in range(len(self._keys()))], dtype=float)
        return int(np.random.default_rng(seed).choice(len(w), p=w / w.sum()))

    def posterior_sample(self, df: DataFrame, schedule: Callable[[int], float], seed: int, out: str = "f") -> DataFrame:
        """f of one posterior draw, chosen with weights schedule(k); logistic models give class probabilities."""
        return self.predict_trace(df, self.sample(schedule, seed), out)

    # -- control ------------------------------------------------------------------------------------------------

    @property
    def is_fitted(self) -> bool:
        return not self.trace.isEmpty()

    def range_post(self) -> range:
        """The posterior draws among the trace's: the last ndpost."""
        n = len(self._draws())
        if n < self.settings.ndpost:
            raise ValueError("fewer draws than asked for")
        return range(n - self.settings.ndpost, n)

    def set_ndpost(self, n: int) -> Model:
        """The model with n draws from now on, in what it predicts and in later updates."""
        return replace(self, settings=replace(self.settings, ndpost=n))

    def set_max_bins(self, n: int) -> Model:
        """The model with n bins in later fits; the thresholds of its rows stay."""
        return replace(self, prep=replace(self.prep, max_bins=n))

    # -- importance and diagnostics ---------------------------------------------------------------------------

    def histogram(self) -> DataFrame:
        """Splits on each feature by chain and draw.  A draw of a model with shards is the mean of the shards' forests, so
        that the splits of all of them are its own."""
        return po.split_histogram(self.nodes().where("category = 0"), len(self.prep.features), ("chain", "draw"))

    def inclusion_probability(self) -> DataFrame:
        return po.inclusion_probability(self.histogram())

    def inclusion_frequency(self, kind: str = "split") -> DataFrame:
        if self.chains > 1 and kind == "split":
            return po.chain_frequency(self.histogram())
        return po.inclusion_frequency(self.histogram(), kind, ("chain", "draw"))

    def sigma_chains(self) -> DataFrame:
        """(chain, draw, value) of the noise variance; with shards, the mean of theirs."""
        return self.trace.where("draw >= 0 and category = 0").groupBy("chain", "draw").agg(F.avg("sigma2").alias("value"))

    def value_chains(self, probes: DataFrame, key: str) -> DataFrame:
        """(key, chain, draw, value) of f on probes."""
        keys = [(c, d) for c, d, _ in self._draws()]
        made = self._values(probes, keys, "__d")
        if self.kind == "logistic":  # of the first category
            made = made.withColumn("__d", F.transform(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda k: F.get("__d", k * self.categories)))
        places = F.array(*[F.struct(F.lit(c).alias("chain"), F.lit(d).alias("draw")) for c, d in keys])
        return made.select(key, F.explode(F.arrays_zip(F.col("__d").alias("value"), places.alias("at"))).alias("z")).select(key, "z.at.chain", "z.at.draw", "z.value")

    def diagnostics(self, probes: DataFrame, key: str) -> DataFrame:
        """(key, rhat, ess_bulk, mcse, mcse_sd) of f's chains on each probe, where it is."""
        keys = [(c, d) for c, d, _ in self._draws()]
        made = self._values(probes, keys, "__d")
        if self.kind == "logistic":  # of the first category
            made = made.withColumn("__d", F.transform(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda k: F.get("__d", k * self.categories)))
        return dg.rank_diagnostics_of_rows(made, [key], "__d", list(Counter(c for c, _ in keys).values()))

    def collect(self, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """Any function of each chain's part of the trace, with the trees as JSON text."""
        return self.trace.withColumn("trees", F.to_json("trees")).groupBy("chain").applyInPandas(func, schema)

    def without(self, k: int) -> Model:
        """The model without posterior draw k."""
        chain, draw = self._keys()[k]
        return replace(self, trace=self.trace.where(~((F.col("chain") == chain) & (F.col("draw") == draw))), settings=replace(self.settings, ndpost=self.settings.ndpost - 1), _found=None)

    # -- more rows --------------------------------------------------------------------------------------------

    def update(self, more: DataFrame, ndpost: int | None = None) -> Model:
        """The chains go on from their last states over the old rows and the new.  Thresholds and the target's range
        stay; the draws are replaced."""
        if self.rows is None:
            raise ValueError("a model without its rows can't go on")
        old, s = self.rows, self.settings
        rows = old.unionByName(_prepared(more, self.prep, self.kind, self.words).select(*old.columns))
        last = {(r["chain"], r["shard"], r["category"]): r for r in self.trace.where(F.col("draw") == self.trace.agg(F.max("draw")).first()[0]).collect()}
        return _run(self.kind, rows, self.prep, replace(s, ndpost=ndpost or s.ndpost), self.chains, self.seed + 1, self.shards, self.words, self.categories, last)

    # -- files --------------------------------------------------------------------------------------------------

    def save(self, path: str, rows: bool = True) -> None:
        """trace, moves, words and the prepared rows as Parquet, and meta as JSON text.  Without the rows a loaded model
        predicts but can't be updated; functions among the settings are not kept."""
        meta = {"kind": self.kind, "chains": self.chains, "seed": self.seed, "categories": self.categories, "shards": self.shards, "prep": asdict(self.prep), "settings": self.settings.plain(), "rows": rows and self.rows is not None}
        if meta["rows"]:
            self.rows.write.parquet(f"{path}/rows")
        self.trace.write.parquet(f"{path}/trace")
        self.moves.write.parquet(f"{path}/moves")
        if self.words is not None:
            self.words.write.parquet(f"{path}/words")
        self.trace.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        words = spark.read.parquet(f"{path}/words") if meta["kind"] != "regression" else None
        rows = spark.read.parquet(f"{path}/rows") if meta.get("rows") else None
        return Model(meta["kind"], Preprocessor(**meta["prep"]), Settings(**meta["settings"]), meta["chains"], meta["seed"], spark.read.parquet(f"{path}/trace"), spark.read.parquet(f"{path}/moves"), words, meta["categories"], meta["shards"], rows)


def _softmax(scores: Column) -> Column:
    def over(z: Column) -> Column:
        e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    return F.element_at(F.transform(F.array(scores), over), 1)


def _prepared(df: DataFrame, prep: Preprocessor, kind: str, words: DataFrame | None) -> DataFrame:
    if kind == "regression":
        made = prep.transform(df, "__y")
    else:
        made = encode_labels(prep.transform(df, target=False), prep.target, words, "__y").withColumn("__y", F.col("__y").cast("double"))
    whole = F.col("__y").isNotNull() & F.forall("x", lambda v: v.isNotNull())
    return made.where(whole).select("x", F.col("__y").alias("y"))


def _run(kind, rows, prep, s: Settings, chains, seed, shards, words, categories, last=None, boosted=None, sampler=None) -> Model:
    """One task for each (chain, shard), to which the cells of its rows come, sorted so that the result depends on the seed
    alone.  What may ask for single rows (a sampler, moves, prior or likelihood of one's own) gets the rows themselves."""
    per_chain = math.ceil(s.ndpost / chains)
    thresholds = [np.array(t) for t in prep.thresholds]
    start = None if last is None else {k: [[tuple(n) for n in t] for t in r["trees"]] for k, r in last.items()}
    sigma = None if last is None else {k: (r["sigma2"], None if r["s"] is None else list(r["s"])) for k, r in last.items()}
    skip = 0 if last is not None else s.nskip
    whole = sampler is not None or s.likelihood is not None or s.prior is not None or bool(s.proposals)
    parts = rows.withColumn("shard", F.pmod(F.xxhash64("x", "y"), F.lit(shards)).cast("int"))
    cuts = ce.all_cuts(thresholds, [*(boosted or []), *(t for trees in (start or {}).values() for t in trees)])
    scale, guesses, names = 1.0, {}, []
    if not whole:
        coded, names = ce.coded(parts, cuts)
        if kind == "regression":
            scale = rows.agg(F.max(F.abs("y")).alias("m")).first()["m"] or 1.0
            guesses = ce.sigma_guesses(parts, "shard", len(cuts)) if s.specification != "naive" else {}
            parts = ce.counted(coded, ["shard", *names], scale)
        else:
            parts = coded.groupBy("shard", *names, "y").agg(F.count("*").alias("n"))

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        chain_id, shard = map(int, key)
        child = np.random.SeedSequence(seed).spawn(chains)[chain_id].spawn(shards)[shard]
        if whole:
            x = np.stack(g["x"].to_numpy())
            y = g["y"].to_numpy()
            order = np.lexsort([*x.T[::-1], y])
            x, y = x[order], y[order]
            if sampler is not None:
                chain = sampler(x, y, thresholds, s, child)
            else:
                chain = LogisticChain(x, y, thresholds, s, child, categories) if kind == "logistic" else RegressionChain(x, y, thresholds, s, child, kind == "probit")
        else:
            x, chain = ce.chain_of(g, names, cuts, kind, thresholds, s, child, categories, scale, guesses.get(shard))
        state = None
        if boosted is not None:
            state = chain.warm(_unpack(boosted, x))
        if start is not None:
            packed = [_unpack(start[(chain_id, shard, c)], x) for c in range(categories if kind == "logistic" else 1)]
            value, weights = sigma[(chain_id, shard, 0)]
            state = {"sigma2": value, "s": None if weights is None else np.array(weights), "trees": packed if kind == "logistic" else packed[0]}
        out = []
        for draw, st in chain.run(state, per_chain, skip):
            for c, trees in enumerate(st["trees"] if kind == "logistic" else [st["trees"]]):
                out.append((chain_id, shard, draw, c, st["sigma2"], None if st["s"] is None else list(st["s"]), _pack(trees), None))
        counts = json.dumps(chain.proposer.counts)
        out.append((chain_id, shard, -9, 0, 0.0, None, [], counts))
        return pd.DataFrame(out, columns=["chain", "shard", "draw", "category", "sigma2", "s", "trees", "counts"])

    spread = parts.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    result = stored(spread.groupBy("chain", "shard").applyInPandas(fit, TRACE + ", counts string"), "trace")
    trace = result.where("draw > -9").drop("counts")
    parsed = F.from_json("counts", "map<string,array<long>>")
    moves = result.where("draw = -9").select("chain", "shard", F.explode(parsed).alias("move", "n")).select("chain", "shard", "move", F.get("n", 0).alias("selected"), F.get("n", 1).alias("proposed"), F.get("n", 2).alias("accepted"))
    return Model(kind, prep, s, chains, seed, trace, moves, words, categories, shards, rows)


def fit(df: DataFrame, features: list[str], target: str, kind: str = "regression", chains: int = 1, seed: int = 42, max_bins: int = 100, shards: int = 1, boosted: list | None = None, prep: Preprocessor | None = None, sampler: Callable | None = None, **settings) -> Model:
    """Fits a model; rows with a null feature or target are left out.

    `boosted`, the dump of a gradient-boosted forest on the features, starts the chains of a regression: they take its
    trees, redraw each tree's leaves given the others and the noise, and go on from there.  `prep` replaces the
    preprocessor, `sampler(x, y, thresholds, settings, seed)` the chain; moves, prior and likelihood of one's own are
    among the settings.

    Chains run in parallel, each in one task that holds the cells of the rows: at most as many as the product of the numbers
    of bins, however many rows there are (all rows with a sampler, moves, prior or likelihood of one's own).  With `shards` above
    1 a chain's rows are dealt to that many tasks whose draws are averaged (consensus Monte Carlo): another
    approximation of the posterior, so it has to be asked for.
    """
    if kind not in ("regression", "probit", "logistic"):
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "logistic":
        settings = {"n_trees": 25, "moves": {"grow": 0.5, "prune": 0.5}} | settings
    s = Settings(**settings)
    known = df.select(*features, target).where(F.col(target).isNotNull())
    for c in features:
        known = known.where(F.col(c).isNotNull())
    if boosted is not None:
        if kind != "regression":
            raise ValueError("only a regression starts from a boosted forest")
        boosted = [[(i, n.var, n.thr, n.leaf) for i, n in sorted(t.items())] for t in fo.from_boosted(boosted)]
        s = replace(s, n_trees=len(boosted))
    prep, words, categories = prep or Preprocessor(features, target, max_bins), None, 1
    if kind == "regression":
        prep.fit(known)
    else:
        from thicket.operators.preprocess import quantile_thresholds

        words = vocabulary(known, target)
        categories = words.count()
        if categories < 2 or kind == "probit" and categories != 2:
            raise ValueError("wrong number of classes")
        prep.thresholds = quantile_thresholds(known, features, max_bins)
    rows = _prepared(known, prep, kind, words)
    return _run(kind, rows, prep, s, chains, seed, shards, words, categories, None, boosted, sampler)


def from_boosted(spark: SparkSession, dump: list, prep: Preprocessor, sigma2: float = 1.0, settings: Settings | None = None) -> Model:
    """A model whose single draw is a gradient-boosted forest, on the scaled axis of prep."""
    trees = [[(i, n.var, n.thr, n.leaf) for i, n in sorted(t.items())] for t in fo.from_boosted(dump)]
    trace = spark.createDataFrame([(0, 0, 0, 0, sigma2, None, trees)], TRACE)
    s = settings or Settings(n_trees=len(trees), ndpost=1, nskip=0)
    return Model("regression", prep, replace(s, ndpost=1), 1, 0, trace, spark.createDataFrame([], MOVES))
