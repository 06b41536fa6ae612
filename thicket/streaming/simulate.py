"""Bandit loops: simulated scenarios and replay of logs, in parallel over simulations and agents, and the same
replay as a stateful stream."""

from __future__ import annotations

import json
import pickle
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from thicket.operators.analytics import empirical_outcome
from thicket.streaming.agents import make


class Scenario:
    """Uniform contexts and a mean reward for each arm; rewards add normal noise of variance sigma2."""

    def __init__(self, features: int, arms: int, sigma2: float = 0.1, seed: int = 0, most: int | None = None) -> None:
        self.features, self.arms, self.sigma2, self.most = features, arms, sigma2, most
        self.reseed(seed)

    def reseed(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def context(self) -> np.ndarray:
        return self.rng.random(self.features)

    def means(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def rewards(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = self.means(x)
        return mean, mean + np.sqrt(self.sigma2) * self.rng.standard_normal(self.arms)


class LinearScenario(Scenario):
    """Mean rewards that are linear in the context."""

    def reseed(self, seed: int) -> None:
        super().reseed(seed)
        self.w = self.rng.uniform(-1, 1, (self.arms, self.features))

    def means(self, x: np.ndarray) -> np.ndarray:
        return self.w @ x


class StepScenario(LinearScenario):
    """Mean rewards that jump with one feature for each arm."""

    def means(self, x: np.ndarray) -> np.ndarray:
        return np.array([1.0 if x[a % self.features] > 0.5 else 0.2 * a / self.arms for a in range(self.arms)])


class TableScenario(Scenario):
    """Contexts of a table in turn, and the chance of a hit for each context and arm."""

    def __init__(self, contexts: np.ndarray, chances: np.ndarray, seed: int = 0) -> None:
        self.contexts, self.chances, self.at = contexts, chances, -1
        super().__init__(contexts.shape[1], chances.shape[1], 0.0, seed, len(contexts))

    def context(self) -> np.ndarray:
        self.at = (self.at + 1) % len(self.contexts)
        return self.contexts[self.at]

    def rewards(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.chances[self.at]
        return p, (self.rng.random(self.arms) < p).astype(float)


SCENARIOS: dict[str, Callable[[int, int, float, int], Scenario]] = {"linear": LinearScenario, "step": StepScenario}


def scenario_of_log(log: DataFrame, context: list[str], arm: str, hit, arms: int, seed: int = 0) -> TableScenario:
    """A scenario from logged events: its contexts in their order, each once, with each arm's share of hits in that
    context (0.5 where nothing was seen).  The contexts are few; they go to the driver."""
    every = log.sparkSession.range(arms).select(F.col("id").cast("int").alias(arm))
    found = empirical_outcome(log.withColumn(arm, F.col(arm).cast("int")), context, arm, hit, every).orderBy(*context, arm).toPandas()
    chances = found["p"].to_numpy(dtype=float).reshape(-1, arms)
    return TableScenario(found[context].to_numpy(dtype=float)[::arms], chances, seed)


def simulate(scenario: Scenario, agents: dict, draws: int, on_draw: Callable | None = None, on_metrics: Callable | None = None, every: int = 1) -> list[tuple]:
    """(agent, draw, arm, regret, secs) of every step; each agent sees the same contexts and rewards.

    on_draw(draw, agents) is called after every step, on_metrics(draw, {agent: (cumulative regret, seconds)}) after
    every `every` steps and the last.  Errors of callbacks are ignored, and agents are closed at the end."""
    out = []
    sums = {name: [0.0, 0.0] for name in agents}
    last = min(draws, scenario.most or draws)
    try:
        for draw in range(1, last + 1):
            x = scenario.context()
            mean, reward = scenario.rewards(x)
            for name, agent in agents.items():
                begun = time.perf_counter()
                arm = agent.choose(x)
                agent.update(arm, x, float(reward[arm]))
                out.append((name, draw, int(arm), float(mean.max() - mean[arm]), time.perf_counter() - begun))
                sums[name][0] += out[-1][3]
                sums[name][1] += out[-1][4]
            told = on_metrics is not None and (draw % every == 0 or draw == last)
            for call in ((on_draw, (draw, agents)) if on_draw else None, (on_metrics, (draw, {k: tuple(v) for k, v in sums.items()})) if told else None):
                try:
                    if call is not None:
                        call[0](*call[1])
                except Exception:  # noqa: BLE001, S110
                    pass
    finally:
        for agent in agents.values():
            agent.close()
    return out


SIM = "scenario string, sim long, agent string, draw long, arm long, regret double, secs double"


def compare(spark: SparkSession, scenarios: dict[str, dict], agents: dict[str, dict], sims: int, draws: int) -> DataFrame:
    """Every scenario and simulation in a task of its own; the seed is the simulation's number."""
    grid = spark.createDataFrame([(s, i) for s in scenarios for i in range(sims)], "scenario string, sim long")

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        name, sim = key
        spec = scenarios[name]
        world = SCENARIOS[spec["kind"]](spec["features"], spec["arms"], spec.get("sigma2", 0.1), int(sim))
        made = {a: make(s | {"arms": spec["arms"], "features": spec["features"]}, int(sim)) for a, s in agents.items()}
        rows = [(name, sim, *r) for r in simulate(world, made, draws)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SIM.split(", ")])

    return grid.groupBy("scenario", "sim").applyInPandas(run, SIM)


def replay_log(rows, agent, choices: int = 1, mode: str = "replay") -> Iterator[tuple]:
    """(t, action, first, matched, share) of each logged event: the agent chooses `choices` times and learns from the
    logged reward when its first choice is the logged action ("replay"), or always ("logged")."""
    if mode not in ("replay", "logged"):
        raise ValueError(f"unknown mode {mode!r}")
    for t, x, action, reward in rows:
        chosen = [agent.choose(x) for _ in range(choices)]
        learn = mode == "logged" or chosen[0] == action
        if learn:
            agent.update(action, x, reward)
        yield t, action, int(chosen[0]), int(learn), (np.bincount(chosen, minlength=agent.arms) / choices).tolist()


#: Events that are replayed at a time.
REPLAY_ROWS = 1 << 16


def _events(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """t, x, action and reward as arrays, which take a fraction of the frame's memory."""
    x = np.stack(frame["x"].to_numpy()).astype(float) if len(frame) else np.zeros((0, 0))
    return frame["t"].to_numpy(), x, frame["action"].to_numpy(), frame["reward"].to_numpy(dtype=float)


def _replayed(name: str, events: tuple[np.ndarray, ...], agent, choices: int, mode: str) -> Iterator[pd.DataFrame]:
    """The replay of events in their order, some at a time, all of those at once where the agent can."""
    if mode not in ("replay", "logged"):
        raise ValueError(f"unknown mode {mode!r}")
    columns = [c.split()[0] for c in REPLAY.split(", ")]
    for k in range(0, len(events[0]), REPLAY_ROWS):
        t, x, action, reward = (c[k : k + REPLAY_ROWS] for c in events)
        plain = action.dtype.kind == "i" and np.isfinite(x).all() and np.isfinite(reward).all()
        made = agent.replay_block(x, action, reward, choices, mode == "logged") if plain and hasattr(agent, "replay_block") else None
        if made is None:
            yield pd.DataFrame([(name, *r) for r in replay_log(zip(t, x, action, reward, strict=True), agent, choices, mode)], columns=columns)
            continue
        chosen, learnt = made
        share = (chosen[:, :, None] == np.arange(agent.arms)).sum(axis=1) / choices
        yield pd.DataFrame(dict(zip(columns, (name, t, action, chosen[:, 0], np.asarray(learnt).astype(int), list(share)), strict=True)))


REPLAY = "agent string, t long, action int, first int, matched int, share array<double>"


def rebased(log: DataFrame, action: str = "action") -> DataFrame:
    """Actions from 0, if the smallest is 1."""
    low = F.broadcast(log.agg(F.min(action).alias("__low")))
    return log.join(low, F.lit(True)).withColumn(action, F.when(F.col("__low") == 1, F.col(action) - 1).otherwise(F.col(action)).cast("int")).drop("__low")


def replay(log: DataFrame, agents: dict[str, dict], choices: int = 1, mode: str = "replay", seed: int = 0) -> DataFrame:
    """Replay of a log (t, x, action, reward) by each agent, in the order of t; agents run in parallel, and each holds
    only its own state: the rows of one agent stream through its task."""
    names = F.explode(F.array(*[F.lit(a) for a in agents]))
    spread = rebased(log).select(names.alias("agent"), F.col("t").cast("long").alias("t"), F.col("x").cast("array<double>").alias("x"), "action", F.col("reward").cast("double").alias("reward"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, agent = None, None
        for frame in frames:
            for name, part in frame.groupby("agent", sort=False):
                if name != now:
                    now, agent = name, make(agents[name], seed)
                yield from _replayed(name, _events(part), agent, choices, mode)

    return spread.repartition("agent").sortWithinPartitions("agent", "t").mapInPandas(run, REPLAY)


class Seen:
    """An agent's log whose earlier part stands in a list state, and is read only when a refit goes through it."""

    def __init__(self, state, before: int) -> None:
        self.state, self.before, self.new = state, before, []

    def append(self, entry: tuple) -> None:
        self.new.append(entry)

    def __len__(self) -> int:
        return self.before + len(self.new)

    def __iter__(self) -> Iterator[tuple]:
        if self.before:
            yield from ((int(a), np.asarray(x, dtype=float), float(r)) for a, x, r in self.state.get())
        yield from self.new


class Replayer(StatefulProcessor):
    """An agent in a value state, and what it has seen in a list state to which each batch appends."""

    def __init__(self, agents: dict[str, dict], choices: int, mode: str, seed: int) -> None:
        self.agents, self.choices, self.mode, self.seed = agents, choices, mode, seed

    def init(self, handle) -> None:
        self.agent = handle.getValueState("agent", "body binary")
        self.log = handle.getListState("log", "arm int, x array<double>, reward double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        agent = pickle.loads(self.agent.get()[0]) if self.agent.exists() else make(self.agents[key[0]], self.seed)
        seen = Seen(self.log, sum(agent.counts)) if hasattr(agent, "counts") else None
        if seen is not None:
            agent.log = seen
        part = pd.concat(list(rows)).sort_values("t")
        out = [(key[0], *r) for r in replay_log(zip(part["t"], part["x"], part["action"], part["reward"], strict=True), agent, self.choices, self.mode)]
        if seen is not None:
            agent.log = []
            if seen.new:
                self.log.appendList([(a, x.tolist(), r) for a, x, r in seen.new])
        self.agent.update((pickle.dumps(agent),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLAY.split(", ")])

    def close(self) -> None:
        pass


def replay_stream(stream: DataFrame, agents: dict[str, dict], choices: int = 1, mode: str = "replay", seed: int = 0, appended: bool = False) -> DataFrame:
    """The same over a stream of (t, x, action, reward): agents live in the operator's state between micro-batches.
    Events of a batch are taken in the order of t; order across batches is that of arrival.

    The state of a random or linear agent is of fixed size.  A tree agent's holds what it has seen and is written whole
    with every batch; `appended` keeps that in a list to which a batch only adds (it needs the RocksDB state store)."""
    if appended:
        spread = stream.select(F.explode(F.array(*[F.lit(a) for a in agents])).alias("agent"), F.col("t").cast("long").alias("t"), F.col("x").cast("array<double>").alias("x"), F.col("action").cast("int").alias("action"), F.col("reward").cast("double").alias("reward"))
        return spread.groupBy("agent").transformWithStateInPandas(Replayer(agents, choices, mode, seed), REPLAY, "append", "None")
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = F.explode(F.array(*[F.lit(a) for a in agents]))
    spread = stream.select(names.alias("agent"), F.col("t").cast("long").alias("t"), F.col("x").cast("array<double>").alias("x"), F.col("action").cast("int").alias("action"), F.col("reward").cast("double").alias("reward"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        agent = pickle.loads(state.get[0]) if state.exists else make(agents[key[0]], seed)
        parts = [_events(f) for f in frames if len(f)]
        events = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.argsort(events[0], kind="stable")
        yield from _replayed(key[0], tuple(c[order] for c in events), agent, choices, mode)
        state.update((pickle.dumps(agent),))

    return spread.groupBy("agent").applyInPandasWithState(run, REPLAY, "agent binary", "append", GroupStateTimeout.NoTimeout)


def linear_statistics(log: DataFrame, features: int, arm: str = "action", x: str = "x", reward: str = "reward") -> DataFrame:
    """For each arm the sums of x x' (rows of the upper triangle) and x r, intercept last: partial sums are merged, so
    the same aggregate serves a batch and a stream."""
    z = [F.get(x, k).cast("double") for k in range(features)] + [F.lit(1.0)]
    sums = [F.sum(z[i] * z[j]).alias(f"b_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    return log.groupBy(arm).agg(*sums, *[F.sum(c * F.col(reward)).alias(f"m_{i}") for i, c in enumerate(z)])


def gather_statistics(stats: DataFrame, features: int, arms: int, arm: str = "action") -> list[tuple[np.ndarray, np.ndarray]]:
    """The sums of every arm as matrices; arms without rows have zeros."""
    d = features + 1
    out = [(np.zeros((d, d)), np.zeros(d)) for _ in range(arms)]
    for r in stats.collect():
        g = np.array([[r[f"b_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        out[r[arm]] = (g, np.array([r[f"m_{i}"] for i in range(d)]))
    return out


def to_json_lines(sim: DataFrame, path: str) -> None:
    """One JSON object for each scenario and simulation: agents, regrets and times by draw."""
    point = F.struct("draw", "regret", "secs")
    by = sim.groupBy("scenario", "sim", "agent").agg(F.sort_array(F.collect_list(point)).alias("points"))
    by.groupBy("scenario", "sim").agg(F.sort_array(F.collect_list(F.struct("agent", "points"))).alias("agents")).write.json(path)


def read_json_lines(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """Back to rows; agents whose name matches `without` are left out, and an agent that several files hold for the
    same simulation counts once."""
    raw = spark.read.schema("scenario string, sim long, agents array<struct<agent:string,points:array<struct<draw:long,regret:double,secs:double>>>>").json(path)
    rows = raw.select("scenario", "sim", F.inline("agents")).select("scenario", "sim", "agent", F.inline("points"))
    rows = rows.dropDuplicates(["scenario", "sim", "agent", "draw"])
    return rows.where(~F.col("agent").rlike(without)) if without else rows


def describe(agents: dict[str, dict]) -> str:
    return json.dumps(agents, sort_keys=True)
