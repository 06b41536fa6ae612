"""Quality classifier from weak labels: expectation-maximisation estimates how accurate overlapping heuristic
labellers are, and the posterior labels train a hashed linear scorer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import lean, place_of, plain, table, utf8, with_columns

#: Frequent function words of English, French, German and Spanish.
COMMON = frozenset(
    "the of and to in a is that for it was with as on by this are be from or at an which et la le les de des un une que dans pour en est sur avec qui par au ce ne pas "
    "der die das und ist von zu den mit ein eine im für auf dem sich nicht es als auch el los las del y no se con su lo una por para más este si".split()
)
_COMMON = frozenset(w.encode() for w in COMMON)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if b not in _LETTERS)
_SPACE = b" \t\n\r\x0b\x0c"
_ODD = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and chr(b) not in ".,;:'\"-()?!")
_NOT_ODD = bytes(b for b in range(256) if b not in _ODD)
_STRIP = b".,;:!?'\"()"

#: A labeller votes 1 (good), 0 (bad) or 2 (abstains).  Most look for one kind of junk: its absence says little,
#: so they abstain then; function words and sentences speak for good text too.
LABELLERS = ("runs", "capitals", "symbols", "shouts", "lines", "variety", "separators", "function words", "sentences")
ABSTAIN = 2

#: Longer words count as pieces of so many bytes; words that a task remembers.
PIECE, REMEMBERED = 64, 150_000


class Kinds(dict):
    """What the labellers ask of a word, in bits: 1 a function word, 2 a lone odd character, 4 it ends a sentence.
    Filled as words come, cleared when full; long words are not remembered."""

    def __missing__(self, word: bytes) -> int:
        out = (word.lower().strip(_STRIP) in _COMMON) + 2 * (len(word) == 1 and word in _ODD) + 4 * (word[-1] in b".!?")
        if len(word) <= PIECE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


#: For each kind, the bytes that do not have its bit.
_WITHOUT = {bit: bytes(k for k in range(8) if not k & bit) for bit in (1, 2, 4)}


def votes(raw: bytes, kinds: Kinds | None = None) -> tuple[int, ...]:
    """The labellers' votes on one whole text; a text of fewer than five words gets none."""
    words = raw.split()
    n = len(words)
    if n < 5:
        return (ABSTAIN,) * len(LABELLERS)
    kinds = Kinds() if kinds is None else kinds
    bad = lambda x: 0 if x else ABSTAIN
    of = bytes(map(kinds.__getitem__, words))
    common, lone, ends = (len(of.translate(None, _WITHOUT[bit])) / n for bit in (1, 2, 4))
    same = sum(map(eq, words, islice(words, 1, None))) / (n - 1)
    upper = len(raw.translate(None, _NOT_UPPER)) / max(1, len(raw.translate(None, _NOT_LETTER)))
    odd = len(raw.translate(None, _NOT_ODD)) / max(1, len(raw.translate(None, _SPACE)))
    pairs = len(set(zip(words, islice(words, 1, None), strict=False))) / (n - 1) if n >= 30 else 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        bad(same > 0.3),
        bad(upper > 0.5),
        bad(odd > 0.08),
        bad(raw.count(b"!") / n > 0.2),
        bad(len(lines) >= 4 and len(set(lines)) < 0.4 * len(lines)),
        bad(pairs < 0.5),
        bad(lone > 0.2),
        0 if common < 0.02 and n >= 30 else 1 if common > 0.1 else ABSTAIN,
        0 if ends < 0.005 and n >= 60 else 1 if 0.02 < ends < 0.5 else ABSTAIN,
    )


def pattern(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def unpack(code: int, labellers: int) -> list[int]:
    out = []
    for _ in range(labellers):
        code, x = divmod(code, 3)
        out.append(x)
    return out[::-1]


@dataclass
class LabelModel:
    """Share of good rows, and each labellers' chance of each vote given bad (row 0) and good (row 1)."""

    good: float
    chance: np.ndarray  # labeller, class, vote
    posterior: dict[int, float]


def fit_labels(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns, which are sufficient (at most 3 ** labellers).

    It starts from the votes' majority.  Votes are smoothed towards labellers that are better than chance, which
    also keeps the classes from being exchanged; patterns without any vote get the share of good rows.
    """
    codes = np.array(sorted(counts), dtype=np.int64)
    if not len(codes):
        return LabelModel(0.5, np.full((labellers, 2, 3), 1 / 3), {})
    n = np.array([counts[c] for c in codes], dtype=np.float64)
    v = np.array([unpack(int(c), labellers) for c in codes])
    one = np.stack([v == k for k in range(3)], axis=2).astype(np.float64)
    for_good, for_bad = (v == 1).sum(1), (v == 0).sum(1)
    q = (for_good + 0.5) / (for_good + for_bad + 1.0)
    prior = np.array([[4.0, 1.0, 0.0], [1.0, 4.0, 0.0]]) + 0.5  # votes of bad and of good rows
    good, chance = 0.5, np.zeros((labellers, 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - q) * n, q * n])
        good = (weight[1].sum() + 1) / (n.sum() + 2)
        chance = np.einsum("cp,plk->lck", weight, one) + prior
        chance /= chance.sum(2, keepdims=True)
        log = np.einsum("plk,lck->pc", one, np.log(chance)) + np.log([1 - good, good])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-9:
            break
    silent = (v == ABSTAIN).all(1)
    q = np.where(silent, good, q)
    return LabelModel(float(good), chance, dict(zip(codes.tolist(), q.tolist(), strict=True)))


BUCKETS = 1 << 16
#: Letters and digits by their kind; runs of one kind count once in a word's shape.
_KIND = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(?<=A)A+|(?<=a)a+|(?<=0)0+")


def _hash(x: bytes) -> int:
    return xxhash.xxh32_intdigest(x) % BUCKETS


def buckets(word: bytes) -> tuple[int, int]:
    """The hash buckets of a word: of itself and of its shape."""
    return _hash(b"w" + word), _hash(b"s" + _RUN.sub(b"", word.translate(_KIND)))


def split_words(raw: bytes) -> list[bytes]:
    """The words of a text, long ones in pieces, so that every byte counts."""
    words = raw.split()
    if words and max(map(len, words)) > PIECE:
        return [w[at : at + PIECE] for w in words for at in range(0, len(w), PIECE)]
    return words


class Features(dict):
    """The hash buckets of words, filled as words come, cleared when full."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = buckets(word)
        return out


_TWICE, _SHORT = _hash(b"twice"), _hash(b"short")


def row_features(raw: bytes, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares: words (or pieces of long ones), shapes, and
    words that repeat the one before."""
    words = split_words(raw)
    if not words:
        return np.array([_SHORT], dtype=np.int64), np.array([1.0])
    at = np.array([i for w in words for i in features[w]], dtype=np.int64)
    twice = sum(map(eq, words, islice(words, 1, None)))
    bucket, n = np.unique(at, return_counts=True)
    return np.append(bucket, _TWICE), np.append(n / len(words), twice / len(words))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, copies: np.ndarray, steps: int = 150, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic scorer for posterior labels: full gradients with adaptive steps.  A row counts
    as so many copies of it."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    part = copies / copies.sum()
    share = np.clip(target @ part, 1e-3, 1 - 1e-3)
    balance = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    m, s, mb, sb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * weights[at], len(rows)) + bias, -30, 30)))
        error = (p - target) * balance * part
        g = np.bincount(at, value * error[row], BUCKETS) + penalty * weights
        gb = error.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.99**step
        weights -= 0.2 * (m / up) / (np.sqrt(s / down) + 1e-9)
        bias -= 0.2 * (mb / up) / (np.sqrt(sb / down) + 1e-9)
    return weights, float(bias)


class Scores(dict):
    """A word's share of the score, filled as words come."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        a, b = buckets(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = float(self.weights[a] + self.weights[b])
        return out


def score(raw: bytes, known: Scores, bias: float) -> float:
    words = split_words(raw)
    if not words:
        total = float(known.weights[_SHORT])
    else:
        twice = sum(map(eq, words, islice(words, 1, None)))
        total = (sum(map(known.__getitem__, words)) + twice * float(known.weights[_TWICE])) / len(words)
    return float(1 / (1 + np.exp(-np.clip(total + bias, -500, 500))))


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, sample_rows: int = 6000, text: str = "text", key: str = "doc_id") -> Classifier:
    """The label model is fitted to the votes on every document; the scorer to a sample with their posterior labels.

    Rows that are alike in key and whole text are one class.  A class of m of all N rows stands for
    floor(m * sample_rows / N + u) rows of the sample, u a number in [0, 1) from its hash, or for m where N is smaller; the
    at most sample_rows classes that stand for most of them are trained on, each once with that weight.  So a class of
    very many rows is always among them, and no table but an empty one leaves the scorer untrained.  Null and empty texts have no votes
    and the features of a text without words; an empty table gives a model without weights.  Texts of any length are
    read whole; columns other than the two are not read.
    """
    lean(docs.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        kinds = Kinds()
        for batch in batches:
            for raw in utf8(batch.column(0)):
                code = pattern(votes(raw or b"", kinds))
                seen[code] = seen.get(code, 0) + 1
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    both = plain(docs.select(F.col(text).cast("string"), F.col(key).cast("string")))
    counted = both.select("c0").mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = {r["code"]: r["n"] for r in counted.collect()}
    labels = fit_labels(counts)

    # the classes' hashes and sizes are all that is shuffled; those of the sample are few, and so is what is kept of them
    total = sum(counts.values())
    h = F.xxhash64("c1", "c0")
    part = F.shiftrightunsigned(F.xxhash64("h"), 11) / F.lit(float(1 << 53))
    copies = F.floor(F.col("m") * F.lit(min(1.0, sample_rows / max(1, total))) + part)
    picked = both.groupBy(h.alias("h")).agg(F.count("*").alias("m")).select("h", F.least(copies, F.col("m")).alias("copies")).where("copies > 0").orderBy(F.desc("copies"), "h").limit(sample_rows)
    drawn = both.select(h.alias("h"), "c0").join(F.broadcast(picked), "h").select("h", "c0", "copies")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of each class once a task."""
        features, kinds, seen = Features(), Kinds(), set()
        for batch in batches:
            hs, weights, codes, ats, values = [], [], [], [], []
            for h, raw, copies in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if h in seen:
                    continue
                seen.add(h)
                at, value = row_features(raw or b"", features)
                hs.append(h)
                weights.append(copies)
                codes.append(pattern(votes(raw or b"", kinds)))
                ats.append(at.astype(np.uint16).tobytes())
                values.append(value.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict({"h": pa.array(hs, pa.int64()), "copies": pa.array(weights, pa.int64()), "code": pa.array(codes, pa.int64()), "at": pa.array(ats, pa.binary()), "value": pa.array(values, pa.binary())})

    posterior, rest = labels.posterior, labels.good

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        rows = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for *_, a, v in found]
        weights, bias = train(rows, np.array([posterior.get(r[2], rest) for r in found]), np.array([r[1] for r in found], dtype=float))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    # one task has the bounded sample; the driver gets the weights only
    each = drawn.mapInArrow(extract, "h long, copies long, code long, at binary, value binary")
    sample = each.groupBy("h").agg(F.max(F.struct("copies", "code", "at", "value")).alias("r")).select("h", "r.*")
    trained = sample.coalesce(1).mapInArrow(learn, "weights binary, bias double").collect()
    if not trained:
        return Classifier(labels, np.zeros(BUCKETS), 0.0)
    return Classifier(labels, np.frombuffer(bytes(trained[0]["weights"]), np.float32).astype(np.float64), trained[0]["bias"])


def _score(model: Classifier):
    bias, packed = model.bias, model.weights.astype(np.float32).tobytes()

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Scores(np.frombuffer(packed, np.float32))
        for batch in batches:
            yield pa.array([score(raw or b"", known, bias) for raw in utf8(batch)], pa.float64())

    return scored


def _judge(model: Classifier):
    labels, bias, packed = model.labels, model.bias, model.weights.astype(np.float32).tobytes()

    @F.arrow_udf("struct<weak: double, score: double>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds, known = Kinds(), Scores(np.frombuffer(packed, np.float32))
        for batch in batches:
            weak, scores = [], []
            for raw in utf8(batch):
                weak.append(labels.posterior.get(pattern(votes(raw or b"", kinds)), labels.good))
                scores.append(score(raw or b"", known, bias))
            yield pa.StructArray.from_arrays([pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], names=["weak", "score"])

    return judged


def classify(docs: DataFrame, model: Classifier, least: float = 0.5, text: str = "text") -> DataFrame:
    """All columns of docs and __weak, __score, __keep: the posterior label from the votes, the scorer's
    probability of good quality and whether it is at least `least`.

    Null and empty texts have no votes and the score of a text without words.  Texts of any length are read whole.
    Repeated rows have equal results; an empty table gives no rows.  Columns of docs may have any names; those
    called __weak, __score or __keep are replaced.  Only texts go to Python.
    """
    lean(docs.sparkSession)
    whole = F.col(place_of(docs, text)).cast("string")
    judged = plain(docs).withColumn("judged", _judge(model)(whole))
    out = judged.withColumns({"weak": F.col("judged.weak"), "score": F.col("judged.score"), "keep": F.col("judged.score") >= least})
    return with_columns(out, docs.columns, __weak="weak", __score="score", __keep="keep")


def filter_quality(docs: DataFrame, least: float = 0.5, text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that the classifier, fitted to docs, keeps.

    Null and empty texts are judged as texts without words.  Of repeated rows all stay or none.  An empty table gives
    no rows.  Texts of any length are read whole, columns may have any names, and only texts go to Python.
    """
    scored = _score(fit(docs, text=text, **options))
    lean(docs.sparkSession)
    kept = plain(docs).where(scored(F.col(place_of(docs, text)).cast("string")) >= least)
    return kept.toDF(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs)).select("doc_id", F.col("__weak").alias("weak_label"), F.col("__score").alias("score"), F.col("__keep").alias("keep"))
