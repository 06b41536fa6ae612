"""Exact Jaccard join over word n-grams that skips by set relations: the list of each token is cut into blocks by
position, whole blocks are skipped by size and position, and a set's answers are derived from those of a highly
similar set whose answers are known (after Wang et al., Leveraging set relations in exact set similarity join).

Sets that are equal are one node.  Each node's prefix, its first tokens in one global order, goes into lists by
token; two sets that are similar enough share a token of their prefixes.  The order puts frequent tokens last,
so that passages which many documents share don't meet in prefixes.

First round: each list compares its sets with one leader.  Pairs that are at all alike form families of highly
similar sets.  Second round: inside a family, overlaps are derived from the sets' differences to the tokens that
most of them have, and only links that join something new are returned, never all pairs.  Across families, the sets
of a family form a block in each list; a set meets a block only if the block's sizes, positions and common tokens
allow a link, and its overlaps with all sets of the family are derived from its overlap with the family's first set
and the few tokens in which the others differ.  No similar pair escapes both.

Hashes only find candidates: 64 bits of hashes of 128-bit word hashes in the lists, 128 bits for equal sets.  Whether
two sets link is decided on their words, which each task numbers without hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import discard, lean, mix64, place_of, plain, saved, table, utf8
from thicket.llm.graph import components

#: A token in this many prefixes is frequent; so many frequent tokens are put last, the most frequent first chosen.
FREQUENT, MOST_FREQUENT = 16, 300_000
#: Tokens are counted over so many times the prefix: frequent ones that come up when others are put last are known too.
WIDE = 2
#: Ids are sent to all tasks up to this number (8 bytes each); beyond it they are joined by shuffle.
IDS_AT_ONCE = 500_000
#: Sets of a family, and sets that meet it, in one task's group; tokens of a family's sets in one.
MEMBERS, MEETING, TOKENS = 400, 2000, 500_000
#: Bytes of texts whose sets are numbered together in a task.
AT_ONCE = 4 << 20
#: So many common prefix tokens are asked of two sets, or as many as a link of their sizes must have.
COMMON = 8
#: Sets of this share of the asked similarity are of one family.
ALIKE = 0.35


#: Bytes of texts whose words are handled at once, words that are remembered, and the longest of them.
CHUNK, REMEMBERED_WORDS, REMEMBERED_BYTES = 1 << 20, 100_000, 48
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


def words_of(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, about CHUNK bytes at a time; no word is cut."""
    raw, at = raw or b"", 0
    while at < len(raw):
        end = _SPACE.search(raw, at + CHUNK)
        to = end.start() if end else len(raw)
        yield raw[at:to].lower().split()
        at = to


class Digests(dict):
    """128-bit hashes of words, filled as words come."""

    def __missing__(self, word: bytes) -> bytes:
        out = xxhash.xxh3_128_digest(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = out
        return out


def _rolled(lane: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(0, len(lane) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = mix64(out ^ lane[i : i + len(out)])
    return out


def digested_sets(texts: Iterable[bytes | None], n: int, known: Digests) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """The set of each text, sorted distinct 64-bit hashes of its n-word shingles, and a 128-bit digest of the set
    (None if it is empty).  Fewer words make one shingle, none make an empty set.  Short texts are hashed many at a time."""
    parts: list[bytes] = []
    ends: list[int] = []
    total = 0
    for raw in texts:
        for words in words_of(raw):
            parts.append(b"".join(map(known.__getitem__, words)))
            total += len(words)
        ends.append(total)
        if total > CHUNK // 8:
            yield from _group_sets(parts, ends, n)
            parts, ends, total = [], [], 0
    yield from _group_sets(parts, ends, n)


def _group_sets(parts: list[bytes], ends: list[int], n: int) -> Iterator[tuple[np.ndarray, bytes | None]]:
    lanes = np.frombuffer(b"".join(parts), dtype=np.uint64).reshape(-1, 2)
    first, second = (_rolled(np.ascontiguousarray(lanes[:, k]), n) for k in (0, 1))
    begin = 0
    for end in ends:
        k = end - begin
        if k >= n:
            s, at = np.unique(first[begin : end - n + 1], return_index=True)
            other = second[begin + at]
        elif k:
            s, other = (_rolled(np.ascontiguousarray(lanes[begin:end, i]), k) for i in (0, 1))
        else:
            s = other = first[:0]
        yield s, xxhash.xxh3_128_digest(s.tobytes() + other.tobytes()) if k else None
        begin = end


def shingle_sets(texts: Iterable[bytes | None], n: int, known: Digests | None = None) -> Iterator[np.ndarray]:
    return (s for s, _ in digested_sets(texts, n, Digests() if known is None else known))


def shingle_set(raw: bytes | None, n: int) -> np.ndarray:
    return next(shingle_sets([raw], n))


def numbered_sets(texts: Iterable[bytes | None], n: int) -> list[np.ndarray]:
    """The set of each text as sorted whole numbers: among these texts, two shingles have one number only if they are
    the same words."""
    numbers: dict[bytes, int] = {}
    short: dict[bytes, int] = {}
    parts, ends, total = [], [], 0
    for raw in texts:
        for words in words_of(raw):
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)))
            total += len(words)
        ends.append(total)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    code, most, kinds = ids, max(1, len(numbers)), max(1, len(numbers))
    for i in range(1, n):
        if most * kinds >= 1 << 62:  # number the pieces anew, so that no product overflows
            distinct, code = np.unique(code, return_inverse=True)
            most = len(distinct)
        code = code[: max(0, len(ids) - i)] * kinds + ids[i:]
        most *= kinds
    out, begin = [], 0
    for end in ends:
        k = end - begin
        if k >= n:
            out.append(np.unique(code[begin : end - n + 1]))
        elif k:
            out.append(np.array([-1 - short.setdefault(ids[begin:end].tobytes(), len(short))], dtype=np.int64))
        else:
            out.append(ids[:0])
        begin = end
    return out


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least num / den, in whole numbers."""

    num: int
    den: int

    def overlap(self, a, b):
        """Least overlap of sets of sizes a and b: o >= t / (1 + t) * (a + b)."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, size: int) -> int:
        return size - -(-self.num * size // self.den) + 1

    def similar(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def sizes(self, small, large):
        return self.den * small >= self.num * large


def _as_long(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def _sets(docs: DataFrame, n: int, t: Threshold, text: str) -> DataFrame:
    """docs, a plain table, with rid, node (digest of the set, null if empty), n (its size) and prefix (its
    WIDE * prefix smallest hashes), saved.  Only texts go to Python."""

    @F.arrow_udf("struct<node: binary, n: long, prefix: array<long>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Digests()
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for s, digest in digested_sets(utf8(batch), n, known):
                nodes.append(digest)
                sizes.append(len(s))
                prefixes.append(_as_long(s[: WIDE * t.prefix(len(s))] if len(s) else s))
            yield pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), _lists(prefixes)], names=["node", "n", "prefix"])

    rows = docs.withColumn("rid", F.monotonically_increasing_id()).withColumn("found", found(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return saved(rows.select("*", "found.node", "found.n", "found.prefix").drop("found"), "sets")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ascending array, by binary search."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _pick(rows: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """rows whose key is in ids (one column, `id`), or isn't (left_anti)."""
    return rows.join(_small(ids), F.col(key) == F.col("id"), how)


def _entries(reps: DataFrame, n: int, t: Threshold, text: str) -> DataFrame:
    """(tok, rid, n, pos, leader) of the prefix tokens that two or more sets share, saved."""
    first = reps.select(F.explode("prefix").alias("tok"))
    counted = first.groupBy("tok").count().where(F.col("count") >= FREQUENT)
    chosen = counted.orderBy(F.desc("count"), "tok").limit(MOST_FREQUENT).select("tok").toArrow()
    frequent = np.sort(chosen.column(0).to_numpy().astype(np.int64))

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Digests()
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            lists = batch.column(1)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy()
            often = _among(flat, frequent)
            toks, again = [], []
            for k, (a, b, size) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), sizes.tolist(), strict=True)):
                wide, late = flat[a:b], often[a:b]
                rare = wide[~late]
                if len(rare) < t.prefix(size):
                    if len(wide) < size:
                        again.append(k)
                    rare = np.concatenate([rare, wide[late]])
                toks.append(rare[: t.prefix(size)])
            texts = batch.column(3).take(pa.array(again, pa.int64()))
            for k, s in zip(again, shingle_sets(utf8(texts), n, known), strict=True):
                s = _as_long(s)
                last = _among(s, frequent)
                toks[k] = np.concatenate([s[~last], s[last]])[: len(toks[k])]
            lens = np.array([len(p) for p in toks], dtype=np.int64)
            pos = np.concatenate([np.arange(k) for k in lens]) if len(lens) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "tok": pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64), pa.int64()),
                "rid": pa.array(np.repeat(batch.column(0).to_numpy(), lens), pa.int64()),
                "n": pa.array(np.repeat(sizes, lens), pa.int32()),
                "pos": pa.array(pos, pa.int32()),
            })

    listed = reps.select("rid", "prefix", "n", text).mapInArrow(reorder, "tok long, rid long, n int, pos int")
    band = F.floor(F.log("n") / F.lit(float(np.log(t.den / t.num)))).cast("int")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops lists of one set; leader is the set of the list, in the same band of sizes, whose place of the token is
        the first: it has the fewest tokens of its own, so that the lists of a family's tokens have one leader."""
        held: np.ndarray | None = None  # the last row so far, and whether its list has had another
        more, band_key, leader = False, None, 0
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            if held is not None:
                rows = np.concatenate([held[None], rows])
            if len(rows) < 2:
                held = rows[-1] if len(rows) else held
                continue
            tok = rows[:, 0]
            same_next = np.append(tok[1:] == tok[:-1], False)
            same_before = np.append(more, tok[1:] == tok[:-1])
            band = rows[:, 4]
            new = np.append(band_key != (tok[0], band[0]), (tok[1:] != tok[:-1]) | (band[1:] != band[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
            lead = np.where(start >= 0, rows[start, 1], leader)
            out = (same_next | same_before)[:-1]
            yield _entry_batch(rows[:-1][out], lead[:-1][out])
            held, more = rows[-1], bool(same_before[-1])
            band_key, leader = (tok[-2], band[-2]), int(lead[-2])
        if held is not None and more:
            yield _entry_batch(held[None], np.array([leader if band_key == (held[0], held[4]) else held[1]]))

    dealt = listed.repartition("tok").withColumn("band", band).sortWithinPartitions("tok", "band", "pos", "n", "rid")
    return saved(dealt.mapInArrow(shared, "tok long, rid long, n int, pos int, leader long"), "entries")


def _entry_batch(rows: np.ndarray, leader: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"tok": pa.array(rows[:, 0], pa.int64()), "rid": pa.array(rows[:, 1], pa.int64()), "n": pa.array(rows[:, 2], pa.int32()), "pos": pa.array(rows[:, 3], pa.int32()), "leader": pa.array(leader, pa.int64())})


class Answers:
    """Overlaps of any set with every set of a cluster, from its overlap with the first and the differences."""

    def __init__(self) -> None:
        self.pivot = np.zeros(0, np.int64)
        self.sizes: list[int] = []
        self.ids: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.signs: list[np.ndarray] = []
        self.packed = None

    def add(self, s: np.ndarray, rid: int = 0) -> None:
        self.ids.append(rid)
        if not self.sizes:
            self.pivot = s
        gone = np.setdiff1d(self.pivot, s, assume_unique=True)
        come = np.setdiff1d(s, self.pivot, assume_unique=True)
        self.tokens.append(np.concatenate([gone, come]))
        self.signs.append(np.concatenate([np.full(len(gone), -1.0), np.ones(len(come))]))
        self.sizes.append(len(s))
        self.packed = None

    def overlaps(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Overlaps with and sizes of the sets of the cluster."""
        if self.packed is None:
            which = np.repeat(np.arange(len(self.sizes)), [len(x) for x in self.tokens])
            self.packed = np.concatenate(self.tokens), np.concatenate(self.signs), which, np.array(self.sizes, dtype=np.int64)
        tokens, signs, which, sizes = self.packed
        base = _shared(self.pivot, s)
        if not len(tokens):
            return np.full(len(sizes), base, dtype=np.int64), sizes
        at = np.minimum(np.searchsorted(s, tokens), len(s) - 1)
        hit = s[at] == tokens
        return base + np.rint(np.bincount(which[hit], signs[hit], len(sizes))).astype(np.int64), sizes


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _verify(meets: DataFrame, members: DataFrame, texts: DataFrame, n: int, t: Threshold, alike: float = 1.0) -> DataFrame:
    """(rid, y, linked) of the sets rid of family k and y of the meets (k, y) that have at least `alike` of the asked
    similarity; members are (k, rid, n).  linked: the whole of it, by the words themselves.  Saved."""
    wanted = members.join(meets.select("k").distinct(), "k", "left_semi")
    sizes = wanted.groupBy("k").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / TOKENS)).cast("int").alias("mc"))
    chunks = meets.groupBy("k").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("yc")).join(sizes, "k")
    part = lambda c, by: F.pmod(F.xxhash64(by), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = wanted.join(chunks, "k").select("k", part("mc", "rid").alias("m"), every("yc").alias("c"), F.lit(0).alias("kind"), "rid")
    right = meets.join(chunks, "k").select("k", every("mc").alias("m"), part("yc", "y").alias("c"), F.lit(1).alias("kind"), F.col("y").alias("rid"))
    needed = left.unionByName(right)
    ids = saved(needed.select(F.col("rid").alias("id")).distinct(), "ids")
    rows = needed.join(_pick(texts, "rid", ids, "left_semi"), "rid").select("k", "m", "c", "kind", "rid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, own = None, [], 0, 0  # groups of (ids, texts) of members and of sets that meet them
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in range(5)]
            for k, m, c, kind, rid, text in zip(*keys, utf8(batch.column(5)), strict=True):
                if (k, m, c) != now:
                    now, own = (k, m, c), 0
                    held.append(([], [], [], []))
                group = held[-1]
                group[2 * kind].append(rid)
                group[2 * kind + 1].append(text)
                size += len(text)
                own += len(text) * (kind == 0)
                if size > AT_ONCE + 2 * own:
                    yield _answers(held, n, t, alike)
                    held, size = [(group[0], group[1], [], [])], own
        if held:
            yield _answers(held, n, t, alike)

    dealt = rows.repartition("k", "m", "c").sortWithinPartitions("k", "m", "c", "kind", "rid")
    out = saved(dealt.mapInArrow(run, "rid long, y long, linked boolean"), "verified")
    discard(ids)
    return out


def _answers(groups: list[tuple[list[int], list[bytes], list[int], list[bytes]]], n: int, t: Threshold, alike: float) -> pa.RecordBatch:
    sets = iter(numbered_sets((text for g in groups for text in [*g[1], *g[3]]), n))
    out_r, out_y, out_l = [], [], []
    for rids, _, ys, _ in groups:
        known = Answers()
        for rid in rids:
            known.add(next(sets), rid)
        for y in ys:
            s = next(sets)
            if not known.sizes:
                continue
            overlap, sizes = known.overlaps(s)
            linked = t.similar(overlap, sizes, len(s))
            for at in np.flatnonzero(linked | (overlap >= alike * t.num / t.den * (sizes + len(s) - overlap))).tolist():
                out_r.append(known.ids[at])
                out_y.append(y)
                out_l.append(bool(linked[at]))
    return pa.RecordBatch.from_pydict({"rid": pa.array(out_r, pa.int64()), "y": pa.array(out_y, pa.int64()), "linked": pa.array(out_l, pa.bool_())})


def family_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Links that join all similar pairs of a set of `left` and a set of `right` (both masks).

    With P the tokens that more than half of the sets have, |x n y| = |P| - |P - x| - |P - y| + |(P - x) n (P - y)| +
    |(x - P) n (y - P)|: lists of the differences give a set's overlaps with all others."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    token, n = np.unique(np.concatenate(sets), return_counts=True)
    most = token[2 * n > m]
    gone = [np.setdiff1d(most, s, assume_unique=True) for s in sets]
    come = [np.setdiff1d(s, most, assume_unique=True) for s in sets]
    apart = [np.concatenate([g, c]) for g, c in zip(gone, come, strict=True)]  # no token is both gone and come
    missing = np.array([len(g) for g in gone], dtype=np.int64)
    flat = np.concatenate(apart)
    owner = np.repeat(np.arange(m), [len(a) for a in apart])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    label, out = np.arange(m), []
    for x in np.flatnonzero(left).tolist():
        a, b = np.searchsorted(flat, apart[x], "left"), np.searchsorted(flat, apart[x], "right")
        shared = np.bincount(np.concatenate([owner[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]), minlength=m) if len(a) else np.zeros(m, dtype=np.int64)
        overlap = len(most) - missing[x] - missing + shared
        near = np.flatnonzero(t.similar(overlap, sizes[x], sizes) & right & (label != label[x]))
        for other in np.unique(label[near]).tolist():
            out.append((x, int(near[label[near] == other][0])))
            label[label == other] = label[x]
    return out


def _inside(families: DataFrame, texts: DataFrame, n: int, t: Threshold) -> DataFrame:
    """(k, y) of links inside families (fam, rid, n), saved.  A family whose sets have many tokens is dealt in chunks,
    and each two chunks meet in one group."""
    chunks = families.groupBy("fam").agg(F.ceil(F.sum("n") / TOKENS).cast("int").alias("chunks"), F.count("*").alias("m")).where("m > 1").drop("m")
    own = families.join(chunks, "fam").withColumn("c", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    needed = own.select("fam", "rid", "c", other.alias("o")).select("fam", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "rid")
    ids = saved(needed.select(F.col("rid").alias("id")).distinct(), "ids")
    rows = needed.join(_pick(texts, "rid", ids, "left_semi"), "rid").select("fam", "i", "j", "c", "rid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0  # groups of (i, j), chunks, ids and texts
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in range(5)]
            for fam, i, j, c, rid, text in zip(*keys, utf8(batch.column(5)), strict=True):
                if (fam, i, j) != now:
                    now = (fam, i, j)
                    if size > AT_ONCE:
                        yield _links(held, n, t)
                        held, size = [], 0
                    held.append(((i, j), [], [], []))
                for to, x in zip(held[-1][1:], (c, rid, text), strict=True):
                    to.append(x)
                size += len(text)
        if held:
            yield _links(held, n, t)

    out = saved(rows.repartition("fam", "i", "j").sortWithinPartitions("fam", "i", "j", "rid").mapInArrow(run, "k long, y long"), "links")
    discard(ids)
    return out


def _links(groups: list[tuple[tuple[int, int], list[int], list[int], list[bytes]]], n: int, t: Threshold) -> pa.RecordBatch:
    sets = numbered_sets((text for g in groups for text in g[3]), n)
    k, y, begin = [], [], 0
    for (i, j), places, rids, _ in groups:
        end, at = begin + len(rids), np.array(places)
        for a, b in family_links(sets[begin:end], at == i, at == j, t) if len(rids) > 1 else []:
            k.append(min(rids[a], rids[b]))
            y.append(max(rids[a], rids[b]))
        begin = end
    return pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "y": pa.array(y, pa.int64())})


def _met(placed: DataFrame, t: Threshold) -> DataFrame:
    """(k, y, common): for each token of the prefix of a set y that a set of the family k has too, a row, unless the
    token can't be among the first `common` that y shares with a set that it links with.

    With an overlap of o, the i-th common token in the order has o - i of them after it, in either set.  So the first i
    common tokens have o - i + 1 tokens from their places on, and a link has at least i rows, as long as these tokens
    are in both prefixes: i - 1 may be (num * (den * small - num * large)) / (den * (num + den)) for sets of these sizes,
    rounded down.  `common` follows from the sizes of the whole family, as all rows of k and y need the same."""
    blocks = placed.groupBy("tok", "cl").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("sets").alias("sets"), F.max("least_n").alias("least_n"), F.max("most_n").alias("most_n"))
    mixed = blocks.groupBy("tok").agg(F.count("*").alias("b")).where("b > 1").select("tok")
    a = blocks.join(mixed, "tok", "left_semi").alias("a")
    b = placed.join(mixed, "tok", "left_semi").alias("b")
    # a block is skipped when none of its sizes is near the set's, or what is left from the shared token on is too little
    near = (F.col("b.n") * t.den >= F.col("a.low") * t.num) & (F.col("a.high") * t.den >= F.col("b.n") * t.num)
    lowest, highest = F.ceil(F.col("b.n") * t.num / t.den - 1e-9), F.floor(F.col("b.n") * t.den / t.num + 1e-9)
    least = F.ceil((F.greatest("a.low", lowest) + F.col("b.n")) * t.num / (t.num + t.den) - 1e-9)
    sure = lambda n: F.floor((F.least(n, "b.n") * t.den - F.greatest(n, "b.n") * t.num) * t.num / (t.den * (t.num + t.den)))
    common = F.least(1 + sure(F.greatest("a.least_n", lowest)), 1 + sure(F.least("a.most_n", highest)), F.lit(COMMON))
    enough = F.least(F.col("a.rest"), F.col("b.n") - F.col("b.pos")) > least - common
    # the sets of the smaller family meet the block of the larger
    larger = (F.col("a.sets") > F.col("b.sets")) | (F.col("a.sets") == F.col("b.sets")) & (F.col("a.cl") < F.col("b.cl"))
    return a.join(b, F.col("a.tok") == F.col("b.tok")).where(larger & near & enough).select(F.col("a.cl").alias("k"), F.col("b.rid").alias("y"), common.alias("common"))


def _small(ids: DataFrame) -> DataFrame:
    """To be sent to all tasks, if it has few rows."""
    return F.broadcast(ids) if ids.count() <= IDS_AT_ONCE else ids


def grouped(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of docs, a plain table, with rid, node and n, and (node, cl): for each node the first row of its
    component.  Rows with empty sets have no node."""
    lean(docs.sparkSession)
    t = Threshold(num, den)
    rows = _sets(docs, n, t, text)
    nodes = saved(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("rid").alias("rep")), "nodes")
    reps = _pick(rows, "rid", nodes.select(F.col("rep").alias("id")), "left_semi")
    entries = _entries(reps, n, t, text)
    texts = rows.select("rid", F.col(text).cast("string").alias("text"))

    star = entries.where(F.col("rid") != F.col("leader")).select(F.least("rid", "leader").alias("k"), F.greatest("rid", "leader").alias("y"), "n")
    # a leader is only a guess: a pair is worth a look if it leads in a tenth of the prefix
    star = star.groupBy("k", "y").agg(F.count("*").alias("c"), F.min("n").alias("n")).where(F.col("c") >= F.col("n") * (1 - t.num / t.den) * 0.1).select("k", "y")
    star = saved(star, "stars")
    alike = _verify(star, star.select("k", F.col("k").alias("rid"), F.lit(1).alias("n")).distinct(), texts, n, t, ALIKE)
    clusters = components(alike.select(F.col("rid").alias("u"), F.col("y").alias("v")))
    discard(star, alike)
    sizes = rows.select("rid", "n")
    families = clusters.join(_pick(sizes, "rid", clusters.select(F.col("node").alias("id")), "left_semi"), F.col("node") == F.col("rid")).select(F.col("component").alias("fam"), "rid", "n")
    families = saved(families, "families")
    links = _inside(families, texts, n, t)

    count = families.groupBy("fam").agg(F.count("*").alias("sets"), F.min("n").cast("int").alias("least_n"), F.max("n").cast("int").alias("most_n"))
    sized = saved(families.join(count, "fam").select(F.col("rid").alias("node"), F.col("fam").alias("component"), "sets", "least_n", "most_n"), "sized")
    own = {"cl": F.coalesce("component", "rid"), "sets": F.coalesce("sets", F.lit(1)), "least_n": F.coalesce("least_n", "n"), "most_n": F.coalesce("most_n", "n")}
    placed = entries.join(_small(sized), F.col("rid") == F.col("node"), "left").withColumns(own).drop("node", "component", "leader")
    meets = _met(placed, t).groupBy("k", "y").agg(F.count("*").alias("c"), F.min("common").alias("common")).where("c >= common").select("k", "y")
    meets = saved(meets, "meets")
    discard(entries, sized)
    members = families.select(F.col("fam").alias("k"), "rid", "n")
    alone = meets.select("k").distinct().join(members.select("k").distinct(), "k", "left_anti").select("k", F.col("k").alias("rid"), F.lit(1).cast("long").alias("n"))
    more = _verify(meets, members.unionByName(alone), texts, n, t).where("linked").select(F.col("rid").alias("k"), "y")
    joined = components(links.unionByName(more).select(F.col("k").alias("u"), F.col("y").alias("v")))
    discard(meets, families, clusters, links)
    linked = saved(nodes.join(joined.withColumnRenamed("node", "of"), F.col("rep") == F.col("of"), "left").select("node", F.coalesce("component", "rep").alias("cl")), "linked")
    discard(nodes, joined)
    return rows, linked


def similar_groups(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct n-word shingles, with fewer
    words the whole sequence; null, empty and blank texts have an empty set, link with nothing and keep their
    own id.  component_id is the smallest doc_id of the rows that links reach; a null doc_id takes part as a row
    but is never the smallest of others.  Repeated rows are one node.  Texts of any length are read whole, a piece at
    a time.  An empty table gives no rows.  Columns other than doc_id and the text are not read.
    """
    rows, linked = grouped(plain(docs.select("doc_id", F.col(text))), n, num, den, "c1")
    own = rows.select(F.col("c0").alias("doc_id"), "n", "node")
    # equal sets first become one row, so that a large group of copies is met once by its component
    least = own.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least")).join(linked, "node")
    component = least.groupBy("cl").agg(F.min("least").alias("component_id"))
    of_node = saved(least.join(component, "cl").select("node", "component_id"), "component-ids")
    known = own.join(_small(of_node), "node")
    out = known.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(own.where(F.col("node").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are the first of their group.

    Two rows link at a similarity of num / den of their n-word shingles, a group is what links reach.  Rows without
    words (null, empty, blank texts) have no group and all stay; of repeated rows one stays.  Which row is the first
    follows from the order in which docs is read.  An empty table gives no rows.  Columns may have any names.
    """
    rows, linked = grouped(plain(docs), n, num, den, place_of(docs, text))
    of_node = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("rid").alias("first"))
    stays = saved(of_node.join(linked, "node").groupBy("cl").agg(F.min("first").alias("id")).select("id"), "first-rows")
    out = rows.where(F.col("node").isNull()).unionByName(_pick(rows.where(F.col("node").isNotNull()), "rid", stays, "left_semi"))
    return out.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
