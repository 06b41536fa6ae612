"""Exact removal of repeated byte strings with a hash-compared suffix sort: prefix polynomial hashes and binary
search give the common extension of two suffixes, so that a mergesort compares them in logarithmic time; what
the sort finds equal is compared byte by byte.  Two paths compare cryptographic digests of the bytes instead (BLAKE2b,
128 bits): runs that are equal throughout, and the windows of anchors with so many runs that no task can hold them.

A corpus does not fit one sort, so its windows (strings of `length` bytes) are first dealt into groups in which
all equal windows meet.  The group of a window is its anchor, the `gram` bytes with the smallest hash inside it
(leftmost on ties), which depends on the window's content alone.  Consecutive windows with the same anchor make a
run.  Runs that are equal throughout are repeats as they are; a group's other runs are sorted as suffixes, column
by column, aligned at the anchor.  All windows of a run hold its anchor, so the bytes that the repeated ones
cover are one span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import at_once, discard, lean, mix64, plain, saved, table, utf8

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Windows handled at once of a long text, and pairs of run and column handled at once by the sort.
CHUNK, AT_ONCE = 1 << 20, 200_000
#: An anchor with more runs than this, a few MB of them, is hot: its windows are counted by an aggregation.
HOT_RUNS = 20_000
_POS = np.uint64((1 << 24) - 1)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, INVERSE)]), dtype=np.uint64)


def prefix_hashes(raw: np.ndarray, powers: Powers) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) base^p over i <= p < j."""
    powers.grow(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[: len(raw)], out=out[1:])
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from the minima to both ends of fixed blocks."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(raw: bytes, length: int, gram: int, powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, first window, number of windows and place of the anchor in the run, for each run."""
    whole = np.frombuffer(raw, dtype=np.uint8)
    windows = len(whole) - length + 1
    for first in range(0, windows, CHUNK):
        part = whole[first : min(first + CHUNK, windows) + length - 1]
        h = prefix_hashes(part, powers)
        n = len(part) - gram + 1
        with np.errstate(over="ignore"):
            mixed = mix64((h[gram:] - h[:-gram]) * powers.down[:n])
        keys = (mixed & ~_POS) | np.arange(n, dtype=np.uint64)
        at = (_sliding_min(keys, length - gram + 1) & _POS).astype(np.int64)
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(start, len(at)))
        yield mixed[at[start]].view(np.int64), start + first, count, at[start] - start


def repeated(contents: list[bytes], offsets: np.ndarray, counts: np.ndarray, group: np.ndarray, length: int, gram: int) -> np.ndarray:
    """(first, last) repeated window of each run, or (-1, -1); runs of one group are next to each other.

    Each run is a row of bytes, aligned at the anchor.  The windows that start in one column of one group are
    sorted as suffixes; a window is repeated if its neighbour in that order has `length` bytes in common with it.
    """
    left, rows = length - gram, len(contents)
    wide = left + length
    text = np.zeros((rows, wide + 1), dtype=np.uint8)
    ends = np.zeros(rows, dtype=np.int64)
    for r, c in enumerate(contents):
        a = left - int(offsets[r])
        text[r, a : a + len(c)] = np.frombuffer(c, dtype=np.uint8)
        ends[r] = a + len(c)
    powers = Powers()
    powers.grow(wide + 1)
    h = np.zeros((rows, wide + 2), dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * np.append(powers.up[:wide], np.uint64(0)), axis=1, out=h[:, 1:])
    flat_h, flat_text, hw, tw = h.ravel(), text.ravel(), h.shape[1], text.shape[1]

    def order(r1: np.ndarray, r2: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix 1 stands before suffix 2, and their common extension, up to `length` bytes."""
        most = np.minimum(np.minimum(ends[r1], ends[r2]) - col, length)
        b1, b2 = r1 * hw + col, r2 * hw + col
        with np.errstate(over="ignore"):
            delta = flat_h[b1] - flat_h[b2]
            low, high = np.zeros(len(col), dtype=np.int64), most.copy()
            for _ in range(int(length).bit_length()):
                mid = (low + high + 1) >> 1
                same = flat_h[b1 + mid] - flat_h[b2 + mid] == delta
                low = np.where(same, mid, low)
                high = np.where(same, high, mid - 1)
        at = np.minimum(col + low, wide)
        c1, c2 = flat_text[r1 * tw + at], flat_text[r2 * tw + at]
        before = np.where(low < most, c1 < c2, ends[r1] < ends[r2]) & (low < length)
        return before, low

    first = np.full(rows, -1, dtype=np.int64)
    last = np.full(rows, -1, dtype=np.int64)
    begin = left - offsets
    for lo, hi in _portions(counts, group):
        r = np.repeat(np.arange(lo, hi), counts[lo:hi])
        inside = np.arange(len(r)) - np.repeat(np.cumsum(counts[lo:hi]) - counts[lo:hi], counts[lo:hi])
        all_cols = begin[r] + inside
        step = max(1, AT_ONCE * wide // max(1, len(r)) // 2) if len(r) > AT_ONCE else wide
        for c0 in range(0, wide, step):
            pick = np.flatnonzero((all_cols >= c0) & (all_cols < c0 + step))
            if not len(pick):
                continue
            key = group[r[pick]] * np.int64(wide) + all_cols[pick]
            sort = np.argsort(key, kind="stable")
            row, col, key = r[pick][sort], all_cols[pick][sort], key[sort]
            row = _mergesort(row, col, key, order)
            pair = np.flatnonzero(key[1:] == key[:-1])
            _, common = order(row[pair], row[pair + 1], col[pair])
            pair = pair[common >= length]
            pair = pair[_equal(text, row[pair], row[pair + 1], col[pair], length)]
            hit = np.concatenate([pair, pair + 1])
            window = col[hit] - begin[row[hit]]
            low = np.full(rows, np.iinfo(np.int64).max)
            np.minimum.at(low, row[hit], window)
            found = low != np.iinfo(np.int64).max
            first = np.where(found & ((first < 0) | (low < first)), low, first)
            np.maximum.at(last, row[hit], window)
    return np.stack([first, last], axis=1)


def _portions(counts: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Whole groups of rows, next to each other, with about AT_ONCE windows."""
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    total = np.append(0, np.cumsum(counts))
    lo = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if total[b] - total[lo] > AT_ONCE and a > lo:
            yield lo, int(a)
            lo = int(a)
    if len(group) > lo:
        yield lo, len(group)


def _mergesort(row: np.ndarray, col: np.ndarray, key: np.ndarray, order) -> np.ndarray:
    """Rows sorted by suffix within each key, bottom up; all merges of a level are done together.

    The place of a suffix in the merged run is its place in its own run and its rank in the other, which binary
    search finds with hash-compared suffixes."""
    n = len(row)
    new = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    edges = np.append(np.flatnonzero(new), n)
    end = np.repeat(edges[1:], np.diff(edges))
    width = 1
    most = int((end - start).max(initial=0))
    while width < most:
        place = np.arange(n) - start
        mine = place // width
        other = mine ^ 1
        lo = np.minimum(start + other * width, end)
        hi = np.minimum(lo + width, end)
        live = np.flatnonzero(hi > lo)
        a, b = lo[live].copy(), hi[live].copy()
        is_left = (mine[live] & 1) == 0
        me, where = row[live], col[live]
        open_ = np.arange(len(live))
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            them = row[mid]
            # a left suffix goes before equal right ones, a right suffix after equal left ones
            left_first = is_left[open_]
            r1 = np.where(left_first, them, me[open_])
            r2 = np.where(left_first, me[open_], them)
            before, _ = order(r1, r2, where[open_])
            go = np.where(left_first, before, ~before)
            a[open_] = np.where(go, mid + 1, a[open_])
            b[open_] = np.where(go, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        to = np.arange(n)
        base = start[live] + (mine[live] // 2) * 2 * width
        to[live] = base + (place[live] - mine[live] * width) + (a - lo[live])
        out = np.empty_like(row)
        out[to] = row
        row, width = out, width * 2
    return row


def _equal(text: np.ndarray, r1: np.ndarray, r2: np.ndarray, col: np.ndarray, length: int) -> np.ndarray:
    """Byte comparison of windows; each pair of rows is compared once."""
    if not len(r1):
        return np.zeros(0, dtype=bool)
    code = r1 * np.int64(len(text)) + r2
    pairs, which = np.unique(code, return_inverse=True)
    out = np.zeros(len(r1), dtype=bool)
    by = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[by], np.arange(0, len(pairs) + 4096, 4096))
    for k in range(len(edges) - 1):
        at = by[edges[k] : edges[k + 1]]
        p = pairs[4096 * k : 4096 * (k + 1)]
        same = np.zeros((len(p), text.shape[1] + 1), dtype=np.int32)
        np.cumsum(text[p // len(text)] == text[p % len(text)], axis=1, out=same[:, 1:])
        w = which[at] - 4096 * k
        out[at] = same[w, col[at] + length] - same[w, col[at]] == length
    return out


def digest(part: memoryview | bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


RUN = "gid long, ah long, c1 long, c2 long, rid long, s long, n int, off int"


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of every text; gid numbers them, ah is the hash of the anchor, c1 and c2 the digest of the whole run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            size = 0
            for rid, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if raw is None or len(raw) < length:
                    continue
                view = memoryview(raw)
                for ah, s, n, off in runs(raw, length, gram, powers):
                    ends = (s + n + (length - 1)).tolist()
                    whole = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(s.tolist(), ends, strict=True)]), dtype=np.int64).reshape(-1, 2)
                    for to, x in zip(parts, (ah, whole[:, 0], whole[:, 1], np.full(len(s), rid), s, n.astype(np.int32), off.astype(np.int32)), strict=True):
                        to.append(x)
                    size += len(s)
                if size > 200_000:
                    yield _batch(parts)
                    parts, size = [[] for _ in range(7)], 0
            yield _batch(parts)

    found = rows.select("rid", "text").mapInArrow(run, RUN.split(", ", 1)[1])
    return saved(found.withColumn("gid", F.monotonically_increasing_id()), "runs")


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    names = [x.split() for x in RUN.split(", ")[1:]]
    kinds = {"long": np.int64, "int": np.int32}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(kinds[t]) if p else np.zeros(0, kinds[t])) for p, (_, t) in zip(parts, names, strict=True)], names=[n for n, _ in names])


VERDICT = "rid long, ah long, s long, n int, off int, whole boolean, compare boolean"


def _groups(found: DataFrame) -> DataFrame:
    """For the runs of anchors that occur again: whole where an equal run exists, compare where the run has to be
    compared with others of its group (one of each kind of equal runs is enough)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)], axis=1)])
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
            held = rows[cut:]
            if cut:
                yield _verdicts(rows[:cut])
        if len(held):
            yield _verdicts(held)

    return found.select("ah", "c1", "c2", "rid", "s", "n", "off").repartition("ah").sortWithinPartitions("ah", "c1", "c2", "rid", "s").mapInArrow(run, VERDICT)


def _verdicts(rows: np.ndarray) -> pa.RecordBatch:
    new_group = np.append(True, rows[1:, 0] != rows[:-1, 0])
    new_class = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))
    in_class = np.diff(np.append(np.flatnonzero(new_class), len(rows)))
    whole = np.repeat(in_class > 1, in_class)
    group = np.cumsum(new_group) - 1
    classes = np.bincount(group[new_class])[group]
    compare = (classes > 1) & new_class
    keep = whole | compare
    ah, _, _, rid, s, n, off = rows[keep].T
    return pa.RecordBatch.from_pydict({"rid": pa.array(rid), "ah": pa.array(ah), "s": pa.array(s), "n": pa.array(n.astype(np.int32)), "off": pa.array(off.astype(np.int32)), "whole": pa.array(whole[keep]), "compare": pa.array(compare[keep])})


def _semi(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose rid is in ids; the ids are sent to all tasks only up to a fixed number."""
    return rows.join(at_once(ids), "rid", "left_semi")


def _contents(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (ah, rid, s, n, off, whole) with the bytes of each run."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("ah", "s", "n", "off", "whole")).alias("runs"))
    lists = saved(lists, "wanted")
    joined = _semi(rows.select("rid", "text"), lists.select("rid")).join(lists, "rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for rid, raw, wanted_runs in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for x in wanted_runs:
                    content = raw[x["s"] : x["s"] + x["n"] + length - 1]
                    for to, value in zip(out, (x["ah"], rid, x["s"], x["n"], x["off"], x["whole"], content), strict=True):
                        to.append(value)
                    size += len(content)
                if size > 8 << 20:
                    yield _content_batch(out)
                    out, size = [[] for _ in range(7)], 0
            yield _content_batch(out)

    return joined.select("rid", "text", "runs").mapInArrow(cut, "ah long, rid long, s long, n int, off int, whole boolean, content binary")


def _content_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["ah", "rid", "s", "n", "off", "whole", "content"])


SPAN = "rid long, a long, b long"


def _compared(contents: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of the repeated windows of runs that are not repeated whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True))
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut >= 2000 or cut and len(held) > 4000:
                yield _span_batch(held[:cut], length, gram)
                held = held[cut:]
        if held:
            yield _span_batch(held, length, gram)

    return contents.repartition("ah").sortWithinPartitions("ah", "rid", "s").mapInArrow(run, SPAN)


def _span_batch(rows: list[tuple], length: int, gram: int) -> pa.RecordBatch:
    ah = np.array([r[0] for r in rows], dtype=np.int64)
    group = np.cumsum(np.append(True, ah[1:] != ah[:-1])) - 1
    found = repeated([r[6] for r in rows], np.array([r[4] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64), group, length, gram)
    s = np.array([r[2] for r in rows], dtype=np.int64)
    rid = np.array([r[1] for r in rows], dtype=np.int64)
    keep = (found[:, 0] >= 0) & ~np.array([r[5] for r in rows], dtype=bool)
    return pa.RecordBatch.from_pydict({"rid": pa.array(rid[keep]), "a": pa.array((s + found[:, 0])[keep]), "b": pa.array((s + found[:, 1] + length)[keep])})


def _hot_spans(found: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Spans of hot anchors.  Equal runs are counted with map-side sums; every window of one of each kind becomes a
    128-bit digest, and digests are counted likewise, so that no task holds a hot anchor's runs."""
    kinds = saved(found.groupBy("ah", "c1", "c2").agg(F.count("*").alias("c"), F.min("gid").alias("gid")), "hot-kinds")
    whole = found.join(kinds.where("c > 1").select("ah", "c1", "c2"), ["ah", "c1", "c2"], "left_semi").select("rid", F.col("s").alias("a"), (F.col("s") + F.col("n") + (length - 1)).alias("b"))
    firsts = found.join(kinds.select("gid", "c"), "gid").select("ah", "rid", "s", "n", "off", (F.col("c") > 1).alias("whole"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, s, n, whole_run, content in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5, 6)), strict=True):
                digests = [digest(content[j : j + length]) for j in range(n)]
                yield pa.RecordBatch.from_pydict({"rid": pa.array([rid] * n, pa.int64()), "a": pa.array(range(s, s + n), pa.int64()), "whole": pa.array([whole_run] * n, pa.bool_()), "digest": pa.array(digests, pa.binary())})

    all_windows = saved(_contents(rows, firsts, length).mapInArrow(windows, "rid long, a long, whole boolean, digest binary"), "hot-windows")
    twice = all_windows.groupBy("digest").count().where("count > 1").select("digest")
    parts = all_windows.where(~F.col("whole")).join(twice, "digest", "left_semi").select("rid", "a", (F.col("a") + length).alias("b"))
    return whole.unionByName(parts)


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, number of maximal removed stretches and the remaining bytes."""
    removed, stretches, rest, done = 0, 0, [], 0
    for a, b in sorted(spans):
        if a > done or not stretches:
            rest.append(raw[done:a])
            stretches += 1
            removed += b - a
            done = b
        elif b > done:
            removed += b - done
            done = b
    rest.append(raw[done:])
    return removed, stretches, b"".join(rest)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int | None = None, text: str = "text", hot_runs: int = HOT_RUNS, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row (and kept, the remaining bytes, on demand).

    Each byte goes that is covered by a string of `length` bytes which also starts anywhere else, in the same
    text or another; strings are judged on the input.  Null texts count as empty; texts shorter than `length`
    stay whole.  Repeated rows repeat each other's strings.  Texts of any length are read whole, a piece at a time.
    Columns other than doc_id and the text are not read.  An empty table gives no rows.
    """
    lean(docs.sparkSession)
    gram = max(1, length // 5) if gram is None else gram
    both = plain(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")))
    rows = saved(both.select(F.monotonically_increasing_id().alias("rid"), F.col("c0").alias("doc_id"), F.coalesce("c1", F.lit("")).alias("text")), "texts")
    found = _runs(rows, length, gram)
    hot = saved(found.groupBy("ah").count().where(F.col("count") > hot_runs).select("ah"), "hot")
    is_hot = not hot.isEmpty()
    usual = found.join(at_once(hot), "ah", "left_anti") if is_hot else found
    verdicts = saved(_groups(usual), "verdicts")
    parts = verdicts.where("whole").select("rid", F.col("s").alias("a"), (F.col("s") + F.col("n") + (length - 1)).cast("long").alias("b"))
    contents = _contents(rows, verdicts.where("compare").select("ah", "rid", "s", "n", "off", "whole"), length)
    compared = saved(_compared(contents, length, gram), "spans")
    parts = parts.unionByName(compared)
    if is_hot:
        parts = parts.unionByName(saved(_hot_spans(found.join(at_once(hot), "ah", "left_semi"), rows, length), "hot-spans"))
    spans = saved(parts.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "document-spans")
    discard(found, hot, verdicts, compared)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for raw, own in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                removed, stretches, rest = cut(raw, [(x["a"], x["b"]) for x in own])
                for to, value in zip(out, (len(raw), removed, stretches, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + kept_text], names=[c.split()[0] for c in schema.split(", ")])

    ids = spans.select("rid")
    known = at_once(ids)
    changed = rows.join(known, "rid", "left_semi").join(spans, "rid").select("doc_id", "text", "spans").mapInArrow(finish, schema)
    raw = F.col("text").cast("binary")
    same = [F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256")]
    unchanged = rows.join(known, "rid", "left_anti").select("doc_id", *same, *([raw.alias("kept")] * kept_text))
    return changed.unionByName(unchanged)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
