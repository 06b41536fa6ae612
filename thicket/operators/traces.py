"""Evaluation of a trace that stays a table: packed draws go to the tasks in chunks under a byte limit.

Tasks pack each draw's forest into one binary value.  The driver passes those on, a chunk at a time, as broadcasts, and
never holds more than one pass of them; what doesn't fit one pass is evaluated in several, each a narrow pass over the
rows that adds its draws, or its part of a weighted sum, to what the pass before has written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thicket.operators.forest import vectors
from thicket.sources.files import stored

#: Bytes of packed draws in one broadcast, and in all broadcasts of one pass.
CHUNK_BYTES, PASS_BYTES = 8 << 20, 64 << 20
#: Bytes of results that a task makes at a time.
BLOCK_BYTES = 16 << 20

PACKED = "k int, weight double, of string, blob binary"


def pack_forest(tree: np.ndarray, node: np.ndarray, var: np.ndarray, thr: np.ndarray, leaf: np.ndarray) -> bytes:
    """Nodes of a forest (heap numbers within trees) as flat arrays: the trees' roots, and for each node its variable
    (negative in leaves), threshold or value, and the places of its children."""
    order = np.lexsort([node, tree])
    tree, node, var, number = tree[order], node[order], var[order], np.where(var[order] < 0, leaf[order], thr[order])
    each = np.unique(tree)
    starts, ends = np.searchsorted(tree, each), np.searchsorted(tree, each, "right")
    left = np.full(len(tree), -1, np.int32)
    right = left.copy()
    for a, z in zip(starts, ends, strict=True):
        own = node[a:z]
        inner = np.flatnonzero(var[a:z] >= 0)
        for side, to in ((1, left), (2, right)):
            child = 2 * own[inner] + side
            at = np.minimum(np.searchsorted(own, child), len(own) - 1)
            if (own[at] != child).any() or own[0] != 0:
                raise ValueError("a split lacks a child, or a tree its root")
            to[a + inner] = a + at
    sizes = np.array([len(starts), len(tree)], "<i8")
    return b"".join([sizes.tobytes(), starts.astype("<i4").tobytes(), number.astype("<f8").tobytes(), var.astype("<i4").tobytes(), left.astype("<i4").tobytes(), right.astype("<i4").tobytes()])


#: Rows from which a forest is evaluated by masks, and the most leaves of a tree that has them.
MANY_ROWS, MASK_LEAVES = 512, 62


class PackedForest:
    """A packed forest over the bytes themselves."""

    def __init__(self, blob: bytes) -> None:
        trees, nodes = np.frombuffer(blob, "<i8", 2).tolist()
        at = 16
        self.roots = np.frombuffer(blob, "<i4", trees, at)
        at += 4 * trees
        self.number = np.frombuffer(blob, "<f8", nodes, at)
        at += 8 * nodes
        self.var, self.left, self.right = (np.frombuffer(blob, "<i4", nodes, at + 4 * nodes * k) for k in range(3))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Sums of the trees' values for the rows of x; a row passes a split on the left where x <= threshold."""
        out = np.zeros(len(x))
        if len(x) >= MANY_ROWS:
            return self._by_masks(x, out)
        for root in self.roots:
            self._walk(x, root, out)
        return out

    def _walk(self, x: np.ndarray, root: int, out: np.ndarray) -> None:
        node = np.full(len(x), root, np.int32)
        rows = np.arange(len(x)) if self.var[root] >= 0 else np.empty(0, np.int64)
        while len(rows):
            at = node[rows]
            below = x[rows, self.var[at]] <= self.number[at]
            node[rows] = to = np.where(below, self.left[at], self.right[at])
            rows = rows[self.var[to] >= 0]
        out += self.number[node]

    def _by_masks(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The same without a walk (after Lucchese et al., QuickScorer): a split that a row passes on the right rules out the
        leaves on its left.  For each tree and feature, a bit for each leaf that is left by the number of thresholds below
        the row's value; the first leaf that all features leave is the row's."""
        var, number, left, right = self.var.tolist(), self.number.tolist(), self.left.tolist(), self.right.tolist()
        cuts = {v: np.unique(self.number[self.var == v]) for v in sorted(set(var) - {-1})}
        code = {v: np.searchsorted(own, x[:, v], "left") for v, own in cuts.items()}
        for root in self.roots.tolist():
            leaves, splits, todo = [], [], [(root, None)]
            while todo:
                node, split = todo.pop()
                if split is not None:  # all leaves on the left of this split are known
                    splits.append((node, split, len(leaves)))
                elif var[node] < 0:
                    leaves.append(number[node])
                else:
                    todo += [(right[node], None), (node, len(leaves)), (left[node], None)]
            if len(leaves) > MASK_LEAVES:
                self._walk(x, root, out)
                continue
            masks: dict[int, np.ndarray] = {}
            for node, begin, end in splits:
                v = var[node]
                if v not in masks:
                    masks[v] = np.full(len(cuts[v]) + 1, (1 << len(leaves)) - 1, np.int64)
                masks[v][int(np.searchsorted(cuts[v], number[node], "left")) + 1 :] &= ~(((1 << end) - 1) ^ ((1 << begin) - 1))
            value = np.array(leaves)
            if not masks:
                out += value[0]
                continue
            there = None
            for v, mask in masks.items():
                there = mask[code[v]] if there is None else there & mask[code[v]]
            first = (there & -there).astype(np.float64).view(np.int64) >> 52
            out += value[first - 1023]
        return out


def pack(trace: DataFrame, k: Column, weight: Column, trees: str = "trees", of: Column | None = None) -> DataFrame:
    """PACKED: each row's forest as one value, its column k, its weight in it and the rows that it is for (`of`, null for
    all); rows without k are left out.

    `trees` holds for each tree an array of (node, var, thr, leaf).  A task packs a row at a time; the trace is not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for row in range(batch.num_rows):
                forest = batch.column(3)[row].values
                nodes = forest.flatten()
                sizes = np.diff(forest.offsets.to_numpy(zero_copy_only=False))
                field = lambda name, kind, nodes=nodes: nodes.field(name).to_numpy(zero_copy_only=False).astype(kind)
                blobs.append(pack_forest(np.repeat(np.arange(len(sizes)), sizes), field("node", np.int64), field("var", np.int64), field("thr", float), field("leaf", float)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["k", "weight", "of", "blob"])

    of = F.lit(None) if of is None else of
    return trace.select(k.cast("int").alias("k"), weight.cast("double").alias("weight"), of.cast("string").alias("of"), trees).where(F.col("k").isNotNull()).mapInArrow(run, PACKED)


def packed_bytes(trace: DataFrame, trees: str = "trees") -> int:
    """How many bytes the rows' forests take when packed, without packing them."""
    nodes = F.aggregate(trees, F.lit(0).cast("long"), lambda n, t: n + F.size(t))
    return trace.agg(F.sum(16 + 4 * F.size(trees) + 20 * nodes).alias("n")).first()["n"] or 0


def _passes(packed: DataFrame, pass_bytes: int, one: bool) -> Iterator[list[Broadcast]]:
    """Passes in the order of k, a single one if it is known that all fits in it."""
    context = packed.sparkSession.sparkContext
    rows = packed.collect() if one else stored(packed, "packed").orderBy("k").toLocalIterator()
    chunks, held, size, passed = [], [], 0, 0
    for r in rows:
        n = len(r["blob"])
        full = passed and passed + n > pass_bytes
        if held and (full or size + n > CHUNK_BYTES):
            chunks.append(context.broadcast(held))
            held, size = [], 0
        if full:
            yield chunks
            chunks, passed = [], 0
        held.append((r["k"], r["weight"], r["of"], bytes(r["blob"])))
        size, passed = size + n, passed + n
    if held:
        yield [*chunks, context.broadcast(held)]


def evaluated(df: DataFrame, trace: DataFrame, k: Column, weight: Column, columns: int, x: str, out: str, pass_bytes: int = PASS_BYTES, of: Column | None = None, group: str | None = None, then: tuple[str, Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]]] | None = None) -> DataFrame:
    """df with `out`, an array whose place k is the weighted sum, over the trace's rows of that k, of their forests' values.

    With `group`, a string column of df, a row meets only the trace's rows whose `of` is its group.

    `then` makes other columns of the sums where they are, instead of x and `out`: it is their schema, and a function of a
    batch of df and the (row, place) matrix of its sums.

    x is an array of doubles.  Rows are not moved.  One pass is part of the result's own plan; where there are several, each
    but the last is written before the next begins, and its broadcasts are given up."""
    made, at, by = df, df.columns.index(x), None if group is None else df.columns.index(group)
    schema = df.withColumn(out, F.array(F.lit(0.0))).schema
    before, again = [], False
    for chunks in _passes(pack(trace, k, weight, of=of), pass_bytes, packed_bytes(trace) <= pass_bytes):
        if before:
            made = stored(made.mapInArrow(_evaluating(before, columns, at, by, schema.names, again), schema), "draws")
            again = True
            for chunk in before:
                chunk.destroy()
        before = chunks
    if then is not None:
        last = StructType([*(f for f in df.schema.fields if f.name != x), *StructType.fromDDL(then[0]).fields])
        return made.mapInArrow(_evaluating(before, columns, at, by, last.names, again, then[1]), last)
    if not before:
        return df.withColumn(out, F.array_repeat(F.lit(0.0), columns))
    return made.mapInArrow(_evaluating(before, columns, at, by, schema.names, again), schema)


def _evaluating(chunks: list[Broadcast], columns: int, at: int, by: int | None, names: list[str], again: bool, make: Callable | None = None):
    step = max(1, BLOCK_BYTES // (8 * columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                z, n = vectors(batch.column(at)), batch.num_rows
                own = batch.columns[:-1] if again else batch.columns
                sums = vectors(batch.column(batch.num_columns - 1)).copy() if again else np.zeros((n, columns))
                rows = None if by is None else _places(batch.column(by).to_pylist())
                for chunk in chunks:
                    for k, weight, of, blob in chunk.value:
                        if rows is None:
                            sums[:, k] += weight * PackedForest(blob)(z)
                        elif of in rows:
                            sums[rows[of], k] += weight * PackedForest(blob)(z[rows[of]])
                made = [*own, listed(sums)] if make is None else [*own[:at], *own[at + 1 :], *make(batch, sums)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    return run


def listed(values: np.ndarray) -> pa.Array:
    """An array of (row, place) or (row, place, part) as a list, or a list of lists, for each row."""
    made, n = pa.array(values.ravel()), values.size
    for size in values.shape[:0:-1]:
        n //= size
        made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), made)
    return made


def _places(names: list) -> dict[str, np.ndarray]:
    """The rows of each group but null."""
    found: dict[str, list[int]] = {}
    for row, name in enumerate(names):
        if name is not None:
            found.setdefault(name, []).append(row)
    return {name: np.array(rows) for name, rows in found.items()}
