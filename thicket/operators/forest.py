"""Forests as values, and their evaluation on rows in three ways that agree: compiled CASE expressions, a
higher-order walk over heap arrays, and NumPy over Arrow batches."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, ABSENT = -1, -2


@dataclass(frozen=True)
class Node:
    """A split (var, thr) or, with var -1, a leaf with a value; children of i are 2 i + 1 and 2 i + 2."""

    var: int
    thr: float = 0.0
    leaf: float = 0.0


Tree = dict[int, Node]


def split(var: int, thr: float) -> Node:
    return Node(var, float(thr))


def leaf(value: float) -> Node:
    return Node(LEAF, 0.0, float(value))


def check(tree: Tree) -> Tree:
    """Raises unless every node hangs from the root and every split has two children."""
    for i, node in tree.items():
        if i and (i - 1) // 2 not in tree or i and tree[(i - 1) // 2].var == LEAF:
            raise ValueError(f"node {i} hangs from nothing")
        if node.var != LEAF and not {2 * i + 1, 2 * i + 2} <= tree.keys():
            raise ValueError(f"split {i} lacks a child")
    if 0 not in tree:
        raise ValueError("no root")
    return tree


def heap(tree: Tree) -> tuple[list[int], list[float], list[float]]:
    """Parallel arrays vars, thresholds, leaf_vals; absent nodes have var -2."""
    size = max(8, 1 << (max(tree) + 1).bit_length())
    var, thr, val = [ABSENT] * size, [math.nan] * size, [math.nan] * size
    for i, n in tree.items():
        var[i] = n.var
        if n.var == LEAF:
            val[i] = n.leaf
        else:
            thr[i] = n.thr
    return var, thr, val


def from_heap(var: list[int], thr: list[float], val: list[float]) -> Tree:
    return check({i: leaf(val[i]) if v == LEAF else split(v, thr[i]) for i, v in enumerate(var) if v != ABSENT})


def leaves(tree: Tree) -> list[int]:
    return sorted(i for i, n in tree.items() if n.var == LEAF)


def splits(tree: Tree) -> list[int]:
    return sorted(i for i, n in tree.items() if n.var != LEAF)


def terminal_splits(tree: Tree) -> list[int]:
    return [i for i in splits(tree) if tree[2 * i + 1].var == tree[2 * i + 2].var == LEAF]


def nonterminal_splits(tree: Tree) -> list[int]:
    return sorted(set(splits(tree)) - set(terminal_splits(tree)))


# -- CASE expressions -------------------------------------------------------------------------------------------


def case_leaf(tree: Tree, x: list[Column], node: int = 0) -> Column:
    """Heap index of the leaf that a row reaches."""
    n = tree[node]
    if n.var == LEAF:
        return F.lit(node)
    return F.when(x[n.var] <= F.lit(n.thr), case_leaf(tree, x, 2 * node + 1)).otherwise(case_leaf(tree, x, 2 * node + 2))


def case_value(tree: Tree, x: list[Column], node: int = 0) -> Column:
    n = tree[node]
    if n.var == LEAF:
        return F.lit(n.leaf)
    return F.when(x[n.var] <= F.lit(n.thr), case_value(tree, x, 2 * node + 1)).otherwise(case_value(tree, x, 2 * node + 2))


def case_forest(forest: list[Tree], x: list[Column], tree_ids: list[int] | None = None, all_except: list[int] | None = None) -> Column:
    """Sum over all trees, the named trees, or all but the named ones."""
    picked = _picked(len(forest), tree_ids, all_except)
    out = F.lit(0.0)
    for k in picked:
        out = out + case_value(forest[k], x)
    return out


def _picked(n: int, tree_ids: list[int] | None, all_except: list[int] | None) -> list[int]:
    if tree_ids is not None and all_except is not None:
        raise ValueError("either tree_ids or all_except")
    return [k for k in range(n) if (tree_ids is None or k in tree_ids) and (all_except is None or k not in all_except)]


def sql_leaf(tree: Tree, x: list[str], node: int = 0) -> str:
    n = tree[node]
    if n.var == LEAF:
        return str(node)
    return f"CASE WHEN {x[n.var]} <= {n.thr!r} THEN {sql_leaf(tree, x, 2 * node + 1)} ELSE {sql_leaf(tree, x, 2 * node + 2)} END"


def sql_value(tree: Tree, x: list[str], node: int = 0) -> str:
    n = tree[node]
    if n.var == LEAF:
        return f"CAST({n.leaf!r} AS DOUBLE)"
    return f"CASE WHEN {x[n.var]} <= {n.thr!r} THEN {sql_value(tree, x, 2 * node + 1)} ELSE {sql_value(tree, x, 2 * node + 2)} END"


def sql_forest(forest: list[Tree], x: list[str], picked: list[int] | None = None) -> str:
    return "(" + " + ".join(sql_value(forest[k], x) for k in (range(len(forest)) if picked is None else picked)) + ")"


# -- higher-order walk ------------------------------------------------------------------------------------------


def walk_leaf(var: Column, thr: Column, x: Column, depth: int) -> Column:
    """Heap index of the leaf, from array columns; depth bounds the number of steps."""

    def step(node: Column, _: Column) -> Column:
        v = F.get(var, node)
        return F.when(v < 0, node).otherwise(F.when(F.get(x, v) <= F.get(thr, node), 2 * node + 1).otherwise(2 * node + 2))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(0), step)


def tree_columns(tree: Tree) -> tuple[Column, Column, Column]:
    var, thr, val = heap(tree)
    number = lambda a: F.array(*[F.lit(None if math.isnan(v) else float(v)).cast("double") for v in a])
    return F.array(*map(F.lit, var)), number(thr), number(val)


def tree_depth(tree: Tree) -> int:
    return max(tree).bit_length() + 1


# -- NumPy over Arrow batches -----------------------------------------------------------------------------------


class Packed:
    """Forests as flat arrays, evaluated tree by tree over all rows of a batch."""

    def __init__(self, forests: list[list[Tree]]) -> None:
        self.forests = [[tuple(np.array(a, dtype=t) for a, t in zip(heap(t_), (np.int64, float, float), strict=True)) for t_ in f] for f in forests]

    @staticmethod
    def leaf(var: np.ndarray, thr: np.ndarray, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while len(rows):
            at = node[rows]
            v = var[at]
            rows, at, v = rows[v >= 0], at[v >= 0], v[v >= 0]
            node[rows] = 2 * at + 2 - (x[rows, v] <= thr[at])
        return node

    def one(self, k: int, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for var, thr, val in self.forests[k]:
            out += val[self.leaf(var, thr, x)]
        return out

    def all(self, x: np.ndarray) -> np.ndarray:
        """Rows by forests."""
        return np.stack([self.one(k, x) for k in range(len(self.forests))], axis=1) if self.forests else np.zeros((len(x), 0))


def vectors(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(column), -1)


def with_draws(df: DataFrame, forests: list[list[Tree]], x: str = "x", out: str = "draws") -> DataFrame:
    """Appends the array of all forests' sums.  The forests go to the tasks in one broadcast; rows are not moved."""
    packed = df.sparkSession.sparkContext.broadcast(Packed(forests))
    at = df.columns.index(x)
    schema = df.withColumn(out, F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = packed.value.all(vectors(batch.column(at)))
            ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=schema.names)

    return df.mapInArrow(run, schema)


# -- statistics of trees over rows -------------------------------------------------------------------------------


def leaf_rows(df: DataFrame, forest: list[Tree], x: list[Column], keep: list[str]) -> DataFrame:
    """(keep, tree, leaf): the sparse leaf basis, a row for each row and tree."""
    parts = [F.struct(F.lit(k).alias("tree"), case_leaf(t, x).alias("leaf")) for k, t in enumerate(forest)]
    return df.select(*keep, F.explode(F.array(*parts)).alias("p")).select(*keep, "p.tree", "p.leaf")


def ancestors(leaf_column: Column, depth: int) -> Column:
    """A node and all nodes above it up to the root."""
    up = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.floor((leaf_column + 1) / F.pow(F.lit(2.0), d)).cast("int") - 1)
    return F.filter(up, lambda n: n >= 0)


def node_counts(basis: DataFrame, depth: int) -> DataFrame:
    """Rows through every node of every tree; leaves are counted before their ancestors are expanded."""
    counted = basis.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    return counted.select("tree", F.explode(ancestors(F.col("leaf"), depth)).alias("node"), "n").groupBy("tree", "node").agg(F.sum("n").alias("n"))


def boxes(tree: Tree, features: int) -> list[tuple[int, list[tuple[float, float]]]]:
    """Each leaf's box lo < x <= hi."""
    out = []

    def down(i: int, box: list[tuple[float, float]]) -> None:
        n = tree[i]
        if n.var == LEAF:
            out.append((i, box))
            return
        lo, hi = box[n.var]
        down(2 * i + 1, [*box[: n.var], (lo, min(hi, n.thr)), *box[n.var + 1 :]])
        down(2 * i + 2, [*box[: n.var], (max(lo, n.thr), hi), *box[n.var + 1 :]])

    down(0, [(-math.inf, math.inf)] * features)
    return out


# -- edits --------------------------------------------------------------------------------------------------------


def _below(i: int, top: int) -> bool:
    while i > top:
        i = (i - 1) // 2
    return i == top


def split_leaf(tree: Tree, node: int, var: int, thr: float, left: float = 0.0, right: float = 0.0) -> Tree:
    if tree[node].var != LEAF:
        raise ValueError("only a leaf can be split")
    return tree | {node: split(var, thr), 2 * node + 1: leaf(left), 2 * node + 2: leaf(right)}


def prune_split(tree: Tree, node: int, value: float = 0.0, recursive: bool = False) -> Tree:
    if tree[node].var == LEAF or not recursive and node not in terminal_splits(tree):
        raise ValueError("only a terminal split can be pruned")
    return {i: n for i, n in tree.items() if not _below(i, node)} | {node: leaf(value)}


def change_split(tree: Tree, node: int, var: int, thr: float) -> Tree:
    if tree[node].var == LEAF:
        raise ValueError("only a split can be changed")
    return tree | {node: split(var, thr)}


def swap_split(tree: Tree, parent: int, child: int) -> Tree:
    if child not in (2 * parent + 1, 2 * parent + 2) or LEAF in (tree[parent].var, tree[child].var):
        raise ValueError("only a split and its child can be swapped")
    return tree | {parent: tree[child], child: tree[parent]}


def set_leaf(tree: Tree, node: int, value: float) -> Tree:
    if tree[node].var != LEAF:
        raise ValueError("not a leaf")
    return tree | {node: leaf(value)}


# -- interchange ---------------------------------------------------------------------------------------------------


def to_json(forest: list[Tree]) -> str:
    return json.dumps([[[i, n.var, n.thr, n.leaf] for i, n in sorted(t.items())] for t in forest])


def from_json(text: str) -> list[Tree]:
    return [check({i: Node(v, thr, val) for i, v, thr, val in t}) for t in json.loads(text)]


def from_boosted(dump: list[dict | str]) -> list[Tree]:
    """Trees of a gradient-boosting dump: nodes with split (or split_feature), split_condition, yes, no, children, or
    a leaf.  Those go left on x < t and heap trees on x <= t, so thresholds step down to the next double."""
    out = []
    for item in dump:
        tree: Tree = {}
        todo = [(0, json.loads(item) if isinstance(item, str) else item)]
        while todo:
            i, n = todo.pop()
            if "leaf" in n:
                tree[i] = leaf(n["leaf"])
                continue
            var = int(str(n.get("split", n.get("split_feature"))).removeprefix("f"))
            tree[i] = split(var, math.nextafter(float(n["split_condition"]), -math.inf))
            by_id = {c["nodeid"]: c for c in n["children"]}
            todo += [(2 * i + 1, by_id[n["yes"]]), (2 * i + 2, by_id[n["no"]])]
        out.append(check(tree))
    return out


def to_text(tree: Tree, counts: dict[int, int] | None = None) -> str:
    """A line for each node in preorder, children further in: `#node x<var> <= <threshold>` or `#node = <value>`, then
    the number of rows, if known."""
    lines, todo = [], [(0, 0)]
    while todo:
        i, level = todo.pop()
        n = tree[i]
        rule = f"= {n.leaf:.6g}" if n.var == LEAF else f"x{n.var} <= {n.thr:.6g}"
        lines.append(f"{'| ' * level}#{i} {rule}{f' [{counts[i]} rows]' if counts else ''}")
        if n.var != LEAF:
            todo += [(2 * i + 2, level + 1), (2 * i + 1, level + 1)]
    return "\n".join(lines)


def to_dot(tree: Tree, name: str = "tree") -> str:
    body = [f'  n{i} [label="{n.leaf:.4g}", shape=box];' if n.var == LEAF else f'  n{i} [label="x{n.var} <= {n.thr:.4g}"];' for i, n in sorted(tree.items())]
    body += [f'  n{i} -> n{2 * i + side} [label="{word}"];' for i in splits(tree) for side, word in ((1, "yes"), (2, "no"))]
    return "\n".join([f"digraph {name} {{", *body, "}"])


def texts(nodes: DataFrame, keys: list[str], of: Callable[[Tree], str]) -> DataFrame:
    """(keys, text) of trees in a table (keys, node, var, thr, leaf): a tree is a group, many are dealt over the tasks."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        tree = {int(i): leaf(v) if k < 0 else split(int(k), t) for i, k, t, v in zip(g["node"], g["var"], g["thr"], g["leaf"], strict=True)}
        return pd.DataFrame([[*key, of(check(tree))]], columns=[*keys, "text"])

    return nodes.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "text string"]))
