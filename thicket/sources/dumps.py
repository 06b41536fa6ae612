"""Forest files as tables: dumps of trees, read by Spark, become rows of nodes with heap numbers.

A nested tree is unfolded level by level over all trees at once, so that neither the driver nor a task recurses, and a
file of very many trees is as many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.sources.files import stored


def below(t: Column) -> Column:
    """The next double below a finite one: its neighbour by one rounded product or quotient, or the least number below 0
    or a subnormal one."""
    one = F.lit(1.0 - 2.0**-53)  # the neighbour of 1
    tiny = F.abs(t) < 2.0**-1021
    return F.when(tiny, t - F.lit(5e-324)).when(t > 0, t * one).otherwise(t / one)


def boosted_nodes(dumps: DataFrame, keys: list[str], dump: str = "dump", most_levels: int = 63) -> DataFrame:
    """keys, node, var, thr, leaf of each tree of a gradient-boosting dump (JSON text, one tree a row).

    Its nodes have split or split_feature (a number, or f and a number), split_condition, yes, no and children, or a leaf;
    they go left on x < t and heap trees on x <= t, so that thresholds step down to the next double.  var is -1 in
    leaves.  A null dump has no rows, and what isn't JSON is an error; so are a split whose children lack yes or no, and
    more levels than a 64-bit heap number has.  Each level is written before the next is unfolded."""
    level = dumps.where(F.col(dump).isNotNull()).select(*keys, F.lit(0).cast("long").alias("node"), F.parse_json(dump).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    out = None
    for depth in range(most_levels):
        var = F.regexp_replace(F.coalesce(get("$.split", "string"), get("$.split_feature", "string")), "^f", "").cast("int")
        child = lambda k: F.struct(get(f"$.children[{k}].nodeid", "long").alias("id"), F.to_json(get(f"$.children[{k}]", "variant")).alias("v"))
        parts = level.select(*keys, "node", get("$.leaf", "double").alias("leaf"), var.alias("var"), get("$.split_condition", "double").alias("t"), get("$.yes", "long").alias("yes"), get("$.no", "long").alias("no"), child(0).alias("a"), child(1).alias("b"))
        held = stored(parts, f"level{depth}")
        made = held.select(*keys, "node", F.when(F.col("leaf").isNotNull(), -1).otherwise(F.col("var")).alias("var"), F.when(F.col("leaf").isNull(), below(F.col("t"))).alias("thr"), "leaf")
        out = made if out is None else out.unionByName(made)
        inner = held.where("leaf is null")
        if inner.isEmpty():
            return out
        side = lambda of: F.when(F.col("a.id") == F.col(of), F.col("a.v")).when(F.col("b.id") == F.col(of), F.col("b.v")).otherwise(F.raise_error(F.lit("a split lacks a child")))
        both = F.array(F.struct((2 * F.col("node") + 1).alias("node"), side("yes").alias("v")), F.struct((2 * F.col("node") + 2).alias("node"), side("no").alias("v")))
        level = inner.select(*keys, F.inline(both)).select(*keys, "node", F.parse_json("v").alias("v"))
    raise ValueError("a tree has too many levels")


def json_nodes(forests: DataFrame, keys: list[str], text: str = "forest") -> DataFrame:
    """keys, tree, node, var, thr, leaf of forests as JSON text: a list of trees, each a list of [node, var, thr, leaf].

    A null text has no rows, and what isn't such a list is an error."""
    numbers = F.from_json(F.col(text), "array<array<array<double>>>", {"mode": "FAILFAST"})
    trees = forests.select(*keys, F.posexplode(numbers).alias("tree", "nodes"))
    at = lambda k: F.get("n", F.lit(k))
    return trees.select(*keys, "tree", F.explode("nodes").alias("n")).select(*keys, "tree", at(0).cast("long").alias("node"), at(1).cast("int").alias("var"), at(2).alias("thr"), at(3).alias("leaf"))


def read_dumps(spark, path: str) -> DataFrame:
    """(tree, dump) of text files with one tree a line: tree numbers the lines of all files without gaps in the files' own
    order only if there is a single file; it tells trees apart in any case."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("tree"), F.col("value").alias("dump"))
