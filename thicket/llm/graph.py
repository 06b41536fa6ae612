"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import FILE_ROWS, discard, saved


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the smallest node it is linked with.

    Each round is saved in the shared folder; about log(n) rounds are needed.  Self-loops add nothing, and no
    edges give no rows.
    """
    now, files, mark = saved(_small(edges), "edges"), None, None
    while True:
        last, now = now, saved(_small(_large(now)), "edges", files)
        discard(last)
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (new["n"], new["h"]) or not new["n"]:
            break
        files = 1 + new["n"] // FILE_ROWS
        mark = (new["n"], new["h"])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = saved(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components", 1 + 2 * new["n"] // FILE_ROWS)
    discard(now)
    return out
