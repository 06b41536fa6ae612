"""What several operators share: the shared folder, saved tables, Arrow texts and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a folder of our own in local mode, in which driver and executors are one process; an error on a
    cluster, whose machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="thicket-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Narrow rows of a saved table in one file, and bytes that a task gathers before it writes them.
FILE_ROWS, WRITE_BYTES = 100_000, 16 << 20


def saved(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes df under the shared folder and reads it back: cuts lineage, and is computed once.

    `files` is for tables that are known to be small: they are not dealt into as many files as there are shuffle
    partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/thicket-{uuid.uuid4().hex}/{name}"
    out = df if files is None else df.coalesce(files)
    out.write.option("compression", "zstd").option("parquet.block.size", str(WRITE_BYTES)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_in = path.rsplit("/", 1)[0]
    return out


def discard(*tables: DataFrame) -> None:
    """Removes saved tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that goes to a Python worker: JVM and worker hold one each, whatever the rows' lengths.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, unless they are bounded more closely.

    A batch is otherwise of 10,000 rows, and as large as its texts happen to be."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def plain(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ...: names of our own beside them can't clash, and none needs quoting."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place_of(df: DataFrame, column: str) -> str:
    """What plain(df) calls a column."""
    return f"c{df.columns.index(column)}"


def with_columns(df: DataFrame, names: list[str], **added: str) -> DataFrame:
    """The columns of a plain df under their names again, then `added`: {name: column of df}.  Of the columns of df,
    those that have the name of an added one are left out."""
    taken = {x.lower() for x in added}
    kept = [(f"c{k}", name) for k, name in enumerate(names) if name.lower() not in taken]
    return df.select(*(F.col(c) for c, _ in kept), *(F.col(c) for c in added.values())).toDF(*(n for _, n in kept), *added)


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The texts of an Arrow string column as bytes, without decoding them and few at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).cast(kind).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): spreads the bits of integer keys."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def ranked(rows: DataFrame, group: str, order: list[Column], out: str, rows_per_block: int | None = None) -> DataFrame:
    """Saved narrow `rows` with `out`, the gapless rank from 0 of each row inside its group in the given order.

    The rows are dealt by range of (group, order), so that a hot group goes to many tasks, and so do rows that are
    alike, whose places in the scan break ties.  A row's rank is its place in its partition and the number of rows of
    its group in the partitions before: only the counts of each partition and group are added up.  `group` has no nulls.
    There are as many partitions as a shuffle has, or of about rows_per_block rows.
    """
    by = [F.col(group), *order, F.col("__scan")]
    parts = [] if rows_per_block is None else [1 + rows.count() // rows_per_block]
    dealt = rows.withColumn("__scan", F.monotonically_increasing_id()).repartitionByRange(*parts, *by).sortWithinPartitions(*by)
    kept = saved(dealt.drop("__scan").withColumn("__at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("__at", 33)
    counts = kept.groupBy(F.col(group).alias("__g"), part.alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(counts.select("__g", "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start")), "starts", 1)
    joined = kept.join(at_once(starts), (F.col(group) == F.col("__g")) & (part == F.col("__p")))
    return joined.withColumn(out, F.col("__at") + F.col("__start")).drop("__g", "__p", "__start", "__at")


#: Rows of a narrow saved table that are sent to all tasks (up to 24 bytes each); beyond it, it is joined by shuffle.
ROWS_AT_ONCE = 500_000


def at_once(rows: DataFrame) -> DataFrame:
    """Narrow rows that are to be joined: sent to all tasks if they are few."""
    return F.broadcast(rows) if rows.limit(ROWS_AT_ONCE + 1).count() <= ROWS_AT_ONCE else rows


def named(docs: DataFrame) -> DataFrame | None:
    """docs, a plain table, with file and row, which name each row by a hash of its Parquet file and its index there,
    and part, the number in the file's name (0 without one).

    The name doesn't depend on how a scan is planned, so it is the same in every job.  None where there is no such
    name: docs is not a selection of the rows of Parquet files that two scans make alike, or a file is read twice, or
    the hashes of two files are the same.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size():
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias", "View") or not plan.deterministic():
            return None
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    try:
        part = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("long"), F.lit(0))
        found = docs.withColumns({"file": F.xxhash64("_metadata.file_path"), "row": F.col("_metadata.row_index"), "part": part})
    except AnalysisException:
        return None
    files = list(plan.relation().location().inputFiles())
    if len(set(files)) < len(files) or not files:
        return None
    hashes = docs.sparkSession.createDataFrame([(f,) for f in files], "f string").agg(F.count_distinct(F.xxhash64("f"))).first()[0]
    return found if hashes == len(files) else None


def certainly_named(docs: DataFrame) -> DataFrame:
    """named(docs), for which docs is saved where its rows have no names."""
    found = named(docs)
    found = named(saved(docs, "rows")) if found is None else found
    if found is None:
        raise ValueError("the rows have no names that tell them apart")
    return found
