"""Files: feature tables, resumable result tables, and arrays as lossless JSON."""

from __future__ import annotations

import base64
import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV (with a header), JSON or text; give a schema for CSV and JSON to save a pass."""
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | {k: str(v) for k, v in options.items()})
    if schema:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", "true")
    return reader.format(kind).load(path)


def vector_layout(df: DataFrame, key: str, features: list[str], target: str | None = None) -> DataFrame:
    """(row_id, x, y): features as one array of doubles."""
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    return df.select(F.col(key).alias("row_id"), x, *([F.col(target).cast("double").alias("y")] if target else []))


def wide_layout(df: DataFrame, features: int) -> DataFrame:
    return df.select("row_id", *[F.get("x", k).alias(f"x{k}") for k in range(features)], *(["y"] if "y" in df.columns else []))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written under the folder that spark.checkpoint.dir names, and read back: computed once, whatever executors are
    lost.  Only in local mode a folder of our own serves where it is unset."""
    spark = df.sparkSession
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="thicket-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def resumed(spark: SparkSession, grid: DataFrame, path: str, keys: list[str], run) -> DataFrame:
    """All results of `run(points)`, a DataFrame with the keys: points of the grid that the result table at `path` lacks
    are run and appended, so that a stopped experiment goes on where it was."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        done = spark.read.parquet(path)
        grid = grid.join(done.select(*keys).distinct(), keys, "left_anti")
    append_results(run(grid), path)
    return spark.read.parquet(path)


def array_to_json(a: np.ndarray) -> str:
    return json.dumps({"shape": list(a.shape), "dtype": str(a.dtype), "data": base64.b64encode(np.ascontiguousarray(a).tobytes()).decode()})


def array_from_json(text: str) -> np.ndarray:
    d = json.loads(text)
    return np.frombuffer(base64.b64decode(d["data"]), dtype=d["dtype"]).reshape(d["shape"]).copy()


def plain(value):
    """NumPy scalars and arrays, at any depth, as built-in values."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    return value.item() if isinstance(value, np.generic) else value


def generator_to_json(rng: np.random.Generator) -> str:
    return json.dumps(plain(rng.bit_generator.state))


def generator_from_json(text: str) -> np.random.Generator:
    rng = np.random.default_rng()
    rng.bit_generator.state = json.loads(text)
    return rng
