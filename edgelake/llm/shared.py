"""Tables in the shared folder, reading inputs, and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A side of a join is broadcast only if it was measured and holds at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
BATCH_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where a session in one process names none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="edgelake-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(__import__("shutil").rmtree, root[7:], ignore_errors=True)
    return root.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of a few MB, unless the session sets its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of write_table() that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and broadcasts of steps that are done; else they stay until the driver's heap happens to fill."""
    gc.collect()  # frames that Python still holds
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Tables that an operator writes while it works; all go when its result is written."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out = write_table(df, name)
        self.held.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        drop_table(*tables)
        if tables:
            free(tables[0].sparkSession)
        self.held = [t for t in self.held if all(t is not x for x in tables)]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table, which stays; all others are deleted."""
        out = write_table(df, name)
        self.drop(*self.held)
        return out


def width(kind: DataType, value: Column) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        each = 8 * (1 + len(kind.elementType.fields)) if isinstance(kind.elementType, StructType) else 8
        return F.greatest(F.size(value), F.lit(0)) * each + 8
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its measured rows and bytes are within bounds; else leave the join to shuffle."""
    n, size = df.agg(F.count("*"), sum((F.sum(width(f.dataType, F.col(f.name))) for f in df.schema.fields), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """Return (node, component) for every node of ``edges`` (a, b: bigint); component is the smallest reachable node.

    Alternates large-star and small-star steps; each writes its edges to the shared folder. Minima are
    pre-aggregated before the shuffle, and a hub's edges are dealt again by Spark's skew join.
    """
    star = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    signature = None
    while True:
        # large star: each neighbour larger than the node goes to the smallest of the neighbourhood
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each neighbour not larger than the node goes to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(low, "u")
        step = small_.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        step = tables.write(step, "cc")
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tables.drop(star)
        star = step
        if now == signature:
            break
        signature = now
    roots = star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
