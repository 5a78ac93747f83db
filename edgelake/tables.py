"""Tables in the folder that all executors share: they cut the lineage of iterative work, so that a lost executor costs one step."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where a session in one process names none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="edgelake-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    return root.rstrip("/")


def write_table(df: DataFrame, name: str, area: str = "tables") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{area}/{name}-{uuid.uuid4().hex[:12]}"
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


#: Bytes of an Arrow batch that is handed to Python.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of a few MB, unless the session sets its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
