"""Reading the tables of a data directory, and folders that every executor can reach."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``base``."""
    ship_package(spark)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; set only where it is unset, as in tests.

    A session without that setting runs on one machine, so a folder of this machine serves there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        folder = sc._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else "file://" + tempfile.mkdtemp(prefix="quern-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def shared_file(spark: SparkSession, content: bytes, name: str) -> str:
    """Put a file of bounded size into the shared folder, if it isn't there; its address."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        beside = jvm.org.apache.hadoop.fs.Path(f"{path.toString()}-{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(content))
        stream.close()
        fs.rename(beside, path)
    return fs.makeQualified(path).toString()


def ship_package(spark: SparkSession) -> None:
    """Have every Python worker of the session find this package, wherever it was started."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{file.relative_to(root).as_posix()}"), file.read_bytes())
    content = packed.getvalue()
    sc.addPyFile(shared_file(spark, content, f"quern-{hashlib.sha256(content).hexdigest()[:16]}.zip"))
    sc._quern_shipped = True


def arrow_mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with this package on every worker, wherever ``df`` came from."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def pandas_mapped(df: DataFrame, run, schema) -> DataFrame:
    """The same for a function of pandas frames."""
    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)


#: Folders that stage_table wrote in this process.
_STAGED: list[str] = []


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later stages neither recompute it nor
    depend on the executors that made it. clear_staged removes what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Remove the folders this process staged, once nothing reads them any more; how many there were."""
    jvm, removed = spark.sparkContext._jvm, 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        removed += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def _bytes_of(field: StructField) -> Column:
    """About how many bytes a row's value of a column takes, lengths of strings and binary values as they are."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    if isinstance(field.dataType, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 2
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take in memory: one pass that adds up the lengths of its values."""
    row = sum((_bytes_of(f) for f in df.schema.fields), F.lit(32))
    return df.agg(F.sum(row.cast("long")).alias("n")).first()["n"] or 0


def broadcast_if_bounded(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes stay within ``limit_bytes``; else as it is, so that the join
    shuffles. Measuring is a job of its own: ``df`` should be small to compute or staged."""
    return F.broadcast(df) if measured_bytes(df) <= limit_bytes else df
