"""What the training-data operators share: reading tables, the shared scratch folder, shipping this package."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters ``[\x20\x09-\x0D]`` that every word and line rule here uses.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROOT = Path(__file__).resolve().parents[2]
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` is the quick way where the text is all ASCII and the two agree."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ascii_lower_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); only a plain local master may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/siftspark-scratch"
    return root.rstrip("/")


def new_scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/siftspark-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends at files that outlive any executor."""
    path = new_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """The columns of df under names that an operator's own can't clash with."""
    return df.toDF(*[f"__own_{k}" for k in range(len(df.columns))])


def named(columns: list[str]) -> list[Column]:
    """The columns of ``numbered`` under their names again."""
    return [F.col(f"__own_{k}").alias(c) for k, c in enumerate(columns)]


#: A key is hot if it has more than one in HOT_KEYS of all rows, so there are fewer than HOT_KEYS of them, and at least HOT_ROWS rows.
HOT_KEYS, HOT_ROWS = 2000, 500


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", rows_of_key: str | None = None) -> DataFrame:
    """left join right on key (how: inner or left), where right has one row a key, without a task that gets all rows of a hot key.

    The rows of left with a hot key stay where they are: the few rows of right that they need are broadcast. All others are
    shuffled. left and right are read up to three times, so both should be written tables. Null keys match nothing.
    ``rows_of_key`` names a column of left that says how many rows the key has, if there is one.
    """
    key = [key] if isinstance(key, str) else key
    total = left.count()
    if total <= HOT_ROWS:
        return left.join(right, key, how)
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    if rows_of_key:
        often = left.where(F.col(rows_of_key) > least).select(*key).distinct()
    else:
        often = left.groupBy(*key).count().where(F.col("count") > least).select(*key)
    hot = durable(often.na.drop(), "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, how)
    wanted = durable(right.join(F.broadcast(hot), key, "left_semi"), "hot-rows")
    apart = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(wanted), key, how)
    return apart.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers where neither PYTHONPATH nor their folder has it."""
    roots = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.path.realpath(os.getcwd())]
    sc = spark.sparkContext
    if str(_ROOT) in roots or os.path.exists(os.path.join(os.getcwd(), __package__.split(".")[0])) or getattr(sc, "_siftspark_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(), "siftspark_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((_ROOT / __package__.split(".")[0]).rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(out)
    sc._siftspark_shipped = True


def worker_cache(name: str, make):
    """One object for each Python worker process, kept between tasks."""
    store = sys.modules[__name__].__dict__.setdefault("_CACHE", {})
    if name not in store:
        store[name] = make()
    return store[name]
