"""Lineage cuts that survive lost executors, and lookups that survive hot keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Names of the tables that ``written`` makes begin so.
PREFIX = "kinsieve-"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session (``spark.checkpoint.dir``).

    Only where the session names none, as in local tests, a temporary folder is set.
    """
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="kinsieve-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and forget how: an eager reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """``cut`` and some aggregates of the rows, from the same job. A stage that runs again may count twice: for sizes, not for results."""
    seen = Observation()
    got = cut(df.observe(seen, *[c.alias(n) for n, c in sums.items()]))
    return got, seen.get


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a compressed Parquet table in the shared folder. ``cleared`` removes all such tables of a session.

    A result may still be computed from them lazily, so that no operator can remove its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> int:
    """Removes the tables that ``written`` made in the session's shared folder, when their results are no longer needed; how many there were.

    Checkpoints are Spark's own, which removes them with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith(PREFIX)] if files.exists(folder) else []
    for path in tables:
        files.delete(path, True)
    return len(tables)


def lookup(left: DataFrame, mapping: DataFrame, key: str, hot_above: int, hottest: int | None = None) -> DataFrame:
    """Inner join of ``left`` with ``mapping`` on ``key`` that tolerates hot keys.

    ``mapping`` has one row per key, a column ``weight`` with the number of ``left`` rows of that key, and
    value columns. Keys with ``weight > hot_above`` are broadcast: with N rows in ``left`` there are fewer than
    N / hot_above of them, so the caller bounds the broadcast through ``hot_above``. Other keys are shuffled. A caller that
    knows the greatest weight gives it as ``hottest`` and spares a look at the mapping.
    """
    values = [c for c in mapping.columns if c not in (key, "weight")]
    hot = mapping.where(F.col("weight") > hot_above).drop("weight")
    cold = mapping.where(F.col("weight") <= hot_above).drop("weight")
    if hot.isEmpty() if hottest is None else hottest <= hot_above:
        return left.join(mapping.drop("weight"), key)
    marked = hot.select(key, F.struct(*values).alias("__hot"))
    tagged = left.join(F.broadcast(marked), key, "left")
    keep = [F.col(c) for c in left.columns]
    direct = tagged.where(F.col("__hot").isNotNull()).select(*keep, *[F.col(f"__hot.{v}").alias(v) for v in values])
    rest = tagged.where(F.col("__hot").isNull()).select(*keep).join(cold, key)
    return direct.unionByName(rest.select(*direct.columns))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files give fewer partitions than there are cores; else as it is.

    For small tables with costly work per row. What is shuffled is at most a partition's size for each core, and nothing
    where a table has many files or splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
