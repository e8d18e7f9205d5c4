"""Session helpers: table reading, lineage cuts in the shared folder, skew-proof lookups."""

from __future__ import annotations

import atexit
import io
import pathlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table; column pruning and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a folder of
    its own; on a cluster that is an error, since a local folder isn't shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyard-ckpt-"))
    return context.getCheckpointDir()


#: Whether Spark removes the shuffle files of a query when it ends, rather than when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    Cuts the lineage durably: the files survive the loss of any executor, are compressed and keep column pruning.
    They are removed when the driver exits. The shuffle files of the write go with its end, nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyard-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            pass

    atexit.register(remove)
    return spark.read.schema(schema).parquet(path)


def lookup_join(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    count: str,
    hot_rows: int = 200_000,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to one-row-per-key ``groups`` without sending a hot key to one task.

    ``groups[count]`` is the number of rows a key has. Keys with at least ``hot_rows`` rows are broadcast: there can be
    no more than rows/hot_rows of them, which bounds the broadcast whatever the skew. All other keys are shuffled.
    ``how`` is ``inner`` or ``left``.
    """
    keys = list(keys)
    hot = groups.filter(F.col(count) >= hot_rows)
    cold = groups.filter(F.col(count) < hot_rows)
    hot_part = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return hot_part.unionByName(rest.join(cold, keys, how), allowMissingColumns=True)


def block_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_id: str, right_id: str, block_rows: int = 2_000) -> DataFrame:
    """Inner join of two tables on the key of a block, in tasks of even size whatever the size of a block.

    A block with more than ``block_rows`` rows on a side is cut there into chunks of about so many; each chunk of one side
    meets each of the other in a task of its own, so no pair is lost. ``left_id`` and ``right_id`` draw the chunks. Only the
    keys of such blocks are broadcast, which are at most the rows divided by ``block_rows``.
    """
    key = list(key)
    sizes = [x.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows) for x in (left, right)]
    chunks = [x.select(*key, F.ceil(F.col("n") / block_rows).cast("int").alias(c)) for x, c in zip(sizes, ("lc", "rc"))]
    hot = chunks[0].join(chunks[1], key, "full")
    hot = materialise(hot.select(*key, F.coalesce("lc", F.lit(1)).alias("lc"), F.coalesce("rc", F.lit(1)).alias("rc")))
    if hot.isEmpty():
        return left.join(right, key)

    def cut(rows: DataFrame, ident: str, own: str, other: str, of: str, by: str) -> DataFrame:
        marked = rows.join(F.broadcast(hot), key, "left")
        chunk = F.pmod(F.xxhash64(ident), F.coalesce(own, F.lit(1))).cast("int").alias(of)
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(by)
        return marked.select(*rows.columns, chunk, every)

    a, b = cut(left, left_id, "lc", "rc", "l", "r"), cut(right, right_id, "rc", "lc", "r", "l")
    return a.join(b, [*key, "l", "r"]).drop("l", "r")


def blank(c: Column) -> Column:
    """Null or empty after trimming every kind of white space."""
    return c.isNull() | (F.regexp_replace(c, r"[\s ﻿]+", "") == "")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for the Python workers, wherever they were started (once per context).

    The archive is written to the shared folder, from which every executor fetches it.
    """
    context = spark.sparkContext
    if getattr(context, "_tallyard_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root)}")
    path = f"{shared_folder(spark)}/tallyard-{uuid.uuid4().hex}/tallyard_package.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    stream = files.create(target, True)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    context.addPyFile(target.makeQualified(files.getUri(), files.getWorkingDirectory()).toString())
    context._tallyard_shipped = True
