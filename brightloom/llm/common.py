"""Shared pieces of the training-data operators.

Texts that are null count as empty everywhere. Operators select the columns they need, so extra columns of any
name never clash with their own; columns they return are fixed and listed in each docstring.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's, else (local masters only) a new one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="brightloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends or at release()."""
    path = f"{shared_dir(spark)}/brightloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: a cut in the lineage that outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes every staged table. Results that are still lazy read them, so call it after those are written."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone; its folder is then the cluster's to clean
            pass


atexit.register(release)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def remainder(mod: int, col: str = "doc_id"):
    """crc32(doc_id as text) mod `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % mod


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the strings of one column take at most `most` bytes, or are a single one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n + 64
        yield batch.slice(at)


def by_slices(strings: pa.Array, f: Callable[[list], Iterable], kind: pa.DataType, most: int = 4_000_000) -> pa.Array:
    """f's values for an array of strings, computed on cuts of it as slices() makes them."""
    cuts = slices(iter([pa.RecordBatch.from_arrays([strings], ["s"])]), "s", most)
    made = [pa.array(f(b.column("s").to_pylist()), kind) for b in cuts]
    return pa.concat_arrays(made) if made else pa.array([], kind)


#: A key is hot if it has at least 1 / HOT of all rows, so at most HOT keys are.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, often: str, total: int) -> DataFrame:
    """rows inner-joined to table (one row for each non-null key; `often`: how many of the `total` rows have it).

    Hot keys are broadcast, so their rows stay where they are; the others' rows are shuffled to their keys.
    """
    hot = F.col(often) * HOT >= total
    few, rest = F.broadcast(table.where(hot).drop(often)), table.where(~hot).drop(often)
    marked = rows.join(few.select(F.col(key), F.lit(True).alias("__hot")), key, "left")
    return rows.join(few, key).unionByName(marked.where("__hot IS NULL").drop("__hot").join(rest, key))


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int, per: int = 100_000) -> DataFrame:
    """df with `rank`: gapless from 0 within each value of keys, however many rows share one.

    Rows of a key are split into blocks of about `per` by a hash of `order`; a block's rank starts after the rows of the
    blocks before it. So no task holds more than a block, hot key or not. rows: how many df has, for the block count.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(max(1, -(-rows // per)))).cast("int")
    d = df.withColumn("__block", block)
    before = (
        d.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "__block", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    at = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(*order)) - 1
    return d.withColumn("__at", at).join(before, [*keys, "__block"]).withColumn("rank", F.col("__before") + F.col("__at")).drop("__block", "__before", "__at")
