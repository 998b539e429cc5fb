"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space as Java and Python regex classes know it: blank, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: A broadcast side has at most this many rows by count, or the join shuffles.
BROADCAST_ROWS = 20_000
#: Bytes of a row group. A task holds one in its heap while it writes, and Parquet's own 128 MB times the tasks of an
#: executor can be more than there is.
ROW_GROUP = 16 << 20

_TEMPORARY: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("temporary", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, one of our own, and only if driver and executors are
    one process: elsewhere a machine's own folder would be seen in part."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed at the end of the temporary() around it or of the driver."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    held = _TEMPORARY.get()
    if held is None:
        atexit.register(remove, spark, path)
    else:
        held.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # the JVM may be gone at exit; the folder is scratch space
        pass


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made within are removed at the end, so results must have been written elsewhere before."""
    held: list[str] = []
    token = _TEMPORARY.set(held)
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        for path in held:
            remove(spark, path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage: write to a path of the shared folder and read back, so a lost executor costs nothing upstream."""
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """write_table to a fresh scratch path."""
    return write_table(df, scratch(df.sparkSession, name))


def small(df: DataFrame) -> DataFrame:
    """`df` (cheap to read again) to be broadcast if it has at most BROADCAST_ROWS rows by count; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def boxed(df: DataFrame) -> DataFrame:
    """`df` with all its columns in one struct `row`, so that no other column's name can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def case_safe(rows: bool = False):
    """Let an operator take tables that hold names which differ in case only, as `text` and `Text`.

    Spark takes such names for one; the operator reads the one that is written as it writes it (in lower case), and
    the others get names of their own meanwhile. rows: it returns the table's columns, which get their names back."""

    def decorate(fn):
        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **kwargs):
            names = docs.columns
            lower = [c.lower() for c in names]
            if len(set(lower)) == len(names):
                return fn(docs, *args, **kwargs)
            safe = [c if lower.count(low) == 1 or c == low and names.index(c) == i else f"{c} ({i})" for i, (c, low) in enumerate(zip(names, lower, strict=True))]
            out = fn(docs.toDF(*safe), *args, **kwargs)
            return out.toDF(*names) if rows else out

        return run

    return decorate


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in views of at most `rows` rows: Spark bounds a batch's bytes, this bounds what becomes Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def hash_order(*keys: str) -> Column:
    """A number from [0, 1) hashed from keys: a reproducible order."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def hashed_sample(df: DataFrame, n: int, keys: list[str], group: str | None = None) -> DataFrame:
    """The n rows of `df` (keys, group), or of each group, that come first in hash order of `keys`.

    Only hashes below four times the share wanted are ranked, so few rows meet in one task however many there are
    (that fewer than n pass is out of question: the expectation is 4 n). Group sizes are joined by broadcast if they
    are few by count, so that no group is dealt to one task."""
    h, size, rank = "sample hash", "sample size", "sample rank"
    df = df.withColumn(h, hash_order(*keys))
    if group is None:
        few = df.where(F.col(h) < 4.0 * n / max(1, df.count()))
        return few.orderBy(h, *keys).limit(n).drop(h)
    sizes = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias(size)), "sizes")
    few = df.join(small(sizes), group).where(F.col(h) < 4.0 * n / F.col(size))
    order = F.row_number().over(Window.partitionBy(group).orderBy(h, *keys))
    return few.withColumn(rank, order).where(F.col(rank) <= n).drop(h, size, rank)


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space; null gives none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    return F.filter(parts, lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """size(words_of(text)) without filtering: split leaves an empty string at either end at most."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, SPACE_CLASS)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def grouped_index(df: DataFrame, keys: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """A gapless 0-based index of rows within `keys`, ordered by (bucket, *order).

    No task ever holds a whole group: rows are counted by (keys, bucket), the counts are summed into offsets (one row
    a bucket), and rows are numbered within their bucket only. `keys` must hold no nulls; `df` should be cheap to read
    twice (a materialized table)."""
    offset = f"offset of {out}"
    sums = (
        df.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("n in bucket"))
        .withColumn(
            offset,
            F.coalesce(
                F.sum("n in bucket").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("n in bucket")
    )
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.join(sums, [*keys, bucket])
        .withColumn(out, (F.col(offset) + F.row_number().over(within) - 1).cast("long"))
        .drop(offset)
    )
