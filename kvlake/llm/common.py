"""What the operators of this package share: written intermediate tables, salted joins, columns' names, Python workers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.session import find_package, scratch, shared_dir

__all__ = ["scratch", "shared_dir"]

#: Written tables of this process that haven't been deleted.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts the lineage and outlives executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    _made.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["written_path"] = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written() that nothing needs any more."""
    for df in tables:
        _made.remove(path := df.__dict__["written_path"])
        remove(df.sparkSession, path)


def made() -> int:
    """How many written tables there are: for sweep() and finished()."""
    return len(_made)


def sweep(spark: SparkSession, *, since: int = 0, but: str = "") -> None:
    """Deletes the written tables of this process, once their results have been used: those made since a time (given by
    made()), but for the path of one that is still needed."""
    for path in _made[since:]:
        if path != but:
            _made.remove(path)
            remove(spark, path)


def finished(df: DataFrame, name: str, since: int) -> DataFrame:
    """df as a written table, without those that were made for it since a time."""
    done = written(df, name)
    sweep(df.sparkSession, since=since, but=done.__dict__["written_path"])
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Enough partitions for rows_each rows in each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


#: Bytes of input for each core below which rows are dealt out before they are worked on.
SPREAD_BYTES = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out over all cores where the input is small for them: a file of one row group is one task otherwise.
    Larger inputs have splits enough and aren't shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPREAD_BYTES else rows


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of an Arrow batch sent to a Python worker, where the session doesn't say otherwise.
BATCH_BYTES = 8 << 20


def python_workers(spark: SparkSession) -> None:
    """Prepares for Python stages: workers find this package, and Arrow batches are bounded by bytes as well as rows, so
    that a batch of very long texts fits a worker's memory."""
    find_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    """Gives freed memory back at the end of a worker's task: workers stay for other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """work, a generator over a task's batches, with release_memory() once it has ended: at the end of work itself its last
    batch and texts are still there, and what lies between them isn't given back."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch], **parameters: object) -> Iterator[pa.RecordBatch]:
        yield from work(batches, **parameters)
        release_memory()

    return run


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front of it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """df with the columns called as one of names, in any case, renamed with underscores in front: results get the names."""
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            df = df.withColumnRenamed(c, unused(df, c))
    return df


#: A key is hot when it has more than one row in HOT_SHARE; there can be no more than HOT_SHARE such keys.
HOT_SHARE = 1000
#: Parts into which the rows of a hot key are dealt.
SALTS = 64


def join_salted(rows: DataFrame, sized: DataFrame, key: str, size: Column, total: int, by: Column) -> DataFrame:
    """rows joined on key with sized (a written table), which has one row for each key and size, the key's number of rows;
    total is that of all keys. Rows of hot keys are dealt over SALTS parts by the hash of by, and their row of sized goes to
    each part. The hot keys, HOT_SHARE of them at most, are literals of the plan; without any it is a plain join."""
    hot = [r[0] for r in sized.where(size * HOT_SHARE > total).select(key).collect()]
    if not hot:
        return rows.join(sized.hint("merge"), key)
    is_hot = F.col(key).isin([bytearray(h) if isinstance(h, bytes) else h for h in hot])
    left = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    right = sized.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    # Dealt by both columns expressly: a join alone may deal by the key only.
    return left.repartition(key, "salt").join(right.repartition(key, "salt").hint("merge"), [key, "salt"]).drop("salt")
