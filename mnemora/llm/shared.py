"""What the operators share: columns, kept rows, hot keys and folders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.checkpoints import cut, ensure_checkpoint_dir, free_name

__all__ = ["cut", "ensure_checkpoint_dir", "free_name", "join_spread", "keep_first", "only", "remove", "sorted_runs", "utf8"]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the frame carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes; a null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sorted_runs(batches, keys: list[str]):
    """The runs of equal, non-null keys among sorted batches, each as a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            c = batch.column(k)
            change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        ends = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(ends, ends[1:]):
            if held and (a or any(held[-1].column(k)[-1] != batch.column(k)[a] for k in keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def keep_first(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, text_hash) of chosen, all columns as they were; docs is shuffled once."""
    by = [free_name(docs, "id"), free_name(docs, "hash")]
    no_id = F.lit(-(1 << 63))
    marked = docs.select("*", F.coalesce(F.col("`doc_id`").cast("long"), no_id).alias(by[0]), F.xxhash64("`text`").alias(by[1]))
    wanted = chosen.select(F.coalesce("doc_id", no_id).alias(by[0]), F.col("text_hash").alias(by[1])).distinct()
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    kept = marked.join(wanted, by, "left_semi").select("*", nth.alias(free_name(docs, "nth"))).where(f"{free_name(docs, 'nth')} = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared store, through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_spread(rows: DataFrame, one: DataFrame, keys: list[str], times: str, total: int, salts: int = 64) -> DataFrame:
    """rows joined with one, which has a row a key and how many rows have it in `times`. Keys of over a thousandth of all rows, so
    fewer than a thousand, are broadcast, and their rows are dealt over `salts` tasks."""
    hot = F.broadcast(one.where(F.col(times) > max(500, total // 1000)).select(*keys, F.lit(salts).alias("__salts")))
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("__salts", F.lit(1))).cast("int"))
    spread = one.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    return dealt.drop("__salts").join(spread.drop("__salts"), [*keys, "__salt"]).drop("__salt", times)
