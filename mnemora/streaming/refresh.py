"""Keeps the folded state of targets up to date from a stream of events, without reading the log again.

The state lies in PARTS parts by a hash of the target. A batch reads and writes only the parts that its events touch, each as a new
version of the part; of a part the last two versions are kept, so that a batch can be repeated, and older ones are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemora.checkpoints import cut
from mnemora.operators.folds import effective_state
from mnemora.sources.folders import numbered_folders, remove

FOLDED = ("target", "state", "state_seq", "n_representations", "retention_seq", "last_seq")
PARTS = 256


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two folds of disjoint parts of a log as one, by partial aggregates: the later state wins, counts add up."""
    both = old.select(*FOLDED).unionByName(new.select(*FOLDED))
    return both.groupBy("target").agg(
        F.coalesce(F.max_by("state", "state_seq"), F.lit("present")).alias("state"), F.max("state_seq").alias("state_seq"), F.sum("n_representations").alias("n_representations"),
        F.max("retention_seq").alias("retention_seq"), F.max("last_seq").alias("last_seq"),
    )


def _part(target) -> F.Column:
    return F.pmod(F.xxhash64(target), F.lit(PARTS)).cast("int")


def _versions(spark: SparkSession, store: str) -> dict[int, list[int]]:
    """The finished batches that have written each part, in order; no more than a few versions of PARTS parts are kept."""
    out: dict[int, list[int]] = {}
    for number in numbered_folders(spark, store, "batch"):
        for part in numbered_folders(spark, f"{store}/batch={number}", "part", finished=False):
            out.setdefault(part, []).append(number)
    return out


def current(spark: SparkSession, store: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """The newest state in the folder `store` (of batches before the given one; of some parts only), or null if there is none."""
    newest = {p: max(n for n in of if before is None or n < before) for p, of in _versions(spark, store).items() if (parts is None or p in parts) and (before is None or of[0] < before)}
    return spark.read.parquet(*[f"{store}/batch={n}/part={p}" for p, n in sorted(newest.items())]) if newest else None


def _drop_old(spark: SparkSession, store: str, parts: list[int], number: int) -> None:
    versions = _versions(spark, store)
    for part in parts:
        for old in [n for n in versions.get(part, []) if n <= number][:-2]:
            remove(spark, f"{store}/batch={old}/part={part}")
            if not numbered_folders(spark, f"{store}/batch={old}", "part", finished=False):
                remove(spark, f"{store}/batch={old}")


def refresh(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of events(target, seq, kind) into `store`; a repeated batch writes its own versions again."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut(effective_state(batch).withColumn("part", _part(F.col("target"))))
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most PARTS numbers
        old = current(spark, store, number, touched)
        state = new if old is None else merged(old, new).withColumn("part", _part(F.col("target")))
        state.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")
        _drop_old(spark, store, touched, number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
