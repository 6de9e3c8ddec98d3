"""Record stores on disk: sealed JSON captures and events, content-addressed objects and curated documents.

Folders are read with `binaryFile`; names that begin with an underscore are not listed, so the event log is read from its own
root. Sizes are checked on the file's length, so that the content of a file over its limit is never read. Such a file, a record that is no
strict JSON, and one whose seal does not match are rows with an `error`, never dropped.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.checkpoints import cut, free_name
from mnemora.functions.records import canonical, strict_load
from mnemora.operators.ordered import with_previous

RECORD_BYTES, TEXT_BYTES, OBJECT_BYTES, FRONT_BYTES = 16 << 20, 8 << 20, 64 << 20, 1 << 20
# The version of records, and their fields.
VERSION = "0.2"
SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "uri", "account", "device", "external_id", "session", "workspace")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
CONTENT = T.StructType([T.StructField("media_type", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType())])
PAYLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("state", "object", "retention")] + [T.StructField("required_representations", T.ArrayType(T.StringType()))])
REPRESENTATION = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "object", "media_type", "created_at", "derived_from")])
CAPTURE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("schema", "record_type", "id", "kind", "captured_at", "ingested_at", "sensitivity", "integrity")]
    + [T.StructField("source", SOURCE), T.StructField("content", CONTENT), T.StructField("payload", PAYLOAD), T.StructField("representations", T.ArrayType(REPRESENTATION)), T.StructField("sealed", T.BooleanType())]
)
EVENT = T.StructType([T.StructField("sequence", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("id", "previous_event", "event_type", "recorded_at", "actor", "target", "data", "sensitivity", "integrity")]])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def checked_record(content: pd.Series) -> pd.DataFrame:
    """The record's text, and what is wrong with it."""

    def one(raw):
        if raw is None:
            return None, "too long"
        try:
            value = strict_load(raw, RECORD_BYTES)
        except (ValueError, RecursionError) as e:
            return None, f"not strict JSON: {type(e).__name__}"
        if not isinstance(value, dict):
            return None, "not an object"
        sealed = "sha256:" + hashlib.sha256(canonical({k: v for k, v in value.items() if k != "integrity"})).hexdigest()
        return canonical(value).decode(), None if value.get("integrity") == sealed else "integrity does not match"

    return pd.DataFrame([one(None if x is None else bytes(x)) for x in content], columns=["text", "error"])


def _files(spark: SparkSession, root: str, glob: str, most: int) -> DataFrame:
    """(path, length, content) of all files; content is null over the limit. Both filters reach the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    read = files.where(F.col("length") <= most).select("path", "length", "content")
    return read.unionByName(files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content")))


def _records(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return _judged(_files(spark, root, "*.json", RECORD_BYTES), schema)


def _judged(files: DataFrame, schema: T.StructType) -> DataFrame:
    rows = files.select("path", checked_record("content").alias("r"))
    named = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    out = rows.select("path", F.col("r.text").alias("raw"), F.from_json("r.text", schema).alias("v"), F.col("r.error").alias("error"))
    fault = F.coalesce("error", F.when(~F.col("v.id").eqNullSafe(named), F.lit("file name is not the id")))
    return out.select("path", "raw", "v.*", fault.alias("error"))


def read_captures(spark: SparkSession, root: str) -> DataFrame:
    """Captures below root with their path, raw text and error."""
    return _records(spark, root, CAPTURE)


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The event log below root, its data as JSON text. Order is that of `sequence`."""
    return _records(spark, root, EVENT)


def stream_events(spark: SparkSession, root: str) -> DataFrame:
    """The event log below root as a stream: each file is read once, also over restarts from a checkpoint. Rows are those of `read_events`; a file over
    the limit is not read into the stream."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    return _judged(files.where(F.col("length") <= RECORD_BYTES).select("path", "length", "content"), EVENT)


def event_error(raw: Column) -> Column:
    """What else is wrong with a sealed event, a JSON text: the first fault under the schema of events, its version or its actor; null for a good one."""
    from mnemora.functions.json_schema import json_faults
    from mnemora.functions.text import is_actor
    from mnemora.sources.schemas import event_schema

    first = F.get(json_faults(event_schema(version=VERSION), raw), F.lit(0))
    return F.coalesce(first, F.when(~is_actor(F.get_json_object(raw, "$.actor")), F.lit("$.actor: not an actor")))


def read_objects(spark: SparkSession, root: str, most: int = OBJECT_BYTES) -> DataFrame:
    """(digest, size, content, error): the digest is the file's name, checked against its bytes."""
    files = _files(spark, root, "*", most)
    name = F.regexp_extract("path", r"([0-9a-f]{64})$", 1)
    actual = F.sha2("content", 256)
    error = F.when(name == "", "not a digest").when(F.col("content").isNull(), "too long").when(name != actual, "bytes do not match the digest")
    return files.select(name.alias("digest"), F.col("length").alias("size"), "content", error.alias("error"))


def object_text(objects: DataFrame, most: int = TEXT_BYTES) -> DataFrame:
    """objects with the strict UTF-8 text of their first `most` bytes and whether that is all."""
    from mnemora.functions.records import text_prefix

    return objects.withColumn("text", text_prefix("content", F.lit(most))).withColumn("truncated", F.col("size") > most)


def new_objects(payloads: DataFrame, objects: DataFrame) -> DataFrame:
    """(digest, content) of payloads(content) that the store does not hold yet, each once."""
    hashed = payloads.select(F.sha2("content", 256).alias("digest"), "content")
    return hashed.dropDuplicates(["digest"]).join(objects.select("digest"), "digest", "left_anti")


def next_events(log: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """fresh(id, ...) numbered on from the end of the log, each linked to the one before.

    The append position is one partial aggregate. Fresh events are dealt by ranges of `order` and written once; numbers are a row's
    place in its part after the sizes of the parts before, so no task sees all fresh events.
    """
    last = log.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("n"), F.max_by("id", "sequence").alias("id")).first()
    spark = fresh.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, at = free_name(fresh, "part"), free_name(fresh, "at")
    dealt = fresh.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = cut(dealt)  # the bounds of ranges come from a sample: another run would deal otherwise
    sizes = {r[part]: r["count"] for r in placed.groupBy(part).count().collect()}  # one number a part
    starts, total = [], last.n
    for k in sorted(sizes):
        starts.append((k, total))
        total += sizes[k]
    offsets = spark.createDataFrame(starts, f"`{part}` int, __start long")
    numbered = placed.join(F.broadcast(offsets), part).withColumn("sequence", F.col("__start") + F.col(at) + 1).drop(part, at, "__start").withColumn(part, F.lit(0))
    linked = with_previous(numbered, [part], "sequence", "id", "previous_event").drop(part)
    return linked.withColumn("previous_event", F.coalesce("previous_event", F.lit(last.id)))


_FRONT = re.compile(rb"\A---\r?\n(.*?)^---\r?\n?", re.S | re.M)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, front_matter, body, error) of curated Markdown below root; index.md and log.md are no documents.

    Front matter is text of at most 1 MiB between two --- lines; `front_fields` reads its plain `key: value` lines.
    """
    files = _files(spark, root, "*.md", TEXT_BYTES).where(~F.col("path").rlike(r"/(index|log)\.md$"))

    @F.pandas_udf("front_matter string, body string, error string")
    def parts(content: pd.Series) -> pd.DataFrame:
        def one(raw):
            if raw is None:
                return None, None, "too long"
            m = _FRONT.match(raw)
            if not m or len(m[1]) > FRONT_BYTES:
                return None, None, "no front matter" if not m else "front matter is too long"
            try:
                return m[1].decode(), raw[m.end() :].decode(), None
            except UnicodeDecodeError:
                return None, None, "not UTF-8"

        return pd.DataFrame([one(None if x is None else bytes(x)) for x in content], columns=["front_matter", "body", "error"])

    return files.select("path", parts("content").alias("p")).select("path", "p.*")


def front_fields(documents: DataFrame) -> DataFrame:
    """documents with `fields`, the map of plain `key: value` lines of the front matter; of a repeated key the first counts."""
    line = F.lit(r"(?m)^([A-Za-z_-]+):[ \t]*(\S.*?)[ \t\r]*$")
    keys, values = F.regexp_extract_all("front_matter", line, 1), F.regexp_extract_all("front_matter", line, 2)
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    first = F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return documents.withColumn("fields", F.map_from_entries(first))
