"""Search projections of documents and evidence, continuity, and how fresh a projection is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.records import canonical_json, number_of
from mnemora.functions.text import is_textual
from mnemora.operators.context import CONTINUITY_TYPES

# Claim states that search sees, the order of a claim object's tags, and what counts as an active status.
CURRENT = ("active", "disputed")
TAGS = ("ref", "text", "boolean", "number", "date", "datetime", "uri", "json")
ACTIVE_STATUS = ("active", "in-progress", "in_progress", "blocked", "open", "paused")


def object_parts(object_json: Column) -> Column:
    """(object_type, object_value, object_json) of a claim's object, a JSON text with one tag: the first tag by a fixed order counts.

    JSON inside the tag `json` and the whole object are in canonical form.
    """
    v = F.try_parse_json(object_json)
    value = {t: F.try_variant_get(v, f"$.{t}", "string") for t in TAGS}
    held = {t: F.array_contains(F.json_object_keys(object_json), t) for t in TAGS}
    kind, shown = F.lit("unknown"), canonical_json(object_json)
    for t in reversed(TAGS):
        own = value[t]
        if t == "number":
            unit = F.try_variant_get(v, "$.unit", "string")
            own = number_of(object_json)
            own = F.when(unit.isNotNull(), F.concat(own, F.lit(" "), unit)).otherwise(own)
        if t == "json":
            own = canonical_json(F.get_json_object(object_json, "$.json"))
        kind, shown = F.when(held[t], t).otherwise(kind), F.when(held[t], own).otherwise(shown)
    return F.struct(kind.alias("object_type"), shown.alias("object_value"), canonical_json(object_json).alias("object_json"))


def canon_body(documents: DataFrame) -> DataFrame:
    """documents with search_body: body, description, tags, and of each current claim its state, predicate, statement, value and JSON.

    claims is an array of (state, predicate, statement, object_value, object_json); superseded and retracted claims are not searched.
    """
    now = F.filter("claims", lambda c: c["state"].isin(*CURRENT))
    lines = F.flatten(F.transform(now, lambda c: F.concat(F.array(F.concat(F.lit("[claim state="), c["state"], F.lit("]"))), F.filter(F.array(*[c[n] for n in ("predicate", "statement", "object_value", "object_json")]), lambda x: x != ""))))
    tags = F.when(F.col("tags").isNotNull(), F.array(F.array_join("tags", " ")))
    described = F.when(F.col("description") != "", F.array("description"))
    none = F.array().cast("array<string>")
    return documents.withColumn("search_body", F.array_join(F.concat(F.array(F.coalesce("body", F.lit(""))), F.coalesce(described, none), F.coalesce(tags, none), F.coalesce(lines, none)), "\n"))


def evidence_body(records: DataFrame) -> DataFrame:
    """records with title and search_body: the raw text where its bytes are present and textual, each textual representation's text, then the metadata.

    records(path, filename, state, media_type, text, texts: array of (role, media_type, text) in fold order, metadata: JSON text).
    """
    raw = F.when((F.col("state") == "present") & is_textual(F.col("media_type")) & (F.col("text") != ""), F.array(F.lit("[raw]"), F.col("text")))
    said = F.filter("texts", lambda r: is_textual(r["media_type"]) & (r["text"] != ""))
    shown = F.flatten(F.transform(said, lambda r: F.array(F.concat(F.lit("[representation:"), F.coalesce(r["role"], F.lit("text")), F.lit("]")), r["text"])))
    none = F.array().cast("array<string>")
    body = F.array_join(F.concat(F.coalesce(raw, none), F.coalesce(shown, none), F.array(canonical_json("metadata"))), "\n")
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return records.withColumn("title", F.coalesce(F.nullif("filename", F.lit("")), stem)).withColumn("search_body", body)


def first_of_each(documents: DataFrame, key: str = "id", order: str = "path") -> DataFrame:
    """documents once for each key, the first by order; rows of a key are compared as partial aggregates, then joined back on their unique order."""
    first = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    return documents.join(first, [key, order], "left_semi")


def walk_key(path: Column) -> Column:
    """Sorts paths as a walk does that takes a folder's files before its subfolders, each by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.concat(F.when(i < F.size(parts) - 1, F.lit("1")).otherwise(F.lit("0")), p))


def continuity_documents(documents: DataFrame) -> DataFrame:
    """Documents of the types that carry on between sessions: not deprecated, and either without a current status claim or with an active one."""
    status = F.filter(F.coalesce("claims", F.array().cast("array<struct<state:string,predicate:string,object_text:string>>")), lambda c: c["state"].isin(*CURRENT) & c["predicate"].endswith("status"))
    live = F.exists(status, lambda c: F.lower(c["object_text"]).isin(*ACTIVE_STATUS))
    return documents.where(F.col("type").isin(*CONTINUITY_TYPES) & ~F.col("status").eqNullSafe(F.lit("deprecated")) & ((F.size(status) == 0) | F.coalesce(live, F.lit(False))))


def handles_of_hits(hits: DataFrame, citations: DataFrame, ranks: DataFrame, ceiling: int) -> DataFrame:
    """(path, position, evidence_id): for the documents among hits(path), the evidence of citations(path, place, evidence_id) that the
    ceiling admits, first seen first, each once. hits is a result of at most some hundred rows and is broadcast."""
    seen = citations.join(F.broadcast(hits.select("path").distinct()), "path").join(ranks.where(F.col("rank") <= ceiling).select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")
    once = seen.groupBy("path", "evidence_id").agg(F.min("place").alias("__at"))
    return once.select("path", F.row_number().over(Window.partitionBy("path").orderBy("__at", "evidence_id")).cast("long").alias("position"), "evidence_id")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row (n, low, high) that changes with any path or content of files(path, digest): xors and sums of halves of each file's
    hash, so that it needs no order and no task sees all files."""
    h = F.sha2(F.concat_ws("\n", "path", "digest"), 256)
    part = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("long")
    return files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(part(1)), F.lit(0)).alias("low"), F.coalesce(F.sum(part(16).bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0)).alias("high"))


def freshness(log: DataFrame, indexed: DataFrame) -> DataFrame:
    """(durable, indexed, dirty) of log(seq) and the one-row indexed(sequence, n, low, high) beside what the sources are now, in now_ columns."""
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("durable"))
    stale = (F.col("durable") != F.col("sequence")) | ~F.struct("n", "low", "high").eqNullSafe(F.struct("now_n", "now_low", "now_high"))
    return end.join(F.broadcast(indexed)).select("durable", F.col("sequence").alias("indexed"), stale.alias("dirty"))
