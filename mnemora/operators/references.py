"""Which objects captures and events refer to, what they are labelled, and whether the store holds them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.labels import UNKNOWN
from mnemora.functions.text import strict_digest_of

_REF = "struct<role: string, object: string, media_type: string, derived_from: string>"
DATA = f"payload struct<object: string, state: string, derived_from: string>, representation {_REF}, representations array<{_REF}>, role string, object string, media_type string, derived_from string"
"""The parts of an event's data that refer to objects: nested under payload, representation or representations, or bare."""


def _digests(*references: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[strict_digest_of(r) for r in references])))


def _of_representations(items: Column) -> Column:
    found = F.flatten(F.transform(items, lambda r: F.array(strict_digest_of(r["object"]), strict_digest_of(r["derived_from"]))))
    return F.array_compact(F.coalesce(found, F.array().cast("array<string>")))


def representation_digests(records: DataFrame) -> DataFrame:
    """(id, digest) of what the representations of captures or folded records refer to, each once."""
    return records.select("id", F.explode(F.array_distinct(_of_representations(F.col("representations")))).alias("digest"))


def capture_digests(captures: DataFrame) -> DataFrame:
    """(id, digest) of every object that captures(id, content, payload, representations) refer to, each once."""
    content = F.when(F.col("content.sha256").rlike("^[0-9a-f]{64}$"), F.col("content.sha256"))
    own = F.array_compact(F.array(content, strict_digest_of(F.col("payload.object"))))
    return captures.select("id", F.explode(F.array_distinct(F.concat(own, _of_representations(F.col("representations"))))).alias("digest"))


def event_digests(log: DataFrame) -> DataFrame:
    """(seq, target, rank, digest) of every object that the JSON `data` of log refers to, each once an event."""
    d = F.from_json("data", DATA)
    bare = F.when(d["object"].isNotNull(), F.array(strict_digest_of(d["object"]), strict_digest_of(d["derived_from"]))).otherwise(F.array().cast("array<string>"))
    nested = _digests(d["payload"]["object"], d["payload"]["derived_from"], d["representation"]["object"], d["representation"]["derived_from"])
    every = F.array_distinct(F.array_compact(F.concat(nested, _of_representations(d["representations"]), bare)))
    return log.select("seq", "target", "rank", F.explode(every).alias("digest"))


def event_representations(log: DataFrame) -> DataFrame:
    """(seq, target, pos, role, object, media_type) of the representations that log's `data` carries: one, a list, or the data itself."""
    d = F.from_json("data", DATA)
    bare = F.struct(*[d[c].alias(c) for c in ("role", "object", "media_type", "derived_from")])
    shape = F.when(d["representation"].isNotNull(), F.array(d["representation"])).when(d["representations"].isNotNull(), d["representations"])
    shape = shape.when(d["role"].isNotNull() & d["object"].isNotNull(), F.array(bare))
    return log.select("seq", "target", F.posexplode(F.filter(shape, lambda r: r.isNotNull())).alias("pos", "r")).select("seq", "target", "pos", "r.role", "r.object", "r.media_type")


def label_floors(*references: DataFrame) -> DataFrame:
    """(digest, rank): the highest label of anything that refers to an object, by partial aggregates; an unknown label stays on top."""
    every = reduce(DataFrame.unionByName, [r.select("digest", F.coalesce("rank", F.lit(UNKNOWN)).alias("rank")) for r in references])
    return every.groupBy("digest").agg(F.max("rank").alias("rank"))


def inventory_faults(references: DataFrame, objects: DataFrame) -> DataFrame:
    """(digest, problem) of references(digest, size) against objects(digest, size, error): missing, orphan (a warning), damaged,
    of disagreeing sizes, or not of the size that is expected. A null size expects nothing."""
    wanted = references.groupBy("digest").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    held = objects.groupBy("digest").agg(F.max("size").alias("size"), F.max("error").alias("error"), F.lit(True).alias("held"))
    both = wanted.withColumn("wanted", F.lit(True)).join(held, "digest", "full_outer")
    faults = [
        F.when(F.col("held").isNull(), "missing"), F.when(F.col("wanted").isNull(), "orphan"), F.when(F.col("error").isNotNull(), "damaged"),
        F.when(F.col("lo") != F.col("hi"), "sizes disagree"), F.when(F.col("held") & (F.col("size") != F.col("lo")), "other size"),
    ]
    return both.select("digest", F.explode(F.array_compact(F.array(*faults))).alias("problem"))


def protected_digests(manifests: DataFrame, representations: DataFrame) -> DataFrame:
    """(digest): what retention may never let go: the bytes before and after each change of a document, and representations."""
    sides = manifests.select(F.explode(F.array_compact(F.array("before", "after"))).alias("digest"))
    return sides.unionByName(representations.select("digest")).distinct()


def expand_representations(wanted: DataFrame, held: DataFrame, representations: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, role, outcome, digest) of wanted(id, role): the first representation in fold order whose object is retained.

    held(id) are the records that the caller may see; representations(target, role, object, seq, pos); objects(digest, error).
    An object that is missing is passed over; one that is damaged is an error, not the next one's chance.
    """
    known = objects.select("digest", F.coalesce("error", F.lit("")).alias("__error"))
    found = representations.select(F.col("target").alias("id"), "role", strict_digest_of(F.col("object")).alias("digest"), F.struct("seq", "pos").alias("__at"))
    found = found.join(known, "digest", "left")
    here = F.col("__error").isNotNull()
    best = found.groupBy("id", "role").agg(F.min_by(F.struct("digest", "__error"), F.when(here, F.col("__at"))).alias("__best"))
    rows = wanted.join(held.select("id", F.lit(True).alias("__seen")), "id", "left").join(best.withColumn("__any", F.lit(True)), ["id", "role"], "left")
    outcome = (
        F.when(F.col("__seen").isNull(), "evidence_not_found").when(F.col("__any").isNull(), "representation_not_found").when(F.col("__best.digest").isNull(), "object_unavailable")
        .when(F.col("__best.__error") != "", "projection_corrupt").otherwise("ok")
    )
    return rows.select("id", "role", outcome.alias("outcome"), F.when(outcome == "ok", F.col("__best.digest")).alias("digest"))


def expand_raw(captures: DataFrame, state: DataFrame, objects: DataFrame, ranks: DataFrame, floors: DataFrame, ceiling: int) -> DataFrame:
    """(id, outcome) of captures(id, digest, object, size): bytes that are present, referred to by the capture's own digest, of its own size,
    and whose every reference is within the ceiling."""
    now = state.select(F.col("target").alias("id"), F.col("state").alias("__state"))
    of = ranks.select("id", F.col("rank").alias("__rank"))
    store = objects.select("digest", F.col("size").alias("__held"), F.coalesce("error", F.lit("")).alias("__error"))
    floor = floors.select("digest", F.col("rank").alias("__floor"))
    rows = captures.join(of, "id", "left").join(now, "id", "left").join(store, "digest", "left").join(floor, "digest", "left")
    outcome = (
        F.when(F.coalesce("__rank", F.lit(UNKNOWN)) > ceiling, "evidence_not_found").when(F.coalesce("__state", F.lit("present")) != "present", "material_unavailable")
        .when(~F.col("object").eqNullSafe(F.concat(F.lit("sha256:"), "digest")), "projection_corrupt").when(F.col("__held").isNull(), "object_unavailable")
        .when((F.col("__error") != "") | ~F.col("__held").eqNullSafe(F.col("size")), "projection_corrupt").when(F.coalesce("__floor", F.lit(UNKNOWN)) > ceiling, "evidence_not_found").otherwise("ok")
    )
    return rows.select("id", outcome.alias("outcome"))
