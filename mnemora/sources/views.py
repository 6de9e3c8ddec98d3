"""Record-store views over the shared tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.ordered import with_previous

# Fixed values of the views.
KINDS = {"click": "representation.added", "error": "payload.evicted", "purchase": "payload.restored", "view": "payload.redacted", "signup": "retention.changed"}
STEPS = {"signup": "created", "purchase": "promoted", "error": "rejected", "view": "reopened"}
CLASSES = ("pinned", "durable", "grace", "derivative-only", "reference-only")
CLAIM_STATES = ("superseded", "retracted", "disputed", "active", "active")
REQUIRES = ("raw", "record-only", "representation:ocr")
CONVERSATIONS_FROM = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _named(mapping: dict, column: str):
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), F.col(column))


def ev_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    before = F.when(F.col("event_id") > 0, F.col("event_id"))
    return e.select((F.col("event_id") + 1).alias("seq"), before.alias("prev_seq"), F.col("user_id").alias("target"), _named(KINDS, "event_type").alias("kind"), (F.col("event_id") % 4).alias("rank"), "ts", "value", "props")


def candidate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*STEPS))
    return e.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("target"), _named(STEPS, "event_type").alias("kind"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = table(spark, sf_dir, "conversations")
    shared = [F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("size"), "text"]
    docs = d.select(F.col("doc_id").alias("id"), F.lit("artifact").alias("kind"), _pick(CLASSES, F.col("doc_id") % 5).alias("retention"), (F.col("doc_id") % 4).alias("rank"), F.lit(None).cast("long").alias("session"), *shared)
    turns = c.select((F.lit(CONVERSATIONS_FROM) + 1000 * F.col("conv_id") + F.col("turn")).alias("id"), F.lit("conversation").alias("kind"), F.lit("durable").alias("retention"), (F.col("conv_id") % 4).alias("rank"), F.col("conv_id").alias("session"), *shared)
    return docs.unionByName(turns)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("subject"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("quality").alias("predicate"), F.col("quality").alias("v")), F.struct(F.lit(1).alias("k"), F.lit("toxic").alias("predicate"), F.col("toxic").alias("v")))).alias("c"))
    rows = rows.select((2 * F.col("subject") + F.col("c.k")).alias("id"), "subject", "c.predicate", F.col("c.v").cast("string").alias("object_value"))
    rows = rows.withColumn("state", _pick(CLAIM_STATES, F.col("id") % 5))
    return with_previous(rows, ["predicate"], "subject", "id", "supersedes")


def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(2 * F.col("doc_id"), 2 * F.col("doc_id") + 1)).alias("claim_id"))
    evidence = F.when(F.col("claim_id") % 17 == 0, F.col("doc_id") + 2_000_000_000).otherwise(F.col("doc_id"))
    return ids.select("claim_id", evidence.alias("evidence_id"), _pick(REQUIRES, F.col("claim_id") % 3).alias("requires")).dropDuplicates()


def ingest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return d.select("doc_id", F.when(F.col("doc_id") % 10 == 0, (F.col("doc_id") % 50).cast("string")).otherwise(F.col("digest")).alias("external_id"), "digest")


def _case(column: str, mapping: dict) -> str:
    return f"case {column} " + " ".join(f"when '{a}' then '{b}'" for a, b in mapping.items()) + " end"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL = {
    "ev_log": f"select event_id + 1 as seq, case when event_id > 0 then event_id end as prev_seq, user_id as target, {_case('event_type', KINDS)} as kind, event_id % 4 as rank, ts, value, props from events",
    "candidate_log": f"select event_id + 1 as seq, user_id as target, {_case('event_type', STEPS)} as kind from events where event_type <> 'click'",
    "captures": f"""select doc_id as id, 'artifact' as kind, {_list(CLASSES)}[doc_id % 5 + 1] as retention, doc_id % 4 as rank, cast(null as bigint) as session, sha256(text) as digest, strlen(text) as size, text from documents
union all select {CONVERSATIONS_FROM} + 1000 * conv_id + turn, 'conversation', 'durable', conv_id % 4, conv_id, sha256(text), strlen(text), text from conversations""",
    "claim_rows": f"""select *, {_list(CLAIM_STATES)}[id % 5 + 1] as state, lag(id) over (partition by predicate order by subject) as supersedes from
(select 2 * doc_id as id, doc_id as subject, 'quality' as predicate, cast(quality as varchar) as object_value from labels union all select 2 * doc_id + 1, doc_id, 'toxic', cast(toxic as varchar) from labels)""",
    "claim_evidence": f"""select distinct claim_id, case when claim_id % 17 = 0 then doc_id + 2000000000 else doc_id end as evidence_id, {_list(REQUIRES)}[claim_id % 3 + 1] as requires from (select doc_id, unnest([2 * doc_id, 2 * doc_id + 1]) as claim_id from labels)""",
    "ingest_keys": "select doc_id, case when doc_id % 10 = 0 then cast(doc_id % 50 as varchar) else sha256(text) end as external_id, sha256(text) as digest from documents",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names)
