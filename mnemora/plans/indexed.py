"""Registered queries over the written search index (built in batches, with later texts, additions and deletions), over labels in force and under compiled schemas."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.checkpoints import ensure_checkpoint_dir
from mnemora.functions.json_schema import json_faults
from mnemora.operators import graph, packs, postings, search
from mnemora.plans.queries import _FOLD, _GRAMS, _HITS, _PLAIN, _TOKENS, PHRASE, PLAIN, QUERY, _bm25_sql, _budget_sql, query
from mnemora.sources import views as V
from mnemora.sources.schemas import event_schema
from mnemora.sources.views import table, with_views

_LEFT = "from documents where doc_id % 10 <> 7)"
EXTRA, BUCKETS = 1_000_000_000, 8


def _index(s: SparkSession, d: str, compacted: bool = False) -> str:
    """The documents whose id does not end in 7, after three batches: the first has only the beginnings of every third text, the second
    their whole texts and copies under other ids, the third takes the copies and ids ending in 7 away."""
    ensure_checkpoint_dir(s)
    folder = f"{s.sparkContext.getCheckpointDir()}/index-{uuid4().hex}"
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).cast("int").alias("rank"), "text", F.lit(False).alias("deleted"))
    later = F.col("id") % 3 == 0
    postings.update(s, folder, docs.withColumn("text", F.when(later, F.concat(F.lit("draft "), F.substring("text", 1, 200))).otherwise(F.col("text"))), 1, BUCKETS)
    copies = docs.where("id % 50 = 1").withColumn("id", F.col("id") + EXTRA)
    postings.update(s, folder, docs.where(later).unionByName(copies), 2, BUCKETS)
    gone = docs.where("id % 10 = 7").unionByName(copies).withColumn("deleted", F.lit(True))
    postings.update(s, folder, gone, 3, BUCKETS)
    if compacted:
        postings.compact(s, folder, 4, BUCKETS)
    return folder


def _best(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(40).select("id", F.round("score", 6).alias("score"))


@query(f"with {_bm25_sql(QUERY).replace('from documents)', _LEFT)} select id, round(score, 6) as score from scored order by scored.score desc, id limit 40")
def index_bm25(s, d):
    return _best(postings.bm25(s, _index(s, d), QUERY, "personal", BUCKETS))


@query(f"with {_bm25_sql(PHRASE).replace('from documents)', _LEFT)} select id, round(score, 6) as score from scored order by scored.score desc, id limit 40")
def index_phrase_compacted(s, d):
    return _best(postings.bm25(s, _index(s, d, compacted=True), PHRASE, "personal", BUCKETS))


@query(f"""select id, round(hits / {len(_GRAMS)}, 6) as score from (select doc_id as id, doc_id % 4 as rank, case when length(p) > 1 then {_HITS} else 0 end as hits from (select *, {_PLAIN} as p {_LEFT})
where rank <= 1 and hits >= {max(1, (len(_GRAMS) + 1) // 2)} order by hits desc, id limit 40""")
def index_gram_overlap(s, d):
    return _best(postings.gram_overlap(s, _index(s, d), PLAIN, "personal", BUCKETS))


@query(f"select token as term, count(distinct doc_id) as df from (select doc_id, unnest({_TOKENS}) as token {_LEFT} group by token")
def index_frequencies(s, d):
    return postings.counts(s, _index(s, d))


_LABELS = with_views("claim_rows", "claim_evidence") + """, cited as (select * from claim_evidence where claim_id % 23 <> 0),
labelled as (select doc_id as id, case doc_id % 5 when 4 then null else doc_id % 5 end as rank from documents),
said as (select id, coalesce(rank, 1) as rank from labelled
 union all select c.subject, case c.id % 7 when 0 then c.id % 4 when 1 then 99 end from claim_rows c where c.id % 7 <= 1
 union all select c.subject, coalesce(r.rank, 99) from claim_rows c left join cited e on e.claim_id = c.id left join (select id, coalesce(rank, 1) as rank from labelled) r on r.id = e.evidence_id),
in_force as (select id, max(rank) as rank from said where id in (select id from labelled) group by id)"""


def _labelled(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents of which every fifth has no label, claims of which some state one, citations (none for some claims, some of what is not there), and labels of evidence."""
    own = F.when(F.col("doc_id") % 5 < 4, (F.col("doc_id") % 5).cast("int"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), own.alias("rank"), "text")
    stated = F.when(F.col("id") % 7 == 0, (F.col("id") % 4).cast("int")).when(F.col("id") % 7 == 1, F.lit(99))
    claims = V.claims(s, d).select("id", F.col("subject").alias("document"), stated.alias("rank"))
    edges = V.claim_evidence(s, d).where("claim_id % 23 <> 0")
    return docs, claims, edges, docs.select("id", F.coalesce("rank", F.lit(1)).alias("rank"))


@query(_LABELS + " select id, rank from in_force")
def document_sensitivity(s, d):
    return graph.document_ranks(*_labelled(s, d)).select("id", F.col("rank").cast("long").alias("rank"))


@query(_LABELS + ", " + _bm25_sql(QUERY).replace("doc_id % 4 as rank, text", "in_force.rank as rank, text", 1).replace("from documents)", "from documents join in_force on in_force.id = doc_id)") + """
select id, round(score, 6) as score from scored order by scored.score desc, id limit 40""")
def search_by_label_in_force(s, d):
    """BM25 over all documents, shown by the label in force; corpus counts cover hidden documents too."""
    docs, *rest = _labelled(s, d)
    ranked = docs.drop("rank").join(graph.document_ranks(docs, *rest), "id")
    return _best(search.bm25(ranked, QUERY, "personal"))


@query("""select event_id, array_to_string(list_sort(list_filter([
 case when event_id = 0 then '$.sequence: minimum' end, case when event_id % 3 = 0 then '$.event_type: pattern' end, case when user_id % 7 = 0 then '$.recorded_at: format' end, case when user_id % 7 = 0 then '$.recorded_at: pattern' end,
 case when user_id % 11 = 0 then '$.actor: minLength' end, case when user_id % 11 = 1 then '$: required actor' end, case when user_id % 13 = 0 then '$.sensitivity: enum' end, case when value <= 5 then '$.sealed: const' end,
 case when cast(json_extract(props, '$.k') as int) > 90 then '$.data.k: maximum' end, case when event_id % 17 = 1 then '$.previous_event: oneOf' end], lambda x: x is not null)), '; ') as faults from events""")
def schema_faults(s, d):
    """All faults of every event, sealed as a JSON record in which parts go wrong by their own values, under the compiled schema of events."""
    e, id_, user = table(s, d, "events"), F.col("event_id"), F.col("user_id")
    uuid = lambda n: F.concat(F.lit("018f0000-0000-7000-8000-"), F.lpad(n.cast("string"), 12, "0"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = {
        "id": quoted(uuid(id_)), "sequence": id_.cast("string"), "previous_event": F.when(id_ % 17 == 1, "7").when(id_ > 0, quoted(uuid(id_ - 1))).otherwise("null"),
        "event_type": quoted(F.when(id_ % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit("payload."), "event_type"))),
        "recorded_at": quoted(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(user % 7 == 0, "").otherwise("Z"))), "data": F.coalesce("props", F.lit("null")),
        "sensitivity": quoted(F.when(user % 13 == 0, "secret").otherwise("personal")), "sealed": (F.col("value") > 5).cast("string"), "integrity": quoted(F.concat(F.lit("sha256:"), F.sha2("props", 256))),
    }
    said = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    actor = F.when(user % 11 != 1, F.when(user % 11 == 0, '"actor": ""').otherwise('"actor": "user"'))
    record = F.concat(F.lit("{"), F.concat_ws(", ", *said, actor), F.lit("}"))
    found = json_faults(event_schema({"type": "object", "properties": {"k": {"type": "integer", "maximum": 90}}}), record)
    return e.select("event_id", F.array_join(found, "; ").alias("faults"))


_IN_FORCE_BM25 = _bm25_sql(QUERY).replace("doc_id % 4 as rank, text", "in_force.rank as rank, text", 1).replace("from documents)", "from documents join in_force on in_force.id = doc_id)")


@query(_LABELS + ", " + _IN_FORCE_BM25 + f""", shown as (select doc_id, source, trim(text, ' ') as text, printf('%s/%09d', source, doc_id) as path, source = 'src0' as core, doc_id % 3 <> 2 and doc_id % 7 <> 0 and doc_id % 50 = 1 as carries from documents join in_force on id = doc_id where rank <= 1),
best as (select id, 1 as tier, row_number() over (order by score desc, id) as place from scored qualify place <= 80
 union all select doc_id, 2, row_number() over (order by doc_id) as place from documents join in_force on id = doc_id where rank <= 1 and contains({_FOLD}, '{QUERY}') and (select count(*) from scored) < 80 qualify place <= 80),
hits as (select id, row_number() over (order by tier, place) as pos from (select * from best qualify row_number() over (partition by id order by tier, place) = 1) order by tier, place limit 20),
layers as (select 0 as layer_no, 'core' as layer, 8000 as budget, row_number() over (order by path) as pos, 'canon' as source_kind, doc_id as source_id, source as title, text as snippet from shown where core
 union all select 1, 'continuity', 4000, row_number() over (order by which, late, path), kind, sid, title, snippet from
  (select 0 as which, -turn as late, '' as path, 'evidence' as kind, {V.CONVERSATIONS_FROM} + 1000 * conv_id + turn as sid, role as title, text as snippet from conversations where conv_id = 1
   union all select 1, 0, path, 'canon', doc_id, source, text from shown where carries)
 union all select 2, 'relevant', 12000, pos, 'canon', id, source, left(documents.text, 320) from hits join documents on doc_id = id),
once as (select * from layers qualify row_number() over (partition by source_kind, source_id order by layer_no, pos) = 1) """ + _budget_sql("select * from once", "layer", "pos", "layer, pos, source_kind, source_id", "budget"))
def context_pack(s, d):
    """A pack of one conversation and all documents: those of one source are core, some carry on between sessions."""
    docs, *rest = _labelled(s, d)
    more = table(s, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), (F.col("source") == "src0").alias("core"), F.col("source").alias("title"),
        F.when((F.col("doc_id") % 3 != 2) & (F.col("doc_id") % 50 == 1), "Project").otherwise("Note").alias("type"), F.when(F.col("doc_id") % 7 == 0, "deprecated").otherwise("active").alias("status"),
        F.lit(None).cast("array<struct<state:string,predicate:string,object_text:string>>").alias("claims"),
    )
    c = table(s, d, "conversations")
    source = F.struct(F.col("conv_id").cast("string").alias("session"), F.lit(None).cast("string").alias("workspace"), F.expr("cast(null as map<string,string>)").alias("metadata"))
    captures = c.select((F.lit(V.CONVERSATIONS_FROM) + 1000 * F.col("conv_id") + F.col("turn")).alias("id"), F.lit("conversation").alias("kind"), source.alias("source"), F.timestamp_micros(F.col("turn")).alias("captured_at"), F.col("role").alias("title"), "text", (F.col("conv_id") % 4).alias("rank"))
    return packs.build_pack(docs.join(more, "id"), *rest, captures, QUERY, "personal", session="1", limit=20)
