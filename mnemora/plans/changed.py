"""Registered queries over changes under compare-and-set, interrupted transactions and ordered digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.checkpoints import cut
from mnemora.operators import changes, folds, graph
from mnemora.plans.queries import _STATE, _raw_needed, query
from mnemora.sources import views as V
from mnemora.sources.views import _list, table, with_views


@query("""with recursive c as (select user_id as path, event_id as seq, cast(json_extract(props, '$.k') as int) % 3 as before, cast(json_extract(props, '$.k') as int) // 3 % 3 as after from events),
walk as (select distinct path, 0 as state, cast(-1 as bigint) as seq from c where path % 5 <> 0
 union all select c.path, arg_min(c.after, c.seq), min(c.seq) from walk w join c on c.path = w.path and c.before = w.state and c.seq > w.seq group by c.path)
select path, seq, seq in (select seq from walk) as accepted from c""")
def accepted_changes(s, d):
    """Each user's events as competing changes of one of three states; every fifth user has no state to begin with."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(s, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), (k % 3).alias("before"), (F.floor(k / 3) % 3).cast("int").alias("after"))
    start = rows.where("path % 5 <> 0").select("path", F.lit(0).alias("digest")).distinct()
    return changes.accepted_changes(rows, start).select("path", "seq", "accepted")


def _interrupted(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """A transaction for each source and remainder of doc_id: its documents are the objects, and their files are as the ids say."""
    docs = table(s, d, "documents").select("doc_id", F.concat("source", F.lit("-"), (F.col("doc_id") % 40).cast("string")).alias("transaction"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 40).alias("r"))
    first = docs.groupBy("transaction").agg(F.min("r").alias("r"))
    kinds = F.array_compact(F.array(F.lit("prepared"), F.when(F.col("r") % 4 == 1, "committed"), F.when(F.col("r") % 8 == 3, "aborted"), F.when(F.col("r") % 20 == 5, "aborted")))
    near = F.col("doc_id") % 7
    in_place = docs.where((F.col("r") % 4 != 1) & (near != 2)).select(F.lit(None).cast("string").alias("transaction"), "digest", F.when(F.col("doc_id") % 97 == 5, F.lit("other")).otherwise(F.col("digest")).alias("found"), "size")
    aside = docs.where(near.isin(2, 3)).select("transaction", F.when(F.col("doc_id") % 89 == 2, F.concat("digest", F.lit("x"))).otherwise(F.col("digest")).alias("digest"), "digest", "size").toDF("transaction", "digest", "found", "size")
    one = in_place.groupBy("transaction", "digest").agg(F.min("found").alias("found"), F.min("size").alias("size")).unionByName(aside.groupBy("transaction", "digest").agg(F.min("found").alias("found"), F.min("size").alias("size")))
    return {
        "transactions": first.select("transaction", F.explode(kinds).alias("kind")), "manifest": docs.select("transaction", "digest", "size", F.col("doc_id").alias("evidence")),
        "evidence": docs.where("doc_id % 101 <> 7").select(F.col("doc_id").alias("id"), "digest"), "observed": one,
        "evictions": docs.where("doc_id % 3 = 0").select("transaction", "digest", F.col("doc_id").alias("evidence")), "state": docs.select(F.col("doc_id").alias("target"), F.when(F.col("doc_id") % 6 == 0, "evicted").otherwise("present").alias("state")),
    }


_INTERRUPTED = """with docs as (select doc_id, source || '-' || doc_id % 40 as tx, sha256(text) as digest, strlen(text) as size, doc_id % 40 as r from documents),
tx as (select tx, min(r) as r from docs group by tx),
phase as (select tx, r % 4 = 1 as committed, r % 8 = 3 or r % 20 = 5 as aborted from tx),
place as (select digest, min(case when doc_id % 97 = 5 then 'other' else digest end) as found, min(size) as size from docs where r % 4 <> 1 and doc_id % 7 <> 2 group by digest),
aside as (select tx, case when doc_id % 89 = 2 then digest || 'x' else digest end as name, min(digest) as found, min(size) as size from docs where doc_id % 7 in (2, 3) group by all),
pairs as (select distinct m.tx, m.digest, p.digest is not null as source, p.found = m.digest and p.size = m.size as source_whole, a.name is not null as quarantine, a.found = m.digest and a.size = m.size as aside_whole
 from docs m left join place p on p.digest = m.digest left join aside a on a.tx = m.tx and a.name = m.digest),
bad as (select tx from docs where doc_id % 101 = 7
 union select tx from pairs join phase using (tx) where (source and not source_whole) or (quarantine and not aside_whole) or (not source and not quarantine and not committed)
 union select tx from aside where (tx, name) not in (select (tx, digest) from docs)),
verdicts as (select tx as transaction, case when (committed and aborted) or tx in (select tx from bad) then 'unresolved' when committed then 'cleaned' else 'recovered' end as verdict from phase where committed or not aborted)"""


@query(_INTERRUPTED + " select * from verdicts")
def recovery_verdicts(s, d):
    x = _interrupted(s, d)
    return changes.recovery(x["transactions"], x["manifest"], x["evidence"], x["observed"])


@query(_INTERRUPTED + """ select transaction, digest, cast(null as bigint) as evidence, case when verdict = 'cleaned' then 'clean' when source then 'drop duplicate' else 'move back' end as step
from pairs join verdicts on transaction = tx where verdict <> 'unresolved' and quarantine
union all select tx, digest, doc_id, 'restore' from docs join verdicts on transaction = tx where verdict = 'recovered' and doc_id % 6 = 0""")
def recovery_steps(s, d):
    x = _interrupted(s, d)
    found = changes.recovery(x["transactions"], x["manifest"], x["evidence"], x["observed"])
    return changes.repairs(found, x["manifest"], x["observed"], x["evictions"], x["state"])


@query("""with a as (select digest, row_number() over (order by digest, doc_id) - 1 as k from (select doc_id, sha256(text) as digest from documents)),
b as (select k // 1024 as k, sha256(string_agg(digest, '' order by k)) as digest from a group by k // 1024),
c as (select k // 1024 as k, sha256(string_agg(digest, '' order by k)) as digest from b group by k // 1024)
select (select count(*) from a) as n, case when (select count(*) from b) > 1 then (select min(digest) from c) else (select min(digest) from b) end as root""")
def tree_digest(s, d):
    """One digest of the digests of all documents in their order."""
    rows = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return changes.tree_hash(rows.withColumn("by", F.col("digest")), ["by", "doc_id"], "digest")


_ROOM = 700


@query(f"""with recursive p as (select conv_id, turn, case turn % 3 when 1 then 'é😀' || text else text end as said, turn % 5 <> 4 as textual from conversations),
parts as (select *, case when turn % 7 = 5 then 0 when turn % 7 = 3 then strlen(said) end as bad, row_number() over (partition by conv_id order by turn) as n from p),
w as (select distinct conv_id, cast(0 as bigint) as n, cast({_ROOM} as bigint) as room, '' as text, false as cut from parts
 union all select conv_id, n, room - used - case when used > 0 and room - used > 1 then 2 else 0 end, text || case when text <> '' and used > 0 then chr(10) || chr(10) else '' end || left(said, used), cut
 from (select s.conv_id, s.n, w.room, w.text, s.said, ok and (length(said) > w.room or bad is not null) as cut, cast(case when ok then least(length(said), w.room) else 0 end as bigint) as used
  from w join (select * from parts) s on s.conv_id = w.conv_id and s.n = w.n + 1, lateral (select s.textual and (s.bad is null or 4 * w.room <= s.bad) as ok) where not w.cut and w.room > 0))
select conv_id as id, sha256(arg_max(text, n)) as text_sha256, arg_max(length(text), n) as n_chars, arg_max(cut, n) as truncated from w group by conv_id""")
def bounded_parts(s, d):
    """Each conversation's turns as parts of one text: some in wide characters, some of other types, some with a byte that is no UTF-8 at the beginning or end."""
    from mnemora.operators.parts import bounded_texts

    said = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("é😀"), "text")).otherwise(F.col("text")).cast("binary")
    spoilt = F.unhex(F.lit("ff"))
    content = F.when(F.col("turn") % 7 == 5, F.concat(spoilt, said)).when(F.col("turn") % 7 == 3, F.concat(said, spoilt)).otherwise(said)
    kind = F.when(F.col("turn") % 5 == 4, "image/png").otherwise("text/plain")
    parts = table(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), content.alias("content"), kind.alias("media_type"))
    out = bounded_texts(parts, _ROOM)
    return out.select("id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), "truncated")


_DAY, _NOW, _DAYS = 86_400_000_000, 1_700_000_000_000_000, 30
_PREVIEW = with_views("ev_log", "claim_rows", "claim_evidence") + f""", docs as (select doc_id as id, sha256(text) as digest, strlen(text) as size, {_list(V.CLASSES)}[doc_id % 5 + 1] as retention,
 case when doc_id % 13 <> 4 then {_NOW} - (doc_id % 60) * {_DAY} end as ingested from documents),
state as (select target, {_STATE} as state from ev_log group by target), kept as (select * from docs where id not in (select target from state where state <> 'present')),
changed as (select id, {_NOW} - (id % 45) * {_DAY} as changed_at from docs where id % 9 = 0), whole as (select digest from docs group by digest having bool_and(id % 31 <> 0)),
reps as (select a.id, case when a.id % 4 = 0 then 'text' when a.id % 29 = 3 then ' ' else 'ocr' end as role, b.digest from docs a join docs b on b.id = a.id + 1 where a.id % 3 <> 1),
sound as (select id, role from reps where trim(role) <> '' and digest in (select digest from whole)),
reasons as (select digest, id || ' retention is ' || retention as reason from kept where retention in ('pinned', 'durable')
 union select digest, id || ' retention does not permit raw eviction' from kept where retention = 'reference-only'
 union select digest, kept.id || ' grace period has not expired' from kept left join changed on changed.id = kept.id where retention = 'grace' and coalesce(coalesce(changed_at, ingested) > {_NOW - _DAYS * _DAY}, true)
 union select digest, kept.id || case when trim(r.role) = '' then ' has a malformed representation' else ' representation ''' || r.role || ''' is invalid' end from kept join (select id, role, digest as rd from reps) r on r.id = kept.id
  where retention = 'derivative-only' and (trim(r.role) = '' or rd not in (select digest from whole))
 union select digest, id || ' lacks required representation role: ocr' from kept where retention = 'derivative-only' and id % 2 = 0 and id not in (select id from sound where role = 'ocr')
 union select digest, id || ' has no retained representation' from kept where retention = 'derivative-only' and id % 2 = 1 and id not in (select id from sound)
 union select digest, 'active Claim requires raw bytes' from kept where id in (select evidence_id from claim_rows join claim_evidence on claim_id = claim_rows.id where state = 'active' and requires = 'raw')
 union select digest, 'owner or legal hold' from kept where id % 41 = 0 or digest in (select digest from docs where id % 43 = 0)
 union select digest, 'object is kept as a snapshot or representation' from kept where digest in (select digest from docs where id % 47 = 0)
 union select digest, 'object is missing or not whole' from kept where digest not in (select digest from whole)),
verdicts as (select digest, size, n_evidence, coalesce(n, 0) as n_reasons, n is null as evictable from (select digest, max(size) as size, count(*) as n_evidence from kept group by digest) g left join (select digest, count(*) as n from reasons group by digest) using (digest))"""


def _preview(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reasons and verdicts over all documents as captures, with dates, holds, representations and objects by their ids."""
    docs, id_ = table(s, d, "documents"), F.col("id")
    pick = F.element_at(F.array(*map(F.lit, V.CLASSES)), (F.col("doc_id") % 5 + 1).cast("int"))
    ingested = F.when(F.col("doc_id") % 13 != 4, F.lit(_NOW) - (F.col("doc_id") % 60) * _DAY)
    required = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("ocr"))).otherwise(F.expr("cast(array() as array<string>)"))
    captures = cut(docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"), pick.alias("retention"), ingested.alias("ingested"), required.alias("required")))
    objects = captures.groupBy("digest").agg(F.when(F.bool_and(id_ % 31 != 0), F.lit(None).cast("string")).otherwise("bytes differ").alias("error"))
    role = F.when(id_ % 4 == 0, "text").when(id_ % 29 == 3, " ").otherwise("ocr")
    after = captures.select((id_ - 1).alias("id"), "digest")
    representations = captures.where("id % 3 <> 1").select("id", role.alias("role")).join(after, "id")
    state = folds.effective_state(V.ev_log(s, d))
    reasons = graph.preview_reasons(
        captures, state, raw_needed=_raw_needed(s, d), held=captures.where("id % 41 = 0"), held_objects=captures.where("id % 43 = 0"), protected=captures.where("id % 47 = 0"), objects=objects,
        changes=captures.where("id % 9 = 0").select("id", (F.lit(_NOW) - (id_ % 45) * _DAY).alias("at")), representations=representations, now=_NOW, days=_DAYS,
    )
    return reasons, graph.retention_groups(captures, state, reasons)


@query(_PREVIEW + " select * from reasons")
def retention_preview_reasons(s, d):
    return _preview(s, d)[0]


@query(_PREVIEW + " select * from verdicts")
def retention_preview(s, d):
    return _preview(s, d)[1]


@query(_PREVIEW + """, free as (select size, sha256(digest || '|' || size || '|' || n_evidence) as said, row_number() over (order by digest) - 1 as place from verdicts where evictable),
b as (select place // 1024 as k, sha256(string_agg(said, '' order by place)) as said from free group by place // 1024), c as (select sha256(string_agg(said, '' order by k)) as said from b),
sums as (select count(*) as n_candidates, cast(coalesce(sum(size), 0) as bigint) as estimated_bytes from free)
select n_candidates, estimated_bytes, sha256('policy|7|' || n_candidates || '|' || estimated_bytes || '|' || case when n_candidates = 0 then sha256('') when n_candidates > 1024 then c.said else (select said from b) end) as confirmation from sums cross join c""")
def retention_confirmation(s, d):
    return graph.preview_confirmation(_preview(s, d)[1], "policy", 7)
