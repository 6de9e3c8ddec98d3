"""Queries over whole record-store views of the shared tables: references, projections, constraints, retention and gates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import constraints as K
from mnemora.operators import folds, graph
from mnemora.operators import projections as P
from mnemora.operators import references as R
from mnemora.plans.queries import _STATE, ORACLE_SQL, QUERIES, query
from mnemora.sources import views as V
from mnemora.sources.views import table, with_views
from mnemora.streaming.turns import request_error


def _sha(text) -> F.Column:
    return F.sha2(text.cast("string").cast("binary"), 256)


def _ref(digest) -> F.Column:
    return F.concat(F.lit("sha256:"), digest)


def _with_data(s: SparkSession, d: str) -> DataFrame:
    """ev_log with `data`: JSON in one of four shapes by seq % 4; every seventh reference is malformed."""
    log = V.ev_log(s, d)
    own = F.when(F.col("seq") % 7 == 0, F.lit("sha256:zz")).otherwise(_ref(_sha(F.col("seq"))))
    other = _ref(_sha(F.col("kind")))
    one = F.struct(F.lit("ocr").alias("role"), own.alias("object"), other.alias("derived_from"))
    two = F.array(F.struct(F.lit("ocr").alias("role"), own.alias("object")), F.struct(F.lit("text").alias("role"), other.alias("object")))
    data = F.when(F.col("seq") % 4 == 0, F.to_json(F.struct(F.struct(own.alias("object")).alias("payload")))).when(F.col("seq") % 4 == 1, F.to_json(F.struct(one.alias("representation"))))
    data = data.when(F.col("seq") % 4 == 2, F.to_json(F.struct(two.alias("representations")))).otherwise(F.to_json(F.struct(F.lit("ocr").alias("role"), own.alias("object"))))
    return log.withColumn("data", data)


_EVENT_REFS = """refs as (select seq, target, rank, sha256(cast(seq as varchar)) as digest from ev_log where seq % 7 <> 0
union all select seq, target, rank, sha256(kind) from ev_log where seq % 4 in (1, 2))"""


@query(with_views("ev_log") + f", {_EVENT_REFS} select seq, target, digest from refs")
def event_object_references(s, d):
    return R.event_digests(_with_data(s, d)).select("seq", "target", "digest")


_REPS = """reps as (select seq, target, 0 as pos, 'ocr' as role, case when seq % 7 = 0 then 'sha256:zz' else 'sha256:' || sha256(cast(seq as varchar)) end as object from ev_log where seq % 4 <> 0
union all select seq, target, 1, 'text', 'sha256:' || sha256(kind) from ev_log where seq % 4 = 2)"""


@query(with_views("ev_log") + f", {_REPS} select seq, target, pos, role, object from reps")
def event_representation_rows(s, d):
    return R.event_representations(_with_data(s, d)).select("seq", "target", "pos", "role", "object")


@query(with_views("ev_log", "captures") + f", {_EVENT_REFS} select digest, max(rank) as rank from (select digest, rank from captures where digest is not null union all select digest, rank from refs) group by digest")
def object_label_floors(s, d):
    return R.label_floors(V.captures(s, d).where("digest is not null").select("digest", "rank"), R.event_digests(_with_data(s, d)))


def _objects(s: SparkSession, d: str) -> DataFrame:
    """Two thirds of the documents' objects, some damaged, and objects that nothing refers to."""
    docs = table(s, d, "documents").where("doc_id % 3 <> 0")
    held = docs.select(_sha(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 13 == 0, "damaged").alias("error"))
    loose = table(s, d, "pages").select(_sha(F.concat(F.lit("page "), F.col("html"))).alias("digest"), F.octet_length("html").cast("long").alias("size"), F.lit(None).cast("string").alias("error"))
    return held.unionByName(loose).groupBy("digest").agg(F.max("size").alias("size"), F.max("error").alias("error"))


_OBJECTS = """objects as (select digest, max(size) as size, max(error) as error from (select sha256(text) as digest, strlen(text) as size, case when doc_id % 13 = 0 then 'damaged' end as error from documents where doc_id % 3 <> 0
union all select sha256('page ' || html), strlen(html), null from pages) group by digest)"""


@query(with_views("captures") + f""", {_OBJECTS}, wanted as (select digest, min(size + (id % 11 = 0)::int) as lo, max(size + (id % 11 = 0)::int) as hi from captures where digest is not null group by digest)
select w.digest, 'missing' as problem from wanted w anti join objects using (digest) union all select digest, 'orphan' from objects anti join wanted using (digest)
union all select digest, 'damaged' from objects where error is not null union all select digest, 'sizes disagree' from wanted where lo <> hi
union all select w.digest, 'other size' from wanted w join objects o using (digest) where o.size <> w.lo""")
def object_inventory(s, d):
    size = F.col("size") + (F.col("id") % 11 == 0).cast("long")
    return R.inventory_faults(V.captures(s, d).where("digest is not null").select("digest", size.alias("size")), _objects(s, d))


@query("""with m as (select target, sha256(kind || rank) as before, case when seq % 5 <> 0 then sha256(kind || (rank + 1)) end as after from ({0})) select distinct digest from
(select before as digest from m union all select after from m where after is not null union all select sha256(kind) from ({0}) where seq % 4 in (1, 2))""".format(V.SQL["ev_log"]))
def protected_objects(s, d):
    log = V.ev_log(s, d)
    moves = log.select(_sha(F.concat("kind", F.col("rank").cast("string"))).alias("before"), F.when(F.col("seq") % 5 != 0, _sha(F.concat("kind", (F.col("rank") + 1).cast("string")))).alias("after"))
    return R.protected_digests(moves, log.where("seq % 4 in (1, 2)").select(_sha(F.col("kind")).alias("digest")))


@query(with_views("ev_log") + f""", {_REPS}, roles as (select unnest(['ocr', 'text', 'scan']) as role), wanted as (select distinct target as id, role from ev_log cross join roles),
stored as (select sha256(cast(seq as varchar)) as digest, case when seq % 9 = 0 then 'damaged' else '' end as error from ev_log where seq % 3 = 0),
best as (select target as id, role, count(*) as n, arg_min(digest, (seq, pos)) as digest, arg_min(error, (seq, pos)) as error from (select r.*, o.digest, o.error from reps r left join stored o on r.object = 'sha256:' || o.digest) group by all),
first as (select target as id, role, digest, error from reps r join stored o on r.object = 'sha256:' || o.digest qualify row_number() over (partition by target, role order by seq, pos) = 1)
select id, role, case when id % 5 = 0 then 'evidence_not_found' when n is null then 'representation_not_found' when f.digest is null then 'object_unavailable' when f.error <> '' then 'projection_corrupt' else 'ok' end as outcome,
case when outcome = 'ok' then f.digest end as digest from wanted left join (select id, role, n from best) using (id, role) left join first f using (id, role)""")
def expand_representation(s, d):
    log = _with_data(s, d)
    ids = log.select(F.col("target").alias("id")).distinct()
    wanted = ids.select("id", F.explode(F.array(*map(F.lit, ("ocr", "text", "scan")))).alias("role"))
    stored = log.where("seq % 3 = 0").select(_sha(F.col("seq")).alias("digest"), F.when(F.col("seq") % 9 == 0, "damaged").alias("error"))
    return R.expand_representations(wanted, ids.where("id % 5 <> 0"), R.event_representations(log), stored)


_RANKS = "ranks as (select c.id, greatest(max(c.rank), coalesce(max(e.rank), 0)) as rank from captures c left join ev_log e on e.target = c.id group by c.id)"


@query(with_views("ev_log", "captures") + f""", {_OBJECTS}, {_RANKS}, state as (select target, {_STATE} as state from ev_log group by target), floors as (select digest, max(rank) as floor from captures group by digest)
select c.id, case when r.rank > 2 then 'evidence_not_found' when coalesce(st.state, 'present') <> 'present' then 'material_unavailable' when c.id % 17 = 0 then 'projection_corrupt' when o.digest is null then 'object_unavailable'
 when o.error is not null or o.size <> c.size then 'projection_corrupt' when f.floor > 2 then 'evidence_not_found' else 'ok' end as outcome
from captures c join ranks r using (id) left join state st on st.target = c.id left join objects o on o.digest = c.digest left join floors f on f.digest = c.digest""")
def expand_raw_material(s, d):
    captures, log = V.captures(s, d), V.ev_log(s, d)
    named = captures.withColumn("object", F.when(F.col("id") % 17 == 0, F.lit("sha256:other")).otherwise(_ref(F.col("digest"))))
    return R.expand_raw(named, folds.effective_state(log), _objects(s, d), folds.effective_rank(captures, log), graph.object_ranks(captures), 2)


_TAGGED = """case doc_id % 6 when 0 then '{"text": "' || source || '", "unit": "x"}' when 1 then '{"boolean": ' || (quality = 1) || '}' when 2 then '{"number": ' || doc_id || ', "unit": "kg"}'
 when 3 then '{"json": {"b": 1, "a": [2]}, "zz": 0}' when 4 then '{"date": "2024-01-01", "uri": "x:y"}' else '{"other": 1}' end"""


@query(f"""with c as (select doc_id, source, quality from labels join documents using (doc_id)) select doc_id, ['text', 'boolean', 'number', 'json', 'date', 'unknown'][doc_id % 6 + 1] as object_type,
[source, (quality = 1)::varchar, doc_id || ' kg', '{{"a":[2],"b":1}}', '2024-01-01', '{{"other":1}}'][doc_id % 6 + 1] as object_value from c""")
def claim_object_parts(s, d):
    rows = table(s, d, "labels").select("doc_id", "quality").join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    parts = P.object_parts(F.expr(_TAGGED.replace("(quality = 1)", "(quality = 1)")))
    return rows.select("doc_id", parts.alias("p")).select("doc_id", "p.object_type", "p.object_value")


@query(with_views("claim_rows") + """, lines as (select subject as doc_id, string_agg('[claim state=' || state || ']' || chr(10) || predicate || chr(10) || object_value, chr(10) order by id) filter (state in ('active', 'disputed')) as said from claim_rows group by subject)
select doc_id, sha256(concat_ws(chr(10), coalesce(text, ''), case when doc_id % 3 = 0 then 'about ' || source end, lang || ' ' || source, said)) as body_sha256 from documents left join lines using (doc_id)""")
def canon_search_body(s, d):
    claim = F.struct("id", "state", "predicate", F.lit("").alias("statement"), "object_value", F.lit("").alias("object_json"))
    claims = V.claims(s, d).groupBy(F.col("subject").alias("doc_id")).agg(F.array_sort(F.collect_list(claim)).alias("claims"))  # a document's own claims
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("body"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("about "), "source")).alias("description"), F.array("lang", "source").alias("tags"))
    return P.canon_body(docs.join(claims, "doc_id", "left")).select("doc_id", _sha(F.col("search_body")).alias("body_sha256"))


@query("""select page_id, case when page_id % 2 = 0 then 'page.html' else cast(page_id as varchar) end as title, sha256(concat_ws(chr(10), case when page_id % 4 in (0, 1) and page_id % 5 <> 0 and html <> '' then '[raw]' || chr(10) || html end,
case when page_id % 3 = 0 then '[representation:ocr]' || chr(10) || url end, '{"id":"' || page_id || '","kind":"web-capture"}')) as body_sha256 from pages""")
def evidence_search_body(s, d):
    kind = V._pick(("text/html", "application/json", "image/png", "audio/ogg"), F.col("page_id") % 4)
    said = F.array(F.struct(F.lit("ocr").alias("role"), F.when(F.col("page_id") % 3 == 0, "text/plain").otherwise("image/png").alias("media_type"), F.col("url").alias("text")))
    rows = table(s, d, "pages").select(
        "page_id", F.concat(F.lit("evidence/web/"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"), F.when(F.col("page_id") % 2 == 0, "page.html").otherwise("").alias("filename"),
        F.when(F.col("page_id") % 5 == 0, "evicted").otherwise("present").alias("state"), kind.alias("media_type"), F.col("html").alias("text"), said.alias("texts"),
        F.to_json(F.struct(F.lit("web-capture").alias("kind"), F.col("page_id").cast("string").alias("id"))).alias("metadata"),
    )
    return P.evidence_body(rows).select("page_id", "title", _sha(F.col("search_body")).alias("body_sha256"))


_TYPES = ("Project", "Goal", "Note", "Decision", "Person")


@query(f"""select doc_id from (select doc_id, {list(_TYPES)}[doc_id % 5 + 1] as type, doc_id % 7 = 0 as old, quality, toxic from documents left join labels using (doc_id)) where type in ('Project', 'Goal', 'Conflict', 'Decision') and not old
and (quality is null or doc_id % 2 = 1 or quality = 1)""")
def continuity_by_status(s, d):
    status = F.array(F.struct(F.when(F.col("doc_id") % 2 == 1, "retracted").otherwise("active").alias("state"), F.lit("work-status").alias("predicate"), F.when(F.col("quality") == 1, "In-Progress").otherwise("done").alias("object_text")))
    labels = table(s, d, "labels").select("doc_id", status.alias("claims"))
    docs = table(s, d, "documents").select("doc_id", V._pick(_TYPES, F.col("doc_id") % 5).alias("type"), F.when(F.col("doc_id") % 7 == 0, "deprecated").alias("status"))
    return P.continuity_documents(docs.join(labels, "doc_id", "left")).select("doc_id")


@query("""select doc_id from (select doc_id, row_number() over (partition by doc_id % 700 order by path) as n from (select doc_id, source || '/' || lang || '/' || doc_id || '.md' as path from documents)) where n = 1""")
def canon_first_wins(s, d):
    docs = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 700).alias("id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    return P.first_of_each(docs).select("doc_id")


_FILES = "files as (select 'docs/' || doc_id as path, sha256(text) as digest from documents), h as (select sha256(path || chr(10) || digest) as h from files)"
_HALF = "('0x' || substr(h, {}, 15))::bigint"


@query(f"with {_FILES} select count(*) as n, bit_xor({_HALF.format(1)}) as low, cast(sum({_HALF.format(16)} & 1099511627775) as bigint) as high from h")
def source_fingerprint(s, d):
    return P.fingerprint(_files(s, d))


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), _sha(F.col("text")).alias("digest"))


@query("select durable, indexed, durable <> indexed as dirty from (select max(event_id) + 1 as durable, max(event_id + 1) filter (event_type = 'click') as indexed from events)")
def index_freshness(s, d):
    log = V.ev_log(s, d)
    now = P.fingerprint(_files(s, d))
    then = log.where("kind = 'representation.added'").agg(F.max("seq").alias("sequence"))
    return P.freshness(log, then.join(now).select("*", *[F.col(c).alias(f"now_{c}") for c in ("n", "low", "high")]))


@query(with_views("ev_log", "captures", "claim_rows") + f""", {_OBJECTS}, state as (select target, {_STATE} as state from ev_log group by target), kept as (select * from captures where digest is not null and id not in (select target from state where state <> 'present')),
floors as (select digest, max(rank) as floor from captures where digest is not null group by digest), found as (
select 'capture has an unknown kind' as rule from captures where id % 19 = 0 union all select 'payload is not the content' from captures where id % 23 = 0
union all select 'reference-only capture has bytes' from captures where retention = 'reference-only' and id % 2 = 0
union all select 'event has no capture' from ev_log where target not in (select id from captures where id % 3 <> 0)
union all select 'retention change is malformed' from ev_log where kind = 'retention.changed' and seq % 4 = 0
union all select 'representation has no role' from ev_log where kind = 'representation.added' and seq % 6 = 0
union all select 'claim refers to no concept' from claim_rows where id % 4 = 0 and subject not in (select doc_id from documents where doc_id % 5 <> 0)
union all select 'superseded claim is of another subject or predicate' from claim_rows a left join claim_rows b on b.id = a.supersedes where a.supersedes is not null and (b.id is null or b.subject <> a.subject)
union all select 'superseded claim has no back-link' from claim_rows a left join claim_rows b on b.id = a.supersedes where a.supersedes is not null and coalesce(b.state, '') <> 'superseded'
union all select 'present object is missing' from kept anti join objects using (digest)
union all select 'present object is damaged or of another size' from kept k join objects o using (digest) where o.error is not null or o.size <> k.size
union all select 'object is labelled above its capture' from captures join floors using (digest) where floor > rank) select rule, count(*) as n from found group by rule""")
def store_violations(s, d):
    return _store_found(s, d).groupBy("rule").agg(F.count("*").alias("n"))


def _store_found(s: SparkSession, d: str) -> DataFrame:
    captures, log, claims = V.captures(s, d), V.ev_log(s, d), V.claims(s, d)
    spoilt = captures.select(
        "id", F.when(F.col("id") % 19 == 0, "odd").otherwise(F.col("kind")).alias("kind"), "retention", "digest", F.when(F.col("id") % 23 == 0, F.lit("sha256:x")).otherwise(_ref(F.col("digest"))).alias("object"),
        F.when(F.col("id") % 2 == 0, "present").otherwise("external").alias("state"),
    )
    shaped = log.withColumn("was", F.lit("grace")).withColumn("becomes", F.when(F.col("seq") % 4 != 0, "durable")).withColumn("role", F.when(F.col("seq") % 6 == 0, "Not A Role").otherwise("ocr"))
    concepts = table(s, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"))
    return K.union(
        K.capture_faults(spoilt), K.event_faults(shaped, captures.where("id % 3 <> 0")), K.claim_faults(claims.withColumn("ref", F.when(F.col("id") % 4 == 0, F.col("subject"))), concepts),
        K.material_faults(captures, folds.effective_state(log), _objects(s, d), graph.object_ranks(captures)),
    )


@query(with_views("ev_log") + """, phases as (select target, count(*) filter (kind = 'payload.evicted') as p, count(*) filter (kind = 'payload.restored') as c, count(*) filter (kind = 'payload.redacted') as a from (select seq // 3 as target, kind from ev_log) group by target having p + c + a > 0),
done as (select target from phases where p = 1 and c = 1 and a = 0), planned as (select done.target, value from ev_log join done on done.target = seq // 3 where seq % 3 = 0), made as (select done.target, case when seq % 2 = 0 then value else value + 1 end as value from ev_log join done on done.target = seq // 3 where seq % 3 = 0),
promoted as (select seq // 2 as txn, target, rank from ev_log where kind = 'payload.restored'), once as (select txn, min(rank) as rank from promoted group by txn having count(*) = 1),
ends as (select seq // 2 as txn, seq as target from ev_log where kind in ('payload.restored', 'payload.redacted')), one as (select txn from ends group by txn having count(*) = 1),
back as (select seq, seq // 2 - 1 as source, rank from ev_log where kind = 'payload.redacted'), last as (select target as path, arg_max(case when seq % 3 <> 0 then cast(rank as varchar) else '' end, seq) as after from ev_log group by target),
found as (select 'transaction has not one beginning and one end' as rule from phases where p <> 1 or c + a <> 1
union all select 'planned eviction did not happen' from (select * from planned except all select * from made) union all select 'eviction was not planned' from (select * from made except all select * from planned)
union all select 'promoted candidate has not one committed promotion' from ends where txn not in (select txn from once) union all select 'promotion has not one promoted candidate' from promoted where txn not in (select txn from one)
union all select 'rollback has no committed promotion' from back where source not in (select txn from once) union all select 'rollback is not the inverse' from back join once on txn = source where back.rank <> once.rank
union all select 'document is not the last commit''s' from last where after <> '1') select rule, count(*) as n from found group by rule""")
def transaction_violations(s, d):
    return _transactions_found(s, d).groupBy("rule").agg(F.count("*").alias("n"))


def _transactions_found(s: SparkSession, d: str) -> DataFrame:
    log = V.ev_log(s, d)
    third = F.floor(F.col("seq") / 3)
    kinds = {"payload.evicted": "prepared", "payload.restored": "committed", "payload.redacted": "aborted"}
    steps = log.where(F.col("kind").isin(*kinds)).select(third.alias("target"), V._named(kinds, "kind").alias("kind"))
    every = log.where("seq % 3 = 0")
    planned, made = every.select(third.alias("target"), F.col("value").alias("item")), every.select(third.alias("target"), F.when(F.col("seq") % 2 == 0, F.col("value")).otherwise(F.col("value") + 1).alias("item"))
    half = F.floor(F.col("seq") / 2)
    restored = log.where("kind = 'payload.restored'")
    promotions = restored.select(half.alias("transaction"), F.lit("x").alias("before"), F.col("rank").cast("string").alias("after"))
    terminals = log.where("kind in ('payload.restored', 'payload.redacted')").select(F.col("seq").alias("target"), half.alias("transaction"))
    rollbacks = log.where("kind = 'payload.redacted'").select("seq", (half - 1).alias("source"), F.lit("x").alias("before"), F.col("rank").cast("string").alias("after"))
    commits = log.select(F.col("target").alias("path"), "seq", F.when(F.col("seq") % 3 != 0, F.col("rank").cast("string")).otherwise("").alias("after"))
    files = log.select(F.col("target").alias("path"), F.lit("1").alias("digest")).distinct()
    return K.union(K.transaction_faults(steps, planned, made), K.promotion_faults(terminals, promotions, rollbacks), K.drift(commits, files))


@query(" union all ".join(f"select rule, cast(n as bigint) as n from ({ORACLE_SQL[q]})" for q in ("validation_report", "store_violations", "transaction_violations", "object_inventory"))
.replace("select rule, cast(n as bigint) as n from (" + ORACLE_SQL["object_inventory"] + ")", "select 'object is ' || problem as rule, count(*) as n from (" + ORACLE_SQL["object_inventory"] + ") group by problem"))
def full_validation(s, d):
    """All constraint families in one report. Objects that nothing refers to are no error, only a warning."""
    base = QUERIES["validation_report"](s, d).select("rule", "n")
    more = K.union(_store_found(s, d), _transactions_found(s, d)).groupBy("rule").agg(F.count("*").alias("n"))
    objects = QUERIES["object_inventory"](s, d).groupBy(F.concat(F.lit("object is "), "problem").alias("rule")).agg(F.count("*").alias("n"))
    return K.union(base, more, objects)


_NOW, _DAYS = 1704500000000000, 1


@query(with_views("captures", "ev_log") + f""", changes as (select target as id, max(epoch_us(ts)) as since from ev_log where kind = 'retention.changed' group by target)
select distinct digest, c.id || ' grace period has not expired' as reason from captures c left join changes using (id) where retention = 'grace' and digest is not null and coalesce(since, 1704067200000000 + 1000000000 * c.id) > {_NOW} - {_DAYS} * 86400000000""")
def retention_grace(s, d):
    held = V.captures(s, d).withColumn("ingested", F.lit(1704067200000000) + 1000000000 * F.col("id"))
    changes = V.ev_log(s, d).where("kind = 'retention.changed'").select(F.col("target").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return graph.grace_reasons(held, changes, _NOW, _DAYS)


@query(with_views("captures", "ev_log") + """, held as (select id, digest, case when id % 2 = 0 then ['ocr', 'text'] else [] end as required from captures where retention = 'derivative-only' and digest is not null),
reps as (select target as id, case seq % 3 when 0 then 'ocr' when 1 then 'text' else ' ' end as role, seq % 5 <> 0 as whole from ev_log where kind = 'representation.added'), good as (select distinct id, role from reps where role <> ' ' and whole),
faults as (select id, ' has a malformed representation' as f from reps where role = ' ' union select id, ' representation ''' || role || ''' is invalid' from reps where role <> ' ' and not whole
union select id, ' lacks required representation role: ' || r from (select id, unnest(required) as r from held) n anti join good g on g.id = n.id and g.role = r
union select id, ' has no retained representation' from held where len(required) = 0 and id not in (select id from good)) select distinct digest, id || f as reason from held join faults using (id)""")
def retention_derivatives(s, d):
    required = F.when(F.col("id") % 2 == 0, F.array(F.lit("ocr"), F.lit("text"))).otherwise(F.array().cast("array<string>"))
    log = V.ev_log(s, d).where("kind = 'representation.added'")
    role = F.when(F.col("seq") % 3 == 0, "ocr").when(F.col("seq") % 3 == 1, "text").otherwise(" ")
    objects = log.where("seq % 5 <> 0").select(_sha(F.col("seq")).alias("digest"), F.lit(None).cast("string").alias("error"))
    return graph.derivative_reasons(V.captures(s, d).withColumn("required", required), log.select(F.col("target").alias("id"), role.alias("role"), _sha(F.col("seq")).alias("digest")), objects)


@query("""with h as (select sha256(text) as h, max(strlen(text)) as size from documents group by all having min(doc_id) % 3 = 0) select (select max(event_id) + 1 from events) as durable_sequence, count(*) as n_candidates, cast(sum(size) as bigint) as estimated_bytes,
sha256(concat_ws('|', 'policy', (select max(event_id) + 1 from events), count(*), cast(sum(size) as bigint), bit_xor(('0x' || substr(h, 1, 15))::bigint), cast(sum(('0x' || substr(h, 16, 15))::bigint & 1099511627775) as bigint))) as confirmation from h""")
def retention_plan(s, d):
    objects = table(s, d, "documents").groupBy(_sha(F.col("text")).alias("digest")).agg(F.max(F.octet_length("text")).cast("long").alias("size"), (F.min("doc_id") % 3 == 0).alias("evictable"))
    return graph.retention_plan(objects, V.ev_log(s, d), "policy")


_FAULTS = ("", "unknown turn field", "invalid turn host", "invalid turn session_id", "invalid turn user_text", "invalid turn captured_at", "invalid turn sensitivity", "invalid turn request", "invalid turn workspace")


@query(f"select conv_id, turn, case when (conv_id + turn) % 9 = 0 and trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' then '' when (conv_id + turn) % 9 = 0 then 'invalid turn user_text' else {list(_FAULTS)}[(conv_id + turn) % 9 + 1] end as error from conversations")
def turn_request_gate(s, d):
    k = (F.col("conv_id") + F.col("turn")) % 9
    when = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    fields = {
        "host": when(2, F.lit("elsewhere"), F.lit("hermes")), "session_id": when(3, F.repeat(F.lit("s"), F.lit(257)), F.col("conv_id").cast("string")), "turn_id": F.col("turn").cast("string"),
        "user_text": F.when(k == 4, F.lit(" \n ")).when(k == 0, F.col("text")).otherwise("said"), "assistant_text": F.lit("ok\tso"), "captured_at": when(5, F.lit("2024-01-01 00:00:00"), F.lit("2024-01-01T00:00:00Z")),
        "sensitivity": F.when(k == 6, "secret").when(k == 0, "personal"), "workspace": F.when(k == 8, F.lit("")).when(k == 0, "w"), "extra": F.when(k == 1, "x"),
    }
    sent = F.when(k == 7, F.lit("[1]")).otherwise(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(request_error(sent), F.lit("")).alias("error"))


@query("select event_id, case event_id % 4 when 0 then true when 1 then false when 2 then event_id % 3 <> 0 else true end as valid from events")
def validity_intervals(s, d):
    day, later = F.date_format("ts", "yyyy-MM-dd"), F.date_format(F.date_add("ts", 1), "yyyy-MM-dd")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    k = F.col("event_id") % 4
    start = F.when(k == 0, day).when(k == 1, day).when(k == 2, at).otherwise(F.lit(None))
    end = F.when(k == 0, later).when(k == 1, at).when(k == 2, F.when(F.col("event_id") % 3 == 0, at).otherwise(F.concat(later, F.lit("T23:59:59Z")))).otherwise(at)
    return table(s, d, "events").select("event_id", T.is_validity(start, end).alias("valid"))


@query(with_views("candidate_log") + """ select target, status, row_number() over (order by created_at, target) as position from (select target, min(strftime(ts, '%Y-%m-%d')) as created_at, arg_max(kind, seq) as status
from candidate_log join (select event_id + 1 as seq, ts from events) using (seq) group by target) where status = 'reopened'""")
def candidates_listed(s, d):
    """Candidates of one status in the order of (created_at, id) as texts, numbered."""
    from pyspark.sql import Window as W

    log = V.candidate_log(s, d).join(table(s, d, "events").select((F.col("event_id") + 1).alias("seq"), "ts"), "seq")
    last = log.groupBy("target").agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("created_at"), F.max_by("kind", "seq").alias("status")).where("status = 'reopened'")
    before = last.groupBy("created_at").agg(F.count("*").alias("n")).select("created_at", F.coalesce(F.sum("n").over(W.orderBy("created_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(W.partitionBy("created_at").orderBy("target")) + F.col("before")
    return last.join(before, "created_at").select("target", "status", at.alias("position"))


_CITED = "claim evidence is not a list of distinct ids"
_WRONG = ("", "claim proposal sets what promotion owns", "claim proposal misses fields", "the predicate is not dotted lower-case words", "claim object has not one typed value", "claim object number is invalid", "the basis is none of those known",
          "claim observed_at is no time", _CITED, "claim valid is no interval", "claim supersedes is not a list of distinct ids", "claim object has other fields", _CITED, _CITED, _CITED, "claim valid is no interval",
          "the predicate is not dotted lower-case words", "claim statement is empty", "", "claim observed_at is no time")


@query(f"select doc_id, {list(_WRONG)}[doc_id % {len(_WRONG)} + 1] as error from labels".replace('"', "'"))
def claim_proposals(s, d):
    """A proposal for each label, wrong in one way by id: among them citations with another requirement, without a role or with more fields, an
    interval with another field, and texts that end in a line break or are no-break spaces only."""
    from mnemora.operators.proposals import proposal_error

    k = F.col("doc_id") % len(_WRONG)
    on = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    uuid = F.concat(F.lit("018f0000-0000-7000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    other = F.concat(F.lit("018f0000-0000-7000-9000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    cite = lambda who, rest: F.concat(F.lit(', {"id": "'), who, F.lit('", "requires": "' + rest + "}"))
    statement = F.when(k == 2, "").when(k == 17, '"statement": "\u00a0\u2003", ').otherwise('"statement": "It is so.", ')
    said = F.concat(
        F.lit("{"), on(1, '"state": "active", ', ""), statement, F.lit('"predicate": '), F.when(k == 3, '"Bad Predicate"').when(k == 16, '"quality\\n"').otherwise('"quality"'), F.lit(', "object": '),
        F.when(k == 4, '{"text": "a", "boolean": true}').when(k == 5, '{"number": "x"}').when(k == 11, '{"text": "a", "unit": "kg"}').when(k == 0, '{"number": 1.5, "unit": "kg"}').otherwise('{"text": "a"}'),
        F.lit(', "basis": '), on(6, '"guessed"', '"declared"'), F.lit(', "certainty": "confirmed", "observed_at": '), F.when(k == 7, '"2024-01-01"').when(k == 19, '"2024-01-01T00:00:00Z\\n"').otherwise('"2024-01-01T00:00:00Z"'), F.lit(', "evidence": ["'), uuid, F.lit('"'),
        F.when(k == 8, cite(uuid, 'raw"')).when(k == 12, cite(other, 'nonsense"')).when(k == 13, cite(other, 'representation:"')).when(k == 14, cite(other, 'raw", "why": "x"')).when(k == 18, cite(other, 'representation:ocr"')).otherwise(""), F.lit('], "valid": '),
        F.when(k == 9, '{"from": "2024-01-02", "until": "2024-01-01"}').when(k == 15, '{"from": "2024-01-02", "to": "2024-01-03"}').otherwise('{"from": "2024-01-02"}'), F.lit(', "supersedes": '), F.when(k == 10, '["x"]').when(k == 0, "null").otherwise("[]"), F.lit("}"),
    )
    return table(s, d, "labels").select("doc_id", F.coalesce(proposal_error(said), F.lit("")).alias("error"))
