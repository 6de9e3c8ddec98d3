import hashlib
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemora.functions import labels as L
from mnemora.functions import text as T
from mnemora.functions.records import canonical, canonical_json, integrity_of, strict_load, text_prefix, uuid7
from mnemora.operators import context as C
from mnemora.operators import folds, graph, search
from mnemora.operators.ordered import with_previous, with_sum_before
from mnemora.sources import records
from mnemora.streaming import turns


def test_labels_fail_closed(spark):
    df = spark.createDataFrame([("public",), (None,), ("secret",), ("restricted",)], "label string").withColumn("rank", L.rank(F.col("label")))
    assert [r.rank for r in df.collect()] == [0, 1, L.UNKNOWN, 3]
    assert L.authorized(df, "restricted").count() == 3
    assert L.narrowed("sensitive", "restricted") == "sensitive" and L.raised("sensitive", "public") == "sensitive"
    assert df.where("false").agg(L.highest(F.col("rank")).alias("r")).first().r == 1
    with pytest.raises(ValueError):
        L.authorized(df, "secret")


def test_ordered_columns_match_plain_loops_over_spans(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(9)) for k in ("a", "b", None) for i in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    want, last, total = {}, {}, {}
    for k, i, v in rows:
        want[k, i] = (last.get(k), total.get(k, 0))
        last[k], total[k] = v, total.get(k, 0) + v
    out = with_sum_before(with_previous(df, ["key"], "at", "v", "prev", span=7), ["key"], "at", "v", "before", span=7)
    assert {(r.key, r.at): (r.prev, r.before) for r in out.collect()} == want
    assert with_previous(df.where("false"), ["key"], "at", "v", "prev").count() == 0


def greedy(items, budget):
    out, used = [], 0
    for title, snippet in items:
        left = budget - used
        if left <= 0:
            break
        if len(title) >= left:
            title, snippet = title[: left - 1] + "…", ""
        elif len(title) + len(snippet) > left:
            snippet = snippet[: left - len(title) - 1] + "…"
        used += len(title) + len(snippet)
        out.append((title, snippet))
    return out


def test_budget_matches_greedy_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for key in range(40):
        items = [("t" * rng.randrange(6), "é" * rng.randrange(12)) for _ in range(rng.randrange(8))]
        rows += [(key, i, *x) for i, x in enumerate(items)]
        want[key] = greedy(items, 20)
    out = C.budgeted(spark.createDataFrame(rows, "key long, pos long, title string, snippet string"), ["key"], "pos", 20)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.key, r.pos)):
        found.setdefault(r.key, []).append((r.title, r.snippet))
    assert found == {k: v for k, v in want.items() if v}
    assert C.allocated(10, 8, 4, 12) == {"core": 8, "continuity": 2, "relevant": 0}


def test_chain_faults_and_candidates(spark):
    good = [(i, f"e{i}", f"e{i - 1}" if i > 1 else None) for i in range(1, 9)]
    chain = lambda rows: sorted((r.seq, r.fault) for r in folds.chain_faults(spark.createDataFrame(rows, "seq long, id string, prev_id string")).collect())
    assert chain(good) == []
    assert chain(good[:3] + good[4:]) == [(5, "gap")]
    assert chain([*good[:4], (5, "e5", "e2"), *good[5:]]) == [(5, "broken link")]
    assert ("repeated id" in dict((f, s) for s, f in chain([*good, (9, "e3", "e8")])))
    log = [(1, 1, "created"), (1, 2, "promoted"), (1, 3, "reopened"), (1, 4, "rejected"), (2, 5, "created"), (2, 6, "reopened"), (3, 7, "promoted"), (4, 8, "created")]
    states = {r.target: r.status for r in folds.candidate_states(spark.createDataFrame(log, "target long, seq long, kind string")).collect()}
    assert states == {1: "rejected", 2: "invalid", 3: "invalid", 4: "pending"}


def test_bm25_matches_fts5(spark):
    rng = random.Random(6)
    words = "alpha beta gamma Été foo bar baz x9".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(body, tokenize = 'unicode61')")
    db.executemany("insert into t(rowid, body) values (?, ?)", docs)
    frame = spark.createDataFrame([(i, i % 3, t) for i, t in docs], "id long, rank int, text string")
    for query, match in (("ete x9", '"ete" OR "x9"'), ("foo-bar", '"foo-bar"'), ("gamma . baz", '"gamma" OR "baz"')):
        want = {i: -s for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (match,)) if i % 3 <= 1}
        found = {r.id: r.score for r in search.bm25(frame, query, "personal").collect()}
        assert found.keys() == want.keys() and all(abs(found[i] - want[i]) <= 1e-9 * max(1, want[i]) for i in want)


def test_search_tiers_ceiling_and_cjk(spark):
    rows = [(i, 3, "the same words") for i in range(5)] + [(9, 0, "the same words")] + [(20, 0, "今日は良い天気です"), (21, 0, "100% SAMEness")]
    docs = spark.createDataFrame(rows, "id long, rank int, text string")
    assert [r.id for r in search.search(docs, "same words", 1, "public").collect()] == [9]
    assert [(r.id, r.tier) for r in search.search(docs, "同じ良い天気", 5, "public").collect()] == [(20, 3)]
    assert [(r.id, r.tier) for r in search.search(docs, "sameNESS", 5, "public").collect()] == [(21, 1)]
    assert [(r.id, r.tier) for r in search.search(docs, "0% s", 5, "public").collect()] == [(21, 2)]
    for bad in ("", " ", "a\0b", "x" * 5000):
        with pytest.raises(ValueError):
            search.search(docs, bad)
    with pytest.raises(ValueError):
        search.search(docs, "a", 101)


def test_text_functions(spark):
    one = lambda **cols: spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    r = one(
        a=T.html_escape(F.lit("<a & 'b'>")), b=T.is_uuid7(F.lit(uuid7())), c=T.is_uuid7(F.lit("x")), d=T.sort_time(F.lit("2024-01-01 00:00:00")), e=T.sort_time(F.lit("1970-01-01T00:00:01+00:00")),
        f=T.bigrams(F.lit("A b")), g=T.bigrams(F.lit("é")), h=T.category(F.lit("retention.apply-prepared")), i=T.is_actor(F.lit("me​")), j=T.is_textual(F.lit("Application/LD+JSON; x")),
        k=T.credentials(F.lit("ghp_" + "a" * 36)), m=T.dotted(F.lit("payload-missing-observed")), n=T.is_absolute_uri(F.lit("https://u:p@h/x")), o=T.digest_of(F.lit("sha256:" + "0" * 64)), p=T.bigrams(F.lit("")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("&lt;a &amp; 'b'&gt;", True, False, 0, 1_000_000)
    assert (r.f, r.g, r.h, r.i, r.j) == (["ab"], ["é"], "retention.apply", False, True)
    assert (r.k, r.m, r.n, r.o, r.p) == (["github-token"], "payload.missing-observed", False, "0" * 64, [])


def test_strict_json_and_prefixes(spark):
    for bad in (b'{"a":1,"a":2}', b'{"a":NaN}', b'{"a":1e999}', b'"\\ud800"', b"\xff"):
        with pytest.raises(ValueError):
            strict_load(bad)
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("{",), (None,)], "t string")
    assert [r.c for r in df.select(canonical_json("t").alias("c")).collect()] == ['{"a":"é","b":1}', None, None]
    sealed = "sha256:" + hashlib.sha256(canonical({"a": 1})).hexdigest()
    assert spark.createDataFrame([('{"a":1,"integrity":"x"}',)], "t string").select(integrity_of("t").alias("i")).first().i == sealed
    raw = spark.createDataFrame([(bytearray("aé".encode()), 2), (bytearray(b"a\xff"), 9)], "b binary, n int")
    assert [r.t for r in raw.select(text_prefix("b", "n").alias("t")).collect()] == ["a", None]


def test_ingest_outcomes_and_retention(spark):
    keys = spark.createDataFrame([(1, "k", "x"), (2, "k", "x"), (3, "k", "y"), (4, None, "z"), (5, None, "z")], "doc_id long, external_id string, digest string")
    assert {r.doc_id: r.outcome for r in graph.first_by_key(keys).collect()} == {1: "new", 2: "replay", 3: "conflict", 4: "new", 5: "replay"}
    captures = spark.createDataFrame([(1, "d", "grace", 5), (2, "d", "durable", 5), (3, "e", "grace", 7), (4, "f", "grace", 9)], "id long, digest string, retention string, size long")
    state = spark.createDataFrame([(4, "evicted")], "target long, state string")
    raw = spark.createDataFrame([], "evidence_id long")
    groups = {r.digest: r.evictable for r in graph.retention_groups(captures, state, graph.blocking_reasons(captures, state, raw)).collect()}
    assert groups == {"d": False, "e": True}


def test_record_store(spark, tmp_path):
    def put(path, record):
        record = record | {"integrity": "sha256:" + hashlib.sha256(canonical(record)).hexdigest()}
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(json.dumps(record).encode())

    for i in (1, 2):
        put(tmp_path / f"evidence/s/c{i}.json", {"id": f"c{i}", "kind": "artifact", "content": {"sha256": "0" * 64, "size": 3}, "sensitivity": "public"})
    (tmp_path / "evidence/s/bad.json").write_text('{"id":"bad","id":"bad"}')
    put(tmp_path / "evidence/_events/x/e1.json", {"id": "e1", "sequence": 1, "previous_event": None, "event_type": "payload.evicted", "target": "c1", "data": {"a": 1}})
    rows = {r.path.rpartition("/")[2]: r for r in records.read_captures(spark, str(tmp_path / "evidence")).collect()}
    assert rows["c1.json"].error is None and rows["c1.json"].content.size == 3 and rows["bad.json"].error.startswith("not strict") and len(rows) == 3
    log = records.read_events(spark, str(tmp_path / "evidence/_events"))
    assert [(r.sequence, r.data, r.error) for r in log.collect()] == [(1, '{"a":1}', None)]
    fresh = spark.createDataFrame([("e3", 2), ("e2", 1), ("e4", 3)], "id string, at int")
    assert [(r.sequence, r.id, r.previous_event) for r in records.next_events(log, fresh, ["at"]).orderBy("sequence").collect()] == [(2, "e2", "e1"), (3, "e3", "e2"), (4, "e4", "e3")]
    digest = hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "objects").mkdir()
    (tmp_path / "objects" / digest).write_bytes(b"abc")
    objects = records.read_objects(spark, str(tmp_path / "objects"))
    assert [(r.text, r.error) for r in records.object_text(objects).collect()] == [("abc", None)]
    assert records.new_objects(spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"x"),), (bytearray(b"x"),)], "content binary"), objects).count() == 1
    (tmp_path / "canon").mkdir()
    (tmp_path / "canon/a.md").write_text("---\ntitle: One: two\nstatus: active\n---\nBody\n")
    (tmp_path / "canon/index.md").write_text("x")
    docs = records.front_fields(records.read_documents(spark, str(tmp_path / "canon"))).collect()
    assert [(r.fields["title"], r.body, r.error) for r in docs] == [("One: two", "Body\n", None)]


def test_streams(spark, tmp_path):
    schema = "host string, session_id string, turn_id string, user_text string, assistant_text string"
    for k, rows in enumerate([[("h", "s", "1", "a", "b"), ("h", "s", "1", "a", "b")], [("h", "s", "1", "a", "b"), ("h", "s", "1", "a", "other"), ("h", "s", "2", "a", "b")]]):
        spark.createDataFrame(rows, schema).write.mode("append").json(str(tmp_path / "in"))
        turns.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store/new")).count() == 2
    assert [r.assistant_text for r in spark.read.parquet(str(tmp_path / "store/conflict")).collect()] == ["other"]
    steps = "session_id string, turn_id string, event string, user_text string, assistant_text string"
    rows = [("s", "1", "candidate", "u", "a"), ("s", "1", "completed", None, None), ("s", "1", "completed", None, None), ("s", "2", "candidate", "u", "a"), ("s", "2", "failed", None, None), ("s", "2", "completed", None, None)]
    spark.createDataFrame(rows, steps).coalesce(1).write.json(str(tmp_path / "steps"))
    q = turns.completed_turns(spark.readStream.schema(steps).json(str(tmp_path / "steps"))).writeStream.format("memory").queryName("done").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from done").collect()] == [("s", "1", "u", "a")]


def test_numbers_of_many_fresh_events(spark):
    """More rows than a range sample covers: the numbers are one gap-free chain in the order of the events."""
    n = 1_200_000
    fresh = spark.range(0, n, 1, 6).select(F.xxhash64("id").alias("at"), F.col("id").cast("string").alias("id"), F.lit("x").alias("__part"))
    log = spark.createDataFrame([("a", 1), ("b", 2)], "id string, sequence long")
    out = records.next_events(log, fresh, ["at"])
    r = out.agg(F.count("*").alias("n"), F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.countDistinct("sequence").alias("d")).first()
    assert (r.n, r.a, r.b, r.d) == (n, 3, n + 2, n)
    prior = out.select((F.col("sequence") + 1).alias("sequence"), F.col("id").alias("before"), F.col("at").alias("then"))
    linked = out.join(prior, "sequence", "left")
    assert linked.where("not (previous_event <=> coalesce(before, 'b')) or then >= at").count() == 0
    assert records.next_events(log, fresh.where("false"), ["at"]).count() == 0


def test_records_at_and_over_the_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RECORD_BYTES", 200)
    for name, size in (("at", 200), ("over", 201)):
        body = {"id": name, "pad": ""}
        body["pad"] = "x" * (size - len(canonical(body)))
        (tmp_path / f"{name}.json").write_bytes(canonical(body))
    found = {r.path.rsplit("/", 1)[1]: (r.error, r.raw is None) for r in records.read_captures(spark, str(tmp_path)).collect()}
    assert found == {"at.json": ("integrity does not match", False), "over.json": ("too long", True)}
    digest = hashlib.sha256(b"abc").hexdigest()
    store = tmp_path / "objects"
    store.mkdir()
    (store / digest).write_bytes(b"abc")
    (store / ("0" * 64)).write_bytes(b"abcd")
    assert {r.digest: (r.error, r.content is None, r.size) for r in records.read_objects(spark, str(store), 3).collect()} == {digest: (None, False, 3), "0" * 64: ("too long", True, 4)}


def test_snippets_and_titles(spark):
    words = [f"w{i}" for i in range(100)]
    words[50], words[60], words[95] = "Été", "foo-bar", "x9"
    text = " ".join(words)
    hits = spark.createDataFrame([(1, text), (2, "Été (x9)"), (3, None), (4, "no hit at all")], "id long, text string")
    got = {r.id: r.snippet for r in search.snippets(hits, "ete foo-bar x9").collect()}
    assert got[1] == " … [Été] " + " ".join(words[51:60]) + " [foo]-[bar] " + " ".join(words[61:81]) + " … "
    assert got[2] == "[Été] ([x9])" and got[3] == "" and got[4] == "no hit at all"
    docs = spark.createDataFrame([(1, 0, "alpha beta", "gamma"), (2, 0, "x", "beta alpha gamma"), (3, 0, "Say Hello", None)], "id long, rank int, title string, text string")
    assert {r.id for r in search.bm25(docs, "beta-gamma", "public", title="title").collect()} == set()
    assert {r.id for r in search.bm25(docs, "alpha-beta", "public", title="title").collect()} == {1}
    assert [(r.id, r.tier) for r in search.search(docs, "ay hel", 5, "public", title="title").collect()] == [(3, 2)]
    long = spark.createDataFrame([(1, 0, "a " * 3 + "b " * 50 + "needle " + "c " * 50)], "id long, rank int, text string")
    assert "[needle]" in search.search(long, "needle", 1, "public", windows=True).first().snippet


def test_more_text_functions(spark):
    one = lambda **cols: spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()
    r = one(
        a=T.textual_type(F.lit("Text/HTML; x")), b=T.textual_type(F.lit("text/ html")), c=T.strict_digest_of(F.lit("sha256:" + "A" * 64)), d=T.precision(F.lit("2024-02-30")), e=T.precision(F.lit("2024-02-28")),
        f=T.is_validity(F.lit("2024-01-01"), F.lit("2024-01-02T00:00:00Z")), g=T.is_validity(F.lit("2024-01-01"), F.lit("2024-01-02")), h=T.is_validity(F.lit("2024-01-02"), F.lit("2024-01-02")),
        i=T.is_validity(F.lit(None), F.lit("x")), j=T.source_folder(F.lit(" My/Source ")), k=T.source_folder(F.lit("..")), m=T.turn_external_id(F.lit(None), F.lit("a"), F.lit("b")),
        n=T.shown_parts(F.expr("array(named_struct('text', 'a', 'synthetic', false, 'ignored', null), named_struct('text', 'b', 'synthetic', true, 'ignored', false), named_struct('text', 'c', 'synthetic', null, 'ignored', false))")),
        o=T.bigrams(F.lit("a b😀c"), 3),
    )
    assert r == {"a": "text/html", "b": None, "c": None, "d": None, "e": "date", "f": False, "g": True, "h": False, "i": False, "j": "my-source", "k": "unknown", "m": None, "n": "a\nc", "o": ["ab"]}


def test_front_matter_and_policies(spark):
    from mnemora.sources import frontmatter as Y

    rows = [("title: x\nat: 2024-01-01\ntags: [a, b]\nx: {claims: [{id: 1}]}", None), ("a: 1\na: 2", None), ("- 1", None), (None, "too long"), ("a: " + "[" * 70 + "]" * 70, None), ("1: x", None), ("a: &a x\n" + "b: [" + "*a, " * 60 + "]", None)]
    got = Y.with_front(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, front_matter string, error string")).orderBy("i").collect()
    assert json.loads(got[0].front) == {"title": "x", "at": "2024-01-01", "tags": ["a", "b"], "x": {"claims": [{"id": 1}]}} and got[0].error is None
    assert [r.front for r in got[1:]] == [None] * 6 and got[3].error == "too long"
    assert all(w in r.error for w, r in zip(("repeated", "mapping", "deep", "no text", "aliases"), [got[1], got[2], got[4], got[5], got[6]]))
    assert Y.context_policy(b'{"budget_chars": 30, "core_chars": 10, "continuity_chars": 10, "relevant_chars": 10}')["budgets"]["total"] == 30
    assert Y.retention_policy(b'{"grace_days": 3, "holds": {"evidence": ["a"]}}')["holds"]["evidence"] == ["a"]
    for bad in (b'{"budget_chars": 29, "core_chars": 10, "continuity_chars": 10, "relevant_chars": 10}', b'{"zz": 1}', b'{"core_chars": true}'):
        with pytest.raises(ValueError):
            Y.context_policy(bad)
    with pytest.raises(ValueError):
        Y.retention_policy(b'{"grace_days": 1, "automatic_eviction": true}')


def test_refresh_matches_a_fold_of_the_whole_log(spark, tmp_path):
    from mnemora.streaming import refresh

    rng = random.Random(9)
    kinds = [*folds.STATES, "representation.added", "retention.changed"]
    rows = [(rng.randrange(9), i, rng.choice(kinds)) for i in range(120)]
    schema, source = "target long, seq long, kind string", f"{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").json(source)
        refresh.refresh(spark.readStream.schema(schema).json(source), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    want = folds.effective_state(spark.createDataFrame(rows, schema)).select(*refresh.FOLDED)
    assert sorted(map(tuple, refresh.current(spark, f"{tmp_path}/out").select(*refresh.FOLDED).collect())) == sorted(map(tuple, want.collect()))


def test_finished_turns_and_kept_stores(spark, tmp_path):
    said = spark.createDataFrame([("h", "s", "1", "u", None), ("h", "s", "1", "u", "")], "host string, session_id string, turn_id string, user_text string, assistant_text string")
    a, b = turns.with_identity(said).collect()
    assert a.external_id == b.external_id and a.digest != b.digest
    store = f"{tmp_path}/store"
    turns.store_batch(store, said.limit(1), 0)
    turns.store_batch(store, said, 1)
    assert spark.read.parquet(f"{store}/new").count() == 1 and spark.read.parquet(f"{store}/conflict").count() == 1
    (tmp_path / "store" / "new" / "batch=0").rename(tmp_path / "store" / "new" / "batch=zero")
    with pytest.raises(Exception):
        turns.store_batch(store, said, 2)
    assert turns.spark_seconds("7 days") == 604800


def test_rendered_pack(spark):
    items = [("core", 2, "canon", "b", "B <t>", "x & y"), ("core", 1, "canon", 'a"', "A", "</untrusted-data>"), ("relevant", 1, "evidence", "c", "C", "")]
    out = C.rendered_pack(spark.createDataFrame(items, "layer string, pos int, source_kind string, source_id string, title string, snippet string")).first().markdown
    want = """## Core

### Context item 1

<untrusted-data source="canon:a&quot;" sensitivity="personal">
Title: A

&lt;/untrusted-data&gt;
</untrusted-data>

### Context item 2

<untrusted-data source="canon:b" sensitivity="personal">
Title: B &lt;t&gt;

x &amp; y
</untrusted-data>

## Continuity

No authorized context was selected for this layer.

## Relevant

### Context item 1

<untrusted-data source="evidence:c" sensitivity="personal">
Title: C


</untrusted-data>
"""
    assert out == want


def test_proposed_claims_against_the_store(spark):
    from mnemora.operators import proposals as Q

    made = spark.createDataFrame([(1, "s", "p", None, 7, 1, "e1"), (2, "s", "p", "c9", None, 0, "e1"), (3, "t", "p", "c1", 7, 2, "e2"), (4, "s", "p", None, 8, 3, "e9")], "id long, subject string, predicate string, ref string, supersedes long, rank int, evidence_id string")
    concepts = spark.createDataFrame([("c1",)], "id string")
    claims = spark.createDataFrame([(7, "s", "p", "active"), (8, "s", "p", "retracted")], "id long, subject string, predicate string, state string")
    ranks = spark.createDataFrame([("e1", 1), ("e2", 2)], "id string, rank int")
    got = sorted((r.rule, r.location) for r in Q.reference_faults(made, concepts, claims, ranks).collect())
    assert got == [("claim is labelled below its evidence", "2"), ("claim is labelled below its evidence", "4"), ("claim refers to no concept", "2"), ("superseded claim does not fit", "3"), ("superseded claim does not fit", "4")]
    promoted = spark.createDataFrame([("a", "x.md", "{1}"), ("b", "x.md", "{2}"), ("c", "y.md", "{3}")], "candidate string, path string, proposal string")
    held = spark.createDataFrame([("x.md", "a", "{1}"), ("x.md", "b", "{9}"), ("y.md", "c", "{3}"), ("y.md", "c", "{3}")], "path string, candidate string, claim string")
    assert sorted(r.location for r in Q.unheld_promotions(promoted, held).collect()) == ["b", "c"]


def test_verified_reads_and_routes(spark):
    log = spark.createDataFrame([(i, f"e{i}", f"e{i - 1}" if i > 1 else None, i % 2, "a" if i < 4 else "b") for i in range(1, 7)], "seq long, id string, prev_id string, target int, kind string")
    assert [r.seq for r in folds.verified_events(log, 1, ("a",)).collect()] == [1, 3]
    with pytest.raises(ValueError):
        folds.verified_events(log.where("seq <> 2"), 1)
    assert folds.one_record(log, "e2").count() == 1 and folds.one_record(log, "none").count() == 0
    with pytest.raises(ValueError):
        folds.one_record(log.unionByName(log), "e2")
    source = "struct<session:string,workspace:string,metadata:map<string,string>>"
    captures = spark.createDataFrame([(1, ("s", None, None)), (2, (None, "w", {"session": "s"})), (3, ("t", None, {"session": "s"})), (4, None)], f"id int, source {source}")
    assert [r.id for r in C.routed(captures, "s").collect()] == [1, 2] and [r.id for r in C.routed(captures, "s", "w").collect()] == [2]


def test_keys_of_several_columns_and_restores(spark):
    from mnemora.operators import graph

    keys = spark.createDataFrame([(1, "a", None, "x"), (2, "a", None, "x"), (3, "a", "u", "y"), (4, "a", None, "z"), (5, None, None, "x")], "doc_id long, kind string, uri string, digest string")
    assert [r.outcome for r in graph.first_by_key(keys, ["kind", "uri"]).orderBy("doc_id").collect()] == ["new", "replay", "new", "conflict", "new"]
    steps = spark.createDataFrame([("t", "prepared", 1), ("t", "aborted", 20), ("u", "prepared", 1), ("u", "committed", 20), ("v", "prepared", 1), ("v", "aborted", 9)], "target string, kind string, seq long")
    schema = "target string, seq long, item string, rank int"
    gone = spark.createDataFrame([("t", 2, "a", 1), ("t", 3, "b", 2), ("t", 4, "c", 0), ("t", 5, "d", 0), ("u", 2, "a", 0), ("v", 3, "a", 0), ("v", 30, "late", 0)], schema)
    back = spark.createDataFrame([("t", 10, "a", 1), ("t", 11, "b", 1), ("t", 12, "x", 0), ("v", 4, "a", 0)], schema)
    assert sorted((r.target, r.n, r.problem) for r in folds.unrestored(steps, gone, back).collect()) == [("t", 2, "labelled lower"), ("t", 3, "restored out of order"), ("t", 4, "not restored")]


def test_chain_parts_are_cut_by_rows(spark, monkeypatch):
    rows = [(i, str(i), str(i - 1) if i > 1 else None) for i in range(1, 101) if i != 50] + [(7, "7", "6"), (99, "x", "98")]
    log = spark.createDataFrame(rows, "seq long, id string, prev_id string")
    whole = sorted(map(tuple, folds.chain_faults(log).collect()))
    monkeypatch.setattr(folds, "CHAIN_ROWS", 10)
    cut = folds.chain_faults(log)
    assert "hashpartitioning(seq#" in (plan := cut._jdf.queryExecution().executedPlan().toString()) and ", 11), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, cut.collect())) == whole and {f for _, f in whole} >= {"repeated sequence", "repeated id", "gap"}
