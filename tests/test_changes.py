"""Compare-and-set, recovery, ordered digests and labels in force against plain loops."""

import hashlib
import random

import pytest

from mnemora.operators import changes, graph
from mnemora.operators.ordered import numbered, with_next


@pytest.mark.parametrize("span", [3, 1 << 16])
def test_accepted_changes_match_a_plain_loop(spark, span):
    rng = random.Random(span)
    rows = [(p, s, rng.choice("abc"), rng.choice(["a", "b", "c", None])) for p in (1, 1, 2, 3, None) for s in [rng.randrange(1000) for _ in range(60)]]
    rows = list({(p, s): (p, s, b, a) for p, s, b, a in rows}.values())
    now, want = {1: "a", 2: "b"}, {}
    for p, s, b, a in sorted(rows, key=lambda r: r[1]):
        want[(p, s)] = p is not None and now.get(p) is not None and now[p] == b
        if want[(p, s)]:
            now[p] = a
    df = spark.createDataFrame(rows, "path int, seq int, before string, after string").repartition(4)
    got = changes.accepted_changes(df, spark.createDataFrame([(1, "a"), (2, "b")], "path int, digest string"), span)
    assert {(r.path, r.seq): r.accepted for r in got.collect()} == want and any(want.values())
    assert changes.accepted_changes(df.where("false"), spark.createDataFrame([], "path int, digest string")).count() == 0


def test_next_values_and_numbers_over_spans(spark):
    rng = random.Random(2)
    rows = [(k, rng.random(), rng.choice([None, None, i])) for k in ("hot", "b", None) for i in range(50 if k == "hot" else 7)]
    df = spark.createDataFrame(rows, "key string, __span double, v int").repartition(4)
    out = with_next(numbered(df, ["key"], ["__span"], "n", "all"), ["key"], ["__span"], "v", "following", span=4)
    for k in ("hot", "b", None):
        own = sorted((r for r in out.collect() if r.key == k), key=lambda r: r["__span"])
        assert [r.n for r in own] == list(range(len(own))) and {r["all"] for r in own} == {len(own)}
        for i, r in enumerate(own):
            assert r.following == next((x.v for x in own[i + 1 :] if x.v is not None), None)


def root(digests, width):
    level, first = digests, True
    while first or len(level) > 1:
        level, first = [hashlib.sha256("".join(level[i : i + width]).encode()).hexdigest() for i in range(0, len(level), width)], False
        if not level:
            return hashlib.sha256(b"").hexdigest()
    return level[0]


def test_tree_hash_shows_any_change(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(30)]
    made = lambda d: changes.tree_hash(spark.createDataFrame(list(enumerate(d)), "at int, d string").repartition(3), ["at"], "d", width=4).first()
    assert tuple(made(digests)) == (30, root(digests, 4))
    swapped = [digests[1], digests[0], *digests[2:]]
    others = [swapped, digests[:-1], [*digests, digests[0]], ["0" * 64, *digests[1:]]]
    assert len({made(d).root for d in [digests, *others]}) == 5
    assert tuple(made(digests[:1])) == (1, root(digests[:1], 4))
    assert tuple(changes.tree_hash(spark.createDataFrame([], "at int, d string"), ["at"], "d").first()) == (0, hashlib.sha256(b"").hexdigest())


def test_each_kind_of_interrupted_transaction(spark):
    a, b = "a" * 64, "b" * 64
    kinds = {"done": ["prepared", "committed"], "both": ["prepared"], "moved": ["prepared"], "lost": ["prepared"], "gone": ["prepared", "committed"], "over": ["prepared", "aborted"], "odd": ["prepared", "committed", "aborted"], "twice": ["prepared", "prepared"], "strange": ["prepared"], "bent": ["prepared"], "uncited": ["prepared"]}
    transactions = spark.createDataFrame([(t, k) for t, ks in kinds.items() for k in ks], "transaction string, kind string")
    object_of = {"both": b}
    cited = {"uncited": 9}
    manifest = spark.createDataFrame([(t, object_of.get(t, a), 5, cited.get(t, 2 if t == "both" else 1)) for t in kinds], "transaction string, digest string, size int, evidence int")
    evidence = spark.createDataFrame([(1, a), (2, b)], "id int, digest string")
    seen = [("done", a, a, 5), (None, b, b, 5), ("both", b, b, 5), ("moved", a, a, 5), ("strange", b, b, 5), ("strange", a, a, 5), ("bent", a, "x", 5), ("uncited", a, a, 5), ("over", a, a, 5)]
    observed = spark.createDataFrame(seen, "transaction string, digest string, found string, size int")
    verdicts = changes.recovery(transactions, manifest, evidence, observed)
    assert {r.transaction: r.verdict for r in verdicts.collect()} == {
        "done": "cleaned", "gone": "cleaned", "both": "recovered", "moved": "recovered", **dict.fromkeys(("lost", "odd", "twice", "strange", "bent", "uncited"), "unresolved")
    }
    evictions = spark.createDataFrame([("moved", a, 1), ("both", b, 2), ("done", a, 1)], "transaction string, digest string, evidence int")
    state = spark.createDataFrame([(1, "evicted"), (2, "present")], "target int, state string")
    steps = changes.repairs(verdicts, manifest, observed, evictions, state).collect()
    assert {tuple(r) for r in steps} == {("done", a, None, "clean"), ("both", b, None, "drop duplicate"), ("moved", a, None, "move back"), ("moved", a, 1, "restore")}


def test_labels_in_force_fail_closed(spark):
    documents = spark.createDataFrame([(1, 0), (2, None), (3, 0), (4, 0), (5, 0), (6, 99)], "id int, rank int")
    claims = spark.createDataFrame([(10, 1, None), (20, 2, 2), (30, 3, None), (40, 4, None), (50, 5, None), (51, 5, 0), (70, 7, 3)], "id int, document int, rank int")
    edges = spark.createDataFrame([(10, 100), (20, 100), (40, 100), (40, 999), (50, 101), (51, 100)], "claim_id int, evidence_id int")
    ranks = spark.createDataFrame([(100, 0), (101, 3)], "id int, rank int")
    found = {r.id: r.rank for r in graph.document_ranks(documents, claims, edges, ranks).collect()}
    assert found == {1: 0, 2: 2, 3: 99, 4: 99, 5: 3, 6: 99}  # 3 has a claim without evidence, 4 cites what is missing
    shown = graph.visible_documents(documents, claims, edges, ranks, "sensitive").collect()
    assert {r.id: r.rank for r in shown} == {1: 0, 2: 2}
