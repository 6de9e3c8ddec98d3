import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm import queries
from mnemora.llm.fingerprints import _BIT_OF, _MOVES, _RECORDS, BITS, CYCLE, classes, edited_with, fingerprint, fingerprint_report, likeness, links, text_fingerprint, walk

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp int, Part string"


def slow(text):
    """The embedded string, step by step, and its sampled bits."""
    chars, i, step, embedded = classes(text), 0, 0, []
    while i < len(chars):
        embedded.append(chars[i])
        i += int(_MOVES[chars[i]][step % CYCLE])
        step += 1
    bits = [0] * BITS
    for b in range(BITS):
        if embedded:
            bits[b] = int(_BIT_OF[b][embedded[max(r for r in _RECORDS[b].tolist() if r < len(embedded))]])
    return np.packbits(np.array(bits, dtype=np.uint8)).tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_walk_against_single_steps(a, b):
    assert text_fingerprint(a) == slow(a)
    edited = edited_with(a, b)
    half = len(a) // 2
    chars, left = classes(a), walk(classes(a))
    kept = len(a) - half
    added = classes(b[:half])
    assert fingerprint(chars[:kept] + added, left[:kept] + walk(added, left[kept - 1] if kept else 0)).tobytes() == slow(edited)


def rows_of(rows):
    order = sorted(rows, key=lambda r: -r.doc_id)
    out = {}
    for r, after in zip(order, order[1:] + order[:1]):
        edited = edited_with(r.text or "", after.text or "")
        f, e, n = (np.frombuffer(text_fingerprint(t), dtype=np.uint8) for t in (r.text, edited, after.text))
        out[r.doc_id] = (len(r.text or ""), hashlib.sha256(edited.encode()).hexdigest(), f.tobytes().hex(), e.tobytes().hex(), likeness(f, e), likeness(f, n))
    return out


def groups_of(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}
    bits = {i: np.frombuffer(bytes.fromhex(prints[i]), dtype=np.uint8) for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op12_document_fingerprints(spark, SF)
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = {r.doc_id: r for r in got.collect()}
    assert {k: tuple(r)[1:7] for k, r in got.items()} == rows_of(docs)
    assert {k: r.component_id for k, r in got.items()} == groups_of({k: r.fingerprint for k, r in got.items()}, 6)
    assert len({r.component_id for r in got.values()}) < len(got)
    assert np.median([r.near_edited for r in got.values() if r.n_chars > 20]) > 0.4 > 0.25 > np.median([r.near_next for r in got.values()])


def test_few_edits_stay_near():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    far, close = [], []
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(400))
        k = rng.randrange(len(text))
        a, b = (np.frombuffer(text_fingerprint(t), dtype=np.uint8) for t in (text, text[:k] + "x" + text[k:]))
        close.append(likeness(a, b))
        far.append(likeness(a, np.frombuffer(text_fingerprint(" ".join(rng.choice(words) for _ in range(400))), dtype=np.uint8)))
    assert np.mean(close) > 0.85 and max(far) < 0.5


def test_edge_cases(spark):
    rows = [(3, "abc"), (3, "abc"), (2, None), (1, ""), (None, "ünï\U0001f600"), (None, None), (7, "y" * 5000)]
    got = [tuple(r) for r in fingerprint_report(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)).collect()]
    assert len(got) == 7 and {r[0]: r[1] for r in got if r[0] is not None} == {3: 3, 2: 0, 1: 0, 7: 5000}
    by = {}
    for r in got:
        by.setdefault(r[3], set()).add((r[0], r[7]))
    assert by["0" * 64] == {(2, 1), (1, 1), (None, 1)}
    assert {r[7] for r in got if r[0] == 3} == {3}
    (r,) = fingerprint_report(spark.createDataFrame([(1, "abcd", 1, "x")], SCHEMA)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    assert fingerprint_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_bucket_is_dealt_over_tasks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, BITS // 8, dtype=np.uint8)
    rows = []
    for k in range(300):
        fp = base.copy()
        fp[k % 32] ^= 1 << (k // 32 % 8)
        rows.append((fp.tobytes(),))
    fps = spark.createDataFrame(sorted(set(rows)), "fp binary")
    from mnemora.llm.components import connected_components

    found = connected_components(links(fps, cap=16)).collect()
    assert len({r.component for r in found}) == 1 and len(found) == fps.count()
