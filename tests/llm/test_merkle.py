import hashlib
import zlib

import pytest

from mnemora.llm import queries
from mnemora.llm.merkle import manifest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, Block int"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text))


def tree(nodes, fanout):
    """The root, and for each leaf its levels of (run, place)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, k in enumerate(at):
            paths[i].append((runs[k // fanout], k % fanout))
        nodes, at = [sha(r) for r in runs], [k // fanout for k in at]
    return nodes[0], paths


def brute(rows, fanout=16):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    kept = {s: sorted(by[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for s in names}
    trees = {s: tree([leaf(r, r.text) for r in kept[s]], fanout) for s in names}
    root, above = tree([trees[s][0] for s in names], fanout) if names else (None, [])
    out = []
    for s, up in zip(names, above):
        for r, path in zip(kept[s], trees[s][1]):
            path = path + up
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for run, k in path:
                node = sha([*run[:k], node, *run[k + 1 :]])
            proof = sha(x for run, k in path for i, x in enumerate(run) if i != k)
            out.append((r.doc_id, leaf(r, r.text), trees[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def test_query_against_plain_loops(spark):
    got = queries.op13_merkle_manifest(spark, SF)
    want = brute(spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[6] for r in want} == {True, False}


@pytest.mark.parametrize("fanout, levels", [(2, 2), (3, 1)])
def test_blocks_and_rounds_match_plain_loops(spark, fanout, levels):
    rows = [(i, f"Text {i}" if i % 7 else None, "en", ["hot", "b", None, ""][0 if i % 3 else i % 4], i, "x", i) for i in range(90)]
    rows += [(None, "A", None, "hot", None, "x", 1), (None, None, None, None, None, "x", 1), (5, "ÄB", "de", "hot", 2, "x", 1), (5, "ÄB", "de", "hot", 2, "x", 2), (7, "", "de", "one", 0, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in manifest(df, fanout, levels).collect()), key=str) == brute(df.collect(), fanout)


def test_any_change_breaks_the_proof_of_its_row_only(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en", "s", 5, "x", 0) for i in range(40)]
    got = {r.doc_id: r for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, r in got.items():
        assert r.verified == (not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0))
    assert len({r.root for r in got.values()}) == 1


def test_empty_and_single(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = manifest(spark.createDataFrame([(1, "x", "en", "s", 1, "", 0)], SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == hashlib.sha256(b"").hexdigest()
