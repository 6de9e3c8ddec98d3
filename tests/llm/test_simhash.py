import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from mnemora.llm.bitslice import linked_rows
from mnemora.llm.simhash import fingerprint, keep_one, links, near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = {d: plain_fingerprint(t) for d, t in rows}
    ids = sorted(fps)
    return fps, components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 2])


def test_fingerprint_matches_plain_loop():
    for text in ("", None, "One", "Two words", "É À ê A b C", "a b c " * 50, "x y z\x0bq", "Lorem " * 70000):
        if text is None or len(text) < 9999:
            assert fingerprint(text and text.encode()) == plain_fingerprint(text)
    long = ("Lorem ipsum dolor " * 20000).encode()
    assert fingerprint(long, at_once=100) == fingerprint(long)


def test_bitsliced_chains_match_all_pairs():
    rng = random.Random(1)
    for size in (1, 2, 3, 64, 65, 200, 700):
        seeds = [rng.getrandbits(64) for _ in range(max(1, size // 6))]
        fps = sorted({rng.choice(seeds) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for _ in range(size)})
        u, v = linked_rows(np.array(fps, dtype=np.uint64), np.array([0]), np.array([len(fps)]), 2)
        wanted = components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
        assert components(range(len(fps)), zip(u.tolist(), v.tolist())) == wanted


def test_links_keep_components_with_split_buckets(spark):
    rng = random.Random(2)
    base = rng.getrandbits(62)
    fps = {base ^ rng.getrandbits(9) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)}
    fps |= {x ^ 1 << rng.randrange(63) for x in list(fps)[:40]}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    wanted = components(sorted(fps), [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    for cap in (7, 4096):
        found = [(r.u, r.v) for r in links(df, 2, cap).collect()]
        assert components(sorted(fps), found) == wanted


def test_query_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(9001, None), (9000, ""), (9002, rows[3][1]), (9003, rows[3][1] + " tail"), (9004, "short")]
    fps, comp = brute(rows)
    from mnemora.llm import queries

    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    found = {r.doc_id: r for r in near_duplicates(more).collect()}
    assert {d: r.fp % (1 << 64) for d, r in found.items()} == fps
    assert {d: r.component_id for d, r in found.items()} == comp
    assert "op2_simhash_near_dedup" in queries.QUERIES


def test_keep_one_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (None, "a b c d e", None, None, None), (None, "q r s t", None, None, None), (None, "q r s t", None, None, None), (5, None, None, None, None), (6, "", "x", "y", 0)]
    out = keep_one(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "a b c d e"), ("5", None), ("None", "q r s t")]
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
