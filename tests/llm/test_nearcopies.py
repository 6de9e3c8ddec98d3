import random
import re
import time

import numpy as np
import pytest

from mnemora.llm.nearcopies import keep_one_copy, near_copies, shingles_of, similarity, small_links, verified_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(rows, least=0.8):
    """The first row of each group under all pairs of the least similarity, by brute force."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for own in by.values():
        for i in own:
            for j in own:
                if i < j and find(i) != find(j) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [rows[i] for i in range(len(rows)) if find(i) == i]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("part_bytes", [20_000, 24 << 20])
def test_edited_copies(spark, part_bytes):
    rng = random.Random(4)
    rows = []
    for d in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 200, 900]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(4)):
            rows.append((len(rows), edited(rng, words, rng.randrange(len(words) // 40 + 1))))
    hot = [f"h{rng.randrange(3000)}" for _ in range(150)]
    rows += [(1000 + i, edited(rng, hot, rng.randrange(3))) for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "One two"), (2004, "one  two"), (None, rows[0][1]), (None, "only here"), (2005, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id) for r in near_copies(df, part_bytes=part_bytes).collect()}
    assert got == {d for d, _ in groups(rows)}


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = keep_one_copy(docs)
    assert out.columns == docs.columns
    want = groups(rows)
    assert len(want) < len(rows) and sorted(map(tuple, out.select("doc_id", "text").collect())) == sorted(want)


def test_links_join_the_same_rows():
    rng = np.random.default_rng(0)
    for n in (2, 9, 64, 200):
        base = rng.integers(0, 1 << 63, (4, 60), dtype=np.uint64)
        sets = []
        for _ in range(n):
            x = base[rng.integers(4)].copy()
            x[rng.integers(60, size=rng.integers(0, 9))] = rng.integers(1 << 63, dtype=np.uint64)
            sets.append(np.unique(x))
        fps = np.zeros(n, dtype=np.uint64)
        want = {(i, j) for i in range(n) for j in range(i) if len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 0.8 * len(set(sets[i].tolist()) | set(sets[j].tolist()))}

        def parts(pairs):
            root = list(range(n))
            for _ in range(n):
                for i, j in pairs:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        assert parts(verified_links(fps, sets, 22, 0.8)) == parts(want)
        if n <= 64:
            assert [parts(x) for x in small_links([fps, fps[:2]], [sets, sets[:2]], 22, 0.8)][0] == parts(want)


def test_shingles_match_sets():
    texts = ["a b c d e f a b c d e", "A b\tc", "a b c", "", "x", "é É e f g h"]
    out = [None] * len(texts)
    for a, b, h, count in shingles_of([t.encode() for t in texts]):
        for i, own in enumerate(np.split(h, np.cumsum(count)[:-1])):
            out[a + i] = np.unique(own)
    assert [len(x) for x in out] == [len(shingles(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            a, b = shingles(texts[i]), shingles(texts[j])
            assert similarity(out[i], out[j]) == pytest.approx(len(a & b) / len(a | b))


def test_edges(spark):
    schema = "doc_id long, text string, __id int, __hash string, __nth int, size long, node int"
    rows = [(1, "a", 7, "q", 1, 2, 3), (1, "a", 7, "q", 1, 2, 3), (None, None, None, None, None, None, None), (None, None, None, None, None, None, None), (2, "", 1, "r", 5, 0, 0)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, keep_one_copy(df).collect())) == [rows[0], rows[4]]
    assert keep_one_copy(df.limit(0)).count() == 0


def test_many_texts_of_the_same_few_words(spark):
    """100,000 texts that differ in white space only are one node."""
    gap = "concat(repeat(' ', cast(id % 300 as int) + 1), repeat('\\n', cast(id div 300 as int)))"
    rows = spark.range(100_000).selectExpr("id as doc_id", f"concat('Page', {gap}, '1') as text")
    assert rows.select("text").distinct().count() == 100_000
    began = time.time()
    assert [r.doc_id for r in keep_one_copy(rows).select("doc_id").collect()] == [0]
    assert time.time() - began < 40


def test_parts_are_bounded_by_rows(spark, monkeypatch):
    """Many near, not equal, texts under one key are dealt into pairs of parts and stay one group."""
    from mnemora.llm import nearcopies

    monkeypatch.setattr(nearcopies, "PART_ROWS", 40)
    common = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{common} end{i}") for i in range(130)]
    assert keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1
