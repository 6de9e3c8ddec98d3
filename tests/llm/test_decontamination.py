import re

import pytest

from mnemora.llm.decontamination import clean_documents, contained_items

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def shingles(text, width=5):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, items):
    out = []
    for item_id, text in items:
        n = len(WORD.findall((text or "").lower()))
        width = min(5, n)
        own = shingles(text, width) if width else set()
        for doc_id, t in docs if own else []:
            shared = len(own & shingles(t, width))
            if shared >= 0.8 * len(own) - 1e-9:
                out.append((doc_id, item_id, shared, len(own)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [2000, 32 << 20])
def test_matches_brute_force(spark, block_bytes):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    long = docs[7][1] or ""
    for k, (_, t) in enumerate(items[:20]):
        words = t.split()
        docs.append((9000 + k, f"{long * (k % 3)} {' '.join(words[: len(words) * (100 - k) // 100])}. {long}"))
        docs.append((9100 + k, t.upper().replace(" ", " \n-")))
        docs.append((9200 + k, " ".join(words[::2])))
    docs += [(None, items[0][1]), (9999, None), (9998, "")]
    items += [(900, None), (901, ""), (902, "zweiwortig Fall"), (903, items[0][1]), (None, items[1][1])]
    docs.append((9997, "x Zweiwortig, fall y"))
    d = spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id long, text string, n_item double").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert found(contained_items(d, i, block_bytes=block_bytes)) == brute(docs, items)
    bad = {str(x[0]) for x in brute(docs, items)}
    kept = clean_documents(d, i, block_bytes=block_bytes)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x, _ in docs if str(x) not in bad)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained_items(d, i.limit(0)).count() == 0 and contained_items(d.limit(0), i).count() == 0
    assert clean_documents(d, i.limit(0)).count() == 1 and clean_documents(d, i).count() == 0


def test_items_with_a_common_opening_are_not_candidates_of_each_document():
    import time

    from mnemora.llm.decontamination import CONTAINMENT, SHINGLE, Items

    opening = " ".join(f"open{i}" for i in range(12))
    items = [f"{opening} " + " ".join(f"w{i}x{k}" for k in range(8)) for i in range(4000)]
    index = Items(list(range(4000)), [t.encode() for t in items], CONTAINMENT, SHINGLE)
    texts = [(" ".join(f"d{j}y{k}" for k in range(200)) + " " + (items[j] if j % 4 == 0 else opening)).encode() for j in range(40)]
    began = time.time()
    got = index.matches(texts)
    assert time.time() - began < 2
    assert [(t, i) for t, i, *_ in got] == [(j, j) for j in range(0, 40, 4)]
