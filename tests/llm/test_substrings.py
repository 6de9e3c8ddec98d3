import hashlib
import re

import pytest

from mnemora.llm.substrings import remove_repeats, repeats_report, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=20):
    """Every window in order of (doc_id, text), each start judged on the input."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [20_000, 6 << 20])
def test_matches_brute_force(spark, block_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(9001, None), (9002, ""), (9003, "a b " * 50), (9004, rows[5][1]), (9005, "x\x0b" + rows[5][1].replace(" ", "\t ")), (9006, "é " * 20), (9007, "é " * 19)]
    out, added = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, block_bytes, 5_000)
    got = sorted((r.doc_id, *[r[a] for a in added]) for r in out.collect())
    assert got == brute(rows)


def test_hot_doc_ids(spark):
    """Most rows under one doc_id, or without one, fill many blocks; of equal texts one stays whole."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(7, text["a"])] * 60 + [(7, text["b"])] * 30 + [(None, text["c"])] * 60 + [(5, text["d"]), (6, text["d"]), (10**17, text["a"] + " x")]
    out, added = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 20, 2_000, 100)
    got = [(r.doc_id, r[added[1]]) for r in out.collect()]
    assert len(got) == len(rows)
    assert sorted(n for d, n in got if d == 7) == [0, 0] + [40] * 88 and sorted(n for d, n in got if d is None) == [0] + [40] * 59
    assert dict(x for x in got if x[0] not in (7, None)) == {5: 0, 6: 40, 10**17: 40}


def test_edges(spark):
    schema = "doc_id long, text string, lang string, __n_words string, bucket int, __id long, __tie string, __block string, __n_removed int"
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(*r, *[None] * (9 - len(r))) for r in [(2, long, "en", "q", 1, 2, "t", "b", 3), (1, "z " + long), (None, long), (3, "short  text\n"), (3, "short  text\n")]]
    df = spark.createDataFrame(rows, schema)
    out = {(r.doc_id, r.text) for r in without_repeats(df).collect()}
    assert out == {(None, long), (1, "z"), (2, ""), (3, "short  text\n")}
    assert without_repeats(df).columns == df.columns
    assert [tuple(r)[2:] for r in without_repeats(df).where("doc_id = 2").collect()] == [rows[0][2:]]
    assert repeats_report(df.limit(0)).count() == 0
    assert found(repeats_report(df.where("doc_id = 3")))[0][1:3] == (2, 0)
