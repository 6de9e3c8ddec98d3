import zlib

import numpy as np
import pytest

import corpus_pipeline
from mnemora.llm.queries import tokenizer_path
from mnemora.llm.tokens import load

SF = "/root/testdata/sf0.001"
MORE = ["__id", "__hash", "__nth", "__score", "__tie", "__block", "__n_words", "__n_removed", "__kept_sha256", "row", "chunk", "score", "component", "node", "key"]


def test_stages_match_plain_loops(spark, tmp_path):
    from tests.llm.test_decontamination import brute as leaks
    from tests.llm.test_nearcopies import groups
    from tests.llm.test_quality import plain_scores
    from tests.llm.test_substrings import brute as repeats

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names, seen = docs.columns, {}
    score = plain_scores(docs, labels)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = ([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], docs)
        if name != "packing":
            assert docs.columns == names
    texts = {name: dict(rows) for name, (rows, _) in seen.items()}
    good = texts["near_duplicates"]
    assert good == {d: t for d, t in texts["quality"].items() if score[d] >= 0.5}
    assert 0.8 * len(texts["quality"]) < len(good) < len(texts["quality"])
    assert texts["repeated_passages"] == dict(groups(list(good.items())))
    wanted = {d: (n, gone) for d, n, gone, _ in repeats(list(texts["repeated_passages"].items()))}
    assert {d: len(t.split()) for d, t in texts["decontamination"].items()} == {d: n - gone for d, (n, gone) in wanted.items()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in leaks(list(texts["decontamination"].items()), items)}
    assert texts["packing"] == {d: t for d, t in texts["decontamination"].items() if d not in bad}
    ids = {d: [*load(tokenizer_path()).encode(t, add_special_tokens=False).ids, 0] for d, t in texts["packing"].items()}
    want = sorted((d, k, zlib.crc32(np.array(x[k * 2048 : k * 2048 + 2048], "<u4").tobytes())) for d, x in ids.items() for k in range(-(-len(x) // 2048)))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in seen["packing"][1].collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == len(want)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_edges_of_each_stage(spark, name, stage):
    """Nulls in any column, empty texts, repeated rows, ties, an empty table and columns of the operators' own names."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    good = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(12).collect()]
    odd = [(None, None, None, None, None), (None, "", None, None, 0), (7001, "", "en", "x", 0), (7002, " \n ", None, None, None), (7003, "one", None, None, None)]
    rows = good + odd + odd[:2] + good[:2]
    docs = spark.createDataFrame([(*r, *[f"{i}"] * len(MORE)) for i, r in enumerate(rows)], columns + "".join(f", `{c}` string" for c in MORE)).repartition(3)
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "packing":
        assert sorted({str(r.doc_id) for r in got}) == sorted({str(r[0]) for r in rows}) and len(got) >= len(rows)
        assert all(r.length > 0 and r.offset >= 0 for r in got)
    else:
        assert out.columns == docs.columns
        own = {int(r["__id"]): r for r in got}
        assert len(own) == len(got)
        assert all(all(r[c] == str(i) for c in MORE) and (r.doc_id, r.lang, r.source) == (rows[i][0], rows[i][2], rows[i][3]) for i, r in own.items())
        if name == "near_duplicates":
            assert len(got) < len(rows) and {r.doc_id for r in got} >= {7001}
        if name in ("repeated_passages",):
            assert len(got) == len(rows)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns
