import zlib

import numpy as np
import pytest

from mnemora.llm import queries
from mnemora.llm.quality import DIM, FEATURES, VOCABULARY, fit, good_documents, index_vectors, pooled, quality_report, word_vectors

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op4_quality_classifier(spark, SF).toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    got = rows.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    got = got[got.held_out]
    assert (got.predicted == got.quality).mean() > 0.98
    assert (got.predicted[got.quality == 0] == 0).mean() > 0.9
    assert (got.predicted[got.quality == 1] == 1).mean() > 0.99


@pytest.mark.parametrize("vocabulary, texts", [(VOCABULARY, ["a b c ### d", "", "b b", None]), (256, [" ".join(f"w{(i * k) % 1999}" for i in range(300)) for k in range(1, 9)])])
def test_word_vectors_match_a_plain_loop(spark, vocabulary, texts):
    """Also with many more words than buckets."""
    from mnemora.llm.quality import buckets_of

    place, sign = index_vectors(vocabulary)
    total, seen = np.zeros((vocabulary, DIM)), np.zeros(vocabulary)
    for t in texts:
        bucket = [x for _, _, bs, _ in buckets_of([(t or "").encode()], vocabulary) for x in bs.tolist()]
        for i, own in enumerate(bucket):
            seen[own] += 1
            for j in range(max(0, i - 2), min(len(bucket), i + 3)):
                if i != j:
                    np.add.at(total[own], place[bucket[j]], sign[bucket[j]])
    for t in range(2):
        total[np.arange(vocabulary), place[:, t]] += sign[:, t] * np.maximum(seen, 1) * 4
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    total -= (seen[:, None] * total).sum(axis=0) / seen.sum()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.allclose(word_vectors(df, vocabulary), total, atol=1e-5)


def plain_scores(docs, labels, sample=20_000):
    """Scores of all documents by plain loops over their words, with a fit on the same labelled rows."""
    from mnemora.llm.quality import buckets_of

    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    words = {d: [x for _, _, bs, _ in buckets_of([t]) for x in bs.tolist()] for d, t in rows}
    place, sign = index_vectors()
    total, seen = np.zeros((VOCABULARY, DIM)), np.zeros(VOCABULARY)
    for own in words.values():
        for i, b in enumerate(own):
            seen[b] += 1
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if i != j:
                    for t in range(2):
                        total[b, place[own[j], t]] += sign[own[j], t]
    for b in range(VOCABULARY):
        for t in range(2):
            total[b, place[b, t]] += sign[b, t] * max(seen[b], 1) * 4
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    total -= (seen[:, None] * total).sum(axis=0) / seen.sum()

    def features(own):
        if not own:
            return np.zeros(FEATURES)
        mean = sum(total[b] for b in own) / len(own)
        return np.concatenate([mean, [np.sqrt(sum(mean**2)), sum(a == b for a, b in zip(own, own[1:])) / len(own), np.log(1 + len(own))]])

    x = {d: features(own) for d, own in words.items()}
    worst = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            worst[r.doc_id] = min(r.quality, worst.get(r.doc_id, 1))
    known = sorted(d for d in worst if d in x)
    assert len(known) <= sample
    net = fit(np.array([x[d] for d in known]), np.array([float(worst[d]) for d in known]))
    out = {}
    for d, own in x.items():
        hidden = np.tanh([sum((own - net.mean) / net.scale * net.a[:, h]) + net.b[h] for h in range(len(net.b))])
        out[d] = 1 / (1 + np.exp(-(sum(hidden * net.c) + net.d) / net.temperature))
    return out


def test_query_matches_plain_loops(spark):
    small = "/root/testdata/sf0.001"
    want = plain_scores(*(spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels")))
    got = {r.doc_id: r for r in queries.op4_quality_classifier(spark, small).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[d].score - want[d]) for d in want) < 2e-3
    assert all(got[d].predicted == (want[d] >= 0.5) for d in want if abs(want[d] - 0.5) > 2e-3)


def test_repeated_labelled_rows_give_one_model(spark):
    """More rows of labelled doc_ids than twice the sample: the fit takes one of each, whatever the order."""
    from mnemora.llm.quality import train

    rows = [(d, f"{'good words here' if d % 2 else '### $$ 1 1 1'} {d} {k}") for d in range(40) for k in range(9)]
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(40)], "doc_id long, quality int, toxic int")
    nets = [train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, sample=15)[1] for n, r in ((1, rows), (5, rows[::-1]))]
    assert np.allclose(nets[0].a, nets[1].a, atol=1e-3) and abs(nets[0].temperature - nets[1].temperature) < 0.05


def test_other_numbers_of_buckets_keep_the_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(2500)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    vectors = word_vectors(docs, 1 << 15)
    assert vectors.shape == (1 << 15, DIM)
    rows = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    ids = sorted(marks)
    x = pooled([(rows[d] or "").encode() for d in ids], vectors)
    y = np.array([float(marks[d]) for d in ids])
    half = len(ids) // 2
    assert ((fit(x[:half], y[:half]).scores(x[half:]) >= 0.5) == y[half:]).mean() > 0.95


def test_temperature_lowers_the_loss_of_an_overconfident_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, FEATURES))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    assert fit(x, y).temperature > 1


def test_edges(spark):
    schema = "doc_id long, text string, score string, y int"
    docs = spark.createDataFrame([(1, None, "q", 1), (None, "word", None, None), (2, "", None, 2), (2, "x " * 9, None, 2)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (None, 0, 1), (2, 0, 0), (2, 1, 0)], none.schema)
    for labels in (none, odd):
        out = quality_report(docs, labels).collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert good_documents(docs, none).columns == docs.columns and good_documents(docs, none).count() == 4
    assert quality_report(docs.limit(0), none).count() == 0
    assert pooled([b"", b"  "], np.ones((VOCABULARY, DIM), np.float32)).sum() == 0
    with pytest.raises(Exception):
        good_documents(docs.drop("text"), none).count()
