import numpy as np

from mnemora.llm import queries
from mnemora.llm.toxicity import fit_chain, fit_linear, presence, toxicity_report, word_sets

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op6_toxicity(spark, SF).toPandas()
    got = rows.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    got = got[got.held_out]
    assert len(rows) == 10_000 and len(got) > 1000
    assert (got.predicted[got.toxic == 1] == 1).mean() > 0.85  # about 1 in 14 carries no mark of it at all
    assert (got.predicted[got.toxic == 0] == 0).mean() > 0.995
    junk = ((got.toxic == 1) & (got.quality == 0)).to_numpy()
    assert ((got.p_toxic_junk >= 0.5).to_numpy() == junk).mean() > 0.97


def test_query_matches_plain_loops(spark):
    """Selection of words, features and the chain by plain loops; the linear fits are the module's own."""
    import math
    import re
    import zlib

    small = "/root/testdata/sf0.001"
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()

    def features(text):
        words = set(token.findall((text or "").lower().encode()))
        return {("w", w) for w in words} | {("w", w[:n]) for w in words for n in (4, 5, 6, 7, 8) if len(w) > n}

    sets = {r.doc_id: features(r.text) for r in rows}
    marks = {}
    for r in spark.read.parquet(f"{small}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in sets:
            marks[r.doc_id] = [float(r.toxic == 1), float(r.toxic == 1 and r.quality == 1), float(r.toxic == 1 and r.quality != 1)]
    ids = sorted(marks)
    count = {}
    for d in ids:
        for f in sets[d]:
            count.setdefault(f, np.zeros(4))
            count[f] += [1, *marks[d]]
    totals = np.sum([marks[d] for d in ids], axis=0)
    picked = set()
    for c in range(3):
        yes, no = totals[c], len(ids) - totals[c]

        def z(f):
            a, b = count[f][1 + c] + 0.5, count[f][0] - count[f][1 + c] + 0.5
            odds = math.log(a / (yes + 1 - a)) - math.log(b / (no + 1 - b))
            return odds / math.sqrt(1 / a + 1 / b + 1 / (yes + 1 - a) + 1 / (no + 1 - b))

        # the operator breaks ties by hash: take its own hash for the order
        key = {f: int(next(iter(word_sets([f[1]]))).view(np.int64)[_whole(f[1])]) for f in count if count[f][0] >= 3}
        picked |= set(sorted(key, key=lambda f: (-round(z(f), 12), key[f]))[:512])
    order = sorted(picked, key=lambda f: key[f] % (1 << 64))
    x = {d: np.array([float(f in sets[d]) for f in order]) for d in sets}
    chain = fit_chain(np.array([x[d] for d in ids]).astype(np.uint8), np.array([marks[d] for d in ids]), np.arange(len(ids)) % 5, None)
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, small).collect()}
    assert got.keys() == x.keys()
    for d, own in x.items():
        for k, model in enumerate(chain.models):
            odds = max(-30, min(30, sum(own * model.weights) + model.intercept))
            assert abs(got[d][f"p_{('toxic', 'toxic_prose', 'toxic_junk')[k]}"] - 1 / (1 + math.exp(-odds))) < 1e-3
            own = np.append(own, odds / 4)


def _whole(word):
    """Where the hash of the whole word stands among its own and its beginnings'."""
    from mnemora.llm.textkernels import token_hashes

    data = np.frombuffer(word, dtype=np.uint8)
    own = token_hashes(data, np.array([0]), np.array([len(word)]))[0]
    return int(np.flatnonzero(next(iter(word_sets([word]))) == own)[0])


def test_presence_matches_sets():
    texts = [b"a b a ###", b"", b"b!"]
    sets = [set(s.tolist()) for s in word_sets(texts)]
    vocabulary = np.sort(np.array(sorted(set().union(*sets)), dtype=np.uint64))
    assert [{int(v) for v, x in zip(vocabulary, row) if x} for row in presence(texts, vocabulary)] == sets


def test_later_models_use_earlier_categories():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (800, 4)).astype(np.uint8)
    first = (x[:, 0] ^ (rng.random(800) < 0.1)).astype(float)
    marks = np.column_stack([first, x[:, 0]])
    chain = fit_chain(x, marks, np.arange(800) % 5, np.arange(4, dtype=np.uint64))
    assert len(chain.models[1].weights) == 5 and chain.models[1].weights[-1] > 0
    assert ((chain.probabilities(x)[:, 1] > 0.5) == x[:, 0]).all()
    assert fit_linear(x.astype(float), np.zeros(800)).log_odds(x.astype(float)).max() < -5


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "word", None), (2, "", None), (2, "x", None)], "doc_id long, text string, predicted string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (None, 0, 1), (2, 0, 1), (2, 1, 0), (5, 1, None)], none.schema)
    for labels in (none, odd):
        out = toxicity_report(docs, labels).collect()
        assert len(out) == 4 and all(0 <= r.p_toxic <= 1 for r in out)
    assert toxicity_report(docs.limit(0), none).count() == 0
