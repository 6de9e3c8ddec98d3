import numpy as np
import pytest

from mnemora.llm.embeddings import near_duplicates

ROWS = "vec_id long, embedding array<float>, label int, node string"


def brute(rows, least=0.93):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in ok}
    links = [(i, j) for a, i in enumerate(ok) for j in ok[:a] if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
        root[find(i)] = find(j)
    head = {}
    for i, r in enumerate(rows):
        head[find(i)] = min(head.get(find(i), r[0]), r[0])
    return {r[0]: (n[i], head[find(i)], head[find(i)] == r[0]) for i, r in enumerate(rows)}, len(links)


@pytest.mark.parametrize("cap", [20, 2048])
def test_matches_brute_force_on_the_table(spark, cap):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    base = rows[0][1]
    rows += [(9000 + i, base, rows[0][2]) for i in range(5)]
    rows += [(9100, None, 1), (9101, [0.0] * 64, 1), (9102, base, None), (9103, [float("nan")] * 64, 1), (9104, [None] * 64, 1), (9105, [1.0, 0.0], 1), (9106, [1.0, 0.1], 1), (9107, [], 1)]
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], ROWS), cap=cap).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)[0]


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 64))
    near = centres[rng.integers(0, 150, 1200)] + rng.normal(size=(1200, 64)) * 0.26
    rows = [(i, [float(x) for x in v.astype(np.float32)], i % 3) for i, v in enumerate(np.concatenate([centres, near]))]
    want, links = brute(rows)
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], ROWS)).collect()
    found = sum(r.n_links for r in got) / 2
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    print("links", links, "recall", found / links)
    assert links > 300 and found / links >= 0.9


def test_recall_in_a_hot_cluster(spark):
    """A third of the rows in one dense cluster of near, not equal, vectors."""
    rng = np.random.default_rng(6)
    hot = rng.normal(size=64) + rng.normal(size=(700, 64)) * 0.27
    rows = [(i, [float(x) for x in v.astype(np.float32)], 1) for i, v in enumerate(np.concatenate([hot, rng.normal(size=(1400, 64))]))]
    want, links = brute(rows)
    for cap in (300, 2048):
        got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], ROWS), cap=cap).collect()
        found = sum(r.n_links for r in got) / 2
        assert all(r.n_links <= want[r.vec_id][0] for r in got)
        print("links", links, "recall", found / links)
        assert links > 30000 and found / links >= 0.97


def test_recall_of_a_set_of_queries(spark):
    """Every vector against all rows of the largest table and copies at cosines about 0.93, by brute force; and with few and many pivots."""
    rng = np.random.default_rng(8)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    for i, (_, v, label) in enumerate(rows[:1500]):
        x = np.array(v) + rng.normal(size=len(v)) * np.linalg.norm(v) / len(v) ** 0.5 * rng.uniform(0.2, 0.42)
        rows.append((10**6 + i, [float(y) for y in x.astype(np.float32)], label))
    unit = np.array([r[1] for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    ids = np.array([r[0] for r in rows])
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    for pivots in (None, 32, 1024):
        got = {r.vec_id: r.n_links for r in near_duplicates(df, pivots=pivots).collect()}
        want = {int(ids[i]): int(((unit @ unit[i] >= 0.93) & (label == label[i])).sum()) - 1 for i in range(len(ids))}
        assert all(got[i] <= n for i, n in want.items())
        print("queries", len(want), "links", sum(want.values()), "pivots", pivots, "recall", sum(got[i] for i in want) / max(1, sum(want.values())))
        assert sum(want.values()) > 100 and sum(got[i] for i in want) >= 0.97 * sum(want.values())


@pytest.mark.parametrize("shared, chosen", [(0.7, 200), (0.5, 200), (0.97, 1)])
def test_vectors_with_a_common_direction(spark, shared, chosen):
    """Pivots tell vectors apart whose mean cosine is high; where nearly all of them are near each other, few pivots list them together."""
    from mnemora.llm.embeddings import _points

    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = np.sqrt(shared) * unit(rng.normal(size=64)) + np.sqrt(1 - shared) * unit(rng.normal(size=(900, 64)))
    noise = rng.normal(size=(600, 64)) * np.linalg.norm(x, axis=1).mean() / 8 * rng.uniform(0.2, 0.39, size=(600, 1))
    rows = [(i, [float(y) for y in v.astype(np.float32)], 1) for i, v in enumerate(np.concatenate([x, x[:600] + noise]))]
    assert len(_points([r[1] for r in rows], 256, 0.93)[1]) >= chosen
    want, links = brute(rows)
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], ROWS)).collect()
    found = sum(r.n_links for r in got) / 2
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    print("links", links, "recall", found / links)
    assert links > 300 and found / links >= (0.95 if shared < 0.9 else 1.0)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], ROWS)).count() == 0
