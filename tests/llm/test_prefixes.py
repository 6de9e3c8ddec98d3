import hashlib
import random
import zlib

import pytest

from mnemora.llm import queries
from mnemora.llm.prefixes import prefix_trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, Key string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            own.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    own = {c: [(a, b) for *_, a, b in sorted(t, key=lambda t: (*t[:2], digest(*t[2:])))] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids, saved, leaves, out = {}, {}, {}, []
    for k in nodes:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k in sorted(nodes, key=len, reverse=True):
        saved[k] = saved.get(k, 0) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
        leaves[k] = leaves.get(k, 0) + (k not in kids)
        if k:
            saved[k[:-1]] = saved.get(k[:-1], 0) + saved[k]
            leaves[k[:-1]] = leaves.get(k[:-1], 0) + leaves[k]
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(k)))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_plain_loops(spark):
    got = queries.op11_prefix_trie(spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = brute([r.asDict() for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 40


@pytest.mark.parametrize("segment, block, fan", [(1, 1, 2), (2, 3, 2), (3, 8, 256)])
def test_split_conversations_match_plain_loops(spark, segment, block, fan):
    rng = random.Random(segment)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é😀", "", None]), 1, "x") for c in [*range(0, 30), *range(198, 210)] for t in range(rng.randrange(1, 9)) if c != 200]
    rows += [(7, t, "user", "same", 1, "x") for t in range(40)] + [(8, t, "user", "same", 1, "x") for t in range(40)] + [(0, 20 + t, "user", str(t % 2), 1, "x") for t in range(30)]
    rows += [(5, None, "user", "z", 1, "x"), (5, 2, "a", "b", 1, "x"), (5, 2, "a", "b", 1, "x"), (-3, 0, "a", "b", 1, "x"), (1000, 0, "a", "b", 1, "x"), (1001, 0, "a", "b", 1, "x")]
    df = spark.createDataFrame(rows + [(None, 0, "a", "b", 1, "x")], SCHEMA).repartition(5)
    rows = [r.asDict() for r in df.where("conv_id <> -3").collect()]
    got = prefix_trie(df.where("conv_id <> -3"), segment, block, fan)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_negative_ids_and_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(-3, 0, "a", "b", 1, "x"), (-103, 0, "a", "b", 1, "x"), (-100, 0, "a", "c", 1, "x")]
    got = {r.depth: r for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).where("n_convs > 1").collect()}
    assert got[0].n_convs == 3
