import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm.packing import best_two_fit, pack
from mnemora.llm.queries import tokenizer_path
from mnemora.llm.token_counts import token_counts
from mnemora.llm.tokens import Counter, IdEncoder, load, proven_whole

PATH = tokenizer_path()
FEW = {w: load(PATH).encode(w).ids[0] for w in ("the", "a")}
ODD = ["", "a", "Hello's WORLD 123", "<|endoftext|> x <|startoftext|>", "İstanbul ß ﬁ é é", "日本語 テスト", "a\x1cb\x1dc\x85d\xa0e f", "'S 'll don't", "$$$###!!! | |", "é ́x", "😀 👍🏽", "<| endoftext|>", "ǅ ẞ ² ½ ٣", "word " * 3000]


@pytest.fixture(scope="module")
def tools():
    return load(PATH), IdEncoder(PATH, proven_whole(PATH)), Counter(PATH, proven_whole(PATH))


def direct(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_proof_is_the_librarys(tools):
    whole = [*proven_whole(PATH)]
    assert 30_000 < len(whole) < 49_408
    for e in tools[0].encode_batch(whole[::17], add_special_tokens=False):
        assert len(e.ids) == 1


def test_odd_texts(tools):
    tokenizer, encoder, counter = tools
    assert ids_of(encoder, ODD) == [direct(tokenizer, t) for t in ODD]
    assert counter.count([t.encode() for t in ODD]).tolist() == [len(direct(tokenizer, t)) for t in ODD]


def ids_of(encoder, texts):
    out = []
    for a, b, ids, sizes in encoder.encode([t.encode() for t in texts]):
        assert a == len(out) and b - a == len(sizes)
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


@pytest.mark.parametrize("bounds", [{"entries": 64}, {"most_bytes": 300}, {"longest": 3}])
def test_small_memos_change_nothing(spark, bounds):
    """Memos that start anew, have no room for a batch, or keep no long runs."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + ODD
    encoder, counter = IdEncoder(PATH, FEW, **bounds), Counter(PATH, FEW, **bounds)
    want = [direct(load(PATH), t) for t in texts]
    for _ in range(2):
        assert ids_of(encoder, texts) == want
        assert counter.count([t.encode() for t in texts]).tolist() == [len(x) for x in want]


def test_equal_hashes_never_stand_for_other_runs(monkeypatch):
    from mnemora.llm import tokentable

    monkeypatch.setattr(tokentable, "token_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["ab cd ab ef", "cd xyz abc abc"]
    for _ in range(2):
        assert ids_of(IdEncoder(PATH, FEW), texts) == [direct(load(PATH), t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids_of(IdEncoder(PATH, FEW, entries=1024), [text]) == [direct(load(PATH), text)]
    counter = Counter(PATH, FEW, entries=1024)
    assert counter.count([text.encode()]).tolist() == [len(direct(load(PATH), text))]


def test_counts_match_the_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "again"), (3, "again")]
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows += [(r.doc_id + 1000, r.text) for r in more]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    key = lambda x: (str(x[0]), *x[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect()), key=key)
    want = [(d, len((t or "").encode()), n := len(direct(load(PATH), t)), n > 2048) for d, t in rows]
    assert got == sorted(want, key=key)
    assert token_counts(df.limit(0), PATH).count() == 0


def check_packing(rows, docs, limit):
    tokenizer = load(PATH)
    ids = {d: [*direct(tokenizer, t), 0] for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == [*range(len(own))] and len(own) == -(-len(ids[d]) // limit)
        for r in own:
            part = ids[d][r.start : r.start + r.length]
            assert r.start == r.piece * limit and r.length == min(limit, len(ids[d]) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        place = 0
        for r in own:
            assert r.offset == place
            place += r.length
        assert place <= limit
    return len(by_sequence), sum(map(len, ids.values()))


@pytest.mark.parametrize("limit,chunk", [(2048, 8192), (64, 50)])
def test_packing(spark, limit, chunk):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, rows_text(limit))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    n, total = check_packing(pack(df, PATH, limit, chunk).collect(), rows, limit)
    assert n <= 1.02 * total / limit + 2 + 8 * (chunk < 100)
    assert pack(df.limit(0), PATH).count() == 0


def rows_text(limit):
    return "the " * (2 * limit - 1)


def test_repeated_rows_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b")] * 5 + [(None, "c")] * 3, "doc_id long, text string")
    out = pack(df, PATH).collect()
    assert len(out) == 8 and len({r.sequence_id for r in out}) == 1
    place = 0
    for r in sorted(out, key=lambda r: r.offset):
        assert r.offset == place
        place += r.length
    assert place == 21


def plain_best_two_fit(lengths, limit):
    """The same rule by plain search: greedy by the longest that fits, then the smallest gives way to the two of the largest sum."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], limit
        while any(x <= gap for x in left):
            x = max(y for y in left if y <= gap)
            left.remove(x)
            own.append(x)
            gap -= x
        if gap and len(own) > 1:
            room = gap + own[-1]
            pairs = [(left[i] + left[j], -left[i]) for i in range(len(left)) for j in range(i + 1, len(left)) if left[i] + left[j] <= room]
            if pairs and max(pairs)[0] > own[-1]:
                total, small = max(pairs)
                left.append(own.pop())
                for x in (total + small, -small):
                    left.remove(x)
                    own.append(x)
                left.sort()
        bins.append(sorted(own))
    return bins


def test_best_two_fit_matches_a_plain_packer():
    rng = np.random.default_rng(1)
    for _ in range(60):
        x = rng.integers(1, 41, rng.integers(1, 60))
        bin_of, _ = best_two_fit(x, 40)
        assert [sorted(x[bin_of == b].tolist()) for b in range(bin_of.max() + 1)] == plain_best_two_fit(x.tolist(), 40)


def test_best_two_fit_swaps_the_smallest():
    lengths = np.array([60, 30, 25, 14])  # greedy: 60 + 30 leaves 10; 25 + 14 fill its gap of 40 better
    bin_of, offset = best_two_fit(lengths, 100)
    assert bin_of[0] == bin_of[2] == bin_of[3] == 0 and bin_of[1] == 1
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = rng.integers(1, 101, rng.integers(1, 300))
        bins, place = best_two_fit(x, 100)
        for b in range(bins.max() + 1):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(place[own])]
            assert place[own].tolist() == [0, *np.cumsum(x[own])[:-1]] and x[own].sum() <= 100
