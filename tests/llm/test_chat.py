import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm import queries
from mnemora.llm.chat import PROBE, as_events, digests, format_conversations, parse, render

SF = "/root/testdata/sf0.001"
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text("\\[]<>/sINST abc\n", max_size=40))))
def test_round_trip(turns):
    assert parse("".join(render(r, t)[0] for r, t in turns)) == turns


def test_query_reads_back_every_conversation(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = {-7: [(0, "user", PROBE), (1, "assistant", PROBE)]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op8_chat_formatting(spark, SF).collect()}
    assert got.keys() == by.keys()
    for k, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for _, a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(render(a, t)[0]) for _, a, t in turns)


def test_fold_of_events(spark):
    rows = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", "Wr"), (1, 1, 3, "delta", None, "ong"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "Ri"), (1, 1, 6, "delta", None, "ght"), (1, 0, 7, "edit", None, "hello"), (1, 2, 8, "message", "user", "x"), (1, 2, 9, "delete", None, None),
        (2, 0, 1, None, None, None), (2, 0, 1, None, "user", "a"), (2, 0, 1, None, "user", "a"), (None, None, None, "delta", "assistant", "<s>"),
    ]
    segments = format_conversations(spark.createDataFrame([(*r, "x") for r in rows], EVENTS).repartition(4))
    out = {}
    for r in segments.collect():
        out.setdefault(r.conv_id, []).extend(parse(r.formatted))
    assert out == {1: [("user", "hello"), ("assistant", "Right")], 2: [("", ""), ("user", "a"), ("user", "a")], None: [("assistant", "<s>")]}
    d = {r.conv_id: r for r in digests(segments).collect()}
    assert (d[1].loss_chars, d[1].loss_sha256, d[2].loss_chars) == (5, sha("Right"), 0)
    assert digests(format_conversations(spark.createDataFrame([], EVENTS))).count() == 0


def test_streamed_rows_fold_back(spark):
    rows = [(1, 0, "user", "ab"), (1, 0, "user", "ab"), (1, 0, "assistant", "a"), (1, 1, "assistant", None), (1, 1, "assistant", ""), (1, None, None, "\U0001f600x"), (None, 3, "user", "[x]")]
    log = as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "delta", "regenerate"}
    out = {}
    for r in format_conversations(log).collect():
        out.setdefault(r.conv_id, []).extend(parse(r.formatted))
    assert out == {1: [("", "\U0001f600x"), ("assistant", "a"), ("user", "ab"), ("user", "ab"), ("assistant", ""), ("assistant", "")], None: [("user", "[x]")]}
