"""A pack built from a store in one call."""

from pyspark.sql import functions as F

from mnemora.operators import packs


def test_a_pack_shows_what_its_labels_allow_and_each_source_once(spark):
    none = "array<struct<state:string,predicate:string,object_text:string>>"
    rows = [
        (1, "a", True, "Note", "active", "One", " fish one ", 0), (2, "b", True, "Note", "active", "Two", "hidden by its claim", 0), (3, "c", False, "Project", "active", "Three", "fish three", None),
        (4, "d", False, "Project", "deprecated", "Four", "fish four", 0), (5, "e", False, "Note", "active", "Five", "fish five", 3), (6, "f", True, "Goal", "active", "Six", "core and carried on", 0),
    ]
    documents = spark.createDataFrame(rows, "id long, path string, core boolean, type string, status string, title string, text string, rank int").withColumn("claims", F.lit(None).cast(none))
    claims = spark.createDataFrame([(20, 2, None)], "id long, document long, rank int")
    edges = spark.createDataFrame([(20, 900)], "claim_id long, evidence_id long")
    ranks = spark.createDataFrame([(900, 3)], "id long, rank int")
    said = [(100, "conversation", "s", 1, "user", "old", 0), (101, "conversation", "s", 2, "user", "new", 0), (102, "conversation", "other", 3, "user", "x", 0), (103, "artifact", "s", 4, "user", "x", 0), (104, "message", "s", 5, "user", "secret", 3)]
    captures = spark.createDataFrame(said, "id long, kind string, session string, at long, title string, text string, rank int")
    captures = captures.select("id", "kind", F.struct("session", F.lit(None).cast("string").alias("workspace"), F.lit(None).cast("map<string,string>").alias("metadata")).alias("source"), F.timestamp_micros("at").alias("captured_at"), "title", "text", "rank")

    def ids(**more):
        out = packs.build_pack(documents, claims, edges, ranks, captures, more.pop("query", "fish"), "personal", session="s", **more).orderBy("layer", "pos").collect()
        return {n: [r.source_id for r in out if r.layer == n] for n in ("core", "continuity", "relevant")}, out

    got, out = ids()
    assert got == {"core": [1, 6], "continuity": [101, 100, 3], "relevant": [4]}
    assert [r.snippet for r in out if r.source_id == 1] == ["fish one"] and not any(r.truncated for r in out)
    assert ids(query=" ")[0]["relevant"] == []
    small, cut = ids(budgets={"total": 12, "core": 9, "continuity": 9, "relevant": 9})
    assert small == {"core": [1], "continuity": [101], "relevant": []} and [r.truncated for r in cut] == [True, True]
