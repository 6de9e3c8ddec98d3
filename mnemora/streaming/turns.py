"""Continuous ingest of agent turns: once by external id, conflicts told apart, only completed turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemora.functions.labels import LABELS
from mnemora.functions.records import canonical_json
from mnemora.functions.text import instant, turn_external_id
from mnemora.operators.graph import first_by_key

TURN = "external_id string, digest string, host string, session_id string, turn_id string, user_text string, assistant_text string"


# Hosts, fields and limits of a turn request.
HOSTS = ("opencode", "hermes")
FIELDS = ("host", "session_id", "turn_id", "workspace", "user_text", "assistant_text", "captured_at", "model", "platform", "sensitivity")
ID_CHARS, TEXT_CHARS, LABEL_CHARS, WORKSPACE_CHARS, TIME_CHARS = 256, 200_000, 256, 4096, 128


def request_error(request: Column) -> Column:
    """What is wrong first with a turn request, a JSON text; null for a good one. Fields are judged in the order of FIELDS."""
    v = F.try_parse_json(request)
    of = {n: F.try_variant_get(v, f"$.{n}", "string") for n in FIELDS}
    text = {n: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.lit(False)) for n in FIELDS}
    null = {n: of[n].isNull() & ~text[n] & (F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("VOID")) == "VOID") for n in FIELDS}

    def good(n: str, most: int, bad: str, trimmed: bool = False) -> Column:
        size = F.length(F.trim(of[n]) if trimmed else of[n])
        return text[n] & ~of[n].rlike(bad) & of[n].rlike(r"\S") & (size <= most)

    control, in_texts = r"[\x00-\x1f\x7f]", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
    rules = {
        "host": text["host"] & of["host"].isin(*HOSTS),
        **{n: good(n, ID_CHARS, control) for n in ("session_id", "turn_id")},
        "workspace": null["workspace"] | good("workspace", WORKSPACE_CHARS, control, trimmed=True),
        **{n: good(n, TEXT_CHARS, in_texts) for n in ("user_text", "assistant_text")},
        "captured_at": text["captured_at"] & (F.length(of["captured_at"]) <= TIME_CHARS) & instant(of["captured_at"]).isNotNull(),
        **{n: null[n] | good(n, LABEL_CHARS, control) for n in ("model", "platform")},
        "sensitivity": null["sensitivity"] | (text["sensitivity"] & of["sensitivity"].isin(*LABELS)),
    }
    unknown = F.size(F.array_except(F.json_object_keys(request), F.array(*[F.lit(n) for n in FIELDS]))) > 0
    out = F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "invalid turn request").when(unknown, "unknown turn field")
    for n, ok in rules.items():
        out = out.when(~F.coalesce(ok, F.lit(False)), f"invalid turn {n}")
    return out


def with_identity(turns: DataFrame) -> DataFrame:
    """turns(host, session_id, turn_id, user_text, assistant_text) with external_id and the digest of their content: canonical JSON, in which
    a null is written, so that a missing text is not an empty one."""
    said = canonical_json(F.to_json(F.struct("host", "session_id", "turn_id", "user_text", "assistant_text"), {"ignoreNullFields": "false"}))
    return turns.withColumn("external_id", turn_external_id(F.col("host"), F.col("session_id"), F.col("turn_id"))).withColumn("digest", F.sha2(said.cast("binary"), 256))


PARTS = 64


def _part(external_id: Column) -> Column:
    return F.pmod(F.xxhash64(external_id), F.lit(PARTS)).cast("int")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def store_batch(store: str, batch: DataFrame, number: int) -> None:
    """Writes what is new and what conflicts, each in a folder of this batch: a repeated batch overwrites itself, so each turn is stored once.

    The store is laid out in PARTS parts by a hash of the external id; a batch reads only the parts that it touches. A
    store that is there but cannot be read is an error, never an empty one.
    """
    spark = batch.sparkSession
    fresh = with_identity(batch).select(*[c.split()[0] for c in TURN.split(", ")]).withColumn("part", _part(F.col("external_id")))
    schema = f"{TURN}, batch long, part int"
    if _exists(spark, f"{store}/new"):
        touched = [r.part for r in fresh.select("part").distinct().collect()]  # at most PARTS numbers
        held = spark.read.schema(schema).parquet(f"{store}/new").where((F.col("batch") != number) & F.col("part").isin(touched))
    else:
        held = spark.createDataFrame([], schema)
    known = held.select("external_id", "digest", "part").withColumn("__order", F.lit(-1).cast("long"))
    both = known.unionByName(fresh.withColumn("__order", F.monotonically_increasing_id()), allowMissingColumns=True)
    judged = first_by_key(both, order="__order").where("__order >= 0").drop("__order")
    for outcome in ("new", "conflict"):
        judged.where(F.col("outcome") == outcome).drop("outcome").write.mode("overwrite").partitionBy("part").parquet(f"{store}/{outcome}/batch={number}")


def ingest(turns: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Starts the ingest of a stream of turns into the folder `store`, over what there is; `checkpoint` holds its progress."""
    return turns.writeStream.foreachBatch(lambda batch, number: store_batch(store, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judged_turns(turns: DataFrame) -> DataFrame:
    """The stream of turns with `outcome`: `new` for the first of an external id, `replay` for an equal later one, else `conflict`. State is the digest
    of each external id, keyed and kept by Spark, so a batch reads and writes the ids of its own turns alone; of turns that arrive in one
    batch the first is the least by digest."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("digest")  # the turns of one external id in one batch
        outcomes = []
        for digest in rows["digest"]:
            outcomes.append("new" if held is None else "replay" if digest == held else "conflict")
            held = held or digest
        state.update((held,))
        yield rows.assign(outcome=outcomes)

    named = with_identity(turns).select(*[c.split()[0] for c in TURN.split(", ")])
    return named.groupBy("external_id").applyInPandasWithState(step, f"{TURN}, outcome string", "digest string", "append", GroupStateTimeout.NoTimeout)


OUT = "session_id string, turn_id string, user_text string, assistant_text string"
STATE = "phase string, user_text string, assistant_text string"


def spark_seconds(text: str) -> float:
    """Seconds of a length of time such as \"7 days\"."""
    return pd.Timedelta(text).total_seconds()


def completed_turns(events: DataFrame, keep: str | None = None) -> DataFrame:
    """(session_id, turn_id, user_text, assistant_text), once for each turn of events(session_id, turn_id, event, user_text, assistant_text)
    that ends well: `candidate` holds its texts, `completed` emits them, `failed` and `interrupted` end it without. State is
    one small row a turn; a finished turn keeps only its phase, and that for `keep` (such as "7 days") of processing time after its last event, or for ever."""
    wait = None if keep is None else int(spark_seconds(keep) * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        phase, user, said = state.get if state.exists else ("open", None, None)
        out = []
        for batch in batches:
            for event, u, a in zip(batch["event"], batch["user_text"], batch["assistant_text"]):
                if phase == "terminal":
                    continue
                if event == "candidate" and phase == "open":
                    phase, user, said = "candidate", u, a
                elif event == "completed" and phase == "candidate":
                    out.append((*key, user or "", said or ""))
                    phase, user, said = "terminal", None, None
                elif event in ("failed", "interrupted"):
                    phase, user, said = "terminal", None, None
        state.update((phase, user, said))
        if wait is not None:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "user_text", "assistant_text"])

    return events.groupBy("session_id", "turn_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout)
