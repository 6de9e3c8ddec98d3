"""Current state from an ordered event log, by partial aggregation: `max_by` keeps one row a key and task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.labels import highest
from mnemora.operators.ordered import with_previous

# The payload state that each event leaves.
STATES = {"payload.evicted": "evicted", "payload.missing-observed": "missing", "payload.restored": "present", "payload.redacted": "redacted"}

CHAIN_ROWS = 1 << 19


def effective_state(log: DataFrame) -> DataFrame:
    """(target, state, state_seq, n_representations, retention_seq, last_seq): each target's log(target, seq, kind) folded in
    the order of seq. state is `present` until an event says otherwise; the wall clock never counts."""
    pairs = [x for k, v in STATES.items() for x in (F.lit(k), F.lit(v))]
    moved = F.col("kind").isin(*STATES)
    return log.groupBy("target").agg(
        F.coalesce(F.max_by(F.element_at(F.create_map(*pairs), F.col("kind")), F.when(moved, F.col("seq"))), F.lit("present")).alias("state"),
        F.max(F.when(moved, F.col("seq"))).alias("state_seq"),
        F.count_if(F.col("kind") == "representation.added").alias("n_representations"),
        F.max(F.when(F.col("kind") == "retention.changed", F.col("seq"))).alias("retention_seq"),
        F.max("seq").alias("last_seq"),
    )


def effective_rank(captures: DataFrame, log: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """(id, rank): the highest label of captures(id, rank), of every event(target, rank) on it, and of objects(id, rank) it addresses."""
    parts = captures.select("id", "rank").unionByName(log.select(F.col("target").alias("id"), "rank").join(captures.select("id").distinct(), "id", "left_semi"))
    if objects is not None:
        parts = parts.unionByName(objects.select("id", "rank"))
    return parts.groupBy("id").agg(highest(F.col("rank")).alias("rank"))


def chain_faults(log: DataFrame) -> DataFrame:
    """(seq, fault) of a log(seq, id, prev_id) that is not one gap-free chain: equal sequences or ids, a gap, or a previous_event that
    is not the id of the row before. Joins, no global sort: rows are dealt by number into parts of about CHAIN_ROWS rows, as narrow rows
    compress so well that parts cut by bytes would hold too many for one task."""
    parts = max(1, -(-log.count() // CHAIN_ROWS))
    whole = log.select("seq", "id", "prev_id")
    log = whole.repartition(parts, "seq")
    twice = log.groupBy("seq").count().where("count > 1").select("seq", F.lit("repeated sequence").alias("fault"))
    same = whole.select("id", "seq").repartition(parts, "id").groupBy("id").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).where("n > 1").select("seq", F.lit("repeated id").alias("fault"))
    prior = whole.select((F.col("seq") + 1).alias("seq"), F.col("id").alias("before")).repartition(parts, "seq").distinct()
    linked = log.join(prior, "seq", "left")
    gap = linked.where((F.col("seq") != 1) & F.col("before").isNull()).select("seq", F.lit("gap").alias("fault"))
    loose = linked.where(~F.col("before").eqNullSafe(F.col("prev_id")) & ((F.col("seq") == 1) | F.col("before").isNotNull())).select("seq", F.lit("broken link").alias("fault"))
    return twice.unionByName(same).unionByName(gap).unionByName(loose)


def durable_sequence(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("durable_sequence"))


def candidate_steps(log: DataFrame) -> DataFrame:
    """log(target, seq, kind) of created, promoted, rejected and reopened with `before`, the kind before, and `legal`: ends come from
    pending, a reopening from a promotion, a creation from nothing."""
    steps = with_previous(log.where(F.col("kind").isin("created", "promoted", "rejected", "reopened")), ["target"], "seq", "kind", "before")
    pending = F.col("before").isNull() | F.col("before").isin("created", "reopened")
    legal = F.when(F.col("kind") == "reopened", F.coalesce(F.col("before") == "promoted", F.lit(False))).when(F.col("kind") == "created", F.col("before").isNull()).otherwise(pending)
    return steps.withColumn("legal", legal)


def candidate_states(log: DataFrame) -> DataFrame:
    """(target, status, n_illegal, last_seq): pending, promoted or rejected by the last step; `invalid` where a step is illegal or the
    candidate was not created exactly once."""
    folded = candidate_steps(log).groupBy("target").agg(
        F.max_by("kind", "seq").alias("kind"), F.count_if(~F.col("legal")).alias("n_illegal"), F.count_if(F.col("kind") == "created").alias("n_created"), F.max("seq").alias("last_seq")
    )
    status = F.when((F.col("n_illegal") > 0) | (F.col("n_created") != 1), "invalid").when(F.col("kind").isin("promoted", "rejected"), F.col("kind")).otherwise("pending")
    return folded.select("target", status.alias("status"), "n_illegal", "last_seq")


def active_terminals(log: DataFrame) -> DataFrame:
    """The ends (promoted, rejected) of each target after its last reopening."""
    ends = log.where(F.col("kind").isin("promoted", "rejected"))
    reopened = log.where(F.col("kind") == "reopened").groupBy("target").agg(F.max("seq").alias("__since"))
    return ends.join(reopened, "target", "left").where(F.col("seq") > F.coalesce("__since", F.lit(0))).drop("__since")


def phase_faults(log: DataFrame) -> DataFrame:
    """(target, prepared, committed, aborted, faulty) of transactions log(target, kind): exactly one prepared and one end each."""
    counts = log.groupBy("target").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("prepared", "committed", "aborted")])
    return counts.withColumn("faulty", (F.col("prepared") != 1) | (F.col("committed") + F.col("aborted") != 1))


def rank_before(log: DataFrame, span: int = 1 << 16) -> DataFrame:
    """log(target, seq, rank) with floor_rank: the highest rank of the target's earlier events, null for its first."""
    from pyspark.sql import Window as W

    cut = log.withColumn("__span", F.floor(F.col("seq") / span))
    own = F.max("rank").over(W.partitionBy("target", "__span").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    tops = cut.groupBy("target", "__span").agg(F.max("rank").alias("__top"))
    tops = tops.select("target", "__span", F.max("__top").over(W.partitionBy("target").orderBy("__span").rowsBetween(W.unboundedPreceding, -1)).alias("__handed"))
    inner = cut.withColumn("__own", own)
    return inner.join(tops, ["target", "__span"], "left").withColumn("floor_rank", F.greatest("__own", "__handed")).drop("__span", "__own", "__handed")


def paired_in_order(left: DataFrame, right: DataFrame, span: int = 1 << 16) -> DataFrame:
    """(target, n, left_seq, right_seq): the n-th row of left(target, seq) beside the n-th of right, null where one is missing."""
    from mnemora.operators.ordered import with_sum_before

    def numbered(df: DataFrame, name: str) -> DataFrame:
        one = df.select("target", "seq").withColumn("__one", F.lit(1).cast("long"))
        return with_sum_before(one, ["target"], "seq", "__one", "n", span).select("target", (F.col("n") + 1).alias("n"), F.col("seq").alias(name))

    return numbered(left, "left_seq").join(numbered(right, "right_seq"), ["target", "n"], "full_outer")


def verified_events(log: DataFrame, target=None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Events of log(seq, id, prev_id, target, kind) by (seq, id), of one target and some kinds where given. The whole chain is checked
    first: a filter never hides a fault elsewhere."""
    faults = chain_faults(log).limit(5).collect()
    if faults:
        raise ValueError(f"the event chain is broken: {[tuple(f) for f in faults]}")
    rows = log if target is None else log.where(F.col("target") == target)
    return (rows.where(F.col("kind").isin(*kinds)) if kinds else rows).orderBy("seq", "id")


def one_record(records: DataFrame, id_: str) -> DataFrame:
    """The record of an id, no row or one; two files of one id are an error."""
    found = records.where(F.col("id") == id_)
    if len(found.select("id").limit(2).collect()) > 1:
        raise ValueError(f"id {id_} has more than one record")
    return found


def unrestored(transactions: DataFrame, evictions: DataFrame, restores: DataFrame) -> DataFrame:
    """(target, n, problem) of aborted transactions(target, kind, seq): between its beginning and its end, each of evictions(target, seq, item, rank) must be followed
    by a restore of the same item, in the same order, and not labelled below what it had."""
    ends = transactions.groupBy("target").agg(*[F.max(F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in ("prepared", "committed", "aborted")]).where("aborted is not null and committed is null")

    def inside(df: DataFrame) -> DataFrame:
        return df.join(ends.select("target", "prepared", "aborted"), "target").where((F.col("seq") > F.col("prepared")) & (F.col("seq") < F.col("aborted"))).select("target", "seq", "item", "rank")

    out, back = inside(evictions), inside(restores)
    pairs = paired_in_order(out.select("target", "seq"), back.select("target", "seq"))
    a, b = (x.select("target", F.col("seq").alias(f"{n}_seq"), F.col("item").alias(f"{n}_item"), F.col("rank").alias(f"{n}_rank")) for x, n in ((out, "left"), (back, "right")))
    both = pairs.join(a, ["target", "left_seq"], "left").join(b, ["target", "right_seq"], "left")
    problem = (
        F.when(F.col("right_seq").isNull(), "not restored").when(F.col("left_seq").isNull(), "restored without eviction").when(~F.col("left_item").eqNullSafe(F.col("right_item")), "restored out of order")
        .when(F.col("right_seq") < F.col("left_seq"), "restored before eviction").when(F.col("right_rank") < F.col("left_rank"), "labelled lower")
    )
    return both.select("target", "n", problem.alias("problem")).where("problem is not null")
