"""Competing changes under compare-and-set, repair of interrupted transactions, and digests that depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.checkpoints import cut
from mnemora.operators.ordered import numbered, with_next

WIDTH = 1024


def accepted_changes(changes: DataFrame, start: DataFrame, span: int = 1 << 16) -> DataFrame:
    """changes(path, seq, before, after) with `accepted`: in the order of seq, a change counts if its `before` is what is in force at its
    path, which is then its `after`; start(path, digest) is in force first, and a path without a start accepts nothing.

    Each change points at the next one of its path whose `before` is its `after`, so what is accepted is one chain of pointers a path.
    It is followed by doubling: with each round pointers skip twice as many changes, and the accepted ones double, so no task folds a path.
    """
    point = lambda df, state, seq, kind, mark: df.select("path", state.alias("state"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), mark.cast("long").alias("mark"))
    seq, none = F.col("seq"), F.lit(None)
    both = point(changes, F.col("before"), seq, 0, seq).unionByName(point(changes, F.col("after"), seq, 1, none)).unionByName(point(start, F.col("digest"), F.lit(-1), 1, none))
    known = both.where("path is not null and state is not null")
    jumps = cut(with_next(known, ["path", "state"], ["seq", "kind"], "mark", "next", span).where("kind = 1 and next is not null").select("path", "seq", "next"))
    reached = cut(start.where("path is not null").select("path", F.lit(-1).cast("long").alias("seq")).distinct())
    while True:
        further = reached.join(jumps, ["path", "seq"]).select("path", F.col("next").alias("seq"))
        more = cut(reached.unionByName(further).distinct())
        if more.count() == reached.count():
            break
        reached = more
        on = jumps.select("path", F.col("seq").alias("next"), F.col("next").alias("over"))
        jumps = cut(jumps.join(on, ["path", "next"]).select("path", "seq", F.col("over").alias("next")))
    taken = reached.where("seq >= 0").withColumn("accepted", F.lit(True))
    return changes.join(taken, ["path", "seq"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def recovery(transactions: DataFrame, manifest: DataFrame, evidence: DataFrame, observed: DataFrame) -> DataFrame:
    """(transaction, verdict) of interrupted transactions(transaction, kind): `cleaned` where a committed one may lose what is left in its
    quarantine, `recovered` where a prepared one can be undone, else `unresolved`; an aborted one is at its end and left out.

    manifest(transaction, digest, size, evidence) has a row for each cited evidence(id, digest), observed(transaction, digest, found, size) a row
    for each file: in place where transaction is null, else in that transaction's quarantine; `found` is the digest of its bytes.
    """
    kinds = transactions.groupBy("transaction").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("prepared", "committed", "aborted")])
    one_way = (F.col("prepared") == 1) & (F.col("committed") <= 1) & (F.col("aborted") <= 1) & ~((F.col("committed") > 0) & (F.col("aborted") > 0))
    sizes = manifest.groupBy("transaction", "digest").agg(F.min("size").alias("size"), (F.min("size") == F.max("size")).alias("same"))
    cited = manifest.join(evidence.select(F.col("id").alias("evidence"), F.col("digest").alias("__held")), "evidence", "left")
    loose = cited.where(~F.coalesce(F.col("__held") == F.col("digest"), F.lit(False))).select("transaction")
    pairs = _pairs(sizes, observed)
    whole = lambda side: ~F.col(side) | F.coalesce(F.col(f"{side}_whole"), F.lit(False))
    gone = ~F.col("source") & ~F.col("quarantine")
    verdict = kinds.select("transaction", one_way.alias("ok"), (F.col("committed") > 0).alias("committed"), (F.col("aborted") > 0).alias("aborted"))
    judged = pairs.join(verdict.select("transaction", "committed"), "transaction")
    broken = judged.where(~(whole("source") & whole("quarantine")) | ~F.col("same") | (gone & ~F.col("committed"))).select("transaction")
    strange = observed.where("transaction is not null").join(sizes.select("transaction", "digest"), ["transaction", "digest"], "left_anti").select("transaction")
    bad = loose.unionByName(broken).unionByName(strange).distinct().withColumn("bad", F.lit(True))
    out = verdict.join(bad, "transaction", "left").where("not (ok and aborted)")
    said = F.when(~F.col("ok") | F.coalesce("bad", F.lit(False)), "unresolved").when(F.col("committed"), "cleaned").otherwise("recovered")
    return out.select("transaction", said.alias("verdict"))


def _pairs(sizes: DataFrame, observed: DataFrame) -> DataFrame:
    """Each object of a manifest with what is in place and in quarantine, and whether both are whole."""
    right = lambda seen: (F.col(f"{seen}.found") == F.col(f"{seen}.digest")) & (F.col(f"{seen}.size") == F.col("m.size"))
    m, s, q = sizes.alias("m"), observed.where("transaction is null").alias("s"), observed.where("transaction is not null").alias("q")
    joined = m.join(s, F.col("m.digest") == F.col("s.digest"), "left").join(q, (F.col("m.digest") == F.col("q.digest")) & (F.col("m.transaction") == F.col("q.transaction")), "left")
    return joined.select("m.transaction", "m.digest", "m.same", F.col("s.digest").isNotNull().alias("source"), right("s").alias("source_whole"), F.col("q.digest").isNotNull().alias("quarantine"), right("q").alias("quarantine_whole"))


def repairs(verdicts: DataFrame, manifest: DataFrame, observed: DataFrame, evictions: DataFrame, state: DataFrame) -> DataFrame:
    """(transaction, digest, evidence, step): what an operator does, as rows; no file moves. An object of a recovered transaction moves back or its
    duplicate is dropped, and what the transaction evicted (evictions(transaction, digest, evidence)) is restored where state(target, state) still
    says so; a cleaned one loses its quarantine."""
    sizes = manifest.groupBy("transaction", "digest").agg(F.min("size").alias("size"), F.lit(True).alias("same"))
    pairs = _pairs(sizes, observed).join(verdicts.where("verdict <> 'unresolved'"), "transaction").where("quarantine")
    step = F.when(F.col("verdict") == "cleaned", "clean").when(F.col("source"), "drop duplicate").otherwise("move back")
    files = pairs.select("transaction", "digest", F.lit(None).cast(dict(manifest.dtypes)["evidence"]).alias("evidence"), step.alias("step"))
    undone = manifest.join(verdicts.where("verdict = 'recovered'").select("transaction"), "transaction", "left_semi").select("transaction", "digest", "evidence").distinct()
    out = undone.join(evictions.select("transaction", "digest", "evidence").distinct(), ["transaction", "digest", "evidence"])
    away = state.where("state <> 'present'").select(F.col("target").alias("evidence"))
    return files.unionByName(out.join(away, "evidence", "left_semi").select("transaction", "digest", "evidence", F.lit("restore").alias("step")))


def tree_hash(rows: DataFrame, order: list[str], digest: str, width: int = WIDTH) -> DataFrame:
    """One row (n, root): a digest of the hex digests of all rows in order. Rows are numbered, each run of `width` of a level becomes the SHA-256 of
    its digests in turn, and so on to the root: a row that is changed, moved, added or taken away changes it, and no task holds more
    than a run. Without rows the root is the digest of nothing; a lone row is hashed once."""
    place = numbered(rows.select(*order, F.col(digest).alias("__digest")), [], order, "__at").select("__at", "__digest")
    n = place.count()
    level, left = place, n
    while True:
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__digest"))), lambda x: x["__digest"]), "")
        level = level.groupBy(F.expr(f"__at div {width}").alias("__run")).agg(F.sha2(run, 256).alias("__digest")).withColumnRenamed("__run", "__at")
        left = -(-left // width)
        if left <= 1:
            break
    root = level.agg(F.coalesce(F.max("__digest"), F.sha2(F.lit(""), 256)).alias("root"))
    return root.select(F.lit(n).cast("long").alias("n"), "root")
