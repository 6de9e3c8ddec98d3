"""More integrity constraints of a record store: each returns (rule, location) rows of its violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.labels import UNKNOWN
from mnemora.functions.text import ROLE

# Kinds of captures and classes of retention.
KINDS = ("artifact", "conversation", "event-batch", "web-capture", "message", "import", "augmentation")
CLASSES = ("pinned", "durable", "grace", "derivative-only", "reference-only")


def violations(rows: DataFrame, rule: str, location: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(location).cast("string").alias("location"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _each(rows: DataFrame, location: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over rows for many row-wise rules; a null verdict counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.col(location).cast("string").alias("location"))


def capture_faults(captures: DataFrame) -> DataFrame:
    """Of captures(id, kind, retention, digest, object, state): known kind and class, an object that is the content's own, and no bytes of
    what is held by reference only."""
    return _each(captures, "id", {
        "capture has an unknown kind": F.col("kind").isin(*KINDS),
        "capture has an unknown retention": F.col("retention").isin(*CLASSES),
        "payload is not the content": F.col("object").isNull() | F.col("object").eqNullSafe(F.concat(F.lit("sha256:"), "digest")),
        "reference-only capture has bytes": ~((F.col("retention") == "reference-only") & (F.col("state") == "present")),
    })


def event_faults(log: DataFrame, captures: DataFrame) -> DataFrame:
    """Of log(seq, target, kind, was, becomes, role): a target that exists, a retention change between two known classes, a representation with a role."""
    orphans = log.where("target is not null").join(captures.select(F.col("id").alias("target")), "target", "left_anti")
    shapes = _each(log, "seq", {
        "retention change is malformed": (F.col("kind") != "retention.changed") | (F.col("was").isin(*CLASSES) & F.col("becomes").isin(*CLASSES)),
        "representation has no role": (F.col("kind") != "representation.added") | F.col("role").rlike(ROLE),
    })
    return union(violations(orphans, "event has no capture", "seq"), shapes)


def claim_faults(claims: DataFrame, concepts: DataFrame) -> DataFrame:
    """Of claims(id, subject, predicate, ref, supersedes): a ref that resolves to a concept, and a superseded claim that exists, is of the same
    subject and predicate, and knows of it."""
    loose = claims.where("ref is not null").join(concepts.select(F.col("id").alias("ref")), "ref", "left_anti")
    old = claims.select(F.col("id").alias("supersedes"), F.col("subject").alias("__s"), F.col("predicate").alias("__p"), F.col("state").alias("__state"))
    linked = claims.where("supersedes is not null").join(old, "supersedes", "left")
    alike = F.col("__s").eqNullSafe(F.col("subject")) & F.col("__p").eqNullSafe(F.col("predicate"))
    return union(
        violations(loose, "claim refers to no concept", "id"),
        _each(linked, "id", {"superseded claim is of another subject or predicate": alike, "superseded claim has no back-link": F.col("__state") == "superseded"}),
    )


def transaction_faults(transactions: DataFrame, manifest: DataFrame, evictions: DataFrame) -> DataFrame:
    """Of retention transactions(target, kind): one prepared and one end; and for committed ones exactly the evictions(target, item) of the manifest(target, item)."""
    counts = transactions.groupBy("target").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("prepared", "committed", "aborted")])
    phases = counts.where("prepared <> 1 or committed + aborted <> 1")
    done = counts.where("committed = 1 and prepared = 1 and aborted = 0").select("target")
    planned, made = (x.select("target", "item").join(done, "target", "left_semi") for x in (manifest, evictions))
    return union(
        violations(phases, "transaction has not one beginning and one end", "target"),
        violations(planned.exceptAll(made), "planned eviction did not happen", "target"),
        violations(made.exceptAll(planned), "eviction was not planned", "target"),
    )


def promotion_faults(terminals: DataFrame, promotions: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """Of promoted terminals(target, transaction): exactly one committed promotion(transaction, before, after) each and one terminal for each
    promotion; of rollbacks(seq, source, before, after): a committed source whose change they undo."""
    made = promotions.groupBy("transaction").agg(F.count("*").alias("n"))
    ended = terminals.groupBy("transaction").agg(F.count("*").alias("ends"))
    unmade = terminals.join(made.where("n = 1").select("transaction"), "transaction", "left_anti")
    unended = promotions.join(ended.where("ends = 1").select("transaction"), "transaction", "left_anti")
    once = promotions.join(made.where("n = 1").select("transaction"), "transaction", "left_semi").select(F.col("transaction").alias("source"), F.col("before").alias("__b"), F.col("after").alias("__a"))
    undone = rollbacks.join(once, "source", "left")
    return union(
        violations(unmade, "promoted candidate has not one committed promotion", "target"),
        violations(unended, "promotion has not one promoted candidate", "transaction"),
        violations(undone.where("__a is null and __b is null"), "rollback has no committed promotion", "seq"),
        violations(undone.where((F.col("__a").isNotNull() | F.col("__b").isNotNull()) & ~(F.col("before").eqNullSafe(F.col("__a")) & F.col("after").eqNullSafe(F.col("__b")))), "rollback is not the inverse", "seq"),
    )


def drift(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Paths whose files(path, digest) are not what the last of commits(path, seq, after) left; a null after means removed."""
    last = commits.groupBy("path").agg(F.max_by(F.struct("after"), "seq").alias("__last"))
    both = last.join(files, "path", "left")
    return violations(both.where(~F.col("__last.after").eqNullSafe(F.col("digest"))), "document is not the last commit's", "path")


def material_faults(captures: DataFrame, state: DataFrame, objects: DataFrame, floors: DataFrame) -> DataFrame:
    """Of captures(id, digest, size, rank): present bytes exist, undamaged and of the capture's size; and no capture is labelled below its object."""
    gone = state.where("state <> 'present'").select(F.col("target").alias("id"))
    held = objects.select("digest", F.col("size").alias("__size"), F.coalesce("error", F.lit("")).alias("__error"))
    rows = captures.where("digest is not null").join(gone, "id", "left_anti").join(held, "digest", "left")
    low = captures.join(floors.select("digest", F.col("rank").alias("__floor")), "digest").where(F.col("__floor") > F.coalesce("rank", F.lit(UNKNOWN)))
    return union(
        _each(rows, "id", {"present object is missing": F.col("__size").isNotNull(), "present object is damaged or of another size": F.col("__size").isNull() | ((F.col("__error") == "") & F.col("__size").eqNullSafe(F.col("size")))}),
        violations(low, "object is labelled above its capture", "id"),
    )
