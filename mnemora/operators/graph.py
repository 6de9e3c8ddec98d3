"""The claim graph: edges, supersession, cited evidence and what retention lets go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.labels import DEFAULT, UNKNOWN, authorized

SALTS = 8


def supersession_edges(claims: DataFrame) -> DataFrame:
    """(claim_id, edge_type, target_id) of claims(id, supersedes)."""
    return claims.where("supersedes is not null").select(F.col("id").alias("claim_id"), F.lit("supersedes").alias("edge_type"), F.col("supersedes").alias("target_id")).dropDuplicates()


def unlinked_supersessions(claims: DataFrame) -> DataFrame:
    """(claim_id, target_id, fault): a superseded claim that is missing, has another subject kind, or does not know it is superseded."""
    targets = claims.select(F.col("id").alias("target_id"), F.col("state").alias("__state"), F.col("predicate").alias("__predicate"))
    found = claims.where("supersedes is not null").select(F.col("id").alias("claim_id"), F.col("supersedes").alias("target_id"), "predicate").join(targets, "target_id", "left")
    fault = F.when(F.col("__state").isNull(), "missing").when(F.col("__predicate") != F.col("predicate"), "other predicate").when(F.col("__state") != "superseded", "no back-link")
    return found.select("claim_id", "target_id", fault.alias("fault")).where("fault is not null")


def dangling(edges: DataFrame, captures: DataFrame) -> DataFrame:
    """Edges to evidence that no capture has."""
    return edges.join(captures.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti")


def requirements(edges: DataFrame, captures: DataFrame, state: DataFrame, roles: DataFrame) -> DataFrame:
    """edges with `satisfied`: raw needs present bytes, representation:<role> a representation of that role (roles(id, role)), record-only the record."""
    known = captures.select(F.col("id").alias("evidence_id"), F.lit(True).alias("__known"))
    states = state.select(F.col("target").alias("evidence_id"), F.col("state").alias("__state"))
    held = roles.select(F.col("id").alias("evidence_id"), F.concat(F.lit("representation:"), "role").alias("requires"), F.lit(True).alias("__held")).distinct()
    joined = edges.join(known, "evidence_id", "left").join(states, "evidence_id", "left").join(held, ["evidence_id", "requires"], "left")
    known_, present = F.coalesce("__known", F.lit(False)), F.coalesce("__state", F.lit("present")) == "present"
    met = F.when(F.col("requires") == "raw", known_ & present).when(F.col("requires") == "record-only", known_).otherwise(known_ & F.coalesce("__held", F.lit(False)))
    return joined.select(*edges.columns, met.alias("satisfied"))


def claim_ranks(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(claim_id, rank): the highest label of the cited evidence; missing evidence fails closed."""
    of = ranks.select(F.col("id").alias("evidence_id"), F.col("rank").alias("__rank"))
    return edges.join(of, "evidence_id", "left").groupBy("claim_id").agg(F.max(F.coalesce("__rank", F.lit(UNKNOWN))).alias("rank"))


def document_ranks(documents: DataFrame, claims: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, rank): the label in force of documents(id, rank): the highest of its own (personal where it has none), of those its
    claims(id, document, rank) state, and of all evidence that they cite. A claim without evidence and missing evidence fail closed.

    Labels meet as rows in one partial aggregate, so a document with most of the claims is one row a task.
    """
    cited = claim_ranks(edges, ranks).select(F.col("claim_id").alias("id"), F.col("rank").alias("__cited"))
    of_claims = claims.select("id", "document", "rank").join(cited, "id", "left")
    stated = of_claims.where("rank is not null").select(F.col("document").alias("id"), "rank")
    from_evidence = of_claims.select(F.col("document").alias("id"), F.coalesce("__cited", F.lit(UNKNOWN)).alias("rank"))
    claimed = stated.unionByName(from_evidence).join(documents.select("id"), "id", "left_semi")
    own = documents.select("id", F.coalesce("rank", F.lit(DEFAULT)).alias("rank"))
    return own.unionByName(claimed).groupBy("id").agg(F.max("rank").cast("int").alias("rank"))


def visible_documents(documents: DataFrame, claims: DataFrame, edges: DataFrame, ranks: DataFrame, ceiling: str) -> DataFrame:
    """documents at or below the ceiling by the label in force, with that label as `rank`: what search and context may show."""
    return authorized(documents.drop("rank").join(document_ranks(documents, claims, edges, ranks), "id"), ceiling)


def object_ranks(captures: DataFrame) -> DataFrame:
    """(digest, rank): the highest label of what refers to an object."""
    return captures.where("digest is not null").groupBy("digest").agg(F.max(F.coalesce("rank", F.lit(UNKNOWN))).alias("rank"))


def handles(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, position, evidence_id): the evidence of each subject's active claims, first seen first, each once."""
    from pyspark.sql import Window as W

    cited = claims.where("state = 'active'").select(F.col("id").alias("claim_id"), "subject").join(edges, "claim_id")
    once = cited.groupBy("subject", "evidence_id").agg(F.min("claim_id").alias("__at"))
    return once.select("subject", F.row_number().over(W.partitionBy("subject").orderBy("__at", "evidence_id")).cast("long").alias("position"), "evidence_id")


def blocking_reasons(captures: DataFrame, state: DataFrame, raw_needed: DataFrame, held: DataFrame | None = None, expired: bool = True) -> DataFrame:
    """(digest, reason), distinct: why the bytes of captures(id, digest, retention) must stay. One row a reason, so a digest
    with most of the captures never makes a list in one task."""
    gone = state.where("state <> 'present'").select(F.col("target").alias("id"))
    kept = captures.where("digest is not null").join(gone, "id", "left_anti")
    raw = raw_needed.select(F.col("evidence_id").alias("id")).distinct().withColumn("__raw", F.lit(True))
    rows = kept.join(raw, "id", "left")
    by_class = (
        F.when(F.col("retention").isin("pinned", "durable"), F.concat(F.col("id").cast("string"), F.lit(" retention is "), "retention"))
        .when(F.col("retention") == "grace", None if expired else F.concat(F.col("id").cast("string"), F.lit(" grace period has not expired")))
        .when(F.col("retention") == "derivative-only", F.concat(F.col("id").cast("string"), F.lit(" has no retained representation")))
        .otherwise(F.concat(F.col("id").cast("string"), F.lit(" retention does not permit raw eviction")))
    )
    reasons = F.array_compact(F.array(by_class, F.when(F.col("__raw"), F.lit("active Claim requires raw bytes"))))
    out = rows.select("digest", F.explode(reasons).alias("reason"))
    if held is not None:
        out = out.unionByName(kept.join(held.select("id").distinct(), "id", "left_semi").select("digest", F.lit("owner or legal hold").alias("reason")))
    return out.distinct()


def grace_reasons(captures: DataFrame, changes: DataFrame, now: int, days: int) -> DataFrame:
    """(digest, reason) of grace captures(id, digest, retention, ingested) whose days have not passed: they run from the last of
    changes(id, at) of the class, else from ingestion, in microseconds. A grace that ends this instant is over; one without
    a beginning is not."""
    since = changes.groupBy("id").agg(F.max("at").alias("__at"))
    origin = F.coalesce("__at", "ingested")
    young = captures.where("retention = 'grace' and digest is not null").join(since, "id", "left").where(origin.isNull() | (origin > now - days * 86_400_000_000))
    return young.select("digest", F.concat(F.col("id").cast("string"), F.lit(" grace period has not expired")).alias("reason")).distinct()


def derivative_reasons(captures: DataFrame, representations: DataFrame, objects: DataFrame) -> DataFrame:
    """(digest, reason) of derivative-only captures(id, digest, retention, required) that must keep their bytes: a representation of
    representations(id, role, digest) is malformed or its object in objects(digest, error) is not whole, required roles are missing, or none is left."""
    whole = objects.where("error is null").select("digest", F.lit(True).alias("__whole")).distinct()
    rows = representations.join(whole, "digest", "left").withColumn("__ok", F.trim("role") != "")
    shown = F.concat(F.lit(" representation '"), "role", F.lit("' is invalid"))
    state = F.when(~F.coalesce("__ok", F.lit(False)) | F.col("digest").isNull(), F.lit(" has a malformed representation")).when(F.col("__whole").isNull(), shown)
    only = captures.where("retention = 'derivative-only' and digest is not null")
    bad = rows.select("id", state.alias("fault")).where("fault is not null").distinct()
    good = rows.where(state.isNull()).select("id", "role").distinct()
    needed = only.select("id", F.explode("required").alias("role"))
    missing = needed.join(good, ["id", "role"], "left_anti").select("id", F.concat(F.lit(" lacks required representation role: "), "role").alias("fault"))
    bare = only.where(F.coalesce(F.size("required"), F.lit(0)) == 0).select("id").join(good.select("id"), "id", "left_anti").withColumn("fault", F.lit(" has no retained representation"))
    return only.select("id", F.col("digest").alias("__d")).join(bad.unionByName(missing).unionByName(bare), "id").select(F.col("__d").alias("digest"), F.concat(F.col("id").cast("string"), "fault").alias("reason")).distinct()


def preview_reasons(
    captures: DataFrame, state: DataFrame, *, raw_needed: DataFrame, held: DataFrame, held_objects: DataFrame, protected: DataFrame, objects: DataFrame, changes: DataFrame, representations: DataFrame, now: int, days: int
) -> DataFrame:
    """(digest, reason), distinct, over all rules of a retention preview: captures(id, digest, retention, ingested, required) whose bytes are present, in
    each class by its own rule (grace from its dates, derivative-only by what is left of its representations), what active claims need, holds on
    evidence (id) and objects (digest), protected digests, and objects(digest, error) whose bytes are not whole. One row a reason."""
    gone = state.where("state <> 'present'").select(F.col("target").alias("id"))
    kept = captures.where("digest is not null").join(gone, "id", "left_anti")
    named = lambda text: F.concat(F.col("id").cast("string"), F.lit(text))
    by_class = F.when(F.col("retention").isin("pinned", "durable"), F.concat(named(" retention is "), F.col("retention"))).when(~F.coalesce(F.col("retention").isin("grace", "derivative-only"), F.lit(False)), named(" retention does not permit raw eviction"))
    of = lambda rows, reason: rows.select("digest", F.lit(reason).alias("reason"))
    present = kept.select("digest").distinct()
    parts = [
        kept.select("digest", by_class.alias("reason")).where("reason is not null"), grace_reasons(kept, changes, now, days), derivative_reasons(kept, representations, objects),
        of(kept.join(raw_needed.select(F.col("evidence_id").alias("id")), "id", "left_semi"), "active Claim requires raw bytes"), of(kept.join(held.select("id"), "id", "left_semi"), "owner or legal hold"),
        of(present.join(held_objects.select("digest"), "digest", "left_semi"), "owner or legal hold"), of(present.join(protected.select("digest"), "digest", "left_semi"), "object is kept as a snapshot or representation"),
        of(present.join(objects.where("error is null").select("digest"), "digest", "left_anti"), "object is missing or not whole"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def preview_confirmation(groups: DataFrame, policy_digest: str, sequence: int) -> DataFrame:
    """One row (n_candidates, estimated_bytes, confirmation) of groups(digest, size, n_evidence, evictable): what an owner confirms. It changes with the policy, the end
    of the log, and any candidate or its place, through the tree hash of all of them."""
    from mnemora.operators.changes import tree_hash

    free = groups.where("evictable").withColumn("__said", F.sha2(F.concat_ws("|", "digest", "size", "n_evidence"), 256))
    sums = free.agg(F.count("*").alias("n_candidates"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("estimated_bytes"))
    said = F.concat_ws("|", F.lit(policy_digest), F.lit(sequence), "n_candidates", "estimated_bytes", "root")
    return sums.join(F.broadcast(tree_hash(free, ["digest"], "__said"))).select("n_candidates", "estimated_bytes", F.sha2(said, 256).alias("confirmation"))


def retention_plan(groups: DataFrame, log: DataFrame, policy_digest: str) -> DataFrame:
    """One row (durable_sequence, n_candidates, estimated_bytes, confirmation): what an owner confirms. The confirmation changes with the policy, the
    log's end, the bytes, and any candidate of groups(digest, size, evictable); candidates are folded by xors and sums, so it needs no order."""
    half = lambda a: F.conv(F.substring("digest", a, 15), 16, 10).cast("long")
    free = groups.where("evictable").agg(
        F.count("*").alias("n_candidates"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("estimated_bytes"), F.coalesce(F.bit_xor(half(1)), F.lit(0).cast("long")).alias("__x"),
        F.coalesce(F.sum(half(16).bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0).cast("long")).alias("__s"),
    )
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("durable_sequence"))
    said = F.concat_ws("|", F.lit(policy_digest), "durable_sequence", "n_candidates", "estimated_bytes", "__x", "__s")
    return end.join(F.broadcast(free)).select("durable_sequence", "n_candidates", "estimated_bytes", F.sha2(said.cast("binary"), 256).alias("confirmation"))


def candidate_ranks(groups: DataFrame, captures: DataFrame, ranks: DataFrame) -> DataFrame:
    """(digest, rank): the highest label of the evidence of each evictable object."""
    of = captures.where("digest is not null").select("id", "digest").join(groups.where("evictable").select("digest"), "digest", "left_semi")
    return of.join(ranks.select("id", "rank"), "id", "left").groupBy("digest").agg(F.max(F.coalesce("rank", F.lit(UNKNOWN))).alias("rank"))


def retention_groups(captures: DataFrame, state: DataFrame, reasons: DataFrame) -> DataFrame:
    """(digest, size, n_evidence, n_reasons, evictable) of each object with present captures: one reason blocks all that share it."""
    gone = state.where("state <> 'present'").select(F.col("target").alias("id"))
    groups = captures.where("digest is not null").join(gone, "id", "left_anti").groupBy("digest").agg(F.max("size").alias("size"), F.count("*").alias("n_evidence"))
    why = reasons.groupBy("digest").agg(F.count("*").alias("n_reasons"))
    return groups.join(why, "digest", "left").withColumn("n_reasons", F.coalesce("n_reasons", F.lit(0).cast("long"))).withColumn("evictable", F.col("n_reasons") == 0)


def transitions(log: DataFrame, start: str, classes: tuple[str, ...], span: int = 1 << 16) -> DataFrame:
    """(target, retention): log(target, seq, was, becomes) folded in order, where a change counts only if `was` is the class in force.

    A span of a target's events is a function from class to class, a map of fixed size; the spans' maps are
    composed in order, so no task holds all events of a target.
    """
    spans = log.groupBy("target", F.floor(F.col("seq") / span).alias("__span")).agg(F.array_sort(F.collect_list(F.struct("seq", "was", "becomes"))).alias("__steps"))
    moves = [x for c in classes for x in (F.lit(c), F.aggregate("__steps", F.lit(c), lambda s, e: F.when(s == e["was"], e["becomes"]).otherwise(s)))]
    maps = spans.select("target", "__span", F.create_map(*moves).alias("__map"))
    chained = maps.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("__span", F.map_entries("__map").alias("__map")))).alias("__maps"))
    return chained.select("target", F.aggregate("__maps", F.lit(start), lambda s, m: F.coalesce(F.element_at(F.map_from_entries(m["__map"]), s), s)).alias("retention"))


def first_by_key(keys: DataFrame, key: str | list[str] = "external_id", order: str = "doc_id", digest: str = "digest") -> DataFrame:
    """keys with `outcome`: `new` for a key's first row, `replay` for a later one with equal content, else `conflict`.

    A key may be several columns, such as a source's kind, uri, account, device and external id; nulls are equal. A key of most rows is
    dealt over SALTS tasks.
    """
    by = [key] if isinstance(key, str) else key
    first = keys.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(by)]).agg(F.min(F.struct(F.col(order).alias("o"), F.col(digest).alias("d"))).alias("__first"))
    first = first.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = F.when(F.col(order) == F.col("__first.o"), "new").when(F.col(digest).eqNullSafe(F.col("__first.d")), "replay").otherwise("conflict")
    same = F.pmod(F.xxhash64(F.col(order)), F.lit(SALTS)).cast("int") == F.col("__salt")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return keys.join(first, same).select(*keys.columns, out.alias("outcome"))


def conflicting_keys(keys: DataFrame, key: str = "external_id", digest: str = "digest") -> DataFrame:
    """Keys that stand for different contents; minimum and maximum tell, no distinct count."""
    return keys.groupBy(key).agg(F.min(digest).alias("__a"), F.max(digest).alias("__b"), F.count("*").alias("n_rows")).where("__a <> __b").select(key, "n_rows")
