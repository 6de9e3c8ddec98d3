"""Proposed claims: what is wrong with one, whether what it cites exists, and whether a promoted document holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.labels import LABELS, UNKNOWN
from mnemora.functions.text import ROLE, UUID7, instant, is_absolute_uri, is_validity, precision, stripped
from mnemora.operators.constraints import union, violations
from mnemora.operators.projections import TAGS

# The fields of a proposal and what they may say.
REQUIRED = ("predicate", "object", "statement", "basis", "certainty", "observed_at", "evidence")
OWNED = ("id", "subject", "state", "superseded_by")
BASES = ("declared", "observed", "inferred", "imported", "computed")
CERTAINTIES = ("confirmed", "probable", "tentative", "unknown")
PREDICATE = r"^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*\z"
REQUIRES = rf"^(?:raw|record-only|representation:{ROLE[1:-2]})\z"


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike(kind), F.lit(False))


def object_error(object_json: Column) -> Column:
    """What is wrong with a claim's object, a JSON text with exactly one tag (and a unit beside a number); null for a good one."""
    v, keys = F.try_parse_json(object_json), F.json_object_keys(object_json)
    tagged = F.array_intersect(keys, F.array(*map(F.lit, TAGS)))
    kind = F.element_at(tagged, 1)
    text = lambda t: F.try_variant_get(v, f"$.{t}", "string")
    extra = F.array_except(keys, F.when(kind == "number", F.array(F.lit("number"), F.lit("unit"))).otherwise(F.array(kind)))
    good = {
        "ref": text("ref").rlike(UUID7), "text": _is(v, "$.text", "^STRING$"), "boolean": _is(v, "$.boolean", "^BOOLEAN$"), "number": _is(v, "$.number", "^(BIGINT|DECIMAL|DOUBLE)") & (~F.array_contains(keys, "unit") | (_is(v, "$.unit", "^STRING$") & (stripped(text("unit")) != ""))),
        "date": _is(v, "$.date", "^STRING$") & (precision(text("date")) == "date"), "datetime": _is(v, "$.datetime", "^STRING$") & instant(text("datetime")).isNotNull(), "uri": _is(v, "$.uri", "^STRING$") & is_absolute_uri(text("uri")), "json": F.lit(True),
    }
    out = F.when(keys.isNull() | v.isNull(), "claim object is no mapping").when(F.size(tagged) != 1, "claim object has not one typed value").when(F.size(extra) > 0, "claim object has other fields")
    for tag, ok in good.items():
        out = out.when((kind == tag) & ~F.coalesce(ok, F.lit(False)), f"claim object {tag} is invalid")
    return out


def proposal_error(proposal: Column, predicate: str = PREDICATE, bases: tuple = BASES, certainties: tuple = CERTAINTIES) -> Column:
    """What is wrong first with a claim proposal, a JSON text; null for a good one. Evidence is ids or (id, requires)."""
    v, keys = F.try_parse_json(proposal), F.json_object_keys(proposal)
    text = lambda p: F.try_variant_get(v, f"$.{p}", "string")
    cited = F.try_variant_get(v, "$.evidence", "array<variant>")
    plain = lambda x: F.schema_of_variant(x) == "STRING"
    ids = F.transform(cited, lambda x: F.when(plain(x), F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.id", "string")))
    fields = lambda x: F.array_sort(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")))
    item = lambda x: plain(x) | (fields(x).eqNullSafe(F.array(F.lit("id"), F.lit("requires"))) & F.coalesce(_is(x, "$.requires", "^STRING$") & F.try_variant_get(x, "$.requires", "string").rlike(REQUIRES), F.lit(False)))
    bounds = F.map_keys(F.try_variant_get(v, "$.valid", "map<string,variant>"))
    dated = lambda k: ~F.array_contains(bounds, k) | _is(v, f"$.valid.{k}", "^STRING$")
    old = F.try_variant_get(v, "$.supersedes", "array<string>")
    has = lambda k: F.array_contains(keys, k)
    ok = lambda c: F.coalesce(c, F.lit(False))
    said_null = lambda k: ~has(k) | _is(v, f"$.{k}", "^VOID$")
    rules = {
        "claim proposal is no mapping": keys.isNotNull() & v.isNotNull(),
        "claim proposal sets what promotion owns": ~F.arrays_overlap(keys, F.array(*map(F.lit, OWNED))),
        "claim proposal misses fields": F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) == 0,
        "the predicate is not dotted lower-case words": text("predicate").rlike(predicate),
        "claim statement is empty": stripped(text("statement")) != "",
        "the basis is none of those known": text("basis").isin(*bases),
        "the certainty is none of those known": text("certainty").isin(*certainties),
        "claim observed_at is no time": instant(text("observed_at")).isNotNull(),
        "claim evidence is not a list of distinct ids": (F.size(ids) > 0) & F.forall(ids, lambda x: F.coalesce(x.rlike(UUID7), F.lit(False))) & F.forall(cited, item) & (F.size(F.array_distinct(ids)) == F.size(ids)),
        "claim valid is no interval": said_null("valid") | ((F.size(F.array_except(bounds, F.array(F.lit("from"), F.lit("until")))) == 0) & dated("from") & dated("until") & is_validity(text("valid.from"), text("valid.until")) & (text("valid.from").isNotNull() | text("valid.until").isNotNull())),
        "claim sensitivity is invalid": said_null("sensitivity") | text("sensitivity").isin(*LABELS),
        "claim supersedes is not a list of distinct ids": said_null("supersedes") | (F.forall(old, lambda x: x.rlike(UUID7)) & (F.size(F.array_distinct(old)) == F.size(old))),
    }
    names = list(rules)
    out = F.when(~ok(rules[names[0]]), names[0])
    for n in names[1:3]:
        out = out.when(~ok(rules[n]), n)
    wrong = object_error(F.get_json_object(proposal, "$.object"))
    out = out.when(~ok(rules[names[3]]), names[3]).when(wrong.isNotNull(), wrong)
    for n in names[4:]:
        out = out.when(~ok(rules[n]), n)
    return out


def reference_faults(proposals: DataFrame, concepts: DataFrame, claims: DataFrame, ranks: DataFrame) -> DataFrame:
    """Of proposals(id, subject, predicate, ref, supersedes, rank, evidence_id), a row for each cited evidence: a ref without a concept, a superseded claim that is
    missing, of another subject or predicate, or not current, and a label below that of the cited evidence."""
    loose = proposals.where("ref is not null").join(concepts.select(F.col("id").alias("ref")), "ref", "left_anti")
    old = claims.select(F.col("id").alias("supersedes"), F.col("subject").alias("__s"), F.col("predicate").alias("__p"), F.col("state").alias("__state"))
    linked = proposals.where("supersedes is not null").join(old, "supersedes", "left")
    fits = F.col("__s").eqNullSafe(F.col("subject")) & F.col("__p").eqNullSafe(F.col("predicate")) & F.col("__state").isin("active", "disputed")
    low = proposals.join(ranks.select(F.col("id").alias("evidence_id"), F.col("rank").alias("__rank")), "evidence_id", "left").where(F.coalesce("__rank", F.lit(UNKNOWN)) > F.col("rank"))
    return union(
        violations(loose.select("id").distinct(), "claim refers to no concept", "id"),
        violations(linked.where(~F.coalesce(fits, F.lit(False))).select("id").distinct(), "superseded claim does not fit", "id"),
        violations(low.select("id").distinct(), "claim is labelled below its evidence", "id"),
    )


def unheld_promotions(promoted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Of promoted(candidate, path, proposal) and claims of snapshots(path, candidate, claim), canonical JSON texts: a document that does not hold exactly its candidate's claim."""
    held = snapshots.groupBy("path", "candidate").agg(F.count("*").alias("n"), F.max("claim").alias("claim"))
    both = promoted.join(held, ["path", "candidate"], "left")
    return violations(both.where(~F.coalesce((F.col("n") == 1) & (F.col("claim") == F.col("proposal")), F.lit(False))), "snapshot does not hold the candidate's claim", "candidate")
