"""Integrity constraints: each is a query of its violations, the report is their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.labels import DEFAULT
from mnemora.operators import folds, graph


def _rule(rows: DataFrame, name: str, location: str) -> DataFrame:
    return rows.select(F.lit(name).alias("rule"), F.col(location).cast("long").alias("location"))


def repeated(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(key)


def report(chain: DataFrame, claims: DataFrame, edges: DataFrame, captures: DataFrame, ranks: DataFrame, requirements: DataFrame, candidates: DataFrame, claim_rank: int = DEFAULT) -> DataFrame:
    """(rule, location) of every violation; claims are labelled `claim_rank`."""
    parts = [
        _rule(folds.chain_faults(chain), "event chain is broken", "seq"),
        _rule(repeated(captures), "capture id is repeated", "id"),
        _rule(repeated(claims), "claim id is repeated", "id"),
        _rule(graph.unlinked_supersessions(claims), "supersession has no back-link", "claim_id"),
        _rule(folds.candidate_steps(candidates).where("not legal"), "candidate step is illegal", "seq"),
        _rule(graph.dangling(edges, captures), "cited evidence does not exist", "claim_id"),
        _rule(requirements.where("not satisfied"), "evidence requirement is not met", "claim_id"),
        _rule(graph.claim_ranks(edges, ranks).where(F.col("rank") > claim_rank), "claim is labelled below its evidence", "claim_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
