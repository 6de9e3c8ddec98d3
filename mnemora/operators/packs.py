"""A context pack from a store in one call: what may be shown, in three layers, under one budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.checkpoints import cut
from mnemora.functions.labels import authorized
from mnemora.operators import context, graph, search
from mnemora.operators.ordered import numbered
from mnemora.operators.projections import continuity_documents

CONVERSATION_KINDS = ("conversation", "message", "event-batch")


def _placed(items: DataFrame, order: list[str]) -> DataFrame:
    return numbered(items, [], order, "__pos").select((F.col("__pos") + 1).alias("pos"), "source_kind", "source_id", "title", "snippet")


def build_pack(
    documents: DataFrame, claims: DataFrame, edges: DataFrame, ranks: DataFrame, captures: DataFrame, query: str, ceiling: str, session: str | None = None, workspace: str | None = None, limit: int = 8, budgets: dict[str, int] | None = None
) -> DataFrame:
    """The rows of `context.pack` for a query: core documents by path; captures of the session and workspace, latest first, then documents
    that carry on between sessions, by path; and search hits. Every document is judged by its label in force (its own, its claims' and that of all
    evidence they cite), each source stands once, in its first layer.

    documents(id, path, core, type, status, title, text, rank, claims), claims(id, document, rank), edges(claim_id, evidence_id), ranks(id, rank),
    captures(id, kind, source, captured_at, title, text, rank).
    """
    in_force = cut(documents.drop("rank").join(graph.document_ranks(documents, claims, edges, ranks), "id"))
    visible = authorized(in_force, ceiling)
    shown = lambda rows: rows.select(F.lit("canon").alias("source_kind"), F.col("id").alias("source_id"), "title", F.trim(F.coalesce("text", F.lit(""))).alias("snippet"), "path")
    said = context.routed(authorized(captures.where(F.col("kind").isin(*CONVERSATION_KINDS)), ceiling), session, workspace)
    said = said.select(F.lit(0).alias("which"), (-F.unix_micros("captured_at")).alias("late"), F.lit("").alias("path"), F.lit("evidence").alias("source_kind"), F.col("id").alias("source_id"), "title", F.col("text").alias("snippet"))
    carried = shown(continuity_documents(visible)).withColumn("which", F.lit(1)).withColumn("late", F.lit(0).cast("long"))
    layers = {"core": _placed(shown(visible.where("core")), ["path", "source_id"]), "continuity": _placed(said.unionByName(carried), ["which", "late", "path", "source_id"])}
    if query.strip():
        hits = search.search(in_force.select("id", "rank", "text"), query, limit, ceiling)
        titles = visible.select("id", "title")
        ordered = hits.join(titles, "id").select(F.lit("canon").alias("source_kind"), F.col("id").alias("source_id"), "title", "snippet", "tier", "place")
        layers["relevant"] = _placed(ordered, ["tier", "place"])
    return context.pack(layers, budgets)
