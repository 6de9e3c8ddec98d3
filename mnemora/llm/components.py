"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.shared import cut

SALTS = 8


def _with_least_neighbour(links: DataFrame) -> DataFrame:
    """links(u, v) and least = min(u, every v of u).

    The minima are partial aggregates, so a hot u costs one row a task. They are
    joined back on (u, salt): a u with most of the links is dealt over SALTS tasks.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    least = least.select("u", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "least")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges(u, v).

    Alternates the large-star and small-star steps until the edges no longer
    change: a logarithmic number of rounds in practice, each of two shuffles over an
    edge list that never grows. Each round is written to the checkpoint folder.
    Self-links only name their node; null ends are ignored. Empty in, empty out.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null").distinct()
    current = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        seen = _with_least_neighbour(large)
        small = seen.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct(F.col("u").alias("u"), F.col("least").alias("v")))).alias("e"))
        current = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = tuple(current.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(hash(u, v), 1000003) as bigint))")).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.unionByName(heads)
