"""Context packs under character budgets, and the expansion of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.labels import authorized
from mnemora.functions.text import html_escape
from mnemora.operators.ordered import with_sum_before

# The budgets of the default policy, in characters.
BUDGETS = {"total": 24_000, "core": 8_000, "continuity": 4_000, "relevant": 12_000}
LAYERS = ("core", "continuity", "relevant")
MOST = 1_000_000
# What counts for continuity.
CONTINUITY_TYPES = ("Project", "Goal", "Conflict", "Decision")


def allocated(total: int, core: int, continuity: int, relevant: int) -> dict[str, int]:
    """What each layer gets of the total, in turn."""
    out, left = {}, total
    for name, wanted in zip(LAYERS, (core, continuity, relevant)):
        if isinstance(wanted, bool) or not isinstance(wanted, int) or not 0 <= wanted <= MOST:
            raise ValueError(f"{name} must be a whole number of characters up to {MOST}")
        out[name] = min(wanted, left)
        left -= out[name]
    return out


def budgeted(items: DataFrame, key: list[str], order: str, budget: int | F.Column) -> DataFrame:
    """items(title, snippet) of each key in order, cut to the budget: what no longer fits ends in an ellipsis, the rest is left out.

    An item that is cut uses up exactly what was left, so the use before an item is the plain running sum up to the budget.
    """
    sized = items.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("snippet", F.coalesce("snippet", F.lit("")))
    sized = sized.withColumn("__size", (F.length("title") + F.length("snippet")).cast("long"))
    run = with_sum_before(sized, key, order, "__size", "__used")
    left = run.withColumn("__left", (F.lit(budget) if isinstance(budget, int) else budget) - F.col("__used")).where("__left > 0")
    t, s, room = F.length("title"), F.length("snippet"), F.col("__left")

    def shortened(text: str, n) -> F.Column:
        return F.concat(F.col(text).substr(F.lit(1), (n - 1).cast("int")), F.lit("…"))

    title = F.when(t >= room, shortened("title", room)).otherwise(F.col("title"))
    snippet = F.when(t >= room, F.lit("")).when(t + s > room, shortened("snippet", room - t)).otherwise(F.col("snippet"))
    out = left.withColumn("__t", title).withColumn("__s", snippet).withColumn("truncated", (t >= room) | (t + s > room))
    return out.select(*[F.col(c) for c in items.columns if c not in ("title", "snippet")], F.col("__t").alias("title"), F.col("__s").alias("snippet"), "truncated")


def once_over_layers(items: DataFrame) -> DataFrame:
    """items(layer_no, pos, source_kind, source_id): the first place of each source, over whole layers.

    (layer_no, pos) is unique, so the places found by a partial aggregate are joined back without a hot key.
    """
    places = items.groupBy("source_kind", "source_id").agg(F.min(F.struct("layer_no", "pos")).alias("__at"))
    return items.join(places.select("__at.layer_no", "__at.pos"), ["layer_no", "pos"], "left_semi").select(*[F.col(c) for c in items.columns])


def recent(captures: DataFrame, session, ceiling: str, order: list) -> DataFrame:
    """Conversation captures of a session within the ceiling, latest first."""
    kinds = F.col("kind").isin("conversation", "message", "event-batch")
    return authorized(captures.where(kinds & (F.col("session") == session)), ceiling).orderBy(*order)


def routed(captures: DataFrame, session: str | None = None, workspace: str | None = None) -> DataFrame:
    """captures whose source names the session and the workspace that are given, in its own field or else in its metadata."""
    for name, value in (("session", session), ("workspace", workspace)):
        if value is not None:
            captures = captures.where(F.coalesce(F.col(f"source.{name}"), F.col("source.metadata")[name]) == value)
    return captures


def pack(layers: dict[str, DataFrame], budgets: dict[str, int] | None = None) -> DataFrame:
    """(layer, pos, source_kind, source_id, title, snippet, truncated) of layers of items(pos, source_kind, source_id, title, snippet).

    pos counts from 1 in each layer. Sources are told apart over the whole layers; only then is a layer cut by
    the running sum of what its items use.
    """
    b = BUDGETS | (budgets or {})
    given = allocated(b["total"], b["core"], b["continuity"], b["relevant"])
    parts = None
    columns = ["pos", "source_kind", "source_id", "title", "snippet"]
    for k, name in enumerate(LAYERS):
        if name not in layers:
            continue
        part = layers[name].select(*columns).withColumn("layer_no", F.lit(k)).withColumn("layer", F.lit(name)).withColumn("budget", F.lit(given[name]))
        parts = part if parts is None else parts.unionByName(part)
    out = budgeted(once_over_layers(parts), ["layer", "layer_no", "budget"], "pos", F.col("budget"))
    return out.select("layer", "pos", "source_kind", "source_id", "title", "snippet", "truncated")


def rendered(packed: DataFrame) -> DataFrame:
    """packed with `block`: the item as untrusted data, its text unable to close the block."""
    source = html_escape(F.concat_ws(":", "source_kind", F.col("source_id").cast("string")), quotes=True)
    block = F.concat(F.lit('<untrusted-data source="'), source, F.lit('">\nTitle: '), html_escape(F.col("title")), F.lit("\n\n"), html_escape(F.col("snippet")), F.lit("\n</untrusted-data>"))
    return packed.withColumn("block", block)


def rendered_pack(packed: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """One row (markdown): all layers of packed(layer, pos, source_kind, source_id, title, snippet), numbered, each item as untrusted data.

    A pack is at most its budget of characters, so it fits one row.
    """
    heads = {n: n.capitalize() for n in LAYERS} | (titles or {})
    source = html_escape(F.concat_ws(":", "source_kind", F.col("source_id").cast("string")), quotes=True)
    label = html_escape(F.col("sensitivity"), quotes=True) if "sensitivity" in packed.columns else F.lit("personal")
    lines = [F.concat(F.lit('<untrusted-data source="'), source, F.lit('" sensitivity="'), label, F.lit('">')), F.concat(F.lit("Title: "), html_escape(F.col("title"))), F.lit(""), html_escape(F.col("snippet")), F.lit("</untrusted-data>"), F.lit("")]
    items = packed.select("layer", "pos", F.concat_ws("\n", *lines).alias("block"))
    of_layer = [F.array_sort(F.collect_list(F.when(F.col("layer") == n, F.struct("pos", "block")))).alias(n) for n in LAYERS]
    once = items.agg(*of_layer)

    def shown(n: str) -> F.Column:
        blocks = F.array_join(F.transform(n, lambda x, i: F.concat(F.lit("### Context item "), (i + 1).cast("string"), F.lit("\n\n"), x["block"])), "\n")
        return F.concat(F.lit(f"## {heads[n]}\n\n"), F.when(F.size(n) == 0, F.lit("No authorized context was selected for this layer.\n")).otherwise(blocks))

    return once.select(F.concat_ws("\n", *[shown(n) for n in LAYERS]).alias("markdown"))


def expand(captures: DataFrame, ranks: DataFrame, state: DataFrame, ceiling: str, max_chars: int) -> DataFrame:
    """(id, outcome, text, truncated) for every capture: above the ceiling a record does not exist, and bytes that are not present are unavailable."""
    from mnemora.functions.labels import LABELS

    of = ranks.select("id", F.col("rank").alias("__rank"))
    now = state.select(F.col("target").alias("id"), F.col("state").alias("__state"))
    rows = captures.join(of, "id", "left").join(now, "id", "left")
    hidden = F.coalesce("__rank", F.lit(99)) > LABELS.index(ceiling)
    outcome = F.when(hidden, "evidence_not_found").when(F.coalesce("__state", F.lit("present")) != "present", "material_unavailable").when(F.col("text").isNull(), "object_unavailable").otherwise("ok")
    ok = F.col("outcome") == "ok"
    return rows.withColumn("outcome", outcome).select("id", "outcome", F.when(ok, F.col("text").substr(1, max_chars)).alias("text"), F.when(ok, F.length("text") > max_chars).alias("truncated"))
