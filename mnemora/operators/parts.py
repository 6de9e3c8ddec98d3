"""The text of something that has several parts, under one budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.records import text_prefix, utf8_facts
from mnemora.functions.text import is_textual
from mnemora.operators.ordered import with_sum_before

SEPARATOR, WIDEST = "\n\n", 4


def bounded_texts(parts: DataFrame, most: int) -> DataFrame:
    """(id, text, truncated): of parts(id, pos, content, media_type) in the order of pos, the texts of at most `most` characters together, joined
    by SEPARATOR, which counts where more than one character is left after a text.

    A part gets the room that is left: its first bytes, WIDEST for each character of room, are read as strict UTF-8 and cut to the room. A part
    that is cut is the last one. One that is not textual, or has a byte within what is read that is no UTF-8, is left out. The room before a
    part is the budget less a running sum, taken span by span, so parts of one id meet in a task as far as they fit the budget only.
    """
    facts = parts.withColumn("__facts", F.when(is_textual(F.col("media_type")), utf8_facts("content")))
    known = facts.select("id", F.col("pos").cast("long").alias("pos"), "content", F.coalesce("__facts.chars", F.lit(0)).cast("long").alias("chars"), "__facts.bad_at", F.col("__facts").isNotNull().alias("shown"))
    whole = F.col("shown") & F.col("bad_at").isNull()
    sized = known.withColumn("takes", F.when(whole & (F.col("chars") > 0), F.col("chars") + len(SEPARATOR)).otherwise(0).cast("long"))
    summed = with_sum_before(sized, ["id"], "pos", "takes", "used")
    left = F.lit(most) - F.col("used")
    room = F.when((left == -1) & (F.lit(most) > 0), 1).otherwise(F.greatest(left, F.lit(0)))  # a single character left pays for no separator
    rows = summed.withColumn("room", room.cast("long")).where("room > 0 and shown")
    cut_short = F.col("bad_at").isNotNull() & (F.col("bad_at") >= WIDEST * F.col("room"))
    rows = rows.withColumn("cut", F.when(F.col("bad_at").isNull(), F.col("chars") > F.col("room")).otherwise(cut_short)).where(F.col("bad_at").isNull() | F.col("cut"))
    end = rows.where("cut").groupBy("id").agg(F.min("pos").alias("end"))
    kept = rows.join(end, "id", "left").where("end is null or pos <= end")
    said = F.substring(text_prefix("content", WIDEST * F.col("room")), F.lit(1), F.col("room").cast("int"))
    texts = kept.select("id", "pos", "cut", said.alias("said")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("t"), F.max("cut").alias("truncated"))
    joined = F.array_join(F.filter(F.transform("t", lambda x: x["said"]), lambda x: x != ""), SEPARATOR)
    ids = parts.select("id").distinct()
    return ids.join(texts.select("id", joined.alias("text"), "truncated"), "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("truncated", F.lit(most <= 0)).alias("truncated"))
