"""Ranked lexical search under a row-level ceiling: BM25 with phrases, then substrings, then character pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemora.checkpoints import cut
from mnemora.functions import text as T
from mnemora.functions.labels import authorized

MOST_TERMS, MOST_CHARS, MOST_ROWS = 32, 4096, 100
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET = 320


def terms_of(query: str) -> list[list[str]]:
    """The query's terms, each the tokens of a phrase; terms without tokens match nothing."""
    fold = str.maketrans(T.ACCENTED, T.FOLDED)
    out = []
    for term in re.findall(r"[\w.-]+", query)[:MOST_TERMS]:
        phrase = [t for t in re.split(r"[\W_]+", term.lower().translate(fold)) if t]
        if phrase:
            out.append(phrase)
    return out


def checked(query: str, limit: int) -> str:
    query = query.strip() if isinstance(query, str) else ""
    if not query or len(query) > MOST_CHARS or "\0" in query:
        raise ValueError("the query must be 1 to 4096 characters without NUL")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MOST_ROWS:
        raise ValueError("the limit must be 1 to 100")
    return query


def occurrences(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(tokens) - F.size(F.array_remove(tokens, phrase[0]))
    starts = F.when(F.size(tokens) >= len(phrase), F.sequence(F.lit(0), F.size(tokens) - len(phrase)))

    def here(i: Column) -> Column:
        out = F.get(tokens, i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            out = out & (F.get(tokens, i + k) == word)
        return out

    return F.coalesce(F.size(F.filter(starts, here)), F.lit(0))


def scored(counted: DataFrame, tf: list[str], n: int, avgdl: float | None, dfs, ceiling: str) -> DataFrame:
    """(id, rank, score) of counted(id, rank, dl, one count a term), where a term occurs; dfs has the documents of each term by its column."""
    score = F.lit(0.0)
    for name in tf:
        idf = F.greatest(F.log((F.lit(float(n)) - dfs[name] + 0.5) / (dfs[name] + 0.5)), F.lit(LEAST_IDF))
        norm = K1 * (1 - B + B * F.col("dl") / float(avgdl or 1))
        score = score + idf * F.col(name) * (K1 + 1) / (F.col(name) + norm)
    return authorized(counted, ceiling).where(F.greatest(*[F.col(name) for name in tf], F.lit(0)) > 0).select("id", "rank", score.alias("score"))


def bm25(docs: DataFrame, query: str, ceiling: str, text: str = "text", title: str | None = None) -> DataFrame:
    """(id, rank, score) of docs(id, rank, text) that hold a term; a title counts like the text, but no phrase runs from one into the other.

    One pass over the texts writes each document's counts, a few numbers a row. Corpus counts cover hidden rows too and
    come from those, as do the scores: no text is read twice, no postings are shuffled.
    """
    phrases = terms_of(query)
    if not phrases:
        return docs.where("false").select("id", "rank", F.lit(0.0).alias("score"))
    own = T.tokens(F.coalesce(F.col(text), F.lit("")))
    if title is not None:
        own = F.concat(T.tokens(F.coalesce(F.col(title), F.lit(""))), F.array(F.lit("\0")), own)
    tf = [f"tf{i}" for i in range(len(phrases))]
    split = docs.select("id", "rank", own.alias("t"))
    counted = cut(split.select("id", "rank", (F.size("t") - int(title is not None)).alias("dl"), *[occurrences(F.col("t"), p).alias(n) for n, p in zip(tf, phrases)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(n) > 0).alias(n) for n in tf]).first()
    return scored(counted, tf, stats.n, stats.avgdl, stats, ceiling)


def snippets(hits: DataFrame, query: str, text: str = "text", most: int = 32, marks: tuple[str, str] = ("[", "]"), cut_mark: str = " … ") -> DataFrame:
    """hits with `snippet`: the window of `most` words of the text that holds most terms of the query, the earliest of equal ones,
    beginning at its first hit where the text goes on far enough; terms stand between marks, a cut-off side ends in cut_mark.

    One small helper a row, for the few rows of a result.
    """
    phrases = [tuple(p) for p in terms_of(query)]
    fold = str.maketrans(T.ACCENTED, T.FOLDED)

    def one(said) -> str:
        said = said or ""
        spots = [(m.start(), m.end(), m[0].lower().translate(fold)) for m in re.finditer(r"[^\W_]+", said)]
        words = [w for *_, w in spots]
        hit = [(i, i + len(p), k) for k, p in enumerate(phrases) for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p]
        last = max(0, len(words) - most)
        first = max(sorted({min(i, last) for i, *_ in hit} | {0}), key=lambda s: (len({k for a, b, k in hit if s <= a and b <= s + most}), -s))
        end = min(len(words), first + most)
        inside = {i for a, b, _ in hit if first <= a and b <= end for i in range(a, b)}
        out, at = [cut_mark if first else said[: spots[0][0]] if spots else said], spots[first][0] if spots else 0
        for i in range(first, end):
            a, b, _ = spots[i]
            out.append(said[at:a] + (marks[0] + said[a:b] + marks[1] if i in inside else said[a:b]))
            at = b
        if spots:
            out.append(cut_mark if end < len(words) else said[at:])
        return "".join(out)

    make = F.pandas_udf(lambda col: col.map(one), StringType())
    return hits.withColumn("snippet", make(F.col(text)))


def like(docs: DataFrame, query: str, ceiling: str, text: str = "text", title: str | None = None) -> DataFrame:
    """(id, rank, score) of docs whose text or title holds the query as it is spelt."""
    found = T.contains_folded(F.col(text), query)
    if title is not None:
        found = F.coalesce(found, F.lit(False)) | F.coalesce(T.contains_folded(F.col(title), query), F.lit(False))
    return authorized(docs, ceiling).where(found).select("id", "rank", F.lit(0.0).alias("score"))


def python_bigrams(query: str) -> list[str]:
    kept = "".join(c.lower() for c in query if c.isalnum())
    return sorted({kept[i : i + 2] for i in range(max(1, len(kept) - 1))}) if kept else []


def gram_overlap(docs: DataFrame, query: str, ceiling: str, text: str = "text", most: int | None = None) -> DataFrame:
    """(id, rank, score) of docs that hold at least half of the query's character pairs, with the share as `score`. Row by row."""
    grams = python_bigrams(query)
    if not grams:
        return docs.where("false").select("id", "rank", F.lit(0.0).alias("score"))
    # a document of one character is the gram of that character only; the text is cleaned once, in the array that is passed through
    alone, pairs = [F.lit(g) for g in grams if len(g) == 1], [F.lit(g) for g in grams if len(g) > 1]
    none = F.expr("cast(array() as array<string>)")
    hits = F.transform(
        F.array(T.alnum(F.col(text), most)),
        lambda p: F.when(F.length(p) > 1, F.size(F.filter(F.array(*pairs) if pairs else none, lambda g: F.contains(p, g)))).otherwise(F.size(F.filter(F.array(*alone) if alone else none, lambda g: p == g))),
    )
    found = authorized(docs, ceiling).select("id", "rank", F.get(hits, F.lit(0)).alias("__hits")).where(F.col("__hits") >= max(1, (len(grams) + 1) // 2))
    return found.select("id", "rank", (F.col("__hits") / len(grams)).alias("score"))


def top(scored: DataFrame, fetch: int, tier: int) -> DataFrame:
    """The best `fetch` rows with tier and place; at most 400 rows meet."""
    best = scored.orderBy(F.desc("score"), "id").limit(fetch)
    return best.withColumn("tier", F.lit(tier)).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def search(docs: DataFrame, query: str, limit: int = 10, ceiling: str = "personal", grams: bool | None = None, title: str | None = None, windows: bool = False) -> DataFrame:
    """(id, snippet, rank, score, tier) of docs(id, rank, text), best first. Scores of different tiers do not compare: the tier
    decides. Substrings count only where BM25 leaves room, character pairs only for CJK queries (or where grams says so).

    Each tier hands on at most 400 ids; texts are fetched for the rows of the result only. A snippet is the beginning of
    the text, or with `windows` the part of it that holds the hits of the first tier.
    """
    query = checked(query, limit)
    fetch = min(4 * MOST_ROWS, 4 * limit)
    spark = docs.sparkSession
    scored = top(bm25(docs, query, ceiling, title=title), fetch, 1)
    found = scored.collect()  # at most 400 rows of numbers
    tiers = spark.createDataFrame(found, scored.schema)
    if len(found) < fetch:
        tiers = tiers.unionByName(top(like(docs, query, ceiling, title=title), fetch, 2))
    cjk = re.search("[぀-ヿ㐀-䶿一-鿿豈-﫿]", query) is not None
    if cjk if grams is None else grams:
        tiers = tiers.unionByName(top(gram_overlap(docs, query, ceiling), fetch, 3))
    first = F.row_number().over(W.partitionBy("id").orderBy("tier", "place"))
    once = tiers.withColumn("__n", first).where("__n = 1").orderBy("tier", "place").limit(limit)
    rows = docs.select("id", "text").join(F.broadcast(once), "id").withColumn("snippet", F.substring("text", 1, SNIPPET))
    if windows:
        rows = snippets(rows.where("tier = 1"), query).unionByName(rows.where("tier > 1"))
    return rows.select("id", "snippet", "rank", "score", "tier", "place").orderBy("tier", "place")
