"""Two search dialects over documents: static (substring) and full-text (token) search, with scores and pages.

Static: terms are folded runs of letters and digits; a phrase is a folded substring. Full-text: tokens of the same fold,
every query word is a prefix, all must match, or the words form a phrase of consecutive tokens; ranked by BM25.

operators.index keeps postings for corpora that are asked often. search_full_text() here is for those that aren't: it reads
every text, matches its tokens by array functions, and only hits and lengths leave the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold, folded, terms

LIMIT, MOST = 50, 100
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def query_terms(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", folded(query))


def clamp(limit: int, offset: int) -> tuple[int, int]:
    """Page sizes are 1 to 100, offsets not negative."""
    return max(1, min(int(limit), MOST)), max(0, int(offset))


def page(df: DataFrame, order: list[Column], limit: int = LIMIT, offset: int = 0) -> DataFrame:
    n, skip = clamp(limit, offset)
    return df.orderBy(*order).offset(skip).limit(n)


# Points for a hit in a field: (whole phrase, one term of a phrase, one term of words).
DECISION_POINTS = {"title": (30, 2, 10), "subject": (22, 2, 7), "citations": (16, 1, 5)}
OPINION_POINTS = {"title": (30, 2, 10), "folder": (16, 1, 4)}


def static_score(blob: Column, fields: dict[str, Column], query: str, mode: str = "words", points: dict = DECISION_POINTS, date: str = "") -> Column:
    """Integer score over folded columns; 0 for no match. Repeated terms count again."""
    words, phrase = query_terms(query), folded(query).strip()
    dated = F.contains(blob, F.lit(folded(date))) if date else F.lit(True)
    if not words:
        return F.when(dated, F.lit(1)).otherwise(F.lit(0))
    one = lambda field, text, n: F.when(field.contains(text), n).otherwise(0)
    if mode == "phrase":
        found = blob.contains(phrase)
        total = F.lit(8 + len(words))
        for name, field in fields.items():
            total = total + one(field, phrase, points[name][0])
            for word in words:
                total = total + one(field, word, points[name][1])
    else:
        found, total = F.lit(True), F.lit(len(words))
        for word in words:
            found = found & blob.contains(word)
            for name, field in fields.items():
                total = total + one(field, word, points[name][2])
    return F.when(dated & found, total).otherwise(F.lit(0))


def search_static(docs: DataFrame, text: Column, fields: dict[str, Column], query: str, mode: str = "words", points: dict = DECISION_POINTS, date: str = "") -> DataFrame:
    """docs with `score`, where it is over 0."""
    folds = {f"_f_{k}": fold(v) for k, v in fields.items()}
    scored = docs.withColumns({"_blob": fold(text), **folds})
    score = static_score(F.col("_blob"), {k: F.col(f"_f_{k}") for k in fields}, query, mode, points, date)
    return scored.withColumn("score", score).where("score > 0").drop("_blob", *folds)


def phrase_hits(tokens: Column, words: list[str]) -> Column:
    """How often words occur as consecutive tokens."""
    places = F.sequence(F.lit(0), F.size(tokens) - len(words))
    same = lambda i: F.slice(tokens, i + 1, F.lit(len(words))) == F.array(*map(F.lit, words))
    return F.when(F.size(tokens) < len(words), F.lit(0)).otherwise(F.size(F.filter(places, same)))


def prefix_hits(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t.startswith(word)))


def measured(tokens: Column, words: list[str], mode: str) -> Column:
    """An array of one struct: the token count and each part's hits; the lambda binds the tokens, so they are made once."""
    parts = (lambda t: [phrase_hits(t, words)]) if mode == "phrase" else (lambda t: [prefix_hits(t, w) for w in words])
    return F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("d"), *[p.alias(f"f{i}") for i, p in enumerate(parts(t))]))


def search_full_text(docs: DataFrame, key: str, text: Column, query: str, mode: str = "words", where: Column | None = None) -> DataFrame:
    """key and rank (BM25, lower is better) of the documents that match; statistics are those of all docs.

    An empty or punctuation-only query matches nothing.
    """
    words = query_terms(query)
    if not words:
        return docs.select(F.col(key), F.lit(0.0).alias("rank")).where(F.lit(False))
    n_parts = 1 if mode == "phrase" else len(words)
    own = docs if where is None else docs.where(where)
    measure = measured(terms(F.coalesce(text, F.lit(""))), words, mode)
    every = docs.select(F.explode(measure).alias("m")).select("m.*")
    stats = every.agg(F.struct(F.count("*").alias("_n"), F.avg("d").alias("_avg"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"_n{i}") for i in range(n_parts)]).alias("_s")).scalar()

    def matches(m: Column) -> Column:
        found = m["f0"] > 0
        for i in range(1, n_parts):
            found = found & (m[f"f{i}"] > 0)
        return found

    # the condition sits inside the generator: a filter would be pushed below and make the tokens again
    found = own.select(F.col(key), F.explode(F.filter(measure, matches)).alias("_m")).select(key, F.col("_m.d").alias("_d"), *[F.col(f"_m.f{i}").alias(f"_f{i}") for i in range(n_parts)]).withColumn("_s", stats)
    rank = bm25([F.col(f"_f{i}") for i in range(n_parts)], [F.col(f"_s._n{i}") for i in range(n_parts)], F.col("_d"), F.col("_s._n"), F.col("_s._avg"))
    return found.select(key, rank.alias("rank"))


def bm25(hits: list[Column], holders: list[Column], length: Column, docs: Column, mean: Column) -> Column:
    """Lower is better. Of each part of a query: its hits in the document and how many documents hold it."""
    rank = F.lit(0.0)
    for f, n in zip(hits, holders, strict=True):
        idf = F.log((docs - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        rank = rank - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
    return rank
