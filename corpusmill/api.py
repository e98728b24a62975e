"""The search service's calls as functions over DataFrames: stats, search, detail and file info."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text
from .operators import search as engine
from .operators.index import TextIndex

#: Legal values of the level filter; others filter nothing.
LEVELS = ("1a_instancia", "2a_instancia")


@dataclass
class Corpus:
    """Decisions with an id, a text, fields with static points, and citations that point to them."""

    docs: DataFrame
    key: str = "file_id"
    body: str = "texto"
    level: str = "instancia"
    fields: dict[str, str] = field(default_factory=lambda: {"title": "nome_arquivo", "subject": "assunto"})
    citations: DataFrame | None = None
    citation_key: str = "voto_file_id"
    rejected: DataFrame | None = None
    #: Kept up beside docs over searched_text(); without it every search reads all texts.
    index: TextIndex | None = None

    def stats(self) -> DataFrame:
        """One row: decisions, citations, rejections."""
        count = lambda df: (F.lit(0).cast("long") if df is None else df.agg(F.count("*")).scalar())
        return self.docs.agg(F.count("*").alias("decisions")).select("decisions", count(self.citations).alias("citations"), count(self.rejected).alias("rejections"))

    def searched_text(self) -> Column:
        return F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in [*self.fields.values(), self.body]])

    def search(self, query: str = "", mode: str = "phrase", level: str = "", month: str = "", year: str = "", limit: int = engine.LIMIT, offset: int = 0, newest: str | None = None) -> DataFrame:
        """A page of full-text results with rank and snippet; without query and date, the newest documents.

        `any` means words, as it does in the service. A date is a further phrase that must occur.
        """
        inside = F.col(self.level) == level if level in LEVELS else None
        docs = self.docs if inside is None else self.docs.where(inside)
        date = text.date_phrase(month, year)
        if not query.strip() and not date:
            order = [F.desc(newest), F.col(self.key)] if newest else [F.col(self.key)]
            return engine.page(docs.withColumns({"snippet": F.substring(self.body, 1, text.WINDOW), "rank": F.lit(0.0)}), order, limit, offset)
        parts = [p for p in ((query, "phrase" if mode == "phrase" else "words"), (date, "phrase")) if p[0].strip()]
        ranked = None
        for words, how in parts:
            if self.index is not None:
                one = self.index.search(words, how, None if inside is None else docs)
            else:
                one = engine.search_full_text(self.docs, self.key, self.searched_text(), words, how, inside)
            ranked = one if ranked is None else ranked.join(one.withColumnRenamed("rank", "_more"), self.key).select(self.key, (F.col("rank") + F.col("_more")).alias("rank"))
        top = engine.page(ranked, [F.col("rank"), F.col(self.key)], limit, offset)
        words = [w for p, _ in parts for w in engine.query_terms(p)]
        return docs.join(F.broadcast(top), self.key).withColumn("snippet", text.token_snippet(F.col(self.body), words, text.TOKENS, *map(F.col, self.fields.values()))).orderBy("rank", self.key)  # a page at most

    def detail(self, id: object) -> DataFrame:
        """The document of an id with a preview and its citations; no row if there is none."""
        one = self.docs.where(F.col(self.key) == F.lit(id)).withColumn("preview", F.substring(self.body, 1, text.WINDOW)).drop(self.body)
        if self.citations is None:
            return one
        own = self.citations.where(F.col(self.citation_key) == F.lit(id)).agg(F.array_sort(F.collect_list(F.struct(*[c for c in self.citations.columns if c != self.citation_key]))).alias("citations")).scalar()
        return one.withColumn("citations", own)

    def file(self, id: object, path: str, root: str) -> DataFrame:
        """Where a document's file is and how it is sent; `allowed` is false for a path outside root."""
        clean = F.regexp_replace(F.col(path), "/+", "/")
        return self.docs.where(F.col(self.key) == F.lit(id)).select(self.key, clean.alias("path"), text.disposition(clean).alias("disposition"), (clean.startswith(root.rstrip("/") + "/") & ~clean.rlike("(^|/)\\.\\.(/|$)")).alias("allowed"))
