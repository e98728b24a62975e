"""Search queries in both dialects, pages and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export, index, search, state
from ..session import shared_folder
from ..sources.tables import load
from .registry import query


def _fields() -> dict:
    return {"title": F.col("source"), "subject": F.substring_index("text", "\n", 1), "citations": F.col("lang")}


_FOLDS = "SELECT doc_id, lower(strip_accents(text)) AS b, lower(strip_accents(source)) AS t, lower(strip_accents(split_part(text, chr(10), 1))) AS s, lower(strip_accents(lang)) AS a FROM documents"


def _points(term: str, title: int, subject: int, citations: int) -> str:
    return f"(CASE WHEN contains(t, '{term}') THEN {title} ELSE 0 END + CASE WHEN contains(s, '{term}') THEN {subject} ELSE 0 END + CASE WHEN contains(a, '{term}') THEN {citations} ELSE 0 END)"


@query(f"""WITH f AS ({_FOLDS}) SELECT doc_id, 2 + {_points("tion", 10, 7, 5)} + {_points("en", 10, 7, 5)} AS score FROM f WHERE contains(b, 'tion') AND contains(b, 'en') ORDER BY score DESC, doc_id LIMIT 50""")
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: fold, all-terms filter, weighted score, top page."""
    found = search.search_static(load(spark, sf_dir, "documents"), F.col("text"), _fields(), "Tión EN")
    return search.page(found, [F.desc("score"), F.col("doc_id")]).select("doc_id", "score")


@query(f"""WITH f AS ({_FOLDS}) SELECT doc_id, 8 + 3 + {_points("general public license", 30, 22, 16)} + {_points("general", 2, 2, 1)} + {_points("public", 2, 2, 1)} + {_points("license", 2, 2, 1)} AS score FROM f WHERE contains(b, 'general public license')""")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_static(load(spark, sf_dir, "documents"), F.col("text"), _fields(), "General Public License", "phrase").select("doc_id", "score")


@query("SELECT doc_id, 1 AS score FROM (SELECT doc_id, lower(strip_accents(text)) AS b FROM documents) WHERE contains(b, 'license de 2099') OR contains(b, 'de la')")
def date_phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    one = search.search_static(docs, F.col("text"), {}, "", date="license de 2099").select("doc_id", "score")
    other = search.search_static(docs, F.col("text"), {}, "", date="De  lÁ".replace("  ", " ")).select("doc_id", "score")
    return one.union(other).distinct()


_TOKENS = r"SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS t FROM documents"


def _index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    return index.of_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def _bm25(parts: list[str]) -> str:
    n = len(parts)
    cols = ", ".join(f"{p} AS f{i}" for i, p in enumerate(parts))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(n))
    idf = lambda i: f"(CASE WHEN ln((c - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((c - n{i} + 0.5) / (n{i} + 0.5)) END)"
    rank = " ".join(f"- {idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / a))" for i in range(n))
    return f"""WITH k AS ({_TOKENS}), h AS (SELECT doc_id, len(t) AS d, {cols} FROM k), s AS (SELECT count(*) AS c, avg(d) AS a, {stats} FROM h),
    r AS (SELECT doc_id, round(0.0 {rank}, 6) AS rank FROM h, s WHERE {" AND ".join(f"f{i} > 0" for i in range(n))}) SELECT doc_id, rank FROM r"""


@query(_bm25(["len(list_filter(t, lambda x: starts_with(x, 'lice')))", "len(list_filter(t, lambda x: starts_with(x, 'th')))"]) + " ORDER BY rank, doc_id LIMIT 20")
def search_fts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _index(spark, sf_dir).search("Licé, th").withColumn("rank", F.round("rank", 6))
    return search.page(ranked, [F.col("rank"), F.col("doc_id")], 20)


@query(_bm25(["len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'general' AND t[i + 1] = 'public' AND t[i + 2] = 'license'))"]))
def search_fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search("general-public license", "phrase").withColumn("rank", F.round("rank", 6))


@query("SELECT o_orderkey, o_orderdate::date::varchar AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10")
def latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(load(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 10).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, ceil((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') / 100.0)::bigint AS pages FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100 OFFSET 0")
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 500 from -5 is clamped to 100 from 0; the total comes from one aggregate row."""
    found = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    total = found.agg(F.count("*").alias("total")).scalar()
    rows = search.page(found.select("o_orderkey"), [F.col("o_orderkey")], 500, -5)
    return rows.withColumn("total", total).select("o_orderkey", "total", F.ceil(F.col("total") / 100).alias("pages"))


@query("SELECT source AS category, count(*) AS n, count(DISTINCT lang) AS folders FROM documents GROUP BY source")
def category_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"), F.countDistinct("lang").alias("folders"))


@query("""SELECT DISTINCT p_name AS name, dense_rank() OVER (ORDER BY p_name) AS place FROM part""")
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names and their places in the locale's order, counted by ranges of names."""
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return state.numbered(names, [], [export.in_locale(F.col("name")), F.col("name")], "place")


@query("""SELECT d.doc_id, substr(d.text, 1, 420) AS preview, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id = 16""")
def decision_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = load(spark, sf_dir, "documents").where("doc_id = 16")
    return one.join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.substring("text", 1, 420).alias("preview"), "toxic")


_BOTH = [f"len(list_filter(t, lambda x: starts_with(x, '{w}')))" for w in ("lice", "th")]


@query(rf"""WITH top AS ({_bm25(_BOTH)} ORDER BY rank, doc_id LIMIT 20),
d AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS tok, string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS gap FROM documents JOIN top USING (doc_id)),
w AS (SELECT *, len(tok) AS n, list_transform(tok, lambda t: CASE WHEN starts_with(lower(strip_accents(t)), 'lice') THEN 0 WHEN starts_with(lower(strip_accents(t)), 'th') THEN 1 END) AS w FROM d),
b AS (SELECT *, list_sort(list_transform(list_filter(range(1, n + 1), lambda i: w[i] IS NOT NULL), lambda i: {{'f': -len(list_distinct(w[i:i + 41])), 'i': i}}))[1].i AS i FROM w),
c AS (SELECT *, greatest(0, least(i - 1, n - 42)) AS low FROM b)
SELECT doc_id, (CASE WHEN low > 0 THEN '...' ELSE gap[1] END) || array_to_string(list_transform(range(low + 1, least(low + 42, n) + 1), lambda i: (CASE WHEN i > low + 1 THEN gap[i] ELSE '' END) || (CASE WHEN w[i] IS NOT NULL THEN '<mark>' || tok[i] || '</mark>' ELSE tok[i] END)), '') || (CASE WHEN low + 42 < n THEN '...' ELSE gap[n + 1] END) AS snippet FROM c""")
def fts_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best windows of a page of results, found by the places of its words in the index."""
    docs, own = load(spark, sf_dir, "documents").select("doc_id", "text"), _index(spark, sf_dir)
    ranked = own.search("lice th").withColumn("rank", F.round("rank", 6))
    top = search.page(ranked, [F.col("rank"), F.col("doc_id")], 20)
    return own.snippets(top, docs, F.col("text"), "lice th").select("doc_id", "snippet")


_LIVE = r"""k AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(CASE WHEN lang = 'fr' THEN text || ' licens' ELSE text END)), '[\p{L}\p{N}]+') AS t FROM documents WHERE lang <> 'de')"""


@query(_bm25(["len(list_filter(t, lambda x: starts_with(x, 'licens')))"]).replace(f"k AS ({_TOKENS})", _LIVE))
def fts_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after half of the documents came in later, French ones came again with other texts, and German ones went."""
    docs = load(spark, sf_dir, "documents")
    own = index.TextIndex(spark, shared_folder(spark, "index"), "doc_id")
    own.put(docs.where("doc_id % 2 = 0"), F.col("text"))
    own.add(docs, F.col("text"))
    french = docs.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit(" licens")))
    own.saved(french, F.col("text"), docs.where("lang = 'de'"))
    return own.search("licens").withColumn("rank", F.round("rank", 6))
