"""Thin queries over the operators of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, maxent, merkle, near_dups, oracles, packing, repeats, secrets, spelling, topk, toxicity, url_rules
from .common import table

SITES = [url_rules.site_rule("net/", "block"), url_rules.site_rule("example.net/en/", "allow"), url_rules.site_rule("example.com/de/", "block"), url_rules.site_rule("org/fr/", "allow")]
# The query's own list of patterns, for urls that no site rule decides.
PATTERN_LIST = """
! hosts by a label
||casino.
||bets.
||pills.
||viagra.
||porn.
||adult.
||malware.
||spam-*.example.org^
! paths of advertising, downloads and endless listings
/ads/
/ads/*/banner^
||track.*/pixel^
/banner/*/click|
.torrent|
/torrent/*/download^
/calendar/*/print|
^sessionid=
! mirrors of blogs, but for their English pages
||blog.*.example.org/*.html|
||blog.thther.example.com/
@@||blog.*.example.org/en/
@@||www.example.org/ads/
"""
PATTERNS = url_rules.pattern_rules(PATTERN_LIST.splitlines())

# Fixed value: the added token of byte_bpe_50k.json, which tokenizers takes as one id even without special tokens.
SPECIAL = {"<|endoftext|>": 50256}

# The chain's categories over `labels`, in order; the last decides.
CHAIN = {"low_quality": "quality = 0", "toxic": "toxic"}


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = secrets.listed(F.filter("spans", lambda s: s["kind"] < len(secrets.BASE)))
    return found.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)], F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), CHAIN)).withColumnRenamed("flagged", "toxic")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), special=SPECIAL)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), 75, 100)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64.0)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find(table(spark, sf_dir, "documents"), 35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_rules.judge(table(spark, sf_dir, "pages"), SITES + PATTERNS)
    return out.select("page_id", "host", "path", F.when(F.col("rank") == url_rules.SITE, F.col("rule")).alias("rule"), "verdict")


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.edited_pairs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), 10, 2000)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def pattern_verdict(text: str) -> str:
    """SQL for the verdict of PATTERNS on an expression: all of them run, in the order of precedence."""
    text = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    regexes = [(rule.verdict, rule.plain.replace("\\Z", "\\z").replace("'", "''")) for rule in sorted(PATTERNS, key=lambda r: (-r.rank, -len(r.name), r.name))]
    return " ".join(f"WHEN regexp_matches({text}, '{regex}', 's') THEN '{verdict}'" for verdict, regex in regexes)


OP9_SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM cut
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    {pattern_verdict("host || path")}
    ELSE 'allow' END AS verdict
FROM ruled
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_packing, op4_byte_bpe, op5_near_dups, op6_top_k, op7_repeats, op8_maxent, op9_url_rules, op10_merkle, op11_spelling, op12_collocations, op13_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dups": oracles.OP5_SQL, "op6_top_k": oracles.OP6_SQL, "op7_repeats": oracles.OP7_SQL, "op9_url_rules": OP9_SQL, "op11_spelling": oracles.OP11_SQL, "op12_collocations": oracles.OP12_SQL, "op13_decontaminate": oracles.OP13_SQL}
