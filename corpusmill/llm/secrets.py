"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a text is content-addressed by its SHA-256. The ledger is a folder of two Parquet tables: `seen` (blob,
rules) and `findings` (blob, rules, spans). A scan takes the blobs that the ledger lacks for this version of the rules,
scans one version of each, appends both tables, and joins the findings back to all versions. A rule set's version is a digest
of its rules, so another set never meets the findings of this one. A ledger that already holds the table is not scanned again.

Only one version of a blob crosses the shuffle with its text; the join is on (key, blob), so a blob with very many
versions meets in no task. Findings go back by a join on the blob, for which the rows of blobs with very many versions (by
their counts) are dealt to as many tasks as it takes.

Places are added up in blocks of matches, so that the time for a text is in proportion to it, whatever it holds.

Null text: empty. Very long texts: one row is one task's work. Spans are 0-based code points, end exclusive, by start and then rule. Repeated rows stay. Ties (many
versions of one blob): all of them get the same spans. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import between, bound, chunked, running
from .common import materialize, shared_folder, split_join

SALTS = 16
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret; group and least: a match counts if that group has so many characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The contract's three kinds, then those that this scan adds.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + MORE


def rules_version(rules: list[Rule]) -> str:
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()


def spans_of(text: Column, number: int, rule: Rule) -> Column:
    """The spans of one rule: what lies between matches is text split by the pattern, so lengths add up to places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    wanted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), wanted.alias("part"))

    def step(at: Column, match: Column) -> tuple[Column, Column]:
        low = at + F.length(match["gap"])
        high = low + F.length(match["hit"])
        return high, F.struct(low.alias("start"), F.lit(number).alias("kind"), F.when(F.length(match["part"]) >= rule.least, high).alias("end"))

    spans = running(steps, F.lit(0), step, "struct<start:int,kind:int,end:int>")["out"]
    return F.when(text.rlike(rule.pattern), F.filter(spans, lambda s: s["end"].isNotNull())).otherwise(F.array().cast(SPANS))


def all_spans(text: Column, rules: list[Rule] = RULES) -> Column:
    return F.array_sort(F.concat(*[spans_of(text, i, rule) for i, rule in enumerate(rules)]))


def listed(spans: Column, rules: list[Rule] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(versions: DataFrame, key: str, ledger: str | None, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Brings the ledger up to date with versions; (blob, n) of their blobs, and (blob, spans) of all that have findings."""
    spark = versions.sparkSession
    ledger, version = ledger or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", rules_version(rules)
    own = addressed(versions).select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"), "blob")
    # a blob that many tasks hold is counted in two steps, by groups of tasks first
    counted = own.groupBy("blob", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("part")).agg(F.min("key").alias("key"), F.count("*").alias("n"))
    blobs = materialize(counted.groupBy("blob").agg(F.min("key").alias("key"), F.sum("n").alias("n")), "blobs")
    unseen = blobs
    schema = f"blob binary, rules string, spans {SPANS}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/seen")
    if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        seen = spark.read.schema("blob binary, rules string").parquet(f"{ledger}/seen").where(F.col("rules") == version)
        unseen = blobs.join(seen, "blob", "left_anti")
    one = own.alias("o").join(unseen.alias("u"), (F.col("o.blob") == F.col("u.blob")) & F.col("o.key").eqNullSafe(F.col("u.key"))).select("o.blob", "o.text", "u.n")
    # the spans depend on the ledger's side, so that no rule is pushed below the join and run on known blobs
    spans = F.when(F.col("n") > 0, all_spans(F.col("text"), rules))
    told = one.select("blob", F.lit(version).alias("rules"), spans.alias("spans")).where(F.size("spans") > 0)
    told.write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", F.lit(version).alias("rules")).write.mode("append").parquet(f"{ledger}/seen")
    findings = spark.read.schema(schema).parquet(f"{ledger}/findings").where(F.col("rules") == version).select("blob", "spans").dropDuplicates(["blob"])
    return blobs.select("blob", "n"), findings


def addressed(versions: DataFrame) -> DataFrame:
    """versions with blob, the SHA-256 of their text."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))


def with_spans(rows: DataFrame, key: Column, blobs: DataFrame, findings: DataFrame) -> DataFrame:
    """rows (with blob) and the spans of their blob, null without any; a blob with very many rows is dealt to many tasks."""
    # rows of one key are told apart by their tasks, as null keys may be many
    salted = rows.withColumn("salt", F.xxhash64(key, F.spark_partition_id()))
    return split_join(salted, findings, "blob", blobs, F.col("salt"), "left").drop("salt")


def scan(versions: DataFrame, key: str = "doc_id", ledger: str | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """key, blob (binary), spans of every version; ledger: the folder that earlier scans have filled, or None for a new one."""
    own = versions.select(F.col(key).alias("key"), "text")
    told = with_spans(addressed(own).select("key", "blob"), F.col("key"), *scanned(own, "key", ledger, rules))
    return told.select(F.col("key").alias(key), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by mark."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.struct(at.alias("low"), F.when(s["start"] >= at, s["start"]).alias("high"))

    def whole(made: Column) -> Column:
        gaps = F.filter(made["out"], lambda g: g["high"].isNotNull())
        every = F.concat(gaps, F.array(F.struct(made["state"].alias("low"), F.length(text).alias("high"))))
        pieces = lambda x: F.array_join(F.transform(x["gaps"], lambda g: between(x["chunks"], g["low"], g["high"])), mark)
        return bound(F.struct(every.alias("gaps"), chunked(text).alias("chunks")), pieces)

    return bound(running(spans, F.lit(0), step, "struct<low:int,high:int>"), whole)


def redact(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of docs with all their columns, secrets masked; null text stays null.

    The ledger's findings come back by content address, so equal texts are scanned once.
    """
    columns = docs.columns
    own = docs.select(F.col("doc_id").alias("key"), "text")
    rows = addressed(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("all"))).select("blob", "all")
    told = with_spans(rows, F.col("all")["doc_id"], *scanned(own, "key", None, rules))
    text = F.when(F.col("spans").isNotNull(), masked(F.col("all")["text"], F.col("spans"))).otherwise(F.col("all")["text"])
    return told.select(*[(text if c == "text" else F.col("all")[c]).alias(c) for c in columns])
