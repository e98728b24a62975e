"""State, change capture, trees, fan-out, export and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, naming
from ..operators import export, state, trees
from ..sources import lookup
from ..sources.tables import load
from ..session import shared_folder
from ..streaming import feed as feeds
from ..streaming import incremental
from .registry import query


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM conversations) AS turns""")
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda name: load(spark, sf_dir, name).agg(F.count("*")).scalar()
    sizes = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"))
    return sizes.select(count("documents").alias("documents"), count("labels").alias("labels"), "conversations", "turns")


@query("""WITH RECURSIVE b AS (SELECT p_name AS path, p_partkey FROM part UNION ALL SELECT p_name || ' (1)', p_partkey + 1000000 FROM part WHERE p_partkey % 97 = 0 UNION ALL SELECT p_name || ' (3)', p_partkey + 2000000 FROM part WHERE p_partkey % 89 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p_partkey) - 1 AS i FROM b),
m AS (SELECT path, max(i) AS most FROM n GROUP BY path),
f AS (SELECT path, u, row_number() OVER (PARTITION BY path ORDER BY u) AS i FROM (SELECT path, unnest(range(1, most + 1 + (SELECT count(DISTINCT path) FROM b WHERE starts_with(b.path, m.path || ' (')))) AS u FROM m WHERE most > 0) WHERE path || ' (' || u || ')' NOT IN (SELECT path FROM b))
SELECT p_partkey, CASE WHEN n.i = 0 THEN n.path ELSE n.path || ' (' || f.u || ')' END AS unique_name FROM n LEFT JOIN f ON f.path = n.path AND f.i = n.i""")
def unique_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    literal = lambda every, name, more: part.where(F.col("p_partkey") % every == 0).select(F.concat("p_name", F.lit(name)), F.col("p_partkey") + more)
    both = part.select(F.col("p_name").alias("path"), "p_partkey").union(literal(97, " (1)", 1_000_000)).union(literal(89, " (3)", 2_000_000))
    return state.unique_suffix(both, "path", [F.col("p_partkey")], F.col("path"), F.lit("")).select("p_partkey", "unique_name")


@query("""WITH r AS (SELECT user_id AS g, CAST(floor(value * 10) AS int) AS low, CAST(floor(value * 10) AS int) + 25 AS high FROM events),
p AS (SELECT *, max(high) OVER (PARTITION BY g ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR low > before THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM p)
SELECT g AS user_id, min(low) AS low, max(high) AS high FROM i GROUP BY g, island""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.floor(F.col("value") * 10).cast("int")
    ranges = load(spark, sf_dir, "events").select("user_id", low.alias("low"), (low + 25).alias("high"))
    return state.islands(ranges, ["user_id"], "low", "high")


@query("""SELECT o_orderkey, o_orderstatus, coalesce(c.items, '') AS items FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY l_orderkey) c ON l_orderkey = o_orderkey""")
def export_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = export.nested(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], [], "items")
    told = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), ",")
    return rows.select("o_orderkey", "o_orderstatus", told.alias("items"))


@query("SELECT source AS category, lang AS folder, doc_id::varchar AS name, coalesce(text, '') AS body FROM documents ORDER BY 1, 2, 3")
def opinions_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("source").alias("category"), F.col("lang").alias("folder"), F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("body")).orderBy("category", "folder", "name")


@query("SELECT DISTINCT p_brand AS protocol, p_type AS subject, p_name AS act FROM part WHERE p_brand <> 'Brand#1'")
def subject_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct triples that the file so far (those of one brand) lacks."""
    rows = load(spark, sf_dir, "part").select(F.col("p_brand").alias("protocol"), F.col("p_type").alias("subject"), F.col("p_name").alias("act"))
    return state.insert_if_absent(rows.limit(0), rows.dropDuplicates().join(rows.where("protocol = 'Brand#1'").distinct(), rows.columns, "left_anti"), rows.columns)


@query("SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "labels").withColumn("_hit", F.lit(True))
    return load(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", "quality", "toxic", F.col("_hit").isNull().alias("missing"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not processed' WHEN l.toxic = 0 THEN 'none' ELSE 'pairs' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def pairs_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") > 0, F.array(F.struct(F.lit("LEI 1/01").alias("law"), F.lit("X").alias("act")))).alias("pairs"), F.lit(True).alias("_hit"))
    told = F.when(F.col("_hit").isNull(), "not processed").when(F.col("pairs").isNull(), "none").otherwise("pairs")
    return load(spark, sf_dir, "documents").select("doc_id").join(pairs, "doc_id", "left").select("doc_id", told.alias("state"))


@query("""WITH r AS (SELECT p_name, min(p_partkey) AS first_key, count(*) AS copies FROM part WHERE p_size < 20 GROUP BY p_name)
SELECT p.p_partkey, r.first_key AS match_key, coalesce(r.copies, 0) AS copies FROM part p LEFT JOIN r USING (p_name)""")
def name_match_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    names = part.where("p_size < 20").groupBy("p_name").agg(F.min("p_partkey").alias("match_key"), F.count("*").alias("copies"))
    return part.select("p_partkey", "p_name").join(names, "p_name", "left").select("p_partkey", "match_key", F.coalesce("copies", F.lit(0)).alias("copies"))


@query("SELECT count(*) AS records, count(l.doc_id) AS linked, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").withColumn("_hit", F.lit(1)), "doc_id", "left")
    return met.agg(F.count("*").alias("records"), F.count("_hit").alias("linked"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), "event_type", "event_id", "value")


_FEED = "SELECT user_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS modified, event_type, event_id, value FROM events"


@query(f"""WITH f AS ({_FEED}), s AS (SELECT id, min(event_id) AS event_id FROM f WHERE id % 3 = 0 GROUP BY id), c AS (SELECT id, max(event_id) AS event_id FROM f GROUP BY id)
SELECT * FROM s UNION ALL SELECT * FROM c WHERE id NOT IN (SELECT id FROM s)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feed(spark, sf_dir)
    held = f.where("id % 3 = 0").groupBy("id").agg(F.min("event_id").alias("event_id"))
    return state.insert_if_absent(held, f.groupBy("id").agg(F.max("event_id").alias("event_id")), ["id"])


@query(f"""WITH f AS ({_FEED}), l AS (SELECT * FROM f WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified DESC, event_id DESC) = 1),
s AS (SELECT id, min(event_id) AS event_id FROM f GROUP BY id)
SELECT id, event_id FROM l UNION ALL SELECT id, event_id FROM s WHERE id NOT IN (SELECT id FROM l)""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feed(spark, sf_dir)
    changes = f.where("event_type = 'click'").select("id", "event_id", "modified")
    latest = state.first_by(changes, ["id"], ["modified", "event_id"], last=True).select("id", "event_id")
    return state.upsert(f.groupBy("id").agg(F.min("event_id").alias("event_id")), latest, ["id"], ["event_id"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 100 FROM orders WHERE o_orderkey % 5 = 0) GROUP BY ALL""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = load(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    fresh = saved.withColumn("l_linenumber", F.lit(100))
    out = state.replace_children(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), fresh, saved, "l_orderkey")
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0 UNION SELECT doc_id FROM documents WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0),
r AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND doc_id % 11 <> 0 UNION SELECT doc_id FROM documents WHERE doc_id % 7 = 0)
SELECT doc_id, 'accepted' AS state FROM a UNION ALL SELECT doc_id, 'rejected' FROM r""")
def accept_reject_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "documents").select("doc_id")
    saves, skips = ids.where("doc_id % 11 = 0 and doc_id % 7 <> 0"), ids.where("doc_id % 7 = 0")
    accepted, rejected = state.accept_reject(ids.where("doc_id % 2 = 0"), ids.where("doc_id % 2 = 1"), saves, skips, "doc_id")
    return accepted.withColumn("state", F.lit("accepted")).union(rejected.withColumn("state", F.lit("rejected")))


@query("""WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 't' || doc_id END AS modified FROM documents WHERE doc_id % 2 = 0)
SELECT id, modified, 'pending' AS t FROM p WHERE id % 3 <> 0 UNION ALL SELECT id, modified, 'revision' FROM p WHERE id % 3 = 0 AND modified <> ''
UNION ALL SELECT doc_id, 'old', 'revision' FROM documents WHERE doc_id % 6 = 0 AND doc_id % 5 = 0""")
def ack_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    pending = ids.where("id % 2 = 0").withColumn("modified", F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))))
    left, revisions = state.acknowledge(pending, ids.where("id % 6 = 0").withColumn("modified", F.lit("old")), ids.where("id % 3 = 0"))
    return left.withColumn("t", F.lit("pending")).union(revisions.withColumn("t", F.lit("revision")))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feed(spark, sf_dir)
    revisions, known = f.where("event_id % 4 = 0").select("id", "modified"), f.where("event_id % 50 = 0").select("id")
    return state.classify_changes(f, revisions, known, F.col("id") % 10 != 3, F.col("event_type") != "error")


_CHANGES = f"""WITH f AS ({_FEED}), r AS (SELECT DISTINCT id, modified FROM f WHERE event_id % 4 = 0), k AS (SELECT DISTINCT id FROM f WHERE event_id % 50 = 0),
c AS (SELECT f.event_id, CASE WHEN event_type = 'error' THEN 'other type' WHEN r.id IS NOT NULL THEN 'unchanged' WHEN k.id IS NOT NULL THEN 'modified' WHEN f.id % 10 = 3 THEN 'out of scope' ELSE 'new' END AS change
FROM f LEFT JOIN r ON f.id = r.id AND f.modified = r.modified LEFT JOIN k ON f.id = k.id)"""


@query(_CHANGES + " SELECT event_id, change FROM c")
def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("event_id", "change")


@query(_CHANGES + " SELECT count(*) AS checked, count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'out of scope') AS out_of_scope FROM c")
def cdc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: F.count_if(F.col("change") == name).alias(name.replace(" ", "_"))
    return _changes(spark, sf_dir).agg(F.count("*").alias("checked"), *[one(x) for x in ("new", "modified", "unchanged", "out of scope")])


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed read twice by a stream; what comes again within the watermark is dropped."""
    return feeds.dedup_events(spark, f"{sf_dir}/events.parquet")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.first_by(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    return state.resume(load(spark, sf_dir, "documents").select("doc_id"), labels, labels.where("toxic = 1"), "doc_id")


@query("""WITH c AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS side FROM documents WHERE lang = 'en'),
p AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'accepted' ELSE 'rejected' END AS side FROM documents)
SELECT * FROM c UNION SELECT * FROM p WHERE id NOT IN (SELECT id FROM c)""")
def checkpoint_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    side = lambda n: F.when(F.col("id") % n == 0, "accepted").otherwise("rejected").alias("side")
    return state.merge_checkpoint(ids.where("lang = 'en'").select("id", side(2)), ids.select("id", side(4)))


@query("SELECT (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) = 0 AS complete, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS missing")
def index_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti")
    return missing.agg((F.count("*") == 0).alias("complete"), F.count("*").alias("missing"))


@query("SELECT DISTINCT l_returnflag AS level, 'LEI ' || l_suppkey || '_19' AS law, p_type AS act, l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey")
def fanout_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return export.fanout(lines, F.col("l_returnflag"), naming.law_folder(F.concat(F.lit("LEI "), F.col("l_suppkey").cast("string"), F.lit("/19"))), F.col("p_type"), F.col("l_orderkey"))


@query("SELECT l_returnflag, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL ORDER BY n DESC, l_returnflag, p_type LIMIT 12")
def top_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return export.top(lines, ["l_returnflag", "p_type"], 12)


@query("""WITH f AS (SELECT l_suppkey, l_shipmode, min(o) AS o FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, l_orderkey * 1000000 + l_partkey AS o FROM lineitem) GROUP BY ALL)
SELECT l_suppkey, string_agg(l_shipmode, ' | ' ORDER BY o, l_shipmode) AS joined FROM f GROUP BY l_suppkey""")
def distinct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("v"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("o"))
    return export.distinct_joined(lines, "l_suppkey", "v", "o")


@query("""SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY event_type""")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = by_type.agg(F.sum("n").alias("total")).scalar()
    return by_type.withColumn("total", total).select("event_type", "n", F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.nullif("total", F.lit(0))), 6).alias("percent"))


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1), c AS (SELECT day, sum(n) OVER (ORDER BY day) AS done, (SELECT count(*) FROM events) AS total, (epoch(day) - epoch((SELECT min(day) FROM d)) + 86400.0) AS s FROM d)
SELECT day::date::varchar AS day, done::bigint AS done, round(done / s, 6) AS rate, round(100.0 * done / total, 6) AS percent, round((total - done) / (done / s), 3) AS left_s,
CASE WHEN floor((total - done) / (done / s) / 3600) > 0 THEN floor((total - done) / (done / s))::bigint // 3600 || 'h' || lpad((floor((total - done) / (done / s))::bigint % 3600 // 60)::varchar, 2, '0') || 'm' || lpad((floor((total - done) / (done / s))::bigint % 60)::varchar, 2, '0') || 's'
WHEN floor((total - done) / (done / s) / 60) > 0 THEN (floor((total - done) / (done / s))::bigint // 60) || 'm' || lpad((floor((total - done) / (done / s))::bigint % 60)::varchar, 2, '0') || 's' ELSE floor((total - done) / (done / s))::bigint || 's' END AS eta FROM c""")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals over days: the rows are aggregated to one for each day before the window."""
    days = load(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seconds = (F.unix_timestamp("day") - F.unix_timestamp(F.min("day").over(w)) + 86400).cast("double")
    rows = days.select("day", F.sum("n").over(w).alias("done"), total.alias("total"), seconds.alias("s"))
    told = export.progress(F.col("done"), F.col("total"), F.col("s"))
    return rows.select(F.col("day").cast("date").cast("string").alias("day"), "done", F.round(told["rate"], 6).alias("rate"), F.round(told["percent"], 6).alias("percent"), F.round(told["left_s"], 3).alias("left_s"), export.duration(told["left_s"]).alias("eta"))


_EDGES = """SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS id, n_name AS name FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_name FROM supplier
UNION ALL SELECT 'n' || (s_nationkey + 1) % 25, 's' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'n1', 'r1', 'loop'"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda t, a, p, b, i, n: load(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(p).cast("string")).alias("parent"), F.concat(F.lit(b), F.col(i).cast("string")).alias("id"), F.col(n).alias("name"))
    own = edge("nation", "r", "n_regionkey", "n", "n_nationkey", "n_name").union(edge("customer", "n", "c_nationkey", "c", "c_custkey", "c_name")).union(edge("supplier", "n", "s_nationkey", "s", "s_suppkey", "s_name"))
    # suppliers in a second nation, and a cycle, to be survived
    shared = load(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("n"), ((F.col("s_nationkey") + 1) % 25).cast("string")), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "s_name")
    return own.union(shared).union(spark.range(1).select(F.lit("n1"), F.lit("r1"), F.lit("loop")))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), t(root, id, path, names, depth) AS (
SELECT 'r' || r_regionkey, 'r' || r_regionkey, ['r' || r_regionkey], []::varchar[], 0 FROM region
UNION ALL SELECT t.root, e.id, list_append(t.path, e.id), list_append(t.names, e.name), t.depth + 1 FROM t JOIN e ON e.parent = t.id WHERE NOT list_contains(t.path, e.id))
SELECT root, id, CASE WHEN len(names) > 1 THEN names[1] ELSE 'Raiz' END AS category, array_to_string(names[1:len(names) - 1], ' / ') AS folder, depth FROM t WHERE depth > 0
QUALIFY row_number() OVER (PARTITION BY root, id ORDER BY depth, list_reverse(path)) = 1""")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    found = trees.walk(_edges(spark, sf_dir), roots)
    return found.select("root", "id", trees.category(F.col("names")).alias("category"), trees.folder_path(F.col("names")).alias("folder"), "depth")


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN n_regionkey < 3 THEN 'r' || n_regionkey END AS root, CASE WHEN n_regionkey < 3 THEN 2 END AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def ancestor_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    roots = load(spark, sf_dir, "region").where("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    edges = _edges(spark, sf_dir).where("name <> 'loop'")
    return trees.ancestors(edges, starts, roots)


@query("""WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'bad' WHEN doc_id % 5 = 2 THEN (n_chars + 1)::varchar ELSE n_chars::varchar END AS size, doc_id % 7 = 0 AS local FROM documents)
SELECT doc_id, CASE WHEN try_cast(size AS bigint) = n_chars THEN 'exists' WHEN local THEN 'copied' ELSE 'downloaded' END AS action FROM d""")
def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("doc_id") % 5, F.col("n_chars")
    size = F.when(key == 0, F.lit(None)).when(key == 1, "bad").when(key == 2, (n + 1).cast("string")).otherwise(n.cast("string"))
    action = F.when(size.try_cast("bigint") == n, "exists").when(F.col("doc_id") % 7 == 0, "copied").otherwise("downloaded")
    return load(spark, sf_dir, "documents").select("doc_id", action.alias("action"))


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE gap < 3600000000) AS too_fast, min(gap) AS least_us FROM g GROUP BY user_id""")
def throttle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = load(spark, sf_dir, "events").select("user_id", (us - F.lag(us).over(w)).alias("gap"))
    return gaps.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("gap") < 3_600_000_000).alias("too_fast"), F.min("gap").alias("least_us"))


@query("""WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')
SELECT event_id, attempt, least(2 * pow(2, attempt - 1), 60)::bigint AS wait_s, (sum(least(2 * pow(2, attempt - 1), 60)) OVER (PARTITION BY user_id ORDER BY attempt))::bigint AS total_s FROM a""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each user waits after each error in turn, and so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    errors = load(spark, sf_dir, "events").where("event_type = 'error'").withColumn("attempt", F.row_number().over(w))
    waits = errors.withColumn("wait_s", F.least(F.lit(2) * F.pow(F.lit(2), F.col("attempt") - 1), F.lit(60)).cast("long"))
    return waits.select("event_id", F.col("attempt").cast("long").alias("attempt"), "wait_s", F.sum("wait_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total_s"))


@query("""WITH o AS (SELECT year(o_orderdate) AS y FROM orders), r AS (SELECT unnest(range(min(y) - 1, max(y) + 3)) AS y FROM o) SELECT r.y AS year, count(o.y) AS n FROM r LEFT JOIN o ON o.y = r.y GROUP BY r.y""")
def year_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of the orders without a gap, from one before the first to two after the last, with their orders."""
    years = load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    every = years.agg(F.min("year").alias("low"), F.max("year").alias("high")).select(F.explode(F.sequence(F.col("high") + 2, F.col("low") - 1, F.lit(-1))).alias("year"))
    return every.join(years, "year", "left").select(F.col("year").cast("long").alias("year"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT doc_id, lang, NULL::int AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return old.unionByName(load(spark, sf_dir, "labels").select("doc_id", "quality"), allowMissingColumns=True)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), t(root, id) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT t.root, e.id FROM t JOIN e ON e.parent = t.id),
l AS (SELECT id, (ascii(right(id, 1)) + length(id)) % 17 <> 3 AS ok FROM e UNION SELECT 'r' || r_regionkey, true FROM region)
SELECT t.root AS id, bool_and(coalesce(g.ok, false)) AS ok, count(*) AS folders FROM t LEFT JOIN (SELECT id, bool_and(ok) AS ok FROM l GROUP BY id) g ON g.id = t.id GROUP BY t.root""")
def subtree_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    edges = _edges(spark, sf_dir)
    told = edges.select("id", ((F.ascii(F.right("id", F.lit(1))) + F.length("id")) % 17 != 3).alias("ok")).union(roots.withColumn("ok", F.lit(True)))
    return trees.subtree_ok(edges, told.groupBy("id").agg(F.bool_and("ok").alias("ok")), roots)


@query("""WITH p AS (SELECT s_suppkey, s_nationkey AS n FROM supplier UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25 FROM supplier WHERE s_suppkey % 3 = 0),
c AS (SELECT s_suppkey, CASE WHEN n % 2 = 0 THEN 'n' || n WHEN n_regionkey = 1 THEN 'r1' END AS root, CASE WHEN n % 2 = 0 THEN 1 WHEN n_regionkey = 1 THEN 2 END AS depth FROM p JOIN nation ON n_nationkey = n)
SELECT 's' || s_suppkey AS id, root, depth FROM c QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY depth NULLS LAST, root) = 1""")
def ancestor_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest folder above that is a known root or is recognised by its name."""
    starts = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    names = [r["n_name"] for r in load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").collect()]  # 13 rules, part of the question
    edges = _edges(spark, sf_dir).where("name <> 'loop'")
    return trees.ancestors(edges, starts, spark.createDataFrame([("r1",)], "id string"), lambda name: name.isin(*names))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), t(id, name, path) AS (SELECT 'r' || r_regionkey, '', ['r' || r_regionkey] FROM region UNION ALL SELECT e.id, e.name, list_append(t.path, e.id) FROM t JOIN e ON e.parent = t.id WHERE NOT list_contains(t.path, e.id))
SELECT name, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM t WHERE len(path) > 1 GROUP BY name""")
def tree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return trees.by_name(_edges(spark, sf_dir), roots).select("name", F.array_join("ids", ",").alias("ids"))


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s(user_id, k, start) AS (SELECT user_id, k, t0 FROM c WHERE k = 1 UNION ALL SELECT c.user_id, c.k, greatest(c.t0, s.start + 3600000000) FROM s JOIN c ON c.user_id = s.user_id AND c.k = s.k + 1)
SELECT c.event_id, s.start FROM s JOIN c USING (user_id, k)""")
def rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each call of a user could start, an hour apart: the oracle steps from call to call."""
    calls = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return state.scheduled(calls, ["user_id"], ["ts", "event_id"], "at", F.lit(3_600_000_000)).select("event_id", "start")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_empty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("text")).otherwise(F.lit("")).alias("body"))
    return state.resume_empty(load(spark, sf_dir, "documents").select("doc_id"), stored, "doc_id", "body")


@query("""SELECT status, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT o_orderstatus || o_orderpriority AS status, count(*) AS n FROM orders GROUP BY 1)""")
def status_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.concat("o_orderstatus", "o_orderpriority").alias("s"))
    return export.counters(rows, "s").withColumn("percent", F.round("percent", 6))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'l' || max_line END AS link FROM (SELECT o_orderkey, (SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS max_line FROM orders) WHERE true""")
def preserved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that an earlier export gave, the last of each order; a third of the orders had none."""
    kept = load(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("link"), "l_linenumber")
    return export.with_links(load(spark, sf_dir, "orders").select("o_orderkey", F.lit("old").alias("link")), kept, "o_orderkey", ["link"], "l_linenumber").select("o_orderkey", "link")


@query("""WITH c AS (SELECT conv_id, min_by(role, turn) FILTER (WHERE turn % 3 = 1) AS subject, arg_max(role, turn) FILTER (WHERE turn % 3 = 2) AS x FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, turn // 4 AS r, max_by(role, turn) FILTER (WHERE turn % 4 = 1) AS place, min(turn) FILTER (WHERE turn % 4 = 1) AS s, min_by('D' || turn, turn) FILTER (WHERE turn % 4 = 2) AS d FROM conversations GROUP BY ALL)
SELECT k.conv_id, coalesce(a.v, '') AS autuado, coalesce(l.v, '') AS local_constatacao FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN (SELECT conv_id, min_by(role || turn, turn) AS v FROM conversations WHERE turn % 4 = 0 GROUP BY conv_id) a USING (conv_id)
LEFT JOIN (SELECT conv_id, min_by(CASE WHEN d IS NULL THEN place || s ELSE place || s || ' - ' || d END, r) AS v FROM p WHERE place IS NOT NULL GROUP BY conv_id) l USING (conv_id)""")
def table_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of tables whose cells are made from turns: rows of four cells, a name, a place, its district and another label."""
    turn, role = F.col("turn"), F.col("role")
    label = F.when(turn % 4 == 0, F.lit("NOME (RAZÃO SOCIAL OU PESSOA FÍSICA)")).when(turn % 4 == 1, F.lit("LOCAL DA CONSTATAÇÃO DA INFRAÇÃO (ENDEREÇO COMPLETO)")).when(turn % 4 == 2, F.lit("BAIRRO")).otherwise(F.lit("OUTRO"))
    value = F.when(turn % 4 == 2, F.concat(F.lit("D"), turn.cast("string"))).otherwise(F.concat(role, turn.cast("string")))
    cells = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.lit(1).alias("page"), F.lit(1).alias("tbl"), F.floor(turn / 4).alias("row"), (turn % 4).alias("col"), F.concat(label, F.lit("\n"), value).alias("value"))
    return extract.table_fields(cells).select(F.col("doc").alias("conv_id"), "autuado", "local_constatacao")


@query("""WITH c AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS modified, value < 10 AS bad FROM events WHERE event_type <> 'error' AND event_id % 4 <> 0 AND (event_id % 50 = 0 OR event_id % 10 <> 3))
SELECT id, modified, 'pending' AS state FROM c WHERE bad UNION ALL SELECT id, modified, 'revision' FROM c WHERE NOT bad
UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'revision' FROM events WHERE event_id % 4 = 0""")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed in three parts against versioned state; files whose handling fails stay pending."""
    base, events = shared_folder(spark, "incremental"), load(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), "event_type")
    incremental.begin(base, 8, known=rows.where("id % 50 = 0"), revisions=rows.where("id % 4 = 0"), pending=rows.where("id < 0"))
    failing = events.where("value < 10").select(F.col("event_id").alias("id"), F.lit("unreadable").alias("error"))
    handle = lambda todo: todo.join(failing, "id", "left").select("id", "error")
    for part in range(3):
        # each part comes in as many files as tasks write, and a run takes all that is there
        rows.where(F.col("id") % 3 == part).write.mode("append").parquet(f"{base}/in")
        stream = feeds.read(spark, f"{base}/in", rows.schema)
        incremental.run(stream, base, handle, F.col("id") % 10 != 3, F.col("event_type") != "error", f"{base}/checkpoint").awaitTermination()
    told = lambda name, word: incremental.tables(spark, base).read(name).withColumn("state", F.lit(word))
    return told("pending", "pending").union(told("revisions", "revision"))


class Register:
    """Stands in for a registry, which is beyond the network: some numbers it lacks, and some it can't be asked for."""

    def get(self, key: str) -> str | None:
        number = int(key)
        if number % 7 == 3:
            raise OSError("no answer")
        return None if number % 5 == 2 else f"LEI {number}/19"


@query("""WITH k AS (SELECT DISTINCT doc_id AS n FROM labels UNION SELECT doc_id + 1000000 FROM labels WHERE toxic = 1)
SELECT n AS number, CASE WHEN n % 7 = 3 THEN 'failed' WHEN n % 5 = 2 THEN 'absent' ELSE 'found' END AS state, CASE WHEN n % 7 <> 3 AND n % 5 <> 2 THEN 'LEI ' || n || '/19' END AS value, CASE WHEN n % 7 = 3 THEN CASE WHEN n < 1000000 THEN 4 ELSE 2 END ELSE 1 END AS attempts FROM k""")
def registry_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of labels asked for, then again with further ones: the second call asks for failed and new numbers alone."""
    table, own = lookup.memory(spark, shared_folder(spark, "registry")), load(spark, sf_dir, "labels")
    numbers = own.select(F.col("doc_id").alias("key"))
    more = numbers.union(own.where("toxic = 1").select(F.col("doc_id") + 1_000_000))
    asked = lambda keys: lookup.resolve(keys, table, "corpusmill.plans.states.Register", 100_000, tries=2, tasks=min(4, spark.sparkContext.defaultParallelism))
    asked(numbers)
    return asked(more).select(F.col("key").cast("long").alias("number"), "state", "value", "attempts")
