"""Writes as values, dedup, ingest and stage-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import operators as O
from tallyfold import sources as S
from tallyfold.operators import keys


def _rows(spark, d):
    return S.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.col("c_nationkey").cast("long").alias("w"))


def upsert_last_wins(spark, d):
    r = _rows(spark, d)
    new = r.where("k % 10 = 0").select((F.col("k") + 5).alias("k"), F.lit("new").alias("v"), "w")
    return O.upsert(r, new, ["k"])


def sparse_upsert(spark, d):
    r = _rows(spark, d)
    new = r.where("k % 3 = 0").select("k", F.when(F.col("k") % 2 == 0, F.lit("set")).alias("v"), F.lit(None).cast("long").alias("w"))
    return O.sparse_upsert(r, new, "k", ["v", "w"])


def insert_or_ignore(spark, d):
    line = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("m"), F.col("l_returnflag").alias("t"), F.col("l_linenumber").alias("pos"))
    old = O.latest(line.where("pos = 1"), ["m", "t"], [F.col("pos")])
    return O.insert_or_ignore(old, line.where("pos > 1"), ["m", "t"], [F.col("pos")])


def replace_by_key(spark, d):
    line = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("m"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("t"))
    new = line.where("m % 4 = 0 AND pos = 1").select("m", "pos", F.lit("X").alias("t"))
    return O.replace_by_key(line, new, "m")


def cascade_delete(spark, d):
    gone = S.meetings(spark, d).where("status = 'failed'").select(F.col("id").alias("meeting_id"))
    return S.commitments(spark, d).join(gone, "meeting_id", "left_anti").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def status_advance(spark, d):
    e = S.read(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def retry_requeue(spark, d):
    m = S.meetings(spark, d)
    return m.select("id", F.when(F.col("status") == "failed", "discovered").otherwise(F.col("status")).alias("status"))


def latest_source(spark, d):
    o = S.read(spark, d, "orders")
    return O.latest(o.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


def confidence_merge(spark, d):
    s = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("m"), F.col("l_linenumber").alias("label"), F.nullif("l_returnflag", F.lit("N")).alias("old"), F.nullif("l_linestatus", F.lit("F")).alias("new"), (F.col("l_partkey") % 2 == 0).alias("confirmed"))
    name = F.when(F.col("confirmed") & F.col("old").isNotNull(), F.col("old")).otherwise(F.coalesce("new", "old"))
    return s.select("m", "label", name.alias("name"))


def content_dedup(spark, d):
    docs = S.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "h").select("doc_id", "first_id", F.when(F.col("doc_id") == F.col("first_id"), "ingested").otherwise("duplicate").alias("outcome"))


def seen_file_skip(spark, d):
    docs = S.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    seen = docs.where("path % 3 = 0").select("path", F.when(F.col("path") % 2 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("size"))
    return docs.join(seen, ["path", "size"], "left_anti")


def doc_replace_plan(spark, d):
    docs = S.read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    known = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.when(F.col("doc_id") % 4 == 0, F.col("h")).otherwise(F.lit("old")).alias("kh"))
    action = F.when(F.col("kh").isNull(), "insert").when(F.col("kh") == F.col("h"), "unchanged").otherwise("replace")
    return docs.join(known, docs["doc_id"] == known["k"], "left").select("doc_id", action.alias("action"))


def file_eligibility(spark, d):
    docs = S.read(spark, d, "documents")
    state = F.when(F.col("lang") == "fr", "ignored").when(F.col("n_chars") < 600, "ambiguous").when(F.col("doc_id") >= 300, "eligible").otherwise("excluded")
    return docs.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def merge_identity(spark, d):
    c = S.commitments(spark, d)
    owner = F.when(F.col("owner") == "Supplier#000000002", "Supplier#000000001").otherwise(F.col("owner"))
    return c.select("meeting_id", owner.alias("owner")).distinct().groupBy("owner").agg(F.count(F.lit(1)).alias("meetings"))


def alias_canonicalize(spark, d):
    n = S.read(spark, d, "nation").select(F.lower("n_name").alias("alias"), F.concat(F.lit("N-"), "n_name").alias("canonical")).where(F.length("alias") > 6)
    s = S.read(spark, d, "supplier").join(S.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("  "), "n_name").alias("name"))
    return O.canonical(s, "name", n, "canonical").select("s_suppkey", "canonical")


def chat_append_index(spark, d):
    return S.turns(spark, d).groupBy("session_id").agg((F.coalesce(F.max("turn") + 1, F.lit(0))).cast("long").alias("next_index"))


def insert_checked(spark, d):
    """Customers and as many new ones under keys of their own; an existing key would raise."""
    r = _rows(spark, d)
    return keys.insert_checked(r, r.select((-F.col("k") - 1).alias("k"), F.lit("new").alias("v"), "w"), ["k"])


def chat_append(spark, d):
    """Every session with its users' turns asked once more, numbered on."""
    t = S.turns(spark, d)
    return keys.append_indexed(t, t.where("speaker = 'user'").withColumnRenamed("turn", "at"), "session_id", "turn", [F.col("at")]).select("session_id", "turn", F.md5("text").alias("digest"))


R = "r AS (SELECT c_custkey AS k, c_mktsegment AS v, CAST(c_nationkey AS BIGINT) AS w FROM customer)"
L = "l AS (SELECT l_orderkey AS m, l_linenumber AS pos, l_returnflag AS t FROM lineitem)"
QUERIES = {
    "upsert_last_wins": (upsert_last_wins, f"WITH {R}, n AS (SELECT k + 5 AS k, 'new' AS v, w FROM r WHERE k % 10 = 0) SELECT * FROM r WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n"),
    "sparse_upsert": (sparse_upsert, f"WITH {R} SELECT k, CASE WHEN k % 6 = 0 THEN 'set' ELSE v END AS v, w FROM r"),
    "insert_or_ignore": (insert_or_ignore, f"WITH {L} SELECT m, t, pos FROM (SELECT *, row_number() OVER (PARTITION BY m, t ORDER BY pos) AS n FROM l) WHERE n = 1"),
    "replace_by_key": (replace_by_key, f"WITH {L} SELECT * FROM l WHERE m NOT IN (SELECT m FROM l WHERE m % 4 = 0 AND pos = 1) UNION ALL SELECT m, pos, 'X' FROM l WHERE m % 4 = 0 AND pos = 1"),
    "cascade_delete": (cascade_delete, f"WITH {S.MEETINGS}, {S.COMMITMENTS} SELECT state, count(*) AS n FROM commitments WHERE meeting_id NOT IN (SELECT id FROM meetings WHERE status = 'failed') GROUP BY state"),
    "status_advance": (status_advance, "SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"),
    "retry_requeue": (retry_requeue, f"WITH {S.MEETINGS} SELECT id, CASE status WHEN 'failed' THEN 'discovered' ELSE status END AS status FROM meetings"),
    "latest_source": (latest_source, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"),
    "confidence_merge": (confidence_merge, "SELECT l_orderkey AS m, l_linenumber AS label, CASE WHEN l_partkey % 2 = 0 AND l_returnflag <> 'N' THEN l_returnflag ELSE coalesce(NULLIF(l_linestatus, 'F'), NULLIF(l_returnflag, 'N')) END AS name FROM lineitem"),
    "content_dedup": (content_dedup, "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'ingested' ELSE 'duplicate' END AS outcome FROM documents"),
    "seen_file_skip": (seen_file_skip, "SELECT doc_id AS path, n_chars AS size FROM documents WHERE NOT (doc_id % 6 = 0)"),
    "doc_replace_plan": (doc_replace_plan, "SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'insert' WHEN doc_id % 4 = 0 THEN 'unchanged' ELSE 'replace' END AS action FROM documents"),
    "drive_eligibility": (file_eligibility, "SELECT CASE WHEN lang = 'fr' THEN 'ignored' WHEN n_chars < 600 THEN 'ambiguous' WHEN doc_id >= 300 THEN 'eligible' ELSE 'excluded' END AS state, count(*) AS n FROM documents GROUP BY 1"),
    "merge_identity": (merge_identity, f"WITH {S.COMMITMENTS} SELECT owner, count(*) AS meetings FROM (SELECT DISTINCT meeting_id, CASE owner WHEN 'Supplier#000000002' THEN 'Supplier#000000001' ELSE owner END AS owner FROM commitments) GROUP BY owner"),
    "alias_canonicalize": (alias_canonicalize, "SELECT s_suppkey, CASE WHEN length(n_name) > 6 THEN 'N-' || n_name ELSE n_name END AS canonical FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "insert_checked": (insert_checked, f"WITH {R} SELECT k, v, w FROM r UNION ALL SELECT -k - 1, 'new', w FROM r"),
    "chat_append": (chat_append, f"WITH {S.TURNS}, l AS (SELECT session_id, max(turn) AS last FROM turns GROUP BY 1) SELECT session_id, turn, md5(text) AS digest FROM turns UNION ALL SELECT t.session_id, last + row_number() OVER (PARTITION BY t.session_id ORDER BY turn), md5(text) FROM turns t JOIN l ON l.session_id = t.session_id WHERE speaker = 'user'"),
    "chat_append_index": (chat_append_index, "SELECT conv_id AS session_id, max(turn) + 1 AS next_index FROM conversations GROUP BY conv_id"),
}
