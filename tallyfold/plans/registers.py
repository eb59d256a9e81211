"""Register, library and overview queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import operators as O
from tallyfold import sources as S

TODAY = S.TODAY


def commitments_overdue(spark, d):
    c, m = S.commitments(spark, d), S.meetings(spark, d).select(F.col("id").alias("meeting_id"), "meeting_date")
    overdue = F.coalesce((F.col("state") == "open") & (F.col("due") < F.lit(TODAY).cast("date")), F.lit(False))
    rows = c.join(m, "meeting_id").withColumn("overdue", overdue).where("state = 'open'")
    return rows.orderBy(F.col("overdue").desc(), F.col("due").asc_nulls_last(), "owner", "meeting_id", "seq").select("meeting_id", "seq", "owner", "due", "meeting_date", "overdue")


def commitments_by_owner(spark, d):
    c = S.commitments(spark, d).where(F.lower("owner") == "supplier#000000003".lower())
    return c.groupBy("owner", "state").agg(F.count(F.lit(1)).alias("n"), F.min("due").alias("first_due"))


def commitments_grouped(spark, d):
    c = S.commitments(spark, d).where("state = 'open'")
    return c.groupBy(F.coalesce("owner", F.lit("Unassigned")).alias("owner")).agg(F.count(F.lit(1)).alias("n_open"))


def status_counts(spark, d):
    return S.meetings(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stage_timings(spark, d):
    e = S.read(spark, d, "events").select(F.col("event_type").alias("stage"), "value")
    ok = (F.col("stage") != "error").cast("long")
    return e.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.sum(ok).alias("ok"), F.round(F.avg("value"), 4).alias("mean_sec"), F.round(F.max("value"), 4).alias("max_sec"))


def known_names_topk(spark, d):
    s = S.commitments(spark, d).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return s.orderBy(F.col("n").desc(), "owner").limit(50)


def entity_mentions(spark, d):
    line, part = S.read(spark, d, "lineitem"), S.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    g = line.select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("kind")).agg(F.countDistinct("l_orderkey").alias("meetings"))
    return g.orderBy(F.col("meetings").desc(), "name", "kind").limit(50)


def library_listing(spark, d):
    per = S.speakers(spark, d).groupBy(F.col("meeting_id").alias("id")).agg(F.count(F.lit(1)).alias("n_speakers"), F.count_if(F.col("name").isNull()).alias("n_unresolved"))
    rows = S.meetings(spark, d).join(per, "id", "left").fillna(0, ["n_speakers", "n_unresolved"])
    state = F.when(F.col("status") == "failed", "Needs attention").when(F.col("n_speakers") == 0, "No diarization").when(F.col("n_unresolved") > 0, "Speaker review").otherwise("Ready")
    return rows.select("id", "meeting_date", "n_speakers", "n_unresolved", state.alias("review_state"))


def library_search(spark, d):
    return S.meetings(spark, d).where(F.col("title").ilike("%urgent%") | F.col("status").ilike("%FAIL%")).select("id", "title", "status")


def no_speaker_antijoin(spark, d):
    named = S.speakers(spark, d).where("name IS NOT NULL").select(F.col("meeting_id").alias("id")).distinct()
    return S.meetings(spark, d).join(named, "id", "left_anti").select("id", "status")


def unresolved_semijoin(spark, d):
    bare = S.speakers(spark, d).where("name IS NULL").select(F.col("meeting_id").alias("id"))
    return S.meetings(spark, d).join(bare, "id", "left_semi").select("id", "meeting_date")


def failures_recent(spark, d):
    e = S.read(spark, d, "events").where("event_type = 'error'")
    return e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "user_id", "value")


def decisions_topic(spark, d):
    return S.read(spark, d, "documents").where(F.col("text").ilike("%ation%")).select("doc_id", "lang")


def stale_version(spark, d):
    m = S.meetings(spark, d).withColumn("version", F.when(F.col("id") % 3 != 0, F.col("id") % 5))
    return m.where((F.col("status") == "indexed") & ~F.col("version").eqNullSafe(F.lit(2))).select("id", "version")


def pending_queue(spark, d):
    m = S.meetings(spark, d).where("status = 'discovered'").withColumn("day", F.when(F.col("id") % 4 != 0, F.col("meeting_date")))
    return m.orderBy(F.col("day").asc_nulls_last(), "id").limit(25).select("id", "day")


def activity_ranges(spark, d):
    ts = F.col("ts")
    name = F.when((ts >= "2024-01-20") & (ts < "2024-01-21"), "today").when((ts >= "2024-01-19") & (ts < "2024-01-20"), "yesterday").when((ts >= "2024-01-13") & (ts < "2024-01-20"), "week").otherwise("other")
    return S.read(spark, d, "events").groupBy(name.alias("range")).agg(F.count(F.lit(1)).alias("n"))


def overview_scalars(spark, d):
    m, s = S.meetings(spark, d), S.speakers(spark, d)
    a = m.agg(F.count(F.lit(1)).alias("meetings"), F.countDistinct("owner_id").alias("owners"), F.round(F.avg("duration_sec"), 2).alias("mean_sec"), F.count_if(F.col("status") == "failed").alias("failed"))
    return a.join(s.agg(F.count(F.lit(1)).alias("speakers"), F.count("name").alias("named")))


def storage_by_state(spark, d):
    return S.read(spark, d, "documents").groupBy("source").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"))


def people_summary(spark, d):
    s = S.read(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    n = S.read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return s.join(n, "c_nationkey").groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_list("c_mktsegment")), ", ").alias("aliases"), F.count(F.lit(1)).alias("n"))


def enrolled_having(spark, d):
    return S.samples(spark, d).where("NOT pending").groupBy("person").agg(F.countDistinct("meeting_id").alias("meetings")).where("meetings >= 3")


def sample_meeting_count(spark, d):
    e = S.samples(spark, d).withColumn("m", F.when(F.col("meeting_id") != 0, F.col("meeting_id").cast("string")))
    return e.groupBy("person").agg(F.countDistinct(F.coalesce("m", F.concat(F.lit("s"), F.col("vec_id").cast("string")))).alias("n"))


def asof_prior_k(spark, d):
    m = S.meetings(spark, d)
    prior = O.preceding_k(m, ["owner_id"], [F.col("meeting_date"), F.col("id")], F.col("id"), 3)
    return m.select("id", F.array_join(F.transform(prior, lambda x: x.cast("string")), ",").alias("prior"))


def first_per_meeting(spark, d):
    return O.top_k(S.commitments(spark, d), ["meeting_id"], [F.col("seq")], 3).select("meeting_id", "seq", F.col("rank").cast("long").alias("rank"))


M, SP, C = S.MEETINGS, S.SPEAKERS, S.COMMITMENTS
T = f"DATE '{TODAY}'"
QUERIES = {
    "commitments_overdue": (commitments_overdue, f"WITH {C}, {M} SELECT meeting_id, seq, owner, due, meeting_date, coalesce(due < {T}, false) AS overdue FROM commitments JOIN meetings ON id = meeting_id WHERE state = 'open'"),
    "commitments_by_owner": (commitments_by_owner, f"WITH {C} SELECT owner, state, count(*) AS n, min(due) AS first_due FROM commitments WHERE lower(owner) = 'supplier#000000003' GROUP BY owner, state"),
    "commitments_grouped": (commitments_grouped, f"WITH {C} SELECT coalesce(owner, 'Unassigned') AS owner, count(*) AS n_open FROM commitments WHERE state = 'open' GROUP BY 1"),
    "status_counts": (status_counts, f"WITH {M} SELECT status, count(*) AS n FROM meetings GROUP BY status"),
    "stage_timings": (stage_timings, "SELECT event_type AS stage, count(*) AS runs, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS ok, round(avg(value), 4) AS mean_sec, round(max(value), 4) AS max_sec FROM events GROUP BY 1"),
    "known_names_topk": (known_names_topk, f"WITH {C} SELECT owner, count(*) AS n FROM commitments GROUP BY owner ORDER BY n DESC, owner LIMIT 50"),
    "entity_mentions": (entity_mentions, "SELECT p_brand AS name, p_type AS kind, count(DISTINCT l_orderkey) AS meetings FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 ORDER BY meetings DESC, name, kind LIMIT 50"),
    "library_listing": (library_listing, f"WITH {M}, {SP}, p AS (SELECT meeting_id, count(*) AS n_speakers, count(*) - count(name) AS n_unresolved FROM speakers GROUP BY 1) SELECT id, meeting_date, coalesce(n_speakers, 0) AS n_speakers, coalesce(n_unresolved, 0) AS n_unresolved, CASE WHEN status = 'failed' THEN 'Needs attention' WHEN coalesce(n_speakers, 0) = 0 THEN 'No diarization' WHEN n_unresolved > 0 THEN 'Speaker review' ELSE 'Ready' END AS review_state FROM meetings LEFT JOIN p ON meeting_id = id"),
    "library_search": (library_search, f"WITH {M} SELECT id, title, status FROM meetings WHERE title ILIKE '%urgent%' OR status ILIKE '%FAIL%'"),
    "no_speaker_antijoin": (no_speaker_antijoin, f"WITH {M}, {SP} SELECT id, status FROM meetings WHERE NOT EXISTS (SELECT 1 FROM speakers WHERE meeting_id = id AND name IS NOT NULL)"),
    "unresolved_semijoin": (unresolved_semijoin, f"WITH {M}, {SP} SELECT id, meeting_date FROM meetings WHERE EXISTS (SELECT 1 FROM speakers WHERE meeting_id = id AND name IS NULL)"),
    "failures_recent": (failures_recent, "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20"),
    "decisions_topic": (decisions_topic, "SELECT doc_id, lang FROM documents WHERE text ILIKE '%ation%'"),
    "stale_version": (stale_version, f"WITH {M}, v AS (SELECT id, status, CASE WHEN id % 3 <> 0 THEN id % 5 END AS version FROM meetings) SELECT id, version FROM v WHERE status = 'indexed' AND version IS DISTINCT FROM 2"),
    "pending_queue": (pending_queue, f"WITH {M} SELECT id, CASE WHEN id % 4 <> 0 THEN meeting_date END AS day FROM meetings WHERE status = 'discovered' ORDER BY day ASC NULLS LAST, id LIMIT 25"),
    "activity_ranges": (activity_ranges, "SELECT CASE WHEN ts >= '2024-01-20' AND ts < '2024-01-21' THEN 'today' WHEN ts >= '2024-01-19' AND ts < '2024-01-20' THEN 'yesterday' WHEN ts >= '2024-01-13' AND ts < '2024-01-20' THEN 'week' ELSE 'other' END AS range, count(*) AS n FROM events GROUP BY 1"),
    "overview_scalars": (overview_scalars, f"WITH {M}, {SP} SELECT * FROM (SELECT count(*) AS meetings, count(DISTINCT owner_id) AS owners, round(avg(duration_sec), 2) AS mean_sec, count(*) FILTER (status = 'failed') AS failed FROM meetings), (SELECT count(*) AS speakers, count(name) AS named FROM speakers)"),
    "storage_by_state": (storage_by_state, "SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source"),
    "list_people": (people_summary, "SELECT n_name, string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment) AS aliases, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"),
    "enrolled_having": (enrolled_having, "SELECT label AS person, count(DISTINCT vec_id % 7) AS meetings FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label HAVING count(DISTINCT vec_id % 7) >= 3"),
    "sample_meeting_count": (sample_meeting_count, "SELECT label AS person, count(DISTINCT CASE WHEN vec_id % 7 <> 0 THEN CAST(vec_id % 7 AS VARCHAR) ELSE 's' || vec_id END) AS n FROM embeddings GROUP BY label"),
    "asof_prior_k": (asof_prior_k, f"WITH {M} SELECT id, coalesce(array_to_string(list(id) OVER (PARTITION BY owner_id ORDER BY meeting_date, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS prior FROM meetings"),
    "first_per_meeting": (first_per_meeting, "SELECT * FROM (SELECT l_orderkey AS meeting_id, l_linenumber AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rank FROM lineitem) WHERE rank <= 3"),
}
