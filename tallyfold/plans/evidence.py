"""Queries over the question, library, people, voice and ingest operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import functions as X
from tallyfold import operators as O
from tallyfold import sources as S
from tallyfold.operators import classify, ingest, people, retrieval, voices
from tallyfold.plans.identity import SC

QUESTION, TOPIC = "What about ation and Mary, ingen?", "the"
STOP = ("what", "about", "and")


def _registers(spark, d):
    """decisions and questions from documents, commitments from parts, owned by persons whose names vary."""
    doc = S.read(spark, d, "documents").where("text IS NOT NULL")
    owner = F.when(F.col("doc_id") % 50 == 3, "Mary Ann").when(F.col("doc_id") % 50 == 4, "Rosemary B")
    a = doc.select(F.when(F.col("doc_id") % 2 == 0, "decision").otherwise("question").alias("register"), F.col("doc_id").alias("row_id"), "text", F.when(F.col("doc_id") % 2 != 0, owner).alias("owner"))
    part = S.read(spark, d, "part").select(F.lit("commitment").alias("register"), F.col("p_partkey").alias("row_id"), F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 100 == 7, "mary").alias("owner"))
    return a.unionByName(part)


def structured_context(spark, d):
    return retrieval.register_context(_registers(spark, d), QUESTION, stop=STOP)


def minutes_scan(spark, d):
    notes = S.read(spark, d, "documents").where("text IS NOT NULL").select(F.format_string("n%08d", "doc_id").alias("name"), "text")
    return retrieval.scan_notes(notes, QUESTION, stop=STOP).select("name", "score", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def questions_topic(spark, d):
    q = S.read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") * 15).alias("id"))
    m = S.meetings(spark, d).select("id", "meeting_date")
    return q.join(m, "id").where(F.col("text").ilike(f"%{TOPIC}%")).select("doc_id", "id", "meeting_date").orderBy(F.col("meeting_date").desc_nulls_last(), "doc_id")


def timeline_topic(spark, d):
    m = S.meetings(spark, d).select(F.col("id").alias("meeting_id"), "meeting_date", "title", "status")
    c = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("ship "), F.col("l_partkey").cast("string")).alias("text"), "l_returnflag")
    names = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.when(F.col("l_linestatus") == "O", "entity").otherwise("speaker").alias("kind"), F.concat(F.lit("N"), F.col("l_suppkey").cast("string")).alias("name"))
    return retrieval.timeline(m, c.where("l_returnflag = 'R'").drop("l_returnflag"), c.where("l_returnflag = 'A'").drop("l_returnflag"), names, "SHIP 1")


def _overdue(c):
    return F.coalesce((F.col("state") == "open") & (F.col("due") < F.lit(S.TODAY).cast("date")), F.lit(False))


def commitments_of(spark, d):
    """Commitments of one owner that are overdue, with their meetings."""
    c, m = S.commitments(spark, d), S.meetings(spark, d).select(F.col("id").alias("meeting_id"), "meeting_date", "title")
    rows = c.where((F.lower("owner") == "supplier#000000003") & _overdue(c)).join(m, "meeting_id")
    return rows.orderBy("due", "owner", "meeting_id", "seq").select("meeting_id", "seq", "owner", "due", "meeting_date", "title")


def meeting_detail(spark, d):
    """Every meeting with its speakers, open commitments and label: what the detail view shows."""
    m = S.meetings(spark, d)
    s = S.speakers(spark, d).groupBy(F.col("meeting_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("speakers"), F.count_if(F.col("name").isNull()).alias("unresolved"))
    c = S.commitments(spark, d).where("state = 'open'").groupBy(F.col("meeting_id").alias("id")).agg(F.count(F.lit(1)).alias("open_items"), F.count_if(F.col("due").isNull()).alias("undated"))
    rows = m.join(s, "id", "left").join(c, "id", "left").fillna({"speakers": "", "unresolved": 0, "open_items": 0, "undated": 0})
    when = X.spoken_date(F.col("meeting_date").cast("string"), F.lit("14:05"))
    return rows.select("id", when.alias("when"), X.minutes_path(F.col("meeting_date"), F.col("title"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("path"), "speakers", "unresolved", "open_items", "undated")


def overview_metrics(spark, d):
    m, s, c, e = S.meetings(spark, d), S.speakers(spark, d), S.commitments(spark, d), S.read(spark, d, "events")
    one = m.agg(F.count(F.lit(1)).alias("meetings"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.coalesce(F.sum("duration_sec"), F.lit(0.0)), 0).alias("seconds"), F.round(F.avg("duration_sec"), 2).alias("mean_sec"))
    two = s.agg(F.count_if(F.col("name").isNull()).alias("unresolved"), F.countDistinct("name").alias("names"), F.countDistinct("meeting_id").alias("with_speakers"))
    three = c.agg(F.count_if(F.col("state") == "open").alias("open_items"), F.count_if(_overdue(c)).alias("overdue"), F.count_if(F.col("owner").isNull()).alias("unassigned"), F.countDistinct("owner").alias("owners"))
    four = e.agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_event"))
    return one.join(two).join(three).join(four)


def known_people(spark, d):
    old_p = S.read(spark, d, "nation").select(F.col("n_name").alias("canonical"), F.when(F.col("n_regionkey") == 1, "host").alias("role"))
    old_a = old_p.select(F.lower("canonical").alias("alias"), "canonical")
    c = S.read(spark, d, "customer").join(S.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    new = c.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "n_name")).otherwise(F.col("c_name")).alias("canonical"), F.array(F.concat(F.lit(" NICK-"), F.col("c_nationkey").cast("string"))).alias("aliases"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("role"), F.col("c_custkey").alias("pos"))
    p, a = people.add_people(old_p, old_a, new)
    return a.join(p, "canonical").select("alias", "canonical", "role")


def person_merge(spark, d):
    tables = {"commitments": S.commitments(spark, d).select("meeting_id", "owner"), "speakers": S.speakers(spark, d)}
    out = people.rename_person(tables, {"Supplier#000000002": " Supplier#000000001 ", "A": "R", "x": "x"}, keys={"commitments": ["meeting_id", "owner"]})
    a = out["commitments"].groupBy(F.col("owner").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(out["speakers"].groupBy("name").agg(F.count(F.lit(1)).alias("n")))


def delete_failed(spark, d):
    gone = S.meetings(spark, d).where("status = 'failed'").select(F.col("id").alias("meeting_id"))
    tables = {"speakers": S.speakers(spark, d), "commitments": S.commitments(spark, d), "sources": S.read(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_orderkey").alias("meeting_id"))}
    out = people.delete_meetings(tables, gone, ["speakers", "commitments"], ["sources"])
    sizes = [df.agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n"), F.count("meeting_id").alias("linked")) for k, df in out.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


def triples_canonical(spark, d):
    line = S.read(spark, d, "lineitem").join(S.read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    ent = line.select(F.col("l_orderkey").alias("meeting_id"), F.upper("s_name").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, "person").otherwise("system").alias("kind")).distinct()
    rel = line.select(F.col("l_orderkey").alias("meeting_id"), "l_linenumber", F.lower("s_name").alias("subject"), F.lit("has").alias("predicate"), F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("object"))
    aliases = spark.createDataFrame([("a", "Alpha"), ("supplier#000000001", "First")], "alias string, canonical string")
    return people.canonical_triples(ent, rel, aliases)[1].select("meeting_id", "l_linenumber", "subject", "object")


def files_outcome(spark, d):
    docs = S.read(spark, d, "documents").select(F.format_string("f%08d", "doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 5).alias("mtime"), F.sha2("text", 256).alias("sha256"), "doc_id")
    seen = docs.where("doc_id % 9 = 0").select("path", "size", F.when(F.col("doc_id") % 2 == 0, F.col("mtime")).otherwise(-1).alias("mtime"))
    return ingest.file_outcomes(docs.drop("doc_id"), seen, docs.where("doc_id % 11 = 0").select("sha256"))


def reconcile_sources(spark, d):
    doc = S.read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    m = doc.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("path"), F.col("h").alias("sha256"))
    src = doc.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 5 != 0, F.col("h")).alias("sha256"), F.when(F.col("doc_id") % 10 == 1, -1).cast("long").alias("meeting_id"))
    return ingest.reconcile(src, m).select("source_id", "meeting_id")


def downloads(spark, d):
    doc = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.md5("text").alias("md5"))
    listed = doc.select("id", "size", F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 7 == 0, "0").otherwise(F.col("md5")).alias("md5"))
    return ingest.verified(listed, doc.where("id % 6 <> 5"))


def gate(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "ingested").when(F.col("o_orderstatus") == "P", "ambiguous").when(F.col("o_orderkey") % 3 == 0, "excluded")
    return ingest.unfinished(S.read(spark, d, "orders").select(state.alias("state")))


def ladder(spark, d):
    e = S.read(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "nonsense").otherwise(F.element_at(F.array(*map(F.lit, ingest.LADDER)), (F.col("event_id") % 5 + 1).cast("int")))
    log = e.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), status.alias("status"), F.repeat(F.col("event_type"), 1000).alias("error"))
    out = ingest.advance(log)
    return out.select("id", "status", ingest.stage_rank(F.col("status")).alias("rank"), F.coalesce(F.length("error"), F.lit(0)).cast("long").alias("chars"))


def names_resolved(spark, d):
    line = S.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("label")).agg(*(F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_partkey")))
    old = line.where("l_partkey % 5 <> 0").select("meeting_id", "label", F.nullif("l_returnflag", F.lit("N")).alias("name"), F.when(F.col("l_partkey") % 3 == 0, "confirmed").otherwise("inferred").alias("confidence"))
    inferred = line.select("meeting_id", "label", F.nullif("l_linestatus", F.lit("F")).alias("name"))
    sure = line.where("l_partkey % 7 = 0").select("meeting_id", "label", F.lit(" kim ").alias("name"))
    return ingest.resolve(old, inferred, sure, spark.createDataFrame([("kim", "Kim Roe")], "alias string, canonical string"))


def professional_filter(spark, d):
    p = S.read(spark, d, "part")
    k = F.col("p_partkey") % 5
    doc = F.when(k == 0, F.concat(F.lit("---\ncategory: "), F.element_at(F.array(F.lit("family"), F.lit("'Work'"), F.lit("misc")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit("\n---\n"))).when(k == 1, F.concat(F.lit("---\nentities: ["), "p_type", F.lit("]\n---\n"))).otherwise(F.lit("text"))
    work = ("#1", "economy")
    table = [
        *classify.rules("category", "is", ("family", "household"), "personal category", 0),
        *classify.rules("category", "is", ("work", "career"), "professional category", 1),
        *classify.rules("name", "part", ("red",), "personal word", 2),
        *classify.rules("name", "part", work, "work word", 3),
        *classify.rules("entities", "part", work, "work entity", 4),
    ]
    why = F.coalesce(classify.decide(classify.note_fields(doc, F.col("p_name"), F.concat("p_brand", F.lit(".md"))), table)["bucket"], F.lit("unmatched"))
    return p.select("p_partkey", why.isin("professional category", "work word", "work entity").alias("ok"), why.alias("why"))


def _pending(spark, d):
    return S.samples(spark, d).select(F.col("vec_id").alias("id"), "embedding", "speech_sec", "person")


def cluster_pending(spark, d):
    from tallyfold.operators.voices import cluster

    return cluster(_pending(spark, d).select("id", "embedding"), keep=S.keeper(spark))


def cluster_cards(spark, d):
    p = _pending(spark, d)
    rows = cluster_pending(spark, d).join(p, "id").select("id", "cluster", "speech_sec", F.when(F.col("id") % 3 == 0, F.col("person")).alias("best"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("P"), F.col("person").cast("string"))).alias("llm_name"))
    return voices.cards(rows)


def match_in_blocks(spark, d):
    s = S.samples(spark, d)
    prints = O.profiles(s.where("NOT pending"))
    found = voices.match_blocks(s.where("pending").select(F.col("vec_id").alias("id"), O.normalised(F.col("embedding")).alias("v")), prints.select(F.col("person").alias("id"), F.col("profile").alias("v")))
    return found.select(F.col("id").alias("vec_id"), "person", F.round("score", 4).alias("score"))


def confident_confirm(spark, d):
    s = S.samples(spark, d)
    m = O.match_top2(s.where("pending"), O.profiles(s.where("NOT pending")))
    state = m.select(F.col("vec_id").alias("id"), F.lit("pending").alias("state"), F.lit(None).cast("long").alias("resolved_as"))
    out, enrol = voices.confirm(state, m.where("best_score >= 0.85").select(F.col("vec_id").alias("id"), F.col("best").cast("long").alias("name")))
    return out.select("id", "state", "resolved_as")


def snippet_choice(spark, d):
    """Clips for every speaker of every session, from turns laid out one after the other."""
    t = S.turns(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", F.length("text").alias("n")))).alias("x"))
    ends = t.select("session_id", F.posexplode("x").alias("i", "x"), F.col("x").alias("all")).select("session_id", "x.speaker", F.aggregate(F.slice("all", 1, F.col("i") + 1), F.lit(0), lambda a, y: a + y["n"]).alias("to"), "x.n")
    spans = ends.select("session_id", "speaker", F.struct((F.col("to") - F.col("n")).cast("double").alias("start"), F.col("to").cast("double").alias("end")).alias("r"))
    per = spans.groupBy("session_id", "speaker").agg(F.array_sort(F.collect_list("r")).alias("regions"))
    clips, quality = voices.choose_clips(F.col("regions"), F.array().cast("array<struct<start: double, end: double>>"))
    return per.select("session_id", "speaker", F.array_join(F.transform(clips, lambda s: s.cast("long").cast("string")), ",").alias("clips"), quality.alias("quality"))


_W = ["ation", "mary", "ingen"]
_OCC = [f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in _W]
_SUM, _DISTINCT = " + ".join(_OCC), " + ".join(f"CAST({o} > 0 AS BIGINT)" for o in _OCC)
M, SP, C = S.MEETINGS, S.SPEAKERS, S.COMMITMENTS
_TODAY = f"DATE '{S.TODAY}'"
QUERIES = {
    "structured_context": (structured_context, f"""
WITH r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'decision' ELSE 'question' END AS register, doc_id AS row_id, text, CASE WHEN doc_id % 2 <> 0 AND doc_id % 50 = 3 THEN 'Mary Ann' END AS owner FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'commitment', p_partkey, p_name, CASE WHEN p_partkey % 100 = 7 THEN 'mary' END FROM part),
s AS (SELECT register, row_id, owner IS NOT NULL AS owned, {_DISTINCT} AS h, {_SUM} AS total FROM r),
k AS (SELECT register, row_id, CASE WHEN owned THEN 3 ELSE h END AS hits, total FROM s WHERE owned OR h >= 2)
SELECT * FROM (SELECT register, row_id, CAST(hits AS BIGINT) AS hits, total, row_number() OVER (PARTITION BY register ORDER BY hits DESC, total DESC, row_id) AS rank FROM k) WHERE rank <= 6"""),
    "minutes_scan": (minutes_scan, f"SELECT printf('n%08d', doc_id) AS name, {_SUM} AS score, length(substring(text, 1, 3500)) AS chars, md5(substring(text, 1, 3500)) AS digest FROM documents WHERE {_SUM} > 0 ORDER BY score DESC, name LIMIT 5"),
    "questions_topic": (questions_topic, f"WITH {M} SELECT doc_id, id, meeting_date FROM documents JOIN meetings ON id = doc_id * 15 WHERE text ILIKE '%{TOPIC}%'"),
    "timeline_topic": (timeline_topic, f"""
WITH {M}, l AS (SELECT l_orderkey AS id, l_linenumber AS pos, 'ship ' || l_partkey AS t, l_returnflag AS f, l_linestatus AS s, 'N' || l_suppkey AS n FROM lineitem),
a AS (SELECT id, list(t ORDER BY pos, t) FILTER (f = 'R') AS d, list(t ORDER BY pos, t) FILTER (f = 'A') AS q, list(DISTINCT n ORDER BY n) FILTER (s = 'O') AS e, list(DISTINCT n) FILTER (s <> 'O') AS sp FROM l GROUP BY id),
r AS (SELECT m.*, coalesce(d, []) AS d, coalesce(q, []) AS q, coalesce(e, []) AS e, coalesce(sp, []) AS sp FROM meetings m LEFT JOIN a ON a.id = m.id WHERE status = 'indexed'),
x AS (SELECT *, CASE WHEN len(d) > 0 THEN d[1:3] WHEN len(q) > 0 THEN q[1:1] ELSE ['Meeting indexed and archived in memory.'] END AS said FROM r WHERE contains(lower(title || ' ' || array_to_string(e || sp || d || q, ' ')), 'ship 1'))
SELECT id AS meeting_id, meeting_date, title, said[1] AS headline, array_to_string(said, '; ') AS decisions, array_to_string(e[1:6], ', ') AS entities FROM x"""),
    "commitments_of_owner_overdue": (commitments_of, f"WITH {M}, {C} SELECT meeting_id, seq, owner, due, meeting_date, title FROM commitments JOIN meetings ON id = meeting_id WHERE lower(owner) = 'supplier#000000003' AND state = 'open' AND due < {_TODAY}"),
    "meeting_detail": (meeting_detail, f"""
WITH {M}, {SP}, {C}, s AS (SELECT meeting_id, string_agg(DISTINCT name, ',' ORDER BY name) AS speakers, count(*) - count(name) AS unresolved FROM speakers GROUP BY 1),
c AS (SELECT meeting_id, count(*) AS open_items, count(*) - count(due) AS undated FROM commitments WHERE state = 'open' GROUP BY 1)
SELECT id, strftime(meeting_date, '%A, %b %d, %Y') || ' at 2:05 PM' AS "when", meeting_date || '-' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9_ -]', '', 'g'), '[ _]+', '-', 'g') || '-' || substring(lpad(CAST(id AS VARCHAR), 8, '0'), 1, 8) || '.md' AS path,
  coalesce(speakers, '') AS speakers, coalesce(unresolved, 0) AS unresolved, coalesce(open_items, 0) AS open_items, coalesce(undated, 0) AS undated FROM meetings LEFT JOIN s ON s.meeting_id = id LEFT JOIN c ON c.meeting_id = id"""),
    "overview_metrics": (overview_metrics, f"""
WITH {M}, {SP}, {C} SELECT * FROM (SELECT count(*) AS meetings, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed, round(sum(duration_sec), 0) AS seconds, round(avg(duration_sec), 2) AS mean_sec FROM meetings),
(SELECT count(*) - count(name) AS unresolved, count(DISTINCT name) AS names, count(DISTINCT meeting_id) AS with_speakers FROM speakers),
(SELECT count(*) FILTER (state = 'open') AS open_items, count(*) FILTER (state = 'open' AND due < {_TODAY}) AS overdue, count(*) FILTER (owner IS NULL) AS unassigned, count(DISTINCT owner) AS owners FROM commitments),
(SELECT count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event FROM events)"""),
    "known_people": (known_people, """
WITH c AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END AS canonical, 'nick-' || c_nationkey AS nick, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS role FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT canonical, coalesce(max_by(r, pos) FILTER (r IS NOT NULL), max(o)) AS role FROM (SELECT canonical, role AS r, pos, NULL AS o FROM c UNION ALL SELECT n_name, NULL, NULL, CASE n_regionkey WHEN 1 THEN 'host' END FROM nation) GROUP BY canonical),
a AS (SELECT lower(canonical) AS alias, max(canonical) AS canonical FROM p GROUP BY 1 UNION ALL SELECT nick, max_by(canonical, pos) FROM c GROUP BY nick)
SELECT alias, a.canonical, role FROM a JOIN p ON p.canonical = a.canonical"""),
    "merge_person": (person_merge, f"WITH {C} SELECT owner AS name, count(*) AS n FROM (SELECT DISTINCT meeting_id, CASE owner WHEN 'Supplier#000000002' THEN 'Supplier#000000001' ELSE owner END AS owner FROM commitments) GROUP BY 1 UNION ALL SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'R' END, count(*) FROM lineitem GROUP BY 1"),
    "delete_meetings": (delete_failed, f"WITH {M}, g AS (SELECT id FROM meetings WHERE status = 'failed') SELECT 'speakers' AS name, count(*) AS n, count(*) AS linked FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g) UNION ALL SELECT 'commitments', count(*), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g) UNION ALL SELECT 'sources', count(*), count(*) FILTER (o_orderkey NOT IN (SELECT id FROM g)) FROM orders"),
    "triples_canonical": (triples_canonical, """
WITH l AS (SELECT l_orderkey AS m, l_linenumber AS k, s_name, l_returnflag AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
p AS (SELECT DISTINCT m, lower(s_name) AS low, CASE WHEN s_name = 'Supplier#000000001' THEN 'First' ELSE upper(s_name) END AS name FROM l WHERE k % 2 = 0)
SELECT l.m AS meeting_id, k AS l_linenumber, CASE WHEN s_name = 'Supplier#000000001' THEN 'First' ELSE coalesce(p.name, lower(s_name)) END AS subject, CASE f WHEN 'A' THEN 'Alpha' ELSE f END AS object FROM l LEFT JOIN p ON p.m = l.m AND p.low = lower(s_name)"""),
    "files_outcome": (files_outcome, """
WITH d AS (SELECT printf('f%08d', doc_id) AS path, sha256(text) AS h, doc_id % 9 = 0 AND doc_id % 2 = 0 AS seen FROM documents), k AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 11 = 0),
f AS (SELECT h, min(path) AS first_path FROM d WHERE NOT seen AND h NOT IN (SELECT h FROM k WHERE h IS NOT NULL) GROUP BY h)
SELECT path, CASE WHEN seen THEN 'skipped' WHEN path = first_path THEN 'ingested' ELSE 'duplicate' END AS outcome FROM d LEFT JOIN f ON f.h = d.h"""),
    "reconcile_sources": (reconcile_sources, """
WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), b AS (SELECT h, min(doc_id) AS id FROM d WHERE doc_id % 3 = 0 GROUP BY h)
SELECT doc_id AS source_id, CAST(CASE WHEN doc_id % 10 = 1 THEN -1 WHEN doc_id % 6 = 0 THEN doc_id WHEN doc_id % 5 <> 0 THEN id END AS BIGINT) AS meeting_id FROM d LEFT JOIN b ON b.h = d.h"""),
    "download_check": (downloads, "SELECT doc_id AS id, doc_id % 6 <> 5 AND (doc_id % 4 = 0 OR doc_id % 7 <> 0) AS ok FROM documents"),
    "completion_gate": (gate, "SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'ingested' WHEN o_orderstatus = 'P' THEN 'ambiguous' WHEN o_orderkey % 3 = 0 THEN 'excluded' END AS state FROM orders) WHERE state IS NULL OR state = 'ambiguous' GROUP BY state"),
    "status_ladder": (ladder, """
SELECT id, status, CASE status WHEN 'failed' THEN 0 WHEN 'discovered' THEN 1 WHEN 'transcribed' THEN 2 WHEN 'speakers_resolved' THEN 3 WHEN 'minutes_compiled' THEN 4 ELSE 5 END AS rank, CAST(CASE status WHEN 'failed' THEN 4000 ELSE 0 END AS BIGINT) AS chars
FROM (SELECT user_id AS id, CASE WHEN event_type = 'error' THEN 'failed' ELSE ['discovered', 'transcribed', 'speakers_resolved', 'minutes_compiled', 'indexed'][CAST(event_id % 5 + 1 AS INT)] END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'purchase') WHERE n = 1"""),
    "resolve_names": (names_resolved, """
WITH l AS (SELECT l_orderkey AS meeting_id, l_linenumber AS label, l_partkey % 5 <> 0 AS had, NULLIF(l_returnflag, 'N') AS old, CASE WHEN l_partkey % 5 <> 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'confirmed' ELSE 'inferred' END END AS oc,
  CASE WHEN l_partkey % 7 = 0 THEN 'Kim Roe' ELSE NULLIF(l_linestatus, 'F') END AS new, CASE WHEN l_partkey % 7 = 0 THEN 'confirmed' WHEN l_linestatus <> 'F' THEN 'inferred' ELSE 'unknown' END AS nc FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
k AS (SELECT *, had AND ((oc = 'confirmed' AND nc <> 'confirmed') OR (new IS NULL AND old IS NOT NULL)) AS keep FROM l)
SELECT meeting_id, label, CASE WHEN keep THEN old ELSE new END AS name, CASE WHEN keep THEN oc ELSE nc END AS confidence FROM k"""),
    "professional_filter": (professional_filter, """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN 'personal category' WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 1 THEN 'professional category' WHEN contains(lower(p_name), 'red') THEN 'personal word' WHEN contains(lower(p_brand || '.md ' || p_name), '#1') OR contains(lower(p_name), 'economy') THEN 'work word' WHEN p_partkey % 5 = 1 AND (contains(lower(p_type), 'economy') OR contains(p_type, '#1')) THEN 'work entity' ELSE 'unmatched' END AS why FROM part)
SELECT p_partkey, why IN ('professional category', 'work word', 'work entity') AS ok, why FROM p"""),
    "cluster_pending": (cluster_pending, None),
    "cluster_cards": (cluster_cards, None),
    "match_blocks": (match_in_blocks, f"WITH {SC} SELECT vec_id, person, round(score, 4) AS score FROM r WHERE k <= 2"),
    "confident_confirm": (confident_confirm, f"WITH {SC} SELECT vec_id AS id, CASE WHEN best_score >= 0.85 THEN 'resolved' ELSE 'pending' END AS state, CASE WHEN best_score >= 0.85 THEN best END AS resolved_as FROM m"),
    "snippet_choice": (snippet_choice, None),
}
