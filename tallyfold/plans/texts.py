"""Text queries: tokens, slugs, scores, parsers over rendered notes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tallyfold import functions as X
from tallyfold import sources as S
from tallyfold.operators import notes

STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def token_estimate(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 4).cast("long").alias("tokens"), F.size(F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "")).cast("long").alias("words"))


def slugs(spark, d):
    return S.read(spark, d, "documents").select("doc_id", X.slugify(F.substring("text", 1, 80)).alias("slug"))


def timestamps(spark, d):
    e = S.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value") * 60).alias("sec"))
    return e.select("event_id", X.format_timestamp(F.col("sec")).alias("stamp"))


def datetimes(spark, d):
    t = F.to_timestamp("o_orderdate")
    return S.read(spark, d, "orders").select("o_orderkey", F.date_format(t, "EEEE, MMM dd, yyyy").alias("day"))


def doc_ids(spark, d):
    return S.read(spark, d, "documents").select("doc_id", X.document_id(F.col("text")).alias("document"))


def excerpts(spark, d):
    flat = F.trim(F.regexp_replace("text", r"[ \t\n]+", " "))
    return S.read(spark, d, "documents").select("doc_id", F.when(F.length(flat) > 220, F.concat(F.substring(flat, 1, 220), F.lit("..."))).otherwise(flat).alias("excerpt"))


def junk_gate(spark, d):
    words = F.size(F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != ""))
    return S.read(spark, d, "documents").where((F.col("n_chars") < 120) | (words < 150)).select("doc_id")


def keywords(spark, d):
    return S.turns(spark, d).where("speaker = 'user'").select("session_id", "turn", F.array_join(X.keywords(F.col("text")), " ").alias("words"))


def salient(text, top=12, stop=X.STOPWORDS):
    """The top terms of each text as array of (term, weight): capitals and hyphens weigh 3; within the row, nothing is shuffled."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.int64())]))

    def rank(column: pa.Array) -> pa.Array:
        import re
        from collections import Counter

        out = []
        for t in column.to_pylist():
            count = Counter(re.findall("[A-Za-z][A-Za-z0-9-]{2,}", t or ""))
            weight = ((-n * (3 if "A" <= w[0] <= "Z" or "-" in w else 1), w) for w, n in count.items() if w.lower() not in stop)
            out.append([{"term": w, "weight": -n} for n, w in sorted(weight)[:top]])
        return pa.array(out, kind)

    return F.arrow_udf(rank, "array<struct<term: string, weight: long>>")(text)


def salient_terms(spark, d):
    found = S.read(spark, d, "documents").select("doc_id", F.explode(salient(F.col("text"))).alias("t"))
    return found.select("doc_id", "t.term", "t.weight")


WORDS = ("ation", "the", "ing")


def keyword_score_topk(spark, d):
    hits = [X.occurrences(F.col("text"), F.lit(w)) for w in WORDS]
    total = sum(hits[1:], hits[0])
    distinct = sum([(h > 0).cast("long") for h in hits[1:]], (hits[0] > 0).cast("long"))
    s = S.read(spark, d, "documents").select("doc_id", distinct.alias("hit_words"), total.alias("total")).where("total > 0")
    return s.orderBy(F.col("hit_words").desc(), F.col("total").desc(), "doc_id").limit(5)


def _notes(spark, d):
    line, sup = S.read(spark, d, "lineitem"), S.read(spark, d, "supplier")
    rows = line.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    action = F.concat(F.lit("- ["), F.when(F.col("l_linestatus") == "F", "x").otherwise(" "), F.lit("] **"), "s_name", F.lit("** - ship "), F.col("l_partkey").cast("string"), F.lit(". Due: before "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(". [0:0"), F.col("l_linenumber").cast("string"), F.lit("]"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", action.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("l_orderkey").agg(F.concat(F.lit("# Notes\n\n## Action Items\n"), body, F.lit("\n\n## Risks\n- none\n")).alias("doc"))


def action_items(spark, d):
    return notes.parse_action_items(_notes(spark, d), "l_orderkey")


def _minutes(spark, d):
    """A note per order: a decision and a question for each of its lines."""
    line, sup = S.read(spark, d, "lineitem"), S.read(spark, d, "supplier")
    rows = line.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    n, part = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    said = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("decided by "), "s_name", F.lit(". "))).otherwise("agreed. ")
    decision = F.concat(F.lit("- **Ship "), part, F.lit("** - "), said, F.when(F.col("l_linestatus") == "F", "Rationale: it was late. ").otherwise(""), F.lit("[0:0"), n, F.lit("]"))
    question = F.concat(F.lit("- Where is "), part, F.lit("? "), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Buyer "), n, F.lit(" needs to resolve this. "))).otherwise(""), F.lit("[0:0"), n, F.lit("]"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", c.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("l_orderkey").agg(F.concat(F.lit("# Notes\n\n## Decisions\n"), text(decision), F.lit("\n\n## Open Questions\n"), text(question), F.lit("\n\n## Risks\n- none\n")).alias("doc"))


def decisions(spark, d):
    return notes.parse_decisions(_minutes(spark, d), "l_orderkey")


def questions(spark, d):
    return notes.parse_questions(_minutes(spark, d), "l_orderkey")


def _graph_notes(spark, d):
    line, part = S.read(spark, d, "lineitem"), S.read(spark, d, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "p_type", "l_returnflag")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c.alias("line")))), lambda x: x["line"]), "\n")
    ent = F.concat(F.lit("- "), "p_brand", F.lit(" ("), F.upper("p_type"), F.lit(") - seen"))
    rel = F.concat(F.lit("- "), "p_brand", F.lit(" -> "), "l_returnflag", F.lit(" -> "), "p_type")
    return rows.groupBy("l_orderkey").agg(F.concat(F.lit("## Entities\n"), text(ent), F.lit("\n## Relations\n"), text(rel), F.lit("\n")).alias("doc"))


def entities(spark, d):
    lines = _graph_notes(spark, d).select("l_orderkey", F.posexplode_outer(F.split(X.section(F.col("doc"), "Entities"), "\n")).alias("pos", "line"))
    pattern = r"^\s*(?:[-*]\s*)?(.+?)\s*[\(\[]([^\)\]]+)[\)\]]\s*[-:–—]?\s*(.*)$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    rows = lines.where(F.col("line").rlike(pattern)).select("l_orderkey", "pos", part(1).alias("name"), F.lower(part(2)).alias("kind"))
    from tallyfold.operators import latest

    return latest(rows.withColumn("_n", F.lower("name")), ["l_orderkey", "_n"], [F.col("pos")]).select("l_orderkey", "name", "kind")


def relations(spark, d):
    lines = _graph_notes(spark, d).select("l_orderkey", F.explode_outer(F.split(X.section(F.col("doc"), "Relations"), "\n")).alias("line"))
    parts = F.transform(F.split(F.regexp_replace("line", r"^\s*[-*]\s*", ""), r"\s*(?:->|→|\|)\s*"), lambda x: F.trim(x))
    return lines.withColumn("p", parts).where((F.size("p") == 3) & F.forall("p", lambda x: x != "")).select("l_orderkey", F.col("p")[0].alias("subject"), F.col("p")[1].alias("predicate"), F.col("p")[2].alias("object")).distinct()


def due_dates(spark, d):
    text = F.concat(F.lit("by "), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, "2024-13-40").otherwise("soon"))
    return S.read(spark, d, "orders").select("o_orderkey", X.due_date(text).alias("due"))


def categories(spark, d):
    from tallyfold.operators import classify

    doc = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("---\ncategory: household\n---\n")).when(F.col("doc_id") % 7 == 1, F.lit("---\ncategory: work\ntype: daily\n---\n")).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    fields = classify.note_fields(doc, F.concat(F.lit("Note "), "source"), F.col("lang"))
    declared = [*classify.rules("category", "is", ("household",), "Personal"), *classify.rules("category", "is", ("work",), "Professional")]
    words = [*classify.rules("all", "word", ("license", "copyright"), "Personal", 1), *classify.rules("all", "word", ("the", "que", "und", "les"), "Personal", 1, 0.5)]
    found = classify.decide(fields, declared + words)
    domain = F.coalesce(found["bucket"], F.lit("Professional"))
    given = classify.decide(fields, classify.rules("type", "is", ("daily",), "Standup"))["bucket"]
    topic = classify.decide(fields, [*classify.rules("all", "part", ("1", "2"), "Numbers"), *classify.rules("all", "part", ("@",), "Mail", 1)])["bucket"]
    kind = F.coalesce(given, F.when(found["priority"] == 1, "Personal & Household"), F.when(domain == "Professional", topic), F.lit("General"))
    return S.read(spark, d, "documents").select("doc_id", domain.alias("domain"), kind.alias("kind"))


def addressed(spark, d):
    from tallyfold.operators import classify

    said = F.concat(F.element_at(F.array(F.lit("Thanks, "), F.lit("So what now, "), F.lit("hey ")), (F.col("turn") % 3 + 1).cast("int")), F.initcap("speaker"), F.when(F.col("turn") % 2 == 0, "?").otherwise(""))
    return S.turns(spark, d).select("session_id", "turn", F.array_join(classify.addressed(said, ("system",), ("thanks", "hey")), " ").alias("names"))


W = "len(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> ''))"
OCC = [f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in WORDS]
_LOW = "lower('note ' || source || ' ' || lang || ' ' || substring(CASE doc_id % 7 WHEN 0 THEN E'---\\ncategory: household\\n---\\n' WHEN 1 THEN E'---\\ncategory: work\\ntype: daily\\n---\\n' ELSE '' END || coalesce(text, ''), 1, 2000))"
_HIT = lambda w, t: f"CAST(regexp_matches({t}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') AS INT)"
CATEGORY = f"""
WITH t AS (SELECT doc_id, doc_id % 7 AS k, {_LOW} AS t FROM documents),
h AS (SELECT *, {_HIT("license", "t")} + {_HIT("copyright", "t")} > 0 OR {" + ".join(_HIT(w, "t") for w in ("the", "que", "und", "les"))} >= 2 AS guessed FROM t)
SELECT doc_id, CASE WHEN k = 0 OR (k > 1 AND guessed) THEN 'Personal' ELSE 'Professional' END AS domain,
  CASE WHEN k = 1 THEN 'Standup' WHEN k > 1 AND guessed THEN 'Personal & Household' WHEN k = 0 THEN 'General' WHEN contains(t, '1') OR contains(t, '2') THEN 'Numbers' WHEN contains(t, '@') THEN 'Mail' ELSE 'General' END AS kind FROM h
"""
QUERIES = {
    "token_estimate": (token_estimate, f"SELECT doc_id, length(text) // 4 AS tokens, {W} AS words FROM documents"),
    "slugify": (slugs, r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(substring(text, 1, 80), '^\s+|\s+$', '', 'g')), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents"),
    "format_timestamp": (timestamps, "SELECT event_id, CASE WHEN s IS NULL THEN '?:??' WHEN s < 3600 THEN printf('%d:%02d', s // 60, s % 60) ELSE printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS stamp FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value * 60) AS BIGINT) END AS s FROM events)"),
    "datetime_format": (datetimes, "SELECT o_orderkey, strftime(o_orderdate, '%A, %b %d, %Y') AS day FROM orders"),
    "doc_id_md5": (doc_ids, "SELECT doc_id, 'doc-' || md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS document FROM documents"),
    "excerpt": (excerpts, r"SELECT doc_id, CASE WHEN length(t) > 220 THEN substring(t, 1, 220) || '...' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'), ' ') AS t FROM documents)"),
    "junk_gate": (junk_gate, f"SELECT doc_id FROM documents WHERE n_chars < 120 OR {W} < 150"),
    "question_keywords": (keywords, f"SELECT conv_id AS session_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(text, '{X.TOKEN}'), lambda x: lower(x)), lambda x: x NOT IN ({STOP})), ' ') AS words FROM conversations WHERE role = 'user'"),
    "salient_terms": (salient_terms, f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{{2,}}')) AS term FROM documents), w AS (SELECT doc_id, term, CAST(sum(CASE WHEN regexp_matches(term, '^[A-Z]') OR contains(term, '-') THEN 3 ELSE 1 END) AS BIGINT) AS weight FROM t WHERE lower(term) NOT IN ({STOP}) GROUP BY 1, 2) SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS n FROM w) WHERE n <= 12"),
    "keyword_score_topk": (keyword_score_topk, f"SELECT doc_id, {' + '.join(f'CAST({o} > 0 AS BIGINT)' for o in OCC)} AS hit_words, {' + '.join(OCC)} AS total FROM documents WHERE {' + '.join(OCC)} > 0 ORDER BY hit_words DESC, total DESC, doc_id LIMIT 5"),
    "parse_action_items": (action_items, "SELECT l_orderkey, s_name AS owner, 'ship ' || l_partkey || '.' AS text, 'before ' || strftime(l_shipdate, '%Y-%m-%d') AS due, CAST(l_shipdate AS DATE) AS due_iso, '[0:0' || l_linenumber || ']' AS cite, CASE l_linestatus WHEN 'F' THEN 'done' ELSE 'open' END AS state FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "parse_decisions": (decisions, "SELECT l_orderkey, 'Ship ' || l_partkey AS text, CASE l_returnflag WHEN 'N' THEN s_name END AS decided_by, CASE l_linestatus WHEN 'F' THEN 'it was late.' END AS rationale, '[0:0' || l_linenumber || ']' AS cite FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "parse_open_questions": (questions, "SELECT l_orderkey, 'Where is ' || l_partkey || '?' || CASE l_returnflag WHEN 'R' THEN ' Buyer ' || l_linenumber || ' needs to resolve this.' ELSE '' END AS text, CASE l_returnflag WHEN 'R' THEN 'Buyer ' || l_linenumber END AS owner, '[0:0' || l_linenumber || ']' AS cite FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "parse_entities": (entities, "SELECT l_orderkey, p_brand AS name, lower(p_type) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(p_brand) ORDER BY l_linenumber, upper(p_type)) AS n FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE n = 1"),
    "parse_relations": (relations, "SELECT DISTINCT l_orderkey, p_brand AS subject, l_returnflag AS predicate, p_type AS object FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "due_date_iso": (due_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS due FROM orders"),
    "category_classify": (categories, CATEGORY),
    "direct_address": (addressed, f"WITH {S.TURNS} SELECT session_id, turn, CASE WHEN speaker = 'system' THEN '' WHEN turn % 3 = 1 OR turn % 3 IN (0, 2) THEN upper(speaker[1]) || speaker[2:] END AS names FROM turns"),
}
