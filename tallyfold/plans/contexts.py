"""Context queries: chat history, earlier notes, the graph's view of a question, vocabulary prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import functions as X
from tallyfold import sources as S
from tallyfold.operators import context, graph, publish, retrieval
from tallyfold.plans import mechanisms

QUESTION = "What is Kim doing about returned parts?"


def _notes(spark, d):
    """Documents as notes of meetings: many of one day, some without a time, a date or a title."""
    k = F.col("doc_id")
    date = F.when(k % 37 != 0, F.date_add(F.lit("2026-01-01").cast("date"), (k % 90).cast("int")))
    time = F.when(k % 5 == 1, "").when(k % 5 >= 2, F.format_string("%02d:15", (k % 9 + 8).cast("int")))
    return S.read(spark, d, "documents").select(k.alias("id"), date.alias("meeting_date"), time.alias("meeting_time"), F.when(k % 7 != 0, F.col("source")).alias("title"), "text")


def prior_context(spark, d):
    """The three notes before each meeting, and its own source's shortest text as what is related."""
    n = _notes(spark, d)
    related = S.read(spark, d, "documents").where("text IS NOT NULL").groupBy("source").agg(F.min(F.struct(F.length("text").alias("n"), "doc_id", "text")).alias("x"))
    topical = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source").where("id % 3 = 0").join(F.broadcast(related.select("source", "x.text")), "source").drop("source")
    made = context.prior_context(n, n, topical=topical)
    return made.select("id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("chars"))


def _chats(spark, d):
    k = F.col("doc_id")
    return S.read(spark, d, "documents").select((k % 60).alias("session"), k.alias("turn"), F.concat_ws(" ", "source", "lang", k.cast("string")).alias("question"), F.col("text").alias("answer"))


def chat_history(spark, d):
    """What a prompt still has room for of the last six turns of each session."""
    kept = context.history(_chats(spark, d), chars=3000)
    return kept.select("session", "turn", "question", F.md5("answer").alias("answer"))


def retrieval_query(spark, d):
    asked = S.read(spark, d, "documents").select((F.col("doc_id") % 80).alias("session")).distinct().withColumn("question", F.lit("why?"))
    return context.retrieval_queries(context.history(_chats(spark, d), chars=3000), asked)


def glossary_prompt(spark, d):
    """A prompt of terms for each language, shortest first."""
    terms = S.read(spark, d, "documents").groupBy("lang", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("term")).agg(F.struct(F.min(F.length("source")).alias("n"), F.min("doc_id").alias("i")).alias("pos"))
    made = context.glossary_prompt(terms.where("lang IS NOT NULL"), ["lang"])
    return made.select("lang", "prompt")


def graph_text(spark, d):
    """What the graph of all orders says of the names in a question."""
    ent, rel = mechanisms._triples(spark, d)
    nodes, _ = graph.nodes(ent, F.col("o"))
    return context.graph_text(nodes, graph.edges(rel, ent, F.col("o")), QUESTION, S.keeper(spark))


def question_context(spark, d):
    """Everything that a question is answered from: registers, graph, notes, in this order."""
    docs = S.read(spark, d, "documents")
    rows = docs.select(F.col("source").alias("register"), F.col("doc_id").alias("row_id"), "text", F.lit(None).cast("string").alias("owner"))
    best = retrieval.register_context(rows, QUESTION).join(docs.select(F.col("doc_id").alias("row_id"), "text"), "row_id")
    found = retrieval.scan_notes(docs.select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text")), QUESTION)
    return context.question_context([context.register_text(best), graph_text(spark, d), context.notes_text(found)])


def _group_notes(spark, d, rows):
    """A note of figures for each of 200 groups of documents; the title has the first source, so it can change with the rows."""
    g = S.read(spark, d, "documents").where(rows).groupBy((F.col("doc_id") % 200).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"), F.min("source").alias("s"))
    content = F.concat(F.lit("# Group "), F.col("k").cast("string"), F.lit("\n\ndocuments: "), F.col("n").cast("string"), F.lit("\ncharacters: "), F.coalesce("c", F.lit(0)).cast("string"), F.lit("\n"))
    return g.select(F.col("k").cast("string").alias("key"), F.concat_ws("-", "s", F.lit("k"), F.col("k").cast("string")).alias("stem"), content.alias("content")).select("key", F.concat(X.slugify(F.col("stem")), F.lit(".md")).alias("name"), "content")


def notes_published(spark, d):
    """What a second publication does to the files of a first, which knew a part of the documents, and some groups that are gone since."""
    import uuid

    S.keeper(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/notes-{uuid.uuid4().hex}"
    publish.publish(_group_notes(spark, d, "doc_id % 200 < 150 AND (doc_id % 3 <> 0 OR doc_id % 200 > 100)"), base)
    return publish.publish(_group_notes(spark, d, "doc_id % 200 >= 30"), base).select("key", "name", "sha256", "size", "outcome")


N = """n AS (SELECT doc_id AS id, CASE WHEN doc_id % 37 <> 0 THEN DATE '2026-01-01' + CAST(doc_id % 90 AS INT) END AS d, coalesce(CASE WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 >= 2 THEN printf('%02d:15', doc_id % 9 + 8) END, '') AS t, doc_id % 5 >= 1 AS timed,
  CASE WHEN doc_id % 7 <> 0 THEN source END AS title, text, source FROM documents)"""
H = """c AS (SELECT doc_id % 60 AS session, doc_id AS turn, concat_ws(' ', source, lang, doc_id) AS question, CASE WHEN length(text) > 1200 THEN substring(text, 1, 1200) || '... [truncated]' ELSE coalesce(text, '') END AS answer, row_number() OVER (PARTITION BY doc_id % 60 ORDER BY doc_id DESC) AS k FROM documents),
h AS (SELECT * FROM (SELECT *, sum(length(question) + length(answer)) OVER (PARTITION BY session ORDER BY turn DESC) AS used FROM c WHERE k <= 6) WHERE used <= 3000 OR k = 1)"""
FILES = "SELECT CAST(doc_id % 200 AS VARCHAR) AS key, regexp_replace(regexp_replace(lower(concat_ws('-', min(source), 'k', doc_id % 200)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.md' AS name, '# Group ' || doc_id % 200 || chr(10) || chr(10) || 'documents: ' || count(*) || chr(10) || 'characters: ' || coalesce(sum(length(text)), 0) || chr(10) AS content FROM documents WHERE {} GROUP BY doc_id % 200"
QUERIES = {
    "prior_context": (prior_context, f"""
WITH {N}, o AS (SELECT *, row_number() OVER (ORDER BY d, t, timed, id) AS i FROM n WHERE d IS NOT NULL),
u AS (SELECT d, t, min(i) - 1 AS upto FROM o GROUP BY 1, 2),
b AS (SELECT n.id, 3 - (o.i - u.upto + 2) AS pos, '### ' || o.d || ' — ' || coalesce(nullif(o.title, ''), 'meeting') || chr(10) || chr(10) || substring(o.text, 1, 2500) AS block FROM n JOIN u ON u.d = n.d AND u.t = n.t JOIN o ON o.i <= u.upto AND o.i > u.upto - 3 WHERE o.text IS NOT NULL
 UNION ALL SELECT id, 9, '### Topically related earlier material' || chr(10) || chr(10) || substring(x.said, 1, 4000) FROM n JOIN (SELECT source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS said FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) = 1) x ON x.source = n.source WHERE id % 3 = 0 AND x.said <> ''),
g AS (SELECT id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS context FROM b GROUP BY id)
SELECT n.id, md5(coalesce(context, '(no earlier minutes on record)')) AS digest, length(coalesce(context, '(no earlier minutes on record)')) AS chars FROM n LEFT JOIN g ON g.id = n.id"""),
    "chat_history": (chat_history, f"WITH {H} SELECT session, turn, question, md5(answer) AS answer FROM h"),
    "retrieval_query": (retrieval_query, f"WITH {H}, q AS (SELECT session, string_agg(question, ' ' ORDER BY turn) AS said FROM h WHERE k <= 2 GROUP BY 1) SELECT s.session, concat_ws(' ', said, 'why?') AS query FROM (SELECT DISTINCT doc_id % 80 AS session FROM documents) s LEFT JOIN q ON q.session = s.session"),
    "glossary_prompt": (glossary_prompt, "WITH t AS (SELECT lang, concat_ws('-', source, doc_id) AS term, min(length(source)) AS n, min(doc_id) AS i FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), u AS (SELECT *, sum(length(term) + 2) OVER (PARTITION BY lang ORDER BY n NULLS FIRST, i) AS used FROM t) SELECT lang, 'Glossary: ' || string_agg(term, ', ' ORDER BY n NULLS FIRST, i) || '.' AS prompt FROM u WHERE used <= 886 GROUP BY lang"),
    "graph_text": (graph_text, f"""
WITH {mechanisms.GR}, ed AS (SELECT DISTINCT s AS a, p, t AS b FROM e WHERE p IS NOT NULL AND t <> s AND t IN (SELECT s FROM e)), v AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
lab AS (SELECT s AS label, row_number() OVER (ORDER BY length(s), s) - 1 AS i FROM (SELECT DISTINCT s FROM e WHERE lower(s) LIKE 'kim %') QUALIFY i < 4),
hop AS (SELECT i, label AS n, 0 AS h FROM lab UNION ALL SELECT i, b, 1 FROM lab JOIN v ON a = label UNION ALL SELECT i, y.b, 2 FROM lab JOIN v x ON x.a = label JOIN v y ON y.a = x.b),
near AS (SELECT * FROM (SELECT i, n, min(h) AS h FROM hop GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY i ORDER BY h, n) <= 24),
told AS (SELECT n, min(i * 10 + h) AS w FROM near GROUP BY n),
lines AS (SELECT w, n, '- **' || n || '**: ' || coalesce(description, k.kind || ' mentioned in the meeting record') AS line FROM told JOIN k ON k.s = n LEFT JOIN d ON d.s = n),
ties AS (SELECT a, p, b, min(x.i) AS i FROM ed JOIN near x ON x.n = a JOIN near y ON y.n = b AND y.i = x.i GROUP BY 1, 2, 3)
SELECT substring('## Knowledge graph (matched: ' || (SELECT string_agg(label, ', ' ORDER BY i) FROM lab) || ')' || chr(10) || chr(10) || '### Entities' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY w, n) FROM lines) ||
 coalesce(chr(10) || chr(10) || '### Relationships' || chr(10) || (SELECT string_agg('- ' || a || ' ' || p || ' ' || b, chr(10) ORDER BY i, a, p, b) FROM ties), ''), 1, 6000) AS context WHERE EXISTS (SELECT 1 FROM lab)"""),
    "question_context": (question_context, None),
    "notes_published": (notes_published, f"""
WITH a AS ({FILES.format("doc_id % 200 < 150 AND (doc_id % 3 <> 0 OR doc_id % 200 > 100)")}), b AS ({FILES.format("doc_id % 200 >= 30")}),
r AS (SELECT coalesce(b.key, a.key) AS key, coalesce(b.name, a.name) AS name, coalesce(b.content, a.content) AS content, CASE WHEN b.key IS NULL THEN 'kept' WHEN a.name = b.name AND a.content = b.content THEN 'same' ELSE 'written' END AS outcome FROM a FULL JOIN b ON a.key = b.key
 UNION ALL SELECT a.key, a.name, a.content, 'superseded' FROM a JOIN b ON a.key = b.key WHERE a.name <> b.name)
SELECT key, name, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS size, outcome FROM r"""),
}
