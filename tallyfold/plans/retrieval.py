"""Ranked evidence for a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import functions as X
from tallyfold import operators as O
from tallyfold import sources as S

WORDS = ["tion", "ing"]


def register_context(spark, d):
    """The best six rows of each register (here: source): all words must occur, then by occurrences."""
    hits = [X.occurrences(F.col("text"), F.lit(w)) for w in WORDS]
    rows = S.read(spark, d, "documents").select("source", "doc_id", sum(hits[1:], hits[0]).alias("total"), *(h.alias(f"h{i}") for i, h in enumerate(hits))).where("h0 > 0 AND h1 > 0")
    return O.top_k(rows, ["source"], [F.col("total").desc(), F.col("doc_id")], 6).select("source", "doc_id", "total", F.col("rank").cast("long").alias("rank"))


def label_match(spark, d):
    part = S.read(spark, d, "part").select(F.col("p_type").alias("label")).distinct()
    words = F.array(F.lit("economy"), F.lit("brushed"))
    tokens = F.split(F.lower("label"), "[ -]+")
    exact = F.size(F.array_intersect(tokens, words)).cast("long")
    partial = F.size(F.filter(words, lambda w: F.contains(F.lower("label"), w))).cast("long")
    rows = part.select("label", exact.alias("exact"), partial.alias("partial"))
    return rows.orderBy(F.col("exact").desc(), F.col("partial").desc(), F.length("label"), "label").limit(4)


def timeline(spark, d):
    m = S.meetings(spark, d).where("status = 'indexed'").select(F.col("id").alias("meeting_id"), "meeting_date")
    first = O.top_k(S.commitments(spark, d), ["meeting_id"], [F.col("seq"), F.col("owner")], 3)
    texts = first.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("owner", F.lit("?")).alias("o")))), lambda x: x["o"]), "; ").alias("decisions"))
    return m.join(texts, "meeting_id")


OCC = [f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in WORDS]
QUERIES = {
    "register_context": (register_context, f"SELECT source, doc_id, total, rank FROM (SELECT source, doc_id, total, row_number() OVER (PARTITION BY source ORDER BY total DESC, doc_id) AS rank FROM (SELECT source, doc_id, {' + '.join(OCC)} AS total FROM documents WHERE {' AND '.join(f'{o} > 0' for o in OCC)})) WHERE rank <= 6"),
    "label_match": (label_match, "SELECT label, exact, partial FROM (SELECT label, CAST(len(list_intersect(string_split_regex(lower(label), '[ -]+'), ['economy', 'brushed'])) AS BIGINT) AS exact, CAST(contains(lower(label), 'economy') AS BIGINT) + CAST(contains(lower(label), 'brushed') AS BIGINT) AS partial FROM (SELECT DISTINCT p_type AS label FROM part)) ORDER BY exact DESC, partial DESC, length(label), label LIMIT 4"),
    "timeline_events": (timeline, f"WITH {S.MEETINGS}, {S.COMMITMENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seq, owner) AS n FROM commitments) SELECT meeting_id, meeting_date, string_agg(coalesce(owner, '?'), '; ' ORDER BY seq, owner) AS decisions FROM f JOIN meetings ON id = meeting_id WHERE status = 'indexed' AND n <= 3 GROUP BY 1, 2"),
}
