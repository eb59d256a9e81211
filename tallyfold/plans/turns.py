"""Turn, dialogue and interval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold import operators as O
from tallyfold import sources as S
from tallyfold.operators import context as C


def turn_merge(spark, d):
    return O.merge_turns(S.turns(spark, d), "session_id", "turn", "speaker", "text").select("session_id", "turn_no", "speaker", "first_turn", "merged", "text")


def dialogue_render(spark, d):
    line = F.concat(F.lit("["), F.col("first_turn").cast("string"), F.lit("] "), F.upper("speaker"), F.lit(": "), "text")
    t = turn_merge(spark, d).select("session_id", "turn_no", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "line"))), lambda x: x["line"]), "\n")
    return t.groupBy("session_id").agg(F.md5(body).alias("digest"), F.count(F.lit(1)).alias("turns"))


def dialogue_windows(spark, d):
    t = S.turns(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("x"))
    w = t.withColumn("w", O.pack_windows(F.transform("x", lambda x: x["n"]), 600))
    rows = w.select("session_id", F.posexplode("w").alias("pos", "window"))
    return rows.groupBy("session_id", "window").agg(F.count(F.lit(1)).alias("n"))


def speaking_time(spark, d):
    return S.turns(spark, d).where("speaker IS NOT NULL").groupBy("session_id", "speaker").agg(F.sum(F.length("text")).alias("chars"))


def chat_recent(spark, d):
    return O.top_k(S.turns(spark, d), ["session_id"], [F.col("turn").desc()], 2).select("session_id", "turn", "speaker")


def longest_segment(spark, d):
    t = S.turns(spark, d).withColumn("n", F.length("text").cast("long"))
    return O.latest(t, ["session_id", "speaker"], [F.col("n").desc(), F.col("turn")]).select("session_id", "speaker", "turn", "n")


def _sized(spark, d):
    return S.turns(spark, d).withColumn("n", F.length("text").cast("long"))


def history_trim(spark, d):
    return C.spend(_sized(spark, d), ["session_id"], [F.col("turn").desc()], F.col("n"), 500, first=True).select("session_id", "turn")


def glossary_budget(spark, d):
    kept = C.spend(_sized(spark, d), ["session_id"], [F.col("turn")], F.col("n"), 900)
    return kept.select("session_id", "turn", F.sum("n").over(Window.partitionBy("session_id").orderBy("turn")).alias("used"))


def region_cap(spark, d):
    cut = C.cut(S.turns(spark, d), ["session_id"], [F.col("turn")], "text", 700)
    return cut.select("session_id", "turn", F.length("text").cast("long").alias("kept")).where("kept > 0")


def dialogue_sample(spark, d):
    t = S.turns(spark, d).select(F.col("session_id").alias("id"), F.col("turn").alias("pos"), (F.col("turn") * 100.0).alias("start"))
    return C.sample(t, whole=4, opening_sec=50.0, opening=2, around=1, ending=1).select(F.col("id").alias("session_id"), F.col("pos").alias("turn"))


def word_coverage(spark, d):
    """Overlap of 6-second clips with spans, as an equi-join on time buckets."""
    t = S.turns(spark, d)
    w = Window.partitionBy("session_id").orderBy("turn")
    spans = t.withColumn("n", F.length("text").cast("double") / 15).withColumn("e", F.sum("n").over(w)).select("session_id", (F.col("e") - F.col("n")).alias("s"), (F.col("e") - F.col("n") / 2).alias("e"))
    parts = spans.select("session_id", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / 6), F.floor(F.col("e") / 6))).alias("b"))
    over = F.greatest(F.lit(0.0), F.least("e", (F.col("b") + 1) * 6.0) - F.greatest("s", F.col("b") * 6.0))
    return parts.groupBy("session_id", "b").agg((F.round(F.least(F.lit(1.0), F.sum(over) / 6), 3) + 0.0).alias("coverage"))


T = S.TURNS
MERGED = f"{T}, m AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY session_id ORDER BY turn) OR row_number() OVER (PARTITION BY session_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS fresh FROM turns), r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY turn) AS run FROM m), g AS (SELECT session_id, CAST(run AS BIGINT) AS turn_no, speaker, min(turn) AS first_turn, count(*) AS merged, string_agg(text, ' ' ORDER BY turn) AS text FROM r GROUP BY session_id, run, speaker)"
RUN = f"{T}, b AS (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY session_id ORDER BY turn) AS used, sum(length(text)) OVER (PARTITION BY session_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY session_id) AS c FROM turns)"
QUERIES = {
    "turn_merge": (turn_merge, f"WITH {MERGED} SELECT * FROM g"),
    "dialogue_render": (dialogue_render, f"WITH {MERGED} SELECT session_id, md5(string_agg('[' || first_turn || '] ' || upper(speaker) || ': ' || text, chr(10) ORDER BY turn_no)) AS digest, count(*) AS turns FROM g GROUP BY session_id"),
    "dialogue_windows": (dialogue_windows, f"WITH RECURSIVE {T}, o AS (SELECT session_id, length(text) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i FROM turns), p AS (SELECT session_id, i, 0 AS w, n + 1 AS used FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.i, CASE WHEN p.used + o.n > 600 THEN p.w + 1 ELSE p.w END, CASE WHEN p.used + o.n > 600 THEN o.n + 1 ELSE p.used + o.n + 1 END FROM p JOIN o ON o.session_id = p.session_id AND o.i = p.i + 1) SELECT session_id, w AS window, count(*) AS n FROM p GROUP BY 1, 2"),
    "speaking_time": (speaking_time, f"WITH {T} SELECT session_id, speaker, CAST(sum(length(text)) AS BIGINT) AS chars FROM turns WHERE speaker IS NOT NULL GROUP BY 1, 2"),
    "chat_recent_n": (chat_recent, f"WITH {RUN} SELECT session_id, turn, speaker FROM b WHERE k <= 2"),
    "longest_segment": (longest_segment, f"WITH {T} SELECT session_id, speaker, turn, n FROM (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY session_id, speaker ORDER BY length(text) DESC, turn) AS k FROM turns) WHERE k = 1"),
    "history_trim": (history_trim, f"WITH {RUN} SELECT session_id, turn FROM b WHERE back <= 500 OR k = 1"),
    "glossary_budget": (glossary_budget, f"WITH {RUN} SELECT session_id, turn, CAST(used AS BIGINT) AS used FROM b WHERE used <= 900"),
    "region_cap": (region_cap, f"WITH {RUN} SELECT session_id, turn, CAST(greatest(0, least(n, 700 - (used - n))) AS BIGINT) AS kept FROM b WHERE greatest(0, least(n, 700 - (used - n))) > 0"),
    "dialogue_sample": (dialogue_sample, f"WITH {RUN} SELECT session_id, turn FROM b WHERE c <= 4 OR i <= 2 OR i = c // 2 OR i = c // 2 + 1 OR i > c - 1"),
    "word_coverage": (word_coverage, f"WITH {T}, w AS (SELECT session_id, length(text) / 15.0::DOUBLE AS n, sum(length(text) / 15.0::DOUBLE) OVER (PARTITION BY session_id ORDER BY turn) AS e FROM turns), s AS (SELECT session_id, e - n AS s, e - n / 2 AS e FROM w), p AS (SELECT *, unnest(range(CAST(floor(s / 6) AS BIGINT), CAST(floor(e / 6) AS BIGINT) + 1)) AS b FROM s) SELECT session_id, b, round(least(1.0::DOUBLE, sum(greatest(0.0::DOUBLE, least(e, (b + 1) * 6.0::DOUBLE) - greatest(s, b * 6.0::DOUBLE))) / 6), 3) + 0.0 AS coverage FROM p GROUP BY session_id, b"),
}
