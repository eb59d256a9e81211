"""Vector identity and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import operators as O
from tallyfold import sources as S


def vector_normalize(spark, d):
    e = S.samples(spark, d).select("vec_id", F.posexplode(O.normalised(F.col("embedding"))).alias("pos", "x"))
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 4) + 0.0).alias("x"))


def voiceprint_weighted(spark, d):
    p = O.profiles(S.samples(spark, d).where("NOT pending"))
    return p.select("person", F.posexplode("profile").alias("pos", "x")).select("person", F.col("pos").cast("long").alias("pos"), (F.round("x", 4) + 0.0).alias("x"))


def _matches(spark, d):
    s = S.samples(spark, d)
    return O.match_top2(s.where("pending"), O.profiles(s.where("NOT pending")))


def match_top2(spark, d):
    return _matches(spark, d).select("vec_id", "best", F.round("best_score", 4).alias("best_score"), F.round("next_score", 4).alias("next_score"))


def band_decision(spark, d):
    s = S.samples(spark, d)
    meetings = s.where("NOT pending").groupBy(F.col("person").alias("best")).agg(F.countDistinct("meeting_id").alias("meetings"))
    m = _matches(spark, d).join(meetings, "best", "left")
    b = O.band(F.col("best_score"), F.col("next_score"), F.col("speech_sec"), F.coalesce("meetings", F.lit(0)))
    return m.select("vec_id", b.alias("band"))


def rematch_counts(spark, d):
    return band_decision(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def _edges(spark, d):
    line, sup, part = S.read(spark, d, "lineitem"), S.read(spark, d, "supplier"), S.read(spark, d, "part")
    return line.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_name").alias("src"), F.col("l_returnflag").alias("predicate"), F.col("p_brand").alias("dst"), F.col("l_orderkey").alias("meeting_id"))


def graph_edges(spark, d):
    e = _edges(spark, d)
    return e.groupBy("src", "predicate", "dst").agg(F.min("meeting_id").alias("meeting_id")).withColumn("description", F.concat_ws(" ", "src", "predicate", "dst"))


def graph_nodes(spark, d):
    e = _edges(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("name"), "meeting_id")
    return n.groupBy("name").agg(F.countDistinct("meeting_id").alias("meetings"), F.min("meeting_id").alias("first_meeting"))


def graph_neighbourhood(spark, d):
    e = _edges(spark, d)
    return O.neighbourhood(e, e.where("dst = 'Brand#11'").select(F.col("dst").alias("node")).distinct(), 2)


V = "s AS (SELECT vec_id, label AS person, vec_id % 7 AS meeting_id, CAST(10 + vec_id % 60 AS DOUBLE) AS speech_sec, embedding, vec_id % 5 = 0 AS pending FROM embeddings), u AS (SELECT vec_id, person, pending, speech_sec, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, person, pending, speech_sec, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS pos FROM s)), q AS (SELECT person, pos, sum(x * greatest(speech_sec, 0.1)) / sum(greatest(speech_sec, 0.1)) AS x FROM u WHERE NOT pending GROUP BY person, pos), p AS (SELECT person, pos, x / sqrt(sum(x * x) OVER (PARTITION BY person)) AS x FROM q)"
SC = f"{V}, c AS (SELECT u.vec_id, p.person, round(sum(u.x * p.x), 6) AS score FROM u JOIN p ON p.pos = u.pos WHERE u.pending GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, person) AS k FROM c), m AS (SELECT vec_id, max(CASE WHEN k = 1 THEN person END) AS best, max(CASE WHEN k = 1 THEN score END) AS best_score, coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS next_score FROM r WHERE k <= 2 GROUP BY vec_id)"
BD = f"{SC}, k2 AS (SELECT person, count(DISTINCT meeting_id) AS n FROM s WHERE NOT pending GROUP BY person), bd AS (SELECT m.vec_id, CASE WHEN best_score IS NULL OR best_score < 0.38 THEN 'new' WHEN s.speech_sec < 30 OR k2.n < 2 OR best_score < 0.62 OR best_score - next_score < 0.12 THEN 'review' ELSE 'auto' END AS band FROM m JOIN s ON s.vec_id = m.vec_id LEFT JOIN k2 ON k2.person = m.best)"
G = "e AS (SELECT s_name AS src, l_returnflag AS predicate, p_brand AS dst, l_orderkey AS meeting_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"
QUERIES = {
    "vector_normalize": (vector_normalize, f"WITH {V} SELECT vec_id, pos, round(x, 4) + 0.0 AS x FROM u"),
    "voiceprint_weighted": (voiceprint_weighted, f"WITH {V} SELECT person, pos, round(x, 4) + 0.0 AS x FROM p"),
    "match_top2": (match_top2, f"WITH {SC} SELECT vec_id, best, round(best_score, 4) AS best_score, round(next_score, 4) AS next_score FROM m"),
    "band_decision": (band_decision, f"WITH {BD} SELECT vec_id, band FROM bd"),
    "rematch_counts": (rematch_counts, f"WITH {BD} SELECT band, count(*) AS n FROM bd GROUP BY band"),
    "graph_edges": (graph_edges, f"WITH {G} SELECT src, predicate, dst, min(meeting_id) AS meeting_id, src || ' ' || predicate || ' ' || dst AS description FROM e GROUP BY src, predicate, dst"),
    "graph_nodes": (graph_nodes, f"WITH {G} SELECT name, count(DISTINCT meeting_id) AS meetings, min(meeting_id) AS first_meeting FROM (SELECT src AS name, meeting_id FROM e UNION ALL SELECT dst, meeting_id FROM e) GROUP BY name"),
    "graph_neighbourhood2": (graph_neighbourhood, f"WITH {G}, f AS (SELECT DISTINCT src, dst FROM e), b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f)), h0 AS (SELECT DISTINCT dst AS node FROM f WHERE dst = 'Brand#11'), h1 AS (SELECT DISTINCT dst AS node FROM b JOIN h0 ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM b JOIN h1 ON src = node) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node"),
}
