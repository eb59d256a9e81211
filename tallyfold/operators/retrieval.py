"""Ranked evidence for a question: registers, notes, graph, history; timeline of decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold import functions as X


def words_of(question: str, stop: Sequence[str] = X.STOPWORDS, least: int = 3) -> list[str]:
    """The keywords of a question: lower case, without stop words; repeated ones stay."""
    import re

    return [w.lower() for w in re.findall(rf"\b[a-zA-Z0-9_-]{{{least},}}\b", question) if w.lower() not in stop]


def matched(text: Column, words: Sequence[str]) -> tuple[Column, Column]:
    """How many of the words occur in the text as substrings, and how often all together."""
    t = F.coalesce(text, F.lit(""))
    hits = [X.occurrences(t, F.lit(w)) for w in words]
    zero = F.lit(0).cast("long")
    return sum(((h > 0).cast("long") for h in hits), zero), sum(hits, zero)


def least_distinct(words: Sequence[str]) -> int:
    """One word has to occur where there is one, two where there are more."""
    return 1 if len(words) < 2 else 2


def is_named(owner: Column, words: Sequence[str]) -> Column:
    """Whether an owner has a name part of three letters or more among the words (whole parts, without case); false for none."""
    parts = F.filter(F.transform(F.split(F.trim(owner), r"\s+"), F.lower), lambda x: F.length(x) > 2)
    return F.coalesce(F.arrays_overlap(parts, F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")), F.lit(False))


def register_context(registers: DataFrame, question: str, per_register: int = 6, stop: Sequence[str] = X.STOPWORDS) -> DataFrame:
    """The best rows of each register for a question; registers: register, row_id, text, owner (null where there is none).

    A row counts if enough words occur in its text or a named person owns it, which ranks with the
    strongest. Rank by distinct words, then occurrences, then row_id. No keywords, no rows. A row is
    judged where it is: only the best rows of each task are shuffled, without their texts.
    """
    words = words_of(question, stop)
    if not words:
        return registers.limit(0).select("register", "row_id", F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("rank"))
    hits, total = matched(F.col("text"), words)
    rows = registers.select("register", "row_id", is_named(F.col("owner"), words).alias("_owned"), hits.alias("_hits"), total.alias("total"))
    rows = rows.where(F.col("_owned") | (F.col("_hits") >= least_distinct(words))).withColumn("hits", F.when(F.col("_owned"), F.lit(len(words)).cast("long")).otherwise(F.col("_hits")))
    w = Window.partitionBy("register").orderBy(F.col("hits").desc(), F.col("total").desc(), "row_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= per_register).select("register", "row_id", "hits", "total", "rank")


def scan_notes(notes: DataFrame, question: str, top: int = 5, chars: int = 3500, newest: int = 3, newest_chars: int = 3000, stop: Sequence[str] = X.STOPWORDS) -> DataFrame:
    """name, score, text (cut) of the notes (name, text) with most occurrences of the question's words.

    Without keywords every note scores 1. If nothing is hit, the notes of the last names stand in, with score 0.
    """
    words = words_of(question, stop)
    score = matched(F.col("text"), words)[1] if words else F.lit(1).cast("long")
    scored = notes.select("name", score.alias("score"), "text")
    best = scored.where("score > 0").orderBy(F.col("score").desc(), "name").limit(top).select("name", "score", F.substring("text", 1, chars).alias("text"))
    hit = scored.agg(F.coalesce(F.max("score"), F.lit(0)).alias("_top"))
    last = scored.select("name", "text").orderBy(F.col("name").desc()).limit(newest).join(hit.where("_top = 0")).select("name", F.lit(0).cast("long").alias("score"), F.substring("text", 1, newest_chars).alias("text"))
    return best.unionByName(last)


def match_labels(labels: DataFrame, question: str, top: int = 4, stop: Sequence[str] = X.STOPWORDS) -> DataFrame:
    """label, exact, partial of the labels that share words with a question: whole tokens first, then substrings, then the shorter."""
    words = sorted({w.strip("?.,!:;\"'()").lower() for w in question.split()} - set(stop))
    words = [w for w in words if len(w) > 2]
    given = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    exact = F.size(F.array_intersect(F.split(F.lower("label"), r"[\s-]+"), given)).cast("long")
    partial = sum((F.contains(F.lower("label"), F.lit(w)).cast("long") for w in words), F.lit(0).cast("long"))
    rows = labels.select("label", exact.alias("exact"), partial.alias("partial")).where("exact > 0 OR partial > 0")
    return rows.orderBy(F.col("exact").desc(), F.col("partial").desc(), F.length("label"), "label").limit(top)


def graph_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, hops) around the seeds, nearest first, `most` of them, and the edges among them, each once."""
    from tallyfold.operators import neighbourhood

    near = neighbourhood(edges, seeds, depth).groupBy("node").agg(F.min("hops").alias("hops"))
    near = near.join(nodes.select(F.col("name").alias("node")).distinct(), "node", "left_semi").orderBy("hops", "node").limit(most)
    ends = near.select("node")
    kept = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return near, kept.select("src", "predicate", "dst").distinct()


def timeline(meetings: DataFrame, decisions: DataFrame, questions: DataFrame, names: DataFrame, topic: str = "", first: int = 3, shown: int = 6) -> DataFrame:
    """meeting_id, meeting_date, title, headline, decisions of indexed meetings, oldest first.

    decisions, questions: meeting_id, pos, text; names: meeting_id, kind (entity or speaker), name. The
    topic must occur in title, names, decisions or questions; all, everything and nothing don't filter.
    Without a decision the first question stands in, without one a fixed line.
    """
    term = topic.strip().lower()
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias(c)
    d = decisions.groupBy("meeting_id").agg(ordered("d"))
    q = questions.groupBy("meeting_id").agg(ordered("q"))
    n = names.groupBy("meeting_id").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "entity", F.col("name")))).alias("entities"), F.array_sort(F.collect_set(F.when(F.col("kind") != "entity", F.col("name")))).alias("speakers"))
    rows = meetings.where("status = 'indexed'").join(d, "meeting_id", "left").join(q, "meeting_id", "left").join(n, "meeting_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("d", "q", "entities", "speakers")})
    if term not in ("", "all", "everything"):
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "entities", "speakers", "d", "q")), F.lit(term)))
    said = F.when(F.size("d") > 0, F.slice("d", 1, first)).when(F.size("q") > 0, F.slice("q", 1, 1)).otherwise(F.array(F.lit("Meeting indexed and archived in memory.")))
    out = rows.withColumn("said", said).select("meeting_id", "meeting_date", "title", F.get("said", F.lit(0)).alias("headline"), F.array_join("said", "; ").alias("decisions"), F.array_join(F.slice("entities", 1, shown), ", ").alias("entities"))
    return out.orderBy(F.col("meeting_date").asc_nulls_last(), "meeting_id")
