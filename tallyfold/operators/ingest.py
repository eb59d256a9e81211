"""Files, downloads, transcripts, glossaries and the stage ladder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold import sources as S

#: The stages of a meeting in order; failed stands beside them.
LADDER = ("discovered", "transcribed", "speakers_resolved", "minutes_compiled", "indexed")
FAILED = "failed"
#: How sure a speaker's name is, weakest first.
CONFIDENCE = ("unknown", "inferred", "confirmed")


# Files


def file_outcomes(files: DataFrame, seen: DataFrame, known: DataFrame) -> DataFrame:
    """path, outcome of files (path, size, mtime, sha256): skipped, duplicate or ingested.

    Files seen with the same path, size and mtime are skipped; of the rest the first path of a content
    that isn't known yet (known: sha256) is ingested.
    """
    s = seen.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m")).distinct()
    rows = files.join(s, (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")), "left")
    k = known.select(F.col("sha256").alias("_h")).distinct()
    rows = rows.join(k, F.col("sha256") == F.col("_h"), "left")
    first = rows.where("_p IS NULL AND _h IS NULL").groupBy("sha256").agg(F.min("path").alias("_first"))
    rows = rows.join(first.withColumnRenamed("sha256", "_f"), F.col("sha256") == F.col("_f"), "left")
    return rows.select("path", F.when(F.col("_p").isNotNull(), "skipped").when(F.col("_h").isNull() & (F.col("path") == F.col("_first")), "ingested").otherwise("duplicate").alias("outcome"))


def ingest_folder(spark, folder: str, suffixes: Sequence[str], seen: DataFrame, known: DataFrame, out: str) -> DataFrame:
    """path, outcome of every file below a folder: what was seen is skipped by path, size and time before any content is read.

    seen: path, size, mtime; known: sha256; `out` is a folder for the digests of the others.
    """
    listed = S.listing(spark, folder, list(suffixes))
    fresh = S.digests(spark, S.unseen(listed, seen), out)
    first = fresh.join(known.select("sha256").distinct(), "sha256", "left_anti").groupBy("sha256").agg(F.min("path").alias("_first"))
    read = fresh.join(first, "sha256", "left").select("path", F.when(F.col("path") == F.col("_first"), "ingested").otherwise("duplicate").alias("outcome"))
    skipped = listed.join(fresh.select("path"), "path", "left_anti").select("path", F.lit("skipped").alias("outcome"))
    return read.unionByName(skipped)


def eligibility(suffix: Column, handled: Column, failed: Column, recorded: Column, cutoff: Column, suffixes: Sequence[str]) -> Column:
    """What becomes of a listed file: ignored, handled, ambiguous (no date), eligible or excluded."""
    return (
        F.when(~F.lower(suffix).isin(*suffixes), "ignored")
        .when(handled & ~failed, "handled")
        .when(recorded.isNull(), "ambiguous")
        .when(recorded >= cutoff, "eligible")
        .otherwise("excluded")
    )


def verified(listed: DataFrame, files: DataFrame) -> DataFrame:
    """id, ok: whether the downloaded file (id, size, md5) has the listed size and, where one is listed, md5."""
    f = files.select(F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("md5").alias("_md5"))
    ok = (F.col("size") == F.col("_size")) & (F.col("md5").isNull() | (F.col("md5") == F.col("_md5")))
    return listed.join(f, F.col("id") == F.col("_id"), "left").select("id", F.coalesce(ok, F.lit(False)).alias("ok"))


def reconcile(sources: DataFrame, meetings: DataFrame) -> DataFrame:
    """sources (source_id, path, sha256, meeting_id) with meeting_id filled in by path, else by content; meetings: id, path, sha256."""
    by_path = meetings.where("path IS NOT NULL").groupBy(F.col("path").alias("_p")).agg(F.min("id").alias("_a"))
    by_hash = meetings.where("sha256 IS NOT NULL").groupBy(F.col("sha256").alias("_h")).agg(F.min("id").alias("_b"))
    rows = sources.join(by_path, F.col("path") == F.col("_p"), "left").join(by_hash, F.col("sha256") == F.col("_h"), "left")
    return rows.withColumn("meeting_id", F.coalesce("meeting_id", "_a", "_b")).drop("_p", "_a", "_h", "_b")


def same_version(asked: DataFrame, current: DataFrame) -> DataFrame:
    """id, version of those asked for; any action on them raises if an id's current version (id, version) is another one."""
    from tallyfold.operators.keys import required

    c = current.select(F.col("id").alias("_id"), F.col("version").alias("_v"))
    rows = asked.join(c, F.col("id") == F.col("_id"), "left")
    return rows.where(required(F.col("version").eqNullSafe(F.col("_v")), F.concat(F.lit("another version of "), F.col("id").cast("string")))).select("id", "version")


def unfinished(sources: DataFrame, done: Sequence[str] = ("ingested", "excluded")) -> DataFrame:
    """state, n of sources that keep a backfill from being complete; no rows mean that it is."""
    return sources.where(F.col("state").isNull() | ~F.col("state").isin(*done)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# Transcripts and glossaries

_WORD = "struct<start: double, end: double, word: string, text: string, speaker: string>"
#: What a recogniser gives for a recording; any field may be missing.
RECOGNISED = f"struct<segments: array<struct<start: double, end: double, text: string, speaker: string, words: array<{_WORD}>>>>"


def segments_of(raw: Column) -> Column:
    """Segments (start, end, text, speaker, words) of a recogniser's JSON: blank words go, a text that is
    missing is made of its words, segments without any text go, missing times are 0."""
    both = lambda w: F.coalesce(F.nullif(w["word"], F.lit("")), F.nullif(w["text"], F.lit("")))
    word = lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.trim(both(w)).alias("text"), w["speaker"].alias("speaker"))
    listed = lambda s: F.transform(F.filter(F.coalesce(s["words"], F.array().cast(f"array<{_WORD}>")), lambda w: both(w).isNotNull()), word)

    def segment(s: Column) -> Column:
        own = F.trim(F.coalesce(s["text"], F.lit("")))
        text = F.when(own != "", own).otherwise(F.array_join(F.transform(listed(s), lambda w: w["text"]), " "))
        zero = F.lit(0.0)
        return F.struct(F.coalesce(s["start"], zero).alias("start"), F.coalesce(s["end"], zero).alias("end"), text.alias("text"), s["speaker"].alias("speaker"), listed(s).alias("words"))

    given = F.coalesce(F.from_json(raw, RECOGNISED)["segments"], F.from_json(F.lit('{"segments": []}'), RECOGNISED)["segments"])
    return F.filter(F.transform(given, segment), lambda s: s["text"] != "")


def duration_of(segments: Column) -> Column:
    """The end of the last segment, 0 without any."""
    return F.coalesce(F.array_max(F.transform(segments, lambda s: s["end"])), F.lit(0.0))


def labels_of(segments: Column) -> Column:
    """Speaker labels by first appearance."""
    return F.array_distinct(F.filter(F.transform(segments, lambda s: s["speaker"]), lambda x: x.isNotNull()))


def glossary(lines: DataFrame, heading: str | None = None) -> DataFrame:
    """path, term of list items of glossaries (path, pos, line), of one section if a heading is given.

    A term ends at " - ", "/", ":" or "("; emphasis is taken off, comments are left out.
    """
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.nullif(F.lower(F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1))), F.lit(""))
    rows = lines.withColumn("_under", F.last(title, ignorenulls=True).over(w))
    if heading is not None:
        rows = rows.where(F.col("_under") == heading.lower())
    item = F.regexp_extract("line", r"^\s*[-*+]\s+(.*)$", 1)
    term = F.trim(F.regexp_replace(F.regexp_replace(item, r"(?:\s+[-–—]\s|[/:(]).*$", ""), r"[*_`]", ""))
    return rows.where(~F.trim("line").startswith("<!--")).select("path", "pos", term.alias("term")).where("term <> ''").select("path", "term")


def overrides(spark, text: str) -> DataFrame:
    """prefix, label, name, rank of a YAML file of speaker names: the default block, then blocks by the beginning of a meeting's id."""
    import yaml

    blocks = yaml.safe_load(text) or {}
    rows = [("" if k == "default" else str(k), str(label), str(name), 0 if k == "default" else i + 1) for i, (k, v) in enumerate(blocks.items()) for label, name in (v or {}).items()]
    return spark.createDataFrame(rows, "prefix string, label string, name string, rank int")


def overridden(speakers: DataFrame, given: DataFrame) -> DataFrame:
    """meeting_id, label, name: the name that the last block that fits a meeting gives a label. given is a short list."""
    found = speakers.select("meeting_id", "label").join(given.withColumnRenamed("label", "_l"), (F.col("label") == F.col("_l")) & F.startswith(F.col("meeting_id"), F.col("prefix")))
    return found.groupBy("meeting_id", "label").agg(F.max_by("name", "rank").alias("name"))


# Stages


def stage_rank(status: Column) -> Column:
    """Place of a status on the ladder, from 1; 0 for failed, null for others."""
    at = F.array_position(F.array(*map(F.lit, LADDER)), status)
    return F.when(status == FAILED, F.lit(0).cast("long")).when(at > 0, at)


#: So many failed meetings are broadcast to fetch their errors.
FEW = 1_000_000


def advance(log: DataFrame, cut: int = 4000) -> DataFrame:
    """id, status, error of a log of transitions (id, at, status, error): the last known status, the error (cut) only if it failed.

    Of one moment the larger status counts, of its errors the largest. Errors are long: the last
    status is found without them, and only those of meetings that failed last are sorted.
    """
    known = log.where(stage_rank(F.col("status")).isNotNull())
    last = known.groupBy("id").agg(F.max(F.when(F.col("at").isNotNull(), F.struct("at", "status"))).alias("l"))
    failed = last.where(F.col("l.status") == FAILED).select(F.col("id").alias("_i"), F.col("l.at").alias("_at"))
    failed = F.broadcast(failed) if failed.count() <= FEW else failed.hint("shuffle_hash")
    said = known.where(F.col("status") == FAILED).join(failed, F.col("id").eqNullSafe(F.col("_i")) & (F.col("at") == F.col("_at")))
    errors = said.groupBy(F.col("id").alias("_i")).agg(F.max(F.substring("error", 1, cut)).alias("error"))
    return last.join(errors, F.col("id").eqNullSafe(F.col("_i")), "left").select("id", "l.status", "error")


def claim(meetings: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """The queue of a stage, oldest first: dates that are missing last, times that are missing first."""
    rows = meetings.where(F.col("status") == status).orderBy(F.col("meeting_date").asc_nulls_last(), F.col("meeting_time").asc_nulls_first(), "created_at", "id")
    return rows if limit is None else rows.limit(limit)


def paired_runs(events: DataFrame) -> DataFrame:
    """run_id, meeting_id, stage, started, finished, ok, seconds of open and close events (run_id, kind, at, ok ...)."""
    e = events.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "start", F.struct("at", "meeting_id", "stage"))).alias("s"), F.max(F.when(F.col("kind") == "finish", F.struct("at", "ok"))).alias("f"))
    return e.where("s IS NOT NULL").select("run_id", "s.meeting_id", "s.stage", F.col("s.at").alias("started"), F.col("f.at").alias("finished"), "f.ok", (F.unix_micros("f.at") - F.unix_micros("s.at")).cast("double").alias("micros")).withColumn("seconds", F.col("micros") / 1e6).drop("micros")


def merge_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """meeting_id, label, name, confidence of old and new names: a confirmed one only gives way to a confirmed one, none never takes a name away."""
    n = new.select("meeting_id", "label", F.nullif("name", F.lit("")).alias("_name"), F.col("confidence").alias("_conf"))
    rows = old.join(n, ["meeting_id", "label"], "full")
    had = F.col("confidence").isNotNull()
    keep = (had & (F.col("confidence") == "confirmed") & ~F.col("_conf").eqNullSafe(F.lit("confirmed"))) | (F.col("_name").isNull() & F.col("name").isNotNull()) | F.col("_conf").isNull()
    return rows.select("meeting_id", "label", F.when(keep, F.col("name")).otherwise(F.col("_name")).alias("name"), F.when(keep, F.col("confidence")).otherwise(F.col("_conf")).alias("confidence"))


def resolve(old: DataFrame, inferred: DataFrame, confirmed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Speaker names after a pass: inferred ones, over them confirmed ones, by their canonical names, merged with what was known."""
    i = inferred.select("meeting_id", "label", F.col("name").alias("_i"))
    c = confirmed.select("meeting_id", "label", F.col("name").alias("_c"))
    rows = i.join(c, ["meeting_id", "label"], "full")
    rows = rows.select("meeting_id", "label", F.coalesce("_c", "_i").alias("_given"), F.when(F.col("_c").isNotNull(), "confirmed").when(F.col("_i").isNotNull(), "inferred").otherwise("unknown").alias("confidence"))
    a = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_n"))
    named = rows.join(a, F.lower(F.trim("_given")) == F.col("_a"), "left").select("meeting_id", "label", F.coalesce("_n", F.trim("_given")).alias("name"), "confidence")
    return merge_names(old, named)
