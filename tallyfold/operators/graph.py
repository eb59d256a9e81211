"""The graph of all meetings: entities and relations of each folded to nodes and edges, and a write that tolerates what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Characters of a node's description, and so many descriptions that could be part of it at most.
DESCRIPTION, FALLBACK = 2000, "other"


def resolved(rows: DataFrame, columns: Sequence[str], speakers: DataFrame) -> DataFrame:
    """rows (meeting_id, columns ...) with names trimmed and speaker labels replaced by the meeting's name for them.

    Rows in which a name is blank, or a label that nobody has been found for, go: unrelated strangers
    have the same labels. speakers: meeting_id, label, name; of several names of a label the largest.
    """
    known = speakers.where("trim(coalesce(name, '')) <> ''").groupBy(F.col("meeting_id").alias("_m"), F.col("label").alias("_l")).agg(F.max(F.trim("name")).alias("_name"))
    label = lambda c: F.startswith(F.upper(c), F.lit("SPEAKER_"))
    some = F.lit(False)
    for column in columns:
        # by explode, so that a name's expression isn't copied into each filter below
        rows = rows.withColumn(column, F.explode(F.filter(F.array(F.trim(column)), lambda x: x != "")))
        some = some | label(column)
    # only rows with labels are shuffled to meet the speakers; the others stay where they are
    found = rows.where(some)
    for column in columns:
        on = (F.col("meeting_id") == F.col("_m")) & (F.when(label(column), F.col(column)) == F.col("_l"))
        found = found.join(known, on, "left").withColumn(column, F.when(label(column), F.col("_name")).otherwise(F.col(column)))
        found = found.where(F.col(column).isNotNull()).select(*rows.columns)
    return rows.where(~some).unionByName(found)


def nodes(entities: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """name, kind, description, meetings of resolved entities (meeting_id, name, kind, description), and their sources (name, meeting_id).

    The kind is the first that isn't the fallback; the description joins the distinct ones in order
    of their first row, cut at DESCRIPTION characters. Everything is combined before names meet:
    of a name's descriptions only those that can reach the cut are ever together.
    """
    rows = entities.withColumn("_o", order)
    kind = F.nullif(F.coalesce("kind", F.lit("")), F.lit(""))
    special = F.when(kind.isNotNull() & (kind != FALLBACK), F.struct("_o", kind.alias("k")))
    kinds = rows.groupBy("name").agg(F.min(special).alias("_k"))
    said = rows.withColumn("_d", F.trim(F.coalesce("description", F.lit("")))).where("_d <> ''").groupBy("name", "_d").agg(F.min("_o").alias("_o"))
    ranked = said.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("_o", "_d"))).where(F.col("_r") <= DESCRIPTION // 2)  # one character and a space each, at least
    text = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_d"))), lambda x: x["_d"]), " "), 1, DESCRIPTION)
    texts = ranked.groupBy("name").agg(text.alias("description"))
    sources = rows.select("name", "meeting_id").distinct()
    counts = sources.groupBy("name").agg(F.count(F.lit(1)).alias("meetings"))
    at = F.coalesce("_k.k", F.lit(FALLBACK))
    out = kinds.join(counts, "name").join(texts, "name", "left")
    return out.select("name", at.alias("kind"), F.coalesce("description", F.concat(at, F.lit(" mentioned in the meeting record"))).alias("description"), "meetings"), sources


def edges(relations: DataFrame, names: DataFrame, order: Column) -> DataFrame:
    """source, target, predicate, meeting_id, description, weight of resolved relations (meeting_id, subject, predicate, object).

    Both ends must be nodes, none points to itself; of equal triples the first row gives the meeting.
    """
    rows = relations.withColumn("predicate", F.trim(F.coalesce("predicate", F.lit("")))).where("predicate <> '' AND subject <> object").withColumn("_o", order)
    first = rows.groupBy("subject", "predicate", "object").agg(F.min_by("meeting_id", "_o").alias("meeting_id"))
    ends = names.select("name").distinct()
    for end in ("subject", "object"):
        first = first.join(ends, F.col(end) == F.col("name"), "left_semi")
    return first.select(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "meeting_id", F.concat_ws(" ", "subject", "predicate", "object").alias("description"), F.lit(1.0).alias("weight"))


def payloads(node_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """entity_name, entity_type, description, source_id: nodes as records, whose last field lists all their meetings in order."""
    listed = sources.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(F.col("meeting_id").cast("string"))), "|").alias("source_id"))
    return node_rows.join(listed, "name").select(F.col("name").alias("entity_name"), F.col("kind").alias("entity_type"), "description", "source_id")


def write_new(rows: DataFrame, existing: DataFrame, keys: Sequence[str], path: str) -> dict[str, int]:
    """Appends rows whose keys aren't in existing to a Parquet folder, and says how many were written and skipped, counted in the same pass."""
    have = existing.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_had", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    seen = Observation()
    marked = rows.join(have, on, "left")
    new = F.col("_had").isNull()
    watched = marked.observe(seen, F.count(F.when(new, 1)).alias("written"), F.count(F.when(~new, 1)).alias("skipped"))
    watched.where(new).select(*rows.columns).write.mode("append").parquet(path)
    return dict(seen.get)
