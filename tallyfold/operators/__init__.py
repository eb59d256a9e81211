"""DataFrame-to-DataFrame operators of the archive: registers, tables as values, turns, vectors."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Tables as values: every write is a function from the old table and a delta to the new table.


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the smallest value of a total order; combined on the map side."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in df.columns if c not in keys)), order).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new win over rows of old with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of old win; of new rows with equal keys the first in order."""
    return old.unionByName(latest(new, keys, order).join(old.select(*keys).distinct(), list(keys), "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """All rows of old under the keys that new has, or that `touched` names (with or without new rows), go."""
    keys = new.select(key) if touched is None else touched.select(key)
    return old.join(keys.distinct(), key, "left_anti").unionByName(new)


def sparse_upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Only supplied (non-null) values of the columns are overwritten, all others stay; unknown keys are inserted, unknown columns raise."""
    if missing := [c for c in (key, *columns) if c not in old.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    n = new.select(key, *(F.col(c).alias(f"_n_{c}") for c in columns))
    return old.join(n, key, "full").select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


# As-of and top-k


def preceding_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], value: Column, k: int) -> Column:
    """The k rows before each row in one pass, newest last."""
    return F.collect_list(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-k, -1))


def top_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Turns


def merge_turns(df: DataFrame, session: str, order: str, speaker: str, text: str) -> DataFrame:
    """Consecutive rows of one speaker become one turn (gaps and islands)."""
    w = Window.partitionBy(session).orderBy(order)
    marked = df.withColumn("_new", (~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) | F.lag(order).over(w).isNull()).cast("long"))
    runs = marked.withColumn("_run", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return runs.groupBy(session, F.col("_run").alias("turn_no"), speaker).agg(F.min(order).alias("first_turn"), F.count(F.lit(1)).alias("merged"), joined.alias("text"))


def pack_windows(lengths: Column, budget: int) -> Column:
    """Greedy packing of an array of lengths: the window number of each, never splitting one; linear."""
    def pack(column: pa.Array) -> pa.Array:
        out = []
        for sizes in column.to_pylist():
            n = used = 0
            row = []
            for x in sizes or ():
                if row and used + x > budget:
                    n, used = n + 1, 0
                used += x + 1
                row.append(n)
            out.append(row)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(pack, "array<int>")(lengths)


# Vectors: profiles, matches, bands


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def profiles(samples: DataFrame) -> DataFrame:
    """person, profile: normalised mean of normalised samples, weighted by speech (at least 0.1)."""
    weight = F.greatest("speech_sec", F.lit(0.1))
    cells = samples.select("person", weight.alias("w"), F.posexplode(normalised(F.col("embedding"))).alias("pos", "x"))
    means = cells.groupBy("person", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    arrays = means.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return arrays.select("person", normalised(F.col("v")).alias("profile"))


#: Profiles are broadcast up to so many bytes, which are counted; beyond it both sides go by blocks.
BROADCAST_BYTES = 16 << 20


def match_top2(pending: DataFrame, prints: DataFrame) -> DataFrame:
    """best and next profile of every pending vector; ties go to the smaller name, without prints there are nulls and 0.

    A few profiles form one array that each pending row is scored against in place. Above the bound
    blocks of profiles meet blocks of pending vectors, and each row keeps its two best of each block.
    """
    size = prints.agg(F.sum(8 * F.size("profile"))).first()[0] or 0
    asked = pending.select("vec_id", "speech_sec", normalised(F.col("embedding")).alias("v"))
    at = lambda i, f: F.get(F.col("r"), i)[f]
    if size > BROADCAST_BYTES:
        from tallyfold.operators.voices import match_blocks

        found = match_blocks(asked.select(F.col("vec_id").alias("id"), "v"), prints.select(F.col("person").alias("id"), F.col("profile").alias("v")))
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "person"))).alias("r")
        best = asked.select("vec_id", "speech_sec").join(found.groupBy(F.col("id").alias("vec_id")).agg(ranked), "vec_id", "left")
    else:
        packed = prints.agg(F.collect_list(F.struct("person", "profile")).alias("ps"))  # one row, an empty array without prints
        scores = F.transform("ps", lambda p: F.struct((-F.round(dot(p["profile"], F.col("v")), 6)).alias("s"), p["person"].alias("person")))
        best = asked.join(F.broadcast(packed)).select("vec_id", "speech_sec", F.slice(F.array_sort(scores), 1, 2).alias("r"))
    return best.select("vec_id", "speech_sec", at(0, "person").alias("best"), F.coalesce(-at(0, "s") + 0.0, F.lit(0.0)).alias("best_score"), at(1, "person").alias("next"), F.coalesce(-at(1, "s"), F.lit(0.0)).alias("next_score"))


def leave_one_out(samples: DataFrame) -> DataFrame:
    """person, meeting_id, correct: whether a meeting's own samples find their person without them.

    People with samples in two meetings or more are tested. A person's sums without a meeting are
    the sums less that meeting's, so no profile is computed anew; other people keep all samples.
    """
    weight = F.greatest("speech_sec", F.lit(0.1))
    cells = samples.select("person", "meeting_id", weight.alias("w"), F.posexplode(normalised(F.col("embedding"))).alias("pos", "x"))
    held = cells.groupBy("person", "meeting_id", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("h"))
    whole = held.groupBy("person", "pos").agg(F.sum("h").alias("t"), F.count(F.lit(1)).alias("meetings")).where("meetings >= 2")
    cell = F.struct("pos", "h", (F.col("t") - F.col("h")).alias("rest"))
    pairs = held.join(whole, ["person", "pos"]).groupBy("person", "meeting_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    unit = lambda f: normalised(F.transform("c", lambda x: x[f]))
    asked = pairs.select(F.struct("person", "meeting_id").alias("vec_id"), F.lit(0.0).alias("speech_sec"), unit("h").alias("embedding"), F.round(dot(unit("h"), unit("rest")), 6).alias("own"))
    found = match_top2(asked, profiles(samples)).join(asked.select("vec_id", "own"), "vec_id")
    mine = F.col("best") == F.col("vec_id.person")
    other, score = F.when(mine, F.col("next")).otherwise(F.col("best")), F.when(mine, F.col("next_score")).otherwise(F.col("best_score"))
    won = other.isNull() | (F.col("own") > score) | (F.col("own") == score) & (F.col("vec_id.person") < other)
    return found.select("vec_id.person", "vec_id.meeting_id", won.alias("correct"))


#: What a dial adds to the thresholds auto, review and margin.
DIALS = {"cautious": (0.06, 0.05, 0.04), "balanced": (0.0, 0.0, 0.0), "confident": (-0.05, -0.04, -0.03)}


def thresholds(dial: str = "balanced", auto: float = 0.62, review: float = 0.38, margin: float = 0.12) -> dict[str, float]:
    """The thresholds of band() at a setting of the dial."""
    a, r, m = DIALS[dial]
    return {"auto": round(auto + a, 6), "review": round(review + r, 6), "margin": round(margin + m, 6)}


def band(best: Column, nxt: Column, speech: Column, meetings: Column, auto=0.62, review=0.38, margin=0.12, least_speech=30.0, least_meetings=2, over_segmented: Column | None = None, name: Column | None = None, guess: Column | None = None) -> Column:
    """auto, review or new; no best score counts as new. An over-segmented recording, or a guess that isn't the best name, is for review."""
    doubt = (speech < least_speech) | (meetings < least_meetings) | (best < auto) | (best - nxt < margin)
    if over_segmented is not None:
        doubt = doubt | F.coalesce(over_segmented, F.lit(False))
    if name is not None and guess is not None:
        doubt = doubt | F.coalesce(guess != name, F.lit(False))
    return F.when(best.isNull() | (best < review), "new").when(doubt, "review").otherwise("auto")


# Graph


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, hops: nodes within `depth` undirected steps of the seeds (node)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("node", F.lit(0).alias("hops"))
    front = seen
    for h in range(1, depth + 1):
        reached = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        front = reached.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def canonical(df: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """The canonical name by lower-cased, trimmed alias; unknown names stay, trimmed."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    return df.join(a, F.lower(F.trim(column)) == F.col("_alias"), "left").withColumn(out, F.coalesce("_canonical", F.trim(column))).drop("_alias", "_canonical")
