"""Voice identity at size: block matching, clusters, cards, confirmation, clip choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import normalised

#: Vectors of one side of a block.
BLOCK = 4096


def _blocks(df: DataFrame, key: str, salt: int, name: str, vectors: int = BLOCK) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // vectors))
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(n)).cast("int")), n


def in_blocks(left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, vectors: int = BLOCK) -> DataFrame:
    """Every block of left (id, v) beside every block of right (id, v): no side is broadcast, no pair of rows is listed.

    work gets two frames of some `vectors` rows and gives what it keeps of their matrix product. Each
    row is shuffled once for every block of the other side: fewer blocks, fewer copies.
    """
    a, n_a = _blocks(left, "id", 1, "x", vectors)
    b, n_b = _blocks(right, "id", 2, "y", vectors)
    a = a.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    # other names, so that a table can be compared with itself
    b = b.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1)))).select(F.col("id").alias("id_"), F.col("v").alias("v_"), F.col("x").alias("x_"), F.col("y").alias("y_"))
    both = lambda p, q: work(p, q.rename(columns={"id_": "id", "v_": "v"}))
    return a.groupBy("x", "y").cogroup(b.groupBy("x_", "y_")).applyInPandas(lambda p, q: both(p, q), schema)


def match_blocks(pending: DataFrame, prints: DataFrame, k: int = 2) -> DataFrame:
    """id, person, score: the k best prints (id, v) of every pending vector (id, v), by blocks; ties go to the smaller name."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "person": [], "score": []})
        b = b.sort_values("id")
        scores = np.round(np.stack(a.v.to_numpy()) @ np.stack(b.v.to_numpy()).T, 6)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(a)), top.shape[1])
        return pd.DataFrame({"id": a.id.to_numpy()[rows], "person": b.id.to_numpy()[top.ravel()], "score": scores[rows, top.ravel()]})

    kinds = dict(pending.dtypes)["id"], dict(prints.dtypes)["id"]
    found = in_blocks(pending.select("id", "v"), prints.select("id", "v"), lambda a, b: work(a, b), f"id {kinds[0]}, person {kinds[1]}, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "person"))), 1, k)
    return found.groupBy("id").agg(best.alias("r")).select("id", F.explode("r").alias("r")).select("id", "r.person", (-F.col("r.s") + 0.0).alias("score"))


def cluster(pending: DataFrame, threshold: float = 0.72, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """id, cluster (its smallest id) of pending vectors (id, embedding), by average linkage."""
    from tallyfold.operators.linkage import linkage

    return linkage(keep(pending.select("id", normalised(F.col("embedding")).alias("v"))), threshold, keep)


def cards(members: DataFrame, most: int = 50) -> DataFrame:
    """cluster, size, speech, leader, band, guess of clustered rows (id, cluster, speech_sec, best, llm_name), most speech first.

    The leader has the longest speech (the smaller id of equals) and gives the band; the guess is the
    most frequent llm_name (the smaller of equals).
    """
    votes = members.where("llm_name IS NOT NULL").groupBy("cluster", "llm_name").agg(F.count(F.lit(1)).alias("n"))
    guess = votes.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "llm_name")).alias("g")).select("cluster", F.col("g.llm_name").alias("guess"))
    lead = F.min(F.struct((-F.col("speech_sec")).alias("s"), "id", "best")).alias("l")
    rows = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("speech_sec"), 4).alias("speech"), lead).join(guess, "cluster", "left")
    out = rows.select("cluster", "size", "speech", F.col("l.id").alias("leader"), F.when(F.col("l.best").isNotNull(), "review").otherwise("new").alias("band"), "guess")
    return out.orderBy(F.col("speech").desc(), "cluster").limit(most)


def split_cluster(members: DataFrame, which: Column) -> DataFrame:
    """members (id, cluster) with the rows of the chosen clusters as clusters of their own."""
    return members.withColumn("cluster", F.when(which, F.col("id")).otherwise(F.col("cluster")))


def confirm(matches: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """matches (id, state, resolved_as) with the chosen (id, name) resolved, and the samples to enrol (id, person)."""
    pick = chosen.select(F.col("id").alias("_i"), F.col("name").alias("_n"))
    both = matches.join(pick, (F.col("id") == F.col("_i")) & (F.col("state") == "pending"), "left")
    out = both.withColumns({"state": F.when(F.col("_n").isNotNull(), "resolved").otherwise(F.col("state")), "resolved_as": F.coalesce("_n", "resolved_as")})
    return out.drop("_i", "_n"), both.where("_n IS NOT NULL").select("id", F.col("_n").alias("person"))


def choose_clips(regions: Column, words: Column, count: int = 4, clip: float = 6.0, opening: float = 90.0, apart: float = 60.0, cover: float = 0.5) -> tuple[Column, Column]:
    """clips (array of start) and quality (ok or low) of a label's speech regions and word spans (arrays of start, end).

    Whole clips are cut from each region; those of the opening are only taken if there are no others;
    those with few words only if there are no better; picks are `apart` seconds from each other.
    """
    cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor((r["end"] - r["start"]) / clip + 1e-9).cast("int") - 1), lambda i: r["start"] + i * clip)
    none = F.array().cast("array<double>")
    every = F.flatten(F.transform(F.filter(F.array_sort(regions), lambda r: r["end"] - r["start"] >= clip), cut))
    later = F.filter(every, lambda s: s >= opening)
    early = F.size(later) == 0
    eligible = F.when(early, every).otherwise(later)
    spoken = lambda s: F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.greatest(F.lit(0.0), F.least(s + clip, w["end"]) - F.greatest(s, w["start"])))
    dense = F.filter(eligible, lambda s: F.least(spoken(s) / clip, F.lit(1.0)) >= cover)
    silent = (F.size(words) > 0) & (F.size(dense) == 0)
    pool = F.when((F.size(words) > 0) & (F.size(dense) > 0), dense).otherwise(eligible)
    fits = lambda acc, s: (F.size(acc) < count) & F.forall(acc, lambda p: F.abs(p - s) >= apart)
    picked = F.aggregate(pool, none, lambda acc, s: F.when(fits(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    low = early | silent | (F.size(picked) < count)
    return picked, F.when(low, "low").otherwise("ok")
