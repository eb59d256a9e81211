"""Average linkage over unit vectors, by rounds of reciprocal nearest neighbours.

The mean cosine of two groups is the product of their mean vectors, so a group is one vector and a
size, and merging two (the Lance-Williams update of average linkage) is their weighted mean: no
matrix of all pairs is ever kept. A merged group is never nearer to a third than the nearer of its
parts was, so pairs that are each other's nearest can be merged all at once, and a group must look
for its nearest anew only if that one was merged.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import voices
from tallyfold.operators.voices import in_blocks

#: So many groups or fewer are merged to the end in one task.
LAST = 512
#: Vectors of one side of a block at most (an eighth of all, unless those are few), and so many are compared with WIDE of the other side at once, or fewer with more.
BLOCK, ROWS, WIDE = 65536, 512, 8192


def forgetting(keep: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """keep, without the size that Spark takes the table to have.

    checkpoint() cuts the lineage but hands that size on, and a join's is the product of its sides': from
    round to round it would get several times as many digits, until the driver has no memory for the number.
    """

    def kept(df: DataFrame) -> DataFrame:
        made = keep(df)
        session = made.sparkSession
        return DataFrame(session._jsparkSession.createDataFrame(made._jdf.toJavaRDD(), made._jdf.schema()), session)

    return kept


def nearest(asked: DataFrame, groups: DataFrame, threshold: float | None = None) -> DataFrame:
    """id, best, score: the group (id, v) with the largest product with each asked one (id, v), itself left out; the larger id of equals.

    Both sides meet block by block, and of each block only the best of every row is kept, if it is at or
    above the threshold.
    """

    rows, wide = ROWS, WIDE

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(a) or not len(b):
            return pd.DataFrame()
        b = b.sort_values("id", ascending=False)
        ids, others, found = b.id.to_numpy(), np.stack(b.v.to_numpy()).T, []
        own = pd.Index(ids).get_indexer(a.id)
        step = max(1, min(rows, rows * wide // len(b)))
        for at in range(0, len(a), step):
            part, here = a.iloc[at : at + step], own[at : at + step]
            scores = np.stack(part.v.to_numpy()) @ others
            mine = np.flatnonzero(here >= 0)
            scores[mine, here[mine]] = -np.inf
            top = scores.max(1)
            some = np.flatnonzero(top > -np.inf if threshold is None else np.round(top, 9) >= threshold)
            if len(some):
                # scores count by nine digits: only rows with another score that near need all of them rounded
                scores, top = scores[some], top[some]
                first = scores.argmax(1)
                for i in np.flatnonzero((scores >= (top - 2e-9)[:, None]).sum(1) > 1):
                    first[i] = np.round(scores[i], 9).argmax()
                found.append(pd.DataFrame({"id": part.id.to_numpy()[some], "best": ids[first], "score": np.round(top, 9)}))
        return pd.concat(found) if found else pd.DataFrame()

    kind = dict(groups.dtypes)["id"]
    found = in_blocks(asked.select("id", "v"), groups.select("id", "v"), lambda a, b: work(a, b), f"id {kind}, best {kind}, score double", min(BLOCK, max(voices.BLOCK, groups.count() // 8)))
    return found.groupBy("id").agg(F.max(F.struct("score", "best")).alias("m")).select("id", "m.best", "m.score")


def _merged(df: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """id, cluster of a few groups (id, n, v): one best pair after the other, of equals that of the larger ids."""
    import numpy as np

    df = df.sort_values("id")
    ids, n, v = df.id.to_numpy(), df.n.to_numpy().copy(), np.stack(df.v.to_numpy()).astype(float)
    into, size = np.arange(len(ids)), len(ids)
    scores = np.tril(np.round(v @ v.T, 9), -1)
    scores[np.triu_indices(size)] = -np.inf
    while True:
        i, j = divmod(size * size - 1 - int(scores.ravel()[::-1].argmax()), size)
        if not scores[i, j] >= threshold:
            return pd.DataFrame({"id": ids, "cluster": ids[into]})
        v[j] = (n[j] * v[j] + n[i] * v[i]) / (n[j] + n[i])
        n[j] += n[i]
        into[into == i] = j
        scores[i, :] = scores[:, i] = -np.inf
        row = np.round(v @ v[j], 9)
        live = np.isin(np.arange(size), into)
        scores[j, :j] = np.where(live[:j], row[:j], -np.inf)
        scores[j + 1 :, j] = np.where(live[j + 1 :], row[j + 1 :], -np.inf)


def linkage(units: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """id, cluster (its smallest id) of unit vectors (id, v): the best pair of groups is merged while its mean cosine is at or above the threshold.

    Exactly the groups that merging one best pair after the other gives; of exact ties, the pair of
    larger ids goes first. Equal vectors, which no pair is nearer than, are one group from the start:
    in rounds only two of them would be merged at once. Once LAST groups or fewer are left that can
    still be merged, one task does. keep cuts the lineage: checkpoint() by default.
    """
    kind, keep = dict(units.dtypes)["id"], forgetting(keep)
    nobody, unsaid = F.lit(None).cast(kind), F.lit(None).cast("double")
    # a vector of no length isn't near to itself
    near = F.round(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x), 9) >= threshold
    equal = keep(units.groupBy("v", F.when(near, nobody).otherwise(F.col("id")).alias("own")).agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n")))
    first = equal.where("n > 1").select(F.col("v").alias("_v"), F.col("id").alias("_i"))
    # only what has moved to another group: id, cluster
    moved = keep(units.join(first, (F.col("v") == F.col("_v")) & (F.col("id") != F.col("_i"))).select("id", F.col("_i").alias("cluster")))
    groups = equal.select("id", "n", "v", nobody.alias("best"), unsaid.alias("score"))

    def moving(into: DataFrame) -> DataFrame:
        """moved after the groups _b have gone into _a."""
        old = moved.join(into, F.col("cluster") == F.col("_b"), "left").select("id", F.coalesce("_a", "cluster").alias("cluster"))
        return old.unionByName(into.select(F.col("_b").alias("id"), F.col("_a").alias("cluster")))

    def labels() -> DataFrame:
        return units.select("id").join(moved.select(F.col("id").alias("_i"), F.col("cluster").alias("_c")), F.col("id") == F.col("_i"), "left").select("id", F.coalesce("_c", "id").alias("cluster"))

    renewed = True  # whether every group has looked at all groups as they are now
    while True:
        if groups.count() <= LAST:
            last = keep(groups.select("id", "n", "v", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda df: _merged(df, threshold), f"id {kind}, cluster {kind}"))
            moved = moving(last.where("id <> cluster").select(F.col("id").alias("_b"), F.col("cluster").alias("_a")))
            return labels()
        looking = groups.where("best IS NULL")
        found = nearest(looking, groups, threshold).select(F.col("id").alias("_i"), F.col("best").alias("_b"), F.col("score").alias("_s"))
        rows = groups.join(found, F.col("id") == F.col("_i"), "left").select("id", "n", "v", F.coalesce("best", "_b").alias("best"), F.coalesce("score", "_s").alias("score"))
        # a group without any near one stays as it is, and is nobody's near one either
        groups = keep(rows.where(F.col("score") >= threshold))
        other = groups.select(F.col("id").alias("_i"), F.col("best").alias("_b"), F.col("n").alias("_n"), F.col("v").alias("_v"))
        # no alias is named as a column of the functions in lambdas: Spark would take the alias there
        pairs = keep(groups.join(other, (F.col("best") == F.col("_i")) & (F.col("id") == F.col("_b")) & (F.col("id") < F.col("_i"))).select(F.col("id").alias("a"), F.col("_i").alias("b"), (F.col("n") + F.col("_n")).alias("both"), F.zip_with(F.transform("v", lambda x: x * F.col("n")), F.transform("_v", lambda x: x * F.col("_n")), lambda x, y: (x + y) / (F.col("n") + F.col("_n"))).alias("v")))
        if pairs.isEmpty():
            if renewed or groups.isEmpty():
                return labels()
            # equal scores that were kept from earlier rounds can point in a ring: all look anew
            groups, renewed = groups.withColumns({"best": nobody, "score": unsaid}), True
            continue
        gone = pairs.select(F.explode(F.array("a", "b")).alias("_g"))
        left = groups.join(gone, F.col("id") == F.col("_g"), "left_anti").join(gone, F.col("best") == F.col("_g"), "left")
        lost = F.col("_g").isNotNull()
        left = left.select("id", "n", "v", F.when(~lost, F.col("best")).alias("best"), F.when(~lost, F.col("score")).alias("score"))
        groups = keep(left.unionByName(pairs.select(F.col("a").alias("id"), F.col("both").alias("n"), "v", nobody.alias("best"), unsaid.alias("score"))))
        moved = keep(moving(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"))))
        renewed = False
