"""Groups from links: buckets without all pairs, and connected components, both spread over tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import Scratch

#: So many members of a bucket's largest component are compared with those outside it, before the
#: rest of them are compared with the whole bucket.
PIVOTS = 6
#: So many members outside the largest component are compared with the whole bucket in one round:
#: each member meets at most so many others.
LEADERS = 256


def components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """id, component (smallest id reachable) for every id of links (a, b), by alternating stars.

    Each round is two joins and two map-side combined minima over the links left, which become
    stars around the smallest id; a hub's rows can be split by AQE, nothing meets in one task.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    k = 0
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.keep(small, f"{name}{k + 1}")
        scratch.drop(f"{name}{k}")
        k += 1
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id")))


def _stars(edges: DataFrame) -> bool:
    """Every end has one centre and no centre is an end."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("c")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("c")))
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("c").alias("c")).where("n > 1 OR n = 1 AND c = 1").isEmpty()


def link_buckets(scratch: Scratch, members: DataFrame, confirm: Callable[[DataFrame], DataFrame], reach: float, near: str = "true", sketches: DataFrame | None = None, closer: str = "true", best: bool = False) -> DataFrame:
    """id, component for the ids of members (bucket, id, p, lead, q) that confirm() links with another.

    members holds the buckets of several ids, each with its smallest id (lead) and that one's payload
    (q, or null: then the first pairs go to confirm unchecked); a member may come more than once. confirm gets candidate pairs (a, b), a < b, and returns a,
    b, d, ok: a distance that obeys the triangle inequality and is at most `reach` for a link, and
    whether they are linked. `near` is a SQL condition on the payloads p and q that every link meets.
    sketches (id, w), if given, are wider payloads, which meet a member only once its bucket is in
    several components; `closer` is a condition on the sketches w and v that every link meets.

    The first round compares each member with the smallest of its bucket. Where that leaves a bucket
    in several components (`best`: each id is first compared with the smallest of those buckets that it
    shares most of, the others then only where components differ), the members outside its largest one are compared with PIVOTS members of
    it. Those still outside are then compared with all of the bucket, at most LEADERS in a round,
    but for pairs that the distances to the smallest member rule out; they then leave the bucket,
    and rounds go on until every pair of a bucket was compared, ruled out or is in one component.
    No link within a bucket is lost, no bucket's pairs are all listed, and there is no cap.
    """
    led = members.where("id <> lead")
    pairs = led.where(f"coalesce({near}, true)").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if sketches is not None:
        pairs = pairs.join(sketches.withColumnRenamed("id", "b"), "b").join(sketches.select(F.col("id").alias("a"), F.col("w").alias("v")), "a").where(closer).select("a", "b", "n")
    if best:
        pairs = scratch.keep(pairs, "pairs")
        top = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("t")).select(F.col("t.a").alias("a"), "b")
        scored = scratch.keep(confirm(top), "top")
        found = components(scratch, scored.where("ok"), "cct_")
        rest = pairs.select("a", "b").join(scored.select("a", "b"), ["a", "b"], "left_anti")
        more = scratch.keep(confirm(_apart(rest, found).select("a", "b")), "rest")
        found = merged(scratch, found, more.where("ok").select("a", "b"), "r")
        scored = scored.unionByName(more)
    else:
        scored = scratch.keep(confirm(pairs.select("a", "b")), "scored")
        found = components(scratch, scored.where("ok"), "cc0_")
    first = scored.select(F.col("a").alias("lead"), F.col("b").alias("id"), "d")
    each = members.select("bucket", "id", "p", "lead").dropDuplicates(["bucket", "id"])
    members = scratch.keep(each.join(first, ["lead", "id"], "left").select("bucket", "id", "p", "d"), "members1")
    k = 0
    while True:
        k += 1
        named = members.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).select("bucket", "id", "p", "d", "c", *(["w"] if k > 1 else []))
        left = _several(named, "c")
        if k == 1:
            left = left.withColumn("w", F.lit(True)) if sketches is None else left.join(sketches, "id")
        left = scratch.keep(left, f"left{k}")
        if left.isEmpty():
            return found
        counts = left.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"))
        sized = left.join(counts.select("bucket", F.col("top.c").alias("top"), F.expr("n - top.n").alias("rest")), "bucket")
        if k == 1:
            chosen, salts = sized.where("c = top"), F.pmod(F.xxhash64("id"), F.lit(PIVOTS))
            others = sized.where("c <> top").drop("top", "rest")
        else:
            chosen, salts = sized.where("c <> top"), F.when(F.col("rest") <= LEADERS, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(LEADERS)))
            others = left
        leaders = chosen.groupBy("bucket", salts.alias("s")).agg(F.max(F.struct("c", "id", "p", "d", "w")).alias("l"), F.max("rest").alias("rest"))
        leaders = scratch.keep(leaders.select("bucket", F.col("l.id").alias("lead"), F.col("l.c").alias("lc"), F.col("l.p").alias("q"), F.col("l.d").alias("ld"), F.col("l.w").alias("v"), "rest"), f"leaders{k}")
        pairs = others.join(leaders, "bucket").where(f"id <> lead AND c <> lc AND coalesce(abs(d - ld) <= {reach} + 1e-9, true) AND {near} AND {closer}")
        pairs = pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        links = scratch.keep(confirm(pairs).where("ok").select("a", "b"), f"links{k}")
        found = merged(scratch, found, links, str(k))
        members = left.drop("c")
        if k > 1:
            open_ = leaders.where(F.col("rest") > LEADERS)
            if open_.isEmpty():
                return found
            members = members.join(open_.select("bucket").distinct(), "bucket").join(open_.select("bucket", F.col("lead").alias("id")), ["bucket", "id"], "left_anti")


def _apart(links: DataFrame, found: DataFrame) -> DataFrame:
    """a, b, ca, cb: the links (a, b) between different components of found (id, component)."""
    at = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def merged(scratch: Scratch, found: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """found (id, component) with the links (a, b) added: a graph of components only."""
    joined = scratch.keep(_apart(links, found).select(F.col("ca").alias("a"), F.col("cb").alias("b")), f"joined{name}")
    if joined.isEmpty():
        return found
    over = scratch.keep(components(scratch, joined, f"cc{name}_"), f"over{name}")
    up = over.select(F.col("id").alias("component"), F.col("component").alias("top"))
    moved = found.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return scratch.keep(moved.unionByName(over.join(found.select("id"), "id", "left_anti")), f"found{name}")


def _several(members: DataFrame, what: str) -> DataFrame:
    """The rows of the buckets in which `what` takes several values."""
    mixed = members.groupBy("bucket").agg(F.min(what).alias("_lo"), F.max(what).alias("_hi")).where("_lo <> _hi").select("bucket")
    return members.join(mixed, "bucket")
