"""Operator 13: an audit of how filters interact, by the Walsh-Hadamard transform.

Each document gets a mask: bit k is set if it fails filter k. For each part and label, 2^n signed
parity sums are added up (the sign of a document in sum t is that of the parity of mask & t); the
sums are inverted exactly to the number of documents of each mask, and all orders of the filters
are read from those. A document that fails j filters is removed by each of them in one j-th of all
orders, so the Shapley column is the cells' sum of (orders / j) in closed form.

Signed sums are linear, so the filter "same text as a smaller id" needs no join of copies: all
rows count as failing it first, and the first of each text is then moved to the cell without it.

Defined results: null text counts as empty; a null part is the empty string; a row without an id
neither repeats another nor is repeated by others, and has no label; rows that repeat an id and its
text are not copies of each other, each is counted; of several labels of an id any 1 counts; texts
of any length are read whole; an empty table gives no rows; other columns are ignored. Texts are
told apart by sha256 and length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Scratch, map_texts, table

#: The filters, by bit.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Words of longer texts are gathered piece by piece.
PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
#: Rows without an id are spread over so many join keys.
SALTS = 64


def word_counts(data: bytes) -> tuple[int, int]:
    """Words and distinct words; only the distinct words are held, besides one piece."""
    if len(data) <= PIECE:
        words = data.split()  # bytes are split at exactly these six
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and data[to] not in _SPACE:  # a word isn't cut
            to += 1
        words = data[at:to].split()
        n, at = n + len(words), to
        seen.update(words)
    return n, len(seen)


def failures(text: str) -> int:
    """Bits 0 to 3 of the mask: few words, repeated words, capitals, symbols."""
    data = text.encode()
    n, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (n < LEAST_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * len(text)) << 2 | any(c in data for c in SYMBOLS) << 3


def parity(shared: Column, n: Column) -> Column:
    """n with the sign that documents have in a sum, by the bits that their mask shares with the sum's number."""
    return F.when(F.bit_count(shared) % 2 == 0, n).otherwise(-n)


def parity_sums(rows: DataFrame, keys: Sequence[str], filters: int, mask: str = "mask", n: str = "n") -> DataFrame:
    """keys and sums: the 2^filters signed sums of n. Combined on the map side, so a hot part is a few rows for each task."""
    size = 1 << filters
    sums = rows.groupBy(*keys).agg(*(F.sum(parity(F.col(mask).bitwiseAND(F.lit(t)), F.col(n))).alias(f"_s{t}") for t in range(size)))
    return sums.select(*keys, F.array(*(f"_s{t}" for t in range(size))).alias("sums"))


def invert(sums: DataFrame, filters: int, column: str = "sums") -> DataFrame:
    """The sums replaced by cells: documents of each mask. The transform is its own inverse but for 2^filters; the division is exact."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    signed = lambda m: F.zip_with(F.col(column), every, lambda s, t: parity(m.bitwiseAND(t), s))
    return sums.withColumn("cells", F.transform(every, lambda m: F.shiftright(_total(signed(m)), filters))).drop(column)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def evaluate(parts: DataFrame, names: str = FILTERS, keys: Sequence[str] = ("part",)) -> DataFrame:
    """keys, filter_order, step and counts of every order of the filters, of one row for each part: keys, all, good, toxic (cells)."""
    every, each = F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)), F.sequence(F.lit(0), F.lit(len(names) - 1))
    cells = lambda c, test: _total(F.filter(c, lambda x, m: test(m)))
    # what a set of filters leaves: the cells of masks without any of them
    left = lambda c: F.transform(every, lambda p: cells(F.col(c), lambda m: m.bitwiseAND(p) == 0)).alias(f"_{c}")
    has = lambda m, k: F.get(F.array(*(m.bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(names)))), k)
    failing = F.transform(each, lambda k: cells(F.col("all"), lambda m: has(m, k))).alias("_failing")
    alone = F.array(*(F.col("all")[1 << k] for k in range(len(names)))).alias("_alone")
    # in a j-th of all orders each of the j filters that a document fails comes first
    share = F.transform("all", lambda c, m: F.when(m > 0, c * F.lit(factorial(len(names))) / F.bit_count(m)).otherwise(0).cast("long"))
    shapley = F.transform(each, lambda k: _total(F.filter(share, lambda x, m: has(m, k)))).alias("_shapley")
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"o": "".join(names[x] for x in order), "k": k + 1, "f": f, "b": before, "a": before | 1 << f})
            before |= 1 << f
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,k:int,f:int,b:int,a:int>>")  # a constant
    wide = parts.select(*keys, left("all"), left("good"), left("toxic"), failing, alone, shapley).select("*", F.explode(plan).alias("_p"))
    at = lambda c, i: F.get(F.col(c), F.col(f"_p.{i}"))
    lost = lambda c: at(c, "b") - at(c, "a")
    return wide.select(
        *keys,
        F.col("_p.o").alias("filter_order"),
        F.col("_p.k").alias("step"),
        at("_all", "a").alias("kept"),
        lost("_all").alias("removed"),
        (at("_failing", "f") - lost("_all")).alias("redundant"),
        at("_alone", "f").alias("unique_fails"),
        lost("_good").alias("good_lost"),
        lost("_toxic").alias("toxic_lost"),
        at("_shapley", "f").alias("shapley"),
    )


#: The labels of the sums: all documents, those of quality 1, those that are toxic.
LABELS = ("all", "good", "toxic")


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """The audit of rows (part, mask, n, good, toxic), whose n may be negative: any filters, up to seven."""
    if not 1 <= len(names) <= 7:
        raise ValueError("one to seven filters")
    labels = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))
    rows = masks.select(F.coalesce("part", F.lit("")).alias("part"), F.col("mask").cast("int").alias("mask"), F.col("n").cast("long").alias("n"), F.explode(labels).alias("label"))
    cells = invert(parity_sums(rows, ["part", "label"], len(names)), len(names))
    zeros = F.array_repeat(F.lit(0).cast("long"), 1 << len(names))
    return evaluate(cells.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), zeros).alias(x) for x in LABELS)), names)


def mask_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic of documents by the five filters; some n are negative, their sums are right."""
    def make():
        def work(texts: list[str]) -> dict:
            data = [t.encode() for t in texts]
            return {"mask": pa.array([failures(t) for t in texts], pa.int32()), "_sha": pa.array([hashlib.sha256(d).digest() for d in data], pa.binary()), "_len": pa.array([len(d) for d in data], pa.int64())}

        return work

    kept = {"_id": f"`{id_col}`", "part": f"coalesce(cast(`{part_col}` AS string), '')"}
    read = map_texts(docs, text_col, kept, "mask int, _sha binary, _len long", make)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_k")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).withColumn("_z", F.lit(0))
    # rows that repeat an id, its text and part are counted before they meet anything
    each = read.groupBy("_sha", "_len", "_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("_salt", F.when(F.col("_id").isNull(), F.pmod(F.xxhash64("_sha"), F.lit(SALTS)).cast("int") + 1).otherwise(F.lit(0)))
    no = F.lit(False)
    labelled = each.join(known, (F.col("_id") == F.col("_k")) & (F.col("_salt") == F.col("_z")), "left").select("_sha", "_len", "_id", "part", "mask", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    rows = Scratch(docs.sparkSession, "audit").keep(labelled, "rows")
    copy = 1 << 4
    every = rows.select("part", F.when(F.col("_id").isNotNull(), F.col("mask").bitwiseOR(F.lit(copy))).otherwise(F.col("mask")).alias("mask"), "n", "good", "toxic")
    # the smallest id of each text: equal texts are combined on the map side, and the join's key holds the id
    first = rows.where("_id IS NOT NULL").groupBy(F.col("_sha").alias("_fs"), F.col("_len").alias("_fl")).agg(F.min("_id").alias("_fi"))
    firsts = rows.join(first, (F.col("_sha") == F.col("_fs")) & (F.col("_len") == F.col("_fl")) & (F.col("_id") == F.col("_fi")))
    moved = firsts.select("part", F.explode(F.array(F.struct(F.col("mask"), F.col("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (-F.col("n")).alias("n")))).alias("_m"), "good", "toxic")
    return every.unionByName(moved.select("part", "_m.mask", "_m.n", "good", "toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return audit(mask_rows(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT w.part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(first_id < w.doc_id, false) AS e, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
st AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
y AS (SELECT m.part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept,
    sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost,
    sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
    FROM m, st GROUP BY m.part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM y
"""
