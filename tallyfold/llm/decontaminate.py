"""Operator 6: benchmark decontamination by winnowing, in DataFrame functions only.

Every run of WINDOW words holds WINDOW - K + 1 hashes of K words each; its smallest is kept as a
fingerprint on both sides. A run that a document shares with an item has the same smallest hash on
both sides, so joining the fingerprints finds every shared run of WINDOW words or more. Hits are
then extended: the runs around a hit are compared word for word with the windows of the items.
Items shorter than a window are one window of all their words, fingerprinted whole.

Defined results: null and empty texts have no words and no hits; an item without words has no
window; an item that occurs twice counts once per id, null ids of items are not counted; documents
are told apart by id and text, so repeated rows and null ids each get a row; an empty table of
either kind gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Scratch, ascii_lower, table

WINDOW, K = 10, 5
#: Only tables whose bytes were summed up to at most so many are broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 16 << 20

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of digits, a-z and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _grams(k: int) -> str:
    """Hashes of the k words from each place on; places too near the end give null."""
    rest = "".join(f", get(_w, i + {j})" for j in range(1, k))
    return f"transform(_w, (x, i) -> IF(i + {k} <= size(_w), xxhash64({k}, x{rest}), NULL))"


def _least(width: int) -> str:
    """The smallest of `width` hashes from each place on that has as many; distinct."""
    rest = "".join(f", get(_h, i + {j})" for j in range(1, width))
    inner = f"least(x{rest})" if width > 1 else "x"
    return f"filter(array_distinct(transform(_h, (x, i) -> IF(i + {width} <= size(_h) AND get(_h, i + {width - 1}) IS NOT NULL, {inner}, NULL))), x -> x IS NOT NULL)"


def fingerprints(df: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """Adds _fp (array of hashes) to a frame with _w: winnowed for whole windows, plain for short items."""
    df = df.withColumn("_h", F.expr(_grams(k))).withColumn("_fp", F.expr(_least(window - k + 1))).drop("_h")
    for n in short:
        df = df.withColumn("_fp", F.expr(f"concat(_fp, array_distinct(filter({_grams(n)}, x -> x IS NOT NULL)))"))
    return df


def _small(df: DataFrame, size: str) -> DataFrame:
    """df to be broadcast if it is small; size: SQL of the bytes of a row. df is a written table."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(f"40 + {size}"))).first()[0] or 0) <= BROADCAST_BYTES else df


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = K,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Texts are hashed in one pass; what is shuffled is one row per fingerprint only where the items
    are too many to broadcast, the matched ids, and the runs around hits. No group is gathered but
    the hits of one document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = scratch.keep(
        benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("_w")).where(F.size("_w") > 0).where("item_id IS NOT NULL"), "items"
    )
    short = sorted(r[0] for r in items.select(F.size("_w").alias("n")).where(F.col("n") < window).distinct().collect())  # below `window` values
    windows = scratch.keep(
        items.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(size(_w) - {window - 1}, 1)), i -> array_join(slice(_w, i, {window}), ' '))")).alias("_run")).distinct(),
        "windows",
    )
    runs = scratch.keep(windows.select("_run").distinct(), "runs")
    marks = scratch.keep(
        fingerprints(items, window, k, short)
        # of an item shorter than a window only the hash of all its words counts
        .select(F.explode_outer(F.expr(f"IF(size(_w) >= {window}, _fp, filter({_whole(short)}, x -> x IS NOT NULL))")).alias("_x"))
        .where("_x IS NOT NULL")
        .distinct(),
        "marks",
    )
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_t"), F.col(text_col).alias("_text"))
    hashed = scratch.keep(
        fingerprints(keyed.withColumn("_w", words(F.col("_text"))), window, k, short).select("doc_id", "_t", F.size("_w").cast("long").alias("n_words"), "_fp"), "hashed"
    )
    # explode_outer: the filter that explode implies would compute the arrays again
    hits = hashed.select("doc_id", "_t", F.explode_outer("_fp").alias("_x")).join(_small(marks, "8"), "_x")
    found = scratch.keep(hits.groupBy("doc_id", "_t").agg(F.collect_set("_x").alias("_xs")), "found")

    f = found.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_ft"), "_xs")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_ft"))
    hit_docs = keyed.join(_small(f, "8 * size(_xs)"), same).withColumn("_w", words(F.col("_text"))).select("doc_id", "_t", "_w", "_xs")
    around = hit_docs.withColumn("_h", F.expr(_grams(k))).select(
        "doc_id",
        "_t",
        "_w",
        F.expr(
            f"""array_distinct(flatten(transform(
            filter(transform(_h, (x, i) -> IF(array_contains(_xs, x), i + 1, NULL)), p -> p IS NOT NULL),
            p -> filter(sequence(greatest(p - {window - k}, 1), p), s -> s + {window - 1} <= size(_w)))))"""
        ).alias("_starts"),
        *(
            F.expr(f"filter(transform({_grams(n)}, (x, i) -> IF(array_contains(_xs, x), i + 1, NULL)), x -> x IS NOT NULL)").alias(f"_s{n}")
            for n in short
        ),
    )
    # two references keep the optimizer from putting the making of _w into the lambda, to be run for each start
    spans = f"transform(_starts, s -> struct(s AS at, {window} AS len, array_join(slice(_w, s, least({window}, size(_w))), ' ') AS run))"
    for n in short:
        spans = f"concat({spans}, transform(_s{n}, s -> struct(s AS at, {n} AS len, array_join(slice(_w, s, {n}), ' ') AS run)))"
    spread = around.select("doc_id", "_t", F.explode_outer(F.expr(spans)).alias("_s")).select("doc_id", "_t", "_s.at", "_s.len", F.col("_s.run").alias("_run"))
    exact = scratch.keep(spread.join(_small(runs, "octet_length(_run)"), "_run").distinct(), "exact")
    covered = exact.select("doc_id", "_t", F.explode(F.expr("sequence(at, at + len - 1)")).alias("_p")).distinct().groupBy("doc_id", "_t").agg(F.count(F.lit(1)).alias("n_hit"))
    named = (
        exact.select("doc_id", "_t", "_run")
        .distinct()
        .join(_small(windows, "8 + octet_length(_run)"), "_run")
        .groupBy("doc_id", "_t")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
        .select("doc_id", "_t", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    )
    both = covered.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_ft"), "n_hit").join(
        named.select(F.col("doc_id").alias("_id2"), F.col("_t").alias("_ft2"), "n_items", "items_sha256"),
        F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_ft") == F.col("_ft2")),
    )
    none = F.lit(0).cast("long")
    return hashed.select("doc_id", "_t", "n_words").join(both, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def _whole(short: list[int]) -> str:
    """The hashes of all words of a short item, by its length."""
    if not short:
        return "CAST(array() AS array<bigint>)"
    return "CASE size(_w) " + " ".join(f"WHEN {n} THEN {_grams(n)}" for n in short) + " ELSE CAST(array() AS array<bigint>) END"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH b AS (SELECT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.run = bw.run AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
