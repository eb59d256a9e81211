"""Operator 8: exact dedup by skew-safe combining.

Copies are deduplicated locally, then merged in salted groups, then the winners of the salts are
combined. Every one of the three steps groups by the content itself next to its digest, so equal
digests alone never merge two texts. Rows find their group again by digest, length and a second
hash; whether two contents share all three is counted first, and if any do, by the content too.

Defined results: null text counts as empty, empty texts are equal to each other; of equal texts the
row with the largest id stays (a null id loses to any other; repeated rows with one id are one
winner and each counts in group_size); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Scratch, map_texts, table

#: Salts over which one group of copies is spread before its winners meet.
SALTS = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    The aggregates combine on the map side (the local step), a hot group then meets in `salts`
    tasks as one row per map task, and last as `salts` rows in one. Content leaves the first stage
    once; the second exchange carries one row per distinct text and salt.
    """
    def make():
        def work(texts: list[str]) -> dict:
            data = [t.encode().lower() for t in texts]  # lower() of bytes changes A-Z only
            return {
                "_text": pa.array(data, pa.binary()),
                "text_sha256": [hashlib.sha256(d).hexdigest() for d in data],
                "_len": [len(d) for d in data],
                "_xx": pa.array([xxhash.xxh3_64_intdigest(d) - (1 << 63) for d in data], pa.int64()),
            }

        return work

    keyed = map_texts(docs, text_col, {"doc_id": f"`{id_col}`"}, "_text binary, text_sha256 string, _len long, _xx long", make)
    content = ["text_sha256", "_len", "_xx", "_text"]
    salted = (
        keyed.withColumn("_salt", F.pmod(F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(F.xxhash64("doc_id")), F.lit(salts)))
        .groupBy("_salt", *content)
        .agg(F.max("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    )
    groups = salted.groupBy(*content).agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    key = ["text_sha256", "_len", "_xx"]
    scratch = Scratch(docs.sparkSession, "exact")
    named = scratch.keep(groups.select(*key, "keep_id", "group_size"), "groups")
    clash = not named.groupBy(*key).count().where("count > 1").isEmpty()
    return (
        keyed.select("doc_id", *key, *(["_text"] if clash else []))
        .join(groups if clash else named, content if clash else key)
        .select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
