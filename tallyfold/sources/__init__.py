"""Sources: the driver's tables, and adapter views that stand in for the archive's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "1995-06-17"


def keeper(spark: SparkSession):
    """Cuts the lineage by checkpoint() in the session's folder; only a session in one process gets a temporary one."""
    import re
    import tempfile

    given = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not given and not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(given or f"file://{tempfile.mkdtemp(prefix='tallyfold-')}")
    return lambda df: df.checkpoint()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON transcripts with the defaults of missing fields."""
    word = "struct<start double, end double, text string, speaker string>".replace(" double", ": double").replace(" string", ": string")
    schema = f"meeting_id string, model string, language string, duration_sec double, segments array<struct<start: double, end: double, text: string, speaker: string, words: array<{word}>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumns({"model": F.coalesce("model", F.lit("unknown")), "language": F.coalesce("language", F.lit("en"))})


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Whole markdown files below a folder: path, text."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """A recursive listing with content digests; only files with one of the suffixes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(path)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")).orderBy("path")


def listing(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """path, size, mtime of the files with one of the suffixes below a folder: no content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(path)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def unseen(listed: DataFrame, seen: DataFrame) -> DataFrame:
    """Listed files without an entry of the same path, size and mtime."""
    return listed.join(seen.select("path", "size", "mtime").distinct(), ["path", "size", "mtime"], "left_anti")


def digests(spark: SparkSession, paths: DataFrame, out: str, batch: int = 10_000) -> DataFrame:
    """path, size, mtime, sha256, md5 of the files in paths (path), whose contents alone are read; written to the folder `out`.

    Names come to the driver in batches of a bounded number, contents never do.
    """
    from itertools import batched

    schema = "path string, size long, mtime timestamp, sha256 string, md5 string"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(out)
    for some in batched((r["path"] for r in paths.select("path").toLocalIterator()), batch):
        df = spark.read.format("binaryFile").load(list(some))
        df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def meetings(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "discovered").when(F.col("o_orderstatus") == "O", "indexed").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.to_date("o_orderdate").alias("meeting_date"), status.alias("status"), F.col("o_totalprice").alias("duration_sec"), F.col("o_orderpriority").alias("title"))


MEETINGS = "meetings AS (SELECT o_orderkey AS id, o_custkey AS owner_id, CAST(o_orderdate AS DATE) AS meeting_date, CASE o_orderstatus WHEN 'P' THEN 'discovered' WHEN 'O' THEN 'indexed' ELSE 'failed' END AS status, o_totalprice AS duration_sec, o_orderpriority AS title FROM orders)"


def speakers(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    return line.select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("label"), F.nullif("l_returnflag", F.lit("N")).alias("name"))


SPEAKERS = "speakers AS (SELECT l_orderkey AS meeting_id, l_linenumber AS label, NULLIF(l_returnflag, 'N') AS name FROM lineitem)"


def commitments(spark: SparkSession, d: str) -> DataFrame:
    """owner, due (null for a seventh of the rows), state of each line item."""
    line, supplier = read(spark, d, "lineitem"), read(spark, d, "supplier")
    due = F.when(F.col("l_partkey") % 7 != 0, F.to_date("l_shipdate"))
    rows = line.select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("seq"), "l_suppkey", due.alias("due"), F.when(F.col("l_linestatus") == "O", "open").otherwise("done").alias("state"))
    return rows.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("owner")), "l_suppkey", "left").drop("l_suppkey")


COMMITMENTS = "commitments AS (SELECT l_orderkey AS meeting_id, l_linenumber AS seq, CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_shipdate AS DATE) END AS due, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'done' END AS state, s_name AS owner FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("speaker"), "text")


TURNS = "turns AS (SELECT conv_id AS session_id, turn, role AS speaker, text FROM conversations)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Voice samples: of every five vectors one is pending, the others are enrolled."""
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id"), F.col("label").alias("person"), (F.col("vec_id") % 7).alias("meeting_id"), (F.lit(10) + F.col("vec_id") % 60).cast("double").alias("speech_sec"), "embedding", (F.col("vec_id") % 5 == 0).alias("pending"))
