"""Folders of text files that follow a table: changed files are replaced, superseded ones go, and a lost task or driver leaves nothing half done.

A publication has three steps. Changed files are written below `_staged` under names of their own
digest; then a manifest of all files is written, which is the commit; then staged files are moved in
place and superseded ones removed. Each step can be done again with the same result, so `settle`
finishes a publication whose driver was lost after the commit, and one lost before it has changed nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.operators import keys, windows

MANIFEST = "key string, name string, sha256 string, size long"
#: Outcomes of a file.
WRITTEN, SAME, KEPT, GONE = "written", "same", "kept", "superseded"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _versions(base: str) -> list[int]:
    """The committed manifests: those that Spark has marked as whole."""
    from pyarrow import fs

    system, root = _filesystem(base)
    found = system.get_file_info(fs.FileSelector(f"{root}/_manifests", allow_not_found=True))
    whole = [f for f in found if f.base_name.isdigit() and system.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File]
    return sorted(int(f.base_name) for f in whole)


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """key, name, sha256, size of the files of the last publication; none before the first."""
    versions = _versions(base)
    if not versions:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(f"{MANIFEST}, outcome string").parquet(f"{base}/_manifests/{versions[-1]}").where(F.col("outcome") != GONE).drop("outcome")


def _staging(base: str):
    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(base)
        attempt = TaskContext.get().taskAttemptId()
        for df in frames:
            sizes = []
            for sha, content, outcome, size in zip(df.sha256, df.content, df.outcome, df["size"], strict=True):
                if outcome != WRITTEN:
                    sizes.append(int(size))
                    continue
                data = content.encode("utf-8", "surrogatepass")
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"a file's text isn't that of its digest {sha}")
                temporary = f"{root}/_staged/_{attempt}-{sha}"
                with system.open_output_stream(temporary, compression=None) as out:
                    out.write(data)
                system.move(temporary, f"{root}/_staged/{sha}")  # equal texts have one staged file, whoever writes it
                sizes.append(len(data))
            yield df.drop(columns="content").assign(size=sizes)

    return stage


def _placing(base: str):
    def digest(system, path: str) -> str | None:
        from pyarrow import fs

        if system.get_file_info(path).type != fs.FileType.File:
            return None
        sha = hashlib.sha256()
        with system.open_input_stream(path, compression=None) as given:
            while data := given.read(1 << 20):
                sha.update(data)
        return sha.hexdigest()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(base)
        attempt = TaskContext.get().taskAttemptId()
        for df in frames:
            for name, sha, outcome in zip(df["name"], df.sha256, df.outcome, strict=True):
                path = f"{root}/{name}"
                if outcome == GONE:
                    if digest(system, path) == sha:  # what somebody else has put there since isn't ours to remove
                        system.delete_file(path)
                elif digest(system, path) != sha:
                    temporary = f"{root}/_staged/_{attempt}-{sha}"
                    system.copy_file(f"{root}/_staged/{sha}", temporary)
                    system.move(temporary, path)
            yield pd.DataFrame({"n": [len(df)]})

    return place


def settle(spark: SparkSession, base: str) -> None:
    """Does what the last manifest says, all of it or what is left of it, and then clears the staged files."""
    versions = _versions(base)
    if not versions:
        return
    system, root = _filesystem(base)
    if system.get_file_info(f"{root}/_manifests/{versions[-1]}/_settled").type.name == "File":
        return
    todo = spark.read.schema(f"{MANIFEST}, outcome string").parquet(f"{base}/_manifests/{versions[-1]}").where(F.col("outcome").isin(WRITTEN, GONE))
    # a name that one key gives up and another takes is removed first, so removals are a job before
    for gone in (True, False):
        some = todo.where((F.col("outcome") == GONE) == F.lit(gone)).select("name", "sha256", "outcome")
        some.mapInPandas(_placing(base), "n long").agg(F.sum("n")).collect()
    system.delete_dir_contents(f"{root}/_staged", missing_dir_ok=True)
    system.open_output_stream(f"{root}/_manifests/{versions[-1]}/_settled", compression=None).close()


def publish(files: DataFrame, base: str, whole: bool = False) -> DataFrame:
    """key, name, sha256, size, outcome of the files of `base` after files (key, name, content) have been published there.

    A key's file is written if its digest or name is new (written), else left (same); its former name
    goes (superseded). Keys that aren't given keep theirs (kept), with `whole` they go too. A null
    content is an empty file. Two rows with one key, one name for two keys, a missing key and a name
    with a path in it, or one that starts with an underscore, raise before anything is committed.
    One publication at a time: the manifest's number is taken by the driver.
    """
    spark = files.sparkSession
    settle(spark, base)
    version = (_versions(base) or [0])[-1] + 1
    system, root = _filesystem(base)
    system.create_dir(f"{root}/_staged", recursive=True)
    old = manifest(spark, base).select(F.col("key").alias("_key"), F.col("name").alias("_name"), F.col("sha256").alias("_sha"), F.col("size").alias("_size"))
    content = F.coalesce("content", F.lit(""))
    given = files.select(F.col("key").cast("string").alias("key"), "name", content.alias("content"), F.sha2(content, 256).alias("sha256"))
    good = F.coalesce(F.col("key").isNotNull() & ~F.col("name").rlike(r"[/\\]|^[_.]|^$"), F.lit(False))
    given = given.where(keys.required(good, F.concat(F.lit("no file name: "), F.coalesce("name", F.lit("null")))))
    given = given.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    given = given.where(keys.required(F.col("_n") == 1, F.concat(F.lit("key of two files: "), F.coalesce("key", F.lit("null")))))
    both = given.join(old, F.col("key") == F.col("_key"), "full")
    outcome = F.when(F.col("key").isNull(), F.lit(GONE if whole else KEPT)).when(F.col("name").eqNullSafe(F.col("_name")) & F.col("sha256").eqNullSafe(F.col("_sha")), SAME).otherwise(WRITTEN)
    new = F.col("outcome") == WRITTEN
    former = F.when(new & (F.col("_name") != F.col("name")), F.struct("_name", "_sha", "_size"))
    pick = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b)).alias(a)
    rows = both.withColumn("outcome", outcome).select(F.coalesce("key", "_key").alias("key"), pick("name", "_name"), pick("sha256", "_sha"), F.when(new, F.lit(0).cast("long")).otherwise(F.col("_size")).alias("size"), F.when(new, F.col("content")).alias("content"), "outcome", former.alias("former"))
    rows = rows.select("key", "name", "sha256", "size", "content", "outcome", F.col("former._name").alias("old_name"), F.col("former._sha").alias("old_sha"), F.col("former._size").cast("string").alias("old_size"))
    made = rows.mapInPandas(_staging(base), f"{MANIFEST}, outcome string, old_name string, old_sha string, old_size string")
    now = F.struct("key", "name", "sha256", "size", "outcome")
    gone = F.when(F.col("old_name").isNotNull(), F.struct("key", F.col("old_name").alias("name"), F.col("old_sha").alias("sha256"), F.col("old_size").cast("long").alias("size"), F.lit(GONE).alias("outcome")))
    listed = made.select(F.inline(F.array_compact(F.array(now, gone))))
    taken = F.count(F.when(F.col("outcome") != GONE, 1)).over(Window.partitionBy("name"))
    listed = listed.withColumn("_n", taken).where(keys.required(F.col("_n") <= 1, F.concat(F.lit("name of two files: "), "name"))).drop("_n")
    listed.write.mode("overwrite").parquet(f"{base}/_manifests/{version}")
    settle(spark, base)
    return spark.read.schema(f"{MANIFEST}, outcome string").parquet(f"{base}/_manifests/{version}")


def transcript_files(segments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """key, name, content: of each transcript (id, pos, start, end, speaker, text) a JSON file of its segments and a dialogue to read."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "speaker", "text")))
    body = F.to_json(F.struct(F.col("id").alias("meeting_id"), F.transform("_s", lambda s: s.dropFields("pos")).alias("segments")))
    id_ = F.col("id").cast("string")
    machine = segments.groupBy("id").agg(cells.alias("_s")).select(F.concat(id_, F.lit("/json")).alias("key"), F.concat(id_, F.lit(".json")).alias("name"), body.alias("content"))
    lines = windows.dialogue(segments, names)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n\n")
    human = lines.groupBy("id").agg(told.alias("_t")).select(F.concat(id_, F.lit("/md")).alias("key"), F.concat(id_, F.lit(".md")).alias("name"), F.concat("_t", F.lit("\n")).alias("content"))
    return machine.unionByName(human)


def export(notes: DataFrame, eligible: Column, base: str) -> tuple[DataFrame, dict[str, int]]:
    """The published files of the notes (key, name, content) that are eligible, and how many were (synced) and weren't (quarantined).

    A note that was eligible before and isn't any more is removed. Unchanged files aren't written again.
    """
    yes = F.coalesce(eligible, F.lit(False))
    n = notes.agg(F.count(F.when(yes, 1)).alias("synced"), F.count(F.when(~yes, 1)).alias("quarantined")).first()
    return publish(notes.where(yes).select("key", "name", "content"), base, whole=True), n.asDict()
