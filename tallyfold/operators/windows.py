"""Dialogue of transcripts in windows, and map-reduce over them with a caller's extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import format_timestamp, strip
from tallyfold.operators import pack_windows

#: Characters of a token, and what an extractor answers where a window holds nothing.
TOKEN_CHARS, NOTHING = 4, "NOTHING"
FAILED = "(extraction failed)"


def dialogue(segments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """id, pos, line of segments (id, pos, start, speaker, text): one stamped line for each run of one speaker.

    names: id, label, name; a label without a name stands for itself, no label for UNKNOWN. A run's
    texts are joined by spaces in order, its stamp is the start of its first segment.
    """
    w = Window.partitionBy("id").orderBy("pos")
    fresh = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | F.lag("pos").over(w).isNull()).cast("long")
    runs = segments.withColumn("_run", F.sum(fresh).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")
    turns = runs.groupBy("id", "_run", "speaker").agg(F.min("pos").alias("pos"), F.min_by("start", "pos").alias("start"), text.alias("text"))
    if names is None:
        who = F.coalesce(F.nullif("speaker", F.lit("")), F.lit("UNKNOWN"))
    else:
        n = names.groupBy(F.col("id").alias("_i"), F.col("label").alias("_l")).agg(F.max("name").alias("_name"))
        turns = turns.join(n, (F.col("id") == F.col("_i")) & (F.col("speaker") == F.col("_l")), "left")
        who = F.coalesce("_name", F.nullif("speaker", F.lit("")), F.lit("UNKNOWN"))
    line = F.concat(F.lit("["), format_timestamp(F.coalesce("start", F.lit(0.0))), F.lit("] "), who, F.lit(": "), "text")
    return turns.select("id", "pos", line.alias("line"))


def windows(lines: DataFrame, budget: int) -> DataFrame:
    """id, window (from 1), total, text of lines (id, pos, line): filled greedily up to `budget` characters, no line is split.

    Only the lengths of an id's lines meet in one row; the texts are joined by their window.
    """
    sizes = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.length("line").alias("n")))).alias("_x"))
    packed = sizes.withColumn("_w", pack_windows(F.transform("_x", lambda x: x["n"]), budget))
    at = packed.select("id", F.explode(F.arrays_zip(F.transform("_x", lambda x: x["pos"]).alias("pos"), "_w")).alias("_z"), (F.array_max("_w") + 1).alias("total")).select("id", "_z.pos", (F.col("_z._w") + 1).alias("window"), "total")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.join(at, ["id", "pos"]).groupBy("id", "window", "total").agg(joined.alias("text"))


class Part(NamedTuple):
    """What an extractor is given."""

    window: int
    total: int
    text: str


def extracts(parts: DataFrame, extract: Callable[[list[Part]], Iterable[str]]) -> DataFrame:
    """id, window, total, output, error of windows: the caller's function over Arrow batches of them.

    If a batch raises, its windows are tried one by one, and only those that raise again carry the
    error: a window that fails doesn't lose the others.
    """
    kind = dict(parts.dtypes)["id"]

    def one(part: Part) -> tuple[str | None, str | None]:
        try:
            return next(iter(extract([part]))), None
        except Exception as e:  # noqa: BLE001  the caller's function may raise anything
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            given = [Part(int(w), int(t), x) for w, t, x in zip(df.window, df.total, df.text, strict=True)]
            try:
                made = [(x, None) for x in extract(given)] if given else []
                if len(made) != len(given):
                    raise ValueError(f"{len(made)} outputs for {len(given)} windows")
            except Exception:  # noqa: BLE001
                made = [one(p) for p in given]
            yield pd.DataFrame({"id": df.id, "window": df.window, "total": df.total, "output": [m[0] for m in made], "error": [m[1] for m in made]})

    return parts.select("id", "window", "total", "text").mapInPandas(run, f"id {kind}, window int, total int, output string, error string")


def _labelled(outputs: DataFrame) -> DataFrame:
    """id, pos, line: the usable outputs of windows as parts; failed ones leave a note of the gap."""
    said = F.when(F.col("error").isNotNull(), F.lit(FAILED)).otherwise(strip(F.col("output")))
    head = F.concat(F.lit("### Part "), F.col("window").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit("\n"))
    rows = outputs.withColumn("_said", said).where((F.col("_said") != "") & (F.col("_said") != NOTHING))
    return rows.select("id", F.col("window").cast("long").alias("pos"), F.concat(head, "_said").alias("line"))


def _joined(lines: DataFrame, between: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), between)
    return lines.groupBy("id").agg(text.alias("text"))


def map_reduce(lines: DataFrame, extract: Callable[[list[Part]], Iterable[str]], budget: int, window: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint(), levels: int = 6) -> DataFrame:
    """id, text, level, status of dialogue (id, pos, line) within a budget of tokens.

    What fits stays as it is (whole, level 0). Else the extractor goes over windows of `window`
    tokens; parts that are together still too long are packed and extracted again, until they fit
    (condensed), all windows hold nothing (empty, no text), or a level makes them no shorter (long).
    """
    tokens = lines.groupBy("id").agg((F.sum(F.length("line") + 1) - 1).alias("_n"))
    fits = F.col("_n") <= budget * TOKEN_CHARS + TOKEN_CHARS - 1
    sized = keep(lines.join(tokens, "id"))
    done = _joined(sized.where(fits), "\n").select("id", "text", F.lit(0).alias("level"), F.lit("whole").alias("status"))
    left = sized.where(~fits).select("id", "pos", "line")
    before = sized.where(~fits).groupBy("id").agg(F.max("_n").alias("_was"))
    for level in range(1, levels + 1):
        if left.isEmpty():
            return done
        parts = keep(_labelled(keep(extracts(windows(left, window * TOKEN_CHARS), extract))))
        after = parts.groupBy("id").agg((F.sum(F.length("line") + 2) - 2).alias("_n"))
        rated = keep(before.join(after, "id", "left"))
        status = F.when(F.col("_n").isNull(), "empty").when(fits, "condensed").when((F.col("_n") >= F.col("_was")) | F.lit(level == levels), "long")
        rated = rated.withColumn("status", status)
        ended = rated.where("status IS NOT NULL").select("id", "status")
        done = done.unionByName(ended.join(_joined(parts, "\n\n"), "id", "left").select("id", "text", F.lit(level).alias("level"), "status"))
        before = rated.where("status IS NULL").select("id", F.col("_n").alias("_was"))
        left = parts.join(before.select("id"), "id", "left_semi")
    return done
