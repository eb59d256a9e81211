"""Operator 11: the fill-in-middle transformation by an Arrow-batched pandas UDF.

In each batch the regex library's finditer gives the end of every unit (a line by default), kept as
a compact array of offsets; two look-ups in it cut a text into prefix, middle and suffix, and
hashlib makes the seeds and the digests. One pass: no shuffle, no state between rows.

The seeds are the first four 8-digit groups of the sha256 of "<seed>:<id>", so a document is cut
alike in any partition and on any retry. A form says how the parts were put together; rebuild()
gives the exact text from output and form, since a text that holds a mark itself stays plain.

Defined results: null text counts as empty, empty texts are plain; a null id is seeded as an empty
one; repeated rows are cut alike; texts of any length are cut whole; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import clean, table, task_memory

#: A unit: a line with its end, or the last line without one.
UNIT = r"[^\n]*\n|[^\n]+"
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are transformed, and of those so many as spm.
RATE, SPM = 100, 50
SEED = 7
#: No more text than this is held as a frame of results at a time.
PIECE = 1 << 20


def seeds(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits."""
    hexed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The end of each unit, in code points."""
    return array("q", (m.end() for m in unit.finditer(text)))


def rebuild(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text of which an output was made."""
    p, s, m = marks
    if form == "psm":
        at, to = output.index(s), output.index(m)
        return output[len(p) : at] + output[to + len(m) :] + output[at + len(s) : to]
    if form == "spm":
        at, to = output.index(p), output.index(m)
        return output[at + len(p) : to] + output[to + len(m) :] + output[len(s) : at]
    return output


class Cutter:
    """What a worker needs for a text: the compiled unit and the parameters."""

    def __init__(self, unit: str, marks: tuple[str, str, str], seed: int, rate: int, spm: int):
        self.unit, self.marks, self.seed, self.rate, self.spm = regex.compile(unit), marks, seed, rate, spm

    def cut(self, key: object, text: str) -> tuple[int, str, int | None, int | None, str]:
        """n, form, prefix_chars, middle_chars, output."""
        ends = unit_ends(text, self.unit)
        n = len(ends)
        h1, h2, h3, h4 = seeds(self.seed, key)
        if not text or any(mark in text for mark in self.marks) or h3 % 100 >= self.rate:
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (low, high))
        p, s, m = self.marks
        if h4 % 100 < self.spm:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, marks: tuple[str, str, str] = MARKS, seed: int = SEED, rate: int = RATE, spm: int = SPM, texts: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and the output itself.

    What a unit pattern leaves uncovered at the end belongs to the suffix. texts=False keeps the
    outputs in the workers: only their digests come back.
    """
    if len({*marks}) < 3 or any(not m or m[0] in m[1:] for m in marks) or len({m[0] for m in marks}) > 1:
        raise ValueError("marks are three different strings with one first character, which isn't in them again")
    fields = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * texts
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(fields)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        with task_memory():
            cutter = Cutter(unit, marks, seed, rate, spm)

            def row(key: object, text: str) -> tuple:
                n, form, prefix, middle, output = cutter.cut(key, text)
                said = (n, form, prefix, middle, _sha(output), _sha(rebuild(output, form, marks)))
                return (*said, output) if texts else said

            for keys, column in batches:
                made = [row(key, clean(text)) for key, text in zip(keys, column, strict=True)]
                frame = pd.DataFrame(made, columns=names)
                for c in ("prefix_chars", "middle_chars"):
                    frame[c] = frame[c].astype("Int64")
                yield frame

    cut = docs.select(F.col(f"`{id_col}`").alias("doc_id"), run(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).alias("r"))
    return cut.select("doc_id", "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"), texts=False)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT doc_id, t, string_split(t, chr(10)) AS parts, ends_with(t, chr(10)) AS closed,
    ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
    ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d),
u AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN closed THEN len(parts) - 1 ELSE len(parts) END AS n FROM s),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
e AS (SELECT *, CASE WHEN lo = 0 THEN '' WHEN lo = n THEN t ELSE array_to_string(parts[1:lo], chr(10)) || chr(10) END AS p,
    CASE WHEN hi = 0 THEN '' WHEN hi = n THEN t ELSE array_to_string(parts[1:hi], chr(10)) || chr(10) END AS pm FROM k),
c AS (SELECT *, substr(t, length(p) + 1, length(pm) - length(p)) AS m, substr(t, length(pm) + 1) AS x FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
        ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM c
"""
