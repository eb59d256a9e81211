"""Registers of notes: action items, decisions and open questions, by line, and all of them in one pass over the notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyfold import functions as X

#: The sections of the registers.
SECTIONS = ("Action Items", "Decisions", "Open Questions")


def _made(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are evaluated once each, in their order.

    An expression that a later filter or several columns use is copied into each of them by the optimizer,
    and a regular expression costs more than all the rest of a line; what an explode made is never copied.
    """
    for name, value in columns.items():
        rows = rows.withColumn(name, F.explode(F.array(value)))
    return rows


def section_lines(notes: DataFrame, key: str, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """key, section, line of notes (key, doc): the lines of the named sections, of each the first of its title. No shuffle."""
    parts = F.split(F.coalesce("doc", F.lit("")), r"(?m)^(?=#{1,6}[ \t])")
    title = lambda p: F.lower(F.trim(F.regexp_extract(p, r"\A#{1,6}[ \t]+([^\n]*)", 1)))
    titled = _made(notes.select(key, "doc"), _parts=F.transform(parts, lambda p: F.struct(title(p).alias("title"), p.alias("part"))))
    named = lambda s: F.get(F.filter("_parts", lambda x: x["title"] == s.lower()), F.lit(0))["part"]
    found = F.filter(F.array(*(F.struct(F.lit(s).alias("section"), named(s).alias("part")) for s in sections)), lambda x: x["part"].isNotNull())
    # the first line of a part is its title
    lines = F.filter(F.slice(F.split("_s.part", "\n"), 2, 1 << 30), lambda x: F.trim(x) != "")
    return titled.select(key, F.explode(found).alias("_s")).select(key, "_s.section", F.explode(lines).alias("line"))


def _parts(lines: DataFrame, pattern: str, n: int) -> DataFrame:
    """lines with the groups of a pattern in `line` as p, matched once; lines that don't match go."""
    form = F.split(F.regexp_replace("line", pattern, "\u0001".join(f"${k}" for k in range(1, n + 1))), "\u0001")
    return lines.withColumn("p", F.explode(F.filter(F.array(form), lambda x: F.size(x) == n)))


#: What stands at the end of a line: its references. Tried only where one, white space or the end comes next.
_TAIL = r"(?=[\s\[]|$)((?:\s*\[[^\]]*\])*)\s*$"


def action_rows(lines: DataFrame, key: str) -> DataFrame:
    """A row per checkbox line of the Action Items section: owner, text, due (as written), due_iso, cite, state. Lines without a task are none."""
    rows = _parts(lines, r"^\s*[-*]\s*\[([ xX])\]\s*\*\*(.+?)\*\*\s*[-:\u2013\u2014]\s*(.*?)(?:[ \t\x0B\f]*\b(?i:Due):[ \t\x0B\f]*(.*?))?" + _TAIL, 5)
    due = F.nullif(F.trim(F.rtrim(F.col("p")[3], F.lit(". \t\n\x0b\f\r"))), F.lit(""))
    out = rows.select(key, F.col("p")[1].alias("owner"), F.trim(F.col("p")[2]).alias("text"), due.alias("due"), X.due_date(due).alias("due_iso"), F.trim(F.col("p")[4]).alias("cite"), F.when(F.lower(F.col("p")[0]) == "x", "done").otherwise("open").alias("state"))
    return out.where("text <> ''")


def decision_rows(lines: DataFrame, key: str) -> DataFrame:
    """A row per bullet of the Decisions section with a bold text: text, decided_by, rationale, cite.

    The decider stands after "by" and before a full stop or comma, in front of the rationale; it is
    null unless it starts with a capital letter. A rationale ends with its line.
    """
    rows = _parts(lines, r"^\s*[-*]\s*\*\*(.+?)\*\*\s*(.*?)(?:\b(?i:Rationale):(.*?))?" + _TAIL, 4)
    said = F.filter(F.slice(F.split(F.col("p")[1], r"\bby\s+"), 2, 1000), lambda x: x.rlike(r"^\p{Lu}"))
    decider = F.when(F.contains(F.col("p")[1], F.lit("by")), F.split(F.get(said, F.lit(0)), "[.,]")[0])
    none = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(key, F.trim(F.col("p")[0]).alias("text"), none(decider).alias("decided_by"), none(F.col("p")[2]).alias("rationale"), F.trim(F.col("p")[3]).alias("cite"))


def question_owner(text):
    """Who needs to resolve this, it or that: the capitalised words right before the phrase, in its sentence; null without any."""
    before = F.split(text, r"\s+needs?\s+to\s+resolve\s+(?:this|it|that)\b", 2)
    sentence = F.element_at(F.split(F.col("_b")[0], r"[.?!;:]\s+"), -1)
    # no pattern is tried on what doesn't have its word
    before = F.when(F.contains(text, F.lit("resolve")), before)
    return before, F.nullif(F.trim(F.regexp_extract(sentence, r"((?:\p{Lu}[\p{L}\p{N}'.\u2019-]*\s*|\p{N}+\s*)+)$", 1)), F.lit(""))


def question_rows(lines: DataFrame, key: str) -> DataFrame:
    """A row per bullet of the Open Questions section: text, owner (who needs to resolve it, else null), cite."""
    rows = _parts(lines, r"^\s*[-*]\s+(.+?)" + _TAIL, 2)
    before, owner = question_owner(F.col("p")[0])
    rows = _made(rows, _b=before)
    return rows.select(key, F.trim(F.col("p")[0]).alias("text"), F.when(F.size("_b") > 1, owner).alias("owner"), F.trim(F.col("p")[1]).alias("cite"))


def parse_action_items(notes: DataFrame, key: str) -> DataFrame:
    return action_rows(section_lines(notes, key, SECTIONS[:1]), key)


def parse_decisions(notes: DataFrame, key: str) -> DataFrame:
    return decision_rows(section_lines(notes, key, SECTIONS[1:2]), key)


def parse_questions(notes: DataFrame, key: str) -> DataFrame:
    return question_rows(section_lines(notes, key, SECTIONS[2:]), key)


def backfill(notes: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The registers of all notes (key, doc), and how many notes and rows of each there were.

    The notes are read once, for the lines of all three sections; the counts are observed while the
    tables are written, so no job counts again. keep cuts the lineage: checkpoint() by default.
    """
    seen = {name: Observation() for name in ("meetings", "commitments", "decisions", "open_questions")}
    count = F.count(F.lit(1)).alias("n")
    lines = keep(section_lines(notes.observe(seen["meetings"], count), key))
    parsers = {"commitments": (SECTIONS[0], action_rows), "decisions": (SECTIONS[1], decision_rows), "open_questions": (SECTIONS[2], question_rows)}
    tables = {name: keep(parse(lines.where(F.col("section") == section).select(key, "line"), key).observe(seen[name], count)) for name, (section, parse) in parsers.items()}
    return tables, {name: o.get["n"] for name, o in seen.items()}
