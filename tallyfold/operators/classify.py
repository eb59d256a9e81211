"""Classification of notes by a caller's rule table, and names in dialogue. There are no word lists in here: all are given."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """What a term in a field counts for: a bucket fires once its rules of one priority reach 1.

    how: "is" (the whole value), "word" (between word boundaries) or "part" (anywhere).
    """

    field: str
    how: str
    term: str
    bucket: str
    priority: int = 0
    weight: float = 1.0


def rules(field: str, how: str, terms: Sequence[str], bucket: str, priority: int = 0, weight: float = 1.0) -> list[Rule]:
    """A rule for each term."""
    return [Rule(field, how, t, bucket, priority, weight) for t in terms]


def _matches(value: Column, rule: Rule) -> Column:
    term = rule.term.lower()
    if rule.how == "is":
        return value == term
    if rule.how == "part":
        return F.contains(value, F.lit(term))
    if rule.how == "word":
        return value.rlike(rf"(?U)\b\Q{term}\E\b")
    raise ValueError(f"no such way to match: {rule.how}")


def decide(fields: Mapping[str, Column], table: Sequence[Rule]) -> Column:
    """bucket and priority of the first bucket that fires, by priority, then by the table's order; null if none does.

    Fields are compared in lower case without regard to space around them; a missing one matches
    nothing. The table is part of the plan, so it is a caller's short list, not data.
    """
    values = {k: F.lower(F.trim(F.coalesce(v, F.lit("")))) for k, v in fields.items()}
    groups: dict[tuple[int, str], list[Rule]] = {}
    for rule in table:
        groups.setdefault((rule.priority, rule.bucket), []).append(rule)
    ordered = sorted(groups, key=lambda g: g[0])  # stable: the table's order within a priority
    out = F.lit(None).cast("struct<bucket:string,priority:int>")
    for group in reversed(ordered):
        score = sum((F.when(_matches(values[r.field], r), F.lit(float(r.weight))).otherwise(0.0) for r in groups[group]), F.lit(0.0))
        hit = F.struct(F.lit(group[1]).alias("bucket"), F.lit(group[0]).alias("priority"))
        out = F.when(score >= 1 - 1e-9, hit).otherwise(out)
    return out


def front_value(doc: Column, key: str) -> Column:
    """The last value of a key in the front matter, lower case, without quotes; null where there is none."""
    front = F.regexp_extract(F.coalesce(doc, F.lit("")), r"\A---\s*\n([\s\S]*?)\n---", 1)
    lines = F.filter(F.split(front, "\n"), lambda x: F.startswith(F.lower(x), F.lit(f"{key}:")))
    value = F.substr(F.get(lines, F.size(lines) - 1), F.lit(len(key) + 2))
    return F.nullif(F.lower(F.trim(F.translate(value, "\"'", ""))), F.lit(""))


def note_fields(doc: Column, title: Column, name: Column, head: int = 2000) -> dict[str, Column]:
    """What rules can look at: category, type and entities of the front matter, title, name, and all of it with the note's beginning."""
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(name, F.lit("")), F.substring(F.coalesce(doc, F.lit("")), 1, head))
    return {"category": front_value(doc, "category"), "type": front_value(doc, "type"), "entities": front_value(doc, "entities"), "title": title, "name": F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(title, F.lit(""))), "all": whole}


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"^\P{L}+|\P{L}+$", "")


def addressed(text: Column, no_names: Sequence[str], greetings: Sequence[str]) -> Column:
    """Names that a line addresses, in order: the word behind a greeting, and a single word behind the last comma.

    A name is a capitalised word of letters that isn't one of no_names; greetings are phrases in lower case.
    """
    named = lambda w: w.rlike(r"^\p{Lu}\p{Ll}+$") & ~F.lower(w).isin(*no_names)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,]+"), lambda w: _bare(w) != "")
    # each word with the two before it
    shifted = lambda k: F.concat(F.array_repeat(F.lit(""), k), words)
    beside = F.zip_with(words, F.zip_with(shifted(1), shifted(2), lambda a, b: F.struct(F.lower(_bare(a)).alias("one"), F.lower(F.concat_ws(" ", _bare(b), _bare(a))).alias("two"))), lambda w, p: F.struct(_bare(w).alias("w"), p.alias("p")))
    greeted = F.transform(F.filter(beside, lambda x: x["w"].isNotNull() & (x["p"]["one"].isin(*greetings) | x["p"]["two"].isin(*greetings))), lambda x: x["w"])
    clauses = F.split(F.coalesce(text, F.lit("")), ",")
    last = F.regexp_replace(F.trim(F.element_at(clauses, -1)), "[.?!]$", "")
    called = F.when(F.size(clauses) > 1, F.array(last)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(greeted, called), named))


def file_candidates(hint: Column, owner: Column, labels: Column, no_names: Sequence[str]) -> Column:
    """Likely names of a call with two speakers or fewer: its owner, then capitalised words of the hint."""
    words = F.transform(F.split(F.coalesce(hint, F.lit("")), r"[\s_-]+"), _bare)
    found = F.filter(words, lambda x: x.rlike(r"^\p{Lu}\p{Ll}+$") & ~F.lower(x).isin(*no_names))
    own = F.filter(F.array(F.trim(F.coalesce(owner, F.lit("")))), lambda x: x != "")
    return F.when(labels <= 2, F.array_distinct(F.concat(own, found))).otherwise(F.array().cast("array<string>"))


def unresolved_label(name: Column) -> Column:
    """A bare or wrapped speaker label in capitals; other names stay as they are."""
    found = F.regexp_extract(F.trim(name), r"(?i)^(?:unknown\s+speaker\s*\(\s*)?(SPEAKER_\d+)\s*\)?$", 1)
    return F.when(found != "", F.upper(found)).otherwise(name)
