"""Column functions over text and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_-]{3,}"
#: Words that say nothing in a question; a parameter of the functions below.
STOPWORDS = ("the", "and", "that", "this", "with", "for", "from", "what", "who", "when", "was", "are", "did", "does", "about")


def format_timestamp(sec: Column) -> Column:
    """Null gives ?:??; M:SS below an hour, else H:MM:SS; truncated."""
    s = F.floor(sec)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(sec.isNull(), "?:??").when(s < 3600, F.format_string("%d:%02d", m, r)).otherwise(F.format_string("%d:%02d:%02d", h, m, r))


def slugify(text: Column) -> Column:
    """Lower case; letters, digits (of any script) and single hyphens only."""
    t = F.regexp_replace(F.lower(strip(text)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?U)[\s_]+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def strip(text: Column) -> Column:
    """The text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def keywords(text: Column) -> Column:
    """Tokens of three characters or more, lower-cased, without stop words; duplicates stay."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word (lower case) as a substring."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, word, F.lit("")))) / F.length(word)).cast("long")


def section(doc: Column, heading: str) -> Column:
    """The body below the first heading of that title, up to the next heading."""
    import re

    return F.regexp_extract(doc, rf"(?smi)^\#{{1,6}}[ \t]+{re.escape(heading)}[ \t]*\n(.*?)(?=^\#{{1,6}}[ \t]|\z)", 1)


def due_date(text: Column) -> Column:
    """The first ISO date in a text; null where there is none or it isn't a date."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), "yyyy-MM-dd")


def document_id(text: Column) -> Column:
    return F.concat(F.lit("doc-"), F.md5(strip(text)))


def short_label(meeting_id: Column, date: Column, hint: Column, source: Column) -> Column:
    """The first 12 characters of an id, the date, and the hint or the source's name."""
    return F.concat_ws(" ", F.substring(meeting_id, 1, 12), F.coalesce(date.cast("string"), F.lit("????-??-??")), F.coalesce(F.nullif(hint, F.lit("")), source))


def minutes_path(date: Column, title: Column, meeting_id: Column) -> Column:
    """date-slug-id8.md, with stand-ins for a date and a slug that are missing."""
    slug = F.coalesce(F.nullif(slugify(title), F.lit("")), F.lit("meeting"))
    return F.concat(F.concat_ws("-", F.coalesce(date.cast("string"), F.lit("0000-00-00")), slug, F.substring(meeting_id, 1, 8)), F.lit(".md"))


def cite(date: Column, title: Column, stamp: Column) -> Column:
    """date - title, and the stamp where there is one."""
    mark = F.nullif(F.trim(F.coalesce(stamp, F.lit(""))), F.lit(""))
    return F.concat_ws(" ", F.concat(F.coalesce(date.cast("string"), F.lit("undated")), F.lit(" - "), title), mark)


def clamp(text: Column, most: int = 1200, mark: str = " [...]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def unfence(text: Column) -> Column:
    """The content of a text that is one fenced block; others as they are."""
    inner = F.regexp_extract(strip(text), r"(?s)\A```[A-Za-z]*[ \t]*\n(.*?)\n?```\z", 1)
    return F.when(strip(text).rlike(r"(?s)\A```[A-Za-z]*[ \t]*\n.*```\z"), inner).otherwise(text)


def kind(text: Column, known: tuple = ("person", "project", "system", "organization", "document", "term", "other")) -> Column:
    """A kind of entity in lower case with underscores; unknown ones are other."""
    k = F.regexp_replace(F.lower(F.trim(text)), " ", "_")
    return F.when(k.isin(*known), k).otherwise("other")


def safe_name(text: Column) -> Column:
    """A file name of letters, digits, dots, underscores and hyphens only."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def diarization_warning(labels: Column, most: int = 8) -> Column:
    """What is odd about the number of speakers; null if nothing is."""
    return F.when(labels == 0, "no speakers").when(labels > most, "too many speakers")


def spoken_date(date: Column, time: Column) -> Column:
    """Weekday, date and 12-hour time; an unreadable time is left out, an unreadable date stays as it is."""
    d = F.try_to_date(date, "yyyy-MM-dd")
    h, m = F.regexp_extract(F.coalesce(time, F.lit("")), r"^(\d{1,2}):(\d{2})$", 1).try_cast("int"), F.regexp_extract(F.coalesce(time, F.lit("")), r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
    clock = F.when((h < 24) & (m < 60), F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":"), F.format_string("%02d", m), F.when(h < 12, " AM").otherwise(" PM")))
    return F.when(d.isNull(), date).otherwise(F.concat_ws(" at ", F.date_format(d, "EEEE, MMM dd, yyyy"), clock))


def excerpt(doc: Column, most: int = 220) -> Column:
    """The beginning of a note as plain text: without front matter, headings, emphasis and repeated white space."""
    t = F.regexp_replace(F.coalesce(doc, F.lit("")), r"(?s)\A---\n.*?\n---\n?", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^#{1,6}[ \t].*$", ""), r"[*_`]", "")
    t = strip(F.regexp_replace(t, r"\s+", " "))
    cut = F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("..."))).otherwise(t)
    return F.when(F.coalesce(doc, F.lit("")) == "", "No minutes yet.").when(t == "", "Nothing to show.").otherwise(cut)
