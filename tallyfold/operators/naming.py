"""Names, titles and file names: compound and prefix folding, title resolution, file-name parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The months, in order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Words that are no part of a subject hint; a parameter of parse_file_name.
NOISE = ("at", "on", "rec", "recording", "audio", "meeting")

_SEPARATOR = r"\s*(?:,|&|/|\band\b)\s*"


def canonical_compound(df: DataFrame, key: str, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """key and the names of a compound ("A, B and C"), each by its alias, joined by " and ".

    aliases: alias (lower case, trimmed), canonical. Unknown names stay; a compound without names
    and a null give null. Only the parts are shuffled, and rejoined in their order.
    """
    parts = df.select(key, F.posexplode_outer(F.filter(F.split(F.trim(column), _SEPARATOR), lambda x: x != "")).alias("_pos", "_part"))
    named = parts.join(aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical")), F.lower("_part") == F.col("_alias"), "left")
    listed = F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_canonical", "_part").alias("name"))).alias("l"))
    joined = F.array_join(F.filter(F.transform(listed, lambda x: x["name"]), lambda x: x.isNotNull()), " and ")
    return named.groupBy(key).agg(F.nullif(joined, F.lit("")).alias(out))


def fold_prefix(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, folded: the known name (name, meetings) whose words begin with, or are the beginning of, name's.

    Of several the one with most meetings, then the smaller, is taken; where two that extend the
    name don't extend each other, the name stays as it is. Two equi-joins on word prefixes; the
    families are only aggregated, never listed.
    """
    key = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    prefixes = lambda k: F.transform(F.sequence(F.lit(1), F.size(F.split(k, " "))), lambda n: F.array_join(F.slice(F.split(k, " "), 1, n), " "))
    given = names.select("name").distinct().withColumn("k", key("name"))
    have = known.select(F.col("name").alias("full"), "meetings", key("name").alias("kk"))
    longer = given.join(have.select("full", "meetings", "kk", F.explode(prefixes(F.col("kk"))).alias("k")), "k").withColumn("ext", F.lit(True))
    shorter = given.withColumn("kk", F.explode(prefixes(F.col("k")))).join(have, "kk").where("kk <> k").withColumn("ext", F.lit(False))
    found = longer.select("name", "full", "meetings", "kk", "ext").unionByName(shorter.select("name", "full", "meetings", "kk", "ext"))
    top = found.where("ext").groupBy("name").agg(F.max_by("kk", F.struct(F.length("kk"), "kk")).alias("top"))
    chain = F.bool_and(~F.col("ext") | F.startswith(F.concat("top", F.lit(" ")), F.concat("kk", F.lit(" "))))
    best = found.join(top, "name", "left").groupBy("name").agg(chain.alias("one"), F.min(F.struct((-F.col("meetings")).alias("m"), "full")).alias("b"))
    return given.select("name").join(best, "name", "left").select("name", F.when(F.col("one"), F.col("b.full")).otherwise(F.col("name")).alias("folded"))


def _some(found: Column) -> Column:
    return F.nullif(F.trim(found), F.lit(""))


def resolve_title(doc: Column, path: Column, hint: Column) -> Column:
    """Title line or first heading in the first 25 lines, else the path's slug, else the hint."""
    head = F.substring_index(doc, "\n", 25)
    slug = F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1), r"^\d{4}-\d{2}-\d{2}-|-[0-9a-f]{12}$|-[0-9a-f]{8}$", "")
    plausible = F.when(hint.rlike("[A-Za-z]{3}"), F.trim(hint))
    return F.coalesce(_some(F.regexp_extract(head, r"(?m)^title:[ \t]*(.+)$", 1)), _some(F.regexp_extract(head, r"(?m)^#[ \t]+(.+)$", 1)), _some(F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))), plausible, F.lit("Untitled Meeting"))


def _class(token: Column) -> Column:
    """One character for a token of a file name: what a date or a time can be made of."""
    low = F.lower(token)
    month = F.exists(F.array(*map(F.lit, MONTHS)), lambda m: F.startswith(m, low))
    number = F.when(F.length(token) <= 2, "d").when(F.length(token) == 4, F.when(F.startswith(token, F.lit("20")), "Y").otherwise("q")).when((F.length(token) == 8) & F.startswith(token, F.lit("20")), "D").otherwise("n")
    word = F.when(low == "at", "a").when(low == "t", "t").when(low.isin("am", "pm"), "X").when(low.isin("a", "p"), "x").when(low == "m", "z").when((F.length(token) >= 3) & month, "M").otherwise("w")
    return F.when(token.rlike("^[0-9]"), number).when(token.rlike("^[A-Za-z]"), word).when(token.isin(" ", "_"), "s").when(token.isin("-", "\u2013"), "h").when(token == ".", "p").when(token == ":", "c").otherwise("o")


#: Over classes: a written date, a date with a month's name, a time with a.m. or p.m., four digits behind the date, hours and minutes.
_WRITTEN, _NAMED, _CLOCK, _COMPACT, _PLAIN = "D|Y[hps]d[hps]d|Y[hps]q", "M[sh]+d(?!c)|d[sh]+M", "(?:a[sh]+)?d(?:[hc]d)?[sh]*(?:X|xp?z)p?", "(?<=-)[tsh][Yq]", "dcd"


def parse_file_name(df: DataFrame, name: str, year: Column, mtime: Column | None = None, noise: Sequence[str] = NOISE) -> DataFrame:
    """df with file_date, file_time (HH:MM) and file_hint of a file name; year is that of the file's time.

    The name without its suffix is cut into runs of letters, runs of digits and single signs; each
    gets a class, and dates and times are looked for in the string of classes. A month's name needs
    a day; one digit behind an hour is the end of a range of hours. What is left without noise words
    is the hint. A missing date or time is that of mtime, if it is given, else null.
    """
    base = F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]{2,4}$", "")
    df = df.withColumn("_tok", F.regexp_extract_all(base, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]"), F.lit(0)))
    df = df.withColumn("_cls", F.array_join(F.transform("_tok", _class), ""))
    span = lambda at, n: F.slice("_tok", F.greatest(at, F.lit(1)), n)
    where = lambda text, pattern: (F.regexp_instr(F.col(text), F.lit(pattern)), F.length(F.regexp_extract(text, pattern, 0)))

    at, n = where("_cls", _WRITTEN)
    digits = F.array_join(F.filter(span(at, n), lambda t: t.rlike("^[0-9]")), "")
    written = F.when((at > 0) & (F.length(digits) == 8), F.try_to_date(digits, "yyyyMMdd"))
    at2, n2 = where("_cls", _NAMED)
    part = lambda test: F.get(F.filter(span(at2, n2), lambda t: t.rlike(test)), F.lit(0))
    month = F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: F.startswith(m, F.lower(part("^[A-Za-z]")))), True)
    spelled = F.when(at2 > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), part("^[0-9]").cast("int")), "yyyy-MM-dd"))
    df = df.withColumn("_d", F.coalesce(written, spelled)).withColumn("_p", F.when(written.isNotNull(), F.struct(at.alias("at"), n.alias("n"))).when(spelled.isNotNull(), F.struct(at2.alias("at"), n2.alias("n"))))
    masked = lambda text: F.when(F.col("_p").isNull(), F.col(text)).otherwise(F.concat(F.substr(F.col(text), F.lit(1), F.col("_p.at") - 1), F.repeat(F.lit("-"), F.col("_p.n")), F.substr(F.col(text), F.col("_p.at") + F.col("_p.n"))))
    df = df.withColumn("_cls", masked("_cls"))

    at3, n3 = where("_cls", _CLOCK)
    numbers = F.filter(span(at3, n3), lambda t: t.rlike("^[0-9]"))
    hour, tail = F.get(numbers, F.lit(0)).cast("int"), F.get(numbers, F.lit(1))
    half = F.lower(F.substring(F.get(F.filter(span(at3, n3), lambda t: F.lower(t).isin("a", "p", "am", "pm")), F.lit(0)), 1, 1))
    minute = F.when(F.length(tail) == 2, tail.cast("int")).otherwise(0)
    clock = F.when((at3 > 0) & hour.between(1, 12) & (minute < 60), F.format_string("%02d:%02d", hour % 12 + F.when(half == "p", 12).otherwise(0), minute))
    at4, n4 = where("_cls", _COMPACT)
    four = F.get("_tok", at4)
    compact = F.when((at4 > 0) & four.rlike("^(?:[01][0-9]|2[0-3])[0-5][0-9]$"), F.concat(F.substring(four, 1, 2), F.lit(":"), F.substring(four, 3, 2)))
    at5, n5 = where("_cls", _PLAIN)
    plain = F.when((at5 > 0) & (F.get("_tok", at5 - 1).cast("int") < 24) & F.get("_tok", at5 + 1).rlike("^[0-5][0-9]$"), F.concat(F.lpad(F.get("_tok", at5 - 1), 2, "0"), F.lit(":"), F.get("_tok", at5 + 1)))
    spot = lambda a, b: F.struct(a.alias("at"), b.alias("n"))
    df = df.withColumn("_t", F.coalesce(clock, compact, plain)).withColumn("_p", F.when(clock.isNotNull(), spot(at3, n3)).when(compact.isNotNull(), spot(at4, n4)).when(plain.isNotNull(), spot(at5, n5)))
    df = df.withColumn("_cls", masked("_cls"))

    kept = F.zip_with("_tok", F.split("_cls", ""), lambda t, c: F.when((c == "-") | c.isin("s", "h") | F.lower(t).isin(*noise), " ").otherwise(t))
    hint = F.regexp_replace(F.regexp_replace(F.array_join(kept, ""), " +", " "), "^[ .,]+|[ .,]+$", "")
    out = df.withColumns({"file_date": F.col("_d"), "file_time": F.col("_t"), "file_hint": _some(hint)})
    if mtime is not None:
        out = out.withColumns({"file_date": F.coalesce("file_date", F.to_date(mtime)), "file_time": F.coalesce("file_time", F.date_format(mtime, "HH:mm"))})
    return out.drop("_tok", "_cls", "_d", "_t", "_p")


def set_category(doc: Column, category: Column) -> Column:
    """The note with its category line set: replaced, inserted in the front matter, or with a new one."""
    line = F.concat(F.lit("category: "), category)
    front = F.regexp_extract(doc, r"(?sm)\A---\n.*?^---(?:\n|\z)", 0)
    has = front.rlike(r"(?m)^category:")
    at = F.instr(front, "\ncategory:")
    replaced = F.concat(F.substr(front, F.lit(1), at), line, F.regexp_extract(F.substr(front, at + 1), r"(?s)^[^\n]*(\n.*)$", 1), F.substr(doc, F.length(front) + 1))
    return F.when(has, replaced).when(front != "", F.concat(F.lit("---\n"), line, F.substr(doc, F.lit(4)))).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n"), doc))


def backup_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """path, action of every source file (path, size, mtime): copy if it is missing, differs in size or is newer. Nothing is deleted."""
    t = target.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    stale = F.col("_size").isNull() | (F.col("size") != F.col("_size")) | (F.col("mtime") > F.col("_mtime"))
    return source.join(t, "path", "left").select("path", F.when(stale, "copy").otherwise("keep").alias("action"))
