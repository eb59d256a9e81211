"""Operator 12: personal data by weak supervision, in DataFrame functions only.

Base spans are what four fixed patterns find (and their checks leave). Beside them looser patterns
give candidates: obfuscated addresses, addresses of hosts with bracketed dots, card numbers with
other separators, national telephone numbers. Six labelers vote yes, no or nothing on each
candidate (regex: form, check, variety; gazetteer; context: cue words, borders).
Expectation-maximisation over the counts of equal votes estimates how reliable each labeler is: base
spans are known to be right and matches that failed their check to be wrong, of the looser ones,
right as often as wrong before any vote, the rounds find which are and how labelers vote on wrong
ones. (With that share estimated too the rounds drift: equal votes of all kinds of wrong candidates
can't be told from votes of right ones.) The posteriors then train a naive Bayes classifier of spans
on votes, borders and lengths, and candidates that it is sure of are added. Base spans always stay.

Places come from the lengths of the pieces between matches, so no text is shuffled and nothing but
counts leaves a document: the texts are read once, what is found is written, and both training and
result read that. The patterns are given in forms that the JVM's engine runs in linear time.

Defined results: null text counts as empty and has no spans; a null id stays null; repeated rows
are treated alike (and count twice in training); texts of any length are read whole; an empty table
gives no rows, and without any candidate nothing is added; other columns are ignored. Counts by
kind and base_sha256 are those of base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Scratch

#: The kinds, in the order of spans with one start.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base patterns. Possessive, and from the start of a run on: what a run's start doesn't match, no later place of it does.
BASE = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_AT, _DOT = r"(?: ?(?:\(at\)|\[at\]|\{at\}) ?| at )", r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot )"
_FULL = r"(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))"
#: The looser ones.
LOOSE = (
    rf"(?i)(?<!{_LOCAL}){_LOCAL}++(?:{_AT}|@){_LABEL}++(?:(?:\.|{_DOT}){_LABEL}++)++",
    rf"(?i)(?<![0-9])[0-9]{{1,3}}{_FULL}[0-9]{{1,3}}{_FULL}[0-9]{{1,3}}{_FULL}[0-9]{{1,3}}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Za-z:])",
    "(?<![0-9])[0-9]{4}([._/\u00a0\u2009\u202f\u2013])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4}){1,2}(?![0-9A-Za-z])",
)
#: What a text must hold for a pattern to be tried: base, then loose.
GATES = (("@", r"[0-9]\.[0-9]+\.[0-9]", r"[0-9](?:[ -]?[0-9]){8}", r"\+[0-9]"), (r"(?i)[\[({](?:at|dot)[\])}]| dot ", r"(?i)[\[(](?:\.|dot)[\])]|[0-9a-f]:[0-9a-f]{1,4}:", "[0-9]{4}[._/\u00a0\u2009\u202f\u2013][0-9]{4}", r"[0-9]\)?[ .-][0-9]{3,4}[ .-][0-9]{2}"))

# Gazetteers and cue words: plain values, by kind.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "de", "fr", "es", "it", "nl", "be", "at", "ch", "uk", "eu", "us", "ca", "au", "nz", "jp", "cn", "in", "br", "mx", "ar", "pl", "cz", "se", "no", "dk", "fi", "pt", "gr", "ie", "ru", "za", "kr")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "218", "234", "254", "351", "352", "353", "354", "358", "359", "370", "371", "372", "380", "381", "385", "386", "420", "421", "852", "886", "966", "971", "972")
CUES = (
    ("mail", "e-mail", "email", "contact", "write", "reach"),
    ("ip", "host", "server", "address", "dns", "ping", "client"),
    ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial"),
)
AGAINST = (
    ("regex", "pattern", "handle"),
    ("version", "release", "section", "chapter", "build", "v"),
    ("order", "invoice", "isbn", "tracking", "serial", "ticket", "id"),
    ("order", "invoice", "isbn", "serial", "part", "id", "lines", "pages"),
)
LABELERS = ("form", "check", "variety", "gazetteer", "cue", "border")
#: Context kept on either side of a match, within the text between it and its neighbours.
BEFORE, AFTER = 48, 16
#: A candidate is added from this probability on.
SURE = 0.9
ROUNDS, CHUNK = 100, 256
#: Feature codes of a kind: three for each labeler, five characters before, five behind, ten lengths.
WIDTH = 3 * len(LABELERS) + 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running op over an array of longs, itself included: in chunks, so that long arrays aren't copied for each element."""
    start = F.array().cast("array<bigint>")
    run = lambda a: F.aggregate(a, start, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.element_at(acc, -1), x)))))

    def chunks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(CHUNK)), lambda k: run(F.slice(v, k + 1, F.lit(CHUNK))))

    def joined(parts: Column) -> Column:
        heads = F.concat(F.array(F.lit(None).cast("bigint")), run(F.transform(parts, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(parts, F.slice(heads, 1, F.size(parts)), lambda p, h: F.when(h.isNull(), p).otherwise(F.transform(p, lambda x: op(h, x)))))

    return let(values, lambda v: F.when(F.size(v) == 0, start).otherwise(F.when(F.size(v) <= CHUNK, run(v)).otherwise(let(chunks(v), joined))))


_PLACE = "array<struct<at:bigint,value:string,before:string,after:string>>"


def places(text: Column, pattern: str, gate: str) -> Column:
    """Matches of a pattern, left to right, with their places in code points and what stands beside them."""

    def placed(found: Column, gaps: Column) -> Column:
        n = F.size(found)
        ahead = F.slice(gaps, 1, n)
        steps = F.zip_with(ahead, F.concat(F.array(F.lit("")), F.slice(found, 1, n - 1)), lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
        at = F.zip_with(scan(steps, lambda a, b: a + b), found, lambda s, m: F.struct(s.alias("at"), m.alias("value")))
        beside = F.zip_with(ahead, F.slice(gaps, 2, n), lambda b, a: F.struct(F.right(b, F.lit(BEFORE)).alias("before"), F.left(a, F.lit(AFTER)).alias("after")))
        return F.zip_with(at, beside, lambda x, y: F.struct(x["at"].alias("at"), x["value"].alias("value"), y["before"].alias("before"), y["after"].alias("after")))

    none = F.array().cast(_PLACE)
    there = F.contains(text, F.lit(gate)) if gate == "@" else text.rlike(gate)
    some = lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))).otherwise(none)
    return F.when(there, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


_PARTS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))$"


def holds(kind: int, value: Column) -> Column:
    """The check of a base match."""
    if kind == IP:
        return value.rlike(_PARTS)
    if kind == CARD:
        return let(digits(value), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == PHONE:
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def plain(kind: int, value: Column) -> Column:
    """A candidate without what obscures it; labelers see no more of it."""
    if kind == EMAIL:
        return F.regexp_replace(F.regexp_replace(F.lower(value), _AT, "@"), _DOT, ".")
    if kind == IP:
        return F.regexp_replace(F.lower(value), r"\[\.\]|\(\.\)|\[dot\]|\(dot\)", ".")
    return value


def _sign(yes: Column, no: Column | None = None) -> Column:
    """1 for yes, else -1; with no: -1 for no, else 0."""
    return F.when(yes, 1).otherwise(-1 if no is None else F.when(no, -1).otherwise(0))


def votes(kind: int, value: Column, before: Column, after: Column) -> list[Column]:
    """1, 0 or -1 of each labeler on a plain candidate."""
    d = digits(value)
    varied = F.size(F.array_distinct(F.split(d, ""))) >= 4
    borders = (before.rlike(r"[A-Za-z0-9_=/#]$"), after.rlike(r"^[A-Za-z0-9_=]"))
    if kind == EMAIL:
        local, top = F.substring_index(value, "@", 1), F.substring_index(value, ".", -1)
        form = _sign(~local.rlike(r"^\.|\.\.|\.$"))
        check = _sign(top.rlike("^[a-z]{2,24}$"))
        variety, gazetteer = _sign(F.length(local).between(1, 64) & ~local.rlike("^[.%+_-]*$")), _sign(top.isin(*TOP_LEVEL))
        borders = (before.rlike(r"[A-Za-z0-9@=/]$"), after.rlike(r"^[A-Za-z0-9@=/]"))
    elif kind == IP:
        six = F.contains(value, F.lit(":"))
        form = _sign(six | value.rlike(r"^(?:0|[1-9][0-9]*+)(?:\.(?:0|[1-9][0-9]*+)){3}$"))
        check, variety = _sign(six | value.rlike(_PARTS)), _sign(six | value.rlike(r"[0-9]{2}"))
        gazetteer = _sign(~value.rlike(r"^(?:0|255|127)\.|^0+:0+:"))
        borders = (before.rlike(r"[A-Za-z0-9_.]$"), after.rlike(r"^(?:[A-Za-z0-9_]|\.[0-9])"))
    elif kind == CARD:
        form, check, variety = _sign(F.length(d).between(13, 19)), _sign(F.call_function("luhn_check", d)), _sign(varied)
        gazetteer = _sign(d.rlike(r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6(?:011|4|5))"))
    else:
        balanced = F.length(F.regexp_replace(value, r"[^(]", "")) == F.length(F.regexp_replace(value, r"[^)]", ""))
        abroad = value.rlike(r"^(?:\+|00)")
        form, check, variety = _sign(F.length(d).between(9, 15) & balanced), _sign(~F.regexp_replace(value, r"^00", "+").rlike(r"^\+0")), _sign(varied)
        country = F.regexp_replace(d, "^00", "")
        known = country.substr(1, 1).isin(*CALLING) | country.substr(1, 2).isin(*CALLING) | country.substr(1, 3).isin(*CALLING)
        home = value.rlike(r"^\([0-9]{2,4}\)|^0[1-9]|^[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}$")
        gazetteer = F.when(abroad, _sign(known)).otherwise(_sign(home))
    said = lambda words: F.lower(before).rlike(r"\b(?:" + "|".join(words) + r")\b[^\n]{0,24}$")
    cue = F.when(said(AGAINST[kind]), -1).when(said(CUES[kind]), 1).otherwise(0)
    return [form, check, variety, gazetteer, cue, _sign(~(borders[0] | borders[1]))]


def _class(c: Column) -> Column:
    """Nothing, white space, a letter, a digit, or another character."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


_FOUND = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,open:boolean,votes:array<int>,codes:array<int>>>"


def candidates(text: Column, kind: int, loose: bool) -> Column:
    """What a pattern of a kind finds, with votes and feature codes. base: a base span; open: neither that nor a match that failed its check."""

    def described(x: Column) -> Column:
        def voted(v: Column, said: Column) -> Column:
            first = 3 * len(LABELERS)
            codes = [3 * i + said[i] + 1 for i in range(len(LABELERS))]
            codes += [first + _class(F.right(x["before"], F.lit(1))), first + 5 + _class(F.left(x["after"], F.lit(1)))]
            codes.append(first + 10 + F.least(F.lit(9), F.length(digits(v)) / 2 if kind in (CARD, PHONE) else F.length(v) / 4))
            base = F.lit(False) if loose else holds(kind, x["value"])
            return F.struct(F.lit(kind).alias("kind"), x["at"].alias("start"), (x["at"] + F.length(x["value"])).alias("end"), base.alias("base"), F.lit(loose).alias("open"), said.alias("votes"), F.transform(F.array(*(c.cast("int") for c in codes)), lambda c: c + kind * WIDTH).alias("codes"))

        return let(plain(kind, x["value"]), lambda v: let(F.array(*(c.cast("int") for c in votes(kind, v, x["before"], x["after"]))), lambda said: voted(v, said)))

    found = places(text, (LOOSE if loose else BASE)[kind], GATES[loose][kind])
    if kind == CARD and not loose:  # shorter runs of digits are no candidates
        found = F.filter(found, lambda x: F.length(digits(x["value"])).between(12, 19))
    return F.transform(found, described).cast(_FOUND)


def clear_of(found: Column, taken: Column, among: bool = True) -> Column:
    """Those of found (start, end, ...) that overlap no span of taken and, with among, of each run of overlapping ones only the first."""
    least, most = F.lit(-1).cast("bigint"), F.lit(1 << 62).cast("bigint")
    row = lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end"))
    up, down = (lambda a, b: F.greatest(a, b)), (lambda a, b: F.least(a, b))

    def kept(given: Column, rows: Column) -> Column:
        n = F.size(rows)
        counts = lambda x: F.lit(True) if among else x["i"] < 0
        ends = scan(F.transform(rows, lambda x: F.when(counts(x), x["end"]).otherwise(least)), up)
        before = F.concat(F.array(least), F.slice(ends, 1, n - 1))
        starts = F.reverse(scan(F.reverse(F.transform(rows, lambda x: F.when(x["i"] < 0, x["start"]).otherwise(most))), down))
        behind = F.concat(F.slice(starts, 2, n), F.array(most))
        beside = F.zip_with(before, behind, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        at = F.zip_with(rows, beside, lambda x, y: F.when((x["i"] >= 0) & (x["start"] >= y["b"]) & (x["end"] <= y["a"]), x["i"]).otherwise(-1))
        return F.transform(F.filter(at, lambda i: i >= 0), lambda i: F.get(given, i))

    every = lambda given: F.array_sort(F.concat(F.transform(taken, lambda x: row(x, F.lit(-1))), F.transform(given, row)))
    return let(found, lambda given: F.when(F.size(given) == 0, given).otherwise(let(every(given), lambda rows: kept(given, rows))))


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and what the eight patterns find in each text, loose candidates only beside base spans: one pass, no shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    strict, loose = (F.concat(*(candidates(text, kind, x) for kind in range(len(KINDS)))) for x in (False, True))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), strict.alias("_strict"), loose.alias("_loose"))
    return rows.select("doc_id", F.concat("_strict", clear_of(F.col("_loose"), F.filter("_strict", lambda x: x["base"]), among=False)).alias("found"))


#: Votes -1, 0, 1 on wrong and on right candidates before any is seen, and how many candidates this stands for.
PRIOR, WEIGHT = ((0.45, 0.35, 0.2), (0.05, 0.35, 0.6)), 4.0


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-40.0)), F.lit(40.0))))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind and share of counts (kind, base, open, votes, n): reliabilities by expectation-maximisation.

    share holds for wrong, then for right candidates, how often each labeler votes -1, 0 and 1. A kind has at most 3 * 3^6 patterns,
    so they stand in one row, and the rounds are a fold within it. Votes on right candidates are
    those on base spans: others would let common votes outweigh a failed check.
    """
    size = 3 * len(LABELERS)
    counts = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "base", "open", F.col("n").cast("double").alias("n")))).alias("c"))
    prior = lambda y: F.array(*(F.lit(x) for _ in LABELERS for x in PRIOR[y]))
    # a vote of labeler i is place 3 * i + vote + 1 of a share
    cast = lambda rows, j: F.filter(rows, lambda x: F.get(x["votes"], (j / 3).cast("int")) == j % 3 - 1)
    places_ = F.sequence(F.lit(0), F.lit(size - 1))

    def share(rows: Column, y: int) -> Column:
        """Shares of votes by the rows' weights n, smoothed: where votes don't tell right from wrong, what was believed before decides."""
        whole = _sum(F.transform(rows, lambda x: x["n"]))
        before = lambda w: WEIGHT + w / 10
        return let(whole, lambda w: F.transform(places_, lambda j: (_sum(F.transform(cast(rows, j), lambda x: x["n"])) + before(w) * F.get(prior(y), j)) / (w + before(w))))

    def odds(votes_: Column, wrong: Column, right: Column) -> Column:
        return _sum(F.transform(votes_, lambda v, i: F.log(F.get(right, 3 * i + v + 1)) - F.log(F.get(wrong, 3 * i + v + 1))))

    rows = counts.select("kind", F.filter("c", lambda x: x["open"]).alias("_open"), F.transform(F.filter("c", lambda x: ~x["base"] & ~x["open"]), lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"))).alias("_wrong"), share(F.filter("c", lambda x: x["base"]), 1).alias("_right"))

    def turn(wrong: Column) -> Column:
        doubt = lambda x: x["n"] * (1 - _probability(odds(x["votes"], wrong, F.col("_right"))))
        against = F.transform("_open", lambda x: F.struct(x["votes"].alias("votes"), doubt(x).alias("n")))
        return share(F.concat("_wrong", against), 0)

    folded = rows.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), prior(0), lambda wrong, _: turn(wrong)))
    return folded.select("kind", F.transform(F.concat("_s", "_right"), lambda x: F.round(x, 9)).alias("share"))


def train(patterns: DataFrame, reliable: DataFrame) -> list[float]:
    """The weight of each feature code in the log odds of a span, from the posteriors of all candidates (kind, base, open, votes, codes, n); smoothed."""
    size = 3 * len(LABELERS)
    each = F.transform("votes", lambda v, i: F.log(F.get("share", size + 3 * i + v + 1)) - F.log(F.get("share", 3 * i + v + 1)))
    p = F.when(F.col("base"), 1.0).when(~F.col("open"), 0.0).otherwise(_probability(_sum(each)))
    rows = patterns.join(F.broadcast(reliable), "kind").withColumn("_p", p)  # four rows
    by_code = rows.select(F.explode("codes").alias("code"), (F.col("n") * F.col("_p")).alias("y"), (F.col("n") * (1 - F.col("_p"))).alias("w")).groupBy("code").agg(F.sum("y").alias("y"), F.sum("w").alias("w"))
    right, wrong = [1.0] * (len(KINDS) * WIDTH), [1.0] * (len(KINDS) * WIDTH)
    for row in by_code.collect():  # one row for each code
        right[row["code"]] += row["y"]
        wrong[row["code"]] += row["w"]
    weights = [0.0] * len(right)
    groups = [range(3 * i, 3 * i + 3) for i in range(len(LABELERS))] + [range(size, size + 5), range(size + 5, size + 10), range(size + 10, size + 20)]
    for k in range(len(KINDS)):
        for g in groups:
            at = [k * WIDTH + c for c in g]
            a, b = sum(right[c] for c in at), sum(wrong[c] for c in at)
            for c in at:
                weights[c] = round(math.log(right[c] / a) - math.log(wrong[c] / b), 9)
    return weights


def _listed(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """doc_id, base and added: arrays of spans (start, kind, end) of every text, the added ones by the trained classifier."""
    scratch = Scratch(docs.sparkSession, "personal")
    found = scratch.keep(found_spans(docs, id_col, text_col), "found")
    each = found.where(F.size("found") > 0).select(F.explode("found").alias("x"))
    # counts of equal candidates: codes hold votes, at most 3^6 * 5 * 5 * 10 of a kind whatever the input
    patterns = scratch.keep(each.groupBy("x.kind", "x.base", "x.open", "x.votes", "x.codes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    reliable = scratch.keep(estimate(patterns.groupBy("kind", "base", "open", "votes").agg(F.sum("n").alias("n"))).coalesce(1), "reliable")
    table = F.array(*map(F.lit, train(patterns, reliable)))
    score = lambda x: F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + F.get(table, c))
    span = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.transform(F.filter("found", lambda x: x["base"]), span)
    more = F.transform(F.filter("found", lambda x: x["open"] & (score(x) >= math.log(sure / (1 - sure)))), span)
    return found.select("doc_id", base.alias("base"), more.alias("_more")).select("doc_id", "base", clear_of(F.col("_more"), F.col("base")).alias("added"))


def summary(found: DataFrame) -> DataFrame:
    """The counts and digests of spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
