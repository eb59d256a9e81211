"""Operators 11 to 13 against plain versions: cut units, personal data, the audit of filters."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tallyfold.llm import fill_in_middle, filter_audit, personal_data


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_cut(key, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = sha(f"7:{'' if key is None else key}")
    h = [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_is_the_plain_cut(spark, odd, none):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "é", "日", "😀", "\n", "\r", "<", "<S", "P>", " "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["has <M> mark", "\n", "\n\n", "no end", "end\n", "x\n" * 50_000]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit("y")})
    rows = [*made.select("doc_id", "text").collect(), *odd.select("doc_id", "text").collect()]
    out = fill_in_middle.fill_in_middle(made.select("doc_id", "text", "n", "form", "output")).collect() + fill_in_middle.fill_in_middle(odd).collect()
    want = Counter((r["doc_id"], *plain_cut(r["doc_id"], r["text"] or ""), sha(r["text"] or "")) for r in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored_sha256"]) for r in out) == want
    assert all(r["output_sha256"] == sha(r["output"]) for r in out) and {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(none).count() == 0


def test_fill_in_middle_parameters(spark):
    df = spark.createDataFrame([(i, f"one two {i} three") for i in range(60)], "doc_id long, text string")
    words = fill_in_middle.fill_in_middle(df, unit=r"\S+\s*", marks=("[a]", "[b]", "[c]"), seed=3, rate=50, spm=0).collect()
    assert {r["n"] for r in words} == {4} and {r["form"] for r in words} == {"plain", "psm"}
    assert all(r["restored_sha256"] == sha(f"one two {r['doc_id']} three") for r in words)
    assert {r["form"] for r in fill_in_middle.fill_in_middle(df, rate=0).collect()} == {"plain"}


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_spans_are_those_of_the_plain_patterns(spark, odd, none):
    rng = random.Random(12)
    tokens = ["a@b.c", "x.y@z", "_q@e.f.", "@", "..", "+", "1.2.3.4", "001.0000255.9.8", "300.1.1.1", "0.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "12", " ", "-", "+1 (415) 555-1234", "+49 30 12", "é", "日本", "😀", "\n", "5", "7.", "abc", "%"]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["a" * 4_000, "1" * 4_000, "x@y" + ".z" * 5_000, "+1" + "(" * 4_000, "1.2.3.4 " * 2_000, "1 " * 5_000, "\x01a@b.c\x02" * 3]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"found": F.lit(1), "base": F.lit(2), "_more": F.lit(3)})
    rows = [*made.select("doc_id", "text").collect(), *odd.select("doc_id", "text").collect()]
    got = personal_data.summary(personal_data.find_personal_data(made)).collect() + personal_data.summary(personal_data.find_personal_data(odd)).collect()
    want = Counter()
    for r in rows:
        spans = plain_spans(r["text"] or "")
        want[(r["doc_id"], *(sum(k == i for _, k, _ in spans) for i in range(4)), sha(listed(spans)))] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    assert personal_data.summary(personal_data.find_personal_data(none)).count() == 0


def made_texts(rng, n):
    """Texts with base spans, obscured ones (to be added) and decoys (not to be)."""
    word = lambda: "".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(3, 8)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(ok):
        d = "4" + number(14)
        last = next(c for c in "0123456789" if luhn(d + c))
        return d + (last if ok else str((int(last) + rng.randint(1, 9)) % 10))

    top = lambda: rng.choice(["com", "org", "de", "fr"])
    ip = lambda sep: sep.join(str(rng.randint(11, 250)) for _ in range(4))
    four = lambda c, s: s.join(c[i : i + 4] for i in (0, 4, 8, 12))
    base = [lambda: f"{word()}.{rng.randint(1, 99)}@{word()}.{top()}", lambda: ip("."), lambda: card(True), lambda: f"+1 ({number(3)}) 555-{number(4)}"]
    hidden = [(0, lambda: f"{word()}.{word()} (at) {word()} (dot) {top()}"), (0, lambda: f"{word()}[at]{word()}.{top()}"), (1, lambda: ip("[.]")), (2, lambda: four(card(True), ".")), (3, lambda: f"({rng.randint(201, 989)}) 555-{number(4)}"), (3, lambda: f"{rng.randint(201, 989)}-{rng.randint(201, 989)}-{number(4)}")]
    decoys = [lambda: card(False), lambda: four(card(False), "."), lambda: f"{rng.randint(101, 999)} {number(4)} {number(4)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{word()} (at) {word()}", lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"+{number(6)}"]
    out = []
    for i in range(n):
        text, want = "", []
        for _ in range(rng.randint(4, 12)):
            text += " ".join(word() for _ in range(rng.randint(2, 6))) + " "
            pick = rng.random()
            if pick < 0.45:
                text += rng.choice(base)()
            elif pick < 0.6:
                kind, make = rng.choice(hidden)
                piece = make()
                want.append((len(text), kind, len(text) + len(piece)))
                text += piece
            elif pick < 0.85:
                text += rng.choice(decoys)()
            text += rng.choice([" ", ", ", ".\n"])
        out.append((i, text, want))
    return out


def test_the_trained_classifier_adds_obscured_spans_and_leaves_decoys(spark):
    made = made_texts(random.Random(7), 300)
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")).collect()}
    kinds = Counter()
    for i, text, want in made:
        assert [tuple(x) for x in sorted(got[i]["base"])] == plain_spans(text)
        added = {tuple(x) for x in got[i]["added"]}
        for k in range(4):
            w, a = {s for s in want if s[1] == k}, {s for s in added if s[1] == k}
            kinds[k, "right"] += len(w & a)
            kinds[k, "wanted"] += len(w)
            kinds[k, "added"] += len(a)
    for k in range(4):
        assert kinds[k, "right"] >= 0.9 * kinds[k, "wanted"] and kinds[k, "right"] >= 0.9 * kinds[k, "added"] and kinds[k, "wanted"] > 10, kinds


def test_reliabilities_follow_the_votes(spark):
    # labeler 1 tells right from wrong, labeler 5 says yes to anything
    rows = [(0, True, False, [1, 1, 1, 1, 0, 1], 500), (0, False, True, [1, -1, 1, -1, 0, 1], 300), (0, False, True, [1, 1, 1, 1, 0, 1], 40), (0, False, False, [1, -1, 1, 1, 0, 1], 50)]
    got = personal_data.estimate(spark.createDataFrame(rows, "kind int, base boolean, open boolean, votes array<int>, n long")).first()
    wrong, right = got["share"][:18], got["share"][18:]
    assert right[5] > 0.95 and wrong[5] < 0.05 and abs(right[17] - wrong[17]) < 0.15  # votes of 1 by labelers 1 and 5


def test_scan_and_clear_of(spark):
    values = [random.Random(1).randint(-9, 9) for _ in range(1000)]
    df = spark.createDataFrame([(values,), ([],), ([4],)], "v array<bigint>")
    sums = [r[0] for r in df.select(personal_data.scan(F.col("v"), lambda a, b: a + b)).collect()]
    assert sums == [[sum(values[: i + 1]) for i in range(1000)], [], [4]]
    spans = "array<struct<start:bigint,kind:int,end:bigint>>"
    df = spark.createDataFrame([([(0, 0, 5), (4, 1, 9), (20, 2, 25), (40, 3, 44)], [(24, 0, 30), (35, 0, 40)])], f"f {spans}, t {spans}")
    assert [tuple(x) for x in df.select(personal_data.clear_of(F.col("f"), F.col("t"))).first()[0]] == [(0, 0, 5), (40, 3, 44)]
    assert [tuple(x) for x in df.select(personal_data.clear_of(F.col("f"), F.col("t"), among=False)).first()[0]] == [(0, 0, 5), (4, 1, 9), (40, 3, 44)]


# The audit

def plain_audit(docs, labels):
    """docs: (doc_id, text, source); every document, order and step by itself."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    rows = []
    for key, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": key is not None and any(k is not None and k < key and (x or "") == t for k, x, _ in docs)}
        rows.append((part or "", {f for f in fails if fails[f]}, key in good, key in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine, result, shapley = [r for r in rows if r[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = [r for r in mine if f in r[1]]
                shapley[f] += len(gone)
                result.append((f, "".join(order), step, len(left), len(gone), len(every) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(part, *r[1:], shapley[r[0]]) for r in result}
    return out


def test_audit_is_the_plain_one(spark, odd, none):
    rng = random.Random(13)
    bits = ["word " * 210, " ".join(f"w{i}" for i in range(220)), "SHOUT LOUD", "a # b", "", "same", "x\x0by z", "é" * 300, " ".join(f"{'z' * 40}{i}" for i in range(30_000))]
    docs = [(rng.choice([None, *range(30)]), rng.choice([None, rng.choice(bits), rng.choice(bits) + rng.choice(bits)]), rng.choice([None, "", "s", "t"])) for _ in range(60)]
    docs += [(5, "twice", "s"), (5, "twice", "t"), (5, "twice", "s"), (6, "twice", "s")]
    labels = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"mask": F.lit("x"), "n": F.lit("y"), "good": F.lit("z"), "_sha": F.lit(0)})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.mask_rows(df, known)).collect()
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(got) == len(plain_audit(docs, labels)) and {tuple(r[c] for c in names) for r in got} == plain_audit(docs, labels)
    assert filter_audit.audit(filter_audit.mask_rows(none.withColumn("source", F.lit("s")), known)).count() == 0
    assert {r["part"] for r in filter_audit.audit(filter_audit.mask_rows(odd, known, part_col="lang")).collect()} == {"", "en", "fr"}


def test_parity_sums_invert_to_cells(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 7), rng.randint(1, 5)) for _ in range(100)]
    cells = filter_audit.invert(filter_audit.parity_sums(spark.createDataFrame(rows, "mask int, n long"), [], 3), 3).first()["cells"]
    assert cells == [sum(n for m, n in rows if m == k) for k in range(8)]


def test_warc_sizes_follow_from_the_table_and_files_roll(spark):
    import random

    from tallyfold.llm import warc
    from tallyfold.llm.common import Scratch

    assert warc.sizes_for(0) == (1 << 20, 64 << 10) and warc.sizes_for(1 << 30) == (16 << 20, 1 << 20)
    for total in (10**7, 10**9, 10**12, 10**14):
        shard, roll = warc.sizes_for(total)
        assert total / shard <= warc.SHARDS and roll < shard / 4
    rng = random.Random(4)
    pages = spark.createDataFrame([(i, "u", "".join(chr(rng.randint(97, 122)) for _ in range(9000))) for i in range(400)], "page_id long, url string, html string")
    files = [r["file"].split("-") for r in warc.write_warc(pages, Scratch(spark, "t").path).collect()]
    assert len({f[1] for f in files}) >= 3 and max(int(f[3].split(".")[0]) for f in files) >= 3
