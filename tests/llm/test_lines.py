import random

import numpy as np
import pyarrow as pa
from tallyfold.llm import line_dedup


def similar(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and line_dedup.edit_distance(a, b, most) <= most


def test_near_lines_against_brute_force(spark):
    """Lines of 5 to 40 words with words replaced, put in or left out: edit similarity 0.8 or more, next to lines of less."""
    rng = random.Random(11)
    word = lambda: rng.choice(("the", "of", "to", "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 9)))))
    lines = []
    for k in range(120):
        base = [word() for _ in range(rng.choice((5, 8, 12, 20, 40)))]
        lines.append(base)
        for _ in range(k % 3):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(copy) // 6))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            lines.append(copy)
    rng.shuffle(lines)
    texts = [" ".join(x) for x in lines if len(x) >= 5]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    changed = 0
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                changed += texts[i] != texts[j]
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in range(len(texts)) if find(i) != i}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.dedup_lines(df).where("n_removed_lines > 0").collect()}
    assert changed > 80 and got <= want and len(got) >= 0.97 * len(want), (changed, len(got), len(want))


def test_bigrams_rule_out_no_similar_line():
    rng = random.Random(2)
    for _ in range(2000):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 30)))
        b = "".join(x for x in a if rng.random() < 0.8) + "".join(rng.choice("ab ") for _ in range(rng.randint(0, 4)))
        most = rng.randint(0, 8)
        assert line_dedup.may_be_similar(a, b, most) or line_dedup.edit_distance(a, b, 99) > most


def noisy(rng, text, share):
    return "".join(("" if rng.random() < 0.3 else rng.choice("xyzéß漢") * rng.randint(1, 2)) if rng.random() < share else c for c in text)


def test_many_pairs_at_once_as_one_by_one():
    """Around the borders of blocks of 64 rows, empty texts, lengths too far apart."""
    rng = random.Random(5)
    for n in (1, 63, 64, 65, 129, 400):
        texts = ["", "a"]
        for _ in range(60):
            text = "".join(rng.choice("abcde漢 ") for _ in range(rng.randint(max(1, n - 3), n + 3)))
            texts += [text, noisy(rng, text, rng.random() * 0.35)]
        a = np.array([*range(2, len(texts), 2), 0, 0, 1, 5])
        b = np.array([*range(3, len(texts), 2), 0, 1, 0, 2])
        want = [similar(texts[i], texts[j]) for i, j in zip(a, b, strict=True)]
        assert line_dedup.similar_pairs(texts, a, b, 0.8).tolist() == want
        assert n == 1 or 5 < sum(want) < 58


def test_noisy_copies_meet_in_blocks(spark, monkeypatch):
    """A key of many copies just below and above the similarity: in small blocks the groups are those of brute force."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 9))) for _ in range(12)]
    texts = sorted({" ".join(w if rng.random() > 0.17 else noisy(rng, w, 0.9) + "q" for w in words) for _ in range(90)})
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(i):
                if root[i] != root[j] and similar(texts[i], texts[j]):
                    root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = None
    for block in (256, 7):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = {r["doc_id"] for r in line_dedup.dedup_lines(df, exact=block == 7).where("n_removed_lines > 0").collect()}
        want = {i for i in range(len(texts)) if root[i] != i}
        assert got <= want and len(got) >= 0.97 * len(want) > 20, (block, len(got), len(want))


def test_pairs_of_a_key_are_no_rows(spark, monkeypatch):
    """What is shuffled for a key are its members; only links come back."""
    blocks = []
    run = line_dedup._in_blocks
    monkeypatch.setattr(line_dedup, "_in_blocks", lambda *a: blocks.append(a) or run(*a))
    joined = []
    keep = line_dedup.Scratch.keep
    monkeypatch.setattr(line_dedup.Scratch, "keep", lambda self, df, name: joined.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(self, df, name))
    df = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon {x}zeta{x}") for i, x in enumerate("abcdefgh")], "doc_id long, text string")
    assert line_dedup.dedup_lines(df).where("n_removed_lines > 0").count() == 7 and blocks
    assert not any("Join" in part and "bucket" in part.split("\n")[0] for name, plan in joined for part in plan.split("Join ")[1:] if name != "links2")


def test_keys_are_dealt_as_arrays(spark, monkeypatch):
    """The members of keys that several classes have, whatever the batches and parts; a key is no row of its own."""
    rng = random.Random(9)
    for parts in (1, 3, 70_000):
        for _ in range(60):
            rows = [(rng.randint(-9, 9) if k else -(2**63), rng.randint(1, 9), [rng.randint(-4, 4) * 2**50 for _ in range(rng.randint(0, 5))]) for k in range(rng.randint(1, 30))]
            batch = pa.RecordBatch.from_pylist([{"lh": i, "p": p, "bands": b} for i, p, b in rows], pa.schema({"lh": pa.int64(), "p": pa.int32(), "bands": pa.list_(pa.int64())}))
            dealt = pa.Table.from_batches(line_dedup._dealt(parts)([batch.slice(0, 7), batch.slice(7)])).sort_by("part")
            got = [tuple(r.values()) for b in line_dedup._shared(dealt.to_batches(rng.randint(1, 5))) for r in b.to_pylist()]
            by = {}
            for i, _, bands in rows:
                for b in bands:
                    by.setdefault(b, set()).add(i)
            assert sorted((b, i, low) for b, i, _, low in got) == sorted((b, i, min(ids)) for b, ids in by.items() if len(ids) > 1 for i in ids)
    plans = {}
    keep = line_dedup.Scratch.keep
    monkeypatch.setattr(line_dedup.Scratch, "keep", lambda self, df, name: plans.__setitem__(name, df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df, name))
    df = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon {x}zeta{x}\nsome quite other line {x * 9}") for i, x in enumerate("abcdefgh")], "doc_id long, text string")
    assert line_dedup.dedup_lines(df).where("n_removed_lines > 0").count() == 7
    assert "Generate" not in plans["members"] and "Window" not in plans["members"]
    # first places are looked for in classes with copies or links only
    assert "classes" not in plans and "Join" in plans["places"]


def test_few_and_long_pairs_are_compared_at_once(monkeypatch):
    """Few pairs, lengths far apart, bands of many blocks; words replaced in place need no table of edits."""
    rng = random.Random(6)
    texts, widths = [], []
    for n in (90, 700, 1500, 2500):
        for share in (0.02, 0.1, 0.16, 0.2, 0.24, 0.3, 0.9):
            text = "".join(rng.choice("abcde漢 ") for _ in range(n))
            texts += [text, noisy(rng, text, share)]
    a, b = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    want = [similar(texts[i], texts[j]) for i, j in zip(a, b, strict=True)]
    alone = []
    monkeypatch.setattr(line_dedup, "is_similar", lambda x, y, s: alone.append(x) or similar(x, y))
    run = line_dedup._within
    monkeypatch.setattr(line_dedup, "_within", lambda short, *rest: widths.append(len(short)) or run(short, *rest))
    assert line_dedup.similar_pairs(texts, a, b, 0.8).tolist() == want and 8 < sum(want) < 24
    assert len(alone) <= 14 <= sum(widths)
    widths.clear()
    words = [f"{'w' * 30} word{k} other words of this line" for k in range(40)]
    assert line_dedup.similar_pairs(words, np.arange(39), np.arange(1, 40), 0.8).all() and not widths


def test_a_pair_of_several_keys_is_compared_once(monkeypatch):
    """In the first key that both have, and not with a key's smallest id, which was compared before; the links are the same."""
    rng = random.Random(8)
    ids, buckets = range(10, 40), {b: sorted(rng.sample(range(10, 40), 12)) for b in (-7, -1, 7000, 8000, 2**40)}
    words = [f"word{k}" for k in range(9)]
    norm = {i: " ".join(w if rng.random() > 0.15 else f"else{i}" for w in words) + f" own{i}" for i in ids}
    whose = {text: i for i, text in norm.items()}
    rows = []
    for b, some in buckets.items():
        for i in some:
            before = sorted(o for o in buckets if o < b and i in buckets[o])
            rows.append({"bucket": b, "lo": 0, "hi": 0, "x": 0, "id": i, "p": len(norm[i]), "c": i, "led": i != some[0], "before": before, "norm": norm[i]} | {s: 0 for s in line_dedup._SKETCHES})
    schema = pa.schema([(c, pa.int64()) for c in ("bucket", "lo", "hi", "x", "id", "p", "c")] + [("led", pa.bool_()), ("before", pa.list_(pa.int64())), ("norm", pa.string())] + [(s, pa.int64()) for s in line_dedup._SKETCHES])
    met, run = [], line_dedup.similar_pairs
    monkeypatch.setattr(line_dedup, "similar_pairs", lambda texts, a, b, s: met.extend((whose[texts[x]], whose[texts[y]]) for x, y in zip(a, b, strict=True)) or run(texts, a, b, s))
    batch = pa.RecordBatch.from_pylist(rows, schema)
    got = {(r["a"], r["b"]) for out in line_dedup._in_blocks(0.8, line_dedup.AGREE)([batch]) for r in out.to_pylist()}
    near = {(i, j) for some in buckets.values() for i in some for j in some if i < j and abs(len(norm[i]) - len(norm[j])) <= 0.2 * max(len(norm[i]), len(norm[j])) + 1e-9}
    first = {(i, j): min(b for b in buckets if i in buckets[b] and j in buckets[b]) for i, j in near}
    want = {(i, j) for (i, j), b in first.items() if buckets[b][0] != i}
    assert len(met) == len(set(met)) and set(met) == want and len(near) > len(want)
    assert got == {(i, j) for i, j in want if similar(norm[i], norm[j])} and 5 < len(got) < len(want)


def test_keys_are_kept_as_bytes():
    """A class's keys are one value of the written table, and dealt as arrays of longs are."""
    lines = line_dedup.Lines(["one two three four five six\nfewer words\none two three four five six\nöne twö three four five   seven 7", ""], line_dedup.MIN_WORDS)
    assert lines.chars().tolist() == [27, 27, 31]
    keys = lines.key_lists()
    assert keys.type == pa.binary() and [k and len(k) for k in keys.to_pylist()] == [8 * line_dedup.BANDS, None, 8 * line_dedup.BANDS]
    longs = pa.array([np.frombuffer(k, np.int64) for k in keys.drop_null().to_pylist()], pa.list_(pa.int64()))
    dealt = [
        pa.Table.from_batches(line_dedup._dealt(5)([batch.slice(0, 1), batch.slice(1)])).to_pylist()
        for batch in (pa.RecordBatch.from_pydict({"lh": pa.array([3, 4]), "p": pa.array([27, 31], pa.int32()), "bands": b}) for b in (keys.drop_null(), longs))
    ]
    assert dealt[0] == dealt[1] and sum(len(r["id"]) for r in dealt[0]) == 2 * line_dedup.BANDS
