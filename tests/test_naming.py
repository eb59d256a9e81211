import itertools

import numpy as np
from pyspark.sql import functions as F

from tallyfold import operators as O
from tallyfold.operators import naming as N


def test_file_names(spark):
    names = [("Kim_Aug_10_at_11-31_a.m..m4a",), ("Kim Aug 10 at 2-3 pm.m4a",), ("2026-08-10T1100_sync.wav",), ("20260810_0930.wav",), ("12 Jan 12:05 a.wav",), ("notes.wav",), (None,)]
    got = [tuple(map(str, r)) for r in N.parse_file_name(spark.createDataFrame(names, "name string"), "name", F.lit(2026)).select("file_date", "file_time", "file_hint").collect()]
    assert got == [("2026-08-10", "11:31", "Kim"), ("2026-08-10", "14:00", "Kim"), ("2026-08-10", "11:00", "sync"), ("2026-08-10", "09:30", "None"), ("2026-01-12", "12:05", "a"), ("None", "None", "notes"), ("None", "None", "None")]


def test_compounds(spark):
    aliases = spark.createDataFrame([("dana roe", "Dana")], "alias string, canonical string")
    df = spark.createDataFrame([(1, "Dana Roe, Kim & Sandy"), (2, ""), (3, None)], "k int, o string")
    assert sorted((r.k, r.who) for r in N.canonical_compound(df, "k", "o", aliases, "who").collect()) == [(1, "Dana and Kim and Sandy"), (2, None), (3, None)]


def test_prefix_folding(spark):
    known = spark.createDataFrame([("Dana Roe", 3), ("Kim Li", 1), ("Kim Po", 9), ("Ana", 2), ("Ana B", 1), ("Ana B C", 1)], "name string, meetings int")
    names = spark.createDataFrame([("dana",), ("Kim",), ("Kim Li Jr",), ("Ana",), ("Zoe",), ("Dan",)], "name string")
    got = dict(map(tuple, N.fold_prefix(names, known).collect()))
    assert got == {"dana": "Dana Roe", "Kim": "Kim", "Kim Li Jr": "Kim Li", "Ana": "Ana", "Zoe": "Zoe", "Dan": "Dan"}


def test_titles_and_categories(spark):
    df = spark.createDataFrame([("# H", "", None), ("", "a/2026-01-02-big-plan-0a1b2c3d.md", "x"), ("b", "", "Weekly sync"), (None, None, "12")], "d string, p string, h string")
    assert [r[0] for r in df.select(N.resolve_title(F.col("d"), F.col("p"), F.col("h"))).collect()] == ["H", "Big Plan", "Weekly sync", "Untitled Meeting"]
    notes = spark.createDataFrame([("---\ncategory: a\n---\ncategory: b",), ("---\nx: 1\n---\n",), ("t",), ("---\nnever closed",)], "d string")
    assert [r[0] for r in notes.select(N.set_category(F.col("d"), F.lit("c"))).collect()] == ["---\ncategory: c\n---\ncategory: b", "---\ncategory: c\nx: 1\n---\n", "---\ncategory: c\n---\nt", "---\ncategory: c\n---\n---\nnever closed"]


def test_backup_copies_missing_changed_and_newer(spark):
    f = "path string, size long, mtime long"
    plan = N.backup_plan(spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 1, 2)], f), spark.createDataFrame([("b", 1, 1), ("c", 1, 1), ("d", 1, 1), ("e", 1, 1)], f))
    assert sorted(map(tuple, plan.collect())) == [("a", "copy"), ("b", "keep"), ("c", "copy"), ("d", "copy")]


def test_leave_one_out_is_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(p, m, float(10 + i), [float(x) for x in rng.normal(size=4) + 1.5 * np.eye(4)[p % 4]]) for i, (p, m) in enumerate(itertools.product(range(5), range(3)))] + [(9, 0, 20.0, [1.0, 0.0, 0.0, 0.0])]
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    vector = lambda some: unit(sum(w * unit(v) for _, _, w, v in some))
    want = []
    for p, m in {r[:2] for r in rows if r[0] != 9}:
        asked = vector([r for r in rows if r[:2] == (p, m)])
        scores = {q: round(float(asked @ vector([r for r in rows if r[0] == q and (q, r[1]) != (p, m)])), 6) for q in {r[0] for r in rows}}
        want.append((p, m, min(scores, key=lambda q: (-scores[q], q)) == p))
    got = O.leave_one_out(spark.createDataFrame(rows, "person int, meeting_id int, speech_sec double, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and {x[2] for x in want} == {True, False}
