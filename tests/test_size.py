"""What must not grow faster than the input: what is evaluated, shuffled and remembered for a row."""

from __future__ import annotations

import re

import pytest
from tallyfold import sources as S
from tallyfold.operators import graph, ingest, intervals, linkage, notes, retrieval


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_note_lines_are_matched_once(spark):
    docs = spark.createDataFrame([(1, "x")], "k long, doc string")
    for parse, pattern in ((notes.parse_action_items, r"xX\]"), (notes.parse_decisions, "Rationale"), (notes.parse_questions, r"\(\.\+\?\)")):
        made = plan(parse(docs, "k"))
        assert len(re.findall(pattern, made)) == 1, made


def test_odd_note_lines(spark):
    lines = ["- [x] **Kim** - do it Due: Due: 2026-01-02. . [a] [Due: b] ", "* [ ] **A** : Due: soon", "- [ ] **B** - see [c] and [Due: d] e", "- [ ] **C** -  [only]", "- [X] **D** – x overdue: 3 due:2026-13-01", "- [ ] **E** - a\rDue: b"]
    doc = "## Action Items\n" + "\n".join(lines) + "\n## Action items\n- [ ] **F** - second section\n"
    got = [tuple(r)[1:] for r in notes.parse_action_items(spark.createDataFrame([(1, doc)], "k long, doc string"), "k").collect()]
    assert [(r[0], r[1], r[2], str(r[3] or ""), r[4], r[5]) for r in got] == [
        ("Kim", "do it", "Due: 2026-01-02", "2026-01-02", "[a] [Due: b]", "done"),
        ("B", "see [c] and [", "d] e", "", "", "open"),
        ("D", "x overdue: 3", "2026-13-01", "", "", "done"),
    ]
    doc = "# Decisions\n- **T** by them, by Kim Roe, and so. rationale: by X [1] y [2]\n- **U** [z Rationale: q]\n- **V** standby Me\n"
    got = [tuple(r)[1:] for r in notes.parse_decisions(spark.createDataFrame([(1, doc)], "k long, doc string"), "k").collect()]
    assert got == [("T", "Kim Roe", "by X [1] y", "[2]"), ("U", None, None, "[z Rationale: q]"), ("V", None, None, "")]


def test_register_rows_meet_without_a_shuffle_of_texts(spark):
    rows = spark.createDataFrame([("r", 1, "alpha beta", None), ("r", 2, "none", " Mary  Ann "), ("s", 3, "alpha", "Rosemary B"), ("s", 4, "beta alpha alpha", "")], "register string, row_id long, text string, owner string")
    found = retrieval.register_context(rows, "alpha beta mary")
    assert " Join" not in plan(found) and plan(found).count("Aggregate") == 0
    assert {tuple(r) for r in found.collect()} == {("r", 2, 3, 0, 1), ("r", 1, 2, 2, 2), ("s", 4, 2, 3, 1)}


def test_errors_are_fetched_for_meetings_that_failed_last(spark):
    log = spark.createDataFrame([(1, 1, "failed", "old"), (1, 2, "failed", "abcdef"), (1, 3, "nonsense", "x"), (2, 1, "failed", "gone"), (2, 2, "indexed", "y"), (None, 1, "failed", "none"), (3, None, "failed", "z"), (4, 1, "failed", None)], "id long, at long, status string, error string")
    for few in (ingest.FEW, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ingest, "FEW", few)
            out = ingest.advance(log, cut=4)
        assert {tuple(r) for r in out.collect()} == {(1, "failed", "abcd"), (2, "indexed", None), (None, "failed", "none"), (3, None, None), (4, "failed", None)}
    assert all("error" not in m for m in re.findall(r"max\w*\(.*\bat\b.*", plan(out)))
    assert "max_by" not in plan(out)


def test_only_labels_meet_the_speakers(spark):
    rows = spark.createDataFrame([(1, " SPEAKER_0 ", "A"), (1, "speaker_0", "B"), (2, "SPEAKER_0", "C"), (2, "D", " Speaker_1"), (2, " ", "E"), (2, None, "F"), (2, "Speaker_1", "SPEAKER_2"), (3, " G ", "H")], "meeting_id long, subject string, object string")
    speakers = spark.createDataFrame([(1, "SPEAKER_0", " Kim "), (1, "SPEAKER_0", "Jo"), (2, "Speaker_1", "Lee"), (2, "SPEAKER_2", " "), (3, "G", "Z")], "meeting_id long, label string, name string")
    found = graph.resolved(rows, ["subject", "object"], speakers)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "Kim", "A"), (2, "D", "Lee"), (3, "G", "H")]
    stays, joined = plan(found).split("Union")[1].split("Join", 1)
    assert "Join" in joined and "SPEAKER_" in stays and plan(found).index("Union") < plan(found).index("Join")


def test_nearest_by_large_blocks_and_few_rows_at_once(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(linkage, "BLOCK", 40)
    monkeypatch.setattr(linkage, "ROWS", 7)
    v = np.random.default_rng(3).normal(size=(90, 5)).round(1)
    groups = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.vstack([v, v[:9]]))], "id long, v array<double>")
    scores = np.round(np.vstack([v, v[:9]]) @ np.vstack([v, v[:9]]).T, 9)
    np.fill_diagonal(scores, -np.inf)
    want = {(i, max(np.flatnonzero(s == s.max())), s.max()) for i, s in enumerate(scores)}
    assert {tuple(r) for r in linkage.nearest(groups, groups).collect()} == want


def turned(degrees):
    import numpy as np

    return [(i, [float(np.cos(np.radians(x))), float(np.sin(np.radians(x)))]) for i, x in enumerate(degrees)]


def test_the_size_of_kept_groups_does_not_grow_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LAST", 0)
    digits = []

    def keep(df):
        digits.append(len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return S.keeper(spark)(df)

    # each is nearest to the one before it, so that one pair is merged in a round
    units = spark.createDataFrame(turned([0, 1, 3, 6, 10, 15, 180]), "id long, v array<double>")
    got = {tuple(r) for r in linkage.linkage(units, 0.9, keep=keep).collect()}
    assert got == {(i, 0 if i < 6 else 6) for i in range(7)} and len(digits) > 15
    assert max(digits) < 400, digits


def test_equal_vectors_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LAST", 0)
    kept = []

    def keep(df):
        kept.append(S.keeper(spark)(df))
        return kept[-1]

    units = spark.createDataFrame(turned([90] * 30 + [91] + [0] * 3) + [(i, [0.0, 0.0]) for i in (40, 41)], "id long, v array<double>")
    got = {tuple(r) for r in linkage.linkage(units, 0.9, keep=keep).collect()}
    assert got == {(i, 0 if i < 31 else 31 if i < 34 else i) for i in (*range(34), 40, 41)}
    assert len(kept) < 12


def test_nearest_of_scores_that_differ_after_nine_digits(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5 - 1e-12, 0.3]), (3, [0.5 - 3e-9, 0.0]), (4, [-1.0, 0.0])]
    groups = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: (r["best"], r["score"]) for r in linkage.nearest(groups.where("id in (0, 4)"), groups, 0.4).collect()}
    assert got == {0: (2, 0.5)}


def test_intervals_are_copied_to_few_buckets(spark):
    # 40 lengths from 1 to 20000 seconds: what is shuffled is each interval once for every bucket
    rows = [(1, i, float(i * 7 % 501), i * 7 % 501 + 1.0 + (i % 40) ** 3 / 3) for i in range(400)]
    a, b = (spark.createDataFrame(rows[k::2], "k long, n long, start double, end double") for k in (0, 1))
    x, y, _ = intervals.candidates(a, b, ["k"], "start", "end")
    copies = x.count() + y.count()
    got = {(r["l"]["n"], r["r"]["n"]) for r in intervals.overlaps(a, b, ["k"]).collect()}
    assert got == {(i, j) for _, i, s, e in rows[::2] for _, j, t, f in rows[1::2] if s < f and t < e}
    assert copies < 2000, copies
