"""Literal fixtures of the operators over questions, people, voices, names, transcripts and files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold import functions as X
from tallyfold import operators as O
from tallyfold import sources as S
from tallyfold.operators import classify, graph, ingest, naming, notes, people, retrieval, voices


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


def test_scalars(spark):
    c = F.col("t")
    assert one(spark, X.document_id(c), t="abc\n ") == one(spark, X.document_id(c), t="abc") == one(spark, X.document_id(c), t="\t abc")
    assert one(spark, X.slugify(c), t=" Café Zürich -- plan_B! ") == "café-zürich-plan-b"
    assert one(spark, X.unfence(c), t="```md\n# A\nb\n```\n") == "# A\nb" and one(spark, X.unfence(c), t="x ```y```") == "x ```y```"
    assert one(spark, X.spoken_date(c, F.lit("00:05")), t="2026-08-17") == "Monday, Aug 17, 2026 at 12:05 AM"
    assert one(spark, X.spoken_date(c, F.lit("25:00")), t="2026-08-17") == "Monday, Aug 17, 2026" and one(spark, X.spoken_date(c, F.lit("1:00")), t="soon") == "soon"
    assert one(spark, X.excerpt(c, 12), t="---\na: b\n---\n# Title\n**Bold** and   more words") == "Bold and mor..."
    assert one(spark, X.excerpt(c), t="") == "No minutes yet." and one(spark, X.excerpt(c), t="# only") == "Nothing to show."
    assert one(spark, X.cite(F.lit(None).cast("date"), c, F.lit(" [0:01] ")), t="Plan") == "undated - Plan [0:01]"
    assert one(spark, X.minutes_path(F.lit(None).cast("date"), c, F.lit("0123456789")), t="!!") == "0000-00-00-meeting-01234567.md"
    assert [one(spark, X.kind(c), t=k) for k in ("Person", "System", "who knows")] == ["person", "system", "other"]
    assert one(spark, X.safe_name(c), t="a b/é.m4a") == "a_b__.m4a" and one(spark, X.clamp(c, 3, "!"), t="abcd") == "abc!"
    assert [one(spark, X.diarization_warning(F.lit(n))) for n in (0, 3, 9)] == ["no speakers", None, "too many speakers"]
    assert one(spark, classify.unresolved_label(c), t="unknown speaker (speaker_03)") == "SPEAKER_03" and one(spark, classify.unresolved_label(c), t="Kim") == "Kim"
    assert one(spark, X.section(c, "A.b"), t="## A.b\nx\n## Axb\ny") == "x\n"


def test_names_in_dialogue(spark):
    said = {"Thanks, Ruth": ["Ruth"], "what do you think, Paul?": ["Paul"], "Paul, what do you think": [], "hey Kim, over to you, Kim.": ["Kim"], "Hi Team": [], "well, Okay": [], "Thank you Ana": ["Ana"]}
    for text, names in said.items():
        assert one(spark, classify.addressed(F.col("t"), ("team", "okay"), ("thanks", "thank you", "hey", "hi")), t=text) == names, text
    found = lambda n: one(spark, classify.file_candidates(F.col("t"), F.lit(" Ana Roe "), F.lit(n), ("weekly",)), t="Weekly with Kim and Lee at 3")
    assert found(2) == ["Ana Roe", "Kim", "Lee"] and found(3) == []


def test_rules_decide_by_priority_and_weight(spark):
    table = [classify.Rule("category", "is", "home", "Home"), classify.Rule("all", "word", "rent", "Home", 1, 0.5), classify.Rule("all", "word", "lease", "Home", 1, 0.5), classify.Rule("title", "part", "c++", "Code", 2)]
    said = lambda doc, title: one(spark, classify.decide(classify.note_fields(F.col("d"), F.col("t"), F.lit("n.md")), table), d=doc, t=title)
    assert said("---\ncategory: work\ncategory: 'Home'\n---\nx", "C++")["bucket"] == "Home"  # the last line of the key counts
    assert said("rent and lease", "x") == ("Home", 1) and said("rent, parental release", "about C++ ") == ("Code", 2) and said(None, "x") is None


def test_notes(spark):
    note = "## Action Items\n- [x] **Dana** — ship it. Due: before 2026-08-17. [0:01] [0:02]\n- [ ] **Kim** - Due: soon\n- [ ] **Lee** - call\n## Decisions\n- **Use A** — done by hand, decided jointly by Dana Roe and Kim. Rationale: cheap. [1:02]\n## Open Questions\n- Who pays? Mary-Ann needs to resolve this. [2:00]\n- We ask whether Kim Roe need to resolve it\n- Nothing else\n"
    df = spark.createDataFrame([(1, note)], "id long, doc string")
    got = [tuple(r)[1:] for r in notes.parse_action_items(df, "id").collect()]
    assert got[0][:3] == ("Dana", "ship it.", "before 2026-08-17") and str(got[0][3]) == "2026-08-17" and got[0][4:] == ("[0:01] [0:02]", "done")
    assert [g[0] for g in got] == ["Dana", "Lee"] and got[1][2] is None  # a line without a task is none
    assert [tuple(r)[1:] for r in notes.parse_decisions(df, "id").collect()] == [("Use A", "Dana Roe and Kim", "cheap.", "[1:02]")]
    assert [(r["owner"], r["cite"]) for r in notes.parse_questions(df, "id").collect()] == [("Mary-Ann", "[2:00]"), ("Kim Roe", ""), (None, "")]


def test_file_names(spark):
    df = spark.createDataFrame([("12340511_call_ab.m4a",), ("20260511_call.m4a",), ("Kim_Aug_10_at_11-31_a.m..m4a",), ("x at 2-3 pm.m4a",)], "name string")
    got = [(str(r["file_date"]), r["file_time"]) for r in naming.parse_file_name(df, "name", F.lit(2026)).collect()]
    assert got == [("None", None), ("2026-05-11", None), ("2026-08-10", "11:31"), ("None", "14:00")]
    names = {"call20260811.m4a": ("2026-08-11", "14:30", "call"), "Kim Mar 13 at 8-40 p.m..m4a": ("2026-03-13", "20:40", "Kim"), "9xYz-aBc_6_Ana_Aug_11_at_5-11_p.m..m4a": ("2026-08-11", "17:11", "9xYz aBc 6 Ana"), "2026-08-10T1100_plan-review.m4a": ("2026-08-10", "11:00", "plan review"), "20260810_1430_daily.m4a": ("2026-08-10", "14:30", "daily"), "late Jan 5 at 12-1 a.m..m4a": ("2026-01-05", "00:00", "late"), "noon Jan 5 at 12-1 p.m..m4a": ("2026-01-05", "12:00", "noon"), "voice 0042.m4a": ("2026-08-10", "14:30", "voice 0042"), "Meeting recording.m4a": ("2026-08-10", "14:30", None), "2026-13-40 x.wav": ("2026-08-10", "14:30", "2026 13 40 x")}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = naming.parse_file_name(df, "name", F.lit(2026), F.lit("2026-08-10 14:30:00").cast("timestamp")).collect()
    assert {r["name"]: (str(r["file_date"]), r["file_time"], r["file_hint"]) for r in found} == names


def test_retrieval(spark):
    reg = spark.createDataFrame([("c", 1, "review access", "Ali Roe"), ("c", 2, "alignment", None), ("d", 3, "CRUD access for all", None), ("d", 4, "access only", None), ("c", 5, "x", "Alignment")], "register string, row_id long, text string, owner string")
    got = [(r["register"], r["row_id"], r["hits"]) for r in retrieval.register_context(reg, "What does Ali say of CRUD access?", stop=("what", "does", "say")).orderBy("register", "rank").collect()]
    assert got == [("c", 1, 3), ("d", 3, 2)]
    assert retrieval.register_context(reg, "the and", stop=("the", "and")).count() == 0
    assert {r["row_id"] for r in retrieval.register_context(reg, "access").collect()} == {1, 3, 4}
    some = spark.createDataFrame([(f"2026-{i:02d}", "alpha " * i) for i in range(1, 8)], "name string, text string")
    assert [r["name"] for r in retrieval.scan_notes(some, "alpha").collect()] == ["2026-07", "2026-06", "2026-05", "2026-04", "2026-03"]
    assert sorted(r["name"] for r in retrieval.scan_notes(some, "nothing").collect()) == ["2026-05", "2026-06", "2026-07"]
    assert {r["score"] for r in retrieval.scan_notes(some, "the", stop=("the",)).collect()} == {1}
    labels = spark.createDataFrame([("Data-Lake",), ("Lakehouse",), ("Other",)], "label string")
    assert [tuple(r) for r in retrieval.match_labels(labels, "Where is the lake?").collect()] == [("Data-Lake", 1, 1), ("Lakehouse", 0, 1)]
    edges = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("b", "p", "c")], "src string, predicate string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abc"], "name string")
    near, kept = retrieval.graph_context(nodes, edges, spark.createDataFrame([("a",)], "node string"))
    assert [(r["node"], r["hops"]) for r in near.collect()] == [("a", 0), ("b", 1), ("c", 2)] and kept.count() == 2


def test_people(spark):
    p = spark.createDataFrame([("Kim", "host")], "canonical string, role string")
    a = spark.createDataFrame([("kim", "Kim"), ("mike", "Kim")], "alias string, canonical string")
    new = spark.createDataFrame([(" Lee ", [" Mike ", ""], None, 1), ("Kim", None, None, 2), ("", ["x"], "r", 3)], "canonical string, aliases array<string>, role string, pos long")
    p2, a2 = people.add_people(p, a, new)
    assert sorted(map(tuple, p2.collect())) == [("Kim", "host"), ("Lee", None)] and sorted(map(tuple, a2.collect())) == [("kim", "Kim"), ("lee", "Lee"), ("mike", "Lee")]
    p3, a3 = people.merge_aliases(p2, a2, {"Lee": "Kim"})
    assert [tuple(r) for r in p3.collect()] == [("Kim", "host")] and {r["canonical"] for r in a3.collect()} == {"Kim"} and a3.count() == 3
    samples = spark.createDataFrame([(1, "Lee"), (2, "Kim")], "id long, person string")
    matches = spark.createDataFrame([(1, "Lee", 0.9, "Lee"), (2, "Kim", 0.8, None)], "id long, best string, best_score double, resolved_as string")
    s, m = people.move_samples(samples, matches, {"Lee": "Kim"})
    assert {r["person"] for r in s.collect()} == {"Kim"} and m.where("resolved_as = 'Kim'").count() == 1
    s, m = people.forget(samples, matches, ["Lee"])
    assert s.count() == 1 and sorted((r["best"] or "", r["best_score"] or 0) for r in m.collect()) == [("", 0), ("Kim", 0.8)]
    with pytest.raises(ValueError):
        people.rename_person({"speakers": samples}, {"a": "b"})


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 9), (2, "b", 8)], "k long, v string, other long")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(map(tuple, O.sparse_upsert(old, new, "k", ["v"]).collect())) == [(1, "a", 9), (2, "b", 8), (3, "c", None)]
    with pytest.raises(ValueError):
        O.sparse_upsert(old, new, "k", ["w"])
    assert [r["k"] for r in O.replace_by_key(old, old.limit(0), "k", spark.createDataFrame([(1,)], "k long")).collect()] == [2]
    names = spark.createDataFrame([(1, "a", "Kim", "confirmed"), (1, "b", "Lee", "inferred"), (1, "c", None, "unknown")], "meeting_id long, label string, name string, confidence string")
    given = spark.createDataFrame([(1, "a", "X", "inferred"), (1, "b", "", "unknown"), (1, "c", "Ana", "inferred"), (1, "d", None, "unknown")], names.schema)
    assert sorted((r["label"], r["name"], r["confidence"]) for r in ingest.merge_names(names, given).collect()) == [("a", "Kim", "confirmed"), ("b", "Lee", "inferred"), ("c", "Ana", "inferred"), ("d", None, "unknown")]


def test_versions_runs_and_gate(spark):
    asked = spark.createDataFrame([(1, "v1"), (2, "v2")], "id long, version string")
    assert ingest.same_version(asked, asked).count() == 2
    with pytest.raises(Exception, match="another version of 2"):
        ingest.same_version(asked, asked.where("id = 1")).collect()
    with pytest.raises(Exception, match="another version of 2"):
        ingest.same_version(asked, asked.where("id = 1")).count()  # nothing prunes the check away
    events = spark.createDataFrame([(1, "start", "2026-01-01 00:00:00", 7, "asr", None), (1, "finish", "2026-01-01 00:00:09", 7, "asr", True), (2, "start", "2026-01-01 00:00:00", 7, "asr", None)], "run_id long, kind string, at string, meeting_id long, stage string, ok boolean").withColumn("at", F.to_timestamp("at"))
    assert sorted((r["run_id"], r["seconds"], r["ok"]) for r in ingest.paired_runs(events).collect()) == [(1, 9.0, True), (2, None, None)]


def test_transcripts_and_glossaries(spark, tmp_path):
    raw = json.dumps({"segments": [{"words": [{"word": " a "}, {"text": "b", "start": 1.0}, {"word": ""}], "end": 4.5, "speaker": "S1"}, {"text": "  "}, {"text": " x ", "start": 5, "end": 7, "speaker": "S0"}]})
    seg = ingest.segments_of(F.col("t"))
    got = one(spark, seg, t=raw)
    assert [(s["start"], s["end"], s["text"], len(s["words"])) for s in got] == [(0.0, 4.5, "a b", 2), (5.0, 7.0, "x", 0)]
    assert one(spark, ingest.duration_of(seg), t=raw) == 7.0 and one(spark, ingest.labels_of(seg), t=raw) == ["S1", "S0"]
    assert one(spark, seg, t="not json") == [] and one(spark, ingest.duration_of(seg), t="{}") == 0.0
    text = "# Terms\n- **Kafka** - a log\n<!-- - hidden -->\n- RBAC: roles\n## People\n* Kim Roe / Kimmy\nplain\n"
    lines = spark.createDataFrame([("g", i, x) for i, x in enumerate(text.split("\n"))], "path string, pos long, line string")
    assert [r["term"] for r in ingest.glossary(lines).collect()] == ["Kafka", "RBAC", "Kim Roe"] and [r["term"] for r in ingest.glossary(lines, "People").collect()] == ["Kim Roe"]
    given = ingest.overrides(spark, "default:\n  S0: Ana\n  S1: Bo\nabc:\n  S0: Kim\n")
    speakers = spark.createDataFrame([("abc1", "S0"), ("abc1", "S1"), ("x", "S0"), ("x", "S9")], "meeting_id string, label string")
    assert sorted(map(tuple, ingest.overridden(speakers, given).collect())) == [("abc1", "S0", "Kim"), ("abc1", "S1", "Bo"), ("x", "S0", "Ana")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text("# A\nb")
    (tmp_path / "b.m4a").write_bytes(b"12")
    (tmp_path / "t.json").write_text(json.dumps({"meeting_id": "m", "segments": [{"start": 0, "end": 1, "text": "x"}]}))
    assert [r["text"] for r in S.notes(spark, str(tmp_path)).collect()] == ["# A\nb"]
    files = S.files(spark, str(tmp_path), [".m4a", ".wav"]).collect()
    assert [(r["size"], r["md5"]) for r in files] == [(2, "c20ad4d76fe97759aa27a0c99bff6710")]
    t = S.transcripts(spark, f"{tmp_path}/t.json").first()
    assert (t["model"], t["language"], t["segments"][0]["text"]) == ("unknown", "en", "x")


def test_voices(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    v = np.concatenate([b + 0.35 * rng.normal(size=(8, 16)) for b in base])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)

    def plain(vectors, threshold):
        groups = [[i] for i in range(len(vectors))]
        while True:
            best = max(((np.round(np.mean([[vectors[i] @ vectors[j] for j in y] for i in x]), 9), a, b) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b), default=None)
            if best is None or best[0] < threshold:
                return groups
            groups[best[1]] = groups[best[1]] + groups.pop(best[2])

    want = {tuple(sorted(g)) for g in plain(u, 0.72)}
    assert 3 < len(want) < 48
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got: dict = {}
    for r in voices.cluster(df, 0.72, keep=S.keeper(spark)).collect():
        got.setdefault(r["cluster"], []).append(r["id"])
    assert {tuple(sorted(g)) for g in got.values()} == want and all(k == min(g) for k, g in got.items())
    units = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "id long, v array<double>")
    best = {(r["id"], r["person"]) for r in voices.match_blocks(units, units, 1).collect()}
    assert best == {(i, i) for i in range(len(u))}
    pending = df.select(F.col("id").alias("vec_id"), F.lit(40.0).alias("speech_sec"), "embedding")
    alone = O.match_top2(pending, spark.createDataFrame([], "person long, profile array<double>")).collect()
    assert len(alone) == len(v) and all(r["best"] is None and r["best_score"] == 0 and r["next_score"] == 0 for r in alone)
    say = lambda **k: one(spark, O.band(F.col("b"), F.lit(0.1), F.lit(60.0), F.lit(3), **k), b=0.9)
    assert say() == "auto" and say(over_segmented=F.lit(True)) == "review" and say(name=F.lit("Kim"), guess=F.lit("Lee")) == "review"
    assert say(**O.thresholds("cautious")) == "auto" and O.thresholds("confident")["auto"] == 0.57


def test_clips(spark):
    def plain(regions, words):
        every = [s + 6.0 * i for s, e in sorted(regions) for i in range(int((e - s) / 6 + 1e-9))]
        pool, low = [s for s in every if s >= 90], False
        if not pool:
            pool, low = every, True
        if words:
            dense = [s for s in pool if sum(max(0, min(s + 6, b) - max(s, a)) for a, b in words) >= 3]
            pool, low = (dense, low) if dense else (pool, True)
        out = []
        for s in pool:
            if len(out) < 4 and all(abs(s - p) >= 60 for p in out):
                out.append(s)
        return out, "low" if low or len(out) < 4 else "ok"

    rng = random.Random(5)
    kind = "array<struct<start: double, end: double>>"
    rows = []
    for k in range(60):
        regions = [(float(a), float(a + rng.randint(1, 60))) for a in rng.sample(range(0, 80 if k % 5 == 0 else 900, 7), rng.randint(0, 8))]
        words = [(float(a), a + rng.random() * 9) for a in rng.sample(range(0, 900, 11), rng.randint(0, 40))] if k % 3 else []
        rows.append((k, regions, words))
    df = spark.createDataFrame(rows, f"k long, r {kind}, w {kind}")
    clips, quality = voices.choose_clips(F.col("r"), F.col("w"))
    got = {r["k"]: (r["c"], r["q"]) for r in df.select("k", clips.alias("c"), quality.alias("q")).collect()}
    assert got == {k: plain(r, w) for k, r, w in rows} and len({q for _, q in got.values()}) == 2
