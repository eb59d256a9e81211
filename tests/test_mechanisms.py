"""As-of, intervals, linkage, windows and the streaming queue against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold import sources as S
from tallyfold.operators import asof, graph, ingest, intervals, keys, linkage, notes, windows
from tallyfold.streaming import claims


def test_asof_is_strict_by_date_and_time(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *(f"2026-01-{d:02d}" for d in range(1, 9))]), rng.choice([None, "", "09:00", "10:30", "16:00"]), rng.random() < 0.5) for i in range(300)]
    m = spark.createDataFrame(rows, "id long, meeting_date string, meeting_time string, has boolean").withColumn("meeting_date", F.to_date("meeting_date"))
    for k, ranges in ((1, 3), (3, 200)):
        got = {r["id"]: r["prior"] for r in asof.preceding(m, m.where("has"), k, ranges=ranges).collect()}
        for i, d, t, _ in rows:
            earlier = [(x, y or "", y is not None, j) for j, x, y, has in rows if has and d and x and (x, y or "") < (d, t or "")]
            assert got[i] == [e[3] for e in sorted(earlier, reverse=True)[:k]], (i, d, t)
    pair = spark.createDataFrame([(1, "2026-01-01", None, True), (2, "2026-01-01", None, True)], "id long, meeting_date string, meeting_time string, has boolean").withColumn("meeting_date", F.to_date("meeting_date"))
    assert [r["prior"] for r in asof.preceding(pair, pair, 3).collect()] == [[], []]
    assert asof.preceding(m.limit(0), m.limit(0), 3).count() == 0 and {tuple(r["prior"]) for r in asof.preceding(pair, pair.limit(0), 2).collect()} == {()}


def test_intervals_are_the_inequality_join(spark):
    rng = random.Random(8)
    span = lambda: (rng.choice(["a", "b", None]), (s := round(rng.uniform(-50, 500), 2)), rng.choice([None, s, s - 1, s + rng.choice([0.3, 1, 5, 6, 64, 900])]))
    left, right = [(i, *span()) for i in range(150)], [(i, *span()) for i in range(200)]
    schema = "n long, k string, start double, end double"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = Counter((r["k"], r["l"]["n"], r["r"]["n"], round(r["shared"], 6)) for r in intervals.overlaps(a, b, ["k"]).collect())
    real = lambda s, e: e is not None and s < e
    want = Counter((k, i, j, round(min(e, y) - max(s, x), 6)) for i, k, s, e in left for j, q, x, y in right if k is not None and k == q and real(s, e) and real(x, y) and s < y and x < e)
    assert got == want and len(want) > 100
    cover = {r["n"]: r["coverage"] for r in intervals.coverage(a, b, ["k"], id_="n").collect()}
    for i, k, s, e in left:
        total = sum(c[3] * n for c, n in want.items() if c[1] == i)
        assert cover[i] == pytest.approx(min(1, total / (e - s)) if real(s, e) and k else 0, abs=1e-6)


def test_short_intervals_dont_meet_in_wide_buckets(spark):
    """One long interval on each side: the short ones meet those, not each other's copies at the wide level."""
    rows = lambda odd: [(i, "a", 8.0 * i + odd, 8.0 * i + odd + 1) for i in range(200)] + [(999, "a", 3.0, 1500.0)]
    a, b = (spark.createDataFrame(rows(odd), "n long, k string, start double, end double") for odd in (0, 4))
    x, y, same = intervals.candidates(a, b, ["k"], "start", "end")
    got = {(r["l"]["n"], r["r"]["n"]) for r in intervals.overlaps(a, b, ["k"]).collect()}
    assert got == {(i, j) for i, _, s, e in rows(0) for j, _, t, f in rows(4) if s < f and t < e} and len(got) > 300
    assert x.join(y, same).count() < 1500


def plain_linkage(u, threshold):
    """One best pair after the other, over the matrix of summed cosines."""
    n = len(u)
    sums, size, alive = u @ u.T, np.ones(n), np.ones(n, bool)
    groups = {i: [i] for i in range(n)}
    mean = sums.copy()
    np.fill_diagonal(mean, -np.inf)
    while True:
        i, j = divmod(int(mean.argmax()), n)
        if mean[i, j] < threshold:
            return {tuple(sorted(g)) for g in groups.values()}
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        size[i] += size[j]
        alive[j] = False
        row = np.where(alive, sums[i] / (size[i] * size), -np.inf)
        row[i] = -np.inf
        mean[i], mean[:, i] = row, row
        mean[j], mean[:, j] = -np.inf, -np.inf


def test_linkage_of_one_large_component(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LAST", 300)
    # a random walk: each vector is near the next one, so that all of them hang together
    rng = np.random.default_rng(4)
    v = np.cumsum(rng.normal(size=(900, 8)) * 0.35, axis=0) + rng.normal(size=(900, 8))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = plain_linkage(u, 0.9)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "id long, v array<double>")
    got: dict = {}
    for r in linkage.linkage(df, 0.9, keep=S.keeper(spark)).collect():
        got.setdefault(r["cluster"], []).append(r["id"])
    assert {tuple(sorted(g)) for g in got.values()} == want and all(k == min(g) for k, g in got.items()) and 5 < len(want) < 800


def test_linkage_of_equal_vectors_and_none(spark, monkeypatch):
    monkeypatch.setattr(linkage, "LAST", 0)  # all of it by rounds
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0]), ("d", [0.0, 1.0]), ("e", [1.0, 0.0]), ("f", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    assert {(r["id"], r["cluster"]) for r in linkage.linkage(df, 0.9, keep=S.keeper(spark)).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "a"), ("d", "d"), ("f", "d")}
    assert linkage.linkage(df.limit(0), 0.9, keep=S.keeper(spark)).count() == 0


def test_dialogue_lines_and_windows(spark):
    rows = [(1, 0, 3.0, "S0", "a"), (1, 1, 4.0, "S0", "b"), (1, 2, 65.0, "S1", "c"), (1, 3, 3700.0, None, "d"), (1, 4, None, "S0", None)]
    seg = spark.createDataFrame(rows, "id long, pos long, start double, speaker string, text string")
    names = spark.createDataFrame([(1, "S0", "Kim"), (2, "S1", "Lee"), (1, "S1", None)], "id long, label string, name string")
    lines = windows.dialogue(seg, names).orderBy("pos")
    assert [r["line"] for r in lines.collect()] == ["[0:03] Kim: a b", "[1:05] S1: c", "[1:01:40] UNKNOWN: d", "[0:00] Kim: "]
    text = "\n".join(r["line"] for r in lines.collect())
    got = windows.windows(lines, 30).orderBy("window").collect()
    assert "\n".join(r["text"] for r in got) == text and [(r["window"], r["total"]) for r in got] == [(1, 3), (2, 3), (3, 3)]


def test_map_reduce_keeps_what_fits_and_notes_what_fails(spark):
    lines = spark.createDataFrame([("short", 0, "fits")] + [("long", i, f"line {i} " + "x" * 30) for i in range(20)] + [("dull", i, "nothing here at all" * 3) for i in range(9)] + [("wide", i, "echo " * 30) for i in range(9)], "id string, pos long, line string")

    def extract(parts):
        out = []
        for p in parts:
            if "line 3 " in p.text:
                raise RuntimeError("no answer")
            out.append(" NOTHING\n" if "nothing" in p.text else p.text if "echo" in p.text else f"{p.window} of {p.total}")
        return out

    got = {r["id"]: r for r in windows.map_reduce(lines, extract, 20, 25, keep=S.keeper(spark)).collect()}
    assert got["short"]["text"] == "fits" and (got["short"]["level"], got["short"]["status"]) == (0, "whole")
    assert (got["dull"]["status"], got["dull"]["text"]) == ("empty", None) and got["wide"]["status"] == "long"
    # 10 windows of 2 lines are over the budget, so their parts were packed and extracted again
    assert got["long"]["level"] == 2 and got["long"]["status"] == "condensed" and got["long"]["text"].startswith("### Part 1/")
    once = {r["window"]: (r["output"], r["error"]) for r in windows.extracts(windows.windows(lines.where("id = 'long'"), 100), extract).collect()}
    assert once[2] == (None, "RuntimeError: no answer") and once[1] == ("1 of 10", None) and len(once) == 10
    assert windows.map_reduce(lines.limit(0), extract, 20, 25, keep=S.keeper(spark)).count() == 0


def answers(df):
    return Counter((r["meeting_id"], str(r["at"]), r["seq"], r["kind"], r["worker"], r["outcome"], r["status"], r["attempts"]) for r in df.collect())


def test_claims_of_a_restarted_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(1, 12), f"2026-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00", i, rng.choice(["discovered", "claim", "claim", "done", "done", "failed", "retry"]), rng.choice(["w1", "w2", None])) for i in range(900)]
    events = spark.createDataFrame(rows, "meeting_id long, at string, seq long, kind string, worker string").withColumn("at", F.to_timestamp("at"))
    src, sink, log = (str(tmp_path / x) for x in ("in", "out", "cp"))
    was = spark.conf.get(claims.ROCKS[0])
    spark.conf.set(*claims.ROCKS)
    try:
        for low in (0, 300, 600):  # each third is another run of the query over the same checkpoint
            for at in (low, low + 150):
                events.where(f"seq >= {at} AND seq < {at + 150}").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1 if low == 300 else 10).parquet(src)
            q = claims.claims(stream, lease=1800, late="10 hours").writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(240)
    finally:
        spark.conf.set(claims.ROCKS[0], was)
    got = answers(spark.read.parquet(sink))
    batch = answers(claims.claims_batch(events, lease=1800))
    trailing = got - batch  # timers of claims that nothing ended
    assert batch - got == Counter() and sum(batch.values()) > 900 and {k[5] for k in trailing} <= {"expired"} and len(trailing) <= 12
    holds: dict = {}
    for r in sorted((r for r in spark.read.parquet(sink).collect() if r["outcome"] in ("granted", "advanced", "failed", "expired")), key=lambda r: (r["meeting_id"], r["at"], r["outcome"] == "granted")):
        if r["outcome"] == "granted":
            assert holds.get(r["meeting_id"]) is None  # nobody else holds it
            holds[r["meeting_id"]] = r["worker"]
        else:
            assert holds[r["meeting_id"]] == r["worker"]
            holds[r["meeting_id"]] = None


def test_claim_steps():
    def run(*events, lease=10):
        state, out = claims.State(), []
        for i, (at, kind, worker) in enumerate(events):
            state, said = claims.step(state, claims.Event(at * 1_000_000, i, kind, worker), lease)
            out += [(a.outcome, a.status, a.attempts) for a in said]
        return out

    assert run((0, "claim", "a"), (1, "discovered", None), (2, "claim", "a"), (3, "claim", "b"), (4, "done", "b"), (5, "done", "a")) == [("refused", None, 0), ("discovered", "discovered", 0), ("granted", "discovered", 1), ("refused", "discovered", 1), ("ignored", "discovered", 1), ("advanced", "transcribed", 0)]
    assert run((0, "discovered", None), (1, "claim", "a"), (11, "claim", "b"), (12, "done", "a"), (13, "failed", "b"), (14, "claim", "a"), (15, "retry", None)) == [("discovered", "discovered", 0), ("granted", "discovered", 1), ("expired", "discovered", 1), ("granted", "discovered", 2), ("ignored", "discovered", 2), ("failed", "failed", 2), ("refused", "failed", 2), ("requeued", "discovered", 2)]
    assert run((5, "discovered", None), (4, "claim", "a"))[1][0] == "late"


def test_graph_folds_in_order(spark):
    ent = spark.createDataFrame([(2, 2, "Kim", None, " b "), (1, 1, " Kim ", "other", "a"), (3, 3, "SPEAKER_01", "person", "b"), (3, 4, "speaker_02", "person", "lost"), (4, 5, "Kim", "team", "c"), (5, 6, "X", None, ""), (6, 7, " ", "team", "z")], "meeting_id long, o long, name string, kind string, description string")
    speakers = spark.createDataFrame([(3, "SPEAKER_01", " Kim "), (3, "SPEAKER_02", "")], "meeting_id long, label string, name string")
    rows = graph.resolved(ent, ["name"], speakers)
    found, sources = graph.nodes(rows, F.col("o"))
    assert sorted(map(tuple, found.collect())) == [("Kim", "person", "a b c", 4), ("X", "other", "other mentioned in the meeting record", 1)]
    assert sorted(r["source_id"] for r in graph.payloads(found, sources).collect()) == ["1|2|3|4", "5"]
    rel = spark.createDataFrame([(2, 2, "Kim", "has", "X"), (1, 1, "Kim", " has", "X"), (1, 3, "Kim", "is", "Kim"), (1, 4, "Kim", "", "X"), (1, 5, "Kim", "has", "Nobody"), (3, 6, "X", "of", "SPEAKER_01"), (4, 7, "X", "of", "SPEAKER_01")], "meeting_id long, o long, subject string, predicate string, object string")
    got = graph.edges(graph.resolved(rel, ["subject", "object"], speakers), found, F.col("o")).collect()
    assert sorted((r["source"], r["predicate"], r["target"], r["meeting_id"], r["description"]) for r in got) == [("Kim", "has", "X", 1, "Kim has X"), ("X", "of", "Kim", 3, "X of Kim")]
    many = spark.createDataFrame([(1, i, "N", None, f"{i:04d}" + "y" * 20) for i in range(300)], ent.schema)
    whole = " ".join(f"{i:04d}" + "y" * 20 for i in range(300))
    assert graph.nodes(many, F.col("o"))[0].first()["description"] == whole[:2000]


def test_write_new_counts_in_the_same_pass(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v long")
    out = str(tmp_path / "nodes")
    assert graph.write_new(rows, rows.where("k = 'b'"), ["k"], out) == {"written": 2, "skipped": 1}
    assert graph.write_new(rows, spark.read.parquet(out), ["k"], out) == {"written": 1, "skipped": 2}
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_files_seen_before_are_not_read(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name, data in {"a.wav": b"one", "b.wav": b"two", "sub/c.wav": b"one", "d.wav": b"three", "e.txt": b"no"}.items():
        (folder / name).write_bytes(data)
    listed = S.listing(spark, str(folder), [".wav"])
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1] and "ReadSchema" in plan and listed.count() == 4
    seen = listed.where("path LIKE '%/b.wav'").unionByName(listed.where("path LIKE '%/d.wav'").withColumn("size", F.col("size") + 1))
    # a file that is skipped may even be unreadable
    (folder / "b.wav").chmod(0)
    known = spark.createDataFrame([], "sha256 string")
    got = {r["path"].split("/")[-1]: r["outcome"] for r in ingest.ingest_folder(spark, str(folder), [".wav"], seen, known, str(tmp_path / "out")).collect()}
    assert got == {"a.wav": "ingested", "c.wav": "duplicate", "b.wav": "skipped", "d.wav": "ingested"}
    small = S.digests(spark, listed.where("path NOT LIKE '%/b.wav'"), str(tmp_path / "out2"), batch=2)
    assert small.count() == 3 and small.where(F.length("sha256") == 64).count() == 3


def test_backfill_reads_the_notes_once(spark):
    doc = "# T\n## Action Items\n- [ ] **Kim** - call. Due: 2026-01-02\n- [ ] **Lee** - \n## Decisions\n- **Go** - decided by Ana.\n## Decisions\n- **Not this** - by B.\n## Open Questions\n- Who?\n- Why?\n"
    df = spark.createDataFrame([(1, doc), (2, "# none"), (3, None), (4, doc.replace("\n## Decisions\n- **Not", "\n## Other\n- **Not"))], "id long, doc string")
    kept = []

    def keep(frame):
        kept.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return S.keeper(spark)(frame)

    tables, counts = notes.backfill(df, "id", keep)
    assert counts == {"meetings": 4, "commitments": 2, "decisions": 2, "open_questions": 4}
    assert {k: t.count() for k, t in tables.items()} == {"commitments": 2, "decisions": 2, "open_questions": 4}
    assert sum("doc" in p for p in kept) == 1  # the later tables come from the lines


def test_keys_are_enforced_by_every_action(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, v string, w long")
    more = lambda *rows: spark.createDataFrame(list(rows), old.schema)
    assert sorted(map(str, keys.insert_checked(old, more((3, None, 7), (4, "d", 8)), ["k"]).collect())) == sorted(map(str, [*old.collect(), *more((3, None, 7), (4, "d", 8)).collect()]))
    for i, (bad, said) in enumerate([((2, "x", 1), "key exists: 2"), ((None, "x", 1), "key exists: null")]):
        wrong = keys.insert_checked(old, more((9, "y", 1), bad), ["k"])
        for action in (lambda: wrong.count(), lambda: wrong.select("w").collect(), lambda: wrong.write.parquet(str(tmp_path / f"out{i}"))):
            with pytest.raises(Exception, match=said):
                action()
    with pytest.raises(Exception, match="key exists: 7"):
        keys.insert_checked(old, more((7, "x", 1), (7, "x", 1)), ["k"]).count()
    turns = spark.createDataFrame([("s", 0, "a"), ("s", 4, "b")], "session string, turn long, text string")
    new = spark.createDataFrame([("s", 2, "d"), ("s", 1, "c"), ("t", 1, "e")], "session string, at long, text string")
    got = keys.append_indexed(turns, new, "session", "turn", [F.col("at")])
    assert sorted((r["session"], r["turn"], r["text"]) for r in got.collect()) == [("s", 0, "a"), ("s", 4, "b"), ("s", 5, "c"), ("s", 6, "d"), ("t", 0, "e")]
    with pytest.raises(Exception, match="key exists: s, "):
        keys.append_indexed(turns.union(turns), new, "session", "turn", [F.col("at")]).count()
