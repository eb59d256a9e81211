"""Publications: what is written, what goes, and what a lost task or driver leaves behind."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import publish


def files(spark, rows):
    return spark.createDataFrame(rows, "key string, name string, content string")


def seen(base):
    return {n: open(f"{base}/{n}", encoding="utf-8").read() for n in os.listdir(base) if not n.startswith(("_", "."))}


def outcomes(df):
    return {(r["key"], r["name"]): r["outcome"] for r in df.collect()}


def test_changed_files_are_replaced_and_superseded_ones_go(spark, tmp_path):
    base = str(tmp_path)
    publish.publish(files(spark, [("1", "a.md", "A"), ("2", "b.md", "B"), ("3", "c.md", None), ("4", "d.md", "D")]), base)
    assert seen(base) == {"a.md": "A", "b.md": "B", "c.md": "", "d.md": "D"}
    before = os.stat(f"{base}/a.md").st_ino
    open(f"{base}/other.md", "w").write("not ours")
    got = outcomes(publish.publish(files(spark, [("1", "a.md", "A"), ("2", "c.md", "Bé"), ("3", "b.md", "B"), ("5", "e.md", "D")]), base))
    assert got == {("1", "a.md"): "same", ("2", "c.md"): "written", ("2", "b.md"): "superseded", ("3", "b.md"): "written", ("3", "c.md"): "superseded", ("4", "d.md"): "kept", ("5", "e.md"): "written"}
    assert seen(base) == {"a.md": "A", "b.md": "B", "c.md": "Bé", "d.md": "D", "e.md": "D", "other.md": "not ours"} and os.stat(f"{base}/a.md").st_ino == before
    assert outcomes(publish.publish(files(spark, []), base)) == {(k, n): "kept" for k, n in (("1", "a.md"), ("2", "c.md"), ("3", "b.md"), ("4", "d.md"), ("5", "e.md"))}
    publish.publish(files(spark, [("1", "a.md", "A")]), base, whole=True)
    assert seen(base) == {"a.md": "A", "other.md": "not ours"} and publish.manifest(spark, base).count() == 1 and os.listdir(f"{base}/_staged") == []


@pytest.mark.parametrize("rows", [[("1", "x.md", "X"), ("1", "y.md", "Y")], [("1", "x.md", "X"), ("2", "x.md", "Y")], [("9", "a.md", "X")], [(None, "x.md", "X")], [("1", "../x.md", "X")], [("1", None, "X")], [("1", "_x.md", "X")]])
def test_wrong_keys_and_names_commit_nothing(spark, tmp_path, rows):
    base = str(tmp_path)
    publish.publish(files(spark, [("0", "a.md", "A")]), base)
    with pytest.raises(Exception, match="two files|no file name"):
        publish.publish(files(spark, rows), base)
    assert seen(base) == {"a.md": "A"} and publish.manifest(spark, base).count() == 1
    publish.publish(files(spark, [("1", "b.md", "B")]), base)
    assert seen(base) == {"a.md": "A", "b.md": "B"}


def test_a_task_or_driver_lost_on_the_way(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    publish.publish(files(spark, [("1", "a.md", "A"), ("2", "b.md", "B")]), base)
    flag = str(tmp_path / "_killed")
    staging = publish._staging

    def dying(base):
        stage = staging(base)

        def run(frames):
            yield from stage(frames)
            if not os.path.exists(flag):  # the files are written, the task's result isn't committed
                open(flag, "w").close()
                os._exit(1)

        return run

    new = files(spark, [("1", "a2.md", "A2"), ("2", "b.md", "B2")])
    with monkeypatch.context() as m:
        m.setattr(publish, "_staging", dying)
        with pytest.raises(Exception):
            publish.publish(new, base)  # one attempt for each task in local mode
    assert os.path.exists(flag) and seen(base) == {"a.md": "A", "b.md": "B"}
    with monkeypatch.context() as m:
        m.setattr(publish, "settle", lambda spark, base: None)
        publish.publish(new, base)  # the driver is lost after the commit
    assert seen(base) == {"a.md": "A", "b.md": "B"}
    publish.settle(spark, base)
    publish.settle(spark, base)
    assert seen(base) == {"a2.md": "A2", "b.md": "B2"}


def test_transcripts_and_exports(spark, tmp_path):
    segments = spark.createDataFrame([("m", 0, 0.0, 1.0, "S0", "hello"), ("m", 1, 1.0, 2.0, "S0", "again"), ("m", 2, 65.0, 66.0, None, "who")], "id string, pos int, start double, end double, speaker string, text string")
    names = spark.createDataFrame([("m", "S0", "Kim")], "id string, label string, name string")
    publish.publish(publish.transcript_files(segments, names), str(tmp_path / "t"))
    got = seen(str(tmp_path / "t"))
    assert [s["text"] for s in json.loads(got["m.json"])["segments"]] == ["hello", "again", "who"]
    assert got["m.md"].split("\n\n") == ["[0:00] Kim: hello again", "[1:05] UNKNOWN: who\n"]
    notes = files(spark, [("1", "a.md", "work"), ("2", "b.md", "home"), ("3", "c.md", None)])
    _, n = publish.export(notes, F.col("content") == "work", str(tmp_path / "e"))
    assert n == {"synced": 1, "quarantined": 2} and seen(str(tmp_path / "e")) == {"a.md": "work"}
    _, n = publish.export(notes, F.col("content") == "home", str(tmp_path / "e"))
    assert seen(str(tmp_path / "e")) == {"b.md": "home"}
