import pytest
from pyspark.sql import functions as F

from tallyfold import functions as X
from tallyfold import operators as O
from tallyfold.plans import registry
from tallyfold.operators.notes import parse_action_items, parse_decisions, parse_questions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_timestamp(spark):
    df = spark.createDataFrame([(None,), (59.9,), (61.0,), (3723.0,)], "s double")
    assert [r[0] for r in df.select(X.format_timestamp(F.col("s"))).collect()] == ["?:??", "0:59", "1:01", "1:02:03"]


def test_action_items(spark):
    doc = "# T\n\n## Action Items\n- [x] **Dana** - ship it. Due: before 2026-08-17. [0:01] [0:02]\n- [ ] **Kim** — think\nnot a line\n\n## Risks\n- [ ] **No** - one\n"
    got = rows(parse_action_items(spark.createDataFrame([(1, doc)], "k int, doc string"), "k"))
    assert [(r[1], r[2], r[3], str(r[4]), r[5], r[6]) for r in got] == [("Dana", "ship it.", "before 2026-08-17", "2026-08-17", "[0:01] [0:02]", "done"), ("Kim", "think", None, "None", "", "open")]


def test_decisions_and_questions(spark):
    doc = "## Decisions\n- **Use A** - decided jointly by Dana Roe and Kim. Rationale: cheap. [1:02]\n- **Keep B** - agreed by all\nRationale: on a second line\n\n## Open Questions\n- Who pays? Ana needs to resolve this. [0:03]\n- Why? It needs to change.\n\n## Risks\n- none\n"
    notes = spark.createDataFrame([(1, doc), (2, ""), (3, None)], "k int, doc string")
    assert sorted(map(str, parse_decisions(notes, "k").drop("k").collect())) == ["Row(text='Keep B', decided_by=None, rationale=None, cite='')", "Row(text='Use A', decided_by='Dana Roe and Kim', rationale='cheap.', cite='[1:02]')"]
    assert sorted(map(str, parse_questions(notes, "k").drop("k").collect())) == ["Row(text='Who pays? Ana needs to resolve this.', owner='Ana', cite='[0:03]')", "Row(text='Why? It needs to change.', owner=None, cite='')"]


def test_replace_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "m int, t string")
    new = spark.createDataFrame([(1, "z")], "m int, t string")
    once = O.replace_by_key(old, new, "m")
    assert rows(once) == rows(O.replace_by_key(once, new, "m")) == [(1, "z"), (2, "c")]


def test_sparse_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, w int")
    new = spark.createDataFrame([(1, None, 5), (2, "n", None)], "k int, v string, w int")
    assert sorted(map(str, O.sparse_upsert(old, new, "k", ["v", "w"]).collect())) == ["Row(k=1, v='a', w=5)", "Row(k=2, v='n', w=None)"]


def test_turns_keep_text_and_order(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, None, "z"), (1, 3, "a", "w")], "s int, t int, p string, x string")
    got = O.merge_turns(df, "s", "t", "p", "x").orderBy("turn_no").collect()
    assert [(r["p"], r["merged"], r["text"]) for r in got] == [("a", 2, "x y"), (None, 1, "z"), ("a", 1, "w")]


def test_windows(spark):
    df = spark.createDataFrame([([3, 3, 9, 1],)], "n array<int>")
    assert df.select(O.pack_windows(F.col("n"), 8)).first()[0] == [0, 0, 1, 2]


@pytest.mark.parametrize("best,nxt,want", [(0.70, 0.65, "review"), (0.70, 0.50, "auto"), (0.30, 0.0, "new"), (None, 0.0, "new")])
def test_band(spark, best, nxt, want):
    df = spark.createDataFrame([(best, nxt)], "b double, n double")
    assert df.select(O.band(F.col("b"), F.col("n"), F.lit(60.0), F.lit(2))).first()[0] == want


def test_match_ties_and_empty(spark):
    pending = spark.createDataFrame([(1, 60.0, [1.0, 0.0])], "vec_id int, speech_sec double, embedding array<float>")
    prints = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0])], "person int, profile array<double>")
    r = O.match_top2(pending, prints).first()
    assert (r["best"], r["next"]) == (1, 2)


def test_every_query_has_a_schema(spark):
    for name, (query, _) in registry().items():
        assert query(spark, "/root/testdata/sf0.001").columns, name
