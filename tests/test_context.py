"""Budgets and contexts against plain versions."""

import random

from pyspark.sql import functions as F

from tallyfold import sources as S
from tallyfold.operators import context


def test_budgets_cut_and_keep_like_plain_loops(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["", "a", "bc" * rng.randrange(9), "é" * 5, None])) for k in ("x", "y", None) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    for budget in (1, 7, 20, 500):
        got = {r["k"]: r["context"] for r in context.assemble(df, ["k"], ["i"], "t", budget, "--").collect()}
        whole = {k: "--".join(t or "" for j, _, t in rows if j == k) for k in ("x", "y", None)}
        assert got == {k: v[:budget] for k, v in whole.items()}
        for first in (False, True):
            kept = {(r["k"], r["i"]) for r in context.spend(df, ["k"], [F.col("i").desc()], F.length("t") + 3, budget, first).collect()}
            want = set()
            for k in whole:
                used = 0
                for n, (_, i, t) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])):
                    used += 0 if t is None else len(t) + 3
                    if used <= budget or first and n == 0:
                        want.add((k, i))
            assert kept == want
    assert context.assemble(df.limit(0), ["k"], ["i"], "t", 5).count() == 0


def test_history_keeps_the_newest_and_folds_questions(spark):
    rows = [("s", i, f"q{i}", "a" * 10 * i) for i in range(1, 9)] + [("long", 1, "only", "z" * 5000), ("nulls", 1, None, None)]
    df = spark.createDataFrame(rows, "session string, turn int, question string, answer string")
    kept = context.history(df, last=4, answer_chars=75, chars=200)
    assert sorted((r["session"], r["turn"], len(r["answer"])) for r in kept.collect()) == [("long", 1, 75 + 15), ("nulls", 1, 0), ("s", 7, 70), ("s", 8, 90)]
    asked = spark.createDataFrame([("s", "why?"), ("new", "what?")], "session string, question string")
    assert {r["session"]: r["query"] for r in context.retrieval_queries(kept, asked).collect()} == {"s": "q7 q8 why?", "new": "what?"}


def test_prior_context_has_earlier_notes_only(spark):
    rows = [(1, "2026-01-01", None, "A", "one" * 10), (2, "2026-01-01", None, None, "two"), (3, "2026-01-02", "09:00", "", None), (4, "2026-01-03", "09:00", "D", "four"), (5, None, None, "E", "five")]
    m = spark.createDataFrame(rows, "id long, meeting_date string, meeting_time string, title string, text string").withColumn("meeting_date", F.to_date("meeting_date"))
    topical = spark.createDataFrame([(1, "  \n"), (5, " related matter ")], "id long, text string")
    got = {r["id"]: r["context"] for r in context.prior_context(m, m, k=2, chars=5, topical=topical, topical_chars=7).collect()}
    two, one = "### 2026-01-01 — meeting\n\ntwo", "### 2026-01-01 — A\n\noneon"
    assert got == {1: context.NO_PRIOR, 2: context.NO_PRIOR, 3: f"{two}\n\n{one}", 4: two, 5: "### Topically related earlier material\n\nrelated"}


def test_graph_and_question_contexts(spark):
    keep = S.keeper(spark)
    nodes = spark.createDataFrame([("Kim", "an owner"), ("Plan", "what is to come"), ("Far", "three steps away"), ("Mid", None), ("Kim Lee", "another")], "name string, description string")
    edges = spark.createDataFrame([("Kim", "owns", "Plan"), ("Kim", "owns", "Plan"), ("Plan", None, "Mid"), ("Mid", "x", "Far"), ("Ghost", "x", "Kim"), ("Kim", "knows", None)], "source string, predicate string, target string")
    text = "## Knowledge graph (matched: Kim, Kim Lee)\n\n### Entities\n- **Kim**: an owner\n- **Plan**: what is to come\n- **Kim Lee**: another\n\n### Relationships\n- Kim owns Plan\n- Plan relates to Mid"
    got = context.graph_text(nodes, edges, "What does Kim own?", keep)
    assert [r["context"] for r in got.collect()] == [text]
    assert [r["context"] for r in context.graph_text(nodes, edges, "What does Kim own?", keep, chars=60).collect()] == [text[:60]]
    assert context.graph_text(nodes, edges, "and the?", keep).collect() == []
    assert [r["context"] for r in context.graph_text(nodes, edges.limit(0), "Far", keep).collect()] == ["## Knowledge graph (matched: Far)\n\n### Entities\n- **Far**: three steps away"]
    found = spark.createDataFrame([("b", 2, "B"), ("a", 2, "A"), ("c", 9, "C")], "name string, score long, text string")
    registers = spark.createDataFrame([("risks", 2, "later"), ("risks", 1, "first"), ("decisions", 1, None)], "register string, rank long, text string")
    blank = spark.createDataFrame([(" ",)], "context string")
    whole = context.question_context([context.register_text(registers), blank, got, context.notes_text(found)]).collect()[0]
    want = context.RULE.join(["## decisions\n- \n\n## risks\n- first\n- later", text, "## Minutes excerpts\n\n" + context.RULE.join(["## c\nC", "## a\nA", "## b\nB"])])
    assert whole["context"] == want and whole["chars"] == len(want)
    newest = context.notes_text(found.withColumn("score", F.lit(0).cast("long"))).collect()[0]["context"]
    assert newest.index("## c") < newest.index("## b") < newest.index("## a")
    assert context.question_context([context.notes_text(found.limit(0))]).collect()[0]["chars"] == 0


def test_sample_is_opening_middle_and_end(spark):
    rows = [("long", i, i * 2.0 if i % 9 else None) for i in range(400)] + [("short", i, 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, pos int, start double")
    got = {k: sorted(r["pos"] for r in context.sample(df).where(F.col("id") == k).collect()) for k in ("long", "short")}
    early = sum((s or 0.0) <= 240 for k, _, s in rows if k == "long")
    assert got["long"] == sorted({*range(early), *range(185, 215), *range(380, 400)}) and got["short"] == list(range(100))


def test_glossary_prompt_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("m", i, t) for i, t in enumerate(["Kafka", "Lakehouse", "x" * 40, "y"])] + [("n", 0, "z" * 99)], "id string, pos int, term string")
    got = {r["id"]: r["prompt"] for r in context.glossary_prompt(df, ["id"], tokens=10).collect()}
    assert got == {"m": "Glossary: Kafka, Lakehouse."}
