"""Budgets of characters spent over ranked pieces, and contexts made so: chat history, earlier notes, graph, a question's sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold import functions as X
from tallyfold.operators import asof, retrieval

#: What stands for the context where there is nothing to tell.
NO_PRIOR = "(no earlier minutes on record)"
RULE = "\n\n---\n\n"


def spend(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: Column, budget: int, first: bool = False) -> DataFrame:
    """The rows of each key, in order, up to the first that overflows the budget; with `first` the first row stays whatever its size.

    Sizes aren't negative; a null counts as 0. The order should be total: of ties either may come first.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    used = F.sum(F.coalesce(size, F.lit(0)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("_used") <= budget
    marked = rows.withColumns({"_used": used, "_k": F.row_number().over(w)})
    return marked.where(fits | (F.col("_k") == 1) if first else fits).drop("_used", "_k")


def cut(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str, budget: int, gap: int = 0) -> DataFrame:
    """The rows of each key, in order, until `budget` characters are spent: the last text is shortened, rows after it go.

    `gap` characters are spent between two texts. No text is longer than the budget when rows meet.
    """
    short = rows.withColumn(text, F.substring(F.coalesce(text, F.lit("")), 1, budget))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = short.withColumn("_at", F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0)))
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("_at")).cast("int")
    return placed.where(F.col("_at") - gap < budget).withColumn(text, F.substring(F.col(text), F.lit(1), left)).drop("_at")


def assemble(pieces: DataFrame, keys: Sequence[str], pos: Sequence[str], text: str, budget: int | None = None, between: str = "\n") -> DataFrame:
    """keys, context: the texts of each key in the order of the columns `pos`, joined and cut at the budget."""
    if budget is not None:
        pieces = cut(pieces, keys, [F.col(p) for p in pos], text, budget, len(between))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*pos, F.coalesce(text, F.lit("")).alias("_piece")))), lambda x: x["_piece"])
    joined = F.array_join(listed, between)
    return pieces.groupBy(*keys).agg((joined if budget is None else F.substring(joined, 1, budget)).alias("context"))


def history(turns: DataFrame, last: int = 6, answer_chars: int = 1200, chars: int = 16_000) -> DataFrame:
    """session, turn, question, answer that a prompt still has room for: of the last turns the newest, at least one.

    Long answers are cut and say so. Only the last turns of a session meet: the rank limit works before the shuffle.
    """
    answer = F.coalesce("answer", F.lit(""))
    clamped = F.when(F.length(answer) > answer_chars, F.concat(F.substring(answer, 1, answer_chars), F.lit("... [truncated]"))).otherwise(answer)
    rows = turns.select("session", "turn", F.coalesce("question", F.lit("")).alias("question"), clamped.alias("answer"))
    newest = [F.col("turn").desc()]
    recent = rows.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy(*newest))).where(F.col("_n") <= last).drop("_n")
    return spend(recent, ["session"], newest, F.length("question") + F.length("answer"), chars, first=True)


def retrieval_queries(kept: DataFrame, asked: DataFrame, fold: int = 2) -> DataFrame:
    """session, query of asked (session, question): the last questions of its kept history before it, since a bare follow-up names nothing."""
    ranked = kept.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy(F.col("turn").desc()))).where(F.col("_n") <= fold)
    before = assemble(ranked, ["session"], ["turn"], "question", between=" ")
    return asked.join(before, "session", "left").select("session", F.concat_ws(" ", "context", "question").alias("query"))


def prior_context(probe: DataFrame, corpus: DataFrame, k: int = 3, chars: int = 2500, topical: DataFrame | None = None, topical_chars: int = 4000, none: str = NO_PRIOR) -> DataFrame:
    """id, context of every row of probe (id, meeting_date, meeting_time): the k notes strictly before it, newest first, then what is related.

    corpus: id, meeting_date, meeting_time, title, text, ids unique; one of the k without a text leaves
    no block. topical: id, text. Texts are cut before they travel; a note meets the meetings it precedes only.
    """
    prior = asof.preceding(probe, corpus, k).select("id", F.posexplode("prior").alias("_pos", "_prior"))
    head = F.concat(F.lit("### "), F.coalesce(F.col("meeting_date").cast("string"), F.lit("")), F.lit(" — "), F.coalesce(F.nullif("title", F.lit("")), F.lit("meeting")), F.lit("\n\n"))
    blocks = corpus.where(F.col("text").isNotNull()).select(F.col("id").alias("_prior"), F.concat(head, F.substring("text", 1, chars)).alias("_block"))
    pieces = prior.join(blocks, "_prior").select("id", "_pos", "_block")
    if topical is not None:
        related = topical.withColumn("_said", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")).where("_said <> ''")
        block = F.concat(F.lit("### Topically related earlier material\n\n"), F.substring("_said", 1, topical_chars))
        pieces = pieces.unionByName(related.select("id", F.lit(k).alias("_pos"), block.alias("_block")))
    made = assemble(pieces, ["id"], ["_pos"], "_block", between="\n\n")
    return probe.select("id").join(made, "id", "left").select("id", F.coalesce("context", F.lit(none)).alias("context"))


def around(ways: DataFrame, seeds: DataFrame, depth: int, most: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """seed, node, hops: of each seed (seed, node) the `most` nearest nodes within `depth` undirected steps of ways (src, dst); all seeds go together."""
    both = ways.select("src", "dst").unionByName(ways.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    seen = front = seeds.select("seed", "node", F.lit(0).alias("hops"))
    for h in range(1, depth + 1):
        front = keep(front.join(both, front["node"] == both["src"]).select("seed", F.col("dst").alias("node"), F.lit(h).alias("hops")).distinct())
        seen = seen.unionByName(front)
    nearest = seen.groupBy("seed", "node").agg(F.min("hops").alias("hops"))
    order = Window.partitionBy("seed").orderBy("hops", "node")
    return nearest.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def graph_text(nodes: DataFrame, edges: DataFrame, question: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint(), top: int = 4, depth: int = 2, most: int = 24, chars: int = 6000, stop: Sequence[str] = X.STOPWORDS) -> DataFrame:
    """context: at most one row, what the graph says of the labels that a question names, nearest first, cut at `chars`.

    nodes: name (unique), description; edges: source, predicate, target. A node that several labels
    reach is told once, where the first reaches it, an edge likewise; nodes without a description aren't
    told. The driver sees the `top` labels; no match gives no row. Nodes and edges are made once and kept.
    """
    nodes = keep(nodes.select("name", "description").where("trim(name) <> ''"))
    found = retrieval.match_labels(nodes.select(F.col("name").alias("label")), question, top, stop)
    labels = [r["label"] for r in found.collect()]
    if not labels:
        return nodes.limit(0).select(F.lit("").alias("context"))
    ends = nodes.select("name")
    ways = edges.select(F.col("source").alias("src"), F.coalesce(F.nullif("predicate", F.lit("")), F.lit("relates to")).alias("predicate"), F.col("target").alias("dst"))
    for end in ("src", "dst"):
        ways = ways.join(ends, F.col(end) == F.col("name"), "left_semi")
    ways = keep(ways.distinct())
    seeds = nodes.sparkSession.createDataFrame(list(enumerate(labels)), "seed int, node string")
    near = keep(around(ways, seeds, depth, most, keep))
    at = lambda end: near.select(F.col("seed").alias(f"_s{end}"), F.col("node").alias(f"_{end}"))
    among = ways.join(F.broadcast(at("src")), F.col("src") == F.col("_src")).join(F.broadcast(at("dst")), (F.col("dst") == F.col("_dst")) & (F.col("_ssrc") == F.col("_sdst")))  # top times most rows
    kept = among.groupBy("src", "predicate", "dst").agg(F.min("_ssrc").alias("seed"))
    said = nodes.where("trim(coalesce(description, '')) <> ''").groupBy(F.col("name").alias("node")).agg(F.min(F.trim("description")).alias("_d"))
    first = keep(near.groupBy("node").agg(F.min(F.struct("seed", "hops")).alias("_w")).join(said, "node"))
    blank, zero = F.lit(""), F.lit(0)
    piece = lambda df, section, key, text, seed=zero, hops=zero: df.select(F.lit(section).alias("a"), seed.alias("b"), hops.alias("c"), key.alias("d"), text.alias("text"))
    told = piece(first, 2, F.col("node"), F.concat(F.lit("- **"), "node", F.lit("**: "), "_d"), F.col("_w.seed"), F.col("_w.hops"))
    ties = piece(kept, 4, F.concat_ws("\0", "src", "predicate", "dst"), F.concat_ws(" ", F.lit("-"), "src", "predicate", "dst"), F.col("seed"))
    lines = keep(told.unionByName(ties))
    head = piece(lines.limit(1), 1, blank, F.lit(f"## Knowledge graph (matched: {', '.join(labels)})\n\n### Entities"))
    middle = piece(lines.where("a = 4").limit(1), 3, blank, F.lit("\n### Relationships"))
    pieces = lines.unionByName(head).unionByName(middle).withColumn("_one", F.lit(1))
    return assemble(pieces, ["_one"], ["a", "b", "c", "d"], "text", chars).select("context")


def register_text(rows: DataFrame) -> DataFrame:
    """context: the rows (register, rank, text) of a question as lists under their register's name; no rows, no context."""
    line = F.concat(F.lit("- "), F.coalesce("text", F.lit("")))
    lists = assemble(rows.select("register", "rank", line.alias("_line")), ["register"], ["rank"], "_line")
    titled = lists.select(F.lit(1).alias("_one"), "register", F.concat(F.lit("## "), "register", F.lit("\n"), "context").alias("_list"))
    return assemble(titled, ["_one"], ["register"], "_list", between="\n\n").select("context")


def notes_text(found: DataFrame) -> DataFrame:
    """context: the notes (name, score, text) that a scan found, best first; the newest, which have no score, by name downwards."""
    shown = F.concat(F.lit("## "), "name", F.lit("\n"), "text")
    order = Window.orderBy(F.col("score").desc(), F.when(F.col("score") > 0, F.col("name")).asc_nulls_last(), F.col("name").desc())
    ranked = found.select(F.row_number().over(order).alias("_n"), shown.alias("_note"), F.lit(1).alias("_one"))  # what a scan found is a few rows
    return assemble(ranked, ["_one"], ["_n"], "_note", between=RULE).select(F.concat(F.lit("## Minutes excerpts\n\n"), "context").alias("context"))


def question_context(sections: Sequence[DataFrame]) -> DataFrame:
    """context, chars: one row, the sections (context; one row or none each) in their order; blank ones are left out."""
    out = None
    for i, section in enumerate(sections):
        rows = section.where("trim(context) <> ''").select(F.lit(i).alias("_n"), "context")
        out = rows if out is None else out.unionByName(rows)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "context"))), lambda x: x["context"]), RULE)
    return out.agg(joined.alias("context")).select("context", F.length("context").cast("long").alias("chars"))


def sample(turns: DataFrame, whole: int = 100, opening_sec: float = 240.0, opening: int = 50, around: int = 15, ending: int = 20) -> DataFrame:
    """The turns (id, pos, start, ...) that stand for a long dialogue: its opening, the middle and the end; a short one as a whole.

    The opening is what starts within `opening_sec`, at least `opening` turns; a null start counts as 0.
    """
    w = Window.partitionBy("id")
    early = F.sum((F.coalesce("start", F.lit(0.0)) <= opening_sec).cast("long")).over(w)
    marked = turns.withColumns({"_k": F.row_number().over(w.orderBy("pos")) - 1, "_n": F.count(F.lit(1)).over(w), "_early": early})
    middle = F.floor(F.col("_n") / 2)
    keep = (F.col("_n") <= whole) | (F.col("_k") < F.greatest("_early", F.lit(opening))) | (F.col("_k") >= middle - around) & (F.col("_k") < middle + around) | (F.col("_k") >= F.col("_n") - ending)
    return marked.where(keep).drop("_k", "_n", "_early")


def glossary_prompt(terms: DataFrame, keys: Sequence[str], tokens: int = 224, token_chars: int = 4, prefix: str = "Glossary: ") -> DataFrame:
    """keys, prompt: the terms (keys, pos, term) that a recogniser's prompt has room for, up to the first that overflows; none, no row."""
    cost = F.length(F.coalesce("term", F.lit(""))) + 2
    kept = spend(terms, keys, [F.col("pos")], cost, tokens * token_chars - len(prefix))
    made = assemble(kept, keys, ["pos"], "term", between=", ")
    return made.select(*keys, F.concat(F.lit(prefix), "context", F.lit(".")).alias("prompt"))
