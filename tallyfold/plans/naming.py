"""Queries over names, titles, file names and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import operators as O
from tallyfold import sources as S
from tallyfold.operators import naming as N


def compound_canonicalize(spark, d):
    s, n = S.read(spark, d, "supplier"), S.read(spark, d, "nation")
    aliases = n.where("n_regionkey <> 1").select(F.lower("n_name").alias("alias"), F.concat(F.lit("N-"), "n_name").alias("canonical"))
    mark = F.element_at(F.array(*map(F.lit, (" and ", ", ", " / "))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    named = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat("s_name", mark, "n_name").alias("owner"))
    return N.canonical_compound(named, "s_suppkey", "owner", aliases, "owners")


def first_name_fold(spark, d):
    p = S.read(spark, d, "part")
    names = p.select(F.explode(F.array(F.split("p_name", " ")[0], F.concat_ws(" ", "p_name", F.lower("p_type")))).alias("name"))
    known = p.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("meetings"))
    return N.fold_prefix(names, known)


def title_resolve(spark, d):
    o, k = S.read(spark, d, "orders"), F.col("o_orderkey") % 4
    doc = F.when(k == 0, F.concat(F.lit("---\ntitle: Order "), "o_orderkey", F.lit("\n---\n# Other\n"))).when(k == 1, F.concat(F.lit("# Plan "), "o_orderkey", F.lit("\nbody"))).otherwise("body")
    path = F.when(k == 2, F.concat(F.lit("notes/1995-01-02-big-plan-"), "o_custkey", F.lit("-0a1b2c3d.md"))).otherwise("")
    hint = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return o.select("o_orderkey", N.resolve_title(doc, path, hint).alias("title"))


def filename_parse(spark, d):
    o, k, t = S.read(spark, d, "orders"), F.col("o_orderkey") % 3, F.to_timestamp("o_orderdate")
    name = F.when(k == 0, F.concat(F.date_format(F.add_months(t, 360), "yyyy-MM-dd"), F.lit("T1130_plan_"), "o_orderstatus", F.lit(".m4a")))
    name = name.when(k == 1, F.concat(F.lit("Kim_recording_"), F.date_format(t, "MMM_d"), F.lit("_at_2-45_p.m..m4a"))).otherwise("untitled.wav")
    return N.parse_file_name(o.select("o_orderkey", name.alias("name"), F.year(t).alias("y"), t.alias("t")), "name", F.col("y"), F.col("t")).drop("name", "y", "t")


def frontmatter_edit(spark, d):
    o, k = S.read(spark, d, "orders"), F.col("o_orderkey") % 3
    doc = F.when(k == 0, F.lit("---\ntitle: a\ncategory: old\nx: 1\n---\nbody")).when(k == 1, F.lit("---\ntitle: a\n---\nbody\ncategory: text")).otherwise("body")
    return o.select("o_orderkey", N.set_category(doc, F.col("o_orderpriority")).alias("note"))


def file_backup_plan(spark, d):
    f = S.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(5).alias("mtime"))
    old = f.where("size > 300").select("path", (F.col("size") + F.when(F.col("path") % 3 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("path") % 5 == 0, 4).otherwise(5).alias("mtime"))
    return N.backup_plan(f, old)


def leave_one_out(spark, d):
    got = O.leave_one_out(S.samples(spark, d))
    return got.groupBy("person").agg(F.count(F.lit(1)).alias("tested"), F.count_if("correct").alias("found"))


QUERIES = {
    "compound_canonicalize": (compound_canonicalize, "SELECT s_suppkey, s_name || ' and ' || CASE WHEN n_regionkey <> 1 THEN 'N-' ELSE '' END || n_name AS owners FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "first_name_fold": (first_name_fold, "WITH g AS (SELECT DISTINCT unnest([split_part(p_name, ' ', 1), p_name || ' ' || lower(p_type)]) AS name FROM part), k AS (SELECT p_name AS full_, count(*) AS n FROM part GROUP BY 1), f AS (SELECT name, full_, n, starts_with(full_ || ' ', name || ' ') AS ext FROM g JOIN k ON starts_with(full_ || ' ', name || ' ') OR starts_with(name || ' ', full_ || ' ')), a AS (SELECT DISTINCT x.name FROM f x JOIN f y ON x.name = y.name AND x.ext AND y.ext AND NOT starts_with(x.full_ || ' ', y.full_ || ' ') AND NOT starts_with(y.full_ || ' ', x.full_ || ' ')), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, full_) AS i FROM f WHERE name NOT IN (SELECT name FROM a)) SELECT g.name, coalesce(full_, g.name) AS folded FROM g LEFT JOIN r ON r.name = g.name AND i = 1"),
    "title_resolve": (title_resolve, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Order ' || o_orderkey WHEN 1 THEN 'Plan ' || o_orderkey WHEN 2 THEN 'Big Plan ' || o_custkey ELSE CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'Untitled Meeting' END END AS title FROM orders"),
    "filename_parse": (filename_parse, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR AS DATE) ELSE CAST(o_orderdate AS DATE) END AS file_date, CASE o_orderkey % 3 WHEN 0 THEN '11:30' WHEN 1 THEN '14:45' ELSE strftime(o_orderdate, '%H:%M') END AS file_time, CASE o_orderkey % 3 WHEN 0 THEN 'plan ' || o_orderstatus WHEN 1 THEN 'Kim' ELSE 'untitled' END AS file_hint FROM orders"),
    "frontmatter_edit": (frontmatter_edit, "SELECT o_orderkey, replace(replace(CASE o_orderkey % 3 WHEN 0 THEN '---;title: a;category: ?;x: 1;---;body' WHEN 1 THEN '---;category: ?;title: a;---;body;category: text' ELSE '---;category: ?;---;body' END, ';', chr(10)), '?', o_orderpriority) AS note FROM orders"),
    "file_backup_plan": (file_backup_plan, "SELECT doc_id AS path, CASE WHEN n_chars <= 300 OR doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'copy' ELSE 'keep' END AS action FROM documents"),
    "leave_one_out": (leave_one_out, None),
}
