import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import bpe, line_dedup, quality

SF = "/root/testdata/sf0.001"


def groups(items, linked):
    """The smallest position that each item is linked to, over all pairs."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if find(i) != find(j) and linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def similar(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and line_dedup.may_be_similar(a, b, most) and line_dedup.edit_distance(a, b, most) <= most


def without_lines(docs):
    places = [(i, k) for i in sorted(docs) for k, x in enumerate(docs[i].split("\n")) if len(x.encode().split()) >= 5]
    norms = [re.sub("[0-9]", "0", b" ".join(docs[i].split("\n")[k].lower().encode().split()).decode()) for i, k in places]
    gone = {places[k] for k, head in enumerate(groups(norms, similar)) if k != head}
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs.items()}
    return {i: t for i, t in left.items() if t == docs[i] or t.strip(" ")}


def without_near(docs):
    ids, shingles = sorted(docs), {}
    for i, t in docs.items():
        w = t.encode().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    heads = groups(ids, lambda a, b: 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]) > 0)
    return {ids[k]: docs[ids[k]] for k, head in enumerate(heads) if k == head}


def without_items(docs, items):
    words = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) if x]
    runs = {tuple(w[k : k + 10]) for w in map(words, items) if w for k in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[k : k + n]) in runs for n in {len(r) for r in runs} for k in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not hit(words(t))}


def test_stages_keep_columns_of_any_name(spark, odd, none):
    """Nulls, repeats and columns that are called like inner ones pass through every stage but the last."""
    names = ("_in", "_text", "score", "n_lines", "_line_t", "row", "gone", "_id", "_t", "component", "kept", "contaminated")
    line = "one line of seven words that repeats"
    extra = spark.createDataFrame([(20, f"{line}\nown words of this text are here", 1, "en"), (21, f"{line}\nquite other words are in that one", 1, "en")], odd.schema)
    for given in (odd.unionByName(extra), none):
        docs = given.withColumn("n_chars", F.length("text").cast("long"))
        for k, name in enumerate(names):
            docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))) if k % 2 else F.lit(k))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "byte_bpe":
                assert out.count() == docs.count()
                continue
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r["_in"] == 0 and r["_line_t"] == 4 and r["_text"] == f"_text-{'x' if r['doc_id'] is None else r['doc_id']}" for r in rows), name
            if name == "line_dedup":
                texts = {r["doc_id"]: r["text"] for r in rows}
                assert not texts or (texts[20].startswith(line) and not texts[21].startswith(line) and texts[1] is None)
            if name != "quality_classifier":
                assert sum(r["doc_id"] is None for r in rows) == docs.where("doc_id IS NULL").count(), name


def test_pipeline_against_brute_force(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = docs.select("doc_id", "text", quality.score_of(model)("text").alias("score")).collect()
    left = {r["doc_id"]: r["text"] or "" for r in scores if r["score"] >= quality.THRESHOLD}
    sizes, texts = [docs.count(), len(left)], [left]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for stage in (without_lines, without_near, lambda x: without_items(x, items)):
        left = stage(left)
        texts.append(left)
        sizes.append(len(left))
    assert sizes[0] > sizes[1] and texts[1] != texts[0] and sizes[3] > sizes[4] > 20, sizes
    codec = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    want = {i: (codec.encode(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
