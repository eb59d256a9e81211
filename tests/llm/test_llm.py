import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyfold.llm import bpe, decontaminate, exact_dedup, html_text, line_dedup, linking, near_dedup, quality, substring_dedup, token_count, warc
from tallyfold.llm.common import Scratch


def rows(df):
    return sorted(map(str, df.collect()))


def test_bpe_is_tiktoken_and_round_trips(spark, odd, none):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})
    codec = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice("abcdeiou tñéthe日😀 \n.,1'") for _ in range(rng.randint(0, 80)))
        ids = codec.encode(t)
        assert ids == enc.encode_ordinary(t) and codec.decode(ids) == t.encode()
        data = t.encode()
        p = bpe.Prefixes(codec, data)
        cut = rng.randint(0, len(data))
        q = bpe.Prefixes(codec, data[:cut])
        q.append(data[cut:])
        assert p.last == q.last
        a, b = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        p.replace(a, b, b"new")
        assert p.last == bpe.Prefixes(codec, data[:a] + b"new" + data[b:]).last
    got = bpe.decode(bpe.encode(odd)).collect()
    assert Counter(bytes(r["decoded"]).decode() for r in got) == Counter(r["text"] or "" for r in odd.collect())
    assert bpe.digests(none).count() == 0


def test_token_count_is_sentencepiece(odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.default_model())
    for r in token_count.token_counts(odd.withColumnRenamed("_k", "n_tokens")).collect():
        text = next(x["text"] or "" for x in odd.collect() if x["doc_id"] == r["doc_id"])
        assert r["n_tokens"] == len(sp.encode(text)) and r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 4096)
    count = token_count.counter(token_count.default_model()).count
    rng = random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice("abcdeiou  tñéthe日😀\x00\n▁") for _ in range(rng.randint(0, 60)))
        assert count(t) == len(sp.encode(t))
    assert token_count.token_counts(none).count() == 0


def test_exact_dedup(spark, odd, none):
    out = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_dedup(odd).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[1, empty]["keep_id"] == 2 and not out[1, empty]["kept"] and out[2, empty]["kept"] and out[1, empty]["group_size"] == 2
    df = spark.createDataFrame([(1, "Ab É"), (7, "aB É"), (9, "ab é")], "doc_id long, text string")
    assert rows(exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size")) == ["Row(doc_id=1, keep_id=7, group_size=2)", "Row(doc_id=7, keep_id=7, group_size=2)", "Row(doc_id=9, keep_id=9, group_size=1)"]
    assert exact_dedup.exact_dedup(odd).count() == odd.count() and exact_dedup.exact_dedup(none).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200
    data = [(3, "u\r\nv", big), (1, None, big), (2, "a", None), (4, "a", "short"), (5, "a", "short"), (None, "n", "é" * 99)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    base = Scratch(spark, "t").path
    manifest = warc.write_warc(pages, base, roll_bytes=300)
    out = {r["page_id"]: r for r in warc.read_warc(spark, base).collect()}
    assert manifest.agg({"records": "sum"}).first()[0] == len(data) == len(out)
    assert (out[3]["record_type"], out[3]["refers_to"], out[1]["record_type"], out[1]["refers_to"]) == ("revisit", 1, "response", None)
    assert out[2]["payload_bytes"] == 0 and out[5]["record_type"] == "response" and out[None]["payload_bytes"] == 198
    again = warc.write_warc(pages.repartition(3), base2 := Scratch(spark, "t").path, roll_bytes=300)
    assert sorted(r["sha256"] for r in manifest.collect()) == sorted(r["sha256"] for r in again.collect()) and base2 != base
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0), b := Scratch(spark, "t").path) and b).count() == 0


def test_warc_is_the_same_from_any_partitions(spark):
    rng = random.Random(9)
    data = [(rng.choice((rng.randint(0, 10**6), rng.randint(0, 50), 7, 2**62, None)), f"u{i}", "x" * rng.randint(0, 300) + str(rng.randint(0, 400)), 1, "s") for i in range(4000)]
    data += data[:50]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, digest int, shard string")

    def written(df):
        base = Scratch(spark, "t").path
        manifest = warc.write_warc(df, base, roll_bytes=20_000, shard_bytes=100_000).collect()
        return base, sorted((r["file"], r["records"], r["bytes"], r["sha256"]) for r in manifest)

    base, one = written(pages)
    assert len({f.split("-")[1] for f, *_ in one}) > 5 and one == written(pages.repartition(7))[1] == written(pages.orderBy("html"))[1]
    rows_ = warc.read_warc(spark, base)
    assert rows_.count() == len(data) and sum(x[1] for x in one) == len(data)
    got = Counter((r["page_id"], r["payload_digest"]) for r in rows_.collect())
    assert got == Counter((p, hashlib.sha256(h.encode()).hexdigest()) for p, _, h, *_ in data)
    responses = Counter(r["payload_digest"] for r in rows_.where("record_type = 'response' AND payload_bytes >= 100 AND page_id IS NOT NULL").collect())
    assert max(responses.values()) == 1


def brute_windows(texts, w):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for x in words:
        gone = {i + j for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for j in range(w)}
        out.append((len(gone), b" ".join(v for i, v in enumerate(x) if i not in gone).decode()))
    return out


def test_substring_against_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(40):
        t = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 120))]
        a = rng.randint(0, 30)
        t[5:5] = passage[a : a + rng.randint(5, 60)] * rng.choice([0, 1, 1, 2])
        texts.append(" ".join(t))
    texts += [texts[0], None, "", "same " * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_windows(texts, 35)
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.remove_passages(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert substring_dedup.remove_passages(odd).count() == odd.count() and substring_dedup.remove_passages(none).count() == 0


def test_substring_with_colliding_hashes_and_many_parts(spark):
    """Hashes of 4 bits make nearly every window a candidate; only what the automata find twice goes."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for k in range(24):
        t = [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(36, 90))]
        a = rng.randint(0, 14)
        t[4:4] = passage[a : a + 36] * rng.choice([0, 1, 2])
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_windows(texts, 35)
    assert any(n for n, _ in want) and any(not n for n, _ in want)
    for options in ({"bits": 4}, {"most": 60}):
        got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.remove_passages(df, **options).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_automaton():
    rng = random.Random(8)
    words = [f"v{i}".encode() for i in range(5000)]
    phrases = [b" ".join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(3000)]
    automaton = substring_dedup.Automaton(phrases)
    line = [b"x", *phrases[7].split(b" "), b"y", *phrases[9].split(b" ")]
    assert automaton.stay(line).tolist() == [True, *[False] * len(phrases[7].split(b" ")), True, *[False] * len(phrases[9].split(b" "))]
    assert automaton.found[7] == 1 and sum(automaton.found) >= 2
    assert substring_dedup.Automaton([]).stay(line) is None  # without phrases nothing goes


def test_quality(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    out = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(out[r["doc_id"]]["score"] >= 0.7, r["quality"] == 1) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect())
    assert {round(r["score"], 6) for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.7} and quality.score(none, model).count() == 0


def test_decontaminate_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three"), (2, " ".join(f"w{i}" for i in range(100, 130))), (3, None), (4, ""), (None, "x")], "item_id long, text string")
    out = decontaminate.decontaminate(odd.unionByName(spark.createDataFrame([(9, "ONE two, three!", 1, "")], odd.schema)), items)
    got = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    assert out.count() == odd.count() + 1
    assert (got[4, 9000]["n_hit"], got[4, 9000]["n_items"]) == (30, 1) and got[9, 3]["n_hit"] == 3
    assert got[3, 1]["n_hit"] == 0 and got[9, 3]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert decontaminate.decontaminate(none, items).count() == 0 and not decontaminate.decontaminate(odd, items.limit(0)).where("contaminated").count()


def test_near_dedup_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(60)] for _ in range(6)]
    texts = []
    for k in range(120):
        t = list(base[k % 6])
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = "z" + str(rng.randint(0, 99))
        texts.append(" ".join(t))
    sets = [frozenset(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    out = near_dedup.near_dedup(odd)
    assert out.count() == odd.count() and near_dedup.near_dedup(none).count() == 0
    assert {r["component_id"] for r in out.collect() if r["doc_id"] in (4, 5)} == {4}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (150, 200)], "a long, b long")
    got = {r["id"]: r["component"] for r in linking.components(Scratch(spark, "t"), links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 150: 100, 200: 100}


def test_signature_agreement_is_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    s = near_dedup.superminhash([x[:250], x[50:]], 200)
    assert abs((s[0] == s[1]).mean() - 200 / 300) < 0.1
    assert (near_dedup.superminhash([x[:3]], 64) < 64).all()


def test_lines(spark, odd, none):
    line = "this is a long line that many documents share with each other and which says very little about them indeed"
    df = spark.createDataFrame([(1, f"first\n{line}"), (2, f"{line.upper()}\nsecond own words here now"), (3, None), (4, "a b\na b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (f"first\n{line}", 0), 2: ("second own words here now", 1), 3: (None, 0), 4: ("a b\na b", 0)}
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and line_dedup.dedup_lines(none).count() == 0 and "_k" in out.columns
    assert line_dedup.edit_distance("kitten", "sitting", 9) == 3


def test_html():
    tree = html_text.grow(html_text.LABELLED)
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy this now please.</div><article><h1>T &amp; U</h1><p>one<br>two  <b>three</b><p>x</article><div class=comments><p>I liked it</p></div><footer>&copy; me</footer>"
    assert html_text.main_text(page, tree) == "T & U\n\none two three\n\nx"
    for broken in ("", "<", "<p", "<p><b>x", "</p></p>x", "<script>", "a<!--", "<a href='"):
        html_text.main_text(broken, tree)


LAYOUT = """<html><head><title>x</title></head><body><nav><a href=1>Home</a><div><a href=2>News</a></div></nav>{open}
<h1>A heading of some words</h1><p>First paragraph of the article with a <a href=3>link</a> and several words in it, so that it is long.</p>
<p>Short one.</p><ul><li>an item of a list in the article</li></ul><p>Last paragraph of the article, as long as the first and rather longer than that.</p>{close}
<div class="comments"><p>I think that this is a very good article, and long words of praise are due to its author.</p></div>
<aside><p>Other articles that you may want to read one day, or rather not.</p></aside><div class="cookie-notice">We use cookies on this page.</div>
<form><p>Subscribe to our letters here</p><input></form><footer>Imprint and so on</footer></body></html>"""


def test_html_layouts():
    tree = html_text.grow(html_text.LABELLED)
    want = ["A heading of some words", "First paragraph of the article with a link and several words in it, so that it is long.", "Short one.", "an item of a list in the article", "Last paragraph of the article, as long as the first and rather longer than that."]
    for tag in ("article", "main", 'div class="post-content"', 'div id="story"', 'div role="main"'):
        page = LAYOUT.format(open=f"<{tag}>", close=f"</{tag.split()[0]}>")
        assert html_text.main_text(page, tree).split("\n\n") == want, tag


def test_html_tree_does_without_markup():
    """With class names and elements that say what is main text taken away, block features decide alike."""
    import pandas as pd

    tree = html_text.grow(html_text.LABELLED)
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    same = n = 0
    for page in pages.html:
        for x in html_text.features(html_text.blocks_of(page)):
            same += html_text.predict(tree, x) == html_text.predict(tree, (*x[:7], 0, 0.0))
            n += 1
    assert n > 3000 and same >= 0.95 * n
    assert not isinstance(tree, int) and tree[0] not in html_text.MINOR


def test_html_hostile_pages_are_linear():
    import time

    tree = html_text.grow(html_text.LABELLED)
    start = time.time()
    for bad in ("<a " * 300000, "<" * 300000, "<div>" * 100000 + "</p>" * 100000, '<a "' * 200000, "<svg>" * 100000, "<!--" * 100000, "<![CDATA[" * 100000, "<b>" * 100000 + "</i>" * 100000):
        html_text.main_text(bad, tree)
    assert time.time() - start < 8


def test_html_table(spark):
    page = LAYOUT.format(open="<article>", close="</article>")
    schema = "page_id long, url string, html string, text int, _text int, n_chars int"
    rows_ = [(1, "u", page, 1, 1, 1), (1, "u", page, 1, 1, 1), (2, None, None, 1, 1, 1), (3, "v", "", 1, 1, 1), (None, "w", "<p>" + "long words here " * 20000, 1, 1, 1)]
    out = html_text.extract(spark.createDataFrame(rows_, schema)).collect()
    assert out[0] == out[1] and out[0]["n_chars"] == len(out[0]["text"]) > 200
    assert [(r["text"], r["n_chars"]) for r in out[2:4]] == [("", 0), ("", 0)] and out[4]["n_chars"] > 300000
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) < docs.count() and len({r["doc_id"] for r in out}) == len(out)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
