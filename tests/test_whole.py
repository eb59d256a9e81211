"""Queries over whole tables against brute force."""

import re
from collections import Counter

import pyarrow.parquet as pq

from tallyfold import functions as X
from tallyfold.plans import registry

SF = "/root/testdata/sf0.001"


def column(table, *names):
    return list(zip(*(pq.read_table(f"{SF}/{table}.parquet").column(n).to_pylist() for n in names), strict=True))


def result(spark, name):
    return [tuple(r) for r in registry()[name][0](spark, SF).collect()]


def test_salient_terms_of_all_languages(spark):
    want = set()
    for i, text in column("documents", "doc_id", "text"):
        weights = Counter()
        for term in re.findall(r"[A-Za-z][A-Za-z0-9-]{2,}", text or ""):
            if term.lower() not in X.STOPWORDS:
                weights[term] += 3 if term[0].isupper() or "-" in term else 1
        want |= {(i, t, w) for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:12]}
    got = result(spark, "salient_terms")
    assert set(got) == want and len(got) == len(want)
    lang = dict(column("documents", "doc_id", "lang"))
    assert {lang[r[0]] for r in got} == set(lang.values()) != {"en"}


def test_neighbourhood_over_all_edges(spark):
    supplier, brand = dict(column("supplier", "s_suppkey", "s_name")), dict(column("part", "p_partkey", "p_brand"))
    near = {}
    for s, p in column("lineitem", "l_suppkey", "l_partkey"):
        near.setdefault(supplier[s], set()).add(brand[p])
        near.setdefault(brand[p], set()).add(supplier[s])
    want = front = {"Brand#11": 0}
    for h in (1, 2):
        front = {y: h for x in front for y in near[x] if y not in want}
        want = want | front
    got = result(spark, "graph_neighbourhood2")
    assert dict(got) == want and len(got) == len(want)


def test_first_names_fold_to_all_known_names(spark):
    part = column("part", "p_name", "p_type")
    known = Counter(n for n, _ in part)
    starts = lambda a, b: (a.lower() + " ").startswith(b.lower() + " ")
    want = {}
    for name in {n.split(" ")[0] for n, _ in part} | {f"{n} {t.lower()}" for n, t in part}:
        longer = [k for k in known if starts(k, name)]
        found = longer + [k for k in known if starts(name, k) and k not in longer]
        one = all(starts(x, y) or starts(y, x) for x in longer for y in longer)
        want[name] = min(found, key=lambda k: (-known[k], k)) if found and one else name
    got = result(spark, "first_name_fold")
    assert dict(got) == want and len(got) == len(want)


def test_normalised_vectors_are_whole(spark):
    vectors = dict(column("embeddings", "vec_id", "embedding"))
    got = {(i, p): x for i, p, x in result(spark, "vector_normalize")}
    want = {(i, p): x / sum(y * y for y in v) ** 0.5 for i, v in vectors.items() for p, x in enumerate(v)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 6e-5 for k in want)
