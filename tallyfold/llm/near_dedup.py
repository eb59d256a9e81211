"""Operator 7: near-duplicate documents by SuperMinHash, banding, verification and union-find.

SuperMinHash gives every element a random permutation of the signature's places and lowers place
p(j) to j + r; once no place is above the level reached, the rest of all permutations can't lower
any, and the element loop stops early. BANDS bands of ROWS places are buckets; candidate pairs of a
bucket are confirmed on the full shingle sets, and groups are the components of confirmed links.

Texts of one shingle set are one class, found by a digest of the set, before any banding: a group
of copies, however large, is one candidate. A pair at the similarity sought shares no band with a
probability of (1 - 0.8**5)**32 < 4e-6.

Defined results: null texts and texts without words have an empty set and link with nothing (they
stay, as their own component); fewer words than a shingle are one shingle; a null id has a null
component and stays; rows that share an id share their component, and all of them count as kept if
the id is its component; an empty table gives no rows; other columns are ignored.

Before full sets are compared, an odd sketch (bit i: the parity of the elements that fall on i)
rules out pairs for certain: the bits in which two sketches differ are at most the elements in
which the sets differ. No link is lost by it, whatever the sizes.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Scratch, WordHashes, map_texts, mix, prefix_sums, span_hashes, table
from tallyfold.llm.linking import link_buckets

BANDS, ROWS = 32, 5
SHINGLE, SIMILARITY = 2, 80
#: 64-bit words of an odd sketch.
SKETCH = 16
#: Elements that are worked on at a time; bounds the memory of the permutations.
CHUNK = 20_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes; A-Z is lower-cased first."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    starts = np.arange(n)
    return np.unique(span_hashes(prefix_sums(hashes.of(words)), starts, np.minimum(starts + size, len(words))))


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (len(sets), m) as level + fraction; equal places mean agreeing minima."""
    out = np.full((len(sets), m), np.inf)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= CHUNK):
            n += len(sets[end])
            end += 1
        if n > 4 * CHUNK:  # one very large set: in parts, whose minima meet
            for part in np.array_split(sets[at], n // CHUNK):
                _lower(out[at : at + 1], part, np.zeros(len(part), np.int64), m)
        elif n:
            _lower(out[at:end], np.concatenate(sets[at:end]), np.repeat(np.arange(end - at), [len(s) for s in sets[at:end]]), m)
        at = end
    return out


def _lower(out: np.ndarray, x: np.ndarray, owner: np.ndarray, m: int) -> None:
    """Lowers the signatures of owners by elements x, level by level."""
    perm = None
    flat = out.reshape(-1)
    rows = np.arange(len(x))
    kind = np.uint8 if m <= 256 else np.uint16
    for level in range(m):
        if level:
            # an owner whose places are all below this level is done
            going = (out.max(1) >= level)[owner]
            if not going.all():
                if not going.any():
                    return
                x, owner, perm = x[going], owner[going], perm[going]
                rows = rows[: len(x)]
        bits = mix(x + np.uint64(int(_GOLD) * (level + 1) & 0xFFFFFFFFFFFFFFFF))
        fraction = (bits >> np.uint64(24)).astype(np.float64) / float(1 << 40)
        swap = level + ((bits & np.uint64(0xFFFFFF)) * np.uint64(m - level) >> np.uint64(24)).astype(np.int64)
        if perm is None:
            place = swap
            perm = np.broadcast_to(np.arange(m, dtype=kind), (len(x), m)).copy()
            perm[rows, swap] = 0
        else:
            place = perm[rows, swap].astype(np.int64)
            perm[rows, swap] = perm[:, level]
        np.minimum.at(flat, owner * m + place, level + fraction)


def _bands(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket per band; the band's number is part of it."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(signatures), bands)).copy()
    for r in range(rows):
        h = mix(h ^ bits[:, :, r]) + _GOLD
    return h.view(np.int64)


def odd_sketch(elements: np.ndarray) -> np.ndarray:
    """SKETCH words: bit i is the parity of the number of elements that fall on i."""
    bits = np.bincount((elements & np.uint64(SKETCH * 64 - 1)).astype(np.int64), minlength=SKETCH * 64).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), bands (array of bucket), o0 ... (odd sketch)."""

    def make():
        hashes = WordHashes()

        def work(texts: list[str]) -> dict:
            sets = [shingles(t, size, hashes) for t in texts]
            b = _bands(superminhash(sets, bands * rows), bands, rows)
            odd = np.stack([odd_sketch(s) for s in sets]) if sets else np.zeros((0, SKETCH), np.int64)
            return {
                "n_shingles": [len(s) for s in sets],
                "digest": pa.array([hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets], pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(b.ravel())),
                **{f"o{i}": np.ascontiguousarray(odd[:, i]) for i in range(SKETCH)},
            }

        return work

    schema = "n_shingles long, digest binary, bands array<long>, " + ", ".join(f"o{i} long" for i in range(SKETCH))
    return map_texts(docs, text_col, {"doc_id": f"`{id_col}`"}, schema, make)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The id and its full set (array of hashes)."""

    def make():
        hashes = WordHashes()

        def work(texts: list[str]) -> dict:
            sets = [shingles(t, size, hashes).view(np.int64) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            return {"shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))}

        return work

    return map_texts(docs, text_col, {"id": f"`{id_col}`"}, "shingles array<long>", make)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. similarity is in hundredths."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    sig = scratch.keep(signatures(docs, "doc_id", "_text", size, bands, rows), "signatures")
    odd = [f"o{i}" for i in range(SKETCH)]
    named = sig.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    by_class = named.select("doc_id", "n_shingles", "digest").join(classes, "digest")
    reps = scratch.keep(
        named.join(classes.select("digest", F.col("rep").alias("doc_id")), ["doc_id", "digest"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", F.struct("n_shingles", *odd).alias("w")), "reps"
    )
    entries = reps.select("id", F.col("n").alias("p"), F.explode("bands").alias("bucket"))
    leads = entries.groupBy("bucket").agg(F.min(F.struct("id", "p")).alias("l"), F.max("id").alias("hi")).where("l.id <> hi")
    leads = scratch.keep(leads.select("bucket", F.col("l.id").alias("lead"), F.col("l.p").alias("q")), "leads")
    members = scratch.keep(entries.join(leads, "bucket"), "members")
    scratch.release("leads")
    # full sets only of texts that share a bucket with another text
    wanted = scratch.keep(members.select("id").distinct(), "wanted")
    sets = scratch.keep(shingle_sets(docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi"), "doc_id", "_text", size), "sets")
    rounds = count()
    apart = 1 - similarity / 100

    def confirm(pairs: DataFrame) -> DataFrame:
        # pairs and their ids are written first: Spark then knows their size, and leaves the sets where they are if it is small
        k = next(rounds)
        pairs = scratch.keep(pairs, f"pairs{k}")
        needed = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"needed{k}")
        few = sets.join(needed, "id", "left_semi")
        side = lambda x: few.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
        common = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        told = common.select("a", "b", F.expr("1 - common / (total - common)").alias("d"), F.expr(f"100 * common >= {similarity} * (total - common)").alias("ok"))
        # an id that several texts share has several sets: linked if any is, without a distance
        return told.groupBy("a", "b").agg(F.expr("CASE WHEN min(d) = max(d) THEN min(d) END").alias("d"), F.max("ok").alias("ok"))

    # the payload is the size of the set; J >= s/100 means a difference of at most (100 - s) / (100 + s) of both sizes
    differ = " + ".join(f"bit_count(w.{c} ^ v.{c})" for c in odd)
    closer = f"{100 + similarity} * ({differ}) <= {100 - similarity} * (w.n_shingles + v.n_shingles)"
    groups = link_buckets(scratch, members, confirm, apart, f"100 * least(p, q) >= {similarity} * greatest(p, q)", reps.select("id", "w"), closer)
    # a class and its representative are linked as well: copies of one id may differ in text, so classes can share an id
    tied = by_class.where("doc_id <> rep").select("doc_id", "rep").distinct()
    final = (
        tied.select(F.col("doc_id").alias("id"), F.col("rep").alias("with"))
        .unionByName(by_class.where("doc_id = rep").select(F.col("doc_id").alias("id"), F.col("rep").alias("with")).distinct())
        .join(groups.select(F.col("id").alias("with"), "component"), "with", "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("component", "with")).alias("component"))
    )
    rows_ = sig.select("doc_id", "n_shingles")
    return rows_.join(final.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r(id, t) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.t)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM d JOIN (SELECT id, min(t) AS component_id FROM r GROUP BY id) m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
