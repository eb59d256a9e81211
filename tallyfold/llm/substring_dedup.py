"""Operator 4: removal of repeated passages by repeated-phrase automata.

1. Every window of WINDOW words is assigned the smallest hash of the K-word phrases in it, its
   anchor; consecutive windows with one anchor are a segment (at most 2 * WINDOW - K words). Equal
   windows have equal anchors at the same place, so only segments whose anchor occurs again can hold
   a repeated window. Segments meet as hashes.
2. The words of one segment of each kind are fetched. Of an anchor with a single kind the whole
   segment is a candidate phrase; of one with several, the runs of windows that the same kinds have
   in common (by hashes of windows).
3. Documents are dealt to parts by the smallest hash of all their phrases, which documents that are
   alike share (of a home with many words by the document as well), and phrases go to the parts in
   which their segments occur. Each part has an Aho-Corasick automaton (pyahocorasick) of its
   phrases, and all of its documents, whole, are streamed past it: words are compared, not hashes,
   and each occurrence is counted.
4. A phrase that is found twice or more is confirmed, and the words of its occurrences are removed.
   One that is found once came from a collision of hashes: it is cut into its windows, a single
   window is dropped, and the documents are streamed again. That is all but never needed.

So no word is removed but by a match of an automaton that the words of another place also gave. A
part's automaton has some PART_WORDS words of phrases, or those of a single document: the number of
parts follows from the words of recurring segments, which are counted.

Defined results: null texts have no words; fewer words than a window are never removed; the words
kept are joined by one space; rows that repeat another's id and text count as occurrences of their
own and get the same result; null ids stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import Scratch, Words, by_text, map_texts_many, pieces, prefix_sums, span_hashes, table

WINDOW, K = 35, 8
#: The words of phrases in the automaton of a part on average (some 300 bytes each).
PART_WORDS = 40_000
#: Homes of many words are broadcast up to so many rows of two numbers, which are counted.
HOT_ROWS = 500_000


def _segments(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """anchor, segment hash, first window, number of windows of each segment of a text (by its words)."""
    n = len(hashes)
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.int32), z.astype(np.int16)
    sums = prefix_sums(hashes)
    at = np.arange(n - k + 1)
    grams = span_hashes(sums, at, at + k)
    least = np.arange(n - window + 1) + np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(starts[1:], len(least))
    return grams[least[starts]].view(np.int64), span_hashes(sums, starts, ends - 1 + window).view(np.int64), starts.astype(np.int32), (ends - starts).astype(np.int16)


def _homes(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of a phrase of each text, and whether the text has a window at all."""
    sizes = np.diff(words.at)
    has, out = sizes >= window, np.zeros(len(sizes), np.int64)
    if has.any():
        sums, at = prefix_sums(words.hash), np.arange(len(words.hash))
        grams = span_hashes(sums, at, np.minimum(at + k, len(at)))
        ends = np.repeat(words.at[1:], sizes)
        grams[at + k > ends] = np.uint64((1 << 64) - 1)  # a phrase that would cross into the next text
        out[has] = np.minimum.reduceat(grams, words.at[:-1][sizes > 0])[has[sizes > 0]].view(np.int64)
    return out, has


def home_of(window: int, k: int):
    """A column function of a text: its home, null for texts without a window."""

    def make():
        def work(texts: list[str]) -> pa.Array:
            out, has = _homes(Words([t.encode() for t in texts]), window, k)
            return pa.array(out, mask=~has)

        return work

    return by_text(make, "long")


def anchored(docs: DataFrame, window: int, k: int) -> DataFrame:
    """_k, home, ah, sh, s, n: the segments of every document (of _k, _text)."""

    def run(batches):
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("_k"))
            for at, part in pieces(batch.column(batch.schema.get_field_index("_text"))):
                words = Words([b"" if t is None else t.encode() for t in part.to_pylist()])
                found = [_segments(words.hash[a:b], window, k) for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
                ah, sh, s, n = (np.concatenate(x) for x in zip(*found, strict=True))
                of = np.repeat(np.arange(len(part)), [len(f[0]) for f in found])
                home = np.repeat(_homes(words, window, k)[0], [len(f[0]) for f in found])
                yield pa.RecordBatch.from_pydict({"_k": key.slice(at, len(part)).take(pa.array(of)), "home": home, "ah": ah, "sh": sh, "s": s, "n": n})

    return docs.select("_k", "_text").mapInArrow(run, "_k long, home long, ah long, sh long, s int, n short")


def _texts(docs: DataFrame, window: int) -> DataFrame:
    """ah, sh, kinds, run: the words of the segments that _want names."""

    def make():
        def work(texts: list[str], batch: pa.RecordBatch) -> tuple:
            want = batch.column(batch.schema.get_field_index("_in_want")).to_pylist()
            out, counts = [], []
            for t, wanted in zip(texts, want, strict=True):
                words = t.encode().split()
                counts.append(len(wanted))
                out += [(x["ah"], x["sh"], x["c"], x["kinds"], b" ".join(words[x["s"] : x["s"] + x["n"] - 1 + window])) for x in wanted]
            ah, sh, c, kinds, run = zip(*out, strict=True) if out else ((),) * 5
            return counts, {"ah": pa.array(ah, pa.int64()), "sh": pa.array(sh, pa.int64()), "c": pa.array(c, pa.int64()), "kinds": pa.array(kinds, pa.int64()), "run": pa.array(run, pa.binary()).cast(pa.string())}

        return work

    return map_texts_many(docs, "_text", {"_in_want": "_want"}, "ah long, sh long, c long, kinds long, run string", make)


def _windows(segments: DataFrame, window: int, bits: int) -> DataFrame:
    """ah, sh, c, at, wh: the windows of every segment, wh of so many bits."""

    def make():
        def work(texts: list[str], _) -> tuple:
            words = Words([t.encode() for t in texts])
            sums = prefix_sums(words.hash)
            counts = np.maximum(np.diff(words.at) - window + 1, 0)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = np.repeat(words.at[:-1], counts) + at
            wh = span_hashes(sums, starts, starts + window) & np.uint64((1 << bits) - 1)
            return counts, {"at": at.astype(np.int32), "wh": wh.view(np.int64)}

        return work

    return map_texts_many(segments, "run", {"ah": "ah", "sh": "sh", "c": "c"}, "at int, wh long", make)


def _phrases(candidates: DataFrame, window: int) -> DataFrame:
    """ah, sh, phrase: the words of the runs of windows (_at: at, sig) with one signature of every segment."""

    def make():
        def work(texts: list[str], batch: pa.RecordBatch) -> tuple:
            counts, out = [], []
            for t, rows in zip(texts, batch.column(batch.schema.get_field_index("_in_at")).to_pylist(), strict=True):
                words, n, first, last, sig = t.split(" "), len(out), None, None, None
                for x in sorted(rows, key=lambda x: x["at"]):
                    if first is None or x["at"] != last + 1 or x["sig"] != sig:
                        if first is not None:
                            out.append(" ".join(words[first : last + window]))
                        first, sig = x["at"], x["sig"]
                    last = x["at"]
                if first is not None:
                    out.append(" ".join(words[first : last + window]))
                counts.append(len(out) - n)
            return counts, {"phrase": pa.array(out, pa.string())}

        return work

    return map_texts_many(candidates, "run", {"ah": "ah", "sh": "sh", "_in_at": "_at"}, "phrase string", make)


#: Words are spelt in letters of so many kinds for each place, so that a node of the trie has few children.
_LETTERS = 64


class Automaton:
    """The Aho-Corasick automaton of phrases over words."""

    def __init__(self, phrases: list[bytes]):
        import ahocorasick

        self.found = [0] * len(phrases)
        split = [p.split(b" ") for p in phrases]
        vocabulary = dict.fromkeys(w for p in split for w in p)
        self.places = 1
        while _LETTERS**self.places < len(vocabulary):
            self.places += 1
        self.spelt = {w: self._spell(i) for i, w in enumerate(vocabulary)}
        self.other = "\0" * self.places  # no phrase has the letter 0
        self.trie = ahocorasick.Automaton()
        for i, p in enumerate(split):
            self.trie.add_word("".join([self.spelt[w] for w in p]), (i, len(p)))
        if phrases:
            self.trie.make_automaton()

    def _spell(self, n: int) -> str:
        out = ""
        for k in range(self.places):
            n, digit = divmod(n, _LETTERS)
            out += chr(1 + k * _LETTERS + digit)
        return out

    def stay(self, words: list[bytes]) -> np.ndarray | None:
        """Which of a document's words no phrase covers; None if nothing was found. Counts what it finds."""
        if not self.found or len(words) < 2:
            return None
        line = "".join([self.spelt.get(w, self.other) for w in words])
        edges = None
        for end, (i, n) in self.trie.iter(line):
            self.found[i] += 1
            if edges is None:
                edges = np.zeros(len(words) + 1, np.int64)
            last = end // self.places + 1
            edges[last - n] += 1
            edges[last] -= 1
        return None if edges is None else np.cumsum(edges[:-1]) == 0


def _stream(batches):
    """Rows sorted by (part, kind): the phrases (kind 0) of a part come before its documents (kind 1).

    Gives kind 1 for a document and, at the end of a part, kind 0 for each phrase and how often it was found.
    """
    part, phrases, automaton = None, [], None

    def told():
        found = automaton.found if automaton else [0] * len(phrases)
        n = len(phrases)
        return pa.RecordBatch.from_pydict({"kind": pa.array([0] * n, pa.int32()), "doc_id": pa.nulls(n, id_type), "n_words": pa.array(found, pa.int64()), "n_removed": pa.nulls(n, pa.int64()), "kept": pa.array(phrases, pa.binary()).cast(pa.string())})

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        rows: list[tuple] = []
        held = 0

        def flush():
            at, n, gone, kept = zip(*rows, strict=True)  # noqa: B023
            return pa.RecordBatch.from_pydict({"kind": pa.array([1] * len(at), pa.int32()), "doc_id": ids.take(pa.array(at)), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})  # noqa: B023

        parts, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(batch.schema.get_field_index("text"))
        for i, (p, kind) in enumerate(zip(parts, kinds, strict=True)):
            text = texts[i].as_py()
            if p != part:
                if phrases:
                    yield told()
                part, phrases, automaton = p, [], None
            if kind == 0:
                phrases.append(text.encode())
                continue
            if automaton is None:
                automaton = Automaton(phrases)
            words = (text or "").encode().split()
            stay = automaton.stay(words)
            left = words if stay is None else [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            rows.append((i, len(words), len(words) - len(left), b" ".join(left)))
            held += len(rows[-1][-1])
            if held > 2 << 20:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()
    if phrases:
        yield told()


def candidates(scratch: Scratch, docs: DataFrame, window: int, k: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Phrases (ah, sh, phrase) of segments that may be repeated, and the recurring segments, of docs (_k, _text)."""
    all_ = scratch.keep(anchored(docs, window, k), "anchored")
    # written before the join, whose sides Spark can then split where an anchor is hot
    again = scratch.keep(all_.groupBy("ah").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("ah"), "again")
    rec = scratch.keep(all_.join(again, "ah"), "recurring")
    scratch.release("anchored", "again")
    kinds = scratch.keep(rec.groupBy("ah", "sh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_k", "s", "n")).alias("r")), "kinds")
    several = scratch.keep(kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")), "several")
    one = F.struct("ah", "sh", "c", "kinds", F.col("r.s").alias("s"), F.col("r.n").alias("n"))
    want = kinds.join(several, "ah").groupBy(F.col("r._k").alias("_k")).agg(F.collect_list(one).alias("_want"))
    want = scratch.keep(want, "want")
    scratch.release("kinds", "several")
    segments = scratch.keep(_texts(docs.join(want, "_k"), window), "segments")
    scratch.release("want")
    alone = segments.where("kinds = 1").select("ah", "sh", F.col("run").alias("phrase"))
    mixed = segments.where("kinds > 1")
    windows = scratch.keep(_windows(mixed, window, bits), "windows")
    # bits of the kinds that have a window: runs of windows end where the kinds change
    twice = windows.groupBy("wh").agg(F.sum("c").alias("c"), F.bit_xor(F.xxhash64("ah", "sh")).alias("sig")).where("c > 1").select("wh", "sig")
    at = windows.join(scratch.keep(twice, "twice"), "wh").groupBy("ah", "sh").agg(F.collect_set(F.struct("at", "sig")).alias("_at"))
    phrases = scratch.keep(alone.unionByName(_phrases(mixed.dropDuplicates(["ah", "sh"]).join(at, ["ah", "sh"]), window)), "phrases")
    scratch.release("windows", "twice", "segments")
    return phrases, rec


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, bits: int = 64, most: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row.

    bits: of the hashes of windows; fewer than 64 are for tests of collisions only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_k", F.xxhash64("doc_id", "_text"))
    phrases, rec = candidates(scratch, rows.select("_k", "_text"), window, k, bits)
    kind = dict(rows.dtypes)["doc_id"]
    # how many parts share the words of recurring segments, and how many sub-parts a home with many of them has
    words_in = F.sum(F.col("n") + window - 1)
    total = rec.agg(words_in).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    hot = scratch.keep(rec.groupBy("home").agg(F.ceil(words_in * 2 / most).cast("int").alias("subs")).where("subs > 1"), "hot")
    if hot.count() <= HOT_ROWS:
        hot = F.broadcast(hot)

    def dealt(df: DataFrame) -> DataFrame:
        sub = F.pmod(F.col("_k"), F.coalesce("subs", F.lit(1)))
        return df.join(hot, "home", "left").withColumn("part", F.pmod(F.xxhash64(F.coalesce("home", "_k"), sub), F.lit(parts)).cast("int"))

    places = scratch.keep(dealt(rec).select("part", "ah", "sh").distinct(), "places")
    docs_ = dealt(rows.withColumn("home", home_of(window, k)(F.col("_text"))))
    right = docs_.select("part", F.lit(1).alias("kind"), "doc_id", F.col("_text").alias("text"))
    scratch.release("recurring")
    tries = 0
    while True:
        routed = scratch.keep(places.join(phrases, ["ah", "sh"]).select("part", "phrase").distinct(), f"routed{tries}")
        scratch.release()
        left = routed.select("part", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"), F.col("phrase").alias("text"))
        both = left.unionByName(right).repartition("part").sortWithinPartitions("part", "kind")
        done = scratch.keep(both.mapInArrow(_stream, f"kind int, doc_id {kind}, n_words long, n_removed long, kept string"), f"done{tries}")
        lone = scratch.keep(done.where("kind = 0").groupBy(F.col("kept").alias("phrase")).agg(F.sum("n_words").alias("n")).where("n < 2").select("phrase"), f"lone{tries}")
        scratch.release(f"routed{tries}")
        if lone.isEmpty():
            return done.where("kind = 1").drop("kind")
        words = F.split("phrase", " ")
        cut = phrases.join(lone, "phrase", "left_semi").withColumn("w", words).where(F.size("w") > window)
        cut = cut.select("ah", "sh", F.explode(F.expr(f"transform(sequence(1, size(w) - {window - 1}), i -> array_join(slice(w, i, {window}), ' '))")).alias("phrase"))
        phrases = scratch.keep(phrases.join(lone, "phrase", "left_anti").unionByName(cut.select("ah", "sh", "phrase")).distinct(), f"phrases{tries}")
        scratch.drop(f"done{tries}")
        tries += 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM x SEMI JOIN r ON x.h = r.h),
e AS (SELECT doc_id, w[p] AS v, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS t FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
