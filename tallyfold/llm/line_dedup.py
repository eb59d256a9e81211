"""Operator 9: fuzzy line dedup by MinHash bands over words and edit similarity.

Lines are normalised (lower case, digits as 0, white space as one space); of lines with MIN_WORDS
words or more, those with equal normal forms (128 bits of them) are one class. A class has BANDS
keys, each of the ROWS smallest words under as many hash functions, where long words weigh more, as
the common short ones are in most lines. Classes that share a key, whose lengths allow it and which
agree in a third of all smallest words are confirmed by edit similarity of the whole normal forms, and groups are the components of confirmed links: each
class is compared with the smallest of its key first, then with all those of the key that are not in its component yet. Of each group the first
occurrence by (id, line number) stays. `exact` takes other candidates, which lose no link at all:
two forms of a and b characters within k edits share max(a, b) - 1 - 2 k pairs of neighbouring
characters at least, so they share one of the first few of their pairs in any fixed order. That is
for small tables, since many lines have a pair in common.

A SimHash within few bits is no signature for an edit similarity of 0.8: one changed word moves 8 to
23 of 128 bits, too many for pigeonhole blocks. Two lines that share a fraction j of their words
have a key in common with probability 1 - (1 - j**ROWS)**BANDS: 0.985 for j = 2/3, which is one
word in five replaced.

The texts are read twice (places and keys, then normal forms), as arrays over the bytes; what is
shuffled is a few numbers for each line and key, the normal forms of lines that share a key (and some
more, where the filter of WANTED_BITS is full), and, last, the texts once. Forms are compared many pairs
at a time; a key's pairs are not listed, its members meet in blocks of BLOCK, and a pair of several keys is compared in the first of them.

Defined results: null and empty texts have no lines to remove; lines below MIN_WORDS words always
stay; rows that repeat another's id and text are one occurrence (they keep and lose the same
lines); null ids sort first; an empty table gives no rows; other columns are kept, whatever they
are called, but those of the names given as `added`, which are overwritten.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import BASE, Scratch, Words, mix, pieces, prefix_sums, span_hashes, table, task_memory
from tallyfold.llm.linking import components, merged

MIN_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, LONG, RICH = 12, 3, 5, 6
#: Of the BANDS * ROWS smallest words, of which a byte each is kept, two forms that share a key must
#: agree in so many to be compared (a share of common words of a third).
AGREE = 12
#: Bits of the filter for classes that share a key with another.
WANTED_BITS = 1 << 25
#: Keys are dealt over so many parts at least, more if there are more than PART for each.
PARTS, PART = 256, 1 << 20
#: Members of a bucket are compared in blocks of about so many by so many.
BLOCK = 256
#: After so many pairs the components are brought up to date.
TRIED = 1 << 13

_ZERO = bytes.maketrans(b"0123456789", b"0000000000")
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
#: Weights as powers of two, by a word's bytes.
_SHIFT = np.array([0, 0, 0, 0, 1, 2, 3, 4], np.uint64)
_SKETCH = -(-BANDS * ROWS // 8)
_SKETCHES = [f"s{i}" for i in range(_SKETCH)]
_BASE, _OTHER = np.uint64(BASE), np.uint64(0xA0761D6478BD642F)


class Lines:
    """The lines that count of several texts, as arrays.

    text, number: where a line stands; first, count: its words; lh, lg: 128 bits of its normal form.
    """

    def __init__(self, texts: list[str], min_words: int):
        self.words = w = Words([t.lower().encode().translate(_ZERO) for t in texts])
        first = np.flatnonzero(np.diff(w.line, prepend=-1))
        count = np.diff(np.append(first, len(w.line)))
        good = count >= min_words
        self.first, self.count = first[good], count[good]
        self.text = np.searchsorted(w.offset, w.start[self.first], "right") - 1
        self.number = w.line[self.first] - np.searchsorted(w.breaks, w.offset[:-1])[self.text]
        self.lh = span_hashes(prefix_sums(w.hash), self.first, self.first + self.count)

    @cached_property
    def lg(self) -> np.ndarray:
        return span_hashes(prefix_sums(mix(self.words.hash ^ _OTHER)), self.first, self.first + self.count)

    def distinct(self) -> np.ndarray:
        """One line of each class, in order."""
        return np.sort(np.unique(self.lh, return_index=True)[1])

    def chars(self) -> np.ndarray:
        """The length of each normal form in characters."""
        w = self.words
        begins = (w.data > 32) | (w.data < 9) | ((w.data > 13) & (w.data < 32))  # what is no white space
        begins &= (w.data & 0xC0) != 0x80  # and no further byte of a character
        of = np.cumsum(begins, dtype=np.int32)  # what a word ends before is white space
        return (of[w.end[self.first + self.count - 1]] - of[w.start[self.first]] + self.count).astype(np.int64)

    def _inside(self, which: np.ndarray) -> np.ndarray:
        """Which words are in the given lines."""
        edge = np.zeros(len(self.words.hash) + 1, np.int8)
        edge[self.first[which]] += 1
        np.subtract.at(edge, self.first[which] + self.count[which], 1)
        return np.cumsum(edge[:-1], dtype=np.int8) > 0

    def minima(self, which: np.ndarray) -> np.ndarray:
        """(len(which), BANDS * ROWS): the smallest hash of each line's words under as many functions.

        A word counts the more the longer it is: its hashes are divided by its weight. Short words are
        left out of lines with RICH long ones or more, where they are hardly ever the smallest.
        """
        w = self.words
        size = w.end - w.start
        long = size >= LONG
        sums = np.concatenate([[0], np.cumsum(long)])
        n_long = (sums[self.first + self.count] - sums[self.first])[which]
        rich = n_long >= RICH
        mine = self._inside(which[rich]) & long | self._inside(which[~rich])
        hashes, shift = w.hash[mine], _SHIFT[np.minimum(size[mine], len(_SHIFT) - 1)]
        counts = np.where(rich, n_long, self.count[which])
        starts = np.cumsum(counts) - counts
        out = np.empty((len(_SALTS), len(which)), np.uint64)
        if len(which):
            salted = np.empty_like(hashes)
            for salt, least in zip(_SALTS, out, strict=True):
                np.multiply(hashes, salt, out=salted)
                np.right_shift(salted, shift, out=salted)
                np.minimum.reduceat(salted, starts, out=least)
        return out.T

    def key_lists(self) -> pa.Array:
        """The BANDS keys of the first line of each class as bytes, null for the others."""
        at = self.distinct()
        least = self.minima(at).T.reshape(BANDS, ROWS, -1)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
        for r in range(ROWS):
            keys = mix(keys * _BASE + least[:, r])
        has = np.zeros(len(self.first), bool)
        has[at] = True
        ends = np.concatenate([[0], np.cumsum(has) * BANDS * 8]).astype(np.int32)
        valid = pa.py_buffer(np.packbits(has, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(has), [valid, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys.T).tobytes())])

    def sketches(self, which: np.ndarray) -> np.ndarray:
        """_SKETCH longs of each line: a byte of each of its smallest words."""
        out = np.zeros((len(which), 8 * _SKETCH), np.uint8)
        out[:, : BANDS * ROWS] = mix(self.minima(which)) & np.uint64(255)
        return out.view(np.int64)

    def forms(self, which: np.ndarray) -> pa.Array:
        """The normal forms of lines."""
        w = self.words
        mine = self._inside(which)
        start, size = w.start[mine], (w.end - w.start)[mine] + 1  # the byte behind a word becomes the space
        last = np.cumsum(self.count[which]) - 1
        size[last] -= 1
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        out = w.data[np.repeat(start - (to - size), size) + np.arange(total)]
        spaces = np.ones(len(to), bool)
        spaces[last] = False
        out[to[spaces] - 1] = 32
        ends = np.concatenate([[0], to[last]]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())]).cast(pa.string())


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance of whole strings by bit vectors of any length; above `most` it may stop."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(d | plus) & full), plus & d
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (~(d | up) & full), up & d
        if score - (len(b) - 1 - j) > most:
            return most + 1
    return score


def _over(docs: DataFrame, schema: str, min_words: int, make) -> DataFrame:
    """make(Lines, piece of the batch) -> columns, over docs (_id, _t, _text)."""

    def run(batches):
        with task_memory():
            for batch in batches:
                for at, part in pieces(batch.column(batch.schema.get_field_index("_text"))):
                    texts = ["" if t is None else t for t in part.to_pylist()]
                    yield pa.RecordBatch.from_pydict(make(Lines(texts, min_words), batch.slice(at, len(part))))

    return docs.mapInArrow(run, schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def places_of(docs: DataFrame, min_words: int) -> DataFrame:
    """_id, _t, lh, lg (class), line (number), p (characters) of the lines that count, of docs (_id, _t, _text).

    bands: the keys, one after another as bytes, at least once for each class, else null.
    """
    kinds = dict(docs.dtypes)

    def make(lines: Lines, batch: pa.RecordBatch) -> dict:
        at = pa.array(lines.text)
        given = {c: batch.column(batch.schema.get_field_index(c)).take(at) for c in ("_id", "_t")}
        return given | {"lh": _signed(lines.lh), "lg": _signed(lines.lg), "line": lines.number.astype(np.int32), "p": lines.chars().astype(np.int32), "bands": lines.key_lists()}

    return _over(docs, f"_id {kinds['_id']}, _t long, lh long, lg long, line int, p int, bands binary", min_words, make)


def forms_of(docs: DataFrame, min_words: int, wanted: Broadcast | None = None) -> DataFrame:
    """lh, lg (class), norm, s0 ... (sketch); classes may come more than once.

    wanted: a bitmap, if given; what is not in it is left out, what is in it need not be meant.
    """

    def make(lines: Lines, batch: pa.RecordBatch) -> dict:
        which = lines.distinct()
        if wanted is not None:
            at = lines.lh[which] & np.uint64(WANTED_BITS - 1)
            which = which[(np.frombuffer(wanted.value, np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) > 0]
        sketch = lines.sketches(which)
        return {"lh": _signed(lines.lh[which]), "lg": _signed(lines.lg[which]), "norm": lines.forms(which)} | {f"s{i}": np.ascontiguousarray(sketch[:, i]) for i in range(_SKETCH)}

    return _over(docs, "lh long, lg long, norm string, " + ", ".join(f"s{i} long" for i in range(_SKETCH)), min_words, make)


def _bitmap(ids: DataFrame) -> Broadcast:
    """A bit for the low bits of each id: of the same few MB for any table, less selective for larger ones."""
    low = F.col("id").bitwiseAND(F.lit(WANTED_BITS - 1))
    words = ids.groupBy(F.shiftright(low, 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(WANTED_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out.tobytes())


def _dealt(parts: int):
    """part, and the bucket, id, p of the keys that fall on it, as arrays, of rows (lh, p, bands): a few rows instead of one for each key.

    bands: an array of longs, or their bytes.
    """

    def run(batches):
        for batch in _larger(batches):
            bands = batch.column("bands")
            if not pa.types.is_nested(bands.type):
                bands = bands.cast(pa.binary())
                ends = np.frombuffer(bands.buffers()[1], np.int32, len(bands) + 1, 4 * bands.offset)
                size = np.diff(ends) // 8
                bucket = np.frombuffer(bands.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int64)
            else:
                size, bucket = bands.value_lengths().to_numpy(), bands.flatten().to_numpy()
            part = (bucket.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
            which, counts = np.unique(part[order], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = {"bucket": bucket, "id": np.repeat(batch.column("lh").to_numpy(), size), "p": np.repeat(batch.column("p").to_numpy(), size)}
            yield pa.RecordBatch.from_pydict({"part": which.astype(np.int32)} | {c: pa.ListArray.from_arrays(ends, x[order]) for c, x in flat.items()})

    return run


def _shared(batches):
    """bucket, id, p, lead (the smallest id) of the buckets with several ids, each once, of rows in the order of their parts."""

    def members(chunks):
        rows = {c: np.concatenate([chunk[c] for chunk in chunks]) for c in ("bucket", "id", "p")}
        order = np.argsort(rows["bucket"])
        near = np.diff(rows["bucket"][order]) == 0
        order = order[np.append(near, False) | np.append(False, near)]
        order = order[np.lexsort((rows["id"][order], rows["bucket"][order]))]
        bucket, id_, p = (rows[c][order] for c in ("bucket", "id", "p"))
        first = np.append(True, np.diff(bucket) != 0)[: len(order)]
        once = first | np.append(True, np.diff(id_) != 0)[: len(order)]
        bucket, id_, p, first = bucket[once], id_[once], p[once], first[once]
        starts = np.flatnonzero(first)
        size = np.diff(np.append(starts, len(id_)))
        out = np.repeat(size > 1, size)
        return pa.RecordBatch.from_pydict({"bucket": bucket[out], "id": id_[out], "p": p[out], "lead": np.repeat(id_[starts], size)[out]})

    with task_memory():
        held, of = [], None
        for batch in batches:
            part = batch.column("part").to_numpy()
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(part)]
            for at, to in zip(starts, np.append(starts[1:], len(part)), strict=True):
                if held and of != part[at]:
                    yield members(held)
                    held = []
                held.append({c: batch.column(c).slice(at, to - at).flatten().to_numpy() for c in ("bucket", "id", "p")})
                of = part[at]
        if held:
            yield members(held)


def exact_entries(forms: DataFrame, similarity: float) -> DataFrame:
    """lh, p, bands: keys of which two forms within the similarity share one, for certain."""

    def run(batches):
        for batch in batches:
            size, bands = [], []
            for norm in batch.column(1).to_pylist():
                seen: Counter = Counter()
                grams = []
                for g in zip(norm, norm[1:], strict=False):
                    seen[g] += 1
                    grams.append((ord(g[0]) << 42) + (ord(g[1]) << 21) + seen[g])
                # of n - 1 pairs, those of a form within k edits miss 2 k at most
                n = len(norm)
                first = min(len(grams), 2 * int((1 - similarity) / similarity * n + 1) + 1)
                bands.append(_signed(np.sort(mix(np.array(grams, np.uint64)))[:first] if grams else np.zeros(1, np.uint64)))
                size.append(n)
            yield pa.RecordBatch.from_pydict({"lh": batch.column(0), "p": pa.array(size, pa.int32()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return forms.select("lh", "norm").mapInArrow(run, "lh long, p int, bands array<long>")


_GRAM = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_BINS = 2048


def _grams(text: str) -> np.ndarray:
    """How many of the text's runs of three characters fall on each of _BINS."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c[:-2] * _GRAM[0] + c[1:-1] * _GRAM[1] + c[2:] * _GRAM[2]
    return np.bincount(((h ^ (h >> np.uint32(15))) * _GRAM[1]) >> np.uint32(21), minlength=_BINS)


def may_be_similar(a: str, b: str, most: int) -> bool:
    """False only for strings more than `most` edits apart: an edit takes away three runs of three characters at most."""
    n = max(len(a), len(b))
    return min(len(a), len(b)) < 3 or n - 2 <= 3 * most or int(np.minimum(_grams(a), _grams(b)).sum()) >= n - 2 - 3 * most


def is_similar(a: str, b: str, similarity: float) -> bool:
    """Whether the edit distance is at most the share 1 - similarity of the longer string."""
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if _same_places(a, b, most):
        return True
    if not may_be_similar(a, b, most):
        return False
    x, y = a.split(" "), b.split(" ")
    head = 0
    while head < len(x) and head < len(y) and x[head] == y[head]:
        head += 1
    x, y = x[head:], y[head:]
    while x and y and x[-1] == y[-1]:
        x.pop()
        y.pop()
    return edit_distance(" ".join(x), " ".join(y), most) <= most


#: Fewer pairs than this are compared one by one.
TOGETHER = 8
#: So many are compared at once whatever their lengths are.
FEW = 256


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """The texts' characters as small numbers one after another, their lengths, and how many numbers there are."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    number = np.cumsum(seen, dtype=np.int32) - 1
    return number[points], np.array([len(t) for t in texts]), int(seen.sum())


def _grid(codes: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """A row for each text, filled up behind it."""
    out = np.full((len(size), int(size.max(initial=0))), fill, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = codes
    return out


def _within(short: list[str], i: np.ndarray, long: list[str], j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether short[i] and long[j] are at most `most` edits apart, for many pairs at once.

    Pairs that have too few characters in common, wherever they stand, are out. The others go through Myers'
    bit vectors in blocks of 64 rows: block b of all pairs is at column t - b in step t, so that all
    blocks go on at once, and only blocks near the diagonal: beyond it distances are taken from above, by
    steps to the side, which no path within `most` edits takes. No short[i] may be longer than long[j] or
    shorter by more than `most`.
    """
    codes, size, kinds = _codes([*short, *long])
    every = np.bincount(np.repeat(np.arange(len(size)) * kinds, size) + codes, minlength=len(size) * kinds).astype(np.int32).reshape(-1, kinds)
    m, n = size[: len(short)], size[len(short) :]
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 20) // kinds)
    order = np.concatenate([at + np.flatnonzero(n[j[at : at + step]] - np.minimum(every[i[at : at + step]], every[len(m) + j[at : at + step]]).sum(1) <= most[at : at + step]) for at in range(0, len(i), step)])
    if not len(order):
        return out
    order = order[np.argsort(-n[j[order]], kind="stable")]
    i, j, most = i[order], j[order], most[order].astype(np.int64)
    rows, columns, blocks = m[i], n[j], -(-int(m.max()) // 64)
    cut, stride = int(m.sum()), len(m) * kinds
    # eq[block * stride + text * kinds + code]: the places of a code within a block
    eq = np.zeros(blocks * stride, np.uint64)
    place = np.arange(cut) - np.repeat(np.cumsum(m) - m, m)
    np.add.at(eq, (place >> 6) * stride + np.repeat(np.arange(len(m)) * kinds, m) + codes[:cut], np.uint64(1) << (place & 63).astype(np.uint64))
    # the columns from the last to the first, as block b is b columns behind
    text = np.zeros((int(columns[0]) + blocks, len(i)), np.int64)
    text[: int(n.max())] = _grid(codes[cut:], n, 0)[j].T[: len(text)]
    text += i * kinds
    text = text[::-1]
    shift = np.arange(blocks)[:, None] * stride
    plus, minus = np.full((blocks, len(i)), ~np.uint64(0)), np.zeros((blocks, len(i)), np.uint64)
    up, down = np.ones((blocks + 1, len(i)), np.uint64), np.zeros((blocks + 1, len(i)), np.uint64)
    score = np.zeros((blocks, len(i)), np.int64)  # the distance at each block's lower edge
    ok = np.zeros(len(i), bool)
    last = (rows - 1) // 64
    due = columns - 1 + last  # the step that a pair's last cell is in
    ends = {int(t): np.flatnonzero(due == t) for t in np.unique(due)}
    until = np.maximum.accumulate(due[::-1])[::-1]
    one, top = np.uint64(1), np.uint64(63)
    # a path goes to the side and down so many times at most, as the texts' lengths differ
    aside, below = (int((most + d).max()) // 2 for d in (columns - rows, rows - columns))
    live, had = len(i), 0
    for t in range(int(until[0]) + 1):
        while until[live - 1] < t:
            live -= 1
        low, high = max(0, -((63 + aside - t) // 65)), min(blocks, (t + below) // 65 + 1, t + 1)
        if not low or t >= 65 * low + aside:  # nothing is above, or it has ended
            up[low, :live], down[low, :live] = one, 0
        if high > had:
            # before its first column a block's lower edge is 64 more than that of the block above
            score[had, :live] = 64 * (had + 1) if t == had else score[had - 1, :live] + 64 - up[had, :live].view(np.int64) + down[had, :live].view(np.int64)
            had = high
        p, q = plus[low:high, :live], minus[low:high, :live]
        first = len(text) - 1 - t
        e = eq.take(text[first + low : first + high, :live] + shift[low:high])
        v = e | q
        e |= down[low:high, :live]
        h = e & p
        h += p
        h ^= p
        h |= e
        e = h | p
        np.invert(e, out=e)
        e |= q
        h &= p
        up_out, down_out = e >> top, h >> top
        e <<= one
        e |= up[low:high, :live]
        h <<= one
        h |= down[low:high, :live]
        np.bitwise_and(e, v, out=q)
        v |= e
        np.invert(v, out=v)
        np.bitwise_or(v, h, out=p)
        up[low + 1 : high + 1, :live], down[low + 1 : high + 1, :live] = up_out, down_out
        edge = score[low:high, :live]
        edge += up_out.view(np.int64)
        edge -= down_out.view(np.int64)
        if t in ends:
            # from the last row of a text's last block back to that of the text
            done = ends[t]
            b = last[done]
            behind = (rows[done] - 64 * b).astype(np.uint64)
            mask = np.where(behind < 64, ~np.uint64(0) << (behind & top), np.uint64(0))
            value = score[b, done] - np.bitwise_count(plus[b, done] & mask).astype(np.int64) + np.bitwise_count(minus[b, done] & mask)
            ok[done] = value <= most[done]
    out[order] = ok
    return out


def _same_places(a: str, b: str, most: int) -> bool:
    """Whether as many words, those that differ replaced in place, take at most `most` edits: an upper bound of the distance."""
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) and sum([max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w]) <= most


def similar_pairs(texts: list[str], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """is_similar(texts[a], texts[b]) for many pairs; those of like lengths are compared at once."""
    size = np.array([len(t) for t in texts], np.int64)
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    most = ((1 - similarity) * size[b] + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    open_ = np.flatnonzero(size[b] - size[a] <= most)
    out[open_] = [_same_places(texts[x], texts[y], k) for x, y, k in zip(a[open_].tolist(), b[open_].tolist(), most[open_].tolist(), strict=True)]
    open_ = open_[~out[open_] & (size[a[open_]] > 0)]
    open_ = open_[np.lexsort((a[open_], size[b][open_]))]
    long, at = size[b][open_], 0
    while at < len(open_):
        # of a length up to a third more, or three times as long if they are few, so many that their arrays take a few MB
        n = int(long[at])
        like, few = (int(np.searchsorted(long, k, "right")) for k in (n + n // 3 + 16, 3 * n))
        to = min(max(like, min(few, at + FEW)), at + max(TOGETHER, min(2048, (1 << 21) // n)))
        part = open_[at:to]
        at = to
        if len(part) < TOGETHER:
            out[part] = [is_similar(texts[x], texts[y], similarity) for x, y in zip(a[part], b[part], strict=True)]
            continue
        (x, i), (y, j) = (np.unique(side[part], return_inverse=True) for side in (a, b))
        out[part] = _within([texts[k] for k in x], i, [texts[k] for k in y], j, most[part])
    return out


def _larger(batches, size: int = 12 << 20):
    """The same rows in fewer batches, of about `size` bytes or one batch each: the more pairs, the cheaper each."""
    held, bytes_ = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            bytes_ += batch.nbytes
        if bytes_ >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, bytes_ = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _similar(similarity: float):
    """a, b of the rows (a, b, na, nb) whose texts are similar."""

    def run(batches):
        with task_memory():
            for batch in _larger(batches):
                n = batch.num_rows
                ok = similar_pairs(batch.column(2).to_pylist() + batch.column(3).to_pylist(), np.arange(n), np.arange(n, 2 * n), similarity)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _in_blocks(similarity: float, agree: int):
    """a, b of the similar rows of each block; rows come in the order of their blocks.

    A pair is compared if its components differ, its lengths allow a link and its sketches agree. What was
    linked before in the same rows is one component from then on. A pair that shares several buckets is
    compared in the first of them, and not with the bucket's smallest id (lead), as that was done before.
    """

    def links(rows: pa.RecordBatch):
        number = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "lo", "hi", "x", "id", "p", "c", "led")}
        texts = rows.column("norm").to_pylist()
        before = _grid_of(rows.column("before"))
        sketch = np.stack([rows.column(f"s{k}").to_numpy() for k in range(_SKETCH)], 1).view(np.uint8)[:, : BANDS * ROWS] if agree else None
        starts = _starts(number)
        last = np.append(starts[1:], len(texts))[np.cumsum(np.isin(np.arange(len(texts)), starts)) - 1]
        own = np.unique(number["c"], return_inverse=True)[1]
        root, at = np.arange(own.max() + 1), own
        left, right, held = [], [], 0

        def compared():
            nonlocal at
            a, b = np.concatenate(left), np.concatenate(right)
            ok = similar_pairs(texts, a, b, similarity)
            a, b = a[ok], b[ok]
            for x, y in zip(own[a].tolist(), own[b].tolist(), strict=True):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
            while len(a) and (root[root] != root).any():
                root[:] = root[root]
            at = root[own]
            return pa.RecordBatch.from_pydict({"a": number["id"][a], "b": number["id"][b]})

        alive, step = np.arange(len(texts)), 0
        while len(alive):
            step += 1
            alive = alive[alive + step < last[alive]]
            i, j = alive, alive + step
            longest = np.maximum(number["p"][i], number["p"][j])
            fits = (at[i] != at[j]) & ((number["lo"][i] == number["hi"][i]) | (number["x"][i] != number["x"][j])) & number["led"][i] & number["led"][j]
            fits &= np.abs(number["p"][i] - number["p"][j]) <= (1 - similarity) * longest + 1e-9
            i, j = i[fits], j[fits]
            if agree and len(i):
                fits = (sketch[i] == sketch[j]).sum(1) >= agree
                i, j = i[fits], j[fits]
            if before.shape[1] and len(i):
                fits = ~_meet(before, i, j)
                i, j = i[fits], j[fits]
            if len(i):
                left.append(i)
                right.append(j)
                held += len(i)
                if held > TRIED:
                    yield compared()
                    left, right, held = [], [], 0
        if held:
            yield compared()

    def run(batches):
        with task_memory():
            held: list[pa.RecordBatch] = []
            for batch in _larger(batches):
                held.append(batch)
                starts = _starts({c: batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")})
                cut = int(starts[-1])
                if not cut and _same(held[0], batch):
                    continue
                rows = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks().to_batches()
                held = [batch.slice(cut)]
                for part in rows:
                    yield from links(part)
            for part in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
                yield from links(part)

    return run


def _grid_of(lists: pa.Array) -> np.ndarray:
    """A row for each list of longs; behind its end the last is repeated, an empty one has numbers of its own."""
    size = lists.value_lengths().to_numpy()
    out = np.repeat(np.arange(len(size))[:, None], int(size.max(initial=0)), 1)
    flat, ends = lists.flatten().to_numpy(), np.cumsum(size)
    some = np.flatnonzero(size)
    out[some] = flat[(ends - size)[some, None] + np.minimum(np.arange(out.shape[1]), size[some, None] - 1)]
    return out


def _meet(lists: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """Whether rows i and j have a number in common, for many pairs at once."""
    return np.concatenate([(lists[i[at : at + step], :, None] == lists[j[at : at + step], None, :]).any((1, 2)) for at in range(0, len(i), step)])


def _starts(number: dict) -> np.ndarray:
    """Where blocks begin."""
    new = np.ones(len(number["bucket"]), bool)
    new[1:] = np.any([number[c][1:] != number[c][:-1] for c in ("bucket", "lo", "hi")], axis=0)
    return np.flatnonzero(new)


def _same(x: pa.RecordBatch, y: pa.RecordBatch) -> bool:
    return all(x.column(c)[0] == y.column(c)[0] for c in ("bucket", "lo", "hi"))


def _agreeing() -> str:
    """SQL: w and v (structs of longs) agree in AGREE bytes or more."""
    differ = []
    for i in range(_SKETCH):
        x = f"(w.s{i} ^ v.s{i})"
        x = f"({x} | shiftrightunsigned({x}, 4))"
        x = f"({x} | shiftrightunsigned({x}, 2))"
        differ.append(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & 72340172838076673)")
    return f"{' + '.join(differ)} <= {BANDS * ROWS - AGREE}"


def _groups(scratch: Scratch, members: DataFrame, norms: DataFrame, similarity: float, agree: int) -> DataFrame:
    """id, component of the classes that are linked, of members (bucket, id, p, lead) and norms (lh, norm, s0 ...).

    Each member is compared with the smallest of its buckets first. Then all pairs of a bucket that
    are still in different components are compared, in blocks that are spread over tasks: what is
    shuffled is a bucket's members, a few times if they are many, and what comes back the links.
    """
    side = lambda s, w: norms.select(F.col("lh").alias(s), F.col("norm").alias(f"n{s}"), F.struct(*_SKETCHES).alias(w))
    led = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    both = led.join(side("b", "w"), "b").join(side("a", "v"), "a").withColumn("p", F.length("na")).withColumn("q", F.length("nb"))
    close = both.where(_near(similarity)).where(_agreeing() if agree else "true").select("a", "b", "na", "nb")
    found = components(scratch, scratch.keep(close.mapInArrow(_similar(similarity), "a long, b long"), "links"), "cc0_")
    key = Window.partitionBy("bucket")
    named = members.join(found.hint("shuffle_hash"), "id", "left").select("bucket", "id", "p", F.coalesce("component", "id").alias("c"), (F.col("id") != F.col("lead")).alias("led"))
    mixed = named.select("*", F.min("c").over(key).alias("c0"), F.max("c").over(key).alias("c1"), F.count(F.lit(1)).over(key).alias("n")).where("c0 <> c1")
    left = scratch.keep(mixed.select("bucket", "id", "p", "c", "led", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "left")
    # the smaller buckets of each id; an exact table has too many
    smaller = F.collect_list("bucket").over(Window.partitionBy("id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)) if agree else F.expr("CAST(array() AS array<bigint>)")
    dealt = left.withColumn("before", smaller).join(norms.select(F.col("lh").alias("id"), "norm", *_SKETCHES), "id").withColumn("x", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("y", F.explode(F.expr("sequence(0, parts - 1)"))).select("bucket", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "x", "id", "p", "c", "led", "before", "norm", *_SKETCHES)
    blocks = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    links = scratch.keep(blocks.mapInArrow(_in_blocks(similarity, agree), "a long, b long"), "links2")
    return merged(scratch, found, links.distinct(), "2")


def removals(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """_id, _t, gone (array of line numbers) of docs (_id, _t, _text)."""
    # of hashes no dictionary is worth its while
    scratch = Scratch(docs.sparkSession, "lines", compression="snappy", **{f"parquet.enable.dictionary#{c}": "false" for c in ("lh", "lg", "bands", "norm", *_SKETCHES)})
    lines = scratch.keep(places_of(docs, min_words), "lines")
    place = F.struct("_id", "_t", "line")
    once = lambda forms: forms.groupBy("lh").agg(F.min(F.struct("lg", "norm", *_SKETCHES)).alias("f")).select("lh", "f.*")
    if exact:
        norms = scratch.keep(once(forms_of(docs, min_words)), "norms")
        keyed = scratch.keep(exact_entries(norms, similarity), "entries")
    else:
        keyed = lines.where("bands IS NOT NULL").select("lh", "p", "bands")
    # the classes of each key that several have, once, and the smallest of them: one shuffle
    parts = max(PARTS, BANDS * lines.count() // PART)
    dealt = keyed.mapInArrow(_dealt(parts), "part int, bucket array<long>, id array<long>, p array<int>")
    members = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, "bucket long, id long, p int, lead long")
    members = scratch.keep(members, "members")
    scratch.release()
    if not exact:
        norms = scratch.keep(once(forms_of(docs, min_words, _bitmap(members.select("id")))), "norms")
    groups = _groups(scratch, members, norms, similarity, 0 if exact else AGREE)
    # only classes with copies or in a group lose lines; a link holds for the class whose form was compared
    linked = groups.select(F.col("id").alias("lh"), "component").join(norms.select("lh", "lg"), "lh").select("lh", "lg", "component")
    copied = lines.groupBy("lh", "lg").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lh", "lg", F.lit(None).cast("long").alias("component"))
    known = scratch.keep(linked.unionByName(copied).groupBy("lh", "lg").agg(F.max("component").alias("component")), "known")
    group = (F.coalesce("component", "lh").alias("g"), F.when(F.col("component").isNull(), F.col("lg")).alias("h"))
    places = scratch.keep(lines.select("_id", "_t", "line", "lh", "lg").join(known.hint("shuffle_hash"), ["lh", "lg"]).select("_id", "_t", "line", *group), "places")
    heads = places.groupBy("g", "h").agg(F.min(place).alias("head")).select(F.col("g").alias("g_"), F.col("h").alias("h_"), "head")
    # every group has a first occurrence, all others of it go
    others = places.join(heads.hint("shuffle_hash"), (F.col("g") == F.col("g_")) & F.col("h").eqNullSafe(F.col("h_"))).where(~place.eqNullSafe(F.col("head"))).select("_id", "_t", "line")
    # written, so that Spark knows its size when it joins the texts with it: they needn't be shuffled if it is small
    gone = scratch.keep(others.groupBy("_id", "_t").agg(F.collect_set("line").alias("gone")), "gone")
    scratch.release("known", "lines", "places", "norms", "members")
    return gone


def _near(similarity: float) -> str:
    return f"abs(p - q) <= {1 - similarity} * greatest(p, q) + 1e-9"


def without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines of these numbers; as they are where there are none."""
    out = []
    for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        if t is not None and g:
            drop = set(g)
            t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop])
        out.append(t)
    return pa.array(out, pa.string())


def n_lines(text: Column) -> Column:
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, exact: bool = False, added: tuple[str, str] = ("n_lines", "n_removed_lines")
) -> DataFrame:
    """docs with the text without its repeated lines, and the two added columns."""
    # the given row is one column, so that its names meet no inner one
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    id_, text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")
    keyed = rows.withColumn("t", F.xxhash64(text))
    gone = removals(keyed.select(id_.alias("_id"), F.col("t").alias("_t"), text.alias("_text")), min_words, similarity, exact)
    # the side with a row for each text that loses lines is held, so that the texts needn't be sorted
    joined = keyed.join(gone.hint("shuffle_hash"), id_.eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("row", "gone")
    # not to be evaluated again where a caller filters by the text: that would be a second Python worker for each task
    cut = F.arrow_udf(without, "string").asNondeterministic()
    return joined.select(
        # a text that stays as it is doesn't go to Python
        *(F.when(F.col("gone").isNull(), text).otherwise(cut(F.when(F.col("gone").isNotNull(), text), F.col("gone"))).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added),
        n_lines(text).alias(added[0]),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(added[1]),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
