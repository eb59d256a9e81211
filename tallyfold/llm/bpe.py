"""Operator 3: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last of the prefix's encoding. encode
stores that token for each prefix: a token that ends at byte i is the last one there if and only if
it and the last token of what precedes it stay two tokens when their joined bytes are merged. The
encoding is read off backwards. An encoded text can thus be appended to without encoding it again,
and an edit costs the bytes from the edit on, up to where the stored tokens agree again.

A piece that is a token itself is that token. Pieces are the matches of the split pattern; short
ones are remembered up to a bound.

Defined results: null and empty texts have no tokens and decode to no bytes; repeated rows and null
ids stay as they are; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm.common import Memo, map_texts, table

#: Pieces of up to this many characters are remembered.
SHORT = 48
#: What a worker remembers of pieces, and of pairs of tokens, in bytes (twice that at most), where it
#: has the executor to itself; `share` is the part of it that is taken.
PIECE_BYTES, PAIR_BYTES = 96 << 20, 40 << 20


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Prefixes:
    """The last token of every prefix of one piece; grows and changes in place."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: what is stored for the old prefixes stays as it is."""
        self.data += more
        self.codec.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replaces data[start:end]; returns how many prefixes were computed anew.

        Prefixes before the edit keep their tokens. Behind it, once as many bytes in a row as the
        longest token has agree with the tokens stored before, all later ones agree as well.
        """
        codec, old, tail = self.codec, self.last, self.data[end:]
        self.data = self.data[:start] + new + tail
        self.last, shift = old[:start], len(new) - (end - start)
        agree, done = 0, 0
        for i in range(start, len(self.data)):
            self.last.append(codec.step(self.data, self.last, i))
            done += 1
            j = i - shift
            inside = i >= start + len(new)
            agree = agree + 1 if inside and old[j] == self.last[i] and len(codec.tokens[self.last[i]]) <= i + 1 - start - len(new) else 0
            if agree >= 2 * codec.longest:
                self.last += old[j + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        return self.codec.back(self.last)


class Codec:
    """Encoder and decoder for one table of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        import regex

        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.find = regex.compile(pattern).findall
        self.known = Memo(int(PIECE_BYTES * share), 320)  # piece -> ids
        self.apart = Memo(int(PAIR_BYTES * share), 120)  # (token, token) -> they stay two tokens
        # how each token comes about: a token that merging its own bytes doesn't give back can be no part of a longer piece
        self.halves: dict[int, tuple[int, int] | None] = {}
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.halves[r] = None
            elif (h := self._halves(b, r)) is not None:
                self.halves[r] = h
        #: The lengths, longest first, of the tokens of four bytes or more that end in given four.
        lengths: dict[bytes, set[int]] = {}
        for r in self.halves:
            b = self.tokens[r]
            if len(b) > 3:
                lengths.setdefault(b[-4:], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        ids = max(self.tokens) + 1
        self.flat = [self.tokens.get(r, b"") for r in range(ids)]
        self.decimal = [str(r) for r in range(ids)]

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging of the lowest rank, for the few bytes of one token."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, data: bytes, rank: int) -> tuple[int, int] | None:
        parts = self._merged(data)
        if len(parts) == 2 and self.ranks.get(parts[0] + parts[1]) == rank:
            return self.ranks[parts[0]], self.ranks[parts[1]]
        return None

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the joined bytes of two tokens encode to just these two.

        Both tokens are taken apart in the reverse order of their merges; a merge across the seam
        that would have come earlier than a merge inside means that they don't stay.
        """
        key = a << 20 | b
        got = self.apart.get(key)
        if got is None:
            self.apart.put(key, got := self._apart(a, b))
        return got

    def _apart(self, a: int, b: int) -> bool:
        tokens, halves, ranks = self.tokens, self.halves, self.ranks
        limit = 1 << 60
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < limit:
                return False
            if halves[a] is not None and (halves[b] is None or a > b):
                limit, a = a, halves[a][1]  # of equal ranks the merge inside the left token comes first
            elif halves[b] is not None:
                limit, b = b + 1, halves[b][0]  # of equal ranks the merge across comes first
            else:
                return True

    def step(self, data: bytes | bytearray, last: list[int], i: int) -> int:
        """The last token of the prefix that ends with byte i."""
        ranks, halves, apart, end = self.ranks, self.halves, self.apart.young, i + 1
        more = self.lengths.get(bytes(data[i - 3 : end]), ()) if i > 2 else ()
        for n in (*more, 3, 2):
            if n <= end and (t := ranks.get(bytes(data[end - n : end]))) is not None and t in halves:
                if n == end:
                    return t
                ok = apart.get(last[i - n] << 20 | t)
                if ok or ok is None and self.stay_apart(last[i - n], t):
                    return t
        return ranks[bytes(data[i:end])]

    def extend(self, data: bytes | bytearray, last: list[int]) -> None:
        for i in range(len(last), len(data)):
            last.append(self.step(data, last, i))

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.back(last)

    def back(self, last: list[int]) -> list[int]:
        """The encoding that ends with the last stored token."""
        out, i, tokens = [], len(last), self.tokens
        while i:
            out.append(t := last[i - 1])
            i -= len(tokens[t])
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        young = known.young
        for p in self.find(text):
            ids = young.get(p)
            if ids is None:
                if (ids := known.get(p)) is None:
                    ids = self.piece(p.encode())
                    if len(p) <= SHORT:
                        known.put(p, ids)
                young = known.young
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the tokens."""
        return b"".join(map(self.flat.__getitem__, ids))


_codecs: dict[tuple[str, str, float], Codec] = {}


def codec(path: str, pattern: str, share: float = 1.0) -> Codec:
    if (path, pattern, share) not in _codecs:
        _codecs[path, pattern, share] = Codec(read_ranks(path), pattern, share)
    return _codecs[path, pattern, share]


def _offsets(lists: list[list[int]]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) for every row; one pass, no shuffle."""
    path, pat = ranks or default_ranks(), pattern or default_pattern()

    def make():
        c = codec(path, pat)
        return lambda texts: {"ids": _offsets([c.encode(t) for t in texts])}

    return map_texts(docs, text_col, {"doc_id": f"`{id_col}`"}, "ids array<int>", make)


def decode(encoded: DataFrame, ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """Adds decoded (binary): the bytes of the ids; null ids decode to no bytes."""
    path, pat = ranks or default_ranks(), default_pattern()

    def run(batches):
        c = codec(path, pat)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids_col))
            flat, ends = col.flatten().to_numpy(), np.cumsum([x or 0 for x in col.value_lengths().to_pylist()])
            parts = np.split(flat, ends[:-1]) if len(ends) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.decode(x.tolist()) for x in parts], pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, with_ids: bool = False, share: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encode, decode and digest in one pass of one worker.

    share: the part of PIECE_BYTES and PAIR_BYTES that each worker may remember.
    """
    path, pat = ranks or default_ranks(), pattern or default_pattern()

    def make():
        c = codec(path, pat, share)

        def work(texts: list[str]) -> dict:
            n, a, b, lists = [], [], [], []
            for t in texts:
                ids = c.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b} | ({"ids": _offsets(lists)} if with_ids else {})

        return work

    return map_texts(docs, text_col, {"doc_id": f"`{id_col}`"}, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
