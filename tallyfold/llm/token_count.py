"""Operator 2: token counts by heap-and-linked-list byte-pair merging.

A symbol list starts as the characters of a text (a character outside the vocabulary stands as its
UTF-8 bytes); a heap holds the adjacent pairs whose joined text is a piece, and the pair of the
lowest rank (the leftmost of equals) is popped again and again. The count is the initial symbols
minus the merges. Identifiers are never made.

No piece holds a space mark after another character, so a text falls into segments at those places
and segments are counted on their own; counts of short segments are remembered up to a bound.

Defined results: null and empty texts have no tokens; repeated rows and null ids stay as they are;
texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm.common import Memo, map_texts, table

SPACE = "▁"
OUT = "n_bytes long, n_tokens long, over_limit boolean"
LIMIT = 4096
#: Segments of up to this many characters are remembered.
SHORT = 48
#: What a worker remembers of segments, in bytes (twice that at most).
SEGMENT_BYTES = 64 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(model: str) -> tuple[dict[str, int], bool]:
    """Rank by piece (0 merges first; equal scores share a rank), and whether a space mark leads a text."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    score = {
        library.id_to_piece(i): library.get_score(i)
        for i in range(library.get_piece_size())
        if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
    }
    order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in score):
        raise ValueError("a piece crosses a word boundary: segments can't be counted on their own")
    return {p: order[s] for p, s in score.items()}, library.encode("a", out_type=str)[0].startswith(SPACE)


class Counter:
    """Counts tokens of texts by one vocabulary."""

    def __init__(self, ranks: dict[str, int], lead: bool):
        self.ranks, self.lead = ranks, lead
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known = Memo(SEGMENT_BYTES, 200)

    def merge(self, text: str) -> int:
        """Initial symbols minus merges for one segment."""
        ranks, n = self.ranks, len(text)
        if n == 1:
            return 1 if text in ranks else len(text.encode("utf-8"))
        part = list(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, size = heappop(heap)
            a = part[i]
            j = right[i]
            if not a or j < 0 or len(a) + len(part[j]) != size:
                continue  # one of the two has been merged meanwhile
            part[i] = a = a + part[j]
            part[j] = ""
            merges += 1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get(a + part[k])) is not None:
                    heappush(heap, (r, i, len(a) + len(part[k])))
            if (k := left[i]) >= 0 and (r := ranks.get(part[k] + a)) is not None:
                heappush(heap, (r, k, len(part[k]) + len(a)))
        unknown = sum(len(p.encode("utf-8")) - 1 for p in part if len(p) == 1 and p not in ranks)
        return n + unknown - merges

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, merge, total = self.known, self.merge, 0
        young = known.young
        for s in self.segments((SPACE if self.lead else "") + text.replace(" ", SPACE)):
            n = young.get(s)
            if n is None:
                if (n := known.get(s)) is None:
                    n = merge(s)
                    if len(s) <= SHORT:
                        known.put(s, n)
                young = known.young
            total += n
        return total


_counters: dict[str, Counter] = {}


def counter(model: str) -> Counter:
    if model not in _counters:
        _counters[model] = Counter(*pieces_of(model))
    return _counters[model]


def _worker(model: str, limit: int):
    def make():
        count = counter(model).count

        def work(texts: list[str]) -> dict:
            n = [count(t) for t in texts]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return make


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; one pass, no shuffle."""
    return map_texts(docs, text_col, {"doc_id": f"`{id_col}`"}, OUT, _worker(model or default_model(), limit))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
