"""Splitting oversized articles at natural boundaries, by lexical cohesion.

Between two sentences or lines the words before and after are compared: the cosine of the term counts of a block on
either side. Where this similarity has a valley, the topic changes. Each piece ends at the deepest valley within its
size window, the later of equal ones; the next piece begins with the last terms of the one before. Every boundary of
the window counts that leaves the piece more terms of its own than ``overlap``. Only if there is none, the piece ends at
an earlier one (the first piece has ``overlap`` terms at least, as the next one repeats them). Where a window has no
such boundary either, the piece is cut at the limit.

Defined cases: a null title or body has no terms; an article of up to ``limit`` terms is one piece, one without any
terms is one piece without terms; repeated rows count once; the text is kept whole (the parts after the overlaps
make up the text again).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.analysis import term_count
from quillon.llm.articles import live_articles
from quillon.plans.shipping import ensure_importable

LIMIT, OVERLAP, BLOCK = 400, 40, 60

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
_WORD = rf"[[\p{{L}}\p{{Nd}}]--[{_CJK}]]"
_TOKEN = regex.compile(rf"[{_CJK}]|{_WORD}+(?:['’](?=[\p{{L}}\p{{Nd}}]){_WORD}*)*", regex.V1)
_PARAGRAPH = regex.compile(r"\n\s*\n|\r\n?\s*\r\n?")
_SENTENCE = regex.compile(r"""[.!?…。！？；]+["'”’»)\]）]*(?:\s|$)|[。！？；]|[\r\n]""")

SCHEMA = "doc_id BIGINT, piece INT, n_pieces INT, first_term INT, n_terms INT, overlap INT, text STRING"


@dataclass
class Piece:
    first: int
    end: int
    overlap: int
    text: str


def _cohesion(ids: np.ndarray, cuts: np.ndarray, block: int) -> np.ndarray:
    """Cosine of the term counts of the ``block`` terms before and after each cut."""
    out = np.ones(len(cuts))
    for k, cut in enumerate(cuts):
        left, n = np.unique(ids[max(0, cut - block) : cut], return_counts=True)
        right, m = np.unique(ids[cut : cut + block], return_counts=True)
        _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
        norm = np.sqrt(float((n * n).sum()) * float((m * m).sum()))
        out[k] = float((n[i] * m[j]).sum()) / norm if norm else 0.0
    return out


def _depths(similarity: np.ndarray) -> np.ndarray:
    """Depth of each valley: how far the similarity rises to the nearest peak on either side."""
    left, right = similarity.copy(), similarity.copy()
    for k in range(1, len(similarity)):
        if similarity[k - 1] >= similarity[k]:
            left[k] = left[k - 1]
    for k in range(len(similarity) - 2, -1, -1):
        if similarity[k + 1] >= similarity[k]:
            right[k] = right[k + 1]
    return left + right - 2 * similarity


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[Piece]:
    """The pieces of one text, each of at most ``limit`` terms."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [Piece(0, n, 0, text)]
    vocabulary: dict[str, int] = {}
    ids = np.fromiter((vocabulary.setdefault(text[a:b].lower(), len(vocabulary)) for a, b in spans), dtype=np.int64, count=n)
    strength = np.zeros(n, dtype=np.int8)
    for k in range(1, n):
        gap = text[spans[k - 1][1] : spans[k][0]]
        if len(gap) > 1 or gap in ("\n", "\r", "。", "！", "？", "；"):
            strength[k] = 2 if _PARAGRAPH.search(gap) else 1 if _SENTENCE.search(gap) else 0
    cuts = np.flatnonzero(strength)
    score = _depths(_cohesion(ids, cuts, block)) + 0.1 * (strength[cuts] == 2)
    pieces, start, back = [], 0, 0
    while start < n:
        room = limit - back
        if n - start <= room:
            end = n
        else:
            first_cut, low, high = np.searchsorted(cuts, [max(start + 1, overlap), start + min(overlap + 1, room), start + room + 1])
            if low == high:
                low = first_cut  # only early boundaries, if any
            end = int(cuts[high - 1 - int(np.argmax(score[low:high][::-1]))]) if low < high else start + room
        first = start - back
        begin = 0 if first == 0 else spans[first][0]
        pieces.append(Piece(first, end, back, text[begin : len(text) if end == n else spans[end][0]]))
        start, back = end, min(overlap, end)
    return pieces


def split_articles(articles: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK, oversized_only: bool = False) -> DataFrame:
    """The pieces of every article: ``doc_id, piece, n_pieces, first_term, n_terms, overlap, text``.

    Title and body are one text, with a blank line between. Only oversized articles go through Python, one
    article at a time.
    """
    ensure_importable(articles.sparkSession)
    text = F.coalesce(F.concat_ws("\n\n", "title", "body"), F.lit(""))
    terms = term_count(F.col("title")) + term_count(F.col("body"))
    sized = live_articles(articles, "title", "body").select("doc_id", text.alias("text"), terms.alias("n_terms"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = split_text(whole, limit, overlap, block)
                columns = zip(*((doc, k, len(pieces), p.first, p.end - p.first, p.overlap, p.text) for k, p in enumerate(pieces)))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                names = ("doc_id", "piece", "n_pieces", "first_term", "n_terms", "overlap", "text")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    pieces = sized.where(F.col("n_terms") > limit).select("doc_id", "text").mapInArrow(cut, SCHEMA)
    if oversized_only:
        return pieces
    zero = F.lit(0)
    whole = sized.where(F.col("n_terms") <= limit).select("doc_id", zero.alias("piece"), F.lit(1).alias("n_pieces"), zero.alias("first_term"), "n_terms", zero.alias("overlap"), "text")
    return pieces.unionByName(whole)


def oversized_articles(articles: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` of the articles that have to be split: those that come out in more than one piece."""
    return split_articles(articles, limit, overlap, oversized_only=True).where("piece = 1").select("doc_id")
