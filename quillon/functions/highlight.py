"""Snippets: the matched words of a text in marks, everything else escaped for HTML."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"}
_TABLE = str.maketrans(_ESCAPES)
ELLIPSIS = "…"


@dataclass(frozen=True)
class Highlighter:
    """``max_length`` limits a snippet in bytes of the text (0: no limit); a window opens around the first match."""

    pre: str = "<em>"
    post: str = "</em>"
    max_length: int = 160

    def snippet(self, text: str, terms: set[str], analyzer) -> str:
        """The snippet of a text, or "" if none of the (analysed) terms is in it.

        The window and the marked words cut the text into pieces that are plain and marked by turns; a word that
        lies over an edge of the window, or over one that is marked already, is no piece of its own.
        """
        spans = [range(t.start, t.end) for t in analyzer.analyze(text) if t.term in terms] if terms else []
        if not spans:
            return ""
        data = text.encode()
        window = self._window(data, spans[0].start)
        edges = [window.start]
        for span in spans:
            if edges[-1] <= span.start and span.stop <= window.stop:
                edges += [span.start, span.stop]
        edges.append(window.stop)
        pieces = [data[i:j].decode().translate(_TABLE) for i, j in pairwise(edges)]
        pieces[1::2] = [f"{self.pre}{p}{self.post}" for p in pieces[1::2]]
        ends = [ELLIPSIS if cut else "" for cut in (window.start > 0, window.stop < len(data))]
        return "".join(pieces).join(ends)

    def _window(self, data: bytes, first: int) -> range:
        """The bytes to show: a quarter of the length before the first match, as far as the text allows, in whole characters."""
        size, most = len(data), self.max_length
        if most <= 0 or size <= most:
            return range(size)
        start = max(0, min(first - most // 4, size - most))
        # Decoding drops the bytes of a character that was cut: the window takes in all of it.
        before, after = (len(part.decode(errors="ignore").encode()) for part in (data[:start], data[start + most :]))
        return range(before, size - after)

    def column(self, text: Column, terms: list[str], analyzer) -> Column:
        """``snippet`` for a column; meant for the rows of one page, after ranking."""
        wanted = set(terms)

        def batch(texts: pa.Array) -> pa.Array:
            return pa.array(["" if t is None else self.snippet(t, wanted, analyzer) for t in texts.to_pylist()], pa.string())

        return F.arrow_udf(batch, "string")(text)

    def catalyst(self, text: Column, terms: list[str], tokens: Column, gaps: Column, folded: Column) -> Column:
        """A whole text marked inside the JVM, from its raw ``tokens``, the ``gaps`` around them and the ``folded`` terms."""
        escape = self._escape
        pieces = F.transform(
            F.arrays_zip(gaps.alias("g"), F.concat(tokens, F.array(F.lit(""))).alias("t"), F.concat(folded, F.array(F.lit(None).cast("string"))).alias("f")),
            lambda x: F.concat(escape(x["g"]), F.when(x["f"].isin(terms), F.concat(F.lit(self.pre), escape(x["t"]), F.lit(self.post))).otherwise(escape(x["t"]))),
        )
        return F.when(F.exists(folded, lambda t: t.isin(terms)), F.array_join(pieces, "")).otherwise("")

    @staticmethod
    def _escape(text: Column) -> Column:
        for char, entity in _ESCAPES.items():
            text = F.replace(text, F.lit(char), F.lit(entity))
        return text
