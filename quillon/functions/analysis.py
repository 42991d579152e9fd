"""The standard analyzer as Column expressions.

A word is a maximal run of letters and decimal digits; every Han, Hiragana or Katakana character is a word of
its own; an apostrophe stays inside a word when a word character follows. Words are folded from full-width
ASCII and lower-cased. Everything here is built from Spark functions, so it stays inside the JVM.
"""

from __future__ import annotations

import functools
import math
import zlib
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_WORD = rf"[\p{{L}}\p{{Nd}}&&[^{CJK}]]"
# Possessive repeats: the same matches, without a stack frame for each apostrophe of a very long word.
TOKEN_PATTERN = rf"[{CJK}]|{_WORD}++(?:['’](?=[\p{{L}}\p{{Nd}}]){_WORD}*+)*+"

_FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F)))

# The English stop words of the standard analyzer.
STOP_WORDS: tuple[str, ...] = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being
    below between both but by can can't cannot could couldn't did didn't do does doesn't doing don't
    down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
    her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it
    it's its itself just let's me more most mustn't my myself no nor not of off on once only or other
    ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some
    such than that that's the their theirs them themselves then there there's these they they'd they'll
    they're they've this those through to too under until up very was wasn't we we'd we'll we're we've
    were weren't what what's when when's where where's which while who who's whom why why's will with
    won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
    """.split()
)


def _literal(text: str) -> Column:
    return F.lit(text)


def raw_tokens(text: Column) -> Column:
    """Words as written, in order; an empty array for null or empty text."""
    return F.coalesce(F.regexp_extract_all(text, _literal(TOKEN_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def gaps(text: Column) -> Column:
    """What stands before, between and after the words: always one more than there are words."""
    return F.split(text, TOKEN_PATTERN, -1)


def fold(token: Column) -> Column:
    """Full-width ASCII to ASCII, typographic apostrophe to ', lower case rune by rune."""
    plain = F.translate(token, _FULL_WIDTH + "’Σİ", _ASCII + "'σi")
    return F.lower(plain)


_WIDE_WORD = "".join(c for c in _FULL_WIDTH if c.isalnum())
_NARROW_WORD = "".join(a for w, a in zip(_FULL_WIDTH, _ASCII) if w.isalnum())


def terms(text: Column) -> Column:
    """All terms of a text in order (no stop words, minimum length 1).

    The text is folded as a whole before its words are taken, which gives the same words: folding turns letters
    into letters, and only those full-width signs that are letters or digits are folded here.
    """
    return raw_tokens(F.lower(F.translate(text, _WIDE_WORD + "’Σİ", _NARROW_WORD + "'σi")))


def term_count(text: Column) -> Column:
    """Number of terms; 0 for null."""
    return F.coalesce(F.regexp_count(text, _literal(TOKEN_PATTERN)), F.lit(0))


_PY_WORD = rf"[[\p{{L}}\p{{Nd}}]--[{CJK.replace('Is', '')}]]"
_PY_TOKEN = regex.compile(rf"[{CJK.replace('Is', '')}]|{_PY_WORD}+(?:['’](?=[\p{{L}}\p{{Nd}}]){_PY_WORD}*)*", regex.V1)
_PY_CJK = regex.compile(rf"[{CJK.replace('Is', '')}]")
_PY_FOLD = {**{ord(w): a for w, a in zip(_FULL_WIDTH, _ASCII)}, ord("’"): "'", ord("Σ"): "σ", ord("İ"): "i"}
TOKEN_TYPE = "array<struct<term: string, pos: int>>"
OFFSET_TYPE = "array<struct<term: string, pos: int, start: int, end: int>>"


def fold_text(token: str) -> str:
    """``fold`` for a Python string."""
    return token.translate(_PY_FOLD).lower()


@dataclass(frozen=True)
class Token:
    term: str
    pos: int
    start: int
    end: int


@dataclass(frozen=True)
class StandardAnalyzer:
    """Text to positioned terms. Dropped words still take a position; CJK characters are never dropped."""

    min_length: int = 2
    stop_words: tuple[str, ...] = STOP_WORDS

    @property
    def fingerprint(self) -> str:
        return f"standard/{self.min_length}/{zlib.crc32(' '.join(sorted(self._stop)).encode()):08x}"

    @functools.cached_property
    def _stop(self) -> set[str]:
        return {fold_text(w.strip()) for w in self.stop_words if w.strip()}

    def analyze(self, text: str) -> list[Token]:
        """The terms of a Python string with byte offsets into its UTF-8 form; the same rules as ``tokens``."""
        stop, found, at, byte = self._stop, [], 0, 0
        for pos, m in enumerate(_PY_TOKEN.finditer(text)):
            byte += len(text[at : m.start()].encode())
            size = len(m.group().encode())
            term = fold_text(m.group())
            if _PY_CJK.fullmatch(m.group()) or (len(term) >= self.min_length and term not in stop):
                found.append(Token(term, pos, byte, byte + size))
            at, byte = m.end(), byte + size
        return found

    def _kept(self, term: Column) -> Column:
        stop = sorted(self._stop)
        long = F.lit(True) if not stop else ~term.isin(stop)
        return F.when(F.char_length(term) >= self.min_length, long).otherwise(term.rlike(f"^[{CJK}]$"))

    def tokens(self, text: Column) -> Column:
        """``array<struct<term, pos>>`` of the kept terms; null for null."""
        numbered = F.transform(terms(text), lambda t, i: F.struct(t.alias("term"), i.cast("int").alias("pos")))
        return F.when(text.isNotNull(), F.filter(numbered, lambda x: self._kept(x["term"])))

    def offsets(self, text: Column) -> Column:
        """``tokens`` with the byte range of each term in the text."""
        sizes = F.arrays_zip(
            F.transform(gaps(text), lambda g: F.octet_length(g)).alias("gap"),
            F.concat(F.transform(raw_tokens(text), lambda t: F.octet_length(t)), F.array(F.lit(0))).alias("size"),
        )
        start = F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts")),
            lambda acc: acc["starts"],
        )
        rows = F.arrays_zip(terms(text).alias("term"), F.transform(raw_tokens(text), lambda t: F.octet_length(t)).alias("size"), F.slice(start, F.lit(1), F.size(raw_tokens(text))).alias("start"))
        numbered = F.transform(rows, lambda x, i: F.struct(x["term"].alias("term"), i.cast("int").alias("pos"), x["start"].alias("start"), (x["start"] + x["size"]).alias("end")))
        return F.when(text.isNotNull(), F.filter(numbered, lambda x: self._kept(x["term"])))


#: Every term counts: no stop words, minimum length 1.
KEEP_ALL = StandardAnalyzer(min_length=1, stop_words=())


def keyword_term(value: Column) -> Column:
    """The one term of a keyword value; null for a blank one."""
    plain = F.lower(F.translate(F.regexp_replace(value, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""), "Σİ", "σi"))
    return F.when(plain != "", plain)


def keyword_tokens(value: Column) -> Column:
    """A keyword value in the form of ``tokens``: its term at position 0, or no term."""
    one = F.transform(F.array_compact(F.array(keyword_term(value))), lambda t: F.struct(t.alias("term"), F.lit(0).alias("pos")))
    return F.when(value.isNotNull(), one)


@dataclass(frozen=True)
class ChineseAnalyzer:
    """Segmentation of Han text with a dictionary; all other text as by the standard analyzer.

    The dictionary is given (lines of ``word`` or ``word frequency``, ``#`` starts a comment): the segmentation of
    the highest word frequency is chosen. A word of three or more characters is followed by the dictionary words
    inside it, at the same position, unless ``sub_words`` is off. The dictionary is part of the function that
    executors receive; it has the size of its text.
    """

    words: tuple[tuple[str, int], ...]
    sub_words: bool = True
    min_length: int = 2
    stop_words: tuple[str, ...] = STOP_WORDS

    @classmethod
    def from_text(cls, text: str, **options) -> ChineseAnalyzer:
        entries = []
        for line in text.splitlines():
            parts = line.split("#")[0].split()
            if parts:
                entries.append((parts[0], int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 100))
        return cls(tuple(entries), **options)

    @property
    def fingerprint(self) -> str:
        return f"chinese/{self.sub_words}/{self.min_length}/{zlib.crc32(repr((self.words, sorted(self.stop_words))).encode()):08x}"

    def _segment(self, run: str, weights: dict[str, float], longest: int) -> list[str]:
        """The most probable way to cut a run of Han characters into words, by dynamic programming from its end."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            options = [(weights.get(run[i : i + 1], -20.0) + best[i + 1][0], i + 1)]
            options += [(weights[run[i:j]] + best[j][0], j) for j in range(i + 2, min(n, i + longest) + 1) if run[i:j] in weights]
            best[i] = max(options)
        out, i = [], 0
        while i < n:
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    @functools.cached_property
    def _prepared(self) -> tuple[dict[str, float], int, StandardAnalyzer]:
        """Log frequencies of the words, the length of the longest, and the analyzer of all other text; made once."""
        total = sum(n for _, n in self.words) or 1
        weights = {w: math.log(n / total) for w, n in self.words if n > 0}
        return weights, max(map(len, weights), default=1), StandardAnalyzer(self.min_length, self.stop_words)

    def analyze(self, text: str) -> list[Token]:
        weights, longest, standard = self._prepared
        stop, found, pos, byte = standard._stop, [], 0, 0
        for piece in regex.findall(r"\p{Han}+|\P{Han}+", text):
            size = len(piece.encode())
            if not regex.match(r"\p{Han}", piece):
                raw = StandardAnalyzer(1, ()).analyze(piece)
                kept = {t.pos for t in standard.analyze(piece)}
                found += [Token(t.term, pos + t.pos, byte + t.start, byte + t.end) for t in raw if t.pos in kept]
                pos += len(raw)
            else:
                at = byte
                for word in self._segment(piece, weights, longest):
                    inner = [word]
                    if self.sub_words and len(word) >= 3:
                        inner += [word[i:j] for i in range(len(word)) for j in range(i + 2, len(word) + 1) if word[i:j] in weights and word[i:j] != word]
                    for sub in dict.fromkeys(inner):
                        if len(sub) >= self.min_length and sub not in stop:
                            start = at + len(word[: word.index(sub)].encode())
                            found.append(Token(sub, pos, start, start + len(sub.encode())))
                    at += len(word.encode())
                    pos += 1
            byte += size
        return found

    def tokens(self, text: Column) -> Column:
        def batch(texts: pa.Array) -> pa.Array:
            rows = [None if t is None else [{"term": x.term, "pos": x.pos} for x in self.analyze(t)] for t in texts.to_pylist()]
            return pa.array(rows, pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())])))

        return F.arrow_udf(batch, TOKEN_TYPE)(text)

    def offsets(self, text: Column) -> Column:
        def batch(texts: pa.Array) -> pa.Array:
            rows = [None if t is None else [vars_of(x) for x in self.analyze(t)] for t in texts.to_pylist()]
            kind = pa.struct([("term", pa.string()), ("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
            return pa.array(rows, pa.list_(kind))

        return F.arrow_udf(batch, OFFSET_TYPE)(text)


def vars_of(token: Token) -> dict:
    return {"term": token.term, "pos": token.pos, "start": token.start, "end": token.end}
