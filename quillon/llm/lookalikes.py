"""Bringing text that looks the same to one form.

The words of a collection are its vocabulary. A word that is written in plain characters of one alphabet is a
canonical spelling. Any other word is matched against the canonical spellings: a weighted edit automaton reads its
characters as they are and walks the trie of the spellings, where arcs of look-alike characters, presentation forms and
ignorable characters cost nothing and all else costs 1; within a budget of 0 it reaches just the spellings that look
the same. One in ASCII is chosen, so that words in ASCII, by far the most, need no lookup; else the most frequent of
them. A word that matches none is normalised by table: into the one alphabet besides Latin that it has letters of, if that has letters of
the look of all of them, else into Latin. The table also says which words go to one task: those that the automaton
could match.

In text in lower case (``lowered``) a look-alike capital has become the small letter of its alphabet, which looks
different. Where a word is of mixed alphabets and matches no spelling, such letters may stand for those of the capital;
only a spelling that the vocabulary has is chosen. A small nu is read as v, as it looks, else as n.

Words of one look always get one form, so texts look the same exactly if their forms are equal. Defined cases: null
stays null, empty stays empty; case, accents, hyphens, digits and the presence of a space are never changed.
"""

from __future__ import annotations

import functools
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.articles import live_articles
from quillon.plans.shipping import ensure_importable
from quillon.plans.workspace import materialise

def _pairs(*rows: tuple[str, str]) -> dict[str, str]:
    return {c: latin for letters, looks in rows for c, latin in zip(letters, looks, strict=True)}


# Letters of other alphabets with the Latin letters that look like them; first those in common use.
COMMON_LOOK_ALIKES = _pairs(
    ("АВЕЅІЈКМНОРСТУХ", "ABESIJKMHOPCTYX"),  # Cyrillic
    ("аеорсухѕіј", "aeopcyxsij"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek
    ("αγινορσυ", "ayivopou"),
    ("ՏՍՕ", "SUO"),  # Armenian
    ("զհոսցօ", "qhnugo"),
)
LOOK_ALIKES = COMMON_LOOK_ALIKES | _pairs(
    ("ӀҮѴԌԚԜ", "IYVGQW"),  # Cyrillic
    ("һԁԛԝӏүѵ", "hdqwlyv"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),  # Lisu
    ("ɑɡıȷ", "agij"),  # Latin
    ("\u2010\u2011", "--"),  # hyphens
)
# Small forms of capitals that look alike, as they come in text in lower case. Not the small mu: it is the micro sign's form.
SMALL_CAPITALS = {c.lower(): latin.lower() for c, latin in LOOK_ALIKES.items() if c.isupper() and LOOK_ALIKES.get(c.lower()) != latin.lower() and c != "Μ"}
# Compatibility forms that look different from what they decompose to.
_OTHER_LOOK = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")
_SPACES = r"[\p{Zs}\t]"
#: A word may need a change if it has any character beyond ASCII.
_BEYOND_ASCII = "[^\\x00-\\x7F]"


@functools.lru_cache(100_000)
def units(char: str) -> str:
    """What a character looks like, decomposed; empty for ignorable characters."""
    return "".join(LOOK_ALIKES.get(c, c) for c in pieces(char))


@functools.lru_cache(100_000)
def pieces(char: str) -> str:
    """A character decomposed, its letters as they are; empty for ignorable characters."""
    category = unicodedata.category(char)
    if category == "Cf" or "︀" <= char <= "️" or char in "͏ᅟᅠ឴឵ㅤﾠ":
        return ""
    if category == "Zs" or char == "\t":
        return " "
    mapping = unicodedata.decomposition(char)
    if mapping and not mapping.startswith(_OTHER_LOOK):
        plain = "".join(chr(int(x, 16)) for x in mapping.split() if not x.startswith("<"))
        return "".join(map(pieces, plain))
    return unicodedata.normalize("NFD", char)  # Hangul


def by_table(text: str) -> str:
    """What a text looks like, by table alone: the same for all texts of one look."""
    if text.isascii() and "\t" not in text:
        return text
    return unicodedata.normalize("NFC", "".join(map(units, text)))


def of_one_alphabet(word: str) -> str:
    """A word of Latin letters and those of another alphabet, all in the other one where it has common letters of that look."""
    form = by_table(word)
    others = {_alphabet(c) for c in form if c.isalpha()} - {"LATIN", *_ANY_ALPHABET}
    if len(others) != 1:
        return form
    own = {latin: c for c, latin in COMMON_LOOK_ALIKES.items() if _alphabet(c) in others}
    parts = [own.get(c, c) for c in unicodedata.normalize("NFD", form)]
    changed = unicodedata.normalize("NFC", "".join(parts))
    return form if _mixed(changed) else changed


def _alphabet(char: str) -> str:
    return unicodedata.name(char, "?").split(" ")[0] if char.isalpha() and char >= "\x80" else "LATIN" if char.isalpha() else ""


def is_plain(word: str) -> bool:
    """Whether a word is a canonical spelling: composed, without ignorable or presentation forms, of one alphabet."""
    if word.isascii():
        return True
    if unicodedata.normalize("NFC", word) != word or any(units(c) == "" for c in word):
        return False
    if any(unicodedata.decomposition(c).startswith("<") for c in word):
        return False
    return not _mixed(word)


# Alphabets that stand in one word with any other.
_ANY_ALPHABET = {"CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "MODIFIER"}


def _mixed(word: str) -> bool:
    return len({_alphabet(c) for c in word if c.isalpha()} - _ANY_ALPHABET) > 1


def _arcs(word: str, lowered: bool = False) -> list[tuple[str, ...]]:
    """What each piece of a word may be read as at no cost: a letter of its look, or nothing if it is ignorable."""
    arcs = [(p, (LOOK_ALIKES.get(p, p),) if p else ("",)) for c in word for p in pieces(c) or ("",)]
    return [a + (SMALL_CAPITALS[p],) if lowered and p in SMALL_CAPITALS else a for p, a in arcs]


# Letters that a small form may be read as, and what stands for them where words are put together.
_TOGETHER = {**SMALL_CAPITALS, **{LOOK_ALIKES[c]: latin for c, latin in SMALL_CAPITALS.items() if c in LOOK_ALIKES}}


def _key(look: Column, lowered: bool) -> Column:
    """Words of one key are in one task: those of one look, in text in lower case also those that small forms may stand for."""
    return F.translate(look, "".join(_TOGETHER), "".join(_TOGETHER.values())) if lowered else look


class Trie:
    """The canonical spellings as a trie over what they look like: a sorted list, a node being a range of it."""

    def __init__(self, spellings: dict[str, int]):
        rows = sorted(("".join(map(units, w)), not w.isascii(), -n, w) for w, n in spellings.items())
        self.keys = [r[0] for r in rows]
        self.words = [r[3] for r in rows]
        self.ranks = [r[1:] for r in rows]

    def _child(self, low: int, high: int, prefix: str) -> tuple[int, int]:
        return bisect_left(self.keys, prefix, low, high), bisect_left(self.keys, prefix + "\U0010ffff", low, high)

    def closest(self, word: str, budget: int = 0, lowered: bool = False) -> str | None:
        """The spelling of the least edit cost within ``budget``, in ASCII or the most frequent of several; None if there is none."""
        arcs = _arcs(word, lowered)
        best: tuple[int, tuple, int] | None = None
        stack = [(0, 0, len(self.keys), "", 0)]
        seen: set[tuple[int, str, int]] = set()
        while stack:
            at, low, high, prefix, cost = stack.pop()
            if low >= high or (at, prefix, cost) in seen:
                continue
            seen.add((at, prefix, cost))
            if at == len(arcs) and self.keys[low] == prefix and (best is None or (cost, self.ranks[low]) < best[:2]):
                best = (cost, self.ranks[low], low)
            if at < len(arcs):
                for unit in arcs[at]:
                    stack.append((at + 1, *(self._child(low, high, prefix + unit) if unit else (low, high)), prefix + unit, cost))
            if cost < budget:
                stack.append((at + 1, low, high, prefix, cost + 1)) if at < len(arcs) else None
                for nxt in {k[len(prefix)] for k in self.keys[low:high] if len(k) > len(prefix)}:
                    step = (*self._child(low, high, prefix + nxt), prefix + nxt, cost + 1)
                    stack.append((at, *step))
                    if at < len(arcs) and nxt not in arcs[at]:
                        stack.append((at + 1, *step))
        return self.words[best[2]] if best else None


def _look(word: Column) -> Column:
    def batch(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else by_table(w) for w in words.to_pylist()], pa.string())

    return F.arrow_udf(batch, "string")(word)


def words_of(text: Column) -> Column:
    """The stretches of a text between spaces of any kind; empty ones too, so that joining by a space gives it back."""
    return F.split(text, _SPACES, -1)


def _form(trie: Trie, word: str, lowered: bool) -> str:
    form = trie.closest(word)
    if form is None and lowered and (_mixed(word) or _mixed(by_table(word))):
        form = trie.closest(word, lowered=True)
    return form or of_one_alphabet(word)


def _canonical_part(batches: Iterator[pa.RecordBatch], lowered: bool = False) -> Iterator[pa.RecordBatch]:
    """``word, form`` of a task's words that change; all words of one key are in the same task."""
    plain: dict[str, int] = {}
    others: list[str] = []
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if is_plain(word):
                plain[word] = n
            if not word.isascii():
                others.append(word)
    trie = Trie(plain)
    forms = [(w, _form(trie, w, lowered)) for w in others]
    forms = [(w, f) for w, f in forms if w != f]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in forms], pa.string()), pa.array([f for _, f in forms], pa.string())], ["word", "form"])


def canonical_words(words: DataFrame, lowered: bool = False) -> DataFrame:
    """``word, form`` of the words whose form is another, from a frame with one ``word`` per occurrence.

    ``lowered``: the words are stored in lower case, as terms are.

    Distinct words are counted before the shuffle. Each task holds the distinct words of its share of looks.
    """
    ensure_importable(words.sparkSession)
    counted = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    # Looks that are in play: those of at least one word beyond ASCII. The others can't change anything.
    looks = counted.where(F.col("word").rlike(_BEYOND_ASCII)).select(_key(_look(F.col("word")), lowered).alias("look"), "word", "n")
    ascii_words = counted.where(~F.col("word").rlike(_BEYOND_ASCII)).select(_key(F.col("word"), lowered).alias("look"), "word", "n")
    matching = ascii_words.join(looks.select("look").distinct(), "look", "left_semi")
    together = looks.unionByName(matching).repartition("look")
    return together.select("word", "n").mapInArrow(functools.partial(_canonical_part, lowered=lowered), "word STRING, form STRING")


def canonical_texts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, form``: each row's text and its one form. ``key`` is unique and not null.

    Texts in ASCII have their form already, but for tabs. Of the others, the words beyond ASCII are looked up by a
    join on the word; the words of one text are collected again by key.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    words = rows.select(F.explode(words_of(F.col("text"))).alias("word"))
    forms = materialise(canonical_words(words))
    odd = rows.where(F.col("text").rlike(_BEYOND_ASCII)).select("key", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).where(F.col("word").rlike(_BEYOND_ASCII))
    found = odd.join(forms, "word").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "form"))).alias("forms"))
    joined = rows.join(found, "key", "left")
    form = F.array_join(F.transform(words_of(F.col("text")), lambda w: F.coalesce(F.element_at(F.col("forms"), w), w)), " ")
    return joined.select(F.col("key").alias(key), F.col("text").alias(text), form.alias("form"))


def same_looking_titles(articles: DataFrame) -> DataFrame:
    """``doc_id, title, form`` of each live article with a title; titles that look the same have the same form."""
    return canonical_texts(live_articles(articles, "title").where("title IS NOT NULL"), "doc_id", "title")


def same_looking_pairs(articles: DataFrame) -> DataFrame:
    """``doc_a, doc_b``: pairs of articles whose titles differ character by character but look the same.

    Links are made between the distinct titles of a form; articles are joined to them only at the end, so copies of
    one title meet none of each other.
    """
    titled = materialise(same_looking_titles(articles))
    distinct = titled.groupBy("form", "title").agg(F.count("*").alias("n"))
    mixed = distinct.groupBy("form").agg(F.count("*").alias("k")).where("k > 1").select("form")
    variants = distinct.join(mixed, "form", "left_semi").select("form", "title")
    a, b = variants.alias("a"), variants.alias("b")
    links = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.title") < F.col("b.title"))).select(F.col("a.title").alias("title_a"), F.col("b.title").alias("title_b"))
    docs = titled.join(mixed, "form", "left_semi").select("doc_id", "title")
    pairs = links.join(docs.select(F.col("doc_id").alias("x"), F.col("title").alias("title_a")), "title_a").join(docs.select(F.col("doc_id").alias("y"), F.col("title").alias("title_b")), "title_b")
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
