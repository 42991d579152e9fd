"""Finding and restoring text that was decoded with a wrong character encoding.

Round-trip repair: a stretch of text is encoded again with a legacy encoding and decoded strictly with the
encoding that was meant. Each layer of wrong decoding is undone by one round; rounds repeat while the garbling
cost of the text drops. Stretches are found by byte patterns, so a text that is garbled only in part is repaired
only there, and every other character stays as it is.

Null and blank texts are not garbled and stay as they are. A text whose characters were lost (U+FFFD in place of
what could not be decoded) is found but can be restored only where nothing was lost.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.shipping import ensure_importable

# Single-byte encodings that UTF-8 is mistaken for, most usual first.
SINGLE_BYTE = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-15", "cp866", "koi8-r", "cp1254", "cp1253", "iso8859-2", "iso8859-5")
MAX_LAYERS = 5

_LOST = "�"
_CLOSING = set("–—’“”…›»")
_RUSSIAN = set("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюяЁё")


def _high_bytes(encoding: str) -> dict[str, int]:
    """Characters of the bytes 0x80-0xFF; bytes that the encoding leaves undefined stand for themselves."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            char = bytes((byte,)).decode(encoding)
        except UnicodeDecodeError:
            char = chr(byte)
        table.setdefault(char, byte)
    if encoding in ("cp1252", "cp1251", "cp1250"):
        for byte in range(0x80, 0xA0):  # decoders for the web pass these bytes through
            table.setdefault(chr(byte), byte)
    return table


def _class(table: dict[str, int], low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"


#: Characters that a text may hold between two layers.
_INTERMEDIATE = {c for e in SINGLE_BYTE for c in _high_bytes(e)}

#: Signs that stand beside words in good Russian text.
_BESIDE_RUSSIAN = set("\u00a0«»“”„‘’‚–—…№°©®·")


class _Layer:
    """UTF-8 text that was read as a single-byte encoding."""

    def __init__(self, encoding: str):
        self.encoding = encoding
        self.cyrillic = encoding in ("cp1251", "cp866", "koi8-r", "iso8859-5")
        self.bytes = _high_bytes(encoding)
        follow = _class(self.bytes, 0x80, 0xBF)
        two = f"{_class(self.bytes, 0xC2, 0xDF)}{follow}"
        three = f"{_class(self.bytes, 0xE0, 0xEF)}{follow}{{2}}"
        four = f"{_class(self.bytes, 0xF0, 0xF4)}{follow}{{3}}"
        self.pattern = re.compile(f"(?:{two}|{three}|{four})+")
        self.leads = frozenset(c for c, b in self.bytes.items() if 0xC2 <= b <= 0xF4)
        self.follows = frozenset(c for c, b in self.bytes.items() if 0x80 <= b <= 0xBF)

    def possible(self, chars: set[str]) -> bool:
        """Whether a text of these characters can hold a stretch of the layer."""
        return not self.leads.isdisjoint(chars) and not self.follows.isdisjoint(chars)

    def begins(self, pairs: set[tuple[str, str]]) -> bool:
        """Whether a stretch of the layer can begin at one of these pairs of neighbours."""
        return any(a in self.leads and b in self.follows for a, b in pairs)

    def restore(self, run: str) -> str | None:
        try:
            return bytes(self.bytes[c] for c in run).decode("utf-8")
        except UnicodeDecodeError:
            return None


@functools.cache
def _plausible(char: str) -> bool:
    """Whether a character is one that texts are made of, and no by-product of wrong decoding."""
    code = ord(char)
    if code < 0x80:
        return True
    if code < 0xA0 or 0xE000 <= code <= 0xF8FF or code == 0xFFFD:
        return False
    if code in (0x131, 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192, 0x1E9E):
        return True
    if code < 0x180 or 0x400 <= code < 0x460 or 0x386 <= code < 0x3CF:
        return True
    if 0x2000 <= code < 0x2070 or 0x20A0 <= code < 0x20C0 or 0x2100 <= code < 0x2150 or 0x2190 <= code < 0x2800:
        return True
    if 0x3000 <= code < 0x3100 or 0x4E00 <= code < 0xA000 or 0xFE00 <= code < 0xFE10 or 0xFF00 <= code < 0xFFF0 or code == 0xFEFF:
        return True
    if 0x300 <= code < 0x370 or 0x1E00 <= code < 0x1F00 or 0xAC00 <= code < 0xD7A4 or 0x5D0 <= code < 0x5EB or 0x620 <= code < 0x650:
        return True
    return code >= 0x1F000 and unicodedata.category(char) in ("So", "Sk")


def _script(char: str) -> str:
    code = ord(char)
    if code < 0x80:
        return "ascii"
    if 0x4E00 <= code < 0xA000 or 0x3040 <= code < 0x3100:
        return "han"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    if 0x370 <= code < 0x400:
        return "greek"
    return "latin" if char.isalpha() else "other"


def _ambiguous(text: str, start: int, end: int, run: str) -> bool:
    """A capital before a closing quote, dash or ellipsis, at the end of a capitalised word: good text as it is."""
    if len(run) != 2 or not run[0].isupper() or run[1] not in _CLOSING:
        return False
    before = text[start - 1] if start else " "
    if _script(run[0]) == "cyrillic" and _script(before) != "cyrillic":
        return False
    return (before.isupper() or not before.isalnum()) and not text[end : end + 1].islower()


def _undo_single(text: str, layer: _Layer) -> str:
    """One layer of ``layer`` undone. An ambiguous stretch is undone where others prove the layer."""
    foreign = layer.cyrillic and not _CYRILLIC_WORD.search(layer.pattern.sub("", text))  # no Cyrillic but in stretches

    def good(match: re.Match) -> str | None:
        run = match.group()
        if layer.cyrillic and not (foreign and proven) and all(c in _RUSSIAN or c in _BESIDE_RUSSIAN for c in run):
            beside = text[max(0, match.start() - 1) : match.start()] + text[match.end() : match.end() + 1]
            if not any(c.isascii() and c.isalpha() for c in beside):
                return None
        better = layer.restore(run)
        if better is not None and layer.cyrillic and any(_script(c) == "greek" for c in better):
            return None  # no text has Greek among Cyrillic
        return better if better is not None and all(_plausible(c) or c in _INTERMEDIATE for c in better) else None

    proven = False
    proven = any(good(m) is not None and not _ambiguous(text, m.start(), m.end(), m.group()) for m in layer.pattern.finditer(text))
    return layer.pattern.sub(lambda m: good(m) or m.group(), text) if proven else text


_LATIN_STRETCH = re.compile("[\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™̀-ͯ](?:[\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]|[@-~](?=[\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]))*[@-~]?")
_HIGH = "[\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]"
_LONG_LATIN_STRETCH = re.compile(f"(?:{_HIGH}[@-~]?){{3}}{_HIGH}")
_CYRILLIC_SIGNS = "".join(re.escape(c) for c in sorted({*_high_bytes("cp1251"), *_high_bytes("koi8-r"), *map(chr, range(0x80, 0xA0))}))
_CYRILLIC_SENTENCE = re.compile(f"[{_CYRILLIC_SIGNS}][{_CYRILLIC_SIGNS}, -]*")
_CYRILLIC_WORD = re.compile("[Ѐ-ӿ]")
# The commonest letters of Russian, which make up most of any text.
_CP1252_SIGNS = set("ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™")
_COMMON_RUSSIAN = set("оеаинтсрвлк")
# East Asian encodings whose bytes are read as a western one.
_EAST_ASIAN = ("gbk", "shift_jis", "euc_jp", "big5")
_LATIN_RUN = re.compile("[À-ÿ¨¸]{3,}")
#: Inside a word of small Latin letters: what stands where an accented small letter should.
_ODD_IN_WORD = re.compile(
    "(?<=[a-z])[^\\x00-\\x7fa-zß-öø-ÿāăąćčďđēěęğīıłńňōőœřśşšťūůűźżž\u00ad\u00b5\u00b7\u200b-\u206f\ufeff\ufffd\ufb00-\ufb06\uff00-\uffef\u3000-\u9fff\u0300-\u036f\u00a0]+(?=[a-z])"
    "|(?<=[a-z]{2})[^\\W\\d_a-zß-öø-ÿA-ZÀ-ÖØ-Þœ\u3000-\u9fff\uff00-\uffef\ufb00-\ufb06](?!\\w)"
)
# Western encodings mistaken for each other, as (read as, meant).
_WESTERN = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"))
_WESTERN_LETTERS = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ’“”–—…µ«»")
_HAN = re.compile("[一-鿿]")
_HAN_IN_WORD = re.compile("(?<=[a-z])[一-鿿]")
_CHINESE = re.compile("[一-鿿]{4}|[。，、！？；：]")
_WIDE_RUN = re.compile("[^\\x00-\\x7f]+")


def _legacy_bytes(run: str, encoding: str) -> bytes | None:
    table = _high_bytes_cached(encoding)
    try:
        return bytes(ord(c) if c < "\x80" else table[c] for c in run)
    except KeyError:
        return None


_high_bytes_cached = functools.cache(_high_bytes)


@functools.cache
def _common_han(char: str) -> bool:
    """A character of the first level of the simplified Chinese standard set, or Chinese punctuation."""
    try:
        data = char.encode("gb2312")
    except UnicodeEncodeError:
        return False
    return len(data) == 2 and (0xB0 <= data[0] <= 0xD7 or 0xA1 <= data[0] <= 0xA3)


@functools.cache
def _common_asian(char: str, encoding: str) -> bool:
    """A character that is common in text of an east Asian encoding: its first level of characters, kana, punctuation."""
    if "ぁ" <= char <= "ヿ":
        return encoding in ("shift_jis", "euc_jp")
    if char in "。、，！？：；「」（）":
        return True
    if encoding == "gbk":
        return _common_han(char)
    standard, low, high = ("big5", 0xA4, 0xC6) if encoding == "big5" else ("euc_jp", 0xB0, 0xCF)
    try:
        data = char.encode(standard)
    except UnicodeEncodeError:
        return False
    return len(data) == 2 and low <= data[0] <= high


def _is_utf8(data: bytes) -> bool:
    """Whether bytes are mostly UTF-8: a stretch may begin or end inside a character."""
    return data.decode("utf-8", "replace").count(_LOST) <= 0.1 * len(data)


def _undo_east_asian(text: str) -> str:
    """Chinese or Japanese bytes that were read as a western encoding: stretches of letters and signs in pairs."""
    best, most = text, 0
    if not _LONG_LATIN_STRETCH.search(text):
        return text  # no stretch is long enough to prove an encoding
    for encoding in _EAST_ASIAN:
        found = []
        for match in _LATIN_STRETCH.finditer(text):
            run = match.group()
            for part in (run, run[:-1] if run[-1] < "\x80" else ""):
                data = _legacy_bytes(part, "cp1252") if part else None
                try:
                    good = data.decode(encoding) if data and not _is_utf8(data) else ""
                except UnicodeDecodeError:
                    continue
                if good:
                    found.append((match.start(), match.start() + len(part), good, sum(_common_asian(c, encoding) for c in good) / len(good)))
                    break
        if not any(len(good) >= 3 and share >= 0.7 for _, _, good, share in found):
            continue
        out, at, gain = [], 0, 0.0
        for start, end, good, share in found:
            if share >= 0.5:
                out += [text[at:start], good]
                at, gain = end, gain + share * len(good) - 2 * (1 - share) * len(good) - 0.1 * len(good)
        if gain > most:
            best, most = "".join(out) + text[at:], gain
    return best


def _russian(text: str) -> float:
    """How much a stretch reads as Russian: the share of the commonest letters among all."""
    letters = [c for c in text.lower() if "а" <= c <= "я" or c == "ё"]
    wide = sum(c >= "\x80" for c in text)
    return sum(c in _COMMON_RUSSIAN for c in letters) / wide if wide else 0.0


def _russian_case(text: str) -> float:
    """The share of small letters among those after the first of a word; low where an encoding swapped the cases."""
    inner = [c for word in re.findall("[Ѐ-ӿ╦╗]+", text) for c in word[1:] if c.isalpha()]
    return sum(c.islower() for c in inner) / len(inner) if inner else 0.0


def _undo_cyrillic(text: str) -> str:
    """Russian bytes of one legacy encoding that were read as another or as a western one."""

    def best(run: str, pairs: list[tuple[str, str]]) -> str:
        options = []
        for read_as, meant in pairs:
            data = _legacy_bytes(run, read_as)
            try:
                good = data.decode(meant) if data else ""
            except UnicodeDecodeError:
                continue
            options.append((round(_russian(good) + 0.5 * _russian_case(good), 3), good))
        return max(options)[1] if options and max(options)[0] >= 0.9 else run

    western = [("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866")]
    letters = sum(len(r) for r in _LATIN_RUN.findall(text) if len(r) >= 4) if _LONG_LATIN_STRETCH.search(text) else 0
    if letters >= 12 and letters > 0.5 * sum("\x80" <= c <= "ÿ" or c in _CP1252_SIGNS for c in text):
        text = re.sub("[\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™][\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™ ,-]*", lambda m: best(m.group(), western), text)

    def sentence(match: re.Match) -> str:
        run = match.group()
        if sum("Ѐ" <= c <= "ӿ" for c in run) < 6:
            return run
        capitals = run.isupper()
        now, case = _russian(run), _russian_case(run)
        if now >= 0.5 if capitals else now + 0.5 * case >= 0.9:
            return run
        if len(_layer("cp1251").pattern.sub("", run)) < 0.5 * len(run):
            return run  # UTF-8 that was read as cp1251
        good = best(run, [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251")])
        if capitals:
            return good if _russian(good) >= max(0.55, now + 0.15) else run
        return good if _russian(good) + 0.5 * _russian_case(good) > max(0.9, now + 0.5 * case + 0.25) else run

    return _CYRILLIC_SENTENCE.sub(sentence, text) if _CYRILLIC_WORD.search(text) else text


def _undo_western(text: str) -> str:
    """Western bytes of one encoding that were read as another: signs or capitals inside words of small letters."""
    before = len(_ODD_IN_WORD.findall(text)) if any(map(_may_be_odd, _beyond_ascii(text))) else 0
    if not before:
        return text
    best, least = text, before
    for read_as, meant in _WESTERN:
        table = _high_bytes_cached(read_as)

        def swap(match: re.Match, table: dict[str, int] = table, meant: str = meant) -> str:
            try:
                good = bytes(table[c] for c in match.group()).decode(meant)
            except (KeyError, UnicodeDecodeError):
                return match.group()
            return good if all(c in _WESTERN_LETTERS or c.isspace() for c in good) else match.group()

        better = _ODD_IN_WORD.sub(swap, text)
        left = len(_ODD_IN_WORD.findall(better))
        if left >= least or left > 0.2 * before:
            continue
        words = [w for w in re.findall("[^\\s]+", text) if not w.isascii()]
        for word in set(words):
            good = _WIDE_RUN.sub(swap, word)
            if good != word and not _already_western(word):
                better = better.replace(word, good)
        best, least = better, left
    return best


@functools.cache
def _may_be_odd(char: str) -> bool:
    return bool(_ODD_IN_WORD.search(f"aa{char}a") or _ODD_IN_WORD.search(f"aa{char}"))


def _already_western(word: str) -> bool:
    """A word whose accented letters are all small, as in good text."""
    return all(c in _WESTERN_LETTERS and (c.islower() or not c.isalpha()) for c in word if c >= "\x80")


def _undo_gbk(text: str) -> str:
    """UTF-8 that was read as GBK: hanzi from byte pairs that cut across characters.

    Pairs may have swallowed an ASCII character, which the round trip gives back. A long stretch must come out as
    plausible text. A short one must come out as a letter or sign that western texts have, and be of rare hanzi or in
    a text that is not Chinese.
    """
    if not _HAN.search(text):
        return text
    counts: list[int] = []

    def native_and_strange() -> list[int]:
        """How many hanzi of the text are common ones, and how many are not."""
        if not counts:
            han = _HAN.findall(text)
            common = sum(map(_common_han, han))
            counts.extend((common, len(han) - common))
        return counts

    def fix(match: re.Match) -> str:
        run = match.group()
        if not _HAN.search(run):
            return run
        try:
            data = run.replace(_LOST, "?").encode("gb18030")
        except UnicodeEncodeError:
            return run
        good = data.decode("utf-8", "replace")
        wrong = good.count(_LOST)
        han = sum("一" <= c < "ꀀ" or "　" <= c < "〿" or "＀" <= c < "￰" for c in good)
        if wrong == 0 and all(map(_plausible, good)):
            if len(run) >= 4 or han:
                return good
            odd = any("一" <= c < "ꀀ" and not _common_han(c) for c in run)
            if not all(c < "\x80" or c in _WESTERN_LETTERS for c in good):
                return run
            if odd or not _CHINESE.search(text):
                return good
        if len(run) >= 3 and wrong and (russian := _russian_bytes(data)):
            return russian
        if len(run) >= 4 and han >= 2 and wrong <= 0.5 * han:
            native, strange = native_and_strange()
            if strange > 0.2 * (native + strange):
                return _keep_lost(run, data)
        return run

    return _WIDE_RUN.sub(fix, text)


def _russian_bytes(data: bytes) -> str | None:
    """Russian in a legacy encoding, nearly all of it small letters; bytes of hanzi give capitals and signs instead."""
    for encoding in ("cp1251", "koi8-r"):
        good = data.decode(encoding, "replace")
        small = sum("а" <= c <= "я" or c in "ё -,." for c in good)
        if small >= 0.9 * len(good) and _russian(good) >= 0.55:
            return good
    return None


def _keep_lost(run: str, data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("�?", _LOST)


_layers: dict[str, _Layer] = {}


def _layer(encoding: str) -> _Layer:
    if encoding not in _layers:
        _layers[encoding] = _Layer(encoding)
    return _layers[encoding]


@functools.cache
def _char_cost(char: str) -> int:
    if not _plausible(char):
        return 3
    return 1 if ord(char) >= 0x80 else 0


def garbling_cost(text: str) -> float:
    """How garbled a text looks.

    Signs that no text is made of count most, then all that is beyond ASCII. What doesn't read counts too: signs inside
    words of small letters, hanzi (two bytes in one sign) and more so those that are not common ones, accented letters
    in a row, and Cyrillic by how far its letters are from those of Russian.
    """
    wide = [c for c in text if c >= "\x80"]
    cost = float(sum(map(_char_cost, wide)))
    kinds = set(wide)
    if any(map(_may_be_odd, kinds)):
        cost += 2 * len(_ODD_IN_WORD.findall(text))
    if any("一" <= c <= "鿿" for c in kinds):
        cost += sum(1 if _common_han(c) else 2 for c in wide if "一" <= c <= "鿿") + len(_HAN_IN_WORD.findall(text))
    if any("À" <= c <= "ÿ" for c in kinds):
        cost += sum(len(run) for run in _LATIN_RUN.findall(text))
    if any("Ѐ" <= c <= "ӿ" for c in kinds):
        cost += sum(_unread(run) for run in _CYRILLIC_SENTENCE.findall(text) if _CYRILLIC_WORD.search(run))
    return cost


def _unread(run: str) -> float:
    """How much of a stretch of Cyrillic does not read as Russian, in characters; capitals are no fault where all are."""
    case = 1.0 if run.isupper() else _russian_case(run)
    return sum(c >= "\x80" for c in run) * max(0.0, 1.5 - _russian(run) - 0.5 * case)


_ASCII = frozenset(map(chr, range(0x80)))


def _beyond_ascii(text: str) -> set[str]:
    return set(text) - _ASCII


def _better(text: str) -> str | None:
    """The text with one layer undone, by the surest means that lowers the garbling cost; None if none does."""
    chars = _beyond_ascii(text)
    if not chars:
        return None
    cost = functools.cache(lambda: garbling_cost(text))  # most texts are never measured
    for undo in (_undo_east_asian, _undo_cyrillic):
        if (good := undo(text)) != text and garbling_cost(good) < cost():
            return good
    pairs = {pair for run in _WIDE_RUN.findall(text) if len(run) > 1 for pair in zip(run, run[1:])}
    layers = [layer for layer in map(_layer, SINGLE_BYTE) if layer.possible(chars) and layer.begins(pairs) and layer.pattern.search(text)]
    if changed := [good for layer in layers if (good := _undo_single(text, layer)) != text]:
        least, _, good = min((garbling_cost(good), n, good) for n, good in enumerate(changed))
        if least < cost():
            return good
    for undo in (_undo_gbk, _undo_western):
        if (good := undo(text)) != text and garbling_cost(good) < cost():
            return good
    return None


def repair(text: str | None) -> tuple[str | None, int]:
    """The restored text and the number of layers undone (0: not garbled, or beyond repair)."""
    if not text or text.isascii():
        return text, 0
    layers = 0
    while layers < MAX_LAYERS and (good := _better(text)) is not None:
        text, layers = good, layers + 1
    return text, layers


def is_garbled(text: str | None) -> bool:
    """Whether a text, in whole or in part, was decoded with a wrong encoding."""
    if not text or text.isascii():
        return False
    return _LOST in text or repair(text)[1] > 0


_RESULT = pa.struct([("text", pa.string()), ("layers", pa.int32()), ("garbled", pa.bool_())])


def _repair_batch(texts: pa.Array) -> pa.Array:
    restored, layers, garbled = [], [], []
    for value in texts.to_pylist():
        good, n = repair(value)
        restored.append(good)
        layers.append(n)
        garbled.append(n > 0 or _LOST in (value or ""))
    return pa.StructArray.from_arrays([pa.array(restored, pa.string()), pa.array(layers, pa.int32()), pa.array(garbled, pa.bool_())], fields=list(_RESULT))


def repaired(text: Column) -> Column:
    """``text, layers, garbled`` of a text: what ``repair`` gives, and whether the text was found garbled."""
    return F.arrow_udf(_repair_batch, "text string, layers int, garbled boolean")(text)


def restore_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, text, layers, garbled`` of the rows that have any character beyond ASCII.

    Other rows can't be garbled and need no Python; other columns are ignored.
    """
    ensure_importable(documents.sparkSession)
    suspects = documents.select("doc_id", "text").where(F.col("text").rlike("[^\\x00-\\x7F]"))
    return suspects.select("doc_id", repaired(F.col("text")).alias("r")).select("doc_id", "r.text", "r.layers", "r.garbled")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each document whose text is garbled, once; every copy of a text counts under its own id."""
    return restore_documents(documents).where("garbled").select("doc_id").distinct()
