"""Operators on documents: encoding, mixing, repair of wrong encodings."""

from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe, mixing, mojibake

VOCABULARY = os.environ.get("QUILLON_VOCABULARY", bpe.DEFAULT_VOCABULARY)
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def machine():
    with open(VOCABULARY, "rb") as file:
        return bpe.Transducer(bpe.read_ranks(file.read()))


@pytest.fixture(scope="module")
def reference(machine):
    return tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=machine.ranks, special_tokens={})


def documents(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id long, text string, source string, n_tokens int, copies int, ids int, rate string")


def test_ids_equal_the_library(spark, machine, reference):
    texts = ["", "Hello world", "it's  a\n\n test\t", "naïve café – 中文テスト 👩‍💻", "=" * 3000, "a" * 20_000, " " * 5000, "ab" * 4000, "<|endoftext|>", "\x00\x7f\x85", "x" * 63 + "é"]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(99, None, "s"), (None, "null id", "s")]
    found = {r.doc_id: r.ids for r in bpe.encode_corpus(documents(spark, rows), VOCABULARY).collect()}
    assert found[99] == [] and found[0] == [] and len(found) == len(rows)
    for k, t in enumerate(texts):
        assert found[k] == reference.encode_ordinary(t)
        assert machine.decode(found[k]) == t
    assert bpe.encode_corpus(documents(spark, []), VOCABULARY).count() == 0


def test_ids_on_a_corpus(spark, folder, reference):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}
    assert all(r.ids == reference.encode_ordinary(texts[r.doc_id]) for r in bpe.encode_corpus(frame, VOCABULARY).collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdetionsr  '\n-=1"), st.characters(codec="utf-8")), max_size=60))
def test_ids_of_any_text(text):
    machine, reference = _shared()
    ids = machine.encode(text)
    assert ids == reference.encode_ordinary(text) and machine.decode(ids) == text


_kept: list = []


def _shared():
    if not _kept:
        with open(VOCABULARY, "rb") as file:
            ranks = bpe.read_ranks(file.read())
        _kept.extend((bpe.Transducer(ranks), tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})))
    return _kept


def test_small_memory_gives_the_same(machine, monkeypatch):
    monkeypatch.setattr(bpe, "_MAX_STATES", 50)
    monkeypatch.setattr(bpe, "_MAX_WORDS", 10)
    other = bpe.Transducer(machine.ranks)
    text = " ".join(f"word{k} naïve" for k in range(200))
    assert other.encode(text) == machine.encode(text)


def test_streaming_decode(machine):
    ids = machine.encode("é中👍 done")
    pieces = list(bpe.stream_decode(machine.by_id(), ids))
    assert "".join(pieces) == "é中👍 done" and "�" not in "".join(pieces)
    assert "".join(bpe.stream_decode({0: b"\xe4\xb8"}, [0])) == "�"


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_mix_reaches_its_targets(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon".split()
    rows = []
    for source, n in (("big", 900), ("mid", 300), ("small", 40), ("other", 50)):
        rows += [(len(rows) + k, " ".join(rng.choices(words, k=rng.randint(5, 120))), source) for k in range(n)]
    rows += [(10_000, None, "mid"), (10_001, "", "big"), (10_002, "x y", None), (None, "no id", "big")]
    rows += rows[:30]
    wishes = targets(spark, [("big", 40.0, 1), ("mid", 40.0, 3), ("small", 20.0, 2), ("absent", 5.0, 9), ("zero", 0.0, 1), (None, 1.0, 1)])
    copies, report = mixing.mix(documents(spark, rows), wishes, VOCABULARY)
    found = {r.source: r for r in report.collect()}
    assert set(found) == {"big", "mid", "small", "absent", "zero"}
    assert found["small"].capped and found["small"].most_copies == 2 and found["absent"].tokens == 0
    sizes = copies.collect()
    assert len({r.doc_id for r in sizes}) == len(sizes) and not {r.source for r in sizes} - {"big", "mid", "small"}
    total = sum(r.n_tokens for r in sizes)
    assert abs(sum(r.tokens for r in found.values()) / total - 1) < 0.01
    assert abs(found["big"].tokens / found["mid"].tokens - 1) < 0.02
    assert all(r.copies <= {"big": 1, "mid": 3, "small": 2}[r.source] for r in sizes)
    for s in ("big", "mid"):
        assert abs(found[s].tokens - found[s].target_tokens) <= 0.01 * found[s].target_tokens
    texts = mixing.mixed_texts(documents(spark, rows), wishes, VOCABULARY)
    assert texts.count() == sum(r.copies > 0 for r in sizes)


def test_mix_of_nothing(spark):
    wishes = targets(spark, [("a", 1.0, 1)])
    assert mixing.mixed_texts(documents(spark, []), wishes, VOCABULARY).count() == 0
    assert [r.share for r in mixing.mix_report(documents(spark, []), wishes, VOCABULARY).collect()] == [0.0]
    assert mixing.mixed_texts(documents(spark, [(1, "text", "a")]), targets(spark, []), VOCABULARY).count() == 0
    nulls = targets(spark, [("a", None, 2), ("b", 1.0, None)])
    assert {r.source: r.copies for r in mixing.mixed_texts(documents(spark, [(1, "some text", "a"), (2, "some text", "b")]), nulls, VOCABULARY).collect()} == {"b": 1}


def test_allotment():
    assert mixing.allot(100, {"a": 1, "b": 1, "c": 2}, {"a": 10, "b": 100, "c": 100}) == {"a": 10, "b": 30, "c": 60}
    assert mixing.allot(100, {"a": 1, "b": 0}, {"a": 20, "b": 50}) == {"a": 20, "b": 0}


GOOD = [
    "It doesn’t read the naïve café — “quoted”, 20–40 µs…",
    "L’élément indexé révèle la façade très tôt, où l’été « décale » le dépôt.",
    "Die Prüfsumme überträgt der Schnappschuss nur für große Blöcke.",
    "El año de carga empezó la señal aquí y allá, ¿según la compañera? ¡Sí!",
    "A REGIÃO FRIA MANTÉM A LÂMINA, A INDEXAÇÃO NÃO LÊ “ISTO É MANHÔ — NÃO…",
    "Запрос проверяет счётчик ещё до слияния, «разбор строки» сжимает порядок выдачи АКТЁР».",
    "порядок\xa0выдачи № 5 ждёт объём памяти",
    "如果延迟没有扫描词条，表结构就要返回43次。夜间，范围会重写罕见的编码。",
    "夜のうちに並べ替えのスコアを削除する。もう一度ログの見出しを比較する。",
    "index/\n├── segments/\n│   ├── a.seg\n└── b.log → ✓ ★ 👩‍💻 ﬁ ￥",
    "10 °C ± 0,5 §3 ©2024 ®x 5 € £4 ½ Ω",
]


@pytest.mark.parametrize("text", GOOD)
def test_good_text_is_left_alone(text):
    assert mojibake.repair(text) == (text, 0) and not mojibake.is_garbled(text)


def garble(text, encoding, meant="utf-8"):
    table = {b: c for c, b in mojibake._high_bytes(encoding).items()}
    return "".join(chr(b) if b < 0x80 else table[b] for b in text.encode(meant))


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("text", GOOD[:4])
def test_utf8_read_as_single_bytes(text, encoding):
    assert mojibake.repair(garble(text, encoding)) == (text, 1)


@pytest.mark.parametrize("text", [*GOOD[:4], GOOD[7]])
def test_layers_and_parts(text):
    twice = garble(garble(text, "cp1252"), "cp1252")
    assert mojibake.repair(twice) == (text, 2)
    assert mojibake.repair("good – café. " + garble(text, "cp1252") + " good – café.") == ("good – café. " + text + " good – café.", 1)


@pytest.mark.parametrize(
    ("text", "read_as", "meant"),
    [(GOOD[7], "cp1252", "gbk"), (GOOD[8], "cp1252", "euc_jp"), ("Запрос проверяет счётчик ещё до слияния", "cp1252", "cp1251"), ("Запрос проверяет счётчик до слияния", "cp1251", "koi8-r"), ("Объём памяти меняет буфер записи", "koi8-r", "cp1251"), ("El año empezó la señal aquí y allá según la compañera", "mac_roman", "cp1252"), ("Le dépôt décale très tôt la clé agrégée", "cp850", "cp1252")],
)
def test_legacy_bytes_read_as_others(text, read_as, meant):
    assert mojibake.repair(garble(text, read_as, meant))[0] == text


@pytest.mark.parametrize(("text", "read_as"), [(GOOD[5], "cp1254"), (GOOD[1], "cp1254"), ("Ο έλεγχος διαβάζει το αρχείο", "cp1253"), (GOOD[1], "iso8859-2"), ("Запрос проверяет счётчик ещё до слияния", "iso8859-5"), (GOOD[2], "iso8859-5")])
def test_utf8_read_as_rarer_encodings(text, read_as):
    assert mojibake.repair(garble(text, read_as))[0] == text


def test_russian_read_as_gbk():
    for word in ("запрос", "строке", "проверка"):
        read = word.encode("cp1251").decode("gbk")
        assert mojibake.is_garbled(read) and mojibake.repair(read)[0] == word
    assert mojibake.repair(GOOD[7]) == (GOOD[7], 0)


@pytest.mark.parametrize("text", GOOD)
def test_each_accepted_step_lowers_the_cost(text):
    """Whatever the means, a text is only replaced by one of lower garbling cost."""
    for encoding in ("cp1252", "cp1251", "mac_roman", "cp850"):
        now = garble(text, encoding) + " " + text
        while (good := mojibake._better(now)) is not None:
            assert mojibake.garbling_cost(good) < mojibake.garbling_cost(now)
            now = good


def test_share_of_restored_texts():
    """Of texts that went through one wrong decoding, by far the most come out as they were."""
    pairs = [("utf-8", e) for e in ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "cp1254", "iso8859-2")]
    tries = [(text, garble(text, read_as, meant)) for text in GOOD for meant, read_as in pairs if garble(text, read_as, meant) != text]
    assert sum(mojibake.repair(bad)[0] == text for text, bad in tries) >= 0.9 * len(tries) and len(tries) > 80


def test_utf8_read_as_gbk():
    text = GOOD[7]
    assert mojibake.repair(text.encode().decode("gbk", "replace"))[1] > 0
    assert mojibake.repair("a caf" + "é".encode().decode("gbk") + " build")[0] == "a café build"
    assert mojibake.repair("it doesn" + "’t ".encode().decode("gbk") + "stop")[0] == "it doesn’t stop"


def test_lost_characters_are_found():
    assert mojibake.is_garbled("colecci�n") and mojibake.repair("colecci�n") == ("colecci�n", 0)


def test_repair_of_documents(spark):
    bad = garble(GOOD[0], "cp1252")
    rows = [(1, GOOD[0], "s"), (2, bad, "s"), (3, bad, "s"), (3, bad, "s"), (4, None, "s"), (5, "", "s"), (6, "ascii", "s"), (7, "lost �", "s"), (8, bad * 2000, None)]
    frame = documents(spark, rows)
    assert sorted(r.doc_id for r in mojibake.garbled_documents(frame).collect()) == [2, 3, 7, 8]
    restored = {r.doc_id: (r.text, r.layers) for r in mojibake.restore_documents(frame).collect()}
    assert restored[2] == (GOOD[0], 1) and restored[1] == (GOOD[0], 0) and restored[8] == (GOOD[0] * 2000, 1) and 6 not in restored
    assert mojibake.garbled_documents(documents(spark, [])).count() == 0


_SIGNS = "ÃÂâ€™éè¤Ðà°±├®ôÕ┬µ‚ÄÖГ©РёжВ璇枚\ufffd\x80\x9d\xa0"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(_SIGNS + "ab c."), st.characters(codec="utf-8")), max_size=40))
def test_repair_of_any_text_ends(text):
    restored, layers = mojibake.repair(text)
    assert isinstance(restored, str) and 0 <= layers <= mojibake.MAX_LAYERS and (layers > 0 or restored == text)
    if text.isascii():
        assert (restored, layers) == (text, 0)
