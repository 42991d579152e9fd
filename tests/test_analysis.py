from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.functions.analysis import KEEP_ALL, STOP_WORDS, ChineseAnalyzer, StandardAnalyzer
from quillon.functions.highlight import Highlighter

TEXTS = {
    "Hello, WORLD!": "hello@0 world@1",
    "  a   bb  ": "bb@1",
    "go1.22 is out": "go1@0 22@1 is@2 out@3",
    "全文搜索": "全@0 文@1 搜@2 索@3",
    "Go语言search": "go@0 语@1 言@2 search@3",
    "a中": "中@1",
    "don’t stop": "don't@0 stop@1",
    "ＧＯ　ｌａｎｇ": "go@0 lang@1",
    "snake_case top-level": "snake@0 case@1 top@2 level@3",
    "'quoted' rock'n'roll x'": "quoted@0 rock'n'roll@1",
    "ΟΔΟΣ İzmir": "οδοσ@0 izmir@1",
    "": "",
}
PLAIN = StandardAnalyzer(stop_words=())


def shown(tokens):
    return " ".join(f"{t.term}@{t.pos}" for t in tokens)


@pytest.mark.parametrize("text", TEXTS)
def test_terms_and_positions_on_the_driver(text):
    assert shown(PLAIN.analyze(text)) == TEXTS[text]


def test_columns_equal_the_driver(spark):
    texts = [*TEXTS, "the quick brown fox", "out of the box", "naïve – café", "x" * 70_000, "日本語テキスト", "a'" * 3000 + "a", "🙂 ok"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for analyzer in (PLAIN, KEEP_ALL, StandardAnalyzer()):
        for r in rows.select("t", analyzer.tokens(F.col("t")).alias("a"), analyzer.offsets(F.col("t")).alias("b")).collect():
            expected = analyzer.analyze(r.t)
            assert [(x.term, x.pos) for x in r.a] == [(x.term, x.pos) for x in expected]
            assert [(x.term, x.pos, x.start, x.end) for x in r.b] == [(x.term, x.pos, x.start, x.end) for x in expected]


def test_null_text_has_null_tokens(spark):
    row = spark.createDataFrame([(None,)], "t string").select(PLAIN.tokens(F.col("t")).alias("a")).first()
    assert row.a is None


def test_stop_words_keep_positions():
    assert len(STOP_WORDS) == 177
    assert shown(StandardAnalyzer().analyze("the quick brown fox")) == "quick@1 brown@2 fox@3"
    assert shown(StandardAnalyzer().analyze("out of the box")) == "box@3"


def test_offsets_are_bytes():
    assert [(t.start, t.end) for t in PLAIN.analyze("Go语言search")] == [(0, 2), (2, 5), (5, 8), (8, 14)]
    for text in TEXTS:
        for t in PLAIN.analyze(text):
            assert PLAIN.analyze(text.encode()[t.start : t.end].decode())[0].term == t.term


def test_chinese_analyzer(spark):
    words = "全文\n搜索\n服务\n大学生\n大学\n学生\n语言 500 # a comment\n"
    analyzer = ChineseAnalyzer.from_text(words)
    assert shown(analyzer.analyze("大学生")) == "大学生@0 大学@0 学生@0"
    assert shown(analyzer.analyze("第 2024 年")) == "2024@1"
    assert shown(analyzer.analyze("全文搜索服务 Go语言")) == "全文@0 搜索@1 服务@2 go@3 语言@4"
    assert shown(ChineseAnalyzer.from_text(words, sub_words=False).analyze("大学生")) == "大学生@0"
    rows = spark.createDataFrame([("大学生用Go语言",), (None,)], "t string").select(analyzer.tokens(F.col("t")).alias("a")).collect()
    assert [(x.term, x.pos) for x in rows[0].a] == [(t.term, t.pos) for t in analyzer.analyze("大学生用Go语言")]
    assert rows[1].a is None


def test_highlight():
    whole = Highlighter(max_length=0)
    snippet = lambda text, *terms: whole.snippet(text, set(terms), KEEP_ALL)
    assert snippet("the there theory", "the") == "<em>the</em> there theory"
    assert snippet("don't stop", "don't") == "<em>don&#39;t</em> stop"
    assert snippet('a & b "quoted" tag', "tag") == "a &amp; b &#34;quoted&#34; <em>tag</em>"
    assert snippet("nothing here", "absent") == ""
    text = "好" * 30 + " target " + "好" * 30
    cut = Highlighter(max_length=40).snippet(text, {"target"}, KEEP_ALL)
    assert cut.startswith("…") and cut.endswith("…") and "<em>target</em>" in cut and "�" not in cut


def test_highlight_of_words_inside_words():
    analyzer = ChineseAnalyzer.from_text("全文搜\n全文\n文搜\n")
    mark = lambda *terms: Highlighter(max_length=0).snippet("全文搜索", set(terms), analyzer)
    assert mark("全文搜", "全文", "文搜") == "<em>全文搜</em>索"
    assert mark("全文", "文搜") == "<em>全文</em>搜索" and mark("文搜") == "全<em>文搜</em>索"


@pytest.mark.parametrize("length", [1, 7, 20, 33, 400])
def test_highlight_window(length):
    """Whole characters, at most three bytes more than asked for on either side; marked words lie inside."""
    text = "é好" * 9 + " tag <b> " + "语é" * 9 + " tag"
    cut = Highlighter("[", "]", length).snippet(text, {"tag"}, KEEP_ALL)
    plain = cut.strip("…").replace("[", "").replace("]", "").replace("&lt;", "<").replace("&gt;", ">")
    assert plain in text and len(plain.encode()) <= min(length + 6, len(text.encode())) and cut.count("[") <= 2
    assert cut.startswith("…") is not text.startswith(plain) and cut.endswith("…") is not text.endswith(plain)


def test_highlight_in_the_jvm_equals_python(spark):
    from quillon.functions.analysis import fold, gaps, raw_tokens

    texts = ["a & b Tag 'tag' <x>", "no match", "", "标签tag"]
    text = F.col("t")
    column = Highlighter().catalyst(text, ["tag", "标"], raw_tokens(text), gaps(text), F.transform(raw_tokens(text), fold))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", column.alias("s")).collect()
    assert all(r.s == Highlighter(max_length=0).snippet(r.t, {"tag", "标"}, KEEP_ALL) for r in rows)
