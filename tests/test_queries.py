from __future__ import annotations

import pytest

from quillon.queries import ORACLES, QUERIES
from tests import oracle


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    oracle.check(spark, folder, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["seq", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


TEXTS = [(1, "Zoë’s index", "全文 search, ＧＯ lang"), (2, None, "don’t stop"), (3, "", None)]


def _tables(spark, folder):
    """Articles, each twice, and their tokens without offsets but for one."""
    from quillon.functions.analysis import KEEP_ALL

    found = [(d, f, t.pos, t.term, t.start, t.end) for d, title, body in TEXTS for f, x in (("title", title), ("body", body)) for t in KEEP_ALL.analyze(x or "")]
    spark.createDataFrame(TEXTS * 2, "doc_id long, title string, body string").write.parquet(f"{folder}/articles.parquet")
    stored = [(*r[:4], *(r[4:] if k == 0 else (None, None))) for k, r in enumerate(found)]
    spark.createDataFrame(stored, "doc_id long, field string, pos int, term string, start_byte int, end_byte int").write.parquet(f"{folder}/tokens.parquet")
    return found


def test_offsets_are_made_for_every_token(spark, tmp_path):
    """Also for those whose stored offsets are null."""
    found = _tables(spark, str(tmp_path))
    rows = QUERIES["made_offsets"](spark, str(tmp_path)).select("doc_id", "field", "pos", "term", "start_byte", "end_byte").collect()
    assert len(found) > 8 and sorted(map(tuple, rows)) == sorted(found)
    texts = {(d, f): x for d, title, body in TEXTS for f, x in (("title", title), ("body", body))}
    cut = {(r.field, r.pos): texts[r.doc_id, r.field].encode()[r.start_byte : r.end_byte].decode() for r in rows if r.doc_id == 1}
    assert cut == {("title", 0): "Zoë’s", ("title", 1): "index", ("body", 0): "全", ("body", 1): "文", ("body", 2): "search", ("body", 3): "ＧＯ", ("body", 4): "lang"}
    assert QUERIES["token_offsets"](spark, str(tmp_path)).count() == 1


def test_chinese_tokens_of_titles_and_bodies(spark, tmp_path):
    from quillon.functions.analysis import ChineseAnalyzer
    from quillon.queries import CHINESE_WORDS

    _tables(spark, str(tmp_path))
    for words in (CHINESE_WORDS, "全文\n"):
        analyzer = ChineseAnalyzer.from_text(words)
        expected = [(d, f, t.term, t.pos) for d, title, body in TEXTS * 2 for f, x in (("title", title), ("body", body)) for t in analyzer.analyze(x or "")]
        rows = QUERIES["chinese_tokens"](spark, str(tmp_path), words).select("doc_id", "field", "term", "pos").collect()
        assert sorted(map(tuple, rows)) == sorted(expected) and {r.field for r in rows} == {"title", "body"}
    assert (1, "body", "全文", 0) in map(tuple, rows)
