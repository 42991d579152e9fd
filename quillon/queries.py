"""The registered queries of the engine, over whole tables, and their SQL.

``documents`` is searched as a collection with a text field, three keyword fields, a number and a date. It is analysed
and indexed once per session and folder; all queries share the stored tokens and postings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.analysis import KEEP_ALL, STOP_WORDS, StandardAnalyzer
from quillon.functions.highlight import Highlighter
from quillon.operators.changes import ChangeStore, current_documents
from quillon.operators.engine import Engine, Table
from quillon.operators.search import Collection
from quillon.plans.syntax import Bool, Term
from quillon.plans.tables import table
from quillon.plans.workspace import scratch_path
from quillon.sources.corpus import read_folder

DOCUMENT_KINDS = {"text": "text", "lang": "keyword", "source": "keyword", "origin": "keyword", "n_chars": "number", "added_at": "date"}
PART_KINDS = {"p_name": "text", "p_type": "text", "p_brand": "keyword", "p_size": "number", "p_retailprice": "number"}
ORDER_KINDS = {"o_orderstatus": "keyword", "o_orderpriority": "keyword", "o_totalprice": "number", "o_orderdate": "date"}
_ready: dict[tuple[str, str], Collection] = {}


def documents(spark: SparkSession, folder: str) -> Collection:
    """The indexed collection of a folder's documents."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _ready:
        docs = table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), *DOCUMENT_KINDS)
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _ready[key] = Collection(docs, DOCUMENT_KINDS).prepare(scratch_path(spark, "documents"), width).with_index(scratch_path(spark, "postings"))
    return _ready[key]


def _typed(spark: SparkSession, folder: str, name: str, key: str, kinds: dict[str, str]) -> Collection:
    rows = table(spark, folder, name).select(F.col(key).alias("seq"), F.col(key).cast("string").alias("id"), *kinds)
    return Collection(rows, kinds)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _scored(df: DataFrame) -> DataFrame:
    return df.select("seq", F.round("score", 6).alias("score"))


def _all_hits(query: str | Bool, **options) -> Query:  # noqa: ANN003
    return lambda spark, folder: _scored(documents(spark, folder).search(query, **options).matches)


def _page(query: str, **options) -> Query:  # noqa: ANN003
    return lambda spark, folder: _scored(documents(spark, folder).search(query, **options).ranked)


# --- SQL building blocks: hits are (seq, score) ---

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _words(column: str) -> str:
    spaced = rf"regexp_replace({column}, '([{_CJK}])', ' \1 ', 'g')"
    found = rf"regexp_extract_all({spaced}, '[\p{{L}}\p{{Nd}}]+(?:[''’][\p{{L}}\p{{Nd}}]+)*')"
    return f"list_transform({found}, lambda x: lower(translate(replace(x, '’', ''''), '{_WIDE}', '{_NARROW}')))"


def _numbered(source: str, key: str, column: str) -> str:
    inner = f"SELECT {key} AS seq, {_words(column)} AS ts FROM {source} WHERE {column} IS NOT NULL"
    return f"SELECT seq, ts[i] AS term, (i - 1)::INT AS pos FROM (SELECT seq, ts, unnest(range(1, len(ts) + 1)) AS i FROM ({inner}))"


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_KEEP = rf"(regexp_full_match(term, '[{_CJK}]') OR (length(term) >= 2 AND term NOT IN ({_STOP})))"
_KEYWORDS = ("lang", "source", "origin")
_TOKENS = (
    f"tok AS MATERIALIZED (SELECT seq, 'text' AS field, term, pos FROM ({_numbered('documents', 'doc_id', 'text')}) WHERE {_KEEP}"
    + "".join(f" UNION ALL SELECT doc_id, '{k}', lower(trim({k})), 0 FROM documents WHERE trim({k}) <> ''" for k in _KEYWORDS)
    + "), len AS (SELECT seq, field, count(*) AS dl FROM tok GROUP BY ALL), "
    + "fs AS (SELECT field, n::DOUBLE AS n, (SELECT count(*) FROM tok WHERE tok.field = x.field) / n::DOUBLE AS average FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS field, count({k}) AS n FROM documents" for k in ("text", *_KEYWORDS))
    + ") x)"
)
_SCORE = "idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))"


def _idf(term: str) -> str:
    return f"(SELECT field, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT field, count(DISTINCT seq) AS df FROM tok WHERE term = '{term}' GROUP BY field) JOIN fs USING (field))"


def _term(term: str, fields: tuple[str, ...] = ()) -> str:
    among = f" AND field IN ({', '.join(repr(f) for f in fields)})" if fields else ""
    tf = f"(SELECT seq, field, count(*) AS tf FROM tok WHERE term = '{term}'{among} GROUP BY ALL)"
    return f"SELECT seq, sum({_SCORE}) AS score FROM {tf} JOIN {_idf(term)} USING (field) JOIN len USING (seq, field) JOIN fs USING (field) GROUP BY seq"


def _phrase(*terms: tuple[str, int]) -> str:
    joins = "".join(f" JOIN tok t{k} ON t{k}.seq = t0.seq AND t{k}.field = t0.field AND t{k}.pos = t0.pos + {step} AND t{k}.term = '{t}'" for k, (t, step) in enumerate(terms) if k)
    tf = f"(SELECT t0.seq, t0.field, count(*) AS tf FROM tok t0{joins} WHERE t0.term = '{terms[0][0]}' GROUP BY ALL)"
    idf = "(SELECT field, sum(idf) AS idf FROM (" + " UNION ALL ".join(f"SELECT * FROM {_idf(t)}" for t, _ in terms) + ") GROUP BY field)"
    return f"SELECT seq, sum({_SCORE}) AS score FROM {tf} JOIN {idf} USING (field) JOIN len USING (seq, field) JOIN fs USING (field) GROUP BY seq"


def _rows(condition: str = "true") -> str:
    return f"SELECT doc_id AS seq, 0.0::DOUBLE AS score FROM documents WHERE {condition}"


def _or(*hits: str) -> str:
    return "SELECT seq, sum(score) AS score FROM (" + " UNION ALL ".join(f"({h})" for h in hits) + ") GROUP BY seq"


def _and(a: str, b: str) -> str:
    return f"SELECT a.seq, a.score + b.score AS score FROM ({a}) a JOIN ({b}) b USING (seq)"


def _minus(a: str, b: str) -> str:
    return f"SELECT * FROM ({a}) WHERE seq NOT IN (SELECT seq FROM ({b}))"


def _boost(a: str, b: str) -> str:
    return f"SELECT a.seq, a.score + coalesce(b.score, 0) AS score FROM ({a}) a LEFT JOIN ({b}) b USING (seq)"


def _hits(sql: str, tail: str = "") -> str:
    return f"WITH {_TOKENS}, h AS ({sql}) SELECT seq, round(score, 6) AS score FROM h JOIN documents d ON d.doc_id = h.seq {tail}"


_TOP = "ORDER BY h.score DESC, seq LIMIT 10"
_register("term_bm25", _page("planner"), _hits(_term("planner"), _TOP))
_register("term_all_hits", _all_hits("planner"), _hits(_term("planner")))
_register("term_multi_field", _all_hits("catalog"), _hits(_term("catalog")))
_register("term_fields", _all_hits("catalog", fields=["source", "nope"]), _hits(_term("catalog", ("source",))))
_register("term_or", _all_hits("planner quota"), _hits(_or(_term("planner"), _term("quota"))))
_register("term_and", _all_hits("planner AND quota"), _hits(_and(_term("planner"), _term("quota"))))
_register("default_and", _all_hits("planner quota", default_and=True), _hits(_and(_term("planner"), _term("quota"))))
_register("term_must_not", _all_hits("planner -quota"), _hits(_minus(_term("planner"), _term("quota"))))
_register("only_negative", _all_hits("-planner"), _hits(_minus(_rows(), _term("planner"))))
_register("or_with_negative", _all_hits("quota OR -planner"), _hits(_or(_term("quota"), _minus(_rows(), _term("planner")))))
_register("should_boost", _all_hits(Bool(must=[Term("planner")], should=[Term("quota")])), _hits(_boost(_term("planner"), _term("quota"))))
_register("grouping", _all_hits("(planner OR quota) AND index"), _hits(_and(_or(_term("planner"), _term("quota")), _term("index"))))
_register("precedence", _all_hits("planner quota AND index"), _hits(_and(_and(_term("planner"), _term("quota")), _term("index"))))
_register("phrase", _all_hits('"kurze Felder"'), _hits(_phrase(("kurze", 0), ("felder", 1))))
_register("phrase_gap", _all_hits('"column of the list" "catalog of the counter"'), _hits(_or(_phrase(("column", 0), ("list", 3)), _phrase(("catalog", 0), ("counter", 3)))))
_register("split_word_phrase", _all_hits("Kurze-Felder", fields=["text"]), _hits(_phrase(("kurze", 0), ("felder", 1))))
_register("cjk_phrase", _all_hits("倒排表"), _hits(_phrase(("倒", 0), ("排", 1), ("表", 2))))
_register("field_text", _all_hits("text:planner", fields=["lang"]), _hits(_term("planner", ("text",))))
_register("keyword_exact", _all_hits("lang:EN"), _hits(_term("en", ("lang",))))
_register("number_eq", _all_hits("n_chars:459"), _hits(_rows("n_chars = 459")))
_register("range_closed", _all_hits("n_chars:[459 TO 514]"), _hits(_rows("n_chars BETWEEN 459 AND 514")))
_register("range_open", _all_hits("n_chars:{459 TO 514}"), _hits(_rows("n_chars > 459 AND n_chars < 514")))
_register("range_half", _all_hits("n_chars:[459 TO 514}"), _hits(_rows("n_chars >= 459 AND n_chars < 514")))
_register("range_unbounded", _all_hits("n_chars:[* TO 500]"), _hits(_rows("n_chars <= 500")))
_register("range_reversed_is_empty", _all_hits("n_chars:[500 TO 100]"), _hits(_rows("false")))
_register("compare_ops", _all_hits("n_chars:>459 AND n_chars:<=514"), _hits(_rows("n_chars > 459 AND n_chars <= 514")))
_register("date_range", _all_hits("added_at:[2031-03-02 TO 2031-03-05T12:00:00Z]"), _hits(_rows("date_trunc('millisecond', added_at) BETWEEN '2031-03-02' AND '2031-03-05 12:00:00'")))
_register("date_compare", _all_hits("added_at:>2031-03-05"), _hits(_rows("date_trunc('millisecond', added_at) > '2031-03-05'")))
_register("range_and_text", _all_hits("planner AND n_chars:[100 TO 2000]"), _hits(_and(_term("planner"), _rows("n_chars BETWEEN 100 AND 2000"))))
_register("range_or_text_zero_score", _all_hits("planner OR n_chars:<100"), _hits(_or(_term("planner"), _rows("n_chars < 100"))))
_register("stopword_and_empty", _all_hits("planner AND the"), _hits(_rows("false")))
_register("sort_number_nulls_last", _page("planner", sort="n_chars:desc", limit=100), _hits(_term("planner"), "ORDER BY n_chars DESC NULLS LAST, seq LIMIT 100"))
_register("sort_date_desc", _page("quota", sort="added_at:desc", limit=50), _hits(_term("quota"), "ORDER BY added_at DESC NULLS LAST, seq LIMIT 50"))
_register("sort_keyword_multi", _page("planner", sort="lang:asc,source:desc,n_chars", limit=100), _hits(_term("planner"), "ORDER BY lang NULLS LAST, source DESC NULLS LAST, n_chars NULLS LAST, seq LIMIT 100"))
_register("page_offset", _page("planner quota", limit=20, offset=40), _hits(_or(_term("planner"), _term("quota")), "ORDER BY h.score DESC, seq LIMIT 20 OFFSET 40"))
_register("scan_mode", _all_hits('"inverted index" planner -quota', mode="scan"), _hits(_minus(_or(_phrase(("inverted", 0), ("index", 1)), _term("planner")), _term("quota"))))


def total_hits(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).search("planner quota").matches.agg(F.count("*").alias("total"))


_register("total_hits", total_hits, f"WITH {_TOKENS} SELECT count(*) AS total FROM ({_or(_term('planner'), _term('quota'))})")

# --- analysis and index ---


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.array_join(KEEP_ALL.tokens(F.col("text"))["term"], " ").alias("terms"))


_register("tokens", tokens, f"SELECT doc_id, array_to_string({_words('text')}, ' ') AS terms FROM documents")


def token_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.inline(StandardAnalyzer().tokens(F.col("text"))))
    return rows.select(F.col("doc_id").alias("seq"), "term", "pos")


_register("token_positions", token_positions, f"SELECT seq, term, pos FROM ({_numbered('documents', 'doc_id', 'text')}) WHERE {_KEEP}")


def made_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Byte offsets of every word of titles and bodies, also of those that the table of tokens has no offsets for."""
    articles = table(spark, folder, "articles").select("doc_id", "title", "body").dropDuplicates(["doc_id"])
    fields = F.array(*(F.struct(F.lit(f).alias("field"), KEEP_ALL.offsets(F.col(f)).alias("t")) for f in ("title", "body")))
    made = articles.select("doc_id", F.inline(fields)).select("doc_id", "field", F.inline("t"))
    return made.select("doc_id", "field", "pos", "term", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


def token_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Those of ``made_offsets`` that the table of tokens has too, for the comparison with it."""
    stored = table(spark, folder, "tokens").where("start_byte IS NOT NULL AND end_byte IS NOT NULL").select("doc_id", "field", "pos").distinct()
    return made_offsets(spark, folder).join(stored, ["doc_id", "field", "pos"], "left_semi")


_register(
    "token_offsets",
    token_offsets,
    "SELECT DISTINCT doc_id, field, pos, term, start_byte, end_byte FROM tokens WHERE start_byte IS NOT NULL AND end_byte IS NOT NULL AND doc_id IN (SELECT doc_id FROM articles)",
)


def postings_tf(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).index.postings.select("field", "term", "seq", "tf")


_register("postings_tf", postings_tf, f"WITH {_TOKENS} SELECT field, term, seq, count(*)::INT AS tf FROM tok GROUP BY ALL")


def posting_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).index.lookup([("text", "planner")])
    return rows.select("seq", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


_register("posting_scan", posting_scan, f"WITH {_TOKENS} SELECT seq, count(*)::INT AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM tok WHERE field = 'text' AND term = 'planner' GROUP BY seq")


def posting_ids(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).index.lookup([("text", "quota")]).select("seq")


_register("posting_ids", posting_ids, f"WITH {_TOKENS} SELECT DISTINCT seq FROM tok WHERE field = 'text' AND term = 'quota'")


def posting_point(spark: SparkSession, folder: str) -> DataFrame:
    """The posting of a term in one document: the first that has it."""
    index = documents(spark, folder).index
    first = index.lookup([("text", "planner")]).agg(F.min("seq")).first()[0]
    return index.point("text", "planner", first).select("seq", "tf", "length")


_register("posting_point", posting_point, f"WITH {_TOKENS} SELECT seq, count(*)::INT AS tf, any_value(dl)::INT AS length FROM tok JOIN len USING (seq, field) WHERE field = 'text' AND term = 'planner' GROUP BY seq ORDER BY seq LIMIT 1")


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).index.lists.select("field", "term", "df")


_register("doc_freq", doc_freq, f"WITH {_TOKENS} SELECT field, term, count(DISTINCT seq) AS df FROM tok GROUP BY ALL")


def field_stats(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).field_stats().withColumn("avg_length", F.round("avg_length", 6))


_register("field_stats", field_stats, f"WITH {_TOKENS} SELECT field, n::BIGINT AS docs, (SELECT count(*) FROM tok WHERE tok.field = fs.field) AS total_tokens, round(average, 6) AS avg_length FROM fs")


def table_stats(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).table_stats().withColumn("avg_doc_length", F.round("avg_doc_length", 6))


_register(
    "table_stats",
    table_stats,
    f"WITH {_TOKENS}, d AS (SELECT count(*) AS docs FROM documents) SELECT docs, (SELECT count(*) FROM fs WHERE n > 0) AS fields, (SELECT count(*) FROM (SELECT DISTINCT field, term FROM tok)) AS terms, (SELECT count(*) FROM tok) AS total_tokens, round((SELECT count(*) FROM tok) / docs::DOUBLE, 6) AS avg_doc_length FROM d",
)


def doc_length(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).with_tokens()
    return rows.select("seq", F.greatest(F.size("_t_text"), F.lit(0)).alias("length"))


_register("doc_length", doc_length, f"WITH {_TOKENS} SELECT doc_id AS seq, coalesce(dl, 0)::INT AS length FROM documents LEFT JOIN len ON len.seq = doc_id AND field = 'text'")


def facet(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).facet("lang")


_register("facet", facet, "SELECT lang AS value, count(*) AS docs FROM documents GROUP BY lang")

# --- typed collections ---


def numeric_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(_typed(spark, folder, "part", "p_partkey", PART_KINDS).search("p_retailprice:[950.5 TO 1200} AND p_size:>10").matches)


_register("numeric_scan", numeric_scan, "SELECT p_partkey AS seq, 0.0::DOUBLE AS score FROM part WHERE p_retailprice >= 950.5 AND p_retailprice < 1200 AND p_size > 10")


def orders_page(spark: SparkSession, folder: str) -> DataFrame:
    found = _typed(spark, folder, "orders", "o_orderkey", ORDER_KINDS).search("o_orderdate:[1995-01-01 TO 1995-12-31] AND o_totalprice:>1000", sort="o_orderpriority,o_totalprice:desc", limit=100)
    return _scored(found.ranked)


_register(
    "orders_page",
    orders_page,
    "SELECT o_orderkey AS seq, 0.0::DOUBLE AS score FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < TIMESTAMP '1995-12-31 00:00:00.001' AND o_totalprice > 1000 ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100",
)


def point_get(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup by external id: the first id of the table."""
    docs = documents(spark, folder).docs
    return docs.where(F.col("id") == F.trim(docs.agg(F.min("id")).scalar())).select("id", "lang", "n_chars")


_register("point_get", point_get, "SELECT doc_id::VARCHAR AS id, lang, n_chars FROM documents WHERE doc_id::VARCHAR = (SELECT min(doc_id::VARCHAR) FROM documents)")


def hydrated_page(spark: SparkSession, folder: str) -> DataFrame:
    hits = documents(spark, folder).search("planner").hits()
    return hits.select("id", F.round("score", 6).alias("score"), F.element_at("fields", "text").alias("text"))


_register("hydrated_page", hydrated_page, _hits(_term("planner"), _TOP).replace("SELECT seq, round(score, 6) AS score", "SELECT seq::VARCHAR AS id, round(score, 6) AS score, text"))


def highlight(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).search("planner quota").hits(highlight=True).select("rank", "id", F.element_at("highlights", "text").alias("snippet"))


def highlight_whole(spark: SparkSession, folder: str) -> DataFrame:
    """All texts with a term, marked as a whole inside the JVM."""
    from quillon.functions.analysis import fold, gaps, raw_tokens

    text = F.col("text")
    marked = Highlighter().catalyst(text, ["planner"], raw_tokens(text), gaps(text), F.transform(raw_tokens(text), fold))
    return table(spark, folder, "documents").select("doc_id", marked.alias("snippet")).where("snippet <> ''")


# A private-use character stands around each CJK character while a text is cut, so that it is a word of its own.
_ASIDE = chr(0xE000)
_ANY_WORD = r"[\p{L}\p{Nd}]+(?:[''’][\p{L}\p{Nd}]+)*"


def _folded(word: str) -> str:
    return f"lower(translate(replace({word}, '’', ''''), '{_WIDE}', '{_NARROW}'))"


def _html(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return text


def _cut(source: str) -> str:
    """Gaps and words by turns (``piece``, in order of ``i``) of the ``text`` of each row of ``source``."""
    aside = rf"regexp_replace(text, '([{_CJK}])', '{_ASIDE}\1{_ASIDE}', 'g')"
    lists = f"SELECT *, regexp_extract_all(x, '{_ANY_WORD}') AS ws, string_split_regex(x, '{_ANY_WORD}') AS gs FROM (SELECT *, {aside} AS x FROM {source})"
    numbered = f"SELECT *, unnest(range(1, 2 * len(ws) + 2)) AS i FROM ({lists})"
    return f"SELECT * EXCLUDE (x, ws, gs), replace(CASE WHEN i % 2 = 1 THEN gs[(i + 1) // 2] ELSE ws[i // 2] END, '{_ASIDE}', '') AS piece FROM ({numbered})"


_SNIPPETS = f"""
WITH {_TOKENS}, h AS ({_or(_term('planner'), _term('quota'))}),
page AS (SELECT row_number() OVER (ORDER BY h.score DESC, seq) - 1 AS rank, doc_id, text FROM h JOIN documents d ON d.doc_id = h.seq ORDER BY h.score DESC, seq LIMIT 10),
pieces AS (SELECT *, octet_length(encode(piece)) AS bytes, i % 2 = 0 AND {_folded('piece')} IN ('planner', 'quota') AS marked FROM ({_cut('page')})),
placed AS (SELECT *, sum(bytes) OVER (PARTITION BY rank ORDER BY i) - bytes AS start, sum(bytes) OVER (PARTITION BY rank) AS size FROM pieces),
framed AS (SELECT *, CASE WHEN size <= 160 THEN 0 ELSE greatest(0, least(min(CASE WHEN marked THEN start END) OVER (PARTITION BY rank) - 40, size - 160)) END AS low FROM placed),
chars AS (SELECT *, substr(piece, k, 1) AS c, start + octet_length(encode(substr(piece, 1, k - 1))) AS place FROM (SELECT *, unnest(range(1, length(piece) + 1)) AS k FROM framed)),
shown AS (SELECT *, min(place) OVER w AS head, max(place + octet_length(encode(c))) OVER w AS tail FROM chars WHERE place + octet_length(encode(c)) > low AND place < low + 160 WINDOW w AS (PARTITION BY rank)),
done AS (SELECT *, marked AND start >= head AND start + bytes <= tail AS whole FROM shown)
SELECT rank::INT AS rank, doc_id::VARCHAR AS id,
    CASE WHEN any_value(head) > 0 THEN '…' ELSE '' END
    || string_agg(CASE WHEN whole AND k = 1 THEN '<em>' ELSE '' END || {_html('c')} || CASE WHEN whole AND k = length(piece) THEN '</em>' ELSE '' END, '' ORDER BY i, k)
    || CASE WHEN any_value(tail) < any_value(size) THEN '…' ELSE '' END AS snippet
FROM done GROUP BY rank, doc_id
"""
_register("highlight", highlight, _SNIPPETS)
_register(
    "highlight_whole",
    highlight_whole,
    f"""WITH p AS (SELECT doc_id, i, {_html('piece')} AS shown, i % 2 = 0 AND {_folded('piece')} = 'planner' AS marked FROM ({_cut('(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)')}))
    SELECT doc_id, string_agg(CASE WHEN marked THEN '<em>' || shown || '</em>' ELSE shown END, '' ORDER BY i) AS snippet FROM p GROUP BY doc_id HAVING bool_or(marked)""",
)

_FIELDS = "(SELECT DISTINCT doc_id, 'title' AS field, title AS text FROM articles WHERE title IS NOT NULL UNION ALL SELECT DISTINCT doc_id, 'body', body FROM articles WHERE body IS NOT NULL)"
_register(
    "made_offsets",
    made_offsets,
    f"""WITH p AS (SELECT *, octet_length(encode(piece)) AS bytes FROM ({_cut(_FIELDS)})),
    placed AS (SELECT *, sum(bytes) OVER (PARTITION BY doc_id, field ORDER BY i) AS stop FROM p)
    SELECT doc_id, field, (i // 2 - 1)::INT AS pos, {_folded('piece')} AS term, (stop - bytes)::INT AS start_byte, stop::INT AS end_byte FROM placed WHERE i % 2 = 0""",
)

# --- change log ---


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return current_documents(table(spark, folder, "changelog")).select("tbl", "external", "seq")


def p1_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The live documents with their fields, one row per field."""
    return current_documents(table(spark, folder, "changelog")).select("tbl", "external", F.explode("doc_fields").alias("name", "value"))


def compaction_state(spark: SparkSession, folder: str) -> DataFrame:
    """The live documents by table after the feed was appended in runs and compacted."""
    store = ChangeStore.open(spark, scratch_path(spark, "compaction")).append(table(spark, folder, "changelog"), F.date_format("received_at", "yyyyMMdd")).compact()
    return store.live().groupBy("tbl").agg(F.count("*").alias("docs"), F.max("seq").alias("last_seq"))


# The code points of Unicode White_Space.
_WHITE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LIVE = rf"""
    WITH c AS (SELECT tbl, regexp_replace(external, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS external, seq, coalesce(deleted, false) AS deleted, doc_fields
               FROM changelog WHERE coalesce(cardinality(declared), 0) = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY tbl, external ORDER BY seq DESC, deleted DESC) AS rn FROM c WHERE external <> ''),
    live AS (SELECT * FROM r WHERE rn = 1 AND NOT deleted)"""

_register("p1_found", p1_found, f"{_LIVE} SELECT tbl, external, seq FROM live")
_register("p1_documents", p1_documents, f"{_LIVE} SELECT tbl, external, unnest(map_keys(doc_fields)) AS name, unnest(map_values(doc_fields)) AS value FROM live")
_register("compaction_state", compaction_state, f"{_LIVE} SELECT tbl, count(*) AS docs, max(seq) AS last_seq FROM live GROUP BY tbl")



def held_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as they were before the second half of the feed arrived and everything was compacted, twice."""
    feed = table(spark, folder, "changelog")
    half = feed.agg((F.min("rec_id") + F.max("rec_id")) / 2).first()[0]
    store = ChangeStore.open(spark, scratch_path(spark, "held")).append(feed.where(F.col("rec_id") <= half))
    held = store.live()
    store.compact().append(feed.where(F.col("rec_id") > half)).compact()
    return held.select("tbl", "external", "seq")


_register("held_snapshot", held_snapshot, f"{_LIVE} SELECT tbl, external, seq FROM live".replace("FROM changelog WHERE", "FROM changelog WHERE rec_id <= (SELECT (min(rec_id) + max(rec_id)) / 2.0 FROM changelog) AND"))

# --- sources ---


def folder_source(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies of all articles, written as text files in folders of their own and read as a corpus."""
    place = scratch_path(spark, "texts")
    texts = table(spark, folder, "articles").where("body <> ''").select("doc_id", "body").distinct()
    texts.repartition("doc_id").sortWithinPartitions("doc_id").write.partitionBy("doc_id").text(place)
    return read_folder(spark, place).select(F.md5(F.regexp_replace("body", r"\n\z", "")).alias("body"))


_register("folder_source", folder_source, "SELECT md5(body) AS body FROM (SELECT DISTINCT doc_id, body FROM articles WHERE body <> '')")

# --- tables of the engine ---


def _engine_table(spark: SparkSession, folder: str) -> Table:
    """Documents imported twice (once in effect), those in French written again with another source, and those of blogs deleted."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    found, rows = engine.create_table("documents", {"added_at": "date"}), table(spark, folder, "documents").withColumn("id", F.concat(F.lit(" "), "doc_id"))
    for _ in range(2):
        found.import_once("documents", rows.where(F.greatest(*(F.col(c).isNotNull() for c in DOCUMENT_KINDS))), DOCUMENT_KINDS)
    return found


def _edited(spark: SparkSession, folder: str, found: Table) -> Table:
    rows = table(spark, folder, "documents").withColumn("id", F.col("doc_id").cast("string"))
    found.upsert_frame(rows.where("lang = 'fr'").withColumn("source", F.lit("Edited planner")), DOCUMENT_KINDS)
    found.delete_frame(rows.where("source = 'blog' AND coalesce(lang, '') <> 'fr'"))
    return found


def engine_table(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a table after an import, changes and deletions, typed."""
    found = _edited(spark, folder, _engine_table(spark, folder))
    return found.collection().docs.select("id", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"), F.unix_millis("added_at").alias("added_ms"))


def engine_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search by an index that was built before the changes and deletions."""
    found = _engine_table(spark, folder)
    found.build_index()
    return _edited(spark, folder, found).search("planner").matches.select("id", F.round("score", 6).alias("score"))


_EDITED = "(SELECT * REPLACE (CASE WHEN lang = 'fr' THEN 'Edited planner' ELSE source END AS source) FROM documents WHERE NOT (coalesce(source, '') = 'blog' AND coalesce(lang, '') <> 'fr'))"
_register("engine_table", engine_table, f"SELECT doc_id::VARCHAR AS id, lang, source, n_chars, epoch_us(added_at) // 1000 AS added_ms FROM {_EDITED}")
_register("engine_search", engine_search, f"WITH edited AS {_EDITED}, {_TOKENS.replace('documents', 'edited')}, h AS ({_term('planner')}) SELECT seq::VARCHAR AS id, round(score, 6) AS score FROM h")

# --- streaming ---


def streamed_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The live documents after the feed arrived as a stream of files."""
    from quillon.streaming.ingest import ingest, stream_changes

    store = ChangeStore.open(spark, scratch_path(spark, "streamed"))
    place = f"{folder}/changelog.parquet"
    ingest(stream_changes(spark, place), store, scratch_path(spark, "checkpoint")).awaitTermination()
    return store.live().select("tbl", "external", "seq")


_register("streamed_changes", streamed_changes, f"{_LIVE} SELECT tbl, external, seq FROM live")

# --- more scalar pieces ---


def keyword_terms(spark: SparkSession, folder: str) -> DataFrame:
    from quillon.functions.analysis import keyword_term

    return table(spark, folder, "documents").select("doc_id", keyword_term(F.col("lang")).alias("lang"), keyword_term(F.col("source")).alias("source"))


def idf(spark: SparkSession, folder: str) -> DataFrame:
    """The inverse document frequency of every (field, term), as Column arithmetic over the index."""
    index = documents(spark, folder).index
    sizes = index.fields.select("field", F.col("docs").cast("double").alias("n"))
    joined = index.lists.join(F.broadcast(sizes), "field")  # a row per field, at most 32
    return joined.select("field", "term", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


CHINESE_WORDS = "倒排表\n入门\n关于\n分词器\n用法\n索引\n查询\n文档\n用户词表\n用户\n词表\n"


def chinese_tokens(spark: SparkSession, folder: str, words: str = CHINESE_WORDS) -> DataFrame:
    """Titles and bodies by the Chinese analyzer with a small dictionary."""
    from quillon.functions.analysis import ChineseAnalyzer

    analyzer = ChineseAnalyzer.from_text(words)
    fields = F.array(*(F.struct(F.lit(f).alias("field"), analyzer.tokens(F.col(f)).alias("t")) for f in ("title", "body")))
    return table(spark, folder, "articles").select("doc_id", F.inline(fields)).select("doc_id", "field", F.inline("t"))


def range_and_sort_without_text(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(documents(spark, folder).search("lang:fr AND n_chars:>1000 AND -source:manual", sort="n_chars:desc,origin", limit=60).ranked)


_register("keyword_terms", keyword_terms, "SELECT doc_id, nullif(lower(trim(lang)), '') AS lang, nullif(lower(trim(source)), '') AS source FROM documents")
_register("idf", idf, f"WITH {_TOKENS}, d AS (SELECT field, term, count(DISTINCT seq) AS df FROM tok GROUP BY ALL) SELECT field, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d JOIN fs USING (field)")
_register("limit_clamped", _page("planner quota", limit=10_000), _hits(_or(_term("planner"), _term("quota")), "ORDER BY h.score DESC, seq LIMIT 100"))
_register("page_beyond_end", _page("planner", offset=1_000_000_000), _hits(_rows("false")))
_register("nested_boolean", _all_hits('((planner OR quota) AND -index) OR "inverted index"'), _hits(_or(_minus(_or(_term("planner"), _term("quota")), _term("index")), _phrase(("inverted", 0), ("index", 1)))))
_register("postings_mode_range", _all_hits("planner OR n_chars:<100", mode="postings"), _hits(_or(_term("planner"), _rows("n_chars < 100"))))
_register(
    "range_and_sort_without_text",
    range_and_sort_without_text,
    _hits(_minus(_and(_term("fr", ("lang",)), _rows("n_chars > 1000")), _term("manual", ("source",))), "ORDER BY n_chars DESC NULLS LAST, origin NULLS LAST, seq LIMIT 60"),
)
_DICTIONARY = "|".join(sorted(CHINESE_WORDS.split(), key=len, reverse=True))
# No word of this dictionary ends as another begins, so the longest word at each place is the best segmentation.
_SEGMENTED = rf"regexp_extract_all(regexp_replace(text, '({_DICTIONARY}|[{_CJK}])', ' \1 ', 'g'), '{_ANY_WORD}')"
_register(
    "chinese_tokens",
    chinese_tokens,
    f"""WITH f AS (SELECT doc_id, 'title' AS field, title AS text FROM articles UNION ALL SELECT doc_id, 'body', body FROM articles),
    w AS (SELECT doc_id, field, ws[i] AS word, (i - 1)::INT AS pos FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, field, {_SEGMENTED} AS ws FROM f))),
    t AS (SELECT doc_id, field, {_folded('word')} AS term, pos FROM w UNION ALL SELECT doc_id, field, unnest(['用户', '词表']), pos FROM w WHERE word = '用户词表')
    SELECT * FROM t WHERE regexp_full_match(term, '[\\p{{Hiragana}}\\p{{Katakana}}]') OR (length(term) >= 2 AND term NOT IN ({_STOP}))""",
)
