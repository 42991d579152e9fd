"""The queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions.analysis import term_count
from quillon.llm import bpe, distinctiveness, frequency, lookalikes, mixing, mojibake, near_duplicates, segmentation
from quillon.plans.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return segmentation.oversized_articles(table(spark, folder, "articles"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return segmentation.split_articles(table(spark, folder, "articles"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinctiveness.most_marking_terms(table(spark, folder, "articles"), table(spark, folder, "postings"))


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctiveness.scored_terms(table(spark, folder, "articles"), table(spark, folder, "postings")).select("doc_id", "term", "score")


def p3_field_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every posting of a live article, titles too; ``p3_scores`` has those of the bodies, as its SQL."""
    return distinctiveness.scored_postings(table(spark, folder, "articles"), table(spark, folder, "postings")).select("doc_id", "field", "term", "score")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.marked_terms(table(spark, folder, "tokens"), table(spark, folder, "articles"))


def p4_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, folder, "tokens"), table(spark, folder, "articles"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.same_looking_pairs(table(spark, folder, "articles"))


def p5_titles(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.same_looking_titles(table(spark, folder, "articles"))


def p5_looks(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and bodies by look: the first article of each look of a title, and of a body."""
    one = lambda rows, name: rows.select("doc_id", F.lit(name).alias("field"), F.min("doc_id").over(Window.partitionBy(F.xxhash64("form"), F.md5("form"))).alias("first"))
    return one(p5_titles(spark, folder), "title").unionByName(one(p5_bodies(spark, folder), "body"))


def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    bodies = lookalikes.live_articles(table(spark, folder, "articles"), "body").where(F.col("body").isNotNull())
    return lookalikes.canonical_texts(bodies, "doc_id", "body")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "tokens").where(F.col("term").isNotNull()).select(F.col("term").alias("word"))
    return lookalikes.canonical_words(words, lowered=True)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, folder, "tokens"), table(spark, folder, "articles"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, folder, "tokens"), table(spark, folder, "articles"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe.Tokenizer(spark)
    documents = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return documents.select("doc_id", (tokenizer.text(tokenizer.ids(F.col("text"))) == F.col("text")).alias("same"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_texts(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_kept_rules(spark: SparkSession, folder: str) -> DataFrame:
    """By source: texts used are texts of it, none beyond its cap, and the share wanted is reached or all that the cap allows is in."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    copies, report = mixing.mix(documents, targets)
    own = documents.select("doc_id", F.col("source").alias("own"))
    used = copies.join(own, "doc_id").groupBy("source").agg(F.bool_and(F.col("source") == F.col("own")).alias("own"), F.max("n_tokens").alias("largest"))
    near = F.abs(F.col("tokens") - F.col("target_tokens")) <= 0.01 * F.col("target_tokens") + F.coalesce("largest", F.lit(0))
    return report.join(used, "source", "left").select("source", F.coalesce("own", F.lit(True)).alias("own"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), near.alias("reached"))


def p2_kept_rules(spark: SparkSession, folder: str) -> DataFrame:
    """By article: its terms, those of its pieces without their overlaps, and whether sizes, overlaps and order are as asked for."""
    pieces = segmentation.split_articles(table(spark, folder, "articles"))
    after = F.lead("first_term").over(Window.partitionBy("doc_id").orderBy("piece"))
    linked = pieces.withColumn("next", after)
    return linked.groupBy("doc_id").agg(
        F.sum(F.col("n_terms") - F.col("overlap")).alias("terms"),
        (F.max("n_terms") <= segmentation.LIMIT).alias("small"),
        (F.count("*") == F.max("n_pieces")).alias("numbered"),
        F.bool_and(F.col("overlap") == F.when(F.col("piece") > F.lit(0), segmentation.OVERLAP).otherwise(0)).alias("overlapping"),
        F.bool_and(F.coalesce(F.col("next") == F.col("first_term") + F.col("n_terms") - segmentation.OVERLAP, F.lit(True))).alias("joined"),
        F.sum(F.greatest(F.lit(0), term_count(F.col("text")) - F.col("overlap"))).alias("terms_in_texts"),
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, folder, "documents"))


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restore_documents(table(spark, folder, "documents")).where("garbled")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_pieces, p2_kept_rules, p3_found, p3_scores, p3_field_scores, p4_found, p4_frequencies, p5_found, p5_titles, p5_bodies, p5_looks, p5_terms, p6_found, p6_classes, p7_ids, p7_roundtrip, p8_mix, p8_shares, p8_kept_rules, p9_found, p9_restored)
}

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"


def _term_count(column: str) -> str:
    spaced = rf"regexp_replace({column}, '([{_CJK}])', ' \1 ', 'g')"
    return rf"coalesce(len(regexp_extract_all({spaced}, '[\p{{L}}\p{{Nd}}]+(?:[''’][\p{{L}}\p{{Nd}}]+)*')), 0)"


# Fixed values of the SQL of look-alike titles, written on its own: spaces, ligatures, ignorable characters.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# Cyrillic and Greek letters and the Latin ones they look like, as far as titles can have them.
_CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӏӀ", "ABESIJKMHOPCTYXaeopcyxsijhdqwlI")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονραι", "ABEZHIKMNOPTYXovpai")
_IGNORABLE = r"[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}]"


def _form(column: str) -> str:
    """A title's look as SQL: ignorable characters out, spaces alike, full-width folded, look-alike letters replaced."""
    sql = f"regexp_replace({column}, '{_IGNORABLE}', '', 'g')"
    for ligature, letters in _LIGATURES.items():
        sql = f"replace({sql}, '{ligature}', '{letters}')"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    letters = {**dict(zip(*_CYRILLIC)), **dict(zip(*_GREEK)), "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï"}
    letters |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}  # radicals used as characters
    for old, new in ((_SPACES, " " * len(_SPACES)), (wide, narrow), ("".join(letters), "".join(letters.values()))):
        sql = f"translate({sql}, '{old}', '{new}')"
    return f"nfc_normalize({sql})"


_LIVE = "live AS (SELECT DISTINCT doc_id, title, body FROM articles)"
_SCORES = f"""
WITH {_LIVE},
p AS (SELECT DISTINCT doc_id, term, tf FROM postings WHERE field = 'body' AND doc_id IN (SELECT doc_id FROM live)),
n AS (SELECT count(*)::DOUBLE AS n FROM live WHERE body IS NOT NULL),
dl AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM p GROUP BY doc_id),
a AS (SELECT sum(dl) / (SELECT n FROM n) AS average FROM dl),
d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
s AS (SELECT doc_id, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)), 6) AS score
      FROM p JOIN d USING (term) JOIN dl USING (doc_id), n, a)
"""
_FIELD_SCORES = f"""
WITH {_LIVE},
p AS (SELECT DISTINCT doc_id, field, term, tf FROM postings WHERE doc_id IN (SELECT doc_id FROM live)),
n AS (SELECT 'title' AS field, count(title)::DOUBLE AS n FROM live UNION ALL SELECT 'body', count(body) FROM live),
dl AS (SELECT doc_id, field, sum(tf)::DOUBLE AS dl FROM p GROUP BY ALL),
a AS (SELECT field, n, sum(dl) / n AS average FROM dl JOIN n USING (field) GROUP BY field, n),
d AS (SELECT field, term, count(*)::DOUBLE AS df FROM p GROUP BY ALL)
SELECT doc_id, field, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)), 6) AS score
FROM p JOIN d USING (field, term) JOIN dl USING (doc_id, field) JOIN a USING (field)
"""
_FREQUENCIES = f"""
WITH {_LIVE},
t AS (SELECT DISTINCT doc_id, field, pos, term FROM tokens WHERE doc_id IN (SELECT doc_id FROM live)),
f AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS df FROM t GROUP BY field, term),
c AS (SELECT 'title' AS field, count(title) AS n FROM live UNION ALL SELECT 'body', count(body) FROM live),
m AS (SELECT field, term, occurrences, df, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.25 * n THEN 'common' END AS mark FROM f JOIN c USING (field))
"""

_RUNS = """t AS (SELECT DISTINCT doc_id, pos, term FROM tokens WHERE field = 'body' AND doc_id IN (SELECT doc_id FROM articles)),
        r AS (SELECT doc_id, term AS t1, lead(term) OVER w AS t2, lead(term, 2) OVER w AS t3 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        s AS (SELECT DISTINCT doc_id, t1, t2, t3 FROM r WHERE t3 IS NOT NULL),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k FROM s a JOIN s b USING (t1, t2, t3) WHERE a.doc_id < b.doc_id GROUP BY ALL)"""
_PAIRS = "SELECT doc_a, doc_b FROM b JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE k >= 0.6 * (x.n + y.n - k)"

ORACLES: dict[str, str] = {
    "p2_found": f"WITH {_LIVE} SELECT doc_id FROM live WHERE {_term_count('title')} + {_term_count('body')} > 400",
    "p3_found": f"{_SCORES} SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rn FROM s WHERE df >= 2) WHERE rn = 1",
    "p3_scores": f"{_SCORES} SELECT doc_id, term, score FROM s",
    "p3_field_scores": _FIELD_SCORES,
    "p4_found": f"{_FREQUENCIES} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p4_frequencies": f"{_FREQUENCIES} SELECT field, term, occurrences, df, mark FROM m",
    "p5_found": f"""
        WITH f AS (SELECT DISTINCT doc_id, title, {_form("title")} AS form FROM articles WHERE title IS NOT NULL)
        SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b USING (form) WHERE a.doc_id < b.doc_id AND a.title <> b.title""",
    "p5_looks": f"""
        WITH {_LIVE}, f AS (SELECT doc_id, 'title' AS field, {_form("title")} AS form FROM live WHERE title IS NOT NULL UNION ALL SELECT doc_id, 'body', {_form("body")} FROM live WHERE body IS NOT NULL)
        SELECT doc_id, field, min(doc_id) OVER (PARTITION BY field, form) AS first FROM f""",
    "p6_found": f"WITH {_RUNS} {_PAIRS}",
    "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p2_kept_rules": f"WITH {_LIVE}, n AS (SELECT doc_id, {_term_count('title')} + {_term_count('body')} AS n FROM live) SELECT doc_id, n AS terms, true AS small, true AS numbered, true AS overlapping, true AS joined, n AS terms_in_texts FROM n",
    "p6_classes": f"""
        WITH {_RUNS}, k AS (SELECT doc_id, list(t1 || ' ' || t2 || ' ' || t3 ORDER BY t1, t2, t3) AS k FROM s GROUP BY doc_id),
        c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM k),
        l AS (SELECT x.class_id, count(*) AS links FROM ({_PAIRS}) p JOIN c x ON x.doc_id = doc_a JOIN c y ON y.doc_id = doc_b
              WHERE x.class_id <> y.class_id AND x.class_id = doc_a AND y.class_id = doc_b GROUP BY x.class_id
              UNION ALL SELECT y.class_id, count(*) FROM ({_PAIRS}) p JOIN c x ON x.doc_id = doc_a JOIN c y ON y.doc_id = doc_b
              WHERE x.class_id <> y.class_id AND x.class_id = doc_a AND y.class_id = doc_b GROUP BY y.class_id)
        SELECT doc_id, class_id, coalesce((SELECT sum(links) FROM l WHERE l.class_id = c.class_id), 0)::BIGINT AS links FROM c""",
    "p8_kept_rules": "SELECT source, true AS own, true AS within_cap, true AS reached FROM mix_targets",
}
