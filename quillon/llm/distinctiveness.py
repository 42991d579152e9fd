"""How distinctive a term is for a record: BM25-weighted inverse document frequency.

Term frequency, saturated and normalised by the record's length, times the smoothed logarithmic inverse document
frequency. Frequencies come from the distinct (record, field, term) counts, aggregated before each shuffle and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.articles import live_articles, live_ids
from quillon.plans.workspace import bucketed

K1, B = 1.2, 0.75
#: The fields of an article that postings are made of.
FIELDS = ("title", "body")
#: A term that holds more than this share of the rows is joined by broadcast: there are at most 1 / HOT of them.
HOT = 0.0005


def score(n: Column, df: Column, tf: Column, length: Column, average: Column) -> Column:
    """The weight of a term in a record, to 6 decimals."""
    rarity = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return F.round(rarity * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)), 6)


def scored_postings(articles: DataFrame, postings: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id, field, term, tf, df, score`` of each posting of a live article in ``fields``.

    Every field is a collection of its own: N, document frequencies, lengths and their average are kept by field. A
    posting counts once per (field, term, doc_id), whatever its repeats; postings of removed documents, with a null
    term or without occurrences count nothing. A field that no article has gives no rows.
    """
    usable = postings.where(F.col("field").isin(*fields) & F.col("term").isNotNull() & (F.col("tf") > 0)).select("doc_id", "field", "term", "tf")
    counts = usable.join(live_ids(articles), "doc_id", "left_semi").groupBy("doc_id", "field", "term").agg(F.max("tf").cast("double").alias("tf"))
    counts = bucketed(counts, "doc_id", "term_counts")  # read for every statistic below; sums by document need no shuffle
    with_field = F.struct(*(F.count(f).cast("double").alias(f) for f in fields))
    n = live_articles(articles, *fields).agg(with_field.alias("n")).scalar()
    sizes = {r.field: r for r in counts.groupBy("field").agg(F.count("*").alias("rows"), F.sum("tf").alias("total")).collect()}  # a row per field
    total = _by_field({f: F.lit(r.total) for f, r in sizes.items()})
    frequency = counts.groupBy("field", "term").agg(F.count("*").cast("double").alias("df"))
    # A column per field, so that the join is by document alone, as the rows lie.
    lengths = counts.groupBy("doc_id").agg(*(F.sum(F.when(F.col("field") == f, F.col("tf"))).alias(f"length_{f}") for f in fields))
    with_length = counts.join(lengths, "doc_id").select("doc_id", "field", "term", "tf", _by_field({f: F.col(f"length_{f}") for f in fields}).alias("length"))
    with_df = _join_frequency(with_length, frequency.withColumn("hot", F.col("df") > sum(r.rows for r in sizes.values()) * HOT))
    weighted = with_df.withColumn("n", _by_field({f: n.getField(f) for f in fields})).withColumn("average", F.try_divide(total, F.col("n")))
    return weighted.select("doc_id", "field", "term", "tf", "df", score(F.col("n"), F.col("df"), F.col("tf"), F.col("length"), F.col("average")).alias("score"))


def scored_terms(articles: DataFrame, postings: DataFrame, field: str = "body") -> DataFrame:
    """``doc_id, term, tf, df, score`` of each posting of a live article in one ``field``."""
    return scored_postings(articles, postings, (field,)).drop("field")


def _by_field(values: dict[str, Column]) -> Column:
    """The value of each row's field, null where it has none."""
    return F.coalesce(*(F.when(F.col("field") == f, v) for f, v in values.items()), F.lit(None).cast("double"))


def _join_frequency(counts: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each count with the document frequency of its term in its field.

    A hot term would put all its rows into one task of a shuffled join; the few hot terms are broadcast (their
    number is bounded by 1 / HOT), only the rest is shuffled by field and term.
    """
    by = ["field", "term"]
    hot = frequency.where("hot").select(*by, F.col("df").alias("hot_df"))
    marked = counts.join(F.broadcast(hot), by, "left")
    columns = ["doc_id", *by, "tf", "length"]
    rest = marked.where("hot_df IS NULL").select(*columns).join(frequency.where("NOT hot").select(*by, "df"), by)
    return rest.select(*columns, "df").unionByName(marked.where("hot_df IS NOT NULL").select(*columns, F.col("hot_df").alias("df")))


def most_marking_terms(articles: DataFrame, postings: DataFrame, field: str = "body", least_df: int = 2) -> DataFrame:
    """``doc_id, term``: of each live article the term of the highest score among those in ``least_df`` articles.

    Equal scores: the smaller term by code points. An article without such a term gives no row.
    """
    best = F.min_by(F.struct("term", "score"), F.struct(-F.col("score"), "term")).alias("r")
    return scored_terms(articles, postings, field).where(F.col("df") >= least_df).groupBy("doc_id").agg(best).select("doc_id", "r.term")
