"""Postings: a derived, positional inverted index in Parquet."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.compile import Statistics


_POSTINGS = "term STRING, seq BIGINT, id STRING, tf INT, positions ARRAY<INT>, length INT, field STRING"


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _by_term(tokens: Column) -> Column:
    """The terms of a token array, which is not empty, in order, each with its positions."""

    def starts(found: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: ~F.get(found, i)["term"].eqNullSafe(F.get(found, i - 1)["term"]))

    def entries(found: Column) -> Column:
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(found))
        positions = lambda at, i, k: F.transform(F.slice(found, i + 1, end(at, k) - i), lambda x: x["pos"])
        return _let(starts(found), lambda at: F.transform(at, lambda i, k: F.struct(F.get(found, i)["term"].alias("term"), positions(at, i, k).alias("positions"))))

    return _let(F.sort_array(tokens), entries)


def build_postings(analysed: DataFrame, fields: list[str]) -> DataFrame:
    """``field, term, seq, id, tf, positions, length`` from documents with token columns.

    A group never crosses a document, so the tokens are sorted and grouped inside the row: no shuffle, no aggregation.
    Without fields there are no rows.
    """
    if not fields:
        return analysed.sparkSession.createDataFrame([], "field STRING, term STRING, seq BIGINT, id STRING, tf INT, positions ARRAY<INT>, length INT")
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_t_{f}").alias("tokens"), F.size(f"_t_{f}").alias("length")) for f in fields))
    by_field = analysed.select("seq", "id", F.inline(each)).where("length > 0")
    rows = by_field.select("seq", "id", "field", "length", F.inline(_by_term(F.col("tokens"))))
    return rows.select("field", "term", "seq", "id", F.size("positions").alias("tf"), "positions", "length")


def posted(terms: list[tuple[str, str]]) -> Column:
    """Whether a posting is of one of the (field, term) pairs; both columns reach the scan as partition and pushed filters."""
    by_field: dict[str, list[str]] = {}
    for f, t in terms:
        by_field.setdefault(f, []).append(t)
    pairs = [(F.col("field") == f) & F.col("term").isin(ts) for f, ts in by_field.items()]
    return F.col("field").isin(list(by_field)) & F.col("term").isin(sorted({t for _, t in terms})) & reduce(Column.__or__, pairs, F.lit(False))


@dataclass
class PostingIndex:
    """Stored postings, with document frequencies and field statistics.

    Files are laid out by field and ranges of (term, seq), so a lookup reads few row groups and the postings of a
    very common term lie in many files. ``sizes`` has, by field, the number of documents that have it and their terms.
    """

    postings: DataFrame
    lists: DataFrame
    sizes: dict[str, tuple[int, int]]
    _df: dict[tuple[str, str], int] = field(default_factory=dict)

    @classmethod
    def build(cls, analysed: DataFrame, names: list[str], path: str, sizes: dict[str, tuple[int, int]], partitions: int | None = None) -> PostingIndex:
        spark = analysed.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        built = build_postings(analysed, names)
        built.repartitionByRange(n, "field", "term", "seq").sortWithinPartitions("field", "term", "seq").write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
        stored = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
        lists = stored.groupBy("field", "term").agg(F.count("*").alias("df"))
        lists.sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/lists")
        return cls.open(spark, path, sizes)

    @classmethod
    def open(cls, spark, path: str, sizes: dict[str, tuple[int, int]]) -> PostingIndex:  # noqa: ANN001
        return cls(spark.read.schema(_POSTINGS).parquet(f"{path}/postings"), spark.read.schema("field STRING, term STRING, df BIGINT").parquet(f"{path}/lists"), sizes)

    @property
    def fields(self) -> DataFrame:
        """``field, docs, total``, a row per field."""
        rows = [(f, n, t) for f, (n, t) in sorted(self.sizes.items())]
        return self.postings.sparkSession.createDataFrame(rows, "field STRING, docs BIGINT, total BIGINT")

    def lookup(self, terms: list[tuple[str, str]]) -> DataFrame:
        """The postings of (field, term) pairs."""
        return self.postings.where(posted(terms)) if terms else self.postings.limit(0)

    def point(self, name: str, term: str, seq: int) -> DataFrame:
        """The posting of a term in one document: a row, or none."""
        return self.lookup([(name, term)]).where(F.col("seq") == seq)

    def frequency(self, terms: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequencies, read once per pair and index."""
        if missing := [x for x in terms if x not in self._df]:
            self._df.update({x: 0 for x in missing} | {(r.field, r.term): r.df for r in self._counted(missing).collect()})
        return {x: self._df[x] for x in terms}

    def _counted(self, terms: list[tuple[str, str]]) -> DataFrame:
        return self.lists.where(posted(terms))

    def statistics(self, terms: list[tuple[str, str]]) -> Statistics:
        sizes = {f: self.sizes.get(f, (0, 0)) for f in {f for f, _ in terms}}
        return Statistics({f: n for f, (n, _) in sizes.items()}, {f: t / n if n else 0.0 for f, (n, t) in sizes.items()}, self.frequency(terms))


@dataclass
class LayeredIndex(PostingIndex):
    """A stored index with the documents that changed since: those of ``changed`` no longer count in ``base``, their
    present versions are the few of ``fresh``. Document frequencies are counted on the query's own postings."""

    @classmethod
    def over(cls, base: PostingIndex, changed: DataFrame, fresh: DataFrame, names: list[str], sizes: dict[str, tuple[int, int]]) -> LayeredIndex:
        columns = ["field", "term", "seq", "id", "tf", "positions", "length"]
        kept = base.postings.join(changed, "id", "left_anti").select(columns)
        both = kept.unionByName(build_postings(fresh, names).select(columns))
        return cls(both, both.groupBy("field", "term").agg(F.count("*").alias("df")), sizes)
