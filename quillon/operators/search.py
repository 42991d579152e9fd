"""Searching a collection of documents: match, rank, sort, page, count, highlight.

A query is analysed on the driver, compiled to Columns and run as one DataFrame. It runs over a scan of the analysed
documents, or over the postings of just the query's terms where an index exists. Both give the same pages.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillon.functions.analysis import StandardAnalyzer, keyword_tokens
from quillon.functions.highlight import Highlighter
from quillon.functions.scoring import BM25
from quillon.functions.values import DATE, KEYWORD, NUMBER, TEXT, date_text, millis_of, number_text
from quillon.operators.index import PostingIndex
from quillon.operators.sorting import SortKey, check_sort, ordering, parse_sort
from quillon.plans.compile import Clause, Compiler, Group, Statistics, analyse, needs_all_documents, positive_terms, range_filter, wanted_numbers, wanted_terms
from quillon.plans.shipping import ensure_importable
from quillon.plans.syntax import MAX_CLAUSES, Node, parse
from quillon.plans.workspace import read_buckets, write_buckets

DEFAULT_LIMIT, MAX_LIMIT, MAX_OFFSET = 10, 100, 1_000_000


def clamp_limit(limit: int | None) -> int:
    return DEFAULT_LIMIT if not limit or limit <= 0 else min(limit, MAX_LIMIT)


def clamp_offset(offset: int | None) -> int:
    return min(max(offset or 0, 0), MAX_OFFSET)


@dataclass
class SearchResult:
    """``ranked`` is the page (``seq, id, score``); ``matches`` are all hits, before paging."""

    collection: Collection
    node: Node
    ranked: DataFrame
    matches: DataFrame
    order: list[Column]

    def total(self) -> int:
        """The exact number of hits before paging."""
        return self.matches.count()

    def hits(self, highlight: bool = False, highlighter: Highlighter | None = None) -> DataFrame:
        """The page with its documents: ``rank, id, score, fields`` and, if asked for, ``highlights``.

        The page (at most 100 rows) is fetched first, so that the documents are read by a filter on their ``seq``:
        of stored documents only the buckets that have them, and there only the pages.
        """
        spark = self.ranked.sparkSession
        page = [(n, r.seq, r.id, r.score) for n, r in enumerate(self.ranked.collect())]
        frame = spark.createDataFrame(page, "rank INT, seq BIGINT, id STRING, score DOUBLE")
        docs = self.collection.docs.where(F.col("seq").isin([p[1] for p in page])) if page else self.collection.docs.limit(0)
        rendered = self.collection.rendered_fields()
        columns = ["rank", "id", "score", rendered.alias("fields")]
        if highlight:
            terms = positive_terms(self.node, self.collection.analyzer)
            columns.append(self.collection.highlights(rendered, terms, highlighter or Highlighter()).alias("highlights"))
        return docs.drop("id").join(F.broadcast(frame), "seq").select(*columns).orderBy("rank")


@dataclass
class Collection:
    """Documents with typed fields.

    ``docs`` has ``seq`` (the write order, which breaks every tie), ``id`` and a column for each field of ``kinds``.
    ``analysed`` adds a column ``_t_<field>`` with the tokens of each searchable field; ``prepare`` makes and stores
    it. ``index`` holds postings.
    """

    docs: DataFrame
    kinds: dict[str, str]
    analyzer: StandardAnalyzer = field(default_factory=StandardAnalyzer)
    bm25: BM25 = field(default_factory=BM25)
    analysed: DataFrame | None = None
    index: PostingIndex | None = None
    sizes: dict[str, tuple[int, int]] | None = None

    def __post_init__(self) -> None:
        ensure_importable(self.docs.sparkSession)

    @property
    def searchable(self) -> list[str]:
        return sorted(f for f, k in self.kinds.items() if k in (TEXT, KEYWORD))

    def tokens_of(self, name: str) -> Column:
        return keyword_tokens(F.col(name)) if self.kinds[name] == KEYWORD else self.analyzer.tokens(F.col(name))

    def with_tokens(self, names: list[str] | None = None) -> DataFrame:
        """The documents with the token columns of ``names``; computed from the text where they are not stored."""
        if self.analysed is not None:
            return self.analysed
        return self.docs.withColumns({f"_t_{f}": self.tokens_of(f) for f in (self.searchable if names is None else names)})

    def with_lengths(self) -> DataFrame:
        """``with_tokens`` and the number of terms of each field, in a small column of its own; null without the field."""
        analysed = self.with_tokens()
        return analysed.withColumns({f"_len_{f}": F.when(F.col(f"_t_{f}").isNotNull(), F.size(f"_t_{f}")) for f in self.searchable})

    def prepare(self, path: str, partitions: int | None = None) -> Collection:
        """Analyses once and stores the documents with their token columns; queries then never analyse text.

        The documents are bucketed by ``seq`` and sorted by it: a page reads the buckets of its documents only, and
        postings are made without a shuffle. Texts are spread before they are analysed, as one input file may be one
        task. The sizes of the fields are observed on the way.
        """
        spark, names, seen = self.docs.sparkSession, self.searchable, Observation()
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        made = replace(self, docs=self.docs.repartition(n, "seq"), analysed=None).with_lengths()
        write_buckets(made.observe(seen, *self._size_columns(names)), path, "seq", n)
        return self.prepared(read_buckets(spark, path, made.schema, "seq", n), sizes_of(names, seen.get))

    def prepared(self, stored: DataFrame, sizes: dict[str, tuple[int, int]]) -> Collection:
        """The collection over documents with token columns that are stored already."""
        extra = [f"{p}{f}" for f in self.searchable for p in ("_t_", "_len_")]
        return replace(self, docs=stored.drop(*extra), analysed=stored, sizes=sizes)

    @staticmethod
    def _size_columns(names: list[str]) -> list[Column]:
        counts = [F.count(f"_len_{f}").alias(f"n{k}") for k, f in enumerate(names)]
        return [F.count(F.lit(1)).alias("docs"), *counts, *(F.sum(f"_len_{f}").alias(f"l{k}") for k, f in enumerate(names))]

    def measured(self) -> dict[str, tuple[int, int]]:
        """By field, the number of documents that have it and their terms; counted if ``prepare`` did not observe them."""
        if self.sizes is None:
            row = self.with_lengths().agg(*self._size_columns(self.searchable)).first()
            self.sizes = sizes_of(self.searchable, row.asDict())
        return self.sizes

    def with_index(self, path: str) -> Collection:
        """The collection with postings built at ``path``."""
        return replace(self, index=PostingIndex.build(self.with_tokens(), self.searchable, path, self.measured()))

    def statistics(self, terms: list[tuple[str, str]]) -> Statistics:
        """Statistics over all documents for just the fields and terms of a query: one row."""
        if self.index is not None:
            return self.index.statistics(terms)
        names = sorted({f for f, _ in terms})
        if not names:
            return Statistics({}, {}, {})
        exprs = [F.count(f"_t_{f}").alias(f"n{k}") for k, f in enumerate(names)]
        exprs += [F.sum(F.size(f"_t_{f}")).alias(f"l{k}") for k, f in enumerate(names)]
        exprs += [F.count(F.when(_has(f, t), True)).alias(f"d{k}") for k, (f, t) in enumerate(terms)]
        row = self.with_tokens(names).agg(*exprs).first()
        docs = {f: row[f"n{k}"] for k, f in enumerate(names)}
        average = {f: (row[f"l{k}"] or 0) / docs[f] if docs[f] else 0.0 for k, f in enumerate(names)}
        return Statistics(docs, average, {x: row[f"d{k}"] for k, x in enumerate(terms)})

    def search(
        self,
        query: str | Node,
        fields: list[str] | None = None,
        limit: int | None = None,
        offset: int | None = None,
        sort: str | list[SortKey] | None = None,
        default_and: bool = False,
        mode: str = "auto",
        max_clauses: int = MAX_CLAUSES,
    ) -> SearchResult:
        """Runs a query. ``fields`` restricts bare words and phrases; unknown names are ignored.

        ``mode`` is ``scan``, ``postings`` or ``auto`` (postings where there is an index and no document without
        any of the terms can match).
        """
        node = parse(query, default_and, max_clauses) if isinstance(query, str) else query
        keys = parse_sort(sort) if isinstance(sort, str) or sort is None else sort
        check_sort(keys, self.kinds)
        tree = analyse(node, self.kinds, self.searchable, fields, self.analyzer)
        terms = wanted_terms(tree)
        stats = self.statistics(terms)
        use_index = mode == "postings" or (mode == "auto" and self.index is not None and not needs_all_documents(tree))
        numbers, lengths = wanted_numbers(tree), sorted({f for f, _ in terms})
        rows = self._posting_rows(tree, terms, lengths, numbers, keys) if use_index else self._scan_rows(tree, terms, lengths, numbers, keys)
        places = {x: f"_p{k}" for k, x in enumerate(terms)}
        types = {n: self.docs.schema[n].dataType for n in numbers}
        compiler = Compiler(
            stats,
            positions=lambda f, t: F.col(places[f, t]),
            length=lambda f: F.col(f"_l{lengths.index(f)}"),
            numeric=lambda c: range_filter(F.col(f"_n_{c.bounds.field}"), self.kinds[c.bounds.field], types[c.bounds.field], c),
            bm25=self.bm25,
        )
        match, score = compiler.compile(tree)
        found = rows.where(match).withColumn("score", score)
        order = ordering(keys)
        page = found.orderBy(*order).offset(clamp_offset(offset)).limit(clamp_limit(limit))
        return SearchResult(self, node, page.select("seq", "id", "score"), found.select("seq", "id", "score"), order)

    def _plain(self, numbers: list[str], keys: list[SortKey]) -> list[Column]:
        return [*(F.col(n).alias(f"_n_{n}") for n in numbers), *(self._sort_value(k.field).alias(f"_s_{k.field}") for k in keys)]

    def _sort_value(self, name: str) -> Column:
        return millis_of(F.col(name), self.docs.schema[name].dataType) if self.kinds[name] == DATE else F.col(name)

    def _scan_rows(self, tree, terms, lengths, numbers, keys) -> DataFrame:  # noqa: ANN001
        places = [F.transform(F.filter(f"_t_{f}", _is(t)), lambda x: x["pos"]).alias(f"_p{k}") for k, (f, t) in enumerate(terms)]
        sizes = [F.size(f"_t_{f}").alias(f"_l{k}") for k, f in enumerate(lengths)]
        source = self._narrowed(self.with_tokens(lengths), tree)
        return source.select("seq", "id", *self._plain(numbers, keys), *places, *sizes)

    def _narrowed(self, docs: DataFrame, tree: Clause | Group) -> DataFrame:
        """Ranges that every hit must satisfy, as plain filters that reach the Parquet scan."""
        clauses = [tree] if isinstance(tree, Clause) else [c for c in tree.must if isinstance(c, Clause)]
        for c in clauses:
            if c.bounds is not None:
                name = c.bounds.field
                docs = docs.where(range_filter(F.col(name), self.kinds[name], self.docs.schema[name].dataType, c))
        return docs

    def _posting_rows(self, tree, terms, lengths, numbers, keys) -> DataFrame:  # noqa: ANN001
        """A row per document with any of the terms, from the postings; all documents where others may match."""
        hits = self.index.lookup(terms)
        places = [F.first(F.when((F.col("field") == f) & (F.col("term") == t), F.col("positions")), True).alias(f"_p{k}") for k, (f, t) in enumerate(terms)]
        sizes = [F.max(F.when(F.col("field") == f, F.col("length"))).alias(f"_l{k}") for k, f in enumerate(lengths)]
        everything = needs_all_documents(tree)
        if len(terms) == 1 and not everything and not numbers and not keys:  # a document has one posting of a term
            return hits.select("seq", "id", F.col("positions").alias("_p0"), F.col("length").alias("_l0"))
        found = hits.groupBy("seq").agg(F.first("id").alias("id"), *places, *sizes) if terms else None
        if found is None and not everything:
            return self.docs.where(F.lit(False)).select("seq", "id", *self._plain(numbers, keys))
        if not everything and not numbers and not keys:
            return found
        docs = self._narrowed(self.docs, tree).select("seq", "id", *self._plain(numbers, keys))
        if found is None:
            return docs
        return docs.join(found.drop("id"), "seq", "left" if everything else "inner")

    def rendered_fields(self) -> Column:
        """All fields of a document as text: ``map<string, string>`` without the missing ones."""
        entries = []
        for name, kind in sorted(self.kinds.items()):
            value = F.col(name)
            if kind == NUMBER:
                value = number_text(value.cast("double"))
            elif kind == DATE:
                value = date_text(millis_of(value, self.docs.schema[name].dataType))
            entries += [F.lit(name), value.cast("string")]
        return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())

    def highlights(self, rendered: Column, terms: list[str], highlighter: Highlighter) -> Column:
        """Snippets of every field with a match, number and date texts too."""
        entries = [x for name in sorted(self.kinds) for x in (F.lit(name), highlighter.column(rendered[name], terms, self.analyzer))]
        return F.map_filter(F.create_map(*entries), lambda _, v: v != "")

    def field_stats(self) -> DataFrame:
        """``field, docs, total_tokens, avg_length`` of each searchable field that some document has."""
        names = self.searchable
        rows = self.with_tokens().select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.size(f"_t_{f}").alias("length")) for f in names))))
        totals = rows.where("length >= 0").groupBy("field").agg(F.count("*").alias("docs"), F.sum("length").alias("total_tokens"))
        return totals.withColumn("avg_length", F.col("total_tokens") / F.col("docs"))

    def postings(self) -> DataFrame:
        """``field, term, seq, tf, positions`` computed from the documents."""
        from quillon.operators.index import build_postings

        return build_postings(self.with_tokens(), self.searchable).drop("id", "length")

    def table_stats(self) -> DataFrame:
        """One row: ``docs, fields, terms, total_tokens, avg_doc_length``."""
        sizes = sum((F.greatest(F.size(f"_t_{f}"), F.lit(0)) for f in self.searchable), F.lit(0))
        docs = self.with_tokens().agg(F.count("*").alias("docs"), F.coalesce(F.sum(sizes), F.lit(0)).alias("total_tokens"))
        distinct = self.postings().select("field", "term").distinct().agg(F.count("*").alias("terms"))
        present = self.field_stats().agg(F.count("*").alias("fields"))
        return docs.select("docs", present.scalar().alias("fields"), distinct.scalar().alias("terms"), "total_tokens", F.coalesce(F.try_divide("total_tokens", "docs"), F.lit(0.0)).alias("avg_doc_length"))

    def facet(self, name: str) -> DataFrame:
        """``value, docs`` of a field."""
        return self.docs.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("docs"))


def sizes_of(names: list[str], row: dict) -> dict[str, tuple[int, int]]:
    return {f: (row[f"n{k}"], row[f"l{k}"] or 0) for k, f in enumerate(names)}


def _is(term: str):  # noqa: ANN202
    return lambda x: x["term"] == F.lit(term)


def _has(name: str, term: str) -> Column:
    return F.exists(f"_t_{name}", _is(term))
