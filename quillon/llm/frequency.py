"""Frequency of every distinct term: recursive radix partitioning to disk, each part aggregated out of core by DuckDB.

Counts per (field, term, document) are partitioned by the leading bits of the term's hash and written to the shared
folder. A part with more distinct terms than ``limit`` is split again by the bits that follow, below its own place, so
each level makes it smaller and only what is still too large is written again; the files of a part that was split
are removed. The first level has as many parts as the table's rows call for, so that later levels are rare.

What a part needs is memory for its distinct terms: a hot term makes a part of many rows, not of many terms. Its rows
are spread over several files when they are written, and as counts add up, each file is aggregated where it is read.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.articles import live_articles
from quillon.plans.shipping import ensure_importable
from quillon.plans.workspace import remove, scratch_path

#: Bits of a level; the first level has up to ``MAX_BITS``, for about ``ROWS`` rows a part.
BITS, MAX_BITS, ROWS = 6, 12, 4_000_000
#: A part with more distinct terms is split.
LIMIT = 500_000
RARE, COMMON = 2, 0.25
DUCKDB_MEMORY = "256MB"
#: What DuckDB gets at once where it has no folder to spill to: so much fits in its memory, all terms being distinct.
CHUNK_ROWS, CHUNK_BYTES = 500_000, 32 << 20

_PARTIAL = "field STRING, term STRING, occurrences BIGINT, df BIGINT"
_ROWS = "field STRING, term STRING, doc_id BIGINT, n BIGINT, radix BIGINT, part STRING"
_SUMS = "SELECT field, term, sum(n)::BIGINT AS occurrences, count(*)::BIGINT AS df FROM reader GROUP BY field, term"


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of a task as stretches of one part; the files of a part are read one after the other."""
    for batch in batches:
        codes = batch.column(3).dictionary_encode()
        ends = [*(np.flatnonzero(np.diff(codes.indices.to_numpy(zero_copy_only=False))) + 1).tolist(), batch.num_rows]
        for start, end in itertools.pairwise([0, *ends]):
            if end > start:
                yield batch.column(3)[start].as_py(), batch.select([0, 1, 2]).slice(start, end - start)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    chunk: list[pa.RecordBatch] = []
    for batch in batches:
        if chunk and (sum(b.num_rows for b in chunk) + batch.num_rows > CHUNK_ROWS or sum(b.nbytes for b in chunk) + batch.nbytes > CHUNK_BYTES):
            yield chunk
            chunk = []
        chunk.append(batch)
    if chunk:
        yield chunk


def _aggregate_parts(batches: Iterator[pa.RecordBatch], spill: str) -> Iterator[pa.RecordBatch]:
    """Sums by (field, term) of each part that a task reads, by DuckDB over the stream of its batches.

    ``spill`` is a folder in the shared workspace. Where that is no plain file system it is empty; a part then goes
    to DuckDB in chunks that fit in its memory, and gives a partial count for each.
    """
    import duckdb

    result = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("df", pa.int64())])
    folder = spill and f"{spill}/{uuid.uuid4().hex}"
    with duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": folder}) as connection:
        for _, rows in itertools.groupby(_by_part(batches), key=lambda x: x[0]):
            stream = (batch for _, batch in rows)
            for some in [stream] if spill else _chunked(stream):
                some = iter(some)
                first = next(some)
                reader = pa.RecordBatchReader.from_batches(first.schema, itertools.chain([first], some))  # noqa: F841 (named in the SQL)
                for batch in connection.sql(_SUMS).to_arrow_reader(50_000):
                    yield batch.cast(result)


def _digit(used: int, width: int) -> Column:
    """The ``width`` bits of the term's hash after the first ``used``."""
    return F.shiftrightunsigned(F.shiftleft(F.col("radix"), used), 64 - width)


def radix_parts(spark: SparkSession, counts: DataFrame, limit: int = LIMIT, bits: int = BITS, first_bits: int | None = None) -> DataFrame:
    """``counts`` with ``part``, the place of its final part; written to the shared folder, split until parts fit.

    A part's place is the path of its digits, as ``part=3f-02``. Rows of one part go to few tasks, those of a large
    one to several.
    """
    root = scratch_path(spark, "radix")
    pending, used, width = counts.withColumn("radix", F.xxhash64("field", "term")).withColumn("path", F.lit("")), 0, first_bits or bits
    done: list[DataFrame] = []
    for level in itertools.count():
        place = f"{root}/level-{level}"
        part = F.concat("path", F.lpad(F.lower(F.hex(_digit(used, width))), -(-width // 4), "0"))
        pending.select("field", "term", "doc_id", "n", "radix", part.alias("part")).hint("rebalance", "part").write.partitionBy("part").parquet(place)
        if level:  # the parts that were split now lie below
            for split in over:
                remove(spark, f"{root}/level-{level - 1}/part={split}")
        written = spark.read.schema(_ROWS).parquet(place)
        used += width
        sizes = written.groupBy("part").agg(F.approx_count_distinct("radix").alias("terms")).where(F.col("terms") > limit)
        over = sorted(r.part for r in sizes.select("part").collect()) if used < 64 else []
        done.append(written.where(~F.col("part").isin(over)) if over else written)
        if not over:
            return _union(done)
        width = min(bits, 64 - used)
        pending = written.where(F.col("part").isin(over)).withColumn("path", F.concat("part", F.lit("-")))


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for more in frames[1:]:
        result = result.unionByName(more)
    return result


def term_frequencies(tokens: DataFrame, articles: DataFrame, limit: int = LIMIT, bits: int = BITS, first_bits: int | None = None) -> DataFrame:
    """``field, term, occurrences, df, mark`` of every distinct (field, term) of the live articles' tokens.

    Each (doc_id, field, pos) counts once; tokens of removed documents or with a null term count nothing. ``mark``
    is ``rare``, ``common`` or null. No tokens give no rows.
    """
    spark = tokens.sparkSession
    ensure_importable(spark)
    articles_now = live_articles(articles, "title", "body")
    with_fields = articles_now.agg(F.count("title").alias("title"), F.count("body").alias("body")).first()
    once = (
        tokens.where(F.col("term").isNotNull())
        .select("doc_id", "field", "pos", "term")
        .join(articles_now.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id", "field", "pos")
        .agg(F.min("term").alias("term"))
    )
    counts = once.groupBy("field", "term", "doc_id").agg(F.count("*").alias("n"))
    if first_bits is None:  # the number of rows is in the footers of the files
        first_bits = min(MAX_BITS, max(bits, math.ceil(math.log2(max(1, tokens.count() / ROWS)))))
    parts = radix_parts(spark, counts, limit, bits, first_bits)
    place = scratch_path(spark, "duckdb")
    spill = place.removeprefix("file:").replace("//", "/", 1) if place.startswith(("file:", "/")) else ""
    partial = parts.select("field", "term", "n", "part").mapInArrow(lambda batches: _aggregate_parts(batches, spill), _PARTIAL)
    totals = partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("df").alias("df"))
    articles_with = F.when(F.col("field") == "title", with_fields.title).when(F.col("field") == "body", with_fields.body)
    mark = F.when(F.col("df") <= RARE, "rare").when(F.col("df") > COMMON * articles_with, "common")
    return totals.withColumn("mark", mark)


def marked_terms(tokens: DataFrame, articles: DataFrame) -> DataFrame:
    """``field, term, mark`` of the terms that are too rare or too common to be useful."""
    return term_frequencies(tokens, articles).where("mark IS NOT NULL").select("field", "term", "mark")
