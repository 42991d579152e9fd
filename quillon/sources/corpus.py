"""Sources of documents: a folder of text files, and a synthetic corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import DocumentTooLarge, NoDocuments

# Suffixes of text files, and the most bytes of one file.
SUFFIXES = ("txt", "md", "markdown", "text", "log")
MAX_BYTES = 4 << 20

SYNTHETIC_SEED, MAX_TOPICS = 20240101, 60


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``id, title, body`` of the text files under ``folder``, at any depth, in order of id.

    Hidden files and folders are skipped. The id and title are the file name without its suffix. A file over 4 MiB
    is an error, as is a folder without any text file. Bytes that are no UTF-8 come out as U+FFFD.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split("://")[-1]
    inner = F.regexp_extract("path", f"{_escaped(root)}/(.*)$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = files.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*SUFFIXES) & ~inner.rlike(r"(^|/)\."))
    large = wanted.where(F.col("length") > MAX_BYTES).select("path").first()
    if large:
        raise DocumentTooLarge(f"{large.path} has more than {MAX_BYTES} bytes")
    if wanted.isEmpty():
        raise NoDocuments(f"{folder} has no text files")
    title = F.regexp_replace(name, r"\.[^.]+$", "")
    return wanted.select(title.alias("id"), title.alias("title"), F.decode("content", "UTF-8").alias("body")).orderBy("id")


def _escaped(path: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in path)


def synthetic(spark: SparkSession, n: int, seed: int = SYNTHETIC_SEED) -> DataFrame:
    """``id, title, body`` of ``n`` made-up documents, made where they are used.

    3 to 8 of 60 topic words a document, 120 to 200 words a body: a fifth fillers, a tenth rare words, the rest the
    document's topics. The same ``seed`` gives the same documents.
    """
    topics = F.array(*(F.lit(f"topic{k:02d}") for k in range(MAX_TOPICS)))
    fillers = F.array(*map(F.lit, ("with", "and", "over", "under", "between", "system", "value", "result")))

    def draw(*salt, below: int):  # noqa: ANN002, ANN202
        return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *salt), F.lit(below))

    own = F.transform(F.sequence(F.lit(1), draw(F.lit("k"), below=6).cast("int") + 3), lambda i: F.element_at(topics, draw(F.lit("t"), i, below=MAX_TOPICS).cast("int") + 1))

    def word(i):  # noqa: ANN001, ANN202
        kind = draw(F.lit("w"), i, below=100)
        rare = F.format_string("rare%05d", draw(F.lit("r"), i, below=100_000))
        filler = F.element_at(fillers, draw(F.lit("f"), i, below=8).cast("int") + 1)
        topic = F.element_at("own", draw(F.lit("o"), i, below=1 << 30).cast("int") % F.size("own") + 1)
        return F.when(kind < 10, rare).when(kind < 30, filler).otherwise(topic)

    length = draw(F.lit("n"), below=81).cast("int") + 120
    made = spark.range(n).withColumn("own", own)
    body = F.array_join(F.transform(F.sequence(F.lit(1), length), word), " ")
    return made.select(F.format_string("gen-%07d", F.col("id")).alias("id"), F.array_join(F.slice("own", 1, 3), " ").alias("title"), body.alias("body"))
