"""Near-duplicate articles: the exact similarity join of their word runs, by covering with anchor points.

The named method covers a Hamming space with the words of a code. At a Jaccard similarity of 0.6 fingerprints of
related texts differ in a fifth of their bits, beyond what any affordable covering radius reaches (see README), so
the anchors are taken from the set space itself: a text's rarest word runs. Two sets of similarity t share one of
the first |x| - ceil(t |x|) + 1 runs of each, in any common order; a text is replicated to just these anchors and
compared with the others there. No link can be lost, and rare anchors have few texts.

Copies (equal sets of runs) are one class and are compared once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.articles import live_ids
from quillon.plans.workspace import bucketed, materialise

RUN, THRESHOLD = 3, 0.6
#: A run that more classes have is compared in blocks of about so many.
HOT = 5000


def run_sets(tokens: DataFrame, articles: DataFrame, run: int = RUN, field: str = "body") -> DataFrame:
    """``doc_id, runs``: the distinct runs of ``run`` consecutive terms of each live article's field, as 64-bit hashes.

    Each position counts once, null terms not at all; an article with fewer terms has no row. Repeated rows meet
    before the shuffle.
    """
    terms = tokens.where((F.col("field") == field) & F.col("term").isNotNull()).select("doc_id", "pos", F.xxhash64("term").alias("h"))
    live = terms.join(live_ids(articles), "doc_id", "left_semi")
    rows = live.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("t"))
    hashes = rows.select("doc_id", F.col("t.h").alias("h"))
    last = F.size("h") - (run - 1)
    moved = F.arrays_zip(*(F.slice("h", k + 1, last).alias(f"h{k}") for k in range(run)))
    made = F.transform(moved, lambda x: F.xxhash64(*(x[f"h{k}"] for k in range(run))))
    return hashes.where(last > 0).select("doc_id", F.array_sort(F.array_distinct(made)).alias("runs"))


def similar_classes(sets: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links between different sets, and the members of each class of equal sets.

    ``sets`` has ``doc_id, runs``. Links are ``a, b, similarity`` between class ids (the least doc_id of a class);
    members are ``class_id, doc_id``.
    """
    sets = bucketed(sets.select("doc_id", "runs", F.size("runs").alias("n"), F.xxhash64("runs").alias("k1"), F.xxhash64(F.lit(1), "runs").alias("k2")), "doc_id", "run_sets")
    keys = sets.select("doc_id", "n", "k1", "k2")
    classes = keys.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("class_id"))
    members = keys.join(classes, ["n", "k1", "k2"]).select("class_id", "doc_id")
    heads = sets.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "runs")

    rows = heads.select("doc_id", F.explode("runs").alias("run"))
    shared = rows.groupBy("run").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    # A run that only one class has can't link; it stands first in the common order, so it only shortens the prefix.
    # The rows go back to their documents as they are: they are smaller than lists of them.
    back = rows.join(shared, "run").repartition("doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("df", "run")).alias("c"))
    common = back.join(sets.select("doc_id", "n"), "doc_id")
    alone = F.col("n") - F.size("c")
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1 - alone
    anchored = (
        common.withColumn("alone", alone)
        .where(prefix > 0)
        .select("doc_id", "n", "alone", F.posexplode(F.slice(F.array_sort("c"), F.lit(1), prefix)).alias("i", "r"))
        .select("doc_id", "n", F.col("r.run").alias("run"), (F.col("alone") + F.col("i")).alias("at"), F.ceil(F.col("r.df") / HOT).cast("int").alias("blocks"))
    )
    anchored = materialise(anchored)
    # An anchor of many sets is split: the sets of one side into blocks, each of which meets all of the other side.
    x = anchored.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).alias("x")
    y = anchored.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - 1e-9)
    reach = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    near = x.join(y, (F.col("x.run") == F.col("y.run")) & (F.col("x.block") == F.col("y.block")) & order & (F.col("x.n") >= F.col("y.n") * threshold - 1e-9) & (reach >= need))
    candidates = near.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()

    left = heads.select(F.col("doc_id").alias("a"), F.col("runs").alias("ra"))
    right = heads.select(F.col("doc_id").alias("b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    checked = candidates.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("ra") + F.size("rb") - both)).alias("similarity"))
    return checked.where(F.col("similarity") >= threshold), members


def near_duplicate_pairs(tokens: DataFrame, articles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_a, doc_b``: all pairs of articles at or above ``threshold``, with those of equal sets."""
    links, members = similar_classes(run_sets(tokens, articles), threshold)
    links, members = materialise(links), materialise(members)
    first = members.select(F.col("class_id").alias("a"), F.col("doc_id").alias("x"))
    second = members.select(F.col("class_id").alias("b"), F.col("doc_id").alias("y"))
    across = links.select("a", "b").join(first, "a").join(second, "b").select("x", "y")
    within = first.join(second, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def near_duplicate_classes(tokens: DataFrame, articles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, links``: one row per article with runs, its class of equal texts and that class's links to others."""
    links, members = similar_classes(run_sets(tokens, articles), threshold)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
