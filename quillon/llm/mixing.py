"""Mixing sources to target weights by entropy balancing.

Of all document rates that give every source its target number of tokens, the closest to one copy per document in
relative entropy are exponential in the document's size: rate = exp(tilt * tokens), up to the source's cap. The
tilts solve the convex dual; each Newton step is one distributed aggregation. The rates are then rounded to whole
copies by a threshold on a hash of the document, chosen so that the tokens come out nearest to the target.

Defined cases: rows of one doc_id are one text (the one of the greatest hash where they differ), a row without doc_id
is none; texts of sources without a target are not in the mix; a source of weight 0, null or less gives
nothing; a text without tokens follows the same rates and adds nothing to the size; a source that can't reach its
target under its cap gives all it may, and what it lacks goes to the others in proportion to their weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import DEFAULT_VOCABULARY, Tokenizer
from quillon.plans.workspace import materialise

STEPS, TOLERANCE, BINS = 60, 1e-7, 4096


def allot(total: float, weights: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """Shares of ``total`` in proportion to ``weights``, none above its ``most``; what a full one lacks goes to the rest."""
    share = dict.fromkeys(weights, 0.0)
    open_, left = {s for s, w in weights.items() if w > 0 and most[s] > 0}, total
    while open_ and left > 1e-9 * total:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * unit >= most[s]}
        for s in full or open_:
            share[s] = most[s] if full else weights[s] * unit
        left = total - sum(share.values())
        if not full:
            break
        open_ -= full
    return share


def sized_documents(documents: DataFrame, sources: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of the texts of ``sources``; tokens are counted once and kept.

    The sources are a filter of the scan, so no source, however large, is gathered anywhere.
    """
    tokenizer = Tokenizer(documents.sparkSession, vocabulary)
    with_target = documents.where(F.col("doc_id").isNotNull() & F.col("source").isin(sources)).select("doc_id", "text", "source")
    counted = with_target.select("doc_id", "source", tokenizer.count(F.col("text")).cast("long").alias("n_tokens"), F.xxhash64("text").alias("h"))
    one = counted.groupBy("doc_id").agg(F.max_by(F.struct("source", "n_tokens"), F.struct("h", "source")).alias("r"))
    return materialise(one.select("doc_id", "r.source", "r.n_tokens"))


def _by_source(df: DataFrame, values: dict[str, float], default: float = 0.0):
    """A column with the value of each row's source; sources are those of the target table."""
    if not values:
        return F.lit(default)
    pairs = [x for s, v in values.items() for x in (F.lit(s), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(default))


def solve_tilts(sizes: DataFrame, wanted: dict[str, float], caps: dict[str, float], unit: dict[str, float]) -> dict[str, float]:
    """The dual variable of each source, in 1 / mean size of its texts.

    ``sizes`` has ``source, n_tokens, count``. Newton steps on all sources at once, kept inside a bracket so that a
    step over a kink at the cap can't run away.
    """
    tilt = dict.fromkeys(wanted, 0.0)
    low, high = dict.fromkeys(wanted, -50.0), dict.fromkeys(wanted, 50.0)
    open_ = set(wanted)
    for _ in range(STEPS):
        if not open_:
            break
        live = sizes.where(F.col("source").isin(sorted(open_)))
        x = F.col("n_tokens") / _by_source(live, unit, 1.0)
        free = F.exp(F.least(_by_source(live, tilt) * x, F.lit(60.0)))
        cap = _by_source(live, caps)
        mass = F.col("count") * F.col("n_tokens")
        rows = live.groupBy("source").agg(F.sum(mass * F.least(free, cap)).alias("got"), F.sum(F.when(free < cap, mass * x * free).otherwise(0.0)).alias("slope"))
        for r in rows.collect():
            s, gap = r.source, r.got - wanted[r.source]
            if abs(gap) <= TOLERANCE * wanted[s]:
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            step = tilt[s] - gap / r.slope if r.slope > 0 else math.inf
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-12:
                open_.discard(s)
    return tilt


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The copies of each text (``doc_id, source, n_tokens, copies``), and a report by source.

    The mix is in total as large as all texts with a target. The target table is as small as the number of
    sources; sums by source are all that reaches the driver.
    """
    spark = documents.sparkSession
    rules = {r.source: r for r in targets.where("source IS NOT NULL").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).collect()}
    weights = {s: max(0.0, r.weight or 0.0) for s, r in rules.items()}
    caps = {s: float(max(0, r.max_repeats if r.max_repeats is not None else 1)) for s, r in rules.items()}
    sized = sized_documents(documents, sorted(rules), vocabulary)
    # The dual depends on the sizes alone: each Newton step reads this histogram, not the documents.
    sizes = materialise(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("count")))
    have = {r.source: r for r in sizes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("count")).alias("tokens"), F.sum("count").alias("docs")).collect()}
    total = float(sum(r.tokens for r in have.values()))
    most = {s: caps[s] * (have[s].tokens if s in have else 0) for s in rules}
    share = allot(total, weights, most)
    wanted = {s: t for s, t in share.items() if 0 < t < most[s] * (1 - 1e-12)}
    unit = {s: max(1.0, have[s].tokens / have[s].docs) for s in wanted}
    tilt = solve_tilts(sizes, wanted, caps, unit)

    exponent = F.least(_by_source(sized, tilt) * F.col("n_tokens") / _by_source(sized, unit, 1.0), F.lit(60.0))
    full = {s: caps[s] for s in rules if share[s] > 0 and s not in wanted}
    rate = F.when(F.col("source").isin(sorted(wanted)), F.least(F.exp(exponent), _by_source(sized, caps))).otherwise(_by_source(sized, full))
    rated = sized.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    # A text gets its broken copy where its draw, relative to the broken part, is under the source's threshold.
    uniform = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    part = F.col("rate") - F.col("whole")
    drawn = rated.withColumn("draw", F.when(part > 1e-9, F.least(uniform / part, F.lit(2.0))))
    # One pass gives the tokens of the whole copies of a source, and those of its broken copies by draw.
    bin_ = F.least(F.floor(F.col("draw") * (BINS // 2)), F.lit(BINS - 1))
    counted = drawn.groupBy("source", bin_.alias("bin")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("whole") * F.col("n_tokens")).alias("fixed")).collect()
    fixed: dict[str, int] = {}
    for r in counted:
        fixed[r.source] = fixed.get(r.source, 0) + r.fixed
    below: dict[str, float] = dict.fromkeys(wanted, 0.0)
    reached = {s: float(fixed.get(s, 0)) for s in wanted}
    for r in sorted((r for r in counted if r.source in wanted and r.bin is not None), key=lambda r: (r.source, r.bin)):
        if abs(reached[r.source] + r.tokens - wanted[r.source]) <= abs(reached[r.source] - wanted[r.source]) and below[r.source] >= 0:
            reached[r.source] += r.tokens
            below[r.source] = (r.bin + 1) / (BINS // 2)
        else:
            below[r.source] = -abs(below[r.source])  # no later bin
    threshold = {s: abs(b) for s, b in below.items()}
    extra = (F.col("draw").isNotNull() & (F.col("draw") < _by_source(drawn, threshold))).cast("int")
    copies = drawn.select("doc_id", "source", "n_tokens", (F.col("whole") + extra).cast("int").alias("copies"))

    used = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.sum((F.col("copies") > 0).cast("int")).alias("docs_used"), F.max("copies").alias("most_copies"))
    wanted_rows = [(s, weights[s] / (sum(weights.values()) or 1.0), int(caps[s]), float(share[s]), bool(share[s] > 0 and s not in wanted)) for s in rules]
    wishes = spark.createDataFrame(wanted_rows, "source STRING, target_share DOUBLE, max_repeats INT, target_tokens DOUBLE, capped BOOLEAN")
    joined = wishes.join(used, "source", "left").fillna(0, ["tokens", "copies", "docs_used", "most_copies"])
    reached_total = joined.agg(F.sum("tokens")).scalar()
    report = joined.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), reached_total), F.lit(0.0)))
    return copies, report


def mixed_texts(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens, copies, text`` of each text in the mix."""
    copies, _ = mix(documents, targets, vocabulary)
    texts = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    return copies.where("copies > 0").join(texts, "doc_id")


def mix_report(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """By source: target share and tokens, what was reached, how many texts and copies, and whether the cap bound."""
    return mix(documents, targets, vocabulary)[1]
