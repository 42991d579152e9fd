"""Operators on articles and their tokens, against brute force on small tables."""

from __future__ import annotations

import itertools
import math
import random
import unicodedata
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions.analysis import KEEP_ALL
from quillon.llm import distinctiveness, frequency, lookalikes, near_duplicates, segmentation

#: Extra columns that bear the names the operators use inside.
CLASH = {c: 1 for c in ("n", "r", "h", "t", "run", "runs", "word", "look", "form", "key", "radix", "digit", "part", "df", "class_id", "text", "piece", "score")}
NOW = datetime(2031, 1, 1)


def articles(spark, rows):
    """rows: (doc_id, title, body); each is there twice."""
    schema = "doc_id long, title string, body string, created_at timestamp, updated_at timestamp, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame([(*r, NOW, None, *CLASH.values()) for r in rows for _ in range(2)], schema)


def tokens(spark, rows):
    made = [(d, f, t.pos, t.term) for d, title, body in rows for f, text in (("title", title), ("body", body)) if text for t in KEEP_ALL.analyze(text)]
    made += made[::3] + [(10**6, "body", k, w) for k, w in enumerate("removed document has these words".split())] + [(None, "body", 0, "x"), (1, "body", 9999, None)]
    schema = "doc_id long, field string, pos int, term string, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame([(*r, *CLASH.values()) for r in made], schema)


def postings(spark, rows):
    made = [(d, f, w, n) for d, title, body in rows for f, text in (("title", title), ("body", body)) if text for w, n in Counter(t.term for t in KEEP_ALL.analyze(text)).items()]
    made += made[::4] + [(10**6, "body", "removed", 3), (1, "body", None, 2), (None, "body", "x", 1), (1, "body", "zero", None)]
    clash = {c: v for c, v in CLASH.items()}
    schema = "doc_id long, field string, term string, tf int, " + ", ".join(f"{c} int" for c in clash)
    return spark.createDataFrame([(*r, *clash.values()) for r in made], schema)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, rng.choice(["Title one", "Other", None]), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(1, 40)]
    base = rng.choices([f"v{k}" for k in range(300)], k=120)
    for k in range(40, 60):
        edited = list(base)
        for _ in range(rng.randint(0, 12)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        rows.append((k, f"Edit {k}", " ".join(edited)))
    rows += [(60, "Edit", " ".join(base)), (61, "Edit", " ".join(base)), (62, None, None), (63, "", ""), (64, "two", "only two"), (65, "中文", "全文搜索全文搜索")]
    return rows


@pytest.mark.parametrize("hot", [5000, 3])
def test_near_duplicates_equal_brute_force(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", hot)

    def runs(text):
        t = [x.term for x in KEEP_ALL.analyze(text or "")]
        return {tuple(t[i : i + 3]) for i in range(len(t) - 2)}

    sets = {d: runs(b) for d, _, b in corpus}
    expected = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    frames = tokens(spark, corpus), articles(spark, corpus)
    found = [tuple(r) for r in near_duplicates.near_duplicate_pairs(*frames).collect()]
    assert len(expected) > 50 and len(found) == len(set(found)) and set(found) == expected
    classes = {r.doc_id: r for r in near_duplicates.near_duplicate_classes(*frames).collect()}
    assert classes.keys() == {d for d, s in sets.items() if s}
    assert classes[60].class_id == classes[61].class_id
    assert all(sets[d] == sets[r.class_id] for d, r in classes.items())


def golay():
    """The words of the perfect binary code of 23 bits and covering radius 3, from its generator polynomial."""
    words = np.zeros(1, dtype=np.int64)
    for k in range(12):
        words = np.concatenate([words, words ^ (0b110001110101 << k)])
    return words


def test_covering_codes_do_not_reach_the_threshold():
    """Why the anchors are no code words: the figures of the README, measured.

    One-bit min-hash fingerprints of sets of similarity s differ in each bit with probability (1 - s) / 2. A text goes to
    the anchors within the covering radius and a threshold of 1; two texts meet where they share one.
    """
    code, rng, tries, reach = golay(), np.random.default_rng(1), 4000, 4
    assert len(set(code.tolist())) == 4096 and sorted(Counter(np.bitwise_count(code).tolist()).items())[:3] == [(0, 1), (7, 253), (8, 506)]
    at = rng.integers(0, 1 << 23, tries)
    near = np.bitwise_count(code[None, :] ^ at[:, None]) <= reach

    def met(p):
        flips = (rng.random((tries, 23)) < p) @ (1 << np.arange(23))
        return float((near & (np.bitwise_count(code[None, :] ^ (at ^ flips)[:, None]) <= reach)).any(axis=1).mean())

    anchors, similar, others = near.sum(axis=1).mean(), met(0.2), met(0.5)
    blocks = math.log(0.01) / math.log(1 - similar)
    assert 5 < anchors < 6 and 0.4 < similar < 0.47 and 0.005 < others < 0.01
    assert blocks * anchors > 35 and 1 - (1 - others) ** blocks > 0.04  # replicas of a text, and the share of all pairs to compare


def test_near_duplicate_threshold_is_exact(spark):
    """Sets of sizes and overlaps all around the threshold, so that no rounding of the prefix loses a link."""
    rows = []
    for k, (n, m) in enumerate(itertools.product(range(3, 14), range(0, 7))):
        common = [f"c{k}x{i}" for i in range(n)]
        rows += [(2 * k + 1, None, " ".join(common)), (2 * k + 2, None, " ".join(common + [f"d{k}x{i}" for i in range(m)]))]
    sets = {d: {tuple(b.split()[i : i + 3]) for i in range(len(b.split()) - 2)} for d, _, b in rows}
    expected = {(a, a + 1) for a in range(1, len(rows), 2) if len(sets[a] & sets[a + 1]) * 10 >= 6 * len(sets[a] | sets[a + 1])}
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(tokens(spark, rows), articles(spark, rows)).collect()} == expected


def test_scores_equal_brute_force(spark, corpus):
    docs = {d: Counter(t.term for t in KEEP_ALL.analyze(b or "")) for d, _, b in corpus}
    n = sum(b is not None for _, _, b in corpus)
    average = sum(sum(c.values()) for c in docs.values()) / n
    df = Counter(w for c in docs.values() for w in c)
    expected = {
        (d, w): round(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)), 6)
        for d, c in docs.items()
        for w, tf in c.items()
    }
    frames = articles(spark, corpus), postings(spark, corpus)
    found = {(r.doc_id, r.term): r.score for r in distinctiveness.scored_terms(*frames).collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - v) < 2e-6 for k, v in expected.items())
    best = {d: min((-s, w) for (x, w), s in found.items() if x == d and df[w] >= 2)[1] for d, c in docs.items() if any(df[w] >= 2 for w in c)}
    assert {r.doc_id: r.term for r in distinctiveness.most_marking_terms(*frames).collect()} == best


def test_every_field_is_scored(spark, corpus):
    """Titles get scores too, by the statistics of titles; the corpus has terms in both fields."""
    expected = {}
    for field, texts in (("title", {d: t for d, t, _ in corpus}), ("body", {d: b for d, _, b in corpus})):
        docs = {d: Counter(t.term for t in KEEP_ALL.analyze(x or "")) for d, x in texts.items()}
        n = sum(x is not None for x in texts.values())
        average = sum(c.total() for c in docs.values()) / n
        df = Counter(w for c in docs.values() for w in c)
        for d, c in docs.items():
            expected |= {(d, field, w): math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * c.total() / average)) for w, tf in c.items()}
    rows = distinctiveness.scored_postings(articles(spark, corpus), postings(spark, corpus)).collect()
    found = {(r.doc_id, r.field, r.term): r.score for r in rows}
    assert len(rows) == len(found) and found.keys() == expected.keys() and {f for _, f, _ in found} == {"title", "body"}
    assert all(abs(found[k] - v) < 2e-6 for k, v in expected.items())
    assert {(64, "title", "two"), (64, "body", "two")} <= found.keys() and found[64, "title", "two"] != found[64, "body", "two"]


@pytest.mark.parametrize("hot", [0.0, 0.02, 1.0])
def test_hot_terms_join_alike(spark, corpus, hot, monkeypatch):
    frames = articles(spark, corpus), postings(spark, corpus)
    plain = {tuple(r) for r in distinctiveness.scored_terms(*frames).collect()}
    monkeypatch.setattr(distinctiveness, "HOT", hot)
    assert {tuple(r) for r in distinctiveness.scored_terms(*frames).collect()} == plain


@pytest.mark.parametrize(("limit", "bits"), [(500_000, 6), (50, 2), (1, 4)])
def test_frequencies_equal_brute_force(spark, corpus, limit, bits):
    """Also with parts so small that they are split many times, and hot terms by documents."""
    uses, docs = Counter(), Counter()
    for _, title, body in corpus:
        for field, text in (("title", title), ("body", body)):
            terms = [t.term for t in KEEP_ALL.analyze(text or "")]
            uses.update((field, t) for t in terms)
            docs.update((field, t) for t in set(terms))
    with_field = {"title": sum(t is not None for _, t, _ in corpus), "body": sum(b is not None for _, _, b in corpus)}
    mark = lambda k, n: "rare" if n <= 2 else "common" if n > 0.25 * with_field[k[0]] else None
    expected = {k: (uses[k], n, mark(k, n)) for k, n in docs.items()}
    rows = frequency.term_frequencies(tokens(spark, corpus), articles(spark, corpus), limit, bits).collect()
    assert len(rows) == len(expected) and {(r.field, r.term): (r.occurrences, r.df, r.mark) for r in rows} == expected
    assert {r.mark for r in rows} == {"rare", "common", None}


def _files(folder):
    import pathlib

    return sorted(pathlib.Path(folder).rglob("part=*/*.parquet"))


def test_parts_shrink_until_they_fit(spark, monkeypatch):
    """Parts split below their own place: each level is smaller, each row is kept once, and only hot terms have many rows."""
    roots = []
    monkeypatch.setattr(frequency, "scratch_path", lambda s, label, make=frequency.scratch_path: roots.append(make(s, label)) or roots[-1])
    terms, hot, limit, bits = 20_000, 5_000, 60, 2
    rows = spark.range(terms).select(F.lit("body").alias("field"), F.concat(F.lit("t"), "id").alias("term"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n"))
    rows = rows.unionByName(spark.range(hot).select(F.lit("body").alias("field"), F.lit("hot").alias("term"), F.col("id").alias("doc_id"), F.lit(2).cast("long").alias("n")))
    parts = frequency.radix_parts(spark, rows, limit, bits)
    sizes = {r.part: (r.rows, r.terms) for r in parts.groupBy("part").agg(F.count("*").alias("rows"), F.countDistinct("term").alias("terms")).collect()}
    assert sum(n for n, _ in sizes.values()) == terms + hot == parts.select("term", "doc_id").distinct().count()
    assert all(t <= 1.25 * limit for _, t in sizes.values()) and sum(n > limit + hot // 2 for n, _ in sizes.values()) == 1
    levels = {p.count("-") for p in sizes}
    assert max(levels) <= math.ceil(math.log(terms / limit, 1 << bits)) + 1 and max(levels) >= 3
    for p, (_, t) in sizes.items():  # a part lies at a level only because the one above was too large
        if "-" in p:
            above = p.rpartition("-")[0]
            assert sum(x for q, (_, x) in sizes.items() if q.startswith(above + "-")) > 0.75 * limit
    assert spark.read.parquet(*map(str, _files(roots[0].removeprefix("file:")))).count() == terms + hot


def test_parts_are_aggregated_apart_and_in_chunks(tmp_path, monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((f"p{rng.randrange(5)}", "body", f"t{rng.randrange(300)}", rng.randrange(1, 4)) for _ in range(3000))
    whole = pa.table({"field": [r[1] for r in rows], "term": [r[2] for r in rows], "n": pa.array([r[3] for r in rows], pa.int64()), "part": [r[0] for r in rows]})
    expected = Counter()
    for _, f, t, n in rows:
        expected[f, t] += n
    monkeypatch.setattr(frequency, "CHUNK_ROWS", 256)
    for spill in (str(tmp_path), ""):
        found, df = Counter(), Counter()
        for batch in frequency._aggregate_parts(iter(whole.to_batches(max_chunksize=100)), spill):
            for r in batch.to_pylist():
                found[r["field"], r["term"]] += r["occurrences"]
                df[r["term"]] += r["df"]
        assert found == expected and df.total() == len(rows)
    assert list(frequency._aggregate_parts(iter([]), "")) == []


def test_memory_for_two_million_terms_without_a_spill_folder():
    import pyarrow as pa

    def batches():
        for k in range(0, 2_000_000, 10_000):
            yield pa.RecordBatch.from_pydict({"field": ["body"] * 10_000, "term": [f"a longer term of the corpus {i}" for i in range(k, k + 10_000)], "n": pa.array([1] * 10_000, pa.int64()), "part": ["x"] * 10_000})

    assert sum(b.num_rows for b in frequency._aggregate_parts(batches(), "")) == 2_000_000


def test_pieces(spark):
    rng = random.Random(3)
    topics = [[f"t{k}x{i}" for i in range(30)] for k in range(6)]
    paragraphs = [" ".join(" ".join(rng.choices(t, k=9)) + "." for _ in range(20)) for t in topics]
    rows = [(1, "Short", "few words"), (2, None, None), (3, None, "\n\n".join(paragraphs)), (4, "No breaks", "word " * 1000), (5, "", "中" * 900), (6, "x", " ".join(["w"] * 399)), (7, "x", " ".join(["w"] * 400))]
    pieces = {}
    for r in segmentation.split_articles(articles(spark, rows)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert {d for d, p in pieces.items() if len(p) > 1} == {3, 4, 5, 7}
    assert {r.doc_id for r in segmentation.oversized_articles(articles(spark, rows)).collect()} == {3, 4, 5, 7}
    for d, title, body in rows:
        whole = "\n\n".join(x for x in (title, body) if x is not None)
        terms = [t.term for t in KEEP_ALL.analyze(whole)]
        parts = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.n_pieces for r in parts] == [len(parts)] * len(parts)
        end, rebuilt = 0, ""
        for k, r in enumerate(parts):
            own = [t.term for t in KEEP_ALL.analyze(r.text)]
            assert own == terms[r.first_term : r.first_term + r.n_terms] and len(own) <= 400
            assert r.overlap == (40 if k else 0) and r.first_term == end - r.overlap
            end = r.first_term + r.n_terms
            offset = KEEP_ALL.analyze(r.text)[r.overlap].start if r.overlap and r.overlap < r.n_terms else 0
            rebuilt += r.text.encode()[offset:].decode()
        assert end == len(terms) and rebuilt == whole
    # Topics change every 180 terms; cuts fall on these changes.
    assert {r.first_term + r.n_terms for r in pieces[3][:-1]} <= {180 * k for k in range(1, 7)}


def test_pieces_end_at_the_deepest_valley_of_the_whole_window():
    sentences = lambda topic, n: " ".join(" ".join(f"{topic}{k}" for k in range(10)) + "." for _ in range(n))
    for early in (50, 100, 150):  # a topic change in the first half, only sentence ends of one topic in the second
        pieces = segmentation.split_text(sentences("a", early // 10) + " " + sentences("b", 60))
        assert pieces[0].end == early and pieces[1].overlap == 40
    long = " ".join(f"b{k % 10}" for k in range(1000))
    pieces = segmentation.split_text(sentences("a", 20) + " " + sentences("b", 2) + " " + long)
    assert [p.end for p in pieces[:4]] == [200, 210, 220, 580]  # early sentence ends before a cut inside a sentence
    assert [p.overlap for p in pieces[:4]] == [0, 40, 40, 40] and all(p.end - p.first <= 400 for p in pieces)
    pieces = segmentation.split_text("a b. " + long, limit=50, overlap=40)
    assert all(p.end - p.first <= 50 and p.overlap == (40 if k else 0) for k, p in enumerate(pieces)) and pieces[-1].end == 1002


def test_pieces_of_a_very_long_text():
    pieces = segmentation.split_text("same words again. " * 40_000)
    assert all(p.end - p.first <= 400 for p in pieces) and pieces[-1].end == 120_000
    with pytest.raises(ValueError):
        segmentation.split_text("a", limit=10, overlap=10)


def test_same_looking_titles(spark):
    plain = "Notes on File cache, Zoë edition 12"
    same = ["Ｎｏｔｅｓ on File cache, Zoë edition 12", "Nоtes on Filе cache, Zoë edition 12", "No​tes on Fi­le cache, Zoë edition 12", "Notes on ﬁle cache"[:9] + "File cache, Zoë edition 12", "Notes on File cache，Zoë edition 12".replace("，", ", "), "Νotes on File cache, Zoë edition １２"]
    other = ["notes on File cache, Zoë edition 12", "Notes on File cache, Zoe edition 12", "Notes on File-cache, Zoë edition 12", "Notes on Filecache, Zoë edition 12", "Notes on File cache, Zoë edition 13", "Журнал", "Жyрнал", "", None, "⒈"]
    rows = [(k, t, None) for k, t in enumerate([plain, plain, *same, *other])]
    found = {tuple(r) for r in lookalikes.same_looking_pairs(articles(spark, rows)).collect()}
    forms = [None if t is None else lookalikes.by_table(t) for _, t, _ in rows]
    expected = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if forms[a] is not None and forms[a] == forms[b] and rows[a][1] != rows[b][1]}
    assert found == expected and (0, 2) in found and (0, 1) not in found
    group = {0, 1, *range(2, 2 + len(same))}
    assert {d for p in found for d in p} == group | {k for k, t, _ in rows if t in ("Журнал", "Жyрнал")}
    titles = {r.doc_id: r.form for r in lookalikes.same_looking_titles(articles(spark, rows)).collect()}
    assert {titles[k] for k in group} == {plain}
    assert titles[rows[-4][0] if rows[-4][1] == "Жyрнал" else rows[-4][0]] == "Журнал"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_table_forms_are_stable(text):
    form = lookalikes.by_table(text)
    assert lookalikes.by_table(form) == form
    assert lookalikes.by_table(unicodedata.normalize("NFD", text)) == lookalikes.by_table(unicodedata.normalize("NFC", text))


def test_trie_costs():
    trie = lookalikes.Trie({"cache": 5, "cash": 9, "снимок": 1})
    assert trie.closest("сасhе") == "cache" and trie.closest("ca​che") == "cache"
    assert trie.closest("cachе") == "cache" and trie.closest("снимок") == "снимок"
    assert trie.closest("cachz") is None and trie.closest("cachz", budget=1) == "cache"
    assert trie.closest("cach", budget=1) in ("cache", "cash") and trie.closest("xcache", budget=1) == "cache"
    assert trie.closest("Cache") is None and lookalikes.Trie({}).closest("a") is None


def test_look_alikes_are_what_their_names_say():
    """No letter twice, none that is plain, and every one of an alphabet that the list names."""
    alphabets = Counter(lookalikes._alphabet(c) for c in lookalikes.LOOK_ALIKES if c.isalpha())
    assert set(alphabets) == {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU", "LATIN"} and len(lookalikes.LOOK_ALIKES) < 200
    assert all(not c.isascii() and x.isascii() for c, x in lookalikes.LOOK_ALIKES.items())
    for c, x in lookalikes.LOOK_ALIKES.items():
        assert not c.isalpha() or c.isupper() == x.isupper() or unicodedata.name(c).startswith("LISU") and x.isupper()


def test_the_alphabet_of_a_form(spark):
    words = ["coco", *["сосо"] * 5, "coсo", "пpивeт", "Жyрнал", "йoд", "ԛuick", "παρτu", "ϑx", "a‑b", "a-b", "Ԍo", "Go", "plаin"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    forms = {r.word: r.form for r in lookalikes.canonical_words(frame).collect()}
    assert forms == {"coсo": "coco", "сосо": "coco", "ϑx": "θx", "пpивeт": "привет", "Жyрнал": "Журнал", "йoд": "йод", "ԛuick": "quick", "παρτu": "παρτυ", "a‑b": "a-b", "Ԍo": "Go", "plаin": "plain"}


def test_automaton_reads_the_characters_as_they_are(monkeypatch):
    """Arcs for look-alikes, presentation forms and ignorables; nothing but the arcs says what is alike."""
    trie = lookalikes.Trie({"cache": 5, "coffee": 2, "zoë": 1})
    monkeypatch.setattr(lookalikes, "units", None)  # the walk normalises nothing
    assert trie.closest("с​а\u00adсhе") == "cache" and trie.closest("ｃoﬀee") == "coffee" and trie.closest("zoe\u0308\ufeff") == "zoë"
    assert trie.closest("zoe") is None and trie.closest("саxhе", budget=1) == "cache" and trie.closest("с​chе") is None
    assert trie.closest("с​chе", budget=1) == "cache"
    monkeypatch.setattr(lookalikes, "LOOK_ALIKES", {})
    assert trie.closest("сасhе") is None and trie.closest("cache") == "cache"


def test_look_alike_capitals_in_lower_case(spark):
    words = ["the", "the", "how", "kuvaduga", "zuhesefo", "now", "value", "ms", "тема", "tema"]
    odd = {"τhe": "the", "тhe": "the", "нow": "how", "кuvаduga": "kuvaduga", "ζuhesefо": "zuhesefo", "ζuhesefo": "zuhesefo", "νow": "now", "νalue": "value"}
    same = ["тone", "μs", "тема", "τ"]  # not in the vocabulary, the micro sign's mu, one alphabet
    frame = spark.createDataFrame([(w,) for w in (*words, *odd, *same, "µs")], "word string").repartition(4)
    assert {r.word: r.form for r in lookalikes.canonical_words(frame, lowered=True).collect()} == odd | {"µs": "μs"}
    assert {r.word for r in lookalikes.canonical_words(frame).collect()} == {"νalue", "кuvаduga", "ζuhesefо", "νow", "µs"}


def test_empty_tables(spark):
    nothing = articles(spark, []), tokens(spark, []).where("doc_id < 0"), postings(spark, []).where("doc_id < 0")
    some = [(1, "a b c d", "a b c d")]
    for live, words, lists in (nothing, (nothing[0], tokens(spark, some), postings(spark, some)), (articles(spark, some), nothing[1], nothing[2])):
        assert near_duplicates.near_duplicate_pairs(words, live).count() == 0
        assert near_duplicates.near_duplicate_classes(words, live).count() == 0
        assert frequency.term_frequencies(words, live).count() == 0
        assert distinctiveness.scored_terms(live, lists).count() == 0
        assert distinctiveness.most_marking_terms(live, lists).count() == 0
        assert lookalikes.same_looking_pairs(live).count() == 0
        assert segmentation.oversized_articles(live).count() == 0
    assert segmentation.split_articles(nothing[0]).count() == 0 and lookalikes.same_looking_titles(nothing[0]).count() == 0
    assert lookalikes.canonical_words(spark.createDataFrame([], "word string")).count() == 0


def test_null_articles(spark):
    rows = [(None, "x", "y"), (1, None, None)]
    assert segmentation.split_articles(articles(spark, rows)).count() == 1
    assert lookalikes.same_looking_titles(articles(spark, rows)).count() == 0
    assert near_duplicates.near_duplicate_pairs(tokens(spark, rows[1:]), articles(spark, rows)).count() == 0
