from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon import errors
from quillon.functions.analysis import KEEP_ALL
from quillon.functions.values import date_text, format_date, format_number, number_text, parse_date, parse_number
from quillon.operators.search import Collection
from quillon.operators.sorting import parse_sort
from quillon.plans.syntax import Bool, Term


def ids(collection, query, **options):
    return [r.id for r in collection.search(query, **options).ranked.collect()]


@pytest.fixture(scope="module")
def boolean(spark, tmp_path_factory):
    rows = [
        (1, "d1", "go search", "fast inverted index written in go"),
        (2, "d2", "search engines", "a search engine relies on an inverted index"),
        (3, "d3", "baking bread", "knead the dough then bake it"),
    ]
    frame = spark.createDataFrame(rows, "seq long, id string, title string, body string")
    path = str(tmp_path_factory.mktemp("boolean"))
    return Collection(frame, {"title": "text", "body": "text"}, KEEP_ALL).prepare(path + "/t").with_index(path + "/i")


@pytest.mark.parametrize("mode", ["scan", "postings"])
@pytest.mark.parametrize(
    ("query", "options", "expected"),
    [
        ("inverted", {}, {"d1", "d2"}),
        ("inverted bread", {}, {"d1", "d2", "d3"}),
        ("inverted AND index", {}, {"d1", "d2"}),
        ("inverted AND bread", {}, set()),
        ("search -engine", {}, {"d1"}),
        ("-bread", {}, {"d1", "d2"}),
        ('"written fast"', {}, set()),
        ('"inverted index"', {}, {"d1", "d2"}),
        ("go", {"fields": ["title"]}, {"d1"}),
        ("go", {"fields": ["nope"]}, set()),
        ("body:go title:search", {}, {"d1", "d2"}),
        ("nope:go", {}, set()),
        ("...", {}, set()),
        ("inverted AND ...", {}, set()),
    ],
)
def test_boolean(boolean, mode, query, options, expected):
    result = boolean.search(query, mode=mode, **options)
    found = result.ranked.collect()
    assert {r.id for r in found} == expected
    assert result.total() == len(expected)
    other = boolean.search(query, mode="scan", **options).ranked.collect()
    assert [(r.id, round(r.score, 6)) for r in found] == [(r.id, round(r.score, 6)) for r in other]


def test_ranking_and_paging(boolean):
    assert ids(boolean, "search")[0] == "d2"
    pages = [ids(boolean, "inverted", limit=1, offset=k) for k in (0, 1, 99)]
    assert sorted(pages[0] + pages[1]) == ["d1", "d2"] and pages[2] == []
    assert boolean.search("inverted", limit=1, offset=99).total() == 2


def test_boost(spark):
    rows = spark.createDataFrame([(1, "d1", "alpha gamma"), (2, "d2", "alpha beta")], "seq long, id string, t string")
    c = Collection(rows, {"t": "text"}, KEEP_ALL)
    assert ids(c, Bool(must=[Term("alpha")], should=[Term("beta")])) == ["d2", "d1"]
    assert ids(c, Bool(must=[Term("alpha")], must_not=[Term("gamma")])) == ["d2"]


def test_phrases_keep_gaps_and_fields(spark):
    rows = spark.createDataFrame([(1, "d1", "quick the brown fox", "x"), (2, "d2", "quick brown fox", "y"), (3, "d3", "full width", "alpha"), (4, "d4", "alpha", "beta")], "seq long, id string, t string, u string")
    c = Collection(rows, {"t": "text", "u": "text"})
    assert ids(c, '"quick the brown"') == ["d1"]
    assert ids(c, '"quick brown"') == ["d2"]
    assert ids(c, "full-width") == ["d3"]
    assert ids(c, '"alpha beta"') == []


def test_ties_and_clamps(spark):
    rows = spark.createDataFrame([(k, f"d{k:03d}", "same token here") for k in range(150)], "seq long, id string, t string")
    c = Collection(rows, {"t": "text"})
    assert ids(c, "token", limit=30) == [f"d{k:03d}" for k in range(30)]
    assert len(ids(c, "token", limit=10_000)) == 100 and len(ids(c, "token", limit=-1)) == 10
    assert c.search("token").total() == 150


@pytest.fixture(scope="module")
def typed(spark):
    day = lambda text: datetime.fromisoformat(text)
    rows = [
        (1, "d1", "cheap laptop", "LAP-1", 500.0, day("2024-01-15")),
        (2, "d2", "mid laptop", "LAP-2", 1500.0, day("2024-06-15")),
        (3, "d3", "expensive desktop", "DSK-1", 3000.0, day("2024-12-15")),
        (4, "d4", "cheap mouse", "MOU-1", 50.0, day("2023-05-01")),
    ]
    frame = spark.createDataFrame(rows, "seq long, id string, title string, sku string, price double, created timestamp")
    return Collection(frame, {"title": "text", "sku": "keyword", "price": "number", "created": "date"}, KEEP_ALL)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("price:[500 TO 1500]", "d1 d2"),
        ("price:{500 TO 1500}", ""),
        ("price:[500 TO 1500}", "d1"),
        ("price:{500 TO 1500]", "d2"),
        ("price:{500 TO 3000}", "d2"),
        ("price:[* TO 100]", "d4"),
        ("price:[1500 TO *]", "d2 d3"),
        ("price:[1500 TO 500]", ""),
        ("price:1500", "d2"),
        ("price:999", ""),
        ("created:[2024-01-01 TO 2024-06-15]", "d1 d2"),
        ("created:[2024-06-16 TO *]", "d3"),
        ("created:>2024-06-15", "d3"),
        ("created:2024-06-15", "d2"),
        ("title:laptop AND price:[1000 TO 2000]", "d2"),
        ("title:desktop OR price:[* TO 100]", "d3 d4"),
        ("price:>=1500", "d2 d3"),
        ("price:>1500", "d3"),
        ("price:<=500", "d1 d4"),
        ("price:<500", "d4"),
        ("-price:<500", "d1 d2 d3"),
        ("sku:LAP-1", "d1"),
        ("sku:lap-1", "d1"),
        ("sku:LAP", ""),
    ],
)
def test_typed_fields(typed, query, expected):
    assert sorted(ids(typed, query)) == expected.split()


def test_ranges_score_nothing(typed):
    assert {r.score for r in typed.search("price:[* TO 5000]").ranked.collect()} == {0.0}


def test_ranges_reach_the_scan(spark, tmp_path, typed):
    typed.docs.write.parquet(str(tmp_path / "d"))
    stored = Collection(spark.read.parquet(str(tmp_path / "d")), typed.kinds, KEEP_ALL)
    plan = stored.search("laptop AND price:[1000 TO 2000]").ranked._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(price,1000.0)" in plan and "LessThanOrEqual(price,2000.0)" in plan


@pytest.mark.parametrize(
    ("query", "error"),
    [("title:[a TO z]", errors.NotNumericField), ("nope:[1 TO 2]", errors.NotNumericField), ("sku:>1", errors.NotNumericField), ("price:abc", errors.InvalidFieldValue), ("price:[abc TO 100]", errors.InvalidFieldValue), ("price:1d", errors.InvalidFieldValue), ("price:NaN", errors.InvalidFieldValue), ("created:2024", errors.InvalidFieldValue), ("laptop AND absent AND price:x", errors.InvalidFieldValue)],
)
def test_query_errors(typed, query, error):
    with pytest.raises(error):
        typed.search(query)


def test_sorting(spark):
    start = datetime(2024, 1, 1)
    rows = [(k, f"p{k:02d}", "widget common", 100.0 * k if k < 10 else None, start + timedelta(days=k), f"S{k:02d}") for k in range(20)]
    c = Collection(spark.createDataFrame(rows, "seq long, id string, name string, price double, created timestamp, sku string"), {"name": "text", "price": "number", "created": "date", "sku": "keyword"})
    up = [f"p{k:02d}" for k in range(20)]
    assert ids(c, "widget", sort="price", limit=20) == up
    assert ids(c, "widget", sort="price:desc", limit=20) == up[9::-1] + up[10:]
    assert ids(c, "widget", sort="sku:DESC", limit=3) == ["p19", "p18", "p17"]
    paged = [i for k in range(0, 20, 7) for i in ids(c, "widget", sort="created:desc", limit=7, offset=k)]
    assert paged == up[::-1]
    for spec, error in (("nope", errors.BadSortField), ("name", errors.UnsortableField), (":asc", errors.BadSortField), ("sku:up", errors.BadSortField), ("a,b,c,d", errors.TooManySortKeys)):
        with pytest.raises(error):
            c.search("absent", sort=spec)
    assert parse_sort(" , ") == []


def test_hits_and_statistics(typed):
    hit = typed.search("laptop", limit=1).hits(highlight=True).first()
    assert hit.fields == {"title": "cheap laptop", "sku": "LAP-1", "price": "500", "created": "2024-01-15T00:00:00Z"}
    assert hit.highlights == {"title": "cheap <em>laptop</em>"}
    stats = {r.field: (r.docs, r.total_tokens) for r in typed.field_stats().collect()}
    assert stats == {"title": (4, 8), "sku": (4, 4)}
    row = typed.table_stats().first()
    assert (row.docs, row.fields, row.terms, row.total_tokens) == (4, 2, 10, 12)


def test_empty_collection(spark, tmp_path):
    empty = Collection(spark.createDataFrame([], "seq long, id string, t string, n double"), {"t": "text", "n": "number"})
    assert ids(empty, "word") == [] and ids(empty, "-word", sort="n") == []
    assert ids(empty.prepare(str(tmp_path / "t")).with_index(str(tmp_path / "i")), "word") == []
    assert empty.table_stats().first().docs == 0


def test_values_as_text_in_the_jvm(spark):
    rng = random.Random(4)
    numbers = [0.0, -0.0, 1.0, 10.0, -1.5, 100.0, 0.1, 999999.0, 999999.5, 1e6, 1234567.0, 1e-4, 9.5e-5, 1e-5, -2.5e-300, 1e21, 1e22, 1.7976931348623157e308, 123.456, 2.0**53]
    numbers += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 12) for _ in range(500)]
    moments = [0, 1, -1, 999, 1000, 86_399_999, -86_400_000, 1_705_276_800_120, -62_135_596_800_000, 253_402_300_799_999] + [rng.randrange(-10**13, 10**13) for _ in range(200)]
    made = spark.createDataFrame([(x,) for x in [*numbers, None, float("nan"), float("inf")]], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert all(r.t == format_number(r.x) for r in made[:-3]) and [r.t for r in made[-3:]] == [None] * 3
    shown = spark.createDataFrame([(x,) for x in moments], "x long").select("x", date_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in shown if r.t != format_date(r.x)] == []


def test_values():
    shown = {1e6: "1e+06", 999999.0: "999999", 0.0001: "0.0001", 1e-5: "1e-05", -1.5: "-1.5", 1234567.0: "1.234567e+06", 0.0: "0", 100.0: "100"}
    for value, text in shown.items():
        assert format_number(value) == text and parse_number(text) == value
    assert format_date(parse_date("2024-01-15T10:00:00.1239+02:00")) == "2024-01-15T08:00:00.123Z"
    for bad in ("", "1d", "inf", "nan", "1e999", "0x10", "1_000"):
        with pytest.raises(errors.InvalidFieldValue):
            parse_number(bad)
    for bad in ("2024", "2024-13-01", "2024-01-01 10:00", "now"):
        with pytest.raises(errors.InvalidFieldValue):
            parse_date(bad)
