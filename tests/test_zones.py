"""Times count in UTC whatever the session's zone."""

from __future__ import annotations

from quillon.functions.analysis import KEEP_ALL
from quillon.operators.search import Collection


def test_dates_in_another_zone(spark):
    rows = spark.createDataFrame([(1, "a", "x", "2024-01-15 23:30:00.0009"), (2, "b", "x", "2024-01-16 00:30:00"), (3, "c", "x", None)], "seq long, id string, t string, raw string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            c = Collection(rows.selectExpr("seq", "id", "t", "cast(raw as timestamp_ntz) as d"), {"t": "text", "d": "date"}, KEEP_ALL)
            found = lambda q, **o: [r.id for r in c.search(q, **o).ranked.collect()]  # noqa: B023, E731
            assert found("d:>=2024-01-16") == ["b"]
            assert found("d:[2024-01-15 TO 2024-01-15T23:30:00Z]") == ["a"]
            assert found("x", sort="d:desc") == ["b", "a", "c"]
            assert c.search("d:>2024-01-16").hits().first().fields["d"] == "2024-01-16T00:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
