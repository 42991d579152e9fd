from __future__ import annotations

import pathlib
import random
import threading
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.operators import changes
from quillon.operators.changes import ChangeStore, current_documents
from quillon.streaming.ingest import ingest

SCHEMA = "rec_id long, tbl string, seq long, op string, external string, doc_fields map<string,string>, deleted boolean, declared map<string,string>, received_at timestamp, run string, r int"


def feed(spark, records):
    rows = [(k, t, s, None, e, f, d, c, None, "clash", 1) for k, (t, s, e, f, d, c) in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def state(df):
    return {(r.tbl, r.external): (r.seq, r.doc_fields) for r in df.collect()}


def replay(records):
    live = {}
    for t, s, e, f, d, c in sorted(records, key=lambda x: (x[1] if x[1] is not None else -(2**63), bool(x[4]))):
        if c or t is None or not (e or "").strip():
            continue
        if d:
            live[t, e.strip()] = None
        else:
            live[t, e.strip()] = (s, f)
    return {k: v for k, v in live.items() if v}


def test_rules(spark):
    records = [
        ("a", 1, "x", {"v": "1"}, False, None),
        ("a", 3, " x ", {"v": "3"}, None, {}),
        ("a", 2, "x", {}, True, None),
        ("a", 4, "x", {"v": "no"}, False, {"v": "text"}),
        ("a", 5, "gone", {"v": "1"}, False, None),
        ("a", 6, "　gone\t", None, True, None),
        ("a", 7, "never", None, True, None),
        ("a", 8, "X", None, False, None),
        ("b", 9, "x", {"v": "b"}, False, None),
        ("b", 9, "x", {"v": "b"}, False, None),
        ("b", None, "n", {"v": "first"}, False, None),
        (None, 1, "x", {"v": "1"}, False, None),
        ("a", 10, None, {"v": "1"}, False, None),
        ("a", 11, " ", {"v": "1"}, False, None),
    ]
    expected = {("a", "x"): (3, {"v": "3"}), ("a", "X"): (8, None), ("b", "x"): (9, {"v": "b"}), ("b", "n"): (None, {"v": "first"})}
    assert state(current_documents(feed(spark, records))) == expected


def test_empty_feed(spark):
    assert state(current_documents(feed(spark, []))) == {}


def test_runs_in_any_order_and_compaction(spark, tmp_path):
    rng = random.Random(7)
    records = [("t", s, rng.choice("abcdefgh" if s % 3 else "h"), {"v": str(s)}, rng.random() < 0.3, None) for s in range(300)]
    delivered = records + rng.sample(records, 60)
    rng.shuffle(delivered)
    store = ChangeStore.open(spark, str(tmp_path / "s"), 3)
    for k in range(0, len(delivered), 60):
        store.append(feed(spark, delivered[k : k + 60]))
    assert len(store.stats()["runs"]) == 6 and {r["level"] for r in store.stats()["runs"].values()} == {0}
    assert state(store.live()) == replay(records)
    store.compact()
    assert len(store.stats()["runs"]) == 1
    assert state(ChangeStore.open(spark, str(tmp_path / "s")).live()) == replay(records)
    late = [("t", 0, e, {"v": "late"}, False, None) for e in "abcdefgh"]
    store.append(feed(spark, late))
    assert state(store.live()) == replay(records + late)
    assert state(store.compact(forget_before=10**6).live()) == replay(records + late)


def files(path):
    return sorted(p for p in pathlib.Path(path).rglob("*.parquet"))


def test_levels_write_a_record_again_as_often_as_there_are_levels(spark, tmp_path):
    store = ChangeStore.open(spark, str(tmp_path / "s"), 2)
    store.fan_in = 2
    written, records = 0, []
    for s in range(14):
        before = set(files(tmp_path))
        records.append(("t", s, f"d{s}", {}, False, None))
        store.append(feed(spark, records[-1:]))
        written += sum(pq.ParquetFile(p).metadata.num_rows for p in set(files(tmp_path)) - before)
        levels = Counter(r["level"] for r in store.state()["runs"].values())
        assert max(levels.values()) <= 2
    assert state(store.live()) == replay(records) and store.records() == 14
    assert max(levels) == 2 and written <= 14 * 3  # a rewrite of all at each merge would be more than 50


def test_a_frame_keeps_its_snapshot(spark, tmp_path):
    """Also one that has not been planned yet when its runs are replaced; without its files it fails."""
    store = ChangeStore.open(spark, str(tmp_path / "s"), 2)
    records = [("t", s, f"d{s % 4}", {"v": str(s)}, s == 5, None) for s in range(8)]
    for k in (0, 4):
        store.append(feed(spark, records[k : k + 4]))
    held, planned = store.live(), store.live()
    planned.collect()
    store.compact()
    store.append(feed(spark, [("t", 100, "d1", {"v": "new"}, False, None)]))
    store.compact()
    assert state(held) == state(planned) == replay(records) != state(store.live())
    assert len(store.state()["retired"]) == 4 and len({p.parent.parent for p in files(tmp_path)}) == 5
    late = store.live()
    store.vacuum(0)
    assert len({p.parent.parent for p in files(tmp_path)}) == 1 and store.state()["retired"] == {}
    for frame in (held, planned):
        with pytest.raises(Exception, match="(?i)not exist"):
            frame.collect()
    assert state(late) == state(store.live()) and len(state(late)) == 4


def test_merge_needs_no_shuffle(spark, tmp_path):
    store = ChangeStore.open(spark, str(tmp_path / "s"), 4)
    for s in range(3):
        store.append(feed(spark, [("t", s, "d", {"v": str(s)}, False, None)]))
    live = store.live()
    live.collect()
    assert "Exchange" not in live._jdf.queryExecution().executedPlan().toString()
    one = live.where("external = 'd'")
    assert one.count() == 1 and one._jdf.queryExecution().executedPlan().toString().count("SelectedBucketsCount: 1 out of 4") == 1
    assert spark.catalog.listTables() == []


def test_folders_that_vanish_while_files_are_listed(spark, tmp_path, monkeypatch):
    store = ChangeStore.open(spark, str(tmp_path / "s"), 2)
    store.append(feed(spark, [("t", 1, "d", {}, False, None)]))
    left, table = [2, 99], type(spark).table

    def sometimes(self, name):
        if left[0]:
            left[0] -= 1
            raise FileNotFoundError(name)
        return table(self, name)

    monkeypatch.setattr(type(spark), "table", sometimes)
    assert len(state(store.live())) == 1 and left[0] == 0
    left[0] = 99
    with pytest.raises(FileNotFoundError):
        store.live()
    assert spark.catalog.listTables() == []


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    store = ChangeStore.open(spark, str(tmp_path / "s"), 2)
    store.append(feed(spark, [("t", 1, "d", {}, False, None)]))
    monkeypatch.setattr(changes, "BUCKET_BYTES", 300)
    store.append(feed(spark, [("t", s, f"d{s}", {"v": "x" * 9}, False, None) for s in range(50)]))
    store.compact().append(feed(spark, [("t", 90, "d", None, True, None)]))
    sizes = [r["buckets"] for r in store.state()["runs"].values()]
    assert sizes[0] == sizes[1] > 2 and len(state(store.live())) == 50


def test_a_refused_batch_leaves_nothing(spark, tmp_path):
    store = ChangeStore.open(spark, str(tmp_path / "s"), 2)

    def refuse(seen):
        assert seen["records"] == 1 and seen["mine"] == 7
        raise ValueError

    with pytest.raises(ValueError):
        store.append(feed(spark, [("t", 7, "d", {}, False, None)]), observed={"mine": F.sum("seq")}, check=refuse)
    assert store.state()["runs"] == {} and files(tmp_path) == []


def test_writers_at_the_same_time(spark, tmp_path):
    """Each publishes the next version from the newest state; numbers are given out once."""
    store, numbers = ChangeStore.open(spark, str(tmp_path / "s"), 2), []

    def write(k):
        own = ChangeStore.open(spark, str(tmp_path / "s"))
        own.fan_in = 3
        for _ in range(3):
            first = own.reserve(2)
            numbers.append(first)
            own.append(feed(spark, [("t", first + i, f"d{k}", {"v": str(first + i)}, False, None) for i in range(2)]))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(numbers) == list(range(1, 19, 2)) and store.state()["next_seq"] == 19
    assert len(state(store.live())) == 3 and max(v for v, _ in state(store.live()).values()) == 18
    stale = store.state()
    store.reserve(1)
    assert store._publish(stale | {"version": stale["version"] + 1}) is False


def test_stream(spark, tmp_path):
    records = [("t", s, f"d{s % 5}", {"v": str(s)}, s % 7 == 0, None) for s in range(40)]
    for k in range(4):
        feed(spark, records[k::4]).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = ChangeStore.open(spark, str(tmp_path / "s"), 2)
    ingest(stream, store, str(tmp_path / "c")).awaitTermination()
    assert state(store.live()) == replay(records)
    ingest(stream, store, str(tmp_path / "c")).awaitTermination()
    assert len(store.stats()["runs"]) == 4
