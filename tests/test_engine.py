from __future__ import annotations

import json
import pathlib
import threading
from datetime import datetime, timezone

import pytest

from quillon import errors
from quillon.operators import engine as module
from quillon.operators.documents import Document, document_from_json, document_from_values
from quillon.operators.engine import Engine
from quillon.service.config import load, parse_mapping
from quillon.service.rest import Api
from quillon.sources.corpus import read_folder, synthetic


def fingerprint(table):
    queries = ("alpha", "alpha beta", "alpha AND beta", '"alpha beta"', "-alpha", "title:gamma")
    pages = [[(r.id, round(r.score, 6)) for r in table.search(q).ranked.collect()] for q in queries]
    return table.count(), pages


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("engine")))


def test_documents_and_restart(spark, engine):
    t = engine.create_table("log")
    texts = {"d1": "alpha beta", "d2": "alpha", "d3": "beta gamma", "d4": "gamma", "d5": "alpha gamma"}
    t.upsert_many([Document(k, {"title": v, "body": v + " more"}) for k, v in texts.items()])
    t.delete(" d4 ")
    assert t.upsert(Document("d2", {"title": "alpha beta"})) is False
    with pytest.raises(errors.DocumentExists):
        t.create(Document("d1", {"title": "again"}))
    with pytest.raises(errors.DocumentNotFound):
        t.update(Document("d4", {"title": "gone"}))
    with pytest.raises(errors.DocumentNotFound):
        t.delete("d4")
    before = fingerprint(t)
    assert before[0] == 4
    assert [r.id for r in t.search("alpha", fields=["title"], sort=None).ranked.collect()][-1] in ("d1", "d2", "d5")
    again = Engine(spark, engine.root).table("log")
    assert fingerprint(again) == before
    again.compact()
    assert again.stats()["log_records"] == 5  # a tombstone stays as long as a write with a lower number may be under way
    again._store.patience = 0
    again._store.reserve(1)
    again.compact()
    again._store.patience = 3600
    assert fingerprint(again) == before and again.stats()["log_records"] == 4
    again.upsert(Document("d6", {"title": "gamma"}))
    assert again.has("d6") and not again.has("d4")


def test_typed_round_trip_and_conflicts(engine):
    t = engine.create_table("typed", {"created": "date", "sku": "keyword"})
    doc = document_from_json("1", '{"title":"a fox","sku":"LAP-1","price":4999,"onSale":true,"x":null,"created":"2024-01-15"}', t.schema())
    t.create(doc)
    assert t.get("1") == Document("1", {"title": "a fox"}, {"sku": "LAP-1", "onSale": "true"}, {"price": 4999.0}, {"created": datetime(2024, 1, 15, tzinfo=timezone.utc)})
    assert t.schema() == {"created": "date", "sku": "keyword", "title": "text", "price": "number", "onSale": "keyword"}
    assert t.fields() == ["onSale", "sku", "title"]
    with pytest.raises(errors.FieldKindConflict):
        t.upsert(Document("2", {"price": "text"}))
    other = engine.create_table("other")
    other.upsert(Document("a1", keywords={"price": "免费"}))
    assert [r.id for r in other.search("price:免费").ranked.collect()] == ["a1"]
    with pytest.raises(errors.InvalidFieldValue):
        t.search("price:免费")
    with pytest.raises(errors.NotNumericField):
        other.search("price:>1")


@pytest.mark.parametrize(
    ("make", "error"),
    [
        (lambda: document_from_values("1", {"a": [1]}), errors.UnsupportedFieldType),
        (lambda: document_from_values("1", {"a": {"b": 1}}), errors.UnsupportedFieldType),
        (lambda: document_from_values("1", {"a": 2**53 + 1}), errors.IntegerTooLarge),
        (lambda: document_from_values("1", {"a": None}), errors.NoFields),
        (lambda: document_from_values("1", {" ": 1}), errors.EmptyFieldName),
        (lambda: document_from_values("1", {"a": "x"}, {"a": "number"}), errors.InvalidFieldValue),
        (lambda: Document("1", {"a": "x"}, {"a": "y"}).kinds(), errors.AmbiguousField),
    ],
)
def test_document_rules(make, error):
    with pytest.raises(error):
        make()


def test_limits(engine):
    t = engine.table()
    with pytest.raises(errors.EmptyExternalId):
        t.create(Document("  ", {"a": "x"}))
    with pytest.raises(errors.TooManyFields):
        engine.create_table("wide").create(Document("1", {f"f{k}": "x" for k in range(33)}))
    with pytest.raises(errors.DocumentTooLarge):
        t.create(Document("1", {"big": "word " * 100_001}))


def test_catalog(engine):
    for bad in ("", "Products", "-a", "a b", "a" * 65):
        with pytest.raises(errors.BadTableName):
            engine.create_table(bad)
    engine.create_table("twice")
    with pytest.raises(errors.TableExists):
        engine.create_table("twice")
    assert engine.ensure_table("twice", {"a": "number"})[1] is False
    engine.drop_table("twice")
    for name, error in (("twice", errors.TableNotFound), ("default", errors.CannotDropDefault)):
        with pytest.raises(error):
            engine.drop_table(name)
    assert "default" in engine.table_names()


def test_import_once_and_frames(spark, engine):
    t = engine.create_table("made")
    frame = synthetic(spark, 300)
    assert t.import_once("synthetic", frame, {"title": "text", "body": "text"})
    assert not t.import_once("synthetic", frame, {"title": "text", "body": "text"})
    assert t.count() == 300 and t.search("topic01").total() > 0
    body = frame.first().body.split()
    assert 120 <= len(body) <= 200 and frame.collect() == synthetic(spark, 300).collect()


def test_folder_source(spark, tmp_path):
    for name in ("alpha.txt", "beta.md", "gamma.markdown", "notes.log", "ignored.json", ".hidden.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    for sub in ("sub", ".git"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "delta.txt").write_text("inner")
    rows = read_folder(spark, str(tmp_path)).collect()
    assert [(r.id, r.title) for r in rows] == [(n, n) for n in ("alpha", "beta", "delta", "gamma", "notes")]
    assert rows[0].body == "text of alpha.txt"
    (tmp_path / "large.txt").write_text("x" * ((4 << 20) + 1))
    with pytest.raises(errors.DocumentTooLarge):
        read_folder(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    with pytest.raises(errors.NoDocuments):
        read_folder(spark, str(tmp_path / "none"))


def test_rest(spark, tmp_path):
    api = Api(Engine(spark, str(tmp_path)))

    def call(method, url, body=None):
        return api.handle(method, url, json.dumps(body).encode() if body is not None else b"")

    assert call("GET", "/healthz") == (200, {"status": "ok"})
    assert call("PUT", "/api/v1/tables/p", {"schema": {"created": "date"}})[0] == 201
    assert call("PUT", "/api/v1/tables/p", {"schema": {"created": "date"}})[0] == 200
    assert call("PUT", "/api/v1/tables/p", {"schema": {"created": "number"}})[0] == 400
    made = call("POST", "/api/v1/tables/p/documents", {"id": "1", "fields": {"title": "red fox", "price": 10, "created": "2024-01-15"}})
    assert made == (201, {"id": "1", "fields": {"title": "red fox", "price": 10.0, "created": "2024-01-15T00:00:00Z"}})
    assert call("POST", "/api/v1/tables/p/documents", {"id": "1", "fields": {"title": "x"}})[0] == 409
    assert call("PUT", "/api/v1/tables/p/documents/2", {"fields": {"title": "fox"}})[0] == 201
    assert call("PUT", "/api/v1/tables/p/documents/2", {"id": "3", "fields": {"title": "fox"}})[0] == 400
    status, found = call("GET", "/api/v1/tables/p/search?q=fox&highlight=true&sort=price")
    assert status == 200 and found["total"] == 2 and found["hits"][0]["highlights"] == {"title": "red <em>fox</em>"}
    for query in ("q=", "q=fox&limit=a", "q=fox&highlight=maybe", "q=title:%5B1%20TO%202%5D", "q=fox&sort=title"):
        assert call("GET", f"/api/v1/tables/p/search?{query}")[0] == 400
    assert call("GET", "/api/v1/search?q=fox")[1]["total"] == 0
    assert call("DELETE", "/api/v1/tables/p/documents/1")[0] == 204
    assert call("GET", "/api/v1/tables/p/documents/1")[0] == 404
    assert call("POST", "/api/v1/documents", {"id": "a", "other": 1})[0] == 400
    assert api.handle("POST", "/api/v1/documents", b"x" * ((8 << 20) + 1))[0] == 413
    assert call("GET", "/api/v1/tables")[0] == 200 and call("GET", "/api/v1/stats")[0] == 200
    assert call("DELETE", "/api/v1/tables/default")[0] == 400 and call("DELETE", "/api/v1/tables/p")[0] == 204
    assert call("GET", "/api/v1/nothing")[0] == 404


def test_config(tmp_path):
    assert load([], {}).max_clauses == 32
    assert load([], {"QUILLON_ROOT": "/a", "QUILLON_K1": "1.5"}).k1 == 1.5
    assert load(["--root", "/b"], {"QUILLON_ROOT": "/a"}).root == "/b"
    assert parse_mapping("a:text, b:number") == {"a": "text", "b": "number"}
    for bad in ("a", "a:vector"):
        with pytest.raises(errors.InvalidFieldKind):
            parse_mapping(bad)


def test_index_of_a_table_follows_its_writes(spark, engine):
    """After writes the index is used for all documents but those that changed, and gives what a search without it gives."""
    t, plain = engine.create_table("indexed"), Engine(spark, engine.root).table("indexed")
    t.upsert_many([Document(f"d{k}", {"title": f"alpha {'beta' if k % 2 else 'gamma'}"}, numbers={"n": k}) for k in range(6)])

    def same():
        pages = [[[(r.id, round(r.score, 6)) for r in c.search(q).ranked.collect()] for q in ("alpha beta", '"alpha gamma"', "-alpha", "delta n:>=4")] for c in (t.collection(), plain._plain())]
        counts = [sorted(map(tuple, c.field_stats().collect())) + [c.table_stats().first()] for c in (t.collection(), plain._plain())]
        return pages[0] == pages[1] and counts[0] == counts[1] and t.collection().index.sizes == plain._plain().measured()

    assert t.build_index().index is not None and same()
    assert [r.id for r in t.search("alpha AND n:>=4", sort="n:desc").ranked.collect()] == ["d5", "d4"]
    t.delete("d1")
    t.upsert(Document("d2", {"title": "alpha delta", "more": "alpha"}))
    t.upsert(Document("new", {"title": "alpha gamma gamma"}))
    assert same() and t.search("delta").total() == 1
    rows = t.search("alpha").matches
    files = " ".join(rows.inputFiles())
    assert "postings" in files and "/log/" not in files and t.collection() is t.collection()
    with_hits = t.search("gamma").hits(highlight=True).collect()
    assert [r.id for r in with_hits] and all("<em>gamma</em>" in r.highlights["title"] for r in with_hits)
    t.compact()
    assert same() and t.build_index().index is not None and same() and t.stats()["index_bytes"] > 0
    assert len(list(pathlib.Path(engine.root).glob("indexed/index-*"))) == 2
    t._store.vacuum(0)
    assert len(list(pathlib.Path(engine.root).glob("indexed/index-*"))) == 1 and t.search("delta").total() == 1


def test_numbers_given_out_before_an_index_was_built(spark, engine):
    t = engine.create_table("early")
    t.upsert(Document("a", {"title": "alpha"}))
    numbers = t._store.reserve(1)
    t.build_index()
    assert t._meta["index"]["upto"] == numbers + 1
    change = spark.createDataFrame([("early", "b", numbers, "upsert", False, {"title": "alpha"}, None, None)], module._CHANGE)
    t._store.append(change, meta=module._index_before)
    assert t._meta["index"]["upto"] == numbers and t.search("alpha").total() == 2


def test_index_of_a_table_without_text(spark, engine):
    t = engine.create_table("numbers", {"n": "number"})
    assert t.build_index().search("-word").total() == 0
    t.upsert_frame(spark.createDataFrame([("1", 1.0), ("2", 5.0)], "id string, n double"), {"n": "number"})
    assert t.search("n:>2").total() == 1 and t.build_index().search("n:>2").total() == 1
    t.delete_frame(spark.createDataFrame([("2",), (None,), ("none",)], "id string"))
    t.upsert(Document("3", {"title": "word"}))
    assert t.search("n:>=0 OR word").total() == 2 and t.search("word").total() == 1 and t.count() == 2


def test_index_is_built_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "INDEX_RECORDS", 3)
    t = Engine(spark, str(tmp_path), indexed=True).table()
    t.upsert_many([Document(f"d{k}", {"title": "alpha"}) for k in range(3)])
    assert t.collection().index is None
    t.upsert(Document("d4", {"title": "alpha"}))
    assert t.collection().index is not None and t.search("alpha").total() == 4


def test_failed_append_makes_a_table_read_only(spark, engine, monkeypatch):
    from quillon.operators.changes import ChangeStore

    t = engine.create_table("broken")
    t.upsert(Document("1", {"title": "alpha"}))
    with monkeypatch.context() as m:
        m.setattr(ChangeStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("disk full")))
        with pytest.raises(errors.PersistenceBroken):
            t.upsert(Document("2", {"title": "alpha"}))
    with pytest.raises(errors.PersistenceBroken):
        engine.table("broken").upsert(Document("3", {"title": "alpha"}))
    assert engine.table("broken").count() == 1 and Engine(spark, engine.root).table("broken").search("alpha").total() == 1


def test_frames_must_meet_the_rules(spark, engine):
    t = engine.create_table("frames")
    schema = "id string, a string, b string, c string"
    wrong = [
        ([("1", "x", None, None), (" ", "y", None, None)], {"a": "text"}, errors.EmptyExternalId),
        ([(None, "y", None, None)], {"a": "text"}, errors.EmptyExternalId),
        ([("1", "x", None, None), ("2", None, None, "x")], {"a": "text", "b": "keyword"}, errors.NoFields),
        ([("1", "ww " * 60_000, None, "ww " * 60_000)], {"a": "text", "c": "text"}, errors.DocumentTooLarge),
        ([("1", "x", None, None)], {" ": "text"}, errors.EmptyFieldName),
    ]
    for rows, kinds, error in wrong:
        with pytest.raises(error):
            t.upsert_frame(spark.createDataFrame(rows, schema), kinds)
    wide = spark.createDataFrame([("1", *["x"] * 33)], "id string, " + ", ".join(f"f{k} string" for k in range(33)))
    with pytest.raises(errors.TooManyFields):
        t.upsert_frame(wide, {f"f{k}": "keyword" for k in range(33)})
    assert t._store.records() == 0 and t.persisted
    t.upsert_frame(spark.createDataFrame([("1", "ww " * 60_000, "k", None)], schema), {"a": "text", "b": "keyword"})
    assert t.count() == 1 and t.search("b:K").total() == 1
    t.broken = "no disk"
    with pytest.raises(errors.PersistenceBroken):
        t.upsert_frame(spark.createDataFrame([("2", "x", "k", None)], schema), {"a": "text"})
    assert not t.persisted and t.count() == 1


def test_writers_at_the_same_time(spark, engine):
    """Of several that create one document one wins; none makes the table read-only; no change is lost."""
    t, won, lost = engine.create_table("busy"), [], []

    def write(k):
        own = Engine(spark, engine.root).table("busy")
        try:
            own.create(Document("same", {"title": f"by {k}"}))
            won.append(k)
        except errors.DocumentExists:
            lost.append(k)
        own.upsert(Document(f"own{k}", {"title": "mine"}))
        assert own.persisted

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1 and len(lost) == 2 and t.get("same").fields["title"] == f"by {won[0]}"
    assert sorted(r.id for r in t.live().collect()) == ["own0", "own1", "own2", "same"]


@pytest.mark.parametrize("stop", ["reserve", "write", "publish", "merge"])
def test_a_stop_between_steps_loses_nothing(spark, engine, monkeypatch, stop):
    """What was acknowledged stays, with its number; what was not is not there, and later writes are newer."""
    from quillon.operators.changes import ChangeStore

    t = engine.create_table(f"stop-{stop}")
    for k in range(2):
        t.upsert(Document("d", {"title": f"first {k}"}, numbers={"n": k}))
    step = {"reserve": "append", "write": "_write", "publish": "_publish", "merge": "_settle"}[stop]
    with monkeypatch.context() as m:
        m.setattr(ChangeStore, step, lambda *_, **__: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t.upsert(Document("d", {"title": "second"}))
    again = Engine(spark, engine.root).table(t.name)
    assert again.schema() == {"title": "text", "n": "number"}
    assert again.get("d").fields["title"] == ("second" if stop == "merge" else "first 1")
    again.upsert(Document("d", {"title": "third"}))
    assert again.get("d").fields["title"] == "third" and again.count() == 1
    again.compact()
    assert again.get("d").fields["title"] == "third"


def test_the_log_is_compacted_by_itself(spark, engine, monkeypatch):
    monkeypatch.setattr(module, "COMPACT_RECORDS", 8)
    t = engine.create_table("grown")
    for k in range(4):
        t.upsert_many([Document(f"d{i}", {"title": f"text {k}"}) for i in range(2)])
    assert t._store.records() == 2 and len(t._store.state()["runs"]) == 1
    t.upsert_many([Document(f"e{i}", {"title": "more"}) for i in range(9)])
    assert t._store.records() == 11 and t.count() == 11


def test_start_imports_once(spark, tmp_path):
    from quillon.service.__main__ import start

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("alpha")
    config = load(["--root", str(tmp_path / "db"), "--corpus", str(tmp_path / "in"), "--generate", "5", "--mapping", "sku:keyword"], {})
    assert start(spark, config).table().count() == 6
    (tmp_path / "in" / "two.txt").write_text("beta")
    again = start(spark, config).table()
    assert again.count() == 6 and again.schema()["sku"] == "keyword" and again.search("alpha").total() == 1
