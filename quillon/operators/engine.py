"""Tables with their own schema, documents and change log.

A table's folder holds a log-structured store of its changes, whose manifest also has the table's schema, the numbers
given out and the imports done: each write publishes all it changes as one version. The live documents and every
index are derived from it. Single writes are small appends; ``upsert_frame`` writes a whole DataFrame as one run.
"""

from __future__ import annotations

import contextlib
import functools
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.errors import (
    BadTableName,
    Busy,
    CannotDropDefault,
    DocumentExists,
    DocumentNotFound,
    DocumentTooLarge,
    EmptyExternalId,
    EmptyFieldName,
    EngineClosed,
    FieldKindConflict,
    NoFields,
    PersistenceBroken,
    QuillonError,
    TableExists,
    TableNotFound,
    TooManyFields,
    TooManyTables,
)
from quillon.functions.analysis import StandardAnalyzer
from quillon.functions.scoring import BM25
from quillon.functions.values import DATE, DATE_TEXT, DECIMAL_TEXT, KEYWORD, NUMBER, TEXT, parse_kind
from quillon.operators.changes import ChangeStore, trimmed_id
from quillon.operators.documents import MAX_FIELDS, MAX_TOKENS, Document, declare, document_from_values, validate
from quillon.operators.index import LayeredIndex, PostingIndex
from quillon.operators.search import Collection, SearchResult
from quillon.plans.shipping import ensure_importable
from quillon.plans.workspace import filesystem, materialise, read_buckets, remove

DEFAULT_TABLE, MAX_TABLES = "default", 64
#: A log is compacted when it has at least this many records and more than so many times the live documents.
COMPACT_RECORDS, COMPACT_RATIO = 512, 3
#: An index is built anew when so many changes, and this share of the log, are newer.
INDEX_RECORDS, INDEX_SHARE = 1000, 0.1
_NAME = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")
_CHANGE = "tbl STRING, external STRING, seq BIGINT, op STRING, deleted BOOLEAN, doc_fields MAP<STRING, STRING>, declared MAP<STRING, STRING>, received_at TIMESTAMP"


def check_table_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise BadTableName(f"{name!r} is no table name: small letters, digits, _ and -, at most 64, a letter or digit first")
    return name


def typed(kind: str, raw: Column) -> Column:
    """Stored text as a value of its kind; text that is no number or date of the accepted forms is null."""
    if kind == NUMBER:
        value = F.when(raw.rlike(DECIMAL_TEXT), raw.try_cast("double"))
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if kind == DATE:
        moment = F.when(raw.rlike(DATE_TEXT), F.try_to_timestamp(F.trim(raw)))
        return F.timestamp_millis(F.unix_millis(moment))
    return raw


class _Moved(Exception):
    """The table was written to between a look at it and the write that relies on it."""


@dataclass
class Table:
    """One table. Reads see the changes appended so far; a DataFrame, once made, keeps its snapshot.

    Writers, in this process or others, get numbers of their own and publish one after the other. A write that
    depends on whether its document exists is tried again if another one came first.
    """

    spark: SparkSession
    name: str
    path: str
    analyzer: StandardAnalyzer
    bm25: BM25 = field(default_factory=BM25)
    broken: str | None = None
    #: Whether writes keep an index up to date.
    indexed: bool = False
    _ready: tuple | None = None

    # --- schema ---

    @functools.cached_property
    def _store(self) -> ChangeStore:
        return ChangeStore.open(self.spark, f"{self.path}/log", meta={"kinds": {}, "imported": {}})

    @property
    def _meta(self) -> dict:
        return self._store.state()["meta"]

    @property
    def persisted(self) -> bool:
        """Whether writes still reach the log."""
        return self.broken is None

    @contextlib.contextmanager
    def _writing(self) -> Iterator[None]:
        """Writes fail at once after one that could not be stored; refusals and busy writers leave the table as it is."""
        if self.broken:
            raise PersistenceBroken(f"table {self.name} is read-only: {self.broken}")
        try:
            yield
        except (QuillonError, _Moved):
            raise
        except Exception as e:
            self.broken = str(e)
            raise PersistenceBroken(f"table {self.name} is read-only: {e}") from e

    def schema(self) -> dict[str, str]:
        """All declared fields, also of an empty table."""
        return self._meta["kinds"]

    def declare(self, kinds: dict[str, str]) -> None:
        wanted = {n: parse_kind(k) for n, k in kinds.items()}
        if declare(self.schema(), wanted) != self.schema():
            with self._writing():
                self._store.commit(lambda state: state | {"meta": state["meta"] | {"kinds": declare(state["meta"]["kinds"], wanted)}})

    def fields(self) -> list[str]:
        """Searchable fields that some document has."""
        kinds = self.schema()
        names = sorted(n for n, k in kinds.items() if k in (TEXT, KEYWORD))
        if not names:
            return []
        row = self.collection().docs.agg(*(F.count(n).alias(f"c{k}") for k, n in enumerate(names))).first()
        return [n for k, n in enumerate(names) if row[f"c{k}"]]

    # --- writing ---

    def _append(self, changes: list[tuple[str, bool, dict[str, str]]], runs: dict | None = None) -> None:
        """Stores changes under new numbers; if ``runs`` is given, only while the log still consists of them."""

        began = time.time()

        def unmoved(state: dict) -> None:
            if time.time() - began > self._store.patience:
                raise Busy(f"a write to table {self.name} took too long")
            if runs is not None and state["runs"].keys() != runs.keys():
                raise _Moved

        with self._writing():
            first = self._store.reserve(len(changes))
            now = datetime.now(timezone.utc)
            rows = [(self.name, id, first + k, "delete" if gone else "upsert", gone, fields, None, now) for k, (id, gone, fields) in enumerate(changes)]
            self._store.append(self.spark.createDataFrame(rows, _CHANGE), meta=_index_before, only_if=unmoved)
        self._tidy()

    def _tidy(self) -> None:
        """What is due after a write."""
        self.maybe_compact()
        if self.indexed:
            self.maybe_index()

    def _admit(self, doc: Document) -> tuple[str, bool, dict[str, str]]:
        self.declare(doc.kinds())
        validate(doc, self.schema(), self.analyzer)
        return doc.id.strip(), False, doc.stored()

    def _change_one(self, change: tuple[str, bool, dict[str, str]], refuse: Callable[[bool], Exception | None] = lambda found: None) -> bool:
        """Stores a change of one document unless ``refuse`` gives an error for whether it exists; whether it did."""
        while True:
            runs = self._store.state()["runs"]
            found = self.has(change[0])
            if error := refuse(found):
                raise error
            with contextlib.suppress(_Moved):
                self._append([change], runs)
                return found

    def create(self, doc: Document) -> None:
        self._change_one(self._admit(doc), lambda found: DocumentExists(f"document {doc.id!r} exists") if found else None)

    def update(self, doc: Document) -> None:
        self._change_one(self._admit(doc), lambda found: None if found else DocumentNotFound(f"there is no document {doc.id!r}"))

    def upsert(self, doc: Document) -> bool:
        """Replaces a document whole; whether it was new."""
        return not self._change_one(self._admit(doc))

    def upsert_many(self, docs: list[Document]) -> None:
        """Several documents as one append; the last of equal ids holds."""
        self._append([self._admit(d) for d in docs])

    def upsert_frame(self, frame: DataFrame, kinds: dict[str, str], id: str = "id", label: str | None = None) -> None:
        """All rows of a frame as documents. Rows of one id in the same frame: the later in read order holds.

        Every row must meet the rules of a document; if one doesn't, nothing is stored. The rules are observed while
        the rows are written, so the frame is read once.
        """
        if any(not n.strip() for n in kinds):
            raise EmptyFieldName("a field needs a name")
        self.declare(kinds)
        values = [x for n in kinds for x in (F.lit(n.strip()), _stored_text(kinds[n], F.col(n)))]
        fields = F.map_filter(F.create_map(*values), lambda _, v: v.isNotNull()) if values else F.create_map().cast("map<string,string>")
        # A document has no more terms than its texts have characters, so only very long ones are analysed here.
        texts = [n for n, k in kinds.items() if parse_kind(k) == TEXT]
        add = lambda sizes: sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(len(kinds) - len(texts)))
        size = F.when(add(F.char_length(F.col(n)) for n in texts) > MAX_TOKENS, add(F.size(self.analyzer.tokens(F.col(n))) for n in texts)).otherwise(0)
        with self._writing():
            base = self._store.reserve(frame.rdd.getNumPartitions() << 33)
            numbered = frame.select(
                F.lit(self.name).alias("tbl"),
                F.col(id).cast("string").alias("external"),
                (F.monotonically_increasing_id() + base).alias("seq"),
                F.lit("upsert").alias("op"),
                F.lit(False).alias("deleted"),
                fields.alias("doc_fields"),
                F.lit(None).cast("map<string,string>").alias("declared"),
                F.current_timestamp().alias("received_at"),
                size.alias("size"),
            )
            blank = F.coalesce(trimmed_id(F.col("external")) == "", F.lit(True))
            observed = {"blank": F.count_if(blank), "empty": F.count_if(F.size("doc_fields") == 0), "most": F.max(F.size("doc_fields")), "largest": F.max("size")}

            def check(seen: dict) -> None:
                if seen["blank"]:
                    raise EmptyExternalId(f"{seen['blank']} rows have no id")
                if seen["empty"]:
                    raise NoFields(f"{seen['empty']} rows have no field")
                if (seen["most"] or 0) > MAX_FIELDS:
                    raise TooManyFields(f"a row has {seen['most']} fields; at most {MAX_FIELDS}")
                if (seen["largest"] or 0) > MAX_TOKENS:
                    raise DocumentTooLarge(f"a row has {seen['largest']} terms; at most {MAX_TOKENS}")

            def mark(meta: dict, facts: dict) -> dict:
                done = {label: datetime.now(timezone.utc).isoformat()} if label else {}
                return _index_before(meta | {"imported": meta["imported"] | done}, facts)

            began = time.time()

            def in_time(state: dict) -> None:
                if time.time() - began > self._store.patience:
                    raise Busy(f"a write to table {self.name} took too long")
                if label in state["meta"]["imported"]:
                    raise _Moved

            self._store.append(numbered, observed=observed, check=check, meta=mark, only_if=in_time)
        self._tidy()

    def delete(self, id: str) -> None:
        self._change_one((id.strip(), True, {}), lambda found: None if found else DocumentNotFound(f"there is no document {id!r}"))

    def delete_frame(self, frame: DataFrame, id: str = "id") -> None:
        """Deletes the documents whose ids a frame has; ids that no document has, and null ones, change nothing."""
        with self._writing():
            base = self._store.reserve(frame.rdd.getNumPartitions() << 33)
            gone = frame.select(
                F.lit(self.name).alias("tbl"),
                F.col(id).cast("string").alias("external"),
                (F.monotonically_increasing_id() + base).alias("seq"),
                F.lit("delete").alias("op"),
                F.lit(True).alias("deleted"),
                F.lit(None).cast("map<string,string>").alias("doc_fields"),
                F.lit(None).cast("map<string,string>").alias("declared"),
                F.current_timestamp().alias("received_at"),
            )
            self._store.append(gone, meta=_index_before)
        self._tidy()

    def maybe_compact(self) -> bool:
        """Compacts when the log has grown far beyond the live documents; called after every write.

        The documents are counted when the log is that far beyond their last count, which then is that of now.
        """
        state = self._store.state()
        records, known = sum(r["records"] for r in state["runs"].values()), state["meta"].get("known", 0)
        if records < COMPACT_RECORDS or records <= COMPACT_RATIO * known:
            return False
        live = self.count()
        if records > COMPACT_RATIO * live:
            self.compact()
            live = max(live, self._store.records())  # with the tombstones that had to stay
        with self._writing():
            self._store.commit(lambda now: now | {"meta": now["meta"] | {"known": live}})
        return records > COMPACT_RATIO * live

    def compact(self) -> None:
        """Leaves one run of the live documents, and tombstones that a write still under way could need."""
        with self._writing():
            self._store.compact(self._store.horizon())

    def import_once(self, label: str, frame: DataFrame, kinds: dict[str, str], id: str = "id") -> bool:
        """``upsert_frame`` unless an import of this label is done already; both are one version of the log."""
        if label in self._meta["imported"]:
            return False
        try:
            self.upsert_frame(frame, kinds, id, label)
        except _Moved:
            return False
        return True

    # --- reading ---

    def live(self) -> DataFrame:
        """``id, seq, doc_fields`` of the live documents."""
        return self._store.live().select(F.col("external").alias("id"), "seq", "doc_fields")

    def collection(self) -> Collection:
        """The live documents with a typed column per declared field; with stored tokens and postings where there is an index.

        An index stays of use when the table is written to: documents that changed since are left out of it, and
        only their present versions, read from the runs that are newer, are analysed. What that gives is kept until
        the next write.
        """
        state = self._store.state()
        index = state["meta"].get("index")
        if index is None or index["analyzer"] != self.analyzer.fingerprint:
            return self._plain()
        key = (index["path"], index["upto"], sorted(state["runs"]), state["meta"]["kinds"])
        if self._ready is None or self._ready[0] != key:
            self._ready = (key, self._layered(state, index))
        return self._ready[1]

    def build_index(self) -> Collection:
        """Analyses the live documents and stores tokens and postings, for the changes published so far.

        The index is derived: it is found by the state it was built from and never repaired. A former index stays as
        long as replaced runs do.
        """
        began = self._store.state()
        upto, path = began["next_seq"], f"{self.path}/index-{uuid.uuid4().hex[:12]}"
        buckets = max(began["buckets"], self.spark.sparkContext.defaultParallelism)
        made = self._plain().prepare(f"{path}/tokens", buckets).with_index(f"{path}/postings")
        index = {"path": path, "buckets": buckets, "kinds": made.kinds, "analyzer": self.analyzer.fingerprint, "sizes": made.sizes, "schema": made.analysed.schema.json()}

        def adopt(state: dict) -> dict:
            # A write that got its numbers before and was published meanwhile is newer than the index.
            late = [r["low"] for n, r in state["runs"].items() if n not in began["runs"] and r["low"] is not None]
            old = state["meta"].get("index")
            retired = state["retired"] | ({old["path"]: time.time()} if old else {})
            return state | {"retired": retired, "meta": state["meta"] | {"index": index | {"upto": min([upto, *late])}}}

        with self._writing():
            self._store.commit(adopt)
        return self.collection()

    def maybe_index(self) -> bool:
        """Builds the index anew when many changes are newer than it."""
        state = self._store.state()
        index = state["meta"].get("index")
        upto = index["upto"] if index else 0
        newer = sum(r["records"] for r in state["runs"].values() if r["high"] is not None and r["high"] >= upto)
        if min(newer, state["next_seq"] - upto) <= max(INDEX_RECORDS, INDEX_SHARE * sum(r["records"] for r in state["runs"].values())):
            return False
        self.build_index()
        return True

    def _layered(self, state: dict, index: dict) -> Collection:
        kinds, path = state["meta"]["kinds"], index["path"]
        sizes = {f: tuple(x) for f, x in index["sizes"].items()}
        stored = read_buckets(self.spark, f"{path}/tokens", StructType.fromJson(json.loads(index["schema"])), "seq", index["buckets"])
        known = Collection(stored, index["kinds"], self.analyzer, self.bm25).prepared(stored, sizes)
        base = replace(known, index=PostingIndex.open(self.spark, f"{path}/postings", sizes))
        newer = any(r["high"] is not None and r["high"] >= index["upto"] for r in state["runs"].values())
        if not newer and kinds == index["kinds"]:
            return base
        changes = materialise(self._store.newest(index["upto"]).withColumnRenamed("external", "id"))
        changed = changes.select("id")
        fresh = Collection(self._columns(changes.where(~F.col("deleted")), kinds), kinds, self.analyzer, self.bm25)
        fresh = replace(fresh, analysed=materialise(fresh.with_lengths()))
        # Fields that are new since the index are null in its documents.
        kept = base.analysed.join(changed, "id", "left_anti").select([c if c in base.analysed.columns else F.lit(None).cast(t).alias(c) for c, t in fresh.analysed.dtypes])
        both = Collection(kept.unionByName(fresh.analysed), kinds, self.analyzer, self.bm25)
        gone = replace(known, docs=stored.join(changed, "id", "left_semi"), analysed=stored.join(changed, "id", "left_semi"), sizes=None).measured()
        added = fresh.measured()
        now = {f: tuple(sizes.get(f, (0, 0))[k] - gone.get(f, (0, 0))[k] + added[f][k] for k in (0, 1)) for f in both.searchable}
        whole = both.prepared(both.docs, now)
        return replace(whole, index=LayeredIndex.over(base.index, changed, fresh.analysed, both.searchable, now))

    def _plain(self) -> Collection:
        kinds = self.schema()
        return Collection(self._columns(self.live(), kinds), kinds, self.analyzer, self.bm25)

    @staticmethod
    def _columns(live: DataFrame, kinds: dict[str, str]) -> DataFrame:
        return live.select("seq", "id", *(typed(k, F.element_at("doc_fields", n)).alias(n) for n, k in sorted(kinds.items())))

    def search(self, query: str, **options) -> SearchResult:  # noqa: ANN003
        return self.collection().search(query, **options)

    def has(self, id: str) -> bool:
        return not self.live().where(F.col("id") == id.strip()).isEmpty()

    def get(self, id: str) -> Document:
        """A document with typed values; text that doesn't read as its kind comes back as text."""
        row = self.live().where(F.col("id") == id.strip()).first()
        if row is None:
            raise DocumentNotFound(f"there is no document {id!r}")
        doc, kinds = Document(row.id), self.schema()
        for name, value in row.doc_fields.items():
            kind = kinds.get(name, TEXT)
            try:
                one = document_from_values(row.id, {name: value}, {name: kind})
            except Exception:  # unparsable as its kind
                one = Document(row.id, {name: value})
            for (_, into), (_, values) in zip(doc.groups(), one.groups()):
                into.update(values)
        return doc

    def count(self) -> int:
        return self.live().count()

    def stats(self) -> dict:
        """Documents, distinct terms, fields, total terms, mean length and the bytes of the log."""
        kinds = self.schema()
        if any(k in (TEXT, KEYWORD) for k in kinds.values()):
            row = self.collection().table_stats().first().asDict()
        else:
            row = {"docs": self.count(), "fields": 0, "terms": 0, "total_tokens": 0, "avg_doc_length": 0.0}
        return {"table": self.name, **row, "index_bytes": self.index_bytes(), "log_bytes": self.log_bytes(), "log_records": self._store.records()}

    def index_bytes(self) -> int:
        """Bytes of the stored tokens and postings; 0 without an index."""
        index = self._meta.get("index")
        return filesystem(self.spark, self.path)[0].getContentSummary(filesystem(self.spark, index["path"])[1]).getLength() if index else 0

    def log_bytes(self) -> int:
        fs, path = filesystem(self.spark, f"{self.path}/log")
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def _index_before(meta: dict, facts: dict) -> dict:
    """The index of a table lacks all numbers from its ``upto`` on: also those that were given out before it was built and come now."""
    index = meta.get("index")
    return meta if index is None or facts["low"] is None or facts["low"] >= index["upto"] else meta | {"index": index | {"upto": facts["low"]}}


def _stored_text(kind: str, value: Column) -> Column:
    if kind == DATE:
        return F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return value.cast("string")


@dataclass
class Engine:
    """Isolated tables under one folder; ``default`` always exists."""

    spark: SparkSession
    root: str
    analyzer: StandardAnalyzer = field(default_factory=StandardAnalyzer)
    bm25: BM25 = field(default_factory=BM25)
    #: Declarations of tables, made at the start; a table that exists takes those that are compatible.
    schemas: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Whether writes keep the index of their table up to date.
    indexed: bool = False
    closed: bool = False
    _open: dict[str, Table] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ensure_importable(self.spark)
        for name in self.table_names():
            check_table_name(name)
        if DEFAULT_TABLE not in self.table_names():
            self._make(DEFAULT_TABLE, {})
        for name, kinds in self.schemas.items():
            self.ensure_table(name, kinds)

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _make(self, name: str, kinds: dict[str, str]) -> Table:
        made = self._open[name] = Table(self.spark, name, self._path(name), self.analyzer, self.bm25, indexed=self.indexed)
        made._store.commit(lambda state: state | {"meta": state["meta"] | {"kinds": {n: parse_kind(k) for n, k in kinds.items()}}})
        return made

    def table_names(self) -> list[str]:
        """The tables found in the folder, in order; a folder without a log is none."""
        fs, path = filesystem(self.spark, self.root)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(n for n in names if fs.exists(filesystem(self.spark, f"{self._path(n)}/log/manifest")[1]))

    def table(self, name: str = DEFAULT_TABLE) -> Table:
        if self.closed:
            raise EngineClosed("the engine is closed")
        if name not in self.table_names():
            raise TableNotFound(f"there is no table {name!r}")
        if name not in self._open:
            self._open[name] = Table(self.spark, name, self._path(name), self.analyzer, self.bm25, indexed=self.indexed)
        return self._open[name]

    def create_table(self, name: str, kinds: dict[str, str] | None = None) -> Table:
        check_table_name(name)
        names = self.table_names()
        if name in names:
            raise TableExists(f"table {name!r} exists")
        if len(names) >= MAX_TABLES:
            raise TooManyTables(f"at most {MAX_TABLES} tables")
        return self._make(name, kinds or {})

    def ensure_table(self, name: str, kinds: dict[str, str] | None = None) -> tuple[Table, bool]:
        """The table, made if absent; an existing one takes compatible declarations. Whether it was made."""
        check_table_name(name)
        if name not in self.table_names():
            return self.create_table(name, kinds), True
        found = self.table(name)
        found.declare(kinds or {})
        return found, False

    def drop_table(self, name: str) -> None:
        if name == DEFAULT_TABLE:
            raise CannotDropDefault("the default table can't be dropped")
        self.table(name)
        del self._open[name]
        remove(self.spark, self._path(name))

    def stats(self) -> list[dict]:
        return [self.table(n).stats() for n in self.table_names()]

    def close(self) -> None:
        self.closed = True


__all__ = ["Engine", "FieldKindConflict", "Table", "check_table_name", "typed"]
