"""JSON over HTTP: tables, documents and search of an engine.

Each request is a small Spark job; the service is meant for administration and tests, not for low latency.
"""

from __future__ import annotations

import json
import logging
import re
import time
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from quillon.errors import QuillonError
from quillon.functions.values import format_date
from quillon.operators.documents import Document, document_from_values, millis
from quillon.operators.engine import DEFAULT_TABLE, Engine, Table
from quillon.operators.sorting import parse_sort

MAX_BODY = 8 << 20
_log = logging.getLogger(__name__)


class BadRequest(QuillonError):
    pass


class TooLarge(QuillonError):
    status, code = 413, "PAYLOAD_TOO_LARGE"


class NoRoute(QuillonError):
    status, code = 404, "NOT_FOUND"


_ROUTES = [
    ("GET", r"/healthz", "health"),
    ("GET", r"/api/v1/stats", "stats"),
    ("GET", r"/api/v1/tables", "list_tables"),
    ("PUT", r"/api/v1/tables/(?P<table>[^/]+)", "put_table"),
    ("GET", r"/api/v1/tables/(?P<table>[^/]+)", "get_table"),
    ("DELETE", r"/api/v1/tables/(?P<table>[^/]+)", "drop_table"),
    *(
        (method, rf"/api/v1{scope}{tail}", action)
        for scope in ("", r"/tables/(?P<table>[^/]+)")
        for method, tail, action in (
            ("POST", "/documents", "create_document"),
            ("PUT", r"/documents/(?P<id>[^/]+)", "put_document"),
            ("GET", r"/documents/(?P<id>[^/]+)", "get_document"),
            ("DELETE", r"/documents/(?P<id>[^/]+)", "delete_document"),
            ("GET", "/search", "search"),
        )
    ),
]


def _as_json(doc: Document) -> dict:
    dates = {n: format_date(millis(v)) for n, v in doc.dates.items()}
    return {"id": doc.id, "fields": {**doc.fields, **doc.keywords, **doc.numbers, **dates}}


def _one(params: dict[str, list[str]], name: str, default: str = "") -> str:
    return params.get(name, [default])[0]


def _integer(params: dict[str, list[str]], name: str, default: int) -> int:
    raw = _one(params, name)
    if raw and not re.fullmatch(r"[+-]?\d+", raw):
        raise BadRequest(f"{name} is no integer: {raw!r}")
    return int(raw) if raw else default


def _boolean(params: dict[str, list[str]], name: str) -> bool:
    raw = _one(params, name)
    known = {"": False, "1": True, "t": True, "true": True, "0": False, "f": False, "false": False}
    if raw.lower() not in known:
        raise BadRequest(f"{name} is no boolean: {raw!r}")
    return known[raw.lower()]


class Api:
    """The routes as a function of method, path, query and body; usable without a socket."""

    def __init__(self, engine: Engine, max_clauses: int = 32):
        self.engine, self.max_clauses = engine, max_clauses

    def handle(self, method: str, url: str, body: bytes = b"") -> tuple[int, dict | None]:
        parts = urlsplit(url)
        try:
            if len(body) > MAX_BODY:
                raise TooLarge(f"a body has at most {MAX_BODY} bytes")
            for verb, pattern, action in _ROUTES:
                m = re.fullmatch(pattern, parts.path)
                if m and verb == method:
                    names = {k: unquote(v) for k, v in m.groupdict().items()}
                    return getattr(self, action)(names, parse_qs(parts.query, keep_blank_values=True), body)
            raise NoRoute(f"no route {method} {parts.path}")
        except QuillonError as e:
            return e.status, {"error": {"code": e.code, "message": str(e) if e.status < 500 else "internal error"}}
        except Exception:
            _log.exception("%s %s failed", method, parts.path)
            return 500, {"error": {"code": "INTERNAL", "message": "internal error"}}

    def _table(self, names: dict) -> Table:
        return self.engine.table(names.get("table", DEFAULT_TABLE))

    @staticmethod
    def _body(body: bytes, allowed: set[str]) -> dict:
        try:
            value = json.loads(body, parse_float=Decimal)
        except ValueError as e:
            raise BadRequest(f"the body is no JSON: {e}") from e
        if not isinstance(value, dict) or (unknown := set(value) - allowed):
            raise BadRequest("the body is no object" if not isinstance(value, dict) else f"unknown members: {', '.join(sorted(unknown))}")
        return value

    def health(self, names, params, body):  # noqa: ANN001, ANN201
        return 200, {"status": "ok"}

    def _info(self, table: Table) -> dict:
        return table.stats() | {"schema": table.schema(), "persisted": table.persisted}

    def stats(self, names, params, body):  # noqa: ANN001, ANN201
        tables = self.engine.stats()
        return 200, {**next(t for t in tables if t["table"] == DEFAULT_TABLE), "tables": tables}

    def list_tables(self, names, params, body):  # noqa: ANN001, ANN201
        return 200, {"tables": [self._info(self.engine.table(n)) for n in self.engine.table_names()]}

    def put_table(self, names, params, body):  # noqa: ANN001, ANN201
        schema = self._body(body, {"schema"}).get("schema") or {} if body.strip() else {}
        if not isinstance(schema, dict):
            raise BadRequest("schema is no object")
        table, made = self.engine.ensure_table(names["table"], schema)
        return 201 if made else 200, self._info(table)

    def get_table(self, names, params, body):  # noqa: ANN001, ANN201
        return 200, self._info(self._table(names))

    def drop_table(self, names, params, body):  # noqa: ANN001, ANN201
        self.engine.drop_table(names["table"])
        return 204, None

    def _document(self, table: Table, id: str, fields: object) -> Document:
        if not isinstance(fields, dict):
            raise BadRequest("fields is no object")
        return document_from_values(id, fields, table.schema())

    def create_document(self, names, params, body):  # noqa: ANN001, ANN201
        table, given = self._table(names), self._body(body, {"id", "fields"})
        doc = self._document(table, str(given.get("id") or ""), given.get("fields") or {})
        table.create(doc)
        return 201, _as_json(table.get(doc.id))

    def put_document(self, names, params, body):  # noqa: ANN001, ANN201
        table, given = self._table(names), self._body(body, {"id", "fields"})
        if given.get("id") and given["id"] != names["id"]:
            raise BadRequest("the id of the body is not that of the path")
        new = table.upsert(self._document(table, names["id"], given.get("fields") or {}))
        return 201 if new else 200, _as_json(table.get(names["id"]))

    def get_document(self, names, params, body):  # noqa: ANN001, ANN201
        return 200, _as_json(self._table(names).get(names["id"]))

    def delete_document(self, names, params, body):  # noqa: ANN001, ANN201
        self._table(names).delete(names["id"])
        return 204, None

    def search(self, names, params, body):  # noqa: ANN001, ANN201
        table, began = self._table(names), time.perf_counter()
        fields = [f.strip() for f in params.get("field", []) if f.strip()]
        found = table.search(
            _one(params, "q").strip(),
            fields=fields,
            limit=_integer(params, "limit", 10),
            offset=_integer(params, "offset", 0),
            sort=parse_sort(_one(params, "sort")),
            max_clauses=self.max_clauses,
        )
        marks = _boolean(params, "highlight")
        rows = found.hits(highlight=marks).collect()
        hits = [{"id": r.id, "score": r.score, "fields": r.fields} | ({"highlights": r.highlights} if marks else {}) for r in rows]
        return 200, {"took_ms": (time.perf_counter() - began) * 1000, "total": found.total(), "hits": hits}


def serve(engine: Engine, address: str = "127.0.0.1:8080", max_clauses: int = 32) -> ThreadingHTTPServer:
    """A server for the engine, bound and not yet running; call ``serve_forever``."""
    api = Api(engine, max_clauses)

    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(size, MAX_BODY + 1))
            status, value = api.handle(self.command, self.path, body)
            data = b"" if value is None else json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _run

        def log_message(self, format: str, *args) -> None:  # noqa: A002, ANN002
            _log.info(format, *args)

    host, _, port = address.rpartition(":")
    return ThreadingHTTPServer((host, int(port)), Handler)
