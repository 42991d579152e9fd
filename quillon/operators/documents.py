"""Typed documents: routing of plain values to kinds, and the rules a document must meet."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from decimal import Decimal

from quillon.errors import AmbiguousField, DocumentTooLarge, EmptyExternalId, EmptyFieldName, FieldKindConflict, NoFields, TooManyFields, UnsupportedFieldType
from quillon.functions.values import DATE, KEYWORD, NUMBER, TEXT, check_integer, format_date, format_number, parse_date, parse_number

MAX_FIELDS, MAX_TOKENS = 32, 100_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass
class Document:
    """A document whose fields are typed by the map they are in."""

    id: str
    fields: dict[str, str] = field(default_factory=dict)
    keywords: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, float] = field(default_factory=dict)
    dates: dict[str, datetime] = field(default_factory=dict)

    def groups(self) -> list[tuple[str, dict]]:
        return [(TEXT, self.fields), (KEYWORD, self.keywords), (NUMBER, self.numbers), (DATE, self.dates)]

    def kinds(self) -> dict[str, str]:
        """The kind that each field declares."""
        found: dict[str, str] = {}
        for kind, values in self.groups():
            for raw in values:
                name = raw.strip()
                if not name:
                    raise EmptyFieldName("a field needs a name")
                if name in found:
                    raise AmbiguousField(f"field {name!r} is given as {found[name]} and as {kind}")
                found[name] = kind
        if not found:
            raise NoFields("a document needs at least one field")
        return found

    def stored(self) -> dict[str, str]:
        """All fields as text: numbers in their shortest form, dates in UTC."""
        texts = {n.strip(): v for n, v in (*self.fields.items(), *self.keywords.items())}
        texts |= {n.strip(): format_number(v) for n, v in self.numbers.items()}
        return texts | {n.strip(): format_date(millis(v)) for n, v in self.dates.items()}


def millis(moment: datetime) -> int:
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return (aware - _EPOCH) // (datetime.resolution * 1000)


def document_from_values(id: str, values: dict, schema: dict[str, str] | None = None) -> Document:
    """A document from JSON values: text, number and keyword (of a boolean) by their type, null is absent.

    A string in a field that ``schema`` declares as keyword, number or date is parsed as such, or refused.
    """
    doc = Document(id)
    for raw_name, value in values.items():
        name = raw_name.strip()
        if not name:
            raise EmptyFieldName("a field needs a name")
        kind = (schema or {}).get(name, TEXT)
        if value is None:
            continue
        if isinstance(value, bool):
            doc.keywords[name] = str(value).lower()
        elif isinstance(value, str):
            if kind == KEYWORD:
                doc.keywords[name] = value
            elif kind == NUMBER:
                doc.numbers[name] = parse_number(value)
            elif kind == DATE:
                doc.dates[name] = datetime.fromtimestamp(0, timezone.utc) + (parse_date(value) * 1000) * datetime.resolution
            else:
                doc.fields[name] = value
        elif isinstance(value, int):
            doc.numbers[name] = check_integer(value)
        elif isinstance(value, (float, Decimal)):
            doc.numbers[name] = parse_number(str(value))
        elif isinstance(value, datetime):
            doc.dates[name] = value
        else:
            raise UnsupportedFieldType(f"field {name!r} is a {type(value).__name__}; text, numbers, booleans and times are supported")
    if not doc.fields and not doc.keywords and not doc.numbers and not doc.dates:
        raise NoFields("a document needs at least one field")
    return doc


def document_from_json(id: str, text: str, schema: dict[str, str] | None = None) -> Document:
    values = json.loads(text)
    if not isinstance(values, dict):
        raise UnsupportedFieldType("a document is a JSON object")
    return document_from_values(id, values, schema)


def declare(schema: dict[str, str], kinds: dict[str, str]) -> dict[str, str]:
    """``schema`` with more declarations; a field keeps the kind it was declared with first."""
    merged = dict(schema)
    for name, kind in kinds.items():
        if merged.setdefault(name, kind) != kind:
            raise FieldKindConflict(f"field {name!r} is {merged[name]}, not {kind}")
    return merged


def validate(doc: Document, schema: dict[str, str], analyzer) -> None:
    if not doc.id.strip():
        raise EmptyExternalId("a document needs an id")
    kinds = doc.kinds()
    if len(kinds) > MAX_FIELDS:
        raise TooManyFields(f"{len(kinds)} fields; at most {MAX_FIELDS}")
    size = sum(len(analyzer.analyze(v)) for v in doc.fields.values()) + sum(bool(v.strip()) for v in doc.keywords.values())
    if size > MAX_TOKENS:
        raise DocumentTooLarge(f"{size} terms; at most {MAX_TOKENS}")
