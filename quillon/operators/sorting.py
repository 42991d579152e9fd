"""Sort keys: parsing, checking against a schema, and their Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import BadSortField, TooManySortKeys, UnsortableField
from quillon.functions.values import TEXT

MAX_KEYS = 3


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False


# A key: a name, then perhaps a colon and a direction.
_KEY = re.compile(r"\s*(?P<name>[^:]*?)\s*(?::\s*(?P<direction>.*?)\s*)?", re.DOTALL)
_DESCENDING = {None: False, "": False, "asc": False, "desc": True}


def parse_sort(spec: str | None) -> list[SortKey]:
    """``field``, ``field:asc`` or ``field:desc``, comma-separated; ascending by default."""
    found = [(m["name"], m["direction"] and m["direction"].lower()) for m in map(_KEY.fullmatch, (spec or "").split(",")) if m.group().strip()]
    if any(not name for name, _ in found):
        raise BadSortField(f"a key of {spec!r} names no field")
    if wrong := [d for _, d in found if d not in _DESCENDING]:
        raise BadSortField(f"{wrong[0]!r} is neither asc nor desc")
    if len(found) > MAX_KEYS:
        raise TooManySortKeys(f"{len(found)} sort keys; at most {MAX_KEYS}")
    return [SortKey(name, _DESCENDING[d]) for name, d in found]


def check_sort(keys: list[SortKey], kinds: dict[str, str]) -> None:
    if len(keys) > MAX_KEYS:
        raise TooManySortKeys(f"{len(keys)} sort keys; at most {MAX_KEYS}")
    for key in keys:
        if key.field not in kinds:
            raise BadSortField(f"there is no field {key.field!r}")
        if kinds[key.field] == TEXT:
            raise UnsortableField(f"text field {key.field!r} can't be sorted by")


def ordering(keys: list[SortKey]) -> list[Column]:
    """Missing values last in either direction, then the write order. Without keys: the best score first."""
    if not keys:
        return [F.desc("score"), F.asc("seq")]
    columns = [F.desc_nulls_last(f"_s_{k.field}") if k.descending else F.asc_nulls_last(f"_s_{k.field}") for k in keys]
    return [*columns, F.asc("seq")]
