"""Configuration of the service: command-line flags over environment variables over defaults."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass, field

from quillon.errors import InvalidFieldKind
from quillon.functions.analysis import STOP_WORDS, ChineseAnalyzer, StandardAnalyzer
from quillon.functions.values import parse_kind
from quillon.operators.engine import check_table_name

ENV_PREFIX = "QUILLON_"


@dataclass
class Config:
    address: str = "127.0.0.1:8080"
    root: str = "quillon-data"
    corpus: str = ""
    generate: int = 0
    analyzer: str = "standard"
    dictionary: str = ""
    keep_stop_words: bool = False
    min_length: int = 2
    max_clauses: int = 32
    k1: float = 1.2
    b: float = 0.75
    mapping: dict[str, str] = field(default_factory=dict)
    tables: dict[str, dict[str, str]] = field(default_factory=dict)

    def make_analyzer(self) -> StandardAnalyzer | ChineseAnalyzer:
        stop = () if self.keep_stop_words else STOP_WORDS
        if self.analyzer == "standard":
            return StandardAnalyzer(self.min_length, stop)
        if self.analyzer != "chinese":
            raise ValueError(f"there is no analyzer {self.analyzer!r}")
        with open(self.dictionary, encoding="utf-8") as file:
            return ChineseAnalyzer.from_text(file.read(), min_length=self.min_length, stop_words=stop)


def parse_mapping(text: str) -> dict[str, str]:
    """``field:kind,field:kind`` as a schema."""
    found: dict[str, str] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, colon, kind = (x.strip() for x in part.partition(":"))
        if not name or not colon:
            raise InvalidFieldKind(f"{part!r} is not written field:kind")
        found[name] = parse_kind(kind)
    return found


def read_mapping_file(path: str) -> dict[str, dict[str, str]]:
    """``{table: {field: kind}}`` from a JSON file."""
    with open(path, encoding="utf-8") as file:
        tables = json.load(file)
    return {check_table_name(t): {f: parse_kind(k) for f, k in kinds.items()} for t, kinds in tables.items()}


def load(arguments: list[str] | None = None, environment: dict[str, str] | None = None) -> Config:
    env = os.environ if environment is None else environment
    base, flags = Config(), argparse.ArgumentParser(prog="quillon")
    simple = ("address", "root", "corpus", "generate", "analyzer", "dictionary", "keep_stop_words", "min_length", "max_clauses", "k1", "b")
    for name in simple:
        default, kind = getattr(base, name), type(getattr(base, name))
        raw = env.get(ENV_PREFIX + name.upper())
        if kind is bool:
            flags.add_argument(f"--{name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=default if raw is None else raw.lower() in ("1", "true", "yes"))
        else:
            flags.add_argument(f"--{name.replace('_', '-')}", type=kind, default=default if raw is None else kind(raw))
    flags.add_argument("--mapping", default=env.get(ENV_PREFIX + "MAPPING", ""))
    flags.add_argument("--mapping-file", default=env.get(ENV_PREFIX + "MAPPING_FILE", ""))
    found = flags.parse_args(arguments or [])
    tables = read_mapping_file(found.mapping_file) if found.mapping_file else {}
    return Config(**{n: getattr(found, n) for n in simple}, mapping=parse_mapping(found.mapping), tables=tables)
