"""A syntax tree compiled to Columns: whether a row matches, and its score.

The rows that the Columns run on have, for each (field, term) of the query, the array of its positions, the length
of each field in terms, and the numeric columns that ranges name. Where such rows come from (a scan of analysed
documents, or the postings of the query's terms) makes no difference here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import NilQuery, NotNumericField
from quillon.functions.analysis import fold_text
from quillon.functions.scoring import BM25
from quillon.functions.values import DATE, KEYWORD, NUMBER, moment, parse_bound
from quillon.plans.syntax import Bool, FieldRange, FieldTerm, Node, Phrase, Term


@dataclass(frozen=True)
class Lookup:
    """Occurrences of one analysed clause in one field: its terms and their distances."""

    field: str
    terms: tuple[str, ...]
    steps: tuple[int, ...]


@dataclass
class Clause:
    """A leaf of the analysed query."""

    lookups: list[Lookup] = field(default_factory=list)
    bounds: FieldRange | None = None
    values: tuple[float | None, float | None] = (None, None)


@dataclass
class Group:
    must: list
    should: list
    must_not: list


@dataclass
class Statistics:
    """What scoring needs: documents and mean length by field, document frequency by (field, term)."""

    docs: dict[str, int]
    average: dict[str, float]
    df: dict[tuple[str, str], int]


def analyse(node: Node | None, kinds: dict[str, str], searchable: list[str], fields: list[str] | None, analyzer) -> Clause | Group:
    """The tree with its literals analysed and checked against the schema; every error shows before any job."""
    if node is None:
        raise NilQuery("there is no query")
    chosen = sorted(searchable if not fields else set(fields) & set(searchable))

    def lookups(text: str, among: list[str]) -> Clause:
        found = analyzer.analyze(text)
        if not found:
            return Clause()
        terms, steps = tuple(t.term for t in found), tuple(t.pos - found[0].pos for t in found)
        return Clause([Lookup(f, terms, steps) for f in among])

    def walk(n: Node) -> Clause | Group:
        if isinstance(n, Bool):
            return Group([walk(c) for c in n.must], [walk(c) for c in n.should], [walk(c) for c in n.must_not])
        if isinstance(n, Term):
            return lookups(n.text, chosen)
        if isinstance(n, Phrase):
            return lookups(n.raw, chosen)
        kind = kinds.get(n.field)
        if isinstance(n, FieldRange):
            if kind not in (NUMBER, DATE):
                raise NotNumericField(f"field {n.field!r} is no number or date")
            return Clause(bounds=n, values=tuple(None if b is None else parse_bound(kind, b) for b in (n.lower, n.upper)))
        assert isinstance(n, FieldTerm)
        if kind in (NUMBER, DATE):
            value = parse_bound(kind, n.text)
            return Clause(bounds=FieldRange(n.field, n.text, n.text, True, True), values=(value, value))
        if n.field not in searchable:
            return Clause()
        if kind == KEYWORD:
            term = fold_keyword(n.text)
            return Clause([Lookup(n.field, (term,), (0,))] if term else [])
        return lookups(n.text, [n.field])

    return walk(node)


def fold_keyword(text: str) -> str:
    return text.strip().translate({ord("Σ"): "σ", ord("İ"): "i"}).lower()


def leaves(tree: Clause | Group) -> list[Clause]:
    return [tree] if isinstance(tree, Clause) else [leaf for c in (*tree.must, *tree.should, *tree.must_not) for leaf in leaves(c)]


def wanted_terms(tree: Clause | Group) -> list[tuple[str, str]]:
    """The (field, term) pairs a query looks up, each once, in order."""
    return list(dict.fromkeys((x.field, t) for leaf in leaves(tree) for x in leaf.lookups for t in x.terms))


def wanted_numbers(tree: Clause | Group) -> list[str]:
    return list(dict.fromkeys(leaf.bounds.field for leaf in leaves(tree) if leaf.bounds))


def needs_all_documents(tree: Clause | Group) -> bool:
    """Whether a document without any of the query's terms could match."""
    if isinstance(tree, Clause):
        return tree.bounds is not None
    if tree.must:
        return all(map(needs_all_documents, tree.must))
    return any(map(needs_all_documents, tree.should)) or not tree.should


def range_filter(column: Column, kind: str, data_type: T.DataType, clause: Clause) -> Column:
    """A range as plain comparisons of the stored column, so that it can reach the Parquet scan.

    Dates count in whole milliseconds: a bound is moved to the edge of its millisecond instead of truncating
    the column.
    """
    (low, high), r = clause.values, clause.bounds

    def literal(value: float, step: int = 0) -> Column:
        if kind == DATE:
            return moment(int(value) + step, data_type)
        if isinstance(data_type, T.IntegralType) and float(value).is_integer() and abs(value) < 2**31:
            return F.lit(int(value))
        return F.lit(float(value))

    parts = []
    if low is not None:
        inclusive = r.include_lower
        parts.append(column >= literal(low, 0 if inclusive else 1) if kind == DATE else column >= literal(low) if inclusive else column > literal(low))
    if high is not None:
        inclusive = r.include_upper
        parts.append(column < literal(high, 1 if inclusive else 0) if kind == DATE else column <= literal(high) if inclusive else column < literal(high))
    return reduce(lambda a, b: a & b, parts)


class Compiler:
    """Columns of an analysed query, over rows with ``positions(field, term)`` and ``length(field)``."""

    def __init__(self, stats: Statistics, positions, length, numeric, bm25: BM25):
        self.stats, self.positions, self.length, self.numeric, self.bm25 = stats, positions, length, numeric, bm25

    def compile(self, tree: Clause | Group) -> tuple[Column, Column]:
        return self._leaf(tree) if isinstance(tree, Clause) else self._group(tree)

    def _leaf(self, clause: Clause) -> tuple[Column, Column]:
        if clause.bounds is not None:
            return F.coalesce(self.numeric(clause), F.lit(False)), F.lit(0.0)
        matches, scores = [], []
        for x in clause.lookups:
            # A field without one of the terms can't match; its branch is left out.
            if any(not self.stats.df.get((x.field, t)) for t in x.terms):
                continue
            tf = F.coalesce(self._occurrences(x), F.lit(0))
            docs = self.stats.docs.get(x.field, 0)
            idf = sum(self.bm25.idf(self.stats.df[x.field, t], docs) for t in x.terms)
            matches.append(tf > 0)
            scores.append(self.bm25.weight(idf, tf, F.coalesce(self.length(x.field), F.lit(0)), self.stats.average.get(x.field, 0.0)))
        if not matches:
            return F.lit(False), F.lit(0.0)
        return reduce(lambda a, b: a | b, matches), reduce(lambda a, b: a + b, scores)

    def _occurrences(self, x: Lookup) -> Column:
        if len(x.terms) == 1:
            return F.size(self.positions(x.field, x.terms[0]))
        moved = [self._moved(x.field, t, step) for t, step in zip(x.terms, x.steps)]
        return F.size(reduce(F.array_intersect, moved))

    def _moved(self, name: str, term: str, step: int) -> Column:
        base = F.coalesce(self.positions(name, term), F.array().cast("array<int>"))
        return F.transform(base, lambda p: p - F.lit(step)) if step else base

    def _group(self, group: Group) -> tuple[Column, Column]:
        must, should = ([self.compile(c) for c in part] for part in (group.must, group.should))
        must_not = [self.compile(c)[0] for c in group.must_not]
        if must:
            match = reduce(lambda a, b: a & b, (m for m, _ in must))
        elif should:
            match = reduce(lambda a, b: a | b, (m for m, _ in should))
        else:
            match = F.lit(True)
        for m in must_not:
            match = match & ~m
        scores = [*(s for _, s in must), *(F.when(m, s).otherwise(0.0) for m, s in should)]
        score = reduce(lambda a, b: a + b, scores) if scores else F.lit(0.0)
        return match, F.when(match, score).otherwise(0.0)


def positive_terms(node: Node, analyzer) -> list[str]:
    """The analysed terms that a query looks for, for highlighting: no excluded clauses, no ranges."""
    if isinstance(node, Bool):
        found = [t for c in (*node.must, *node.should) for t in positive_terms(c, analyzer)]
    elif isinstance(node, FieldRange):
        found = []
    else:
        found = [t.term for t in analyzer.analyze(node.raw if isinstance(node, Phrase) else node.text)]
    return list(dict.fromkeys(found))


__all__ = ["Clause", "Compiler", "Group", "Lookup", "Statistics", "analyse", "fold_text", "needs_all_documents", "positive_terms", "range_filter", "wanted_numbers", "wanted_terms"]
