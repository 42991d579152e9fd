"""Encoding a corpus with a public byte-level BPE vocabulary.

The merge table is compiled into a finite-state transducer that is determinised lazily. A state holds the bytes
whose segmentation is still open, the candidate last tokens at their boundaries and the last token given out.
Reading a byte adds the one token that can end there (the longest suffix that is compatible with the segmentation
before it); as soon as all boundaries from which a longer token can still start share a common ancestor, the
tokens up to it are final and are emitted. The lookahead is bounded by the longest token. States, arcs and whole
words already seen are kept, up to a limit.

Null and empty texts give an empty list. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import codecs
import gc
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.shipping import ensure_importable

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published word pattern of the byte-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MAX_STATES = 150_000
_MAX_WORDS = 300_000
_MAX_WORD_CHARS = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to ids from the lines of a .tiktoken file; ids are also the merge order."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class _State:
    __slots__ = ("arcs", "final", "last", "nodes", "pending")

    def __init__(self, last: int | None, pending: bytes, nodes: dict[int, tuple[int, int]]):
        self.last = last  # token given out most recently
        self.pending = pending  # bytes read and not given out
        self.nodes = nodes  # boundaries in pending from which more can follow: the one before, and the token between
        self.arcs: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.final: tuple[int, ...] | None = None


class Transducer:
    """Text to ids of one byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.words = regex.compile(WORD_PATTERN)
        self.tokens = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.start = _State(None, b"", {})
        self.states: dict[tuple, _State] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token, found by applying the merges in their order; itself for a byte."""
        if (known := self.halves.get(token)) is not None:
            return known
        data, ranks = self.tokens[token], self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        pair = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (token, token)
        self.halves[token] = pair
        return pair

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when they stand side by side.

        They would not if a merge across their border came before one that made them: the border is followed down
        the halves of either token, the later merge first.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        tokens, ranks = self.tokens, self.ranks
        a, b, bound, apart = left, right, 1 << 30, True
        while True:
            if ranks.get(tokens[a] + tokens[b], 1 << 30) < bound:
                apart = False
                break
            # The token that was merged later is undone; an equal rank merges from the left.
            later_left = a > b
            for undo_left in (later_left, not later_left):
                if undo_left:
                    inner, bound_now = self.split(a)[1], a
                    if inner != a:
                        a, bound = inner, bound_now
                        break
                else:
                    inner, bound_now = self.split(b)[0], b + 1
                    if inner != b:
                        b, bound = inner, bound_now
                        break
            else:
                break
        self.fits[left, right] = apart
        return apart

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The arc of ``state`` for ``byte``: the state it leads to and the ids it emits."""
        data, last = state.pending + bytes((byte,)), state.last
        n, ranks, prefixes, nodes = len(data), self.ranks, self.prefixes, state.nodes
        made: tuple[int, int] | None = None
        for start in (0, *nodes):  # in order, so the longest token that fits is found first
            token = ranks.get(data[start:])
            if token is not None:
                left = nodes[start][1] if start else last
                if left is None or self.compatible(left, token):
                    made = (start, token)
                    break
        if data in prefixes:  # a token may still start where the state starts, so nothing is final
            if (target := self.states.get((last, data))) is None:
                target = self.states[last, data] = _State(last, data, {**nodes, n: made})
            return target, ()
        through: dict[int, int] = {}
        ends = [k for k in nodes if data[k:] in prefixes]
        for k in ends:
            while k > 0:
                through[k] = through.get(k, 0) + 1
                k = nodes[k][0]
        k = made[0]  # the chain of the new boundary
        cut = n if not ends else 0
        while ends and k > 0:
            if through.get(k, 0) == len(ends):
                cut = k
                break
            k = nodes[k][0]
        ids, k = [], cut
        while k > 0:
            k, token = made if k == n else nodes[k]
            ids.append(token)
        if ids:
            last, rest = ids[0], data[cut:]
            ids.reverse()
        else:
            rest = data
        if (target := self.states.get((last, rest))) is None:
            kept = {k - cut: (nodes[k][0] - cut, nodes[k][1]) for k in nodes if k > cut and self._reaches(nodes, k, cut)}
            if cut < n:
                kept[n - cut] = (made[0] - cut, made[1])
            target = self.states[last, rest] = _State(last, rest, kept)
        return target, tuple(ids)

    @staticmethod
    def _reaches(nodes: dict[int, tuple[int, int]], k: int, cut: int) -> bool:
        """Whether the segmentation up to boundary ``k`` has a boundary at ``cut``."""
        while k > cut:
            k = nodes[k][0]
        return k == cut

    def _final(self, state: _State) -> tuple[int, ...]:
        ids, k = [], len(state.pending)
        while k > 0:
            k, token = state.nodes[k]
            ids.append(token)
        return tuple(reversed(ids))

    def word(self, data: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        if len(self.states) > _MAX_STATES:
            self._reset()
        state, out = self.start, []
        for byte in data:
            arc = state.arcs.get(byte)
            if arc is None:
                arc = state.arcs[byte] = self._step(state, byte)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        if state.final is None:
            state.final = self._final(state)
        return (*out, *state.final)

    def _remember(self, word: str) -> tuple[int, ...]:
        ids = self.word(word.encode("utf-8", "replace"))
        if len(word) <= _MAX_WORD_CHARS:
            if len(self.memo) > _MAX_WORDS:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode_into(self, text: str, out: array) -> None:
        memo, remember, extend = self.memo, self._remember, out.extend
        for word in self.words.findall(text):
            ids = memo.get(word)
            extend(remember(word) if ids is None else ids)

    def count(self, text: str) -> int:
        """Number of ids of a text."""
        memo, remember = self.memo, self._remember
        return sum(len(remember(word) if (ids := memo.get(word)) is None else ids) for word in self.words.findall(text))

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(stream_decode(self.by_id(), ids))

    def by_id(self) -> dict[int, bytes]:
        return self.tokens


def stream_decode(tokens: dict[int, bytes], ids: Iterable[int]) -> Iterator[str]:
    """Text of a stream of ids, as far as it is complete after each id.

    A token may end inside a character; its bytes wait in an incremental UTF-8 decoder. Bytes that are no UTF-8
    come out as U+FFFD.
    """
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if piece := machine.decode(tokens[i]):
            yield piece
    if piece := machine.decode(b"", final=True):
        yield piece


_ready: dict[int, Transducer] = {}


def _transducer(shared, key: int) -> Transducer:  # noqa: ANN001
    """The worker's transducer for a broadcast vocabulary of checksum ``key``, made once per Python worker."""
    if (made := _ready.get(key)) is None:
        gc.set_threshold(200_000, 50, 50)  # states are many and long-lived; looking through them often costs a lot
        made = _ready[key] = Transducer(read_ranks(shared.value))
    return made


class Tokenizer:
    """Column functions for one vocabulary file.

    The file (under 2 MB, a fixed size) is read by the driver and broadcast, so executors need no copy of it.
    """

    def __init__(self, spark: SparkSession, vocabulary: str = DEFAULT_VOCABULARY):
        ensure_importable(spark)
        with open(vocabulary, "rb") as file:
            data = file.read()
        shared, key = spark.sparkContext.broadcast(data), zlib.crc32(data)

        def encode_batch(texts: pa.Array) -> pa.Array:
            machine, flat, ends = _transducer(shared, key), array("i"), [0]
            for text in texts:
                if (value := text.as_py()) and value:
                    machine.encode_into(value, flat)
                ends.append(len(flat))
            return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))

        def count_batch(texts: pa.Array) -> pa.Array:
            machine = _transducer(shared, key)
            return pa.array([machine.count(value) if (value := text.as_py()) else 0 for text in texts], pa.int32())

        def decode_batch(ids: pa.Array) -> pa.Array:
            tokens = _transducer(shared, key).by_id()
            return pa.array([None if row is None else "".join(stream_decode(tokens, row)) for row in ids.to_pylist()], pa.string())

        self._encode = F.arrow_udf(encode_batch, T.ArrayType(T.IntegerType(), False))
        self._count = F.arrow_udf(count_batch, T.IntegerType())
        self._decode = F.arrow_udf(decode_batch, T.StringType())

    def ids(self, text: Column) -> Column:
        """Ids of a text, without special tokens; an empty array for null."""
        return self._encode(text)

    def count(self, text: Column) -> Column:
        """Number of ids of a text; 0 for null."""
        return self._count(text)

    def text(self, ids: Column) -> Column:
        """Text of an array of ids; null for null."""
        return self._decode(ids)


def encode_corpus(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every row of ``documents``; other columns are ignored."""
    tokenizer = Tokenizer(documents.sparkSession, vocabulary)
    return documents.select("doc_id", tokenizer.ids(F.col("text")).alias("ids"))
