"""Byte-level BPE encoding and decoding by a rank file.

Text is split by the tokenizer's pattern, each match is merged on its own. The
pairs of live neighbours of a match sit in a segment tree over its byte
positions: a leaf holds (rank, position) of the pair that starts there, so the
root is the leftmost pair of least rank. A merge changes three leaves (the merged
pair, the one before, the one that vanished), each in logarithmic time, so a long
match costs n log n and never n squared.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Bytes of matches with their ids that a worker remembers.
REMEMBERED = 160 << 20
#: What an entry costs besides its characters and ids.
ENTRY = 220
#: Rows that leave a task together.
SLICE = 256
#: Characters whose matches wait for each other, to be merged together.
WAITING = 1 << 21
#: Matches up to so many bytes are merged many at a time, so many rows at once.
WIDEST = 64
ROWS = 20_000
#: Texts above so many characters are split match by match, to bound memory.
LONG_TEXT = 1 << 20
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the leftmost neighbours of least rank until none is
    left. A match that is a token itself is that token."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get, shift = ranks.get, n.bit_length()
    leaves = 1 << (n - 1).bit_length()
    low = (1 << shift) - 1
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[leaves + i] = rank << shift | i
    for p in range(leaves - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    after = list(range(1, n + 1)) + [n]     # start of the next live token
    before = list(range(-1, n))             # start of the one before
    while (least := tree[1]) != _NONE:
        i = least & low
        j = after[i]
        end = after[j]
        after[i] = end
        before[end] = i
        changed = [(j, _NONE)]
        rank = get(piece[i:after[end]]) if end < n else None
        changed.append((i, _NONE if rank is None else rank << shift | i))
        if (k := before[i]) >= 0:
            rank = get(piece[k:end])
            changed.append((k, _NONE if rank is None else rank << shift | k))
        for at, key in changed:
            p = leaves + at
            tree[p] = key
            p >>= 1
            while p:
                a, b = tree[2 * p], tree[2 * p + 1]
                key = a if a < b else b
                if tree[p] == key:
                    break
                tree[p] = key
                p >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


@lru_cache(maxsize=8)
def _latin_twin(pattern: str):
    """The pattern for texts of the first 256 characters, with its classes spelt out, so
    that the standard library's faster engine can match it; None if it holds others."""
    def members(name: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)))
    space, classes = members(r"\s"), {r"\p{L}": members(r"\p{L}"), r"\p{N}": members(r"\p{N}")}
    # inside brackets the members alone, elsewhere a class of their own
    parts = regex.split(r"(\[[^\]]*\])", pattern)
    for i, part in enumerate(parts):
        for name, found in {r"\s": space, **classes}.items():
            part = part.replace(name, found if i % 2 else f"[{found}]")
        parts[i] = part if i % 2 else part.replace(r"\S", f"[^{space}]")
    twin = "".join(parts)
    return None if regex.search(r"\\[^x]", twin) else re.compile(twin)


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Memory:
    """Packed ids of texts, in two halves: when the younger is full, the older goes, but
    for texts met again meanwhile."""

    def __init__(self):
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0                           # bytes of the younger half

    def keep(self, texts: list[str], ids: list[bytes]) -> None:
        self.recent.update(zip(texts, ids))
        self.held += ENTRY * len(texts) + sum(map(len, texts)) + sum(map(len, ids))

    def unknown(self, lists: list[list[str]]) -> set[str]:
        """Texts of the lists that are not remembered; the others are in the younger half."""
        if self.held > REMEMBERED // 2:
            self.older, self.recent, self.held = self.recent, {}, 0
        fresh = set().union(*lists)
        fresh.difference_update(self.recent)
        known = [x for x in fresh if x in self.older]
        self.keep(known, [self.older[x] for x in known])
        fresh.difference_update(known)
        return fresh

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        look = self.recent.__getitem__
        return [b"".join(map(look, texts)) for texts in lists]


class Encoder:
    """Encodes matches, the short ones many at a time: their segment trees are the
    rows of one array, and each step merges the least pair of every row."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.matches = Memory()
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.base = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaves (rank, position) of pairs of ids; _NONE where they make no token."""
        key = left * self.base + right
        found = np.searchsorted(self.pair_keys, key)
        found[found == len(self.pair_keys)] = 0
        ok = (self.pair_keys[found] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_ranks[found] * width + at, _NONE)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of matches of 2 to ``width`` bytes; width is a power of two."""
        count, depth = len(pieces), width.bit_length() - 1
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
        inside = np.arange(width) < size[:, None]
        ids = np.full((count, width + 1), -1, dtype=np.int64)       # the id that starts at a byte
        ids[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        live = inside.copy()
        after = np.broadcast_to(np.arange(1, width + 2), (count, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (count, width + 1)).copy()
        tree = np.full((count, 2 * width), _NONE, dtype=np.int64)
        where = np.broadcast_to(np.arange(width), (count, width))
        tree[:, width:] = self._leaf(ids[:, :-1], ids[:, 1:], where, width)
        for level in range(depth - 1, -1, -1):
            lo = 1 << level
            tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            i, rank = root % width, root // width
            j = after[rows, i]
            end = np.minimum(after[rows, j], width)
            ids[rows, i] = rank
            after[rows, i], live[rows, j] = end, False
            before[rows, end] = i
            k = before[rows, i]
            back = np.maximum(k, 0)
            right = np.where(end < size[rows], ids[rows, end], -1)
            leaves = [(j, np.full(len(rows), _NONE)), (i, self._leaf(rank, right, i, width)),
                      (back, np.where(k >= 0, self._leaf(ids[rows, back], rank, back, width), tree[rows, width + back]))]
            for at, leaf in leaves:
                # without a neighbour before, leaf 0 was just written and is kept
                p = width + at
                tree[rows, p] = np.where((at == 0) & (k < 0), tree[rows, p], leaf) if at is back else leaf
            for at, _ in leaves:
                p = (width + at) >> 1
                for _ in range(depth):
                    tree[rows, p] = np.minimum(tree[rows, 2 * p], tree[rows, 2 * p + 1])
                    p >>= 1
            rows = rows[tree[rows, 1] != _NONE]
        packed = ids[:, :width][live].astype("<u4").tobytes()
        ends = (4 * live.sum(1).cumsum()).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, matches: set[str]) -> None:
        """Add the ids of matches to the memory."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        done, ids = [], []
        for match in matches:
            piece = match.encode("utf-8")
            if (rank := self.ranks.get(piece)) is not None:
                done.append(match)
                ids.append(rank.to_bytes(4, "little"))
            elif len(piece) > WIDEST:
                done.append(match)
                ids.append(b"".join(x.to_bytes(4, "little") for x in merge(piece, self.ranks)))
            else:
                by_width.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append((match, piece))
        self.matches.keep(done, ids)
        for width, group in by_width.items():
            for at in range(0, len(group), ROWS):
                part = group[at:at + ROWS]
                self.matches.keep([m for m, _ in part], self._merge_rows([p for _, p in part], width))

    def encode(self, texts: Iterable[str | None], pattern) -> Iterator[bytes]:
        """Packed ids of each text, in order."""
        twin = _latin_twin(pattern.pattern)
        waiting: list[list[str]] = []
        held = 0
        for text in texts:
            text = text or ""
            if len(text) > LONG_TEXT:
                yield from self._match_ids(waiting)
                found = pattern.finditer(text)
                blocks = iter(lambda: [m.group() for m in islice(found, 200_000)], [])
                yield b"".join(x for block in blocks for x in self._match_ids([block]))
                waiting, held = [], 0
                continue
            waiting.append((twin if twin is not None and _is_latin(text) else pattern).findall(text))
            held += len(text)
            if held > WAITING:
                yield from self._match_ids(waiting)
                waiting, held = [], 0
        yield from self._match_ids(waiting)

    def _match_ids(self, lists: list[list[str]]) -> list[bytes]:
        self.learn(self.matches.unknown(lists))
        return self.matches.joined(lists)


_WORKERS: dict[str, Encoder] = {}
_TOKENS: dict[str, dict[int, bytes]] = {}


def _encoder(ranks, name: str) -> Encoder:
    """One encoder per worker process, kept from task to task."""
    if name not in _WORKERS:
        _WORKERS[name] = Encoder(ranks.value)
    return _WORKERS[name]


def _ranks(spark: SparkSession, path: str | None):
    """The rank file as a broadcast variable: a fixed vocabulary, under 1 MB."""
    path = path or public_tokenizers.path(RANK_FILE)
    return spark.sparkContext.broadcast(read_ranks(path)), path


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None,
           split: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids), a row for each row of ``docs``; ``ids`` is binary, each id a
    little-endian unsigned 32-bit integer. Null and empty texts have no ids; there
    are no special tokens; other columns are ignored."""
    return _encoded(docs, id_col, text_col, rank_path, split, False)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None,
               split: str = public_tokenizers.PATTERN) -> DataFrame:
    """:func:`encode`, then :func:`decode`, in one pass: (id, ids, decoded)."""
    return _encoded(docs, id_col, text_col, rank_path, split, True)


def _encoded(docs: DataFrame, id_col: str, text_col: str, rank_path: str | None, split: str, decoded: bool) -> DataFrame:
    ranks, path = _ranks(docs.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pattern = _encoder(ranks, path), regex.compile(split)
        for batch in batches:
            # texts merged together, many rows at a time; they leave in small slices
            for at in range(0, batch.num_rows, 4 * SLICE):
                part = batch.slice(at, 4 * SLICE)
                done = encoder.encode(part.column(1).to_pylist(), pattern)
                for low in range(0, part.num_rows, SLICE):
                    some = part.slice(low, SLICE)
                    packed = list(islice(done, some.num_rows))
                    columns = [some.column(0), pa.array(packed, pa.binary())]
                    if decoded:
                        columns.append(pa.array(_decoded(packed, ranks, path), pa.binary()))
                    yield pa.record_batch(columns, names=[id_col, "ids", "decoded"][:len(columns)])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, ids binary" + (", decoded binary" if decoded else ""))


def _decoded(packed: list[bytes | None], ranks, path: str) -> list[bytes | None]:
    # ranks need not be dense, so the table is keyed by id
    if path not in _TOKENS:
        _TOKENS[path] = {rank: token for token, rank in ranks.value.items()}
    look = _TOKENS[path].__getitem__
    return [None if p is None else b"".join(map(look, memoryview(p).cast("I"))) for p in packed]


def decode(encoded: DataFrame, ids_col: str = "ids", rank_path: str | None = None) -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary): the bytes of its ids. Null
    ids stay null."""
    ranks, path = _ranks(encoded.sparkSession, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield part.append_column("decoded", pa.array(_decoded(part.column(ids_col).to_pylist(), ranks, path), pa.binary()))
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))
