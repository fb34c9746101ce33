"""Benchmark passages in documents: CGK walks, bit sampling, exact edit distance.

A CGK walk reads a sequence of words: at every step it shows the word it stands on and
then, by a random bit of the step and that word, stays or goes on. Two walks that meet
an edit get out of step and fall back into step by chance, so sequences a few edits
apart show the same word at most steps: edit distance has become Hamming distance.
Bit sampling looks at a few steps of the walk; windows of a document and of an item
whose walks show the same words there are candidates.

Windows of the item start at each of its words, as far as the sampled steps stay inside
it, and windows of a document at each of its words. Agreement falls with the edits that a
walk has met, so steps are sampled from the first STEPS, about twice the words between
two edits at the accepted rate. Walks are repeated, each with bits and samples of
its own, until sequences edited at that very rate are found with the target recall:
the number comes from a simulation for the lengths of the items at hand
(:func:`repetitions`). A candidate goes on if the words around it hold as many of the
item's words as the edits leave, and is verified by the exact edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits (words inserted, left out or replaced) per word of an item that still match.
EDIT_RATE = 0.2
#: Items of fewer words match without any edit only: less than that with a word changed
#: is a common phrase.
MIN_WORDS = 8
#: Share of the places at EDIT_RATE edits, of whatever kind, that the search must reach.
RECALL = 0.99
#: Steps sampled of a walk, and most walks.
SAMPLES, MOST_WALKS = 4, 32
#: Items of fewer words are also found by walks of which some samples lie beyond them.
SHORT = 14
#: Bytes of item text that one pass over the documents looks for.
BLOCK_BYTES = 8 << 20
#: Words of documents that are searched at once, bytes that are split into words at once.
CHUNK = 1 << 18
_SPLIT = 4 << 20
#: Words around candidates that are looked at together.
_CELLS = 1 << 18

_PLAIN = bytearray(b" " * 128) + bytes(range(128, 256))
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _PLAIN[_c] = _c
_PLAIN = bytes(_PLAIN)


#: Scripts without spaces between words (Thai to Khmer, kana, Han), and their punctuation.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3040-\u312f\u31a0-\u31ff"
                       "\u3400-\u9fff\ua000-\ua4cf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def _plain(text: str | None) -> bytes:
    """Lower case, ASCII characters but letters and digits as spaces; characters of
    scripts without spaces apart from each other."""
    text = (text or "").lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN)


def words_of(text: str | None) -> list[bytes]:
    return _plain(text).split()


def edit_distance_inside(item: list[int], region: list[int], most: int) -> tuple[int, int]:
    """(distance, end): the least edit distance of the item to any stretch of the
    region and where that stretch ends; bit-parallel (Myers). ``most`` + 1 at least
    if none is within ``most``."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score, best, at = full, 0, n, min(n, most + 1), 0
    for j, w in enumerate(region):
        eq = masks.get(w, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp) & full, d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | ~(d0 | hp) & full, hp & d0
        if score < best:
            best, at = score, j + 1
    return best, at


def _mix(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ key >> np.uint64(29)


def steps_of(rate: float) -> int:
    """Steps that are sampled from: a walk goes a word in two steps, and at ``rate`` a run
    of (1 - rate) / rate words holds no edit."""
    return max(SAMPLES + 1, min(24, 2 * round((1 - rate) / max(rate, 0.01)) + 2))


def edits_of(n: int, rate: float) -> int:
    """Edits that an item of n words bears."""
    return int(rate * n) if n >= MIN_WORDS else 0


class Walk:
    """One CGK walk: the bits of its steps and the steps that are sampled, 0 among them."""

    def __init__(self, number: int, steps: int, words: int):
        rng = np.random.default_rng([number, steps])
        self.samples = np.sort(np.append(rng.choice(np.arange(1, steps), SAMPLES - 1, replace=False), 0)).tolist()
        self.bits = np.stack([np.random.default_rng([number, s]).integers(0, 2, words, dtype=np.uint8) for s in range(self.samples[-1] + 1)])

    def read(self, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Positions at each sampled step of the walks from ``starts``; the caller may
        send back which of them go on. ``words`` must be long enough behind them."""
        at = starts
        for step in range(self.samples[-1] + 1):
            if step in self.samples:
                go = yield at
                if go is not None:
                    at = at[go]
            at = at + self.bits[step][words[at]]


class Items:
    """The sampled walks of a block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, list[bytes]]], rate: float = EDIT_RATE, walks: int | None = None,
                 recall: float = RECALL):
        names: dict[tuple[bytes, ...], list[int]] = {}
        for item_id, words in items:
            if words:
                names.setdefault(tuple(words), []).append(item_id)
        self.ids = list(names.values())
        vocabulary = sorted({w for words in names for w in words})
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}      # 0: in no item
        self.items = [[self.vocabulary[w] for w in words] for words in names]
        self.most = [edits_of(len(item), rate) for item in self.items]
        self.longest = max(map(len, self.items), default=0)
        steps = steps_of(rate)
        if walks is None:
            walks = repetitions(rate, sorted({len(x) for x in self.items}), recall) if self.items else 0
        self.tape = np.array([w for item in self.items for w in [*item, *[0] * (steps + 1)]], dtype=np.int64)
        sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        begins = (sizes + steps + 1).cumsum() - sizes - steps - 1
        item = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(item)) - np.repeat(sizes.cumsum() - sizes, sizes)
        self.plans = [self._plan(Walk(r, steps, len(vocabulary) + 1), item, offset, begins, sizes) for r in range(walks)]

    def _plan(self, walk: Walk, item, offset, begins, sizes) -> dict:
        """The keys of the items' windows by number of samples inside the item: all, or,
        for short items, fewer; and which words and pairs of words samples show."""
        start = begins[item] + offset
        end = (begins + sizes)[item]
        keys, tables = np.zeros(len(start), dtype=np.uint64), []
        shown = np.zeros((SAMPLES, len(self.vocabulary) + 1), dtype=bool)
        pairs = np.zeros(1 << 20, dtype=bool)
        places = list(walk.read(self.tape, start))
        inside = np.array([at < end for at in places])
        used = (inside.all(axis=0)) | (sizes[item] < SHORT)
        for c, at in enumerate(places):
            ok = inside[c] & used
            shown[c, self.tape[at[ok]]] = True
            keys = np.where(inside[c], _mix(keys, self.tape[at]), keys)
            if c == 1:
                pairs[keys[ok] >> np.uint64(44)] = True
            last = ok & ~inside[c + 1] if c + 1 < SAMPLES else ok
            order = np.argsort(keys[last], kind="stable")
            tables.append((keys[last][order], item[last][order], offset[last][order]))
        return {"walk": walk, "shown": shown, "pairs": pairs, "tables": tables}

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, position where its first word would be, position of the window) of all
        windows that share the sampled steps of a walk with a window of an item."""
        reach = max((p["walk"].samples[-1] for p in self.plans), default=0) + 1
        padded = np.concatenate([words, np.zeros(reach, dtype=words.dtype)])
        found = [self._places(plan, padded, len(words)) for plan in self.plans]
        item, first, at = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 3
        order = np.lexsort((at, first, item))
        item, first, at = item[order], first[order], at[order]
        fresh = np.ones(len(item), dtype=bool)
        fresh[1:] = (np.diff(item) != 0) | (np.diff(first) != 0) | (np.diff(at) != 0)
        return item[fresh], first[fresh], at[fresh]

    @staticmethod
    def _places(plan: dict, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.flatnonzero(plan["shown"][0][words[:n]])
        key, out, go = np.zeros(len(start), dtype=np.uint64), [], None
        reading = plan["walk"].read(words, start)
        for c in range(SAMPLES):
            at = next(reading) if c == 0 else reading.send(go)
            if c:
                go = plan["shown"][c][words[at]]
                start, key, at = start[go], key[go], at[go]
            key = _mix(key, words[at])
            if c == 1:
                pair = plan["pairs"][key >> np.uint64(44)]
                start, key = start[pair], key[pair]
                go = np.flatnonzero(go)[pair]
            elif c == 0:
                go = None
            keys, item, offset = plan["tables"][c]
            if len(keys) and len(key):
                left = np.searchsorted(keys, key, "left")
                often = np.searchsorted(keys, key, "right") - left
                at_found = np.repeat(start, often)
                entry = np.repeat(left - np.cumsum(often) + often, often) + np.arange(len(at_found))
                out.append((item[entry], at_found - offset[entry], at_found))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, dtype=np.int64),) * 3

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, position where its first word would be, position of the window) of
        places that may hold the item, by item and position."""
        item, first, at = self.places(words)
        cuts = np.flatnonzero(np.diff(item, prepend=-1, append=-1)).tolist()
        mine = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        for low, high in zip(cuts, cuts[1:]):
            k = int(item[low])
            n, most = len(self.items[k]), self.most[k]
            mine[self.items[k]] = True
            rows = max(1, _CELLS // (n + 2 * most))
            for a in range(low, high, rows):
                start = first[a:min(high, a + rows)]
                # all words of the item but ``most`` are around the place
                around = start[:, None] + np.arange(-most, n + most)
                held = mine[words[np.clip(around, 0, len(words) - 1)]].sum(axis=1)
                for i in np.flatnonzero(held >= n - most).tolist():
                    yield k, int(start[i]), int(at[a + i])
            mine[self.items[k]] = False


def edited(words: np.ndarray, edits: int, kind: str, rng: np.random.Generator, fresh: int) -> np.ndarray:
    """``words`` with ``edits`` random edits of a kind (replace, insert, delete, mixed);
    new words are numbered from ``fresh`` on."""
    out = words.tolist()
    for i in range(edits):
        what = rng.choice(["replace", "insert", "delete"]) if kind == "mixed" else kind
        at = int(rng.integers(len(out))) if out else 0
        if what == "insert" or not out:
            out.insert(at, fresh + i)
        elif what == "delete":
            del out[at]
        else:
            out[at] = fresh + i
    return np.array(out, dtype=np.int64)


def _lost(rate: float, n: int, trials: int) -> np.ndarray:
    """For each number of walks up to MOST_WALKS the share of edited sequences of n words
    that no walk finds, the worst of all kinds of edits."""
    steps, most, worst = steps_of(rate), edits_of(n, rate), None
    words = [b"%d" % i for i in range(n)]
    ready = Items([(0, words)], rate, walks=MOST_WALKS)
    base = np.array(ready.items[0], dtype=np.int64)
    for kind in ("replace", "insert", "delete", "mixed"):
        rng = np.random.default_rng([n, steps, len(kind)])
        found = np.zeros((trials, MOST_WALKS), dtype=bool)
        for t in range(trials):
            seen = edited(base, most, kind, rng, 1 << 40)
            seen = np.where(seen >= 1 << 40, 0, seen)
            padded = np.concatenate([seen, np.zeros(steps + 1, dtype=np.int64)])
            for r, plan in enumerate(ready.plans):
                item, first, _ = Items._places(plan, padded, len(seen))
                if len(item):
                    found[t, r:] = True
                    break
        lost = 1 - found.mean(axis=0)
        worst = lost if worst is None else np.maximum(worst, lost)
    return worst


@lru_cache(maxsize=64)
def _walks_for(rate: float, n: int, recall: float) -> int:
    enough = np.flatnonzero(_lost(rate, n, 300) <= (1 - recall) / 2)
    return int(enough[0]) + 1 if len(enough) else MOST_WALKS


def repetitions(rate: float, lengths: list[int], recall: float) -> int:
    """Walks that reach ``recall`` for sequences edited at ``rate``, twice as sure in
    the simulation; the lengths are the shortest, the middle and the longest that
    bear an edit."""
    bearing = [n for n in lengths if edits_of(n, rate)]
    if not bearing:
        return 2
    return max(_walks_for(rate, n, recall) for n in {bearing[0], bearing[len(bearing) // 2], bearing[-1]})


def _pieces(text: str | None, reach: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words before, words) of a whole text, in pieces that overlap by
    ``reach`` words, so that a very long text needs bounded memory."""
    data = _plain(text)
    if len(data) <= _SPLIT:
        yield 0, data.split()
        return
    before, kept, at = 0, [], 0
    while at < len(data):
        stop = data.find(b" ", at + _SPLIT)
        stop = len(data) if stop < 0 else stop
        words = kept + data[at:stop].split()
        yield before, words
        kept = words[-reach:] if reach else []
        before, at = before + len(words) - len(kept), stop


def _search(items: Items, rate: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    get, reach = items.vocabulary.get, int(items.longest * (1 + 3 * rate)) + 2
    for batch in batches:
        found: dict[tuple[int, int], tuple[int, int, int]] = {}     # (row, item) -> distance, start, end
        held: list[tuple[int, int, int]] = []                       # row, words before, length
        words: list[np.ndarray] = []
        size = 0

        def look() -> None:
            tape = np.concatenate(words)
            ends = np.cumsum([n for _, _, n in held])
            last = None
            for item, start, at in items.candidates(tape):
                piece = int(np.searchsorted(ends, at, "right"))
                # other pieces of the same place are left out
                if (item, start, piece) == last:
                    continue
                last = item, start, piece
                n, most = len(items.items[item]), items.most[item]
                row, before, length = held[piece]
                low = int(ends[piece]) - length
                a, b = max(low, start - 2 * most - 1), min(int(ends[piece]), start + n + 2 * most + 1)
                if found.get((row, item), (most + 1,))[0] == 0 or b - a < n - most:
                    continue
                distance, end = edit_distance_inside(items.items[item], tape[a:b].tolist(), most)
                if distance <= most and distance < found.get((row, item), (most + 1,))[0]:
                    stop = before + a + end - low
                    found[row, item] = distance, max(before, stop - n), stop
            words.clear()
            held.clear()

        for row, text in enumerate(batch["text"]):
            for before, piece in _pieces(text, reach):
                if not piece:
                    continue
                words.append(np.fromiter(map(get, piece, repeat(0)), dtype=np.int32, count=len(piece)))
                held.append((row, before, len(piece)))
                size += len(piece)
                if size >= CHUNK:
                    look()
                    size = 0
        if words:
            look()
        out = [(batch["key"].iloc[row], item_id, start, end, distance, len(items.items[item]))
               for (row, item), (distance, start, end) in found.items() for item_id in items.ids[item]]
        yield pd.DataFrame(out, columns=["key", "item_id", "start", "end", "distance", "n_words"])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE,
               block_bytes: int = BLOCK_BYTES, recall: float = RECALL) -> DataFrame:
    """(id, item_id, start, end, distance, n_words): a row for each document and item
    of which a stretch of the document is at most ``rate`` * n_words word edits away,
    with the closest stretch (word positions; ``start`` counts n_words back from
    ``end``).

    Words are compared in lower case without punctuation; in scripts without spaces
    each character is a word. Items of fewer than MIN_WORDS words match unedited only;
    null and empty texts match nothing; items with the same text are
    all reported, and so is every repeated document. Of places at the full rate a share
    of ``recall`` at least is found, of less edited ones more. Items are looked for in blocks of
    about ``block_bytes``, each one pass over the documents.
    """
    if not 0 <= rate < 1:
        raise ValueError("rate must be at least 0 and below 1")
    spark = docs.sparkSession
    known = items.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("t")).distinct()
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, ceil(total / block_bytes))
    keyed = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    schema = f"key {kind}, item_id long, start long, end long, distance int, n_words int"
    found = None
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == block).collect()
        ready = Items([(r["item"], words_of(r["t"])) for r in sorted(rows)], rate, recall=recall)
        if not ready.items:
            continue
        shared = spark.sparkContext.broadcast(ready)        # made of block_bytes of item text
        one = keyed.mapInPandas(lambda batches, shared=shared: _search(shared.value, rate, batches), schema)
        found = one if found is None else found.unionByName(one)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.withColumnRenamed("key", id_col)


def drop_leaking(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without a leak, all columns as they are; rows without an id stay."""
    return docs.join(leaks.select(id_col).distinct(), id_col, "left_anti").select(docs.columns)
