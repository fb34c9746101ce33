"""Aligning the tokens of two tokenizers, by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the token of the other side
that overlaps it and reaches farthest right; where both end together the pointer
stays. Doubling all pointers at once (each takes over its successor's) ends, after a
logarithmic number of steps, at the last token of each group, whose end labels the
group: tokens with one label are linked.

Links are counted over the corpus by blocks: a task turns up to BLOCK_BYTES of
text into one row, the distinct id pairs of the block once, and for each document
the numbers of its pairs in that list. Spark counts pairs over the blocks, finds the
highest count of each A id and joins the answer to the blocks' lists; a block then
looks its documents up in its own list. So a pair that every document holds is one
row a block, not one a link.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.storage import write_table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text that is aligned at once, and text whose pairs make up one block.
STEP_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20
#: Groups with more links are counted by distinct ids instead of link by link.
WIDE_GROUP = 1 << 12
#: Between two letters a space starts a new token on both sides (see Aligner), so long
#: texts are cut there.
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(a_json: bytes) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file, without its special tokens. Each
    merge makes a token and their ids ascend, so merging by least id is merging in
    the file's order, and an encoder of ranks, several times faster, gives its ids
    (both split text alike; tests compare them)."""
    spec, char = json.loads(a_json), byte_of_char()
    vocabulary, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"] if t["special"]}
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    ahead = spec["pre_tokenizer"]
    if made != sorted(set(made)) or spec["normalizer"] is not None or ahead["type"] != "ByteLevel" or ahead["add_prefix_space"]:
        raise ValueError("not a byte-level BPE file whose ids follow its merges")
    return {bytes(char[c] for c in token): i for token, i in vocabulary.items() if token not in special}


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of its group for each A token and each B token; both ends ascend
    and reach the same last byte."""
    n = len(end_a)
    ends = np.concatenate([end_a, end_b])
    over = np.concatenate([n + np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)])
    jump = np.where(ends[over] == ends, np.arange(len(ends)), over)
    while True:
        farther = jump[jump]
        if np.array_equal(farther, jump):
            break
        jump = farther
    return ends[jump[:n]], ends[jump[n:]]


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after another."""
    ends = counts.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Aligner:
    """Both tokenizers with their tokens' bytes; one per worker process."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken
        ranks = ranks_of(a_json)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.n_b = len(self.b_bytes)
        # the text of an id with what follows it: nothing, the next id, the B side, the next group
        self.a_text = np.array([f"{i}{after}" for after in ("", ",", "|", ";") for i in range(len(self.a_bytes))], dtype=object)
        self.b_text = np.array([f"{i}{after}" for after in ("", ",", "|", ";") for i in range(self.n_b)], dtype=object)
        #: whether no piece goes on past a space, so that B never merges across one
        self.cuts = not any(" " in token.decode(errors="ignore").lstrip(" ") for token in self.b_bytes)

    def parts(self, text: str) -> list[str]:
        """The text cut before spaces that start a token on both sides, without those
        spaces; each part, a space before it, is tokenised like a text of its own."""
        if len(text) <= STEP_BYTES or not self.cuts:
            return [text]
        found, start = [], 0
        while len(text) - start > STEP_BYTES:
            cut = _CUT.search(text, start + STEP_BYTES // 2)
            if cut is None:
                break
            found.append(text[start:cut.start()])
            start = cut.end()
        return [*found, text[start:]]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where a side's bytes are not the text's."""
        none = np.empty(0, dtype=np.int64)
        if not text:
            return none, none
        all_a, all_b = [], []
        for part in self.parts(text):
            a = self.a.encode_ordinary(" " + part)
            b = self.b.encode(part, num_threads=1)
            whole = b" " + part.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                return none, none
            all_a.append(np.array(a, dtype=np.int64))
            all_b.append(np.array(b, dtype=np.int64))
        return np.concatenate(all_a), np.concatenate(all_b)

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """For each text n_a, n_b, n_groups, n_links, groups_sha256 and its distinct id
        pairs (a * n_b + b, ascending) with the number of links of each."""
        sides = [self.tokens(t) for t in texts]
        n_a, n_b = np.array([len(a) for a, _ in sides], dtype=np.int64), np.array([len(b) for _, b in sides], dtype=np.int64)
        a, b = np.concatenate([x for x, _ in sides]), np.concatenate([x for _, x in sides])
        # both sides have tokens in every group, so the changes of label number the groups
        g_a, g_b = (np.concatenate([of[:1] * 0, of[1:] != of[:-1]]).cumsum()
                    for of in groups(self.a_size[a].cumsum(), self.b_size[b].cumsum()))
        in_a, in_b = np.bincount(g_a), np.bincount(g_b)
        links = in_a * in_b
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        doc_of = doc_a[in_a.cumsum() - 1] if len(a) else np.empty(0, dtype=np.int64)
        n_groups = np.bincount(doc_of, minlength=len(texts))
        before = np.concatenate([[0], links.cumsum()])
        last = n_groups.cumsum()
        pairs, many = self._pairs(a, b, g_a, g_b, in_a, in_b, links, doc_of, len(texts))
        return {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n_groups.tolist(),
                "n_links": (before[last] - before[last - n_groups]).tolist(),
                "groups_sha256": self._digests(a, b, g_a, g_b, in_a, in_b, n_a, n_b), "pairs": pairs, "many": many}

    def _pairs(self, a, b, g_a, g_b, in_a, in_b, links, doc_of, n):
        """Distinct pairs of each document and the number of their links."""
        first_b = in_b.cumsum() - in_b
        narrow = links <= WIDE_GROUP
        some = narrow[g_a]
        reps = in_b[g_a[some]]
        left = np.repeat(a[some], reps)
        right = b[np.repeat(first_b[g_a[some]], reps) + _within(reps)]
        key = np.repeat(doc_of[g_a[some]], reps) << 32 | left * self.n_b + right
        keys, counts = np.unique(key, return_counts=True)
        first_a = in_a.cumsum() - in_a
        extra_keys, extra_counts = [], []
        for g in np.flatnonzero(~narrow).tolist():
            ua, ca = np.unique(a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
            extra_keys.append((doc_of[g] << 32 | ua[:, None] * self.n_b + ub).ravel())
            extra_counts.append((ca[:, None] * cb).ravel())
        if extra_keys:
            both, all_counts = np.concatenate([keys, *extra_keys]), np.concatenate([counts, *extra_counts])
            keys, at = np.unique(both, return_inverse=True)
            counts = np.zeros(len(keys), dtype=np.int64)
            np.add.at(counts, at, all_counts)
        cut = np.searchsorted(keys, np.arange(1, n) << 32)
        return np.split(keys & 0xFFFFFFFF, cut), np.split(counts, cut)

    def _digests(self, a, b, g_a, g_b, in_a, in_b, n_a, n_b) -> list[str]:
        """sha256 of each document's groups as text."""
        last_a = np.concatenate([g_a[1:] != g_a[:-1], [True]]) if len(a) else np.empty(0, dtype=bool)
        last_b = np.concatenate([g_b[1:] != g_b[:-1], [True]]) if len(b) else np.empty(0, dtype=bool)
        after_a, after_b = np.where(last_a, 2, 1), np.where(last_b, 3, 1)
        after_b[n_b.cumsum()[n_b > 0] - 1] = 0          # the end of a document
        # the A tokens of a group come before its B tokens
        words = np.empty(len(a) + len(b), dtype=object)
        at_a = np.arange(len(a)) + (in_b.cumsum() - in_b)[g_a]
        at_b = np.arange(len(b)) + in_a.cumsum()[g_b]
        words[at_a] = self.a_text[after_a * len(self.a_bytes) + a]
        words[at_b] = self.b_text[after_b * self.n_b + b]
        out, start = [], 0
        for n in (n_a + n_b).tolist():
            out.append(hashlib.sha256("".join(words[start:start + n].tolist()).encode()).hexdigest() if n else "")
            start += n
        return out


_WORKERS: dict[tuple[str, str], Aligner] = {}

_DOC = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCK = ("block bigint, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
          "groups_sha256 array<string>, pairs array<bigint>, holders array<int>, sizes binary, places binary, odd binary, many binary")


def _block(number: int, held: dict[str, list]) -> pa.RecordBatch:
    """One row: the documents, the block's distinct pairs with the number of documents
    that hold each, and each document's pairs as places in that list. ``odd`` and
    ``many`` name the pairs linked more than once in a document."""
    flat = np.concatenate([p.astype(np.uint32) for p in held["pairs"]])
    many = np.concatenate(held["many"])
    pairs, places = np.unique(flat, return_inverse=True)
    odd = np.flatnonzero(many > 1)
    row = {"block": (number, pa.int64()), "ids": (held["ids"], pa.list_(pa.int64())),
           **{c: (held[c], pa.list_(pa.int64())) for c in _DOC}, "groups_sha256": (held["groups_sha256"], pa.list_(pa.string())),
           "pairs": (pairs.astype(np.int64), pa.list_(pa.int64())),
           "holders": (np.bincount(places, minlength=len(pairs)).astype(np.int32), pa.list_(pa.int32())),
           "sizes": (np.array([len(p) for p in held["pairs"]], dtype="<u4").tobytes(), pa.binary()),
           "places": (places.astype("<u4").tobytes(), pa.binary()), "odd": (odd.astype("<u4").tobytes(), pa.binary()),
           "many": (many[odd].astype("<u8").tobytes(), pa.binary())}
    return pa.record_batch([pa.array([v], t) for v, t in row.values()], names=list(row))


def _blocks(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """The documents aligned, in blocks. The vocabulary files, of fixed size, are read
    here and sent to every task."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        if (a_path, b_path) not in _WORKERS:
            _WORKERS[a_path, b_path] = Aligner(*files.value)
        aligner, part, count = _WORKERS[a_path, b_path], TaskContext.get().partitionId(), 0
        keys = ["ids", *_DOC, "groups_sha256", "pairs", "many"]
        held, held_bytes = {k: [] for k in keys}, 0
        ids, texts, waiting = [], [], 0

        def step():
            for name, values in {"ids": list(ids), **aligner.align(texts)}.items():
                held[name] += values
            ids.clear(), texts.clear()

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(i), texts.append(text)
                waiting += len(text or "")
                if waiting >= STEP_BYTES or len(texts) >= 10_000:
                    step()
                    held_bytes, waiting = held_bytes + waiting, 0
                    if held_bytes >= BLOCK_BYTES or len(held["ids"]) >= 100_000:
                        yield _block(part << 32 | count, held)
                        held, held_bytes, count = {k: [] for k in keys}, 0, count + 1
        if ids:
            step()
        if held["ids"]:
            yield _block(part << 32 | count, held)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _BLOCK)


def _answer(blocks: pa.Table, answers: pa.Table, id_col: str) -> pa.Table:
    """The documents of one block with their n_best and count_sum."""
    row = blocks.to_pylist()[0]
    packed = np.empty(answers.num_rows, dtype=np.int64)
    packed[answers.column("place").to_numpy()] = answers.column("answer").to_numpy()
    found = packed[np.frombuffer(row["places"], dtype="<u4")]
    many = np.ones(len(found), dtype=np.int64)
    many[np.frombuffer(row["odd"], dtype="<u4")] = np.frombuffer(row["many"], dtype="<u8")
    ends = np.frombuffer(row["sizes"], dtype="<u4").astype(np.int64).cumsum()

    def per_document(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], values.cumsum()])[ends]
        return np.diff(total, prepend=0)
    columns = {id_col: row["ids"], **{c: row[c] for c in _DOC}, "n_best": per_document(many * (found & 1)),
               "count_sum": per_document(many * (found >> 1))}
    table = {name: pa.array(values, pa.int64()) for name, values in columns.items()}
    return pa.table(table | {"groups_sha256": pa.array(row["groups_sha256"], pa.string())})


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
          b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for
    each row of ``docs``. A text that is null or empty, or whose tokens do not give
    back a space and the text (white space that a tokenizer drops), has zeros and an
    empty digest. Repeated rows count as documents of their own; ids may be null;
    an empty table gives an empty result; other columns are ignored."""
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    blocks, _ = write_table(_blocks(docs, id_col, text_col, str(a_path), str(b_path)), "alignment-blocks")
    n_b = _pieces(str(b_path))
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "x"))
    counts, _ = write_table(listed.select(F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders"))
                            .groupBy("pair").agg(F.sum("holders").alias("n")), "alignment-counts")
    left = F.expr(f"pair div {n_b}")
    top = counts.groupBy(left.alias("a")).agg(F.max("n").alias("top"))
    ranked = counts.withColumn("a", left).join(top, "a").select(
        "pair", (F.col("n") * 2 + (F.col("n") == F.col("top")).cast("long")).alias("answer"))
    answers = listed.select("block", "place", F.col("x.pairs").alias("pair")).join(ranked, "pair").select(
        F.col("block").alias("of_block"), "place", "answer")
    held = blocks.select("block", "ids", *_DOC, "groups_sha256", "sizes", "places", "odd", "many")
    schema = f"`{id_col}` bigint, " + ", ".join(f"{c} bigint" for c in [*_DOC, "n_best", "count_sum"]) + ", groups_sha256 string"
    return held.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(
        lambda rows, found: _answer(rows, found, id_col), schema)


def _pieces(path: str) -> int:
    """Number of pieces of a model file."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
