"""Byte-level BPE encoding of a whole corpus.

The distinct words of a batch (pieces of the split pattern) are encoded together: words of similar length form a padded
matrix of token ids, each round finds the leftmost pair of least rank in every row by a hashed pair lookup, merges it,
and closes the gap; rows without a mergeable pair leave the matrix. Words beyond ``LONG_BYTES`` are merged one by one
with a heap, in the same order. There is no exchange: rows stay where they were read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern that splits text into words before merging; ``\s`` is Unicode white space. A fixed value.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Bytes up to which words are encoded in matrices; each longer word is merged by heap.
LONG_BYTES = 256
#: Encoded words kept between batches, to save work only.
CACHE_WORDS = 200_000
#: Characters of text encoded at once.
SLICE_CHARS = 4_000_000
#: Cells of a matrix at most.
MATRIX_CELLS = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a byte-level BPE: a pair of tokens merges if the joined bytes are a token, whose id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pad = max(ranks.values()) + 1
        self.ranks = {w: i for w, i in ranks.items()}
        pairs = {
            (ranks[w[:i]], ranks[w[i:]]): r
            for w, r in ranks.items()
            for i in range(1, len(w))
            if w[:i] in ranks and w[i:] in ranks
        }
        self.pairs = pairs
        keys = np.array([(a << 20) | b for a, b in pairs], dtype=np.int64)
        vals = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        self._build(keys, vals)

    def _build(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Open addressing with linear probing; at most a quarter of the slots are taken."""
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.vals = np.full(1 << bits, _NONE, dtype=np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)  # one key takes a free slot, the others probe on
            won = todo[free][first]
            self.keys[slot[won]], self.vals[slot[won]] = keys[won], vals[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merged token for each pair, ``_NONE`` where a pair does not merge."""
        shape = left.shape
        k = ((left.astype(np.int64) << 20) | right).ravel()
        at = self._slot(k)
        out = np.full(len(k), _NONE, dtype=np.int32)
        todo = np.arange(len(k))
        for _ in range(self.probes + 1):
            found = self.keys[at]
            hit = found == k[todo]
            out[todo[hit]] = self.vals[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], (at[go] + 1) & self.mask
            if not len(todo):
                break
        return out.reshape(shape)

    def _matrix(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of similar length, all rows merged in step."""
        n, width = len(words), max(map(len, words))
        lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        m = np.full((n, width), self.pad, dtype=np.int32)
        m[np.arange(width) < lens[:, None]] = flat
        rows = np.arange(n)
        out: list[list[int]] = [[]] * n
        ranks = self.merged(m[:, :-1], m[:, 1:]) if width > 1 else np.empty((n, 0), dtype=np.int32)
        while True:
            if m.shape[1] > 1:
                best = ranks.argmin(axis=1)  # the first of equals is the leftmost
                low = ranks[np.arange(len(rows)), best]
                over = low == _NONE
            else:
                over = np.ones(len(rows), dtype=bool)
            if over.any():
                for i, ids, size in zip(rows[over].tolist(), m[over].tolist(), lens[over].tolist()):
                    out[i] = ids[:size]
                keep = ~over
                if not keep.any():
                    return out
                m, ranks, rows, lens, best, low = m[keep], ranks[keep], rows[keep], lens[keep], best[keep], low[keep]
            r = np.arange(len(rows))
            m[r, best] = low
            lens = lens - 1
            cols = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, cols + (cols > best[:, None]), axis=1)  # close the gap
            wide = int(lens.max())
            m = m[:, :wide]
            if wide > 1:
                cols = np.arange(wide - 1)
                ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= best[:, None]), ranks.shape[1] - 1), axis=1)
                for shift in (-1, 0):  # only the pairs beside the merged token are new
                    at = best + shift
                    ok = (at >= 0) & (at < wide - 1)
                    ranks[r[ok], at[ok]] = self.merged(m[r[ok], at[ok]], m[r[ok], at[ok] + 1])

    def _heap(self, word: bytes) -> list[int]:
        """Ids of one long word: a heap of pairs by rank and place over a linked list of tokens."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (x := get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (p := prv[i]) >= 0 and (x := get((ids[p], r))) is not None:
                heapq.heappush(heap, (x, p, ids[p], r))
        return [x for x in ids if x != -1]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word, in matrices of words of similar length."""
        out: dict[str, list[int]] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode("utf-8")
            if (whole := self.ranks.get(b)) is not None and len(b) == 1:
                out[w] = [whole]
            elif len(b) > LONG_BYTES:
                out[w] = self._heap(b)
            else:
                # Lengths up to 16 have a bucket each, beyond that one for every eighth of a power of two.
                n = len(b)
                step = 1 if n <= 16 else 1 << (n.bit_length() - 4)
                by_length.setdefault(-(-n // step) * step, []).append((w, b))
        for length, group in by_length.items():
            most = max(1, MATRIX_CELLS // length)
            for i in range(0, len(group), most):
                part = group[i : i + most]
                out.update(zip((w for w, _ in part), self._matrix([b for _, b in part])))
        return out


class Encoder:
    """Texts to ids, with a bounded store of words seen before."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}
        self.assigned: set[str] = set()

    def words(self, text: str) -> list[str]:
        """The words of a text; a code point that the vocabulary's Unicode does not assign is no letter or digit."""
        if text.isascii():
            return self.split.findall(text)
        strange = [c for c in set(text) - self.assigned if unicodedata.category(c) == "Cn"]
        if not strange:
            self.assigned.update(text)
            return self.split.findall(text)
        plain = text.translate({ord(c): "\ue000" for c in strange})
        return [text[m.start() : m.end()] for m in self.split.finditer(plain)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.words(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            self.known |= self.vocabulary.encode_words(list(new))
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, w))) for w in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _task(batches: Iterator[pa.RecordBatch], path: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)

    def out(keys: list, texts: list) -> pa.RecordBatch:
        ids = enc.encode(texts)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(keys, id_type), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["id", "ids"])

    for b in batches:
        keys, texts, size = [], [], 0
        for k, t in zip(b.column(0).to_pylist(), b.column(1)):
            keys.append(k)
            texts.append(t := t.as_py())
            size += len(t or "")
            if size > SLICE_CHARS:
                yield out(keys, texts)
                keys, texts, size = [], [], 0
        if keys:
            yield out(keys, texts)


def encode_corpus(documents: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """``id_col, ids``: the token ids of every text by the byte-level BPE of the rank file ``vocabulary``.

    No special tokens are added, and their spellings in a text are plain text. Null and empty texts give an empty list,
    blank ones the ids of their white space. Repeated rows and null ids are kept as they are, one output row for each
    input row; further columns are ignored.
    """
    kind = documents.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = f"id {kind.simpleString()}, ids array<int>"
    return documents.select(id_col, text_col).mapInArrow(lambda it: _task(it, vocabulary, id_type), schema).withColumnRenamed("id", id_col)
