"""Evaluation texts that leak into a corpus.

One Aho-Corasick automaton over words holds every run of ``run`` words of the held-out items; each document is scanned
once, as the sequence of its normalised words. Hits of successive places join to longer runs, and their offsets are
mapped back to the original text. The items are a stated query set: they are taken in blocks of bounded size, each
with its own automaton, and only that bounded block is sent to the executors.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that a shared run must have.
RUN_WORDS = 13
#: Characters of item text in one automaton; more items make further blocks, each of which scans the corpus.
BLOCK_CHARS = 4_000_000

#: Characters dropped before words are told apart. A fixed value.
DROPPED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the text in NFKC and lower case."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(DROPPED)).lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in the original text for each of ``words(text)``.

    The text is normalised in pieces that do not interact, each a character with what combines with it, and every
    normalised character remembers its piece; a word spans from its first piece to its last.
    """
    if text.isascii():
        return [m.span() for m in _ASCII_WORD.finditer(text.lower())]
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    a, piece = 0, ""

    def emit(b: int) -> None:
        done = nfkc(piece).lower()
        out.append(done)
        start.extend([a] * len(done))
        end.extend([b] * len(done))

    for i, c in enumerate(text):
        if ord(c) in DROPPED:
            continue
        # An ASCII character combines with nothing before it, a mark may; what else may shows when both are normalised.
        if piece and (c < "\x80" or not unicodedata.combining(c) and nfkc(piece + c) == nfkc(piece) + nfkc(c)):
            emit(i)
            a, piece = i, ""
        elif not piece:
            a = i
        piece += c
    emit(len(text))
    return [(start[m.start()], end[m.end() - 1]) for m in _WORD.finditer("".join(out))]


class Automaton:
    """Every run of ``run`` words of a block of items, with the items that have it."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        import ahocorasick

        self.ids: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for i in range(len(w) - run + 1):
                owners.setdefault(tuple(w[i : i + run]), set()).add(item)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, having in owners.items():
            self.auto.add_word(pattern, sorted(having))
        self.empty = not owners
        if owners:
            self.auto.make_automaton()
        self.run = run

    def scan(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (words of its longest run, first word, last word) of the items that share a run with the text."""
        get = self.ids.get
        seq = tuple(get(w, 0) for w in words(text))
        if self.empty or len(seq) < self.run:
            return {}
        open_: dict[int, tuple[int, int]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for last, items in self.auto.iter(seq):
            for item in items:
                first = last - self.run + 1
                if item in open_ and open_[item][1] == last - 1:
                    first = open_[item][0]
                open_[item] = (first, last)
                if last - first + 1 > best.get(item, (0,))[0]:
                    best[item] = (last - first + 1, first, last)
        return best


_automata: dict[int, Automaton] = {}


def _task(batches: Iterator[pa.RecordBatch], block, key: int, run: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(block.value, run)
    auto = _automata[key]
    for b in batches:
        rows: list[tuple] = []
        for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
            if not (text := t.as_py()):
                continue
            if hits := auto.scan(text):
                spans = word_spans(text)
                for item, (n, first, last) in sorted(hits.items()):
                    rows.append((doc, item, n, spans[first][0], spans[last][1]))
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = [id_type, pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types)], names=["doc", "item", "n_words", "start_char", "end_char"]
        )


def _blocks(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.select(item_col, text_col).where(f"{text_col} IS NOT NULL AND {item_col} IS NOT NULL").distinct().toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    doc_text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    run: int = RUN_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Each document and item that share a run of at least ``run`` words, with the longest such run of the document.

    ``doc_col, item_col, n_words, start_char, end_char``; the offsets are those of the run in the document's original
    text (end exclusive). Null and empty texts, and items of fewer words, share nothing; documents with one id and
    several rows give the rows of each; without items the result is empty. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    kind = documents.schema[doc_col].dataType
    id_type = to_arrow_type(kind)
    schema = f"doc {kind.simpleString()}, item bigint, n_words int, start_char int, end_char int"
    d = documents.select(doc_col, doc_text)
    out = None
    for block in _blocks(items, item_col, item_text, block_chars):
        sent = spark.sparkContext.broadcast(block)
        key = uuid.uuid4().int
        found = d.mapInArrow(lambda it, sent=sent, key=key: _task(it, sent, key, run, id_type), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("doc", doc_col).withColumnRenamed("item", item_col)
