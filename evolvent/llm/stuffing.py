"""Keyword-stuffed pages, link lists and tag lists.

A text is cut into segments of up to ``SEGMENT_WORDS`` words. Sentences are made of words that belong together across
the corpus, so the mean pointwise mutual information (PMI) of a segment's neighbouring words is high and few word pairs
repeat within it. Word salad has a low mean PMI, or, if its words are rare, one that rests on pairs seen nowhere else,
which a mean discounted by few counts shows; keyword lists repeat the same collocations over and over; link and tag
lists show in their markup. A logistic model over these measures, fitted to labelled documents, gives the probability
that a segment is stuffed; a document is stuffed if more than half of its characters are.

Corpus counts cover all documents, all words and all word pairs, each known by a 64-bit hash. Word pairs of a relative
frequency of at least ``1 / HOT_PAIRS`` are sent to the executors (no more than ``HOT_PAIRS``); all other pairs are
looked up by a join, in which by the same bound no key is frequent. So are the counts of the words of the pairs, those
of a relative frequency of at least ``1 / VOCABULARY`` being sent. Words below that frequency are called rare.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolvent.session import Stages

SEGMENT_WORDS = 60
#: Most words sent to the executors; 1 / VOCABULARY is the least relative frequency. All others are rare words.
VOCABULARY = 20_000
#: Most word pairs sent to the executors; 1 / HOT_PAIRS is the least relative frequency.
HOT_PAIRS = 200_000
#: Words whose hashes a task keeps between batches, to save work only.
KNOWN_WORDS = 500_000
#: Labelled documents that the model is fitted on, at most: those of the least hash of the id.
TRAIN_DOCUMENTS = 4_000
#: Segments of a labelled document that are used in fitting, at most.
TRAIN_SEGMENTS = 60

FEATURES = ("pmi", "firm", "loose", "rare", "repeat", "distinct", "brief", "link", "digits", "marks", "ends", "capital", "blob")

#: Weights before any label is seen, from what the measures mean; the fit is drawn towards them.
PRIOR = {
    "pmi": -0.5, "firm": -0.5, "loose": 3.0, "rare": 0.0, "repeat": 3.0, "distinct": -1.0, "brief": 1.0, "link": 3.0, "digits": 1.0, "marks": 1.0,
    "ends": -1.0, "capital": 0.0, "blob": -3.0, "bias": -0.5,
}

#: A word; scripts written without spaces count by the character.
_CJK = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)*")
_WORD = regex.compile(rf"[{_CJK}]|[\w--[_{_CJK}]]+(?:['’][\w--[_{_CJK}]]+)*", regex.V1)
_LINK = re.compile(r"https?://[^\s)\"'<>]+|<a\s[^>]*>|</?li>|</a>|\]\(", re.I)
_BLOCK = re.compile(r"\n\s*\n")
_CUT = re.compile(r"(?<=[.!?。！？])\s+|\n|(?<=[。！？])")
_ENDS = re.compile(r"[.!?。！？](?=\s|$|[^\W_a-z])")
_MARKS = ",|·•#/;()[]<>_*"
_PHRASE = re.compile(r"[.!?;,|·•()\n#/。！？、]+|\s[-*]\s")
#: Characters dropped before anything else. A fixed value.
_DROPPED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
_DROPPED_CHARS = [chr(c) for c in _DROPPED]
_BLOB = re.compile(r"[^\s<>\"'()]{60,}")
#: Digits written for letters within a word. Fixed values.
_LEET = str.maketrans("013457", "oieast")
_NUMBER = xxhash.xxh64_intdigest("0") - 2**63


def _norm(w: str) -> str:
    """A word in lower case; numbers are all one word, digits within a word are read as the letters they stand for."""
    if w.isdigit():
        return "0"
    low = w.lower()
    return low.translate(_LEET) if low.isascii() and not low.isalpha() and not low[0].isdigit() else low


#: In the flags of a word: it is a number; its capitals are odd.
_IS_NUMBER, _IS_ODD = 1, 1 << 16


class _Words(dict):
    """Word as written -> (hash of its normal form, flags), worked out when first asked for."""

    def __missing__(self, w: str) -> tuple[int, int]:
        flags = _IS_NUMBER if w.isdigit() else _IS_ODD if w.isascii() and w.isalpha() and not (w.islower() or w.istitle()) else 0
        x = self[w] = (xxhash.xxh64_intdigest(_norm(w)) - 2**63, flags)
        return x


def segments(text: str) -> Iterator[tuple[str, list[str]]]:
    """(text, words as written) of pieces of whole lines and sentences of about ``SEGMENT_WORDS`` words.

    A piece never crosses a blank line; a sentence with more words than that is cut.
    """
    ascii_ = text.isascii()
    word = _ASCII_WORD if ascii_ else _WORD
    if not ascii_ and any(c in text for c in _DROPPED_CHARS):
        text = text.translate(_DROPPED)
    for block in _BLOCK.split(text):
        held: list[str] = []
        have: list[str] = []
        for piece in _CUT.split(block):
            if not piece or piece.isspace():
                continue
            w = word.findall(piece)
            if have and len(have) + len(w) > SEGMENT_WORDS:
                yield "\n".join(held), have
                held, have = [], []
            if len(w) > SEGMENT_WORDS:
                ends, start = [m.end() for m in word.finditer(piece)], 0
                while len(w) > SEGMENT_WORDS:
                    cut = ends[SEGMENT_WORDS - 1]
                    yield piece[start:cut], w[:SEGMENT_WORDS]
                    start, w, ends = cut, w[SEGMENT_WORDS:], ends[SEGMENT_WORDS:]
                piece = piece[start:]
            held.append(piece)
            have += w
        if held:
            yield "\n".join(held), have


def measures(segment: str, ids: list[int], flags: int) -> tuple[float, ...]:
    """repeat, distinct, brief, link, digits, marks, ends, capital, blob of a segment.

    ``ids`` are the hashes of its words, ``flags`` the sum of their flags.
    """
    n, size = max(1, len(ids)), max(1, len(segment))
    pairs = list(zip(ids, ids[1:]))
    repeat = 0.0
    if len(set(pairs)) < len(pairs):
        counts = Counter(pairs)
        counts.pop((_NUMBER, _NUMBER), None)
        repeat = sum(c for c in counts.values() if c > 1) / len(pairs)
    brief = min(1.0, sum(k for p in _PHRASE.split(segment) if (k := len(p.split())) < 6) / n)
    link = 0.0
    if "://" in segment or "<" in segment or "](" in segment:
        link = min(1.0, sum(len(m) for m in _LINK.findall(segment)) / size * 1.5)
    marks = min(1.0, sum(map(segment.count, _MARKS)) / n)
    ends = min(1.0, 10 * len(_ENDS.findall(segment)) / n)
    blob = 0.0
    if size > 60 and max(map(len, segment.split()), default=0) >= 60:
        blob = sum(len(m) for m in _BLOB.findall(segment) if "://" not in m) / size
    return repeat, len(set(ids)) / n, brief, link, (flags & 0xFFFF) / n, marks, ends, (flags >> 16) / n, blob


def fit(x: np.ndarray, size: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 600, sharp: float = 10.0) -> np.ndarray:
    """Weights (bias last) by which the share of stuffed characters of a document tells its label.

    ``x`` are measures and ``size`` characters of segments, ``doc`` the index of each segment's document in ``label``.
    Labels are smoothed, since raters err; the weights are drawn towards ``PRIOR``, so few labels move them little.
    """
    prior = np.array([PRIOR[f] for f in FEATURES] + [PRIOR["bias"]])
    w = prior.copy()
    if len(label) == 0:
        return w
    x = np.hstack([x, np.ones((len(x), 1))])
    share = size / np.maximum(1, np.bincount(doc, size, len(label)))[doc]
    y = 0.03 + 0.94 * label
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        p = 1 / (1 + np.exp(-sharp * (np.bincount(doc, share * s, len(label)) - 0.5)))
        slope = ((p - y) * sharp)[doc] * share * s * (1 - s)
        g = (x * slope[:, None]).sum(axis=0) / len(label) + 0.5 / (len(label) + 50) * (w - prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


LOOSE_PMI = 1.0
_BASE = ("repeat", "distinct", "brief", "link", "digits", "marks", "ends", "capital", "blob")


def _segment_rows(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The one pass over the texts: each segment with the measures of its own and the hashes of its words."""
    words, first, second = _Words(), itemgetter(0), itemgetter(1)
    names = ["doc", "seg", "size", *_BASE, "words"]
    docs: list = []
    numbers: list[tuple[int, int]] = []
    told: list[tuple[float, ...]] = []
    flat, lengths = array("q"), array("i")

    def flush() -> pa.RecordBatch:
        at, base = np.array(numbers, dtype=np.int64), np.array(told, dtype=np.float32)
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, dtype=np.int32))]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, dtype=np.int64).copy() if flat else np.empty(0, dtype=np.int64)))
        cols = [pa.array(docs, id_type), pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1]), *(pa.array(base[:, i]) for i in range(len(_BASE))), ids]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for b in batches:
        if len(words) > KNOWN_WORDS:
            words.clear()
        for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
            for no, (s, w) in enumerate(segments(t.as_py() or "")):
                known = list(map(words.__getitem__, w))
                ids = list(map(first, known))
                docs.append(doc)
                numbers.append((no, len(s)))
                told.append(measures(s, ids, sum(map(second, known))))
                flat.extend(ids)
                lengths.append(len(ids))
                if len(docs) >= 20_000:
                    yield flush()
                    docs, numbers, told, flat, lengths = [], [], [], array("q"), array("i")
    if docs:
        yield flush()


def _lookup(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each x among the keys, whether it is one of them)."""
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return at, sorted_keys[at] == x


#: Multiplier of the first word's hash in the key of a pair. An odd fixed value.
_FIRST = np.int64(0x1E3779B97F4A7C15)


def _pairs(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, segment) of every word, (place of the first word, key) of every pair of neighbouring words."""
    values = words.flatten().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    seg = np.repeat(np.arange(len(size)), size)
    first = np.flatnonzero(seg[:-1] == seg[1:])
    return values, seg, first, values[first] * _FIRST + values[first + 1]


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values, _, first, p = _pairs(b.column(0))
        k, at, n = np.unique(p, return_index=True, return_counts=True)
        a = first[at]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(values[a]), pa.array(values[a + 1]), pa.array(n.astype(np.int64))], names=["p", "a", "b", "n"])


def _pmi_rows(batches: Iterator[pa.RecordBatch], vocabulary, hot) -> Iterator[pa.RecordBatch]:
    """Each segment's sums over its hot pairs, and the keys of all its other pairs."""
    keys, pmis, firms = hot.value
    for b in batches:
        n = b.num_rows
        values, wseg, first, p = _pairs(b.column(b.num_columns - 1))
        seg, rare = wseg[first], ~_lookup(vocabulary.value, values)[1]
        at, hit = _lookup(keys, p)
        v = pmis[at[hit]] if len(keys) else np.empty(0)
        total = np.bincount(seg[hit], v, n).astype(np.float64)
        firm = np.bincount(seg[hit], firms[at[hit]] if len(keys) else v, n).astype(np.float64)
        loose = np.bincount(seg[hit], v < LOOSE_PMI, n).astype(np.int64)
        share = np.bincount(wseg, rare, n).astype(np.float64) / np.maximum(1, np.bincount(wseg, minlength=n))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(seg[~hit], minlength=n))]).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(p[~hit]))
        own = [pa.array(np.bincount(seg, minlength=n).astype(np.int64)), pa.array(total), pa.array(firm), pa.array(loose), pa.array(share), others]
        yield pa.RecordBatch.from_arrays(
            [b.column(i) for i in range(b.num_columns - 1)] + own, names=[*b.schema.names[:-1], "pairs", "pmi_sum", "firm_sum", "loose_n", "rare", "others"]
        )


def _with_count(pairs: DataFrame, counts: DataFrame, word: str, n: str, total: int) -> DataFrame:
    """``pairs`` with column ``n`` of ``counts``, which has a row for each ``word``: frequent words are sent, others joined."""
    often = F.col(n) * VOCABULARY >= total
    sent = pairs.join(F.broadcast(counts.where(often)), word, "left")  # at most VOCABULARY rows
    # By the same bound no key of this join is frequent.
    return sent.where(f"{n} IS NOT NULL").unionByName(sent.where(f"{n} IS NULL").drop(n).join(counts.where(~often), word))


def pair_pmi(stages: Stages, segs: DataFrame):
    """(broadcast sorted hashes of words not rare, table ``p, n, pmi, firm`` of every pair of neighbouring words of the corpus, its total).

    ``firm`` is the PMI discounted where counts are few: a pair that occurs once has none.
    """
    sc = segs.sparkSession.sparkContext
    uni = stages.put(segs.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    total = uni.agg(F.sum("n")).first()[0] or 0
    often = uni.where(F.col("n") * VOCABULARY >= total).select("w").toArrow()["w"].to_numpy()  # at most VOCABULARY
    vocabulary = sc.broadcast(np.sort(often))
    pairs = segs.select("words").mapInArrow(_bigrams, "p bigint, a bigint, b bigint, n bigint")
    pairs = stages.put(pairs.groupBy("p").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")), "pairs")
    n = pairs.agg(F.sum("n")).first()[0] or 0
    left = stages.put(pairs.groupBy("a").agg(F.sum("n").alias("na")), "left")
    right = stages.put(pairs.groupBy("b").agg(F.sum("n").alias("nb")), "right")
    pmi = F.log(F.col("n") * float(n) / (F.col("na") * F.col("nb")))
    fewer = F.least("na", "nb")
    firm = pmi * (F.col("n") - 1) / F.col("n") * fewer / (fewer + 1)
    table = _with_count(_with_count(pairs, left, "a", "na", n), right, "b", "nb", n)
    return vocabulary, stages.put(table.select("p", "n", pmi.alias("pmi"), firm.alias("firm")), "pmi"), n


def segment_measures(stages: Stages, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, seg, size`` and the ``FEATURES`` of every segment of every text."""
    from pyspark.sql.pandas.types import to_arrow_type

    sc = documents.sparkSession.sparkContext
    kind = documents.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    base = f"doc {kind.simpleString()}, seg int, size bigint, " + ", ".join(f"{f} float" for f in _BASE)
    d = documents.select(id_col, text_col).where(f"{text_col} IS NOT NULL AND {id_col} IS NOT NULL")
    segs = stages.put(d.mapInArrow(lambda it: _segment_rows(it, id_type), f"{base}, words array<bigint>"), "segments")
    vocabulary, table, n = pair_pmi(stages, segs)
    hot = table.where(F.col("n") * HOT_PAIRS >= n).select("p", "pmi", "firm").toArrow()  # at most HOT_PAIRS rows
    keys = hot["p"].to_numpy()
    order = np.argsort(keys)
    sent = sc.broadcast((keys[order], hot["pmi"].to_numpy()[order], hot["firm"].to_numpy()[order]))
    schema = f"{base}, pairs bigint, pmi_sum double, firm_sum double, loose_n bigint, rare double, others array<bigint>"
    rows = stages.put(segs.mapInArrow(lambda it: _pmi_rows(it, vocabulary, sent), schema), "rows")
    # Pairs that are not hot: joined with their counts, summed by segment, added to the segment's own sums.
    loose = F.when(F.col("pmi") < LOOSE_PMI, 1).otherwise(0).cast("long").alias("loose_n")
    rest = (
        rows.where(F.size("others") > 0)
        .select("doc", "seg", F.explode("others").alias("p"))
        .join(table.where(F.col("n") * HOT_PAIRS < n).select("p", "pmi", "firm"), "p")
        .select("doc", "seg", F.col("pmi").alias("pmi_sum"), F.col("firm").alias("firm_sum"), loose)
    )
    kept = ("size", "pairs", "rare", *_BASE)
    whole = (
        rows.drop("others")
        .unionByName(rest, allowMissingColumns=True)
        .groupBy("doc", "seg")
        .agg(F.sum("pmi_sum").alias("pmi_sum"), F.sum("firm_sum").alias("firm_sum"), F.sum("loose_n").alias("loose_n"), F.count("size").alias("copies"), *[F.max(c).alias(c) for c in kept])
    )
    n_pairs = F.greatest(F.lit(1), F.col("pairs") * F.col("copies"))
    return whole.select(
        "doc", "seg", "size", (F.col("pmi_sum") / n_pairs).alias("pmi"), (F.col("firm_sum") / n_pairs).alias("firm"), (F.col("loose_n") / n_pairs).alias("loose"), "rare", *_BASE
    )


def fit_on_labels(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> np.ndarray:
    """Weights fitted to a bounded sample of labelled documents (``TRAIN_DOCUMENTS`` of least hash).

    A document's label is what most of its raters say; undecided raters and ties do not count.
    """
    y = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("y"))
        .where("y <> 0.5")
        .orderBy(F.xxhash64("doc"))
        .limit(TRAIN_DOCUMENTS)
    )
    x = measured.where(F.col("seg") < TRAIN_SEGMENTS).join(F.broadcast(y), "doc").select("doc", "y", "size", *FEATURES).toPandas()
    if x.empty:
        return fit(np.empty((0, len(FEATURES))), np.empty(0), np.empty(0, dtype=int), np.empty(0))
    docs, doc = np.unique(x["doc"].to_numpy(), return_inverse=True)
    label = np.zeros(len(docs))
    label[doc] = (x["y"].to_numpy() > 0.5).astype(float)
    return fit(x[list(FEATURES)].to_numpy(), x["size"].to_numpy().astype(float), doc, label)


def stuffed_documents(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "stuffed"
) -> DataFrame:
    """``id_col, share, stuffed``: the share of each text's characters that are stuffed, and whether it is over half.

    Null, empty and blank texts have no segments and no row, nor have rows without an id; rows of one id make up one
    document; without labels the prior weights hold. Further columns are ignored.
    """
    stages = Stages(documents.sparkSession, "stuffing")
    measured = stages.put(segment_measures(stages, documents, id_col, text_col), "measured")
    w = fit_on_labels(measured, labels, label_id, label_col)
    z = F.lit(float(w[-1]))
    for f, v in zip(FEATURES, w):
        z = z + F.col(f) * float(v)
    s = 1 / (1 + F.exp(-z))
    share = (F.sum(s * F.col("size")) / F.sum("size")).alias("share")
    return measured.groupBy(F.col("doc").alias(id_col)).agg(share).withColumn("stuffed", F.col("share") > 0.5)
