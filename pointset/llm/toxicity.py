"""Toxicity by multiple-instance learning: sentences are scored, a document's score is their noisy-or.

Only documents have labels.  A sentence's score is a logistic function of its words and their beginnings (hashed to a table of fixed size), a
document's is 1 - prod(1 - sentence score), and the weights are trained in numpy on that through the document labels of a
bounded sample (``max_rows`` documents with ``max_words`` words in all), with a penalty on their size so that only words that carry the label keep weight.  The
same sentence scores then locate the offending sentences.

Words are runs of bytes that are no ASCII control, space or punctuation character, with A-Z in lower case; sentences end
at . ! ? and line ends.

Defined cases: a null or empty text has no sentence and scores 0; labels that are null, and labels of unknown documents,
are not used; of several labels of a document the highest counts; without both labels in the sample every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointset.llm.common import Prefix, Scratch, id_key, small_batches, text_bytes
from pointset.llm.jaccard_join import LOWER, WORD_BASE, slices
from pointset.llm.language_id import fold, labelled_sample

BITS = 18
#: Bytes of a word's beginning that are features too, for words of which only the stem comes again.
PREFIXES = (4, 5, 6, 7)
MARK = np.zeros(256, bool)
MARK[:128] = True
MARK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
STOP = np.zeros(256, bool)
STOP[[10, 13, 33, 46, 63]] = True


def marked_words(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = (), characters: bool = False) -> tuple[np.ndarray, ...]:
    """Fingerprint, start and end of every word; then the fingerprints of its first so many bytes.

    With ``characters`` each character of a script that is written without spaces is a word.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    low = LOWER[data]
    gap = MARK[low]
    cut = np.zeros(len(low) + 4, bool)
    cut[offsets[(offsets > 0) & (offsets < len(low))]] = True
    if characters:
        at, length = unspaced(low)
        cut[at] = cut[at + length] = True
    cut = cut[: len(low)]
    before, after = cut.copy(), np.ones(len(low), bool)
    before[0] = True
    before[1:] |= gap[:-1]
    after[:-1] = gap[1:] | cut[1:]
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    sums = Prefix(low, WORD_BASE)
    return sums.of(starts, ends), starts, ends, *(sums.of(starts, np.minimum(ends, starts + k)) for k in prefixes)


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters of scripts without spaces begin, and their bytes: U+3000 to U+9FFF (kana, ideographs), U+20000 to U+2FFFF, Thai, Lao, Burmese, Khmer."""
    high = np.flatnonzero(data >= 0xE0)
    lead, second = data[high], data[np.minimum(high + 1, len(data) - 1)]
    three = ((lead >= 0xE3) & (lead <= 0xE9)) | ((lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)) | ((lead == 0xE1) & np.isin(second, (0x80, 0x81, 0x82, 0x9E, 0x9F)))
    four = (lead == 0xF0) & (second >= 0xA0) & (second <= 0xAF)
    return high[three | four], np.where(four, 4, 3)[three | four]


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word; where each sentence's words begin; each sentence's text; the sentences' byte ranges (start, end)."""
    h, starts, ends, *beginnings = marked_words(data, offsets, PREFIXES)
    feature = np.stack([(x >> np.uint64(64 - BITS)).astype(np.int32) for x in (h, *beginnings)], 1)
    stops = np.cumsum(STOP[data]) if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(h), bool)
    new[1:] = (stops[starts[1:]] != stops[starts[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1 if len(first) else first
    return feature, first, text[first], np.stack([starts[first], ends[last]], 1) if len(first) else np.zeros((0, 2), np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def train(feature: np.ndarray, first: np.ndarray, bag: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.1, bags: float = 0.05, at_once: int = 1 << 14) -> Model:
    """Adam on the log-likelihood of the bags.

    feature: the features of each word; first: where each sentence begins; bag: the document of each sentence.
    The L1 penalty is what ``bags`` unexplained toxic documents of ten sentences can pull a word: words that only a few documents share stay at zero.
    """
    w, b = np.zeros(1 << BITS), -5.0
    m, v, mb, vb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    after = np.append(first[1:], len(feature))
    parts = [(k, min(k + at_once, len(first))) for k in range(0, len(first), at_once)]
    toxic = max(1, int((label == 1).sum()))
    balance = np.where(label == 1, 0.5 / toxic, 0.5 / max(1, len(label) - toxic))
    penalty = bags * 0.5 / toxic
    for step in range(1, steps + 1):
        logit = np.concatenate([np.add.reduceat(w[feature[first[i] : after[j - 1]]].sum(1), first[i:j] - first[i]) for i, j in parts])
        p = 1 / (1 + np.exp(-np.clip(logit + b, -30, 30)))
        quiet = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(label))
        doc = np.clip(1 - np.exp(quiet), 1e-9, 1 - 1e-9)
        # the loss by a sentence's logit: p in clean documents, -p * (1 - doc) / doc in toxic ones
        g = np.where(label[bag] == 1, -p * (1 - doc[bag]) / doc[bag], p) * balance[bag]
        gw = np.zeros(1 << BITS)
        for i, j in parts:
            own = np.repeat(g[i:j], after[i:j] - first[i:j])
            for k in range(feature.shape[1]):
                gw += np.bincount(feature[first[i] : after[j - 1], k], own, minlength=1 << BITS)
        gw = np.where(w == 0, np.sign(gw) * np.maximum(np.abs(gw) - penalty, 0), gw + penalty * np.sign(w))
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = 1 - 0.9**step, 1 - 0.999**step
        moved = w - rate * (m / scale[0]) / (np.sqrt(v / scale[1]) + 1e-6)
        crossed = w * moved < 0
        m[crossed] = 0
        w = np.where(crossed, 0, moved)
        b = min(b - rate * (mb / scale[0]) / (np.sqrt(vb / scale[1]) + 1e-6), -2.0)
    return Model(w, float(b))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as numbers: the features of its words, and where its sentences begin."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out = []
        for k in range(len(offsets) - 1):
            feature, first, _, _ = sentences(data[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k])
            out.append((feature.astype(np.int32).tobytes(), first.astype(np.int32).tobytes(), len(feature)))
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.record_batch([batch.column("mark"), batch.column("label"), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["mark", "label", "features", "firsts", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 3000, max_words: int = 4_000_000) -> Model | None:
    """Trains on ``max_rows`` labelled documents at most, in the order of a hash of their ids while they have ``max_words`` words in all; what comes to the driver are numbers."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = labelled_sample(known, "id", max_rows).select("id", F.col("__mark").alias("mark"), "label")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    texts = rows.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select("mark", "label", "text")  # max_rows ids
    with Scratch(docs.sparkSession) as scratch:
        bags = scratch.written(texts.mapInArrow(_bags, "mark long, label int, features binary, firsts binary, n long"), "bags")
        upto = F.sum("n").over(Window.orderBy("mark", "n", "features"))  # max_rows rows
        found = bags.withColumn("upto", upto).where(F.col("upto") <= max_words).orderBy("mark", "n", "features").collect()
    if len({r["label"] for r in found}) < 2:
        return None
    feature = np.concatenate([np.frombuffer(r["features"], np.int32) for r in found]).reshape(-1, 1 + len(PREFIXES))
    if not len(feature):
        return None
    words = np.array([r["n"] for r in found])
    firsts = [np.frombuffer(r["firsts"], np.int32) for r in found]
    first = np.concatenate([f + base for f, base in zip(firsts, np.cumsum(words) - words, strict=True)])
    return train(feature, first, np.repeat(np.arange(len(found)), [len(f) for f in firsts]), np.array([r["label"] for r in found]))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = (), offending: float = 0.5) -> DataFrame:
    """The columns ``keep`` and score, predicted, sentences: byte ranges and scores of the sentences that score ``offending`` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    out_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("__text"))
            n = len(offsets) - 1
            quiet, where = np.zeros(n), [[] for _ in range(n)]
            for a, b in slices(offsets) if own else ():
                feature, first, text, at = sentences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(first):
                    continue
                p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(own.weights[feature].sum(1), first) + own.bias, -30, 30)))
                quiet[a:b] = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=b - a)
                for k in np.flatnonzero(p >= offending):
                    base = offsets[a + text[k]] - offsets[a]
                    where[a + text[k]].append({"start": int(at[k, 0] - base), "end": int(at[k, 1] - base), "score": float(p[k])})
            s = 1 - np.exp(quiet)
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(where, out_type)], names=[*keep, "score", "predicted", "sentences"])

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInArrow(run, f"{schema}, score double, predicted int, sentences array<struct<start:bigint,end:bigint,score:double>>")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per row: doc_key, held_out, score, predicted, sentences; labels are learned from rows that are not held out."""
    model = fit(docs, labels.where(fold(id_col) != 0), id_col, text_col, **more)
    rows = docs.select(id_key(id_col).alias("doc_key"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, model, keep=("doc_key", "held_out"))
