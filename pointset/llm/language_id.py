"""Language identification by a convolutional network over bytes.

Filters of several widths run over the bytes of fixed-length windows, the largest answer of each filter in a window goes
through a ReLU to a softmax over languages, and a document's probabilities are the mean over all of its windows: whole
texts are read, in batches of windows.  Training is plain numpy on a bounded sample: ``max_windows`` windows, drawn by hash
from all windows of the whole texts of ``max_rows`` labelled rows.  For
prediction the byte embedding and the filters are folded into lookup tables over bytes and byte pairs, which gives the same
numbers with one gather for each pair.

Defined cases: a null text and a text without any letter are ``und`` with score 0; short texts are one window padded with
zero bytes; without training rows every text is ``und``; ties between languages go to the first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointset.llm.common import id_key, mixed, once_a_worker, small_batches, text_bytes

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 16, 8, 256
UNKNOWN = "und"


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def labelled_sample(rows: DataFrame, id_col: str, max_rows: int, *more: str) -> DataFrame:
    """At most ``max_rows`` rows, those whose id has the smallest hash, with that hash as ``__mark``; ties go by the hash of the columns ``more``, and of rows that are equal in both one stays."""
    marked = rows.withColumn("__mark", F.xxhash64(F.col(id_col).cast("string"))).withColumn("__tie", F.xxhash64(id_col, *more))
    pair = F.struct("__mark", "__tie")
    last = marked.select(pair.alias("pair")).orderBy("pair").limit(max_rows).agg(F.max("pair")).first()[0]
    if last is None:
        return marked.limit(0).drop("__tie")
    inside = (F.col("__mark") < last[0]) | ((F.col("__mark") == last[0]) & (F.col("__tie") <= last[1]))
    return marked.where(inside).dropDuplicates(["__mark", "__tie"]).drop("__tie")


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``size`` bytes and the bytes that the widest filter still needs, zero beyond the text; and the text of each row."""
    lengths = np.diff(offsets)
    n = np.maximum(1, -(-lengths // size))
    text = np.repeat(np.arange(len(lengths)), n)
    first = np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][text] + (np.arange(len(text)) - first) * size
    at = start[:, None] + np.arange(size + max(WIDTHS) - 1)
    rows = np.append(data, np.uint8(0))[np.minimum(at, len(data))]
    rows[at >= offsets[1:][text][:, None]] = 0
    return rows, text


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def _columns(x: np.ndarray, w: int, size: int) -> np.ndarray:
    return np.concatenate([x[:, k : k + size] for k in range(w)], axis=2)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 250, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the cross-entropy of windows; ``rows`` come from ``windows_of``."""
    rng = np.random.default_rng(seed)
    size, f, total = rows.shape[1] - max(WIDTHS) + 1, FILTERS, FILTERS * len(WIDTHS)
    w = [rng.normal(0, 0.3, (256, EMBED)), *(rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, f)) for k in WIDTHS), np.zeros(total), rng.normal(0, 0.1, (total, len(languages))), np.zeros(len(languages))]
    w = [x.astype(np.float32) for x in w]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), batch)
        x, y = rows[pick], labels[pick]
        e = w[0][x]
        cols, hot, best = [], [], []
        for i, k in enumerate(WIDTHS):
            c = _columns(e, k, size)
            z = c.reshape(-1, k * EMBED) @ w[1 + i]
            z = z.reshape(batch, size, f)
            where = z.argmax(1)
            cols.append(c)
            hot.append(where)
            best.append(np.take_along_axis(z, where[:, None], 1)[:, 0])
        pooled = np.concatenate(best, 1) + w[-3]
        act = np.maximum(pooled, 0)
        out = act @ w[-2] + w[-1]
        out = np.exp(out - out.max(1, keepdims=True))
        out /= out.sum(1, keepdims=True)
        out[np.arange(batch), y] -= 1
        out /= batch
        back = (out @ w[-2].T) * (pooled > 0)
        grads = [np.zeros_like(w[0]), *(None,) * len(WIDTHS), back.sum(0), act.T @ out, out.sum(0)]
        for i, k in enumerate(WIDTHS):
            g = back[:, i * f : (i + 1) * f]
            taken = np.take_along_axis(cols[i], hot[i][:, :, None], 1)  # batch, filter, width * embed
            grads[1 + i] = np.einsum("bfd,bf->df", taken, g)
            into = (g[:, :, None] * w[1 + i].T[None]).reshape(batch, f, k, EMBED)
            at = np.take_along_axis(x[:, None, :].repeat(f, 1), hot[i][:, :, None] + np.arange(k), 2)
            np.add.at(grads[0], at.ravel(), into.reshape(-1, EMBED))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, w[0], w[1 : 1 + len(WIDTHS)], w[-3], w[-2], w[-1])


class Folded:
    """The network as lookup tables: filters of widths 2, 3 and 4 from a byte pair, the third byte, the second pair."""

    def __init__(self, net: Network):
        parts = [[net.embed @ w[k * EMBED : (k + 1) * EMBED] for k in range(n)] for w, n in zip(net.filters, WIDTHS, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, a.shape[1]).astype(np.float32)
        self.first = np.concatenate([pair(p[0], p[1]) for p in parts], axis=1)
        self.third = parts[1][2].astype(np.float32)
        self.second = pair(parts[2][2], parts[2][3])
        self.net = net

    def window_probabilities(self, rows: np.ndarray, at_once: int = 1024) -> np.ndarray:
        out, size, f = [], rows.shape[1] - max(WIDTHS) + 1, FILTERS
        for k in range(0, len(rows), at_once):
            x = np.ascontiguousarray(rows[k : k + at_once].T).astype(np.int32)
            pairs = x[:-1] * 256 + x[1:]
            best = np.full((x.shape[1], f * len(WIDTHS)), -np.inf, np.float32)
            for j in range(size):
                z = self.first.take(pairs[j], axis=0)
                z[:, f : 2 * f] += self.third.take(x[j + 2], axis=0)
                z[:, 2 * f :] += self.second.take(pairs[j + 2], axis=0)
                np.maximum(best, z, out=best)
            z = np.maximum(best + self.net.bias, 0) @ self.net.dense + self.net.dense_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)

    def text_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, text = windows_of(data, offsets)
        p = self.window_probabilities(rows)
        n = np.bincount(text, minlength=len(offsets) - 1)
        return np.stack([np.bincount(text, p[:, k], minlength=len(n)) for k in range(p.shape[1])], 1) / n[:, None]


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of every text, with a hash of the text's mark and the window's number."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        mark = batch.column("mark").to_numpy().view(np.uint64)
        for a, b in _slices(offsets):
            rows, text = windows_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            number = np.arange(len(text)) - np.searchsorted(text, text)
            draw = mixed(mark[a:b][text] + mixed(number.astype(np.uint64))) >> np.uint64(1)
            yield pa.record_batch([pa.array(draw.astype(np.int64)), batch.column("lang").slice(a, b - a).take(pa.array(text)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["draw", "lang", "window"])


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 2500, max_windows: int = 12_000) -> Network | None:
    """Trains on ``max_windows`` windows at most of ``max_rows`` labelled rows at most.

    Executors cut the texts; of all windows of the whole texts those with the smallest hash come to the driver.
    """
    good = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sample = labelled_sample(good, "id", max_rows, "text", "lang").select(F.col("__mark").alias("mark"), "text", "lang")
    found = sample.mapInArrow(_training_windows, "draw long, lang string, window binary").orderBy("draw", "lang", "window").limit(max_windows).collect()
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    x = np.frombuffer(b"".join(r["window"] for r in found), np.uint8).reshape(len(found), -1)
    return train(x, np.searchsorted(languages, [r["lang"] for r in found]), languages)


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` (any columns but text_col pass through) with lang_pred and score; the text goes along as given."""
    small_batches(docs.sparkSession)
    kinds = [f for f in docs.schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size; workers fold it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = once_a_worker(shared, lambda own: Folded(own) if own else None)
        for batch in batches:
            column = batch.column(names.index(text_col))
            data, offsets = text_bytes(column)
            lang, score = [UNKNOWN] * len(column), np.zeros(len(column))
            if tables and len(column):
                p = np.concatenate([tables.text_probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _slices(offsets)])
                best = p.argmax(1)
                known = batch.column(len(names)).to_numpy(zero_copy_only=False)
                lang = [tables.net.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
                score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.record_batch([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    names = [f.name for f in kinds]
    lettered = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("__lettered"))
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return lettered.mapInArrow(run, StructType([*kinds, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def _slices(offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **more) -> DataFrame:
    """Per row: doc_key, held_out, lang_pred, score; learns from the rows that are not held out."""
    net = fit(docs.where(fold(id_col) != 0), id_col, text_col, lang_col, **more)
    rows = docs.select(id_key(id_col).alias("doc_key"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return identify(rows, net).drop("text")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3, **more) -> DataFrame:
    """``docs`` without the documents that have no letter, or no language with a probability of ``least``.  Columns and texts stay as they are."""
    net = fit(docs.where(fold(id_col) != 0), id_col, text_col, lang_col, **more)
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of a caller's columns may clash with ours
    found = identify(numbered, net, f"c{docs.columns.index(text_col)}").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
