"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A random walk over a string of words (output the word, then go on to the next word or stay, by a random bit of the word and
the step) turns edit distance into Hamming distance.  A window's key is a few coordinates of that embedding; equal keys of
a document window and an item window are a candidate.  Items are cut into size classes; a class fixes the words of a
window and the stride at which document windows begin, and an item has a window at every word, so a passage of an item
always has document windows that are aligned with item windows.  ``walks * samples`` tables repeat the draw.  A candidate is
aligned and verified: the item is found if some part of the document is at a word edit distance of at most
``max_edits`` of the item's words.

With 20 % of a window's words edited, about half of the coordinates of a walk still agree, so a table of four coordinates
hits with a probability of 1/16 and 36 tables with 0.9; a passage has several aligned windows.  tests/llm measures recall.

The document side is one pass without a shuffle.  Items come in blocks of ``block_items``: a block is broadcast, its
matches are written, the broadcast is freed, and the next block comes; more items are more passes.

Words are runs of bytes that are no ASCII control, space or punctuation character, with A-Z in lower case; in scripts that
are written without spaces every character is a word.

The windows are those of the size class of an item (16, 8 or 4 words), not as long as the item: an item of 60 words has its
edits spread over several windows, and one of them with few edits is enough.

Items of under five words may have no edit and are found by the equality of their whole word sequence.  Such an item may be
a common phrase, so ``without_leaks`` drops a document for it only if the document has no other words.

Defined cases: null and empty texts match nothing, items without words neither; equal items are found each under its own id;
rows that repeat an id repeat their matches once, of several matches the one with the fewest edits that comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointset.llm.common import NO_ID, id_key, mixed, once_a_worker, own_keys, small_batches, text_bytes, written
from pointset.llm.jaccard_join import slices
from pointset.llm.toxicity import marked_words

#: Smallest item of a class, words of its windows, stride of document windows: stride <= item words - window words + 1.
CLASSES = ((24, 16, 8), (12, 8, 4), (5, 4, 2))
#: Items with fewer words are found by equality.
SHORT = 5
END = np.uint64(0x5851F42D4C957F2D)


class Sampler:
    """The keys of windows of one class."""

    def __init__(self, width: int, walks: int, samples: int, coordinates: int = 4, seed: int = 11):
        rng = np.random.default_rng(seed + width)
        self.width, self.steps, self.walks = width, min(2 * width, 64), walks
        self.seeds = rng.integers(1, 2**63, walks, dtype=np.uint64)
        cut = np.linspace(0, self.steps, coordinates + 1).astype(int)
        self.picks = np.stack([rng.integers(cut[k], cut[k + 1], (walks, samples)) for k in range(coordinates)], 2)

    def keys(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the keys of the windows at ``start`` of ``words``; a window has ``width`` words, or ends at ``end``."""
        stop = np.minimum(start + self.width, end)
        padded = np.append(words, END)
        for walk in range(self.walks):
            coins = mixed(padded ^ self.seeds[walk])
            needed = set(self.picks[walk].ravel().tolist())
            at, seen = start.copy(), {}
            for step in range(self.steps):
                if step in needed:
                    seen[step] = padded[np.where(at < stop, at, len(words))]
                at += ((coins[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
                np.minimum(at, stop, out=at)
            for pick in self.picks[walk]:
                key = np.full(len(start), walk + 1, np.uint64)
                for step in pick.tolist():
                    key = key * np.uint64(0x9E3779B97F4A7C15) + (seen[step] ^ (seen[step] >> np.uint64(31)))
                yield key


class ItemIndex:
    """Keys of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], walks: int, samples: int):
        self.items, self.tables = items, []
        for k, (least, width, stride) in enumerate(CLASSES):
            most = CLASSES[k - 1][0] if k else 1 << 60
            own = [i for i, (_, w) in enumerate(items) if least <= len(w) < most]
            if not own:
                continue
            words = np.concatenate([items[i][1] for i in own])
            sizes = np.array([len(items[i][1]) for i in own])
            begin = np.cumsum(sizes) - sizes
            n = sizes - width + 1
            item, offset = np.repeat(np.array(own), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(begin, n) + offset
            sampler, tables = Sampler(width, walks, samples), []
            for key in sampler.keys(words, start, np.repeat(begin + sizes, n)):
                order = np.argsort(key, kind="stable")
                bits = np.zeros(1 << 20, bool)
                bits[(key >> np.uint64(44)).astype(np.int64)] = True
                tables.append((key[order], item[order], offset[order], np.packbits(bits)))
            self.tables.append((sampler, stride, tables))
        self.short = []
        for size in range(1, SHORT):
            own = np.array([i for i, (_, w) in enumerate(items) if len(w) == size], np.int64)
            key = np.array([sequence_keys(items[i][1], size)[0] for i in own], np.uint64)
            self.short.append((key[np.argsort(key)], own[np.argsort(key)]))

    def short_candidates(self, words: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The first place of each short item in each text."""
        for size, (known, item) in enumerate(self.short, 1):
            if not len(item) or len(words) < size:
                continue
            key = sequence_keys(words, size)
            text = np.searchsorted(at, np.arange(len(key)), side="right") - 1
            lo, hi = np.searchsorted(known, key), np.searchsorted(known, key, side="right")
            hit = np.flatnonzero((hi > lo) & (np.arange(len(key)) + size <= at[text + 1]))
            n = hi[hit] - lo[hit]
            which = np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = np.repeat(hit, n)
            found = np.stack([text[start], item[which], start - at[text[start]]], 1)
            yield found[np.unique(found[:, :2], axis=0, return_index=True)[1]]

    def candidates(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (text, item, word of the text where the item would begin); ``at``: where each text's words begin."""
        out = [*self.short_candidates(words, at)]
        counts = np.diff(at)
        for sampler, stride, tables in self.tables:
            n = -(-np.maximum(counts - sampler.width // 2, 0) // stride)
            text = np.repeat(np.arange(len(counts)), n)
            start = at[:-1][text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
            for key, (known, item, offset, bits) in zip(sampler.keys(words, start, at[1:][text]), tables, strict=True):
                slot = (key >> np.uint64(44)).astype(np.int64)
                maybe = np.flatnonzero((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
                lo, hi = np.searchsorted(known, key[maybe]), np.searchsorted(known, key[maybe], side="right")
                hit = np.repeat(np.arange(len(maybe)), hi - lo)
                which = np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[hit]
                w = maybe[hit]
                out.append(np.stack([text[w], item[which], start[w] - at[:-1][text[w]] - offset[which]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def verify(self, words: np.ndarray, at: np.ndarray, found: np.ndarray, max_edits: float) -> list[tuple[int, int, int, int, int]]:
        """The best (text, item, edits, first word, word after the last) of each text and item that are close enough."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, begin in found.tolist():
            own = self.items[item][1]
            most = int(max_edits * len(own)) if len(own) >= SHORT else 0
            if best.get((text, item), (1,))[0] == 0:
                continue
            lo = max(at[text], at[text] + begin - most)
            part = words[lo : min(at[text + 1], at[text] + begin + len(own) + most)]
            if np.isin(own, part).sum() < len(own) - most:
                continue
            edits, first, last = nearest_part(own, part)
            if edits <= most and (edits, first) < best.get((text, item), (1 << 60, 0, 0))[:2]:
                best[text, item] = edits, int(lo - at[text]) + first, int(lo - at[text]) + last
        return [(t, i, *b) for (t, i), b in sorted(best.items())]


def sequence_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint of each run of ``size`` words."""
    key = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(key)])
    return key


def nearest_part(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to any run of words of ``part``, and that run."""
    n = len(part)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for k, word in enumerate(item, 1):
        up = cost + 1
        diagonal = cost[:-1] + (part != word)
        new, source = up.copy(), origin.copy()
        take = diagonal < new[1:]
        new[1:][take], source[1:][take] = diagonal[take], origin[:-1][take]
        # words of the part left out: the least of what stands to the left plus the way
        slid = new - np.arange(n + 1)
        least = np.minimum.accumulate(slid)
        where = np.maximum.accumulate(np.where(slid == least, np.arange(n + 1), 0))
        cost, origin = least + np.arange(n + 1), source[where]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


MATCH = "doc_key long, item_key long, edits int, item_words int, first_word int, end_word int, doc_words int"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of all texts, and where each text's begin."""
    data, offsets = text_bytes(texts)
    words, starts, _ = marked_words(data, offsets, characters=True)
    return words, np.searchsorted(starts, offsets)


def _matches(texts: DataFrame, block: Broadcast, max_edits: float, walks: int, samples: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = once_a_worker(block, lambda items: ItemIndex(items, walks, samples))
        for batch in batches:
            ids = batch.column("doc_key").to_pylist()
            for lo, hi in slices(text_bytes(batch.column("text"))[1]):
                words, at = _words(batch.column("text").slice(lo, hi - lo))
                found = own.verify(words, at, own.candidates(words, at), max_edits)
                rows = [(ids[lo + t], own.items[i][0], edits, len(own.items[i][1]), a, b, int(at[t + 1] - at[t])) for t, i, edits, a, b in found]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in MATCH.split(", ")])

    return texts.mapInArrow(run, MATCH)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_edits: float = 0.2, walks: int = 6, samples: int = 6, block_items: int = 2000) -> DataFrame:
    """One row for each document and each item that it holds: doc_key, item_key, edits, item_words, first_word, end_word (places in words), doc_words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(id_key(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(NO_ID)).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    out, items = spark.createDataFrame([], MATCH), rows.toLocalIterator()
    while block := list(islice(items, block_items)):  # one block of items at a time
        words, at = _words(pa.array([r["text"] for r in block], pa.string()))
        shared = spark.sparkContext.broadcast([(r["item"], words[a:b]) for r, a, b in zip(block, at[:-1], at[1:], strict=True)])  # block_items items; workers make the index
        out = out.unionByName(written(_matches(texts, shared, max_edits, walks, samples), "leaks"))
        shared.unpersist()
    match = [c for c in out.columns if c not in ("doc_key", "item_key")]
    best = out.groupBy("doc_key", "item_key").agg(F.min(F.struct("edits", "first_word", *[c for c in match if c not in ("edits", "first_word")])).alias("best"))
    return best.select("doc_key", "item_key", *[F.col("best")[c].alias(c) for c in match])


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the documents that hold an item (see above for items of under five words); all columns stay.

    Rows of one id with unlike texts, and rows without id, are judged each for itself.
    """
    rows = own_keys(docs, id_col, text_col)
    found = find_leaks(rows, benchmark, "doc_key", "text", **more)
    bad = found.where(f"item_words >= {SHORT} or doc_words = item_words").select("doc_key").distinct()
    return rows.join(bad, "doc_key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
