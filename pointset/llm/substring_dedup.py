"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

What counts: a byte is removed when it lies in a string of ``min_bytes`` bytes that also starts earlier
(at a smaller id, or in the same document at an earlier place).  Matches never cross documents, overlaps
count, and everything is judged on the input.

How it runs on Spark
--------------------
1. *Dealing.*  Of the ``min_bytes - gram + 1`` grams in every window of ``min_bytes`` bytes the one with the smallest
   hash is its anchor.  Equal windows have equal anchors at equal offsets, so only windows of one anchor need to meet.
   Neighbouring windows of one anchor are a run (about one in thirty bytes), known by a fingerprint of its bytes.  A run
   whose anchor stands nowhere else has no repeat, and of runs that are equal as a whole the later ones repeat the
   earliest: both are settled before any text moves.
2. *Suffix arrays.*  The other runs come back with their bytes.  In a bucket of anchors each arriving batch gets the suffix
   array of its windows, sorted by their bytes (``SuffixArray.of``).  Levels of like size merge (``merge_scan``): one scan
   along both arrays in byte order finds the suffixes that agree in ``min_bytes`` bytes or more, keeps the earliest place
   of each and hands out the later ones as repeats.  A suffix is moved a logarithmic number of times, a level is its text
   and one number for each suffix, and strings are drawn up for one stretch of the scan at a time.
3. *Hot anchors.*  A first pass counts the runs of frequent anchors over all documents.  An anchor that has more than
   ``hot_runs`` runs and more than one in ``HOT_SHARE`` of all is dealt by run, and in step 2 by single windows, so a
   passage that a third of all documents share does not fill one task.  No more than ``HOT_SHARE`` anchors can be hot.
4. Spans of repeats meet their text by id.

Defined cases: a null or empty text has no windows and keeps nothing; a text shorter than ``min_bytes`` is
kept whole.  In ``removal_digest`` null ids count as one id below all others, and rows that repeat an id count as one
document whose places coincide (the same text twice under one id is no repeat, and what is removed in one is removed in
both).  In ``dedup`` rows of one id with unlike texts, and rows without id, are documents of their own that come after all
others.  Other columns pass through ``dedup`` untouched, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointset.llm.common import Prefix, Scratch, id_key, mixed, own_keys, partitions, small_batches, split_by, text_bytes, written

#: One run: the hashes of its anchor and of all its bytes, its place, its number of windows.
RUN = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("windows", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("pos", "<i4"), ("windows", "<i4")])
#: Bytes of text whose windows are taken at once, runs of a map batch, suffixes of a batch of the family.
CHUNK, BATCH, SUFFIXES = 1 << 18, 1 << 17, 1 << 16
#: Suffixes of either side in one stretch of a merge scan.
STRETCH = 1 << 15
#: A hot anchor has more than one in so many of all runs.
HOT_SHARE = 1 << 14
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def strings(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each place on, as strings that compare byte by byte; a last byte keeps zeros at the end."""
    rows = np.ones((len(at), size + 1), np.uint8)
    if len(at):
        rows[:, :size] = np.lib.stride_tricks.sliding_window_view(text, size)[at]
    return rows.view(f"S{size + 1}").ravel()


@dataclass
class SuffixArray:
    """``at``: places in ``text`` in the order of the ``size`` bytes that start there, no two equal; runs: where each begins in the text, and its document and place."""

    text: np.ndarray
    at: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    pos: np.ndarray

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.begin, at, side="right") - 1
        return self.doc[run], self.pos[run] + (at - self.begin[run])

    def __len__(self) -> int:
        return len(self.at)

    @staticmethod
    def of(text: np.ndarray, runs: np.ndarray, size: int) -> tuple[SuffixArray, np.ndarray]:
        """The suffix array of all windows of the runs that make up ``text``; and the spans that repeat within it."""
        windows = runs["windows"].astype(np.int64)
        length = windows + size - 1
        begin = np.cumsum(length) - length
        at = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        own = SuffixArray(text, at, begin, runs["doc"].astype(np.int64), runs["pos"].astype(np.int64))
        s = strings(text, at, size)
        order = np.argsort(s, kind="stable")
        s = s[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        doc, pos = own.places(at[order])
        first, later = earliest(np.cumsum(new) - 1, doc, pos)
        own.at = at[order[first]]
        return own, spans_of(doc[later], pos[later])


def earliest(group: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the row with the earliest place, in order of groups; and the rows with a later place than that."""
    order = np.lexsort((pos, doc, group))
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    first, later = order[new], order[~new]
    kept = first[(np.cumsum(new) - 1)[~new]] if len(order) else first
    return first, later[(doc[later] != doc[kept]) | (pos[later] != pos[kept])]  # a row that repeats an id has the same place again


def spans_of(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), SPAN)
    out["doc"], out["pos"], out["windows"] = doc, pos, 1
    return joined(out)


def merge_scan(one: SuffixArray, two: SuffixArray, size: int, stretch: int = STRETCH) -> tuple[SuffixArray, np.ndarray]:
    """Two levels as one, and the spans that repeat across them: a scan along both in byte order."""
    base = len(one.text)
    out = SuffixArray(np.concatenate([one.text, two.text]), one.at, np.concatenate([one.begin, two.begin + base]), np.concatenate([one.doc, two.doc]), np.concatenate([one.pos, two.pos]))
    text, sides = out.text, (one.at, two.at + base)
    marks = np.sort(np.concatenate([strings(text, side[stretch::stretch], size) for side in sides]))
    cuts = [[0, *(bisect.bisect_left(side, m[:size], key=lambda a: text[a : a + size].tobytes()) for m in marks.tolist()), len(side)] for side in sides]
    at, repeated = [], []
    for k in range(len(marks) + 1):
        here = np.concatenate([side[c[k] : c[k + 1]] for side, c in zip(sides, cuts, strict=True)])
        s = strings(text, here, size)
        order = np.argsort(s, kind="stable")  # two ordered runs: merged, not sorted anew
        here, s = here[order], s[order]
        common = np.flatnonzero(s[1:] == s[:-1])  # the longest common prefix of neighbours reaches ``size``
        if len(common):
            (doc, pos), (doc2, pos2) = out.places(here[common]), out.places(here[common + 1])
            swap = (doc2 < doc) | ((doc2 == doc) & (pos2 < pos))
            late = (doc != doc2) | (pos != pos2)
            repeated.append(spans_of(np.where(swap, doc, doc2)[late], np.where(swap, pos, pos2)[late]))
            here = np.delete(here, np.where(swap, common, common + 1))
        at.append(here)
    out.at = np.concatenate(at)
    return out, np.concatenate([np.zeros(0, SPAN), *repeated])


class SuffixFamily:
    """Suffix arrays whose sizes grow geometrically; hands out what repeats something earlier."""

    def __init__(self, size: int, batch: int = SUFFIXES):
        self.size, self.batch, self.texts, self.runs, self.held = size, batch, [], [], 0
        self.levels: list[SuffixArray] = []

    def add(self, text: np.ndarray, runs: np.ndarray) -> list[np.ndarray]:
        """Spans that are found to repeat by the arrival of these runs."""
        out, length = [], runs["windows"].astype(np.int64) + self.size - 1
        ends, windows = np.cumsum(length), np.cumsum(runs["windows"], dtype=np.int64)
        cut = np.flatnonzero(np.diff(windows // self.batch, prepend=0, append=-1))
        for a, b in zip([0, *cut[:-1]], cut, strict=True):
            if a == b:
                continue
            self.texts.append(text[ends[a] - length[a] : ends[b - 1]])
            self.runs.append(runs[a:b])
            self.held += int(runs["windows"][a:b].sum())
            if self.held >= self.batch:
                out += self._index()
        return out

    def _index(self) -> list[np.ndarray]:
        fresh, repeated = SuffixArray.of(np.concatenate(self.texts), np.concatenate(self.runs), self.size)
        self.texts, self.runs, self.held = [], [], 0
        self.levels.append(fresh)
        out = [repeated]
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            out.append(self._merge())
        return out

    def _merge(self) -> np.ndarray:
        two, one = self.levels.pop(), self.levels.pop()
        level, repeated = merge_scan(one, two, self.size)
        self.levels.append(level)
        return repeated

    def close(self) -> Iterator[np.ndarray]:
        if self.held:
            yield from self._index()
        while len(self.levels) > 1:
            yield self._merge()


def earliest_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal runs, by anchor; and the others, but for rows that repeat an id (the same place again)."""
    x = x[np.lexsort((x["k2"], x["k1"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["k1"][1:] != x["k1"][:-1]) | (x["k2"][1:] != x["k2"][:-1])
    first, later = earliest(np.cumsum(new) - 1, x["doc"], x["pos"])
    return x[first], x[later]


def repeats(x: np.ndarray) -> np.ndarray:
    """The spans of runs."""
    out = np.empty(len(x), SPAN)
    for f in SPAN.names:
        out[f] = x[f]
    return out


def sampled_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, base: np.ndarray, size: int) -> np.ndarray:
    """Every run of windows that start in [begin, end) of each segment of ``data``.

    doc and base: the document of each segment and the place of the segment's first byte in it.
    """
    gram = 1 << max(0, (size // 3).bit_length() - 1)
    width = size - gram + 1
    if len(data) < size or not len(begin):
        return np.zeros(0, RUN)
    h = mixed(np.arange(256, dtype=np.uint64) + np.uint64(BASES[0] >> 1))[data]
    k = 1
    while k < gram:
        h = mixed_step(h[:-k], h[k:])
        k *= 2
    h = mixed(h)
    low = np.uint64((1 << 26) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while k * 2 <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if width > k:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    turns = np.zeros(len(least) + 1, np.int32)
    np.add.at(turns, begin, 1)
    np.add.at(turns, end, -1)
    start = np.flatnonzero(np.cumsum(turns[:-1]) > 0)
    anchor = (least[start] & low).astype(np.int64)
    cut = np.ones(len(start), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    cut[np.searchsorted(start, begin)] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, anchor = start[first], start[last], anchor[first]
    seg = np.searchsorted(begin, lo, side="right") - 1
    out = np.empty(len(lo), RUN)
    out["windows"] = hi - lo + 1
    shape = out["windows"].astype(np.uint64) * np.uint64(1 << 20) + (anchor - lo).astype(np.uint64)
    out["k1"], out["k2"] = h[anchor], mixed(Prefix(data, BASES[1]).of(lo, hi + size) + shape)
    out["doc"], out["pos"] = doc[seg], lo - begin[seg] + base[seg]
    return out


def mixed_step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))


def chunks(docs: np.ndarray, data: np.ndarray, offsets: np.ndarray, size: int, chunk: int = CHUNK) -> Iterator[tuple]:
    """Segments of whole documents, about ``chunk`` bytes at once; a longer document is cut so that each window lies in one segment."""
    begin, end, doc, base, parts, used = [], [], [], [], [], 0
    for i in range(len(docs)):
        lo, hi = offsets[i], offsets[i + 1]
        for at in range(0, max(0, hi - lo - size + 1), chunk):
            part = data[lo + at : min(hi, lo + at + chunk + size - 1)]
            begin.append(used)
            end.append(used + len(part) - size + 1)
            doc.append(docs[i])
            base.append(at)
            parts.append(part)
            used += len(part)
            if used >= chunk:
                yield np.concatenate(parts), np.array(begin), np.array(end), np.array(doc, np.int64), np.array(base)
                begin, end, doc, base, parts, used = [], [], [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(begin), np.array(end), np.array(doc, np.int64), np.array(base)


def _batches_of_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    waiting, held = [], 0
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for part in chunks(batch.column("doc_key").to_numpy(), data, offsets, size):
            waiting.append(sampled_runs(*part, size))
            held += len(waiting[-1])
            if held >= BATCH:
                yield np.concatenate(waiting)
                waiting, held = [], 0
    if held:
        yield np.concatenate(waiting)


def _count_anchors(size: int, share: int):
    """Rows (anchor, runs): anchors with more than one in ``share`` of a batch's runs, and under no anchor the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _batches_of_runs(batches, size):
            anchor, n = np.unique(x["k1"][np.unique(x["k1"] ^ mixed(x["k2"]), return_index=True)[1]], return_counts=True)
            often = n > max(1, len(x) // share)
            yield pa.record_batch([pa.array([*anchor[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[often].tolist(), len(x)], pa.int64())], names=["anchor", "runs"])

    return run


def hot_anchors(texts: DataFrame, size: int, hot_runs: int, scratch: Scratch, share: int = HOT_SHARE) -> np.ndarray:
    """Anchors with more than ``hot_runs`` runs and more than one in ``share`` of all, so ``share`` at most; a run counts once in a batch."""
    counts = scratch.written(texts.mapInArrow(_count_anchors(size, share), "anchor long, runs long").groupBy("anchor").agg(F.sum("runs").alias("runs")), "anchors")
    total = counts.where("anchor is null").agg(F.coalesce(F.max("runs"), F.lit(0))).first()[0]
    found = counts.where((F.col("anchor").isNotNull()) & (F.col("runs") > max(hot_runs, total // share))).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def bucket_of(x: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """By anchor; runs of a hot one by their bytes."""
    route = np.where(np.isin(x["k1"], hot), x["k2"], x["k1"]) if len(hot) else x["k1"]
    return (route >> np.uint64(24)) % np.uint64(buckets)


def _deal_runs(size: int, buckets: int, shared: Broadcast):
    schema = pa.schema([("bucket", pa.int32()), ("runs", pa.binary()), ("done", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _batches_of_runs(batches, size):
            kept, later = earliest_runs(x)  # a string that many documents share leaves a batch once
            order, cuts = split_by(bucket_of(kept, shared.value, buckets), buckets)
            kept, shares = kept[order], np.array_split(repeats(later), buckets)
            yield pa.record_batch([pa.array(np.arange(buckets, dtype=np.int32)), pa.array([columns_of(kept[cuts[b] : cuts[b + 1]]) for b in range(buckets)], pa.binary()), pa.array([columns_of(x) for x in shares], pa.binary())], schema=schema)

    return run


def columns_of(x: np.ndarray) -> bytes:
    """Field after field, which the shuffle's compression likes better than record after record."""
    return b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)


def from_columns(raw: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = len(raw) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for f in dtype.names:
        out[f] = np.frombuffer(raw, dtype[f], n, at)
        at += n * dtype[f].itemsize
    return out


def _spans(x: np.ndarray, k1: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(x)
    some = k1 is not None
    return pa.record_batch(
        [pa.array(x["doc"].astype(np.int64)), pa.array(x["pos"].astype(np.int32)), pa.array(x["windows"].astype(np.int32)), pa.array(k1.astype(np.uint64).view(np.int64) if some else np.zeros(n, np.int64)), pa.array(hot if some else np.zeros(n, bool)), pa.array(np.full(n, some))],
        names=["doc_key", "pos", "windows", "route", "hot", "open"],
    )


SPANS = "doc_key long, pos int, windows int, route long, hot boolean, open boolean"


def _settle_runs(shared: Broadcast):
    """A bucket's runs: repeats as a whole (open = false), and runs whose anchor occurs in other runs too (open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, held = np.zeros(0, RUN), [], 0
        for batch in batches:
            for raw, done in zip(batch.column("runs").to_pylist(), batch.column("done").to_pylist(), strict=True):
                yield _spans(from_columns(done, SPAN))
                waiting.append(from_columns(raw, RUN))
                held += len(waiting[-1])
                if held >= max(BATCH, len(kept)):
                    kept, later = earliest_runs(np.concatenate([kept, *waiting]))
                    waiting, held = [], 0
                    yield _spans(repeats(later))
        kept, later = earliest_runs(np.concatenate([kept, *waiting]))
        yield _spans(repeats(later))
        new = np.ones(len(kept), bool)
        new[1:] = kept["k1"][1:] != kept["k1"][:-1]
        group = np.cumsum(new) - 1
        hot = np.isin(kept["k1"], shared.value)
        opened = hot | (np.bincount(group)[group] > 1) if len(kept) else hot
        for part in np.array_split(np.flatnonzero(opened), 1 + len(kept) // BATCH):
            yield _spans(kept[part], kept["k1"][part], hot[part])

    return run


def _open_runs(size: int, buckets: int, at_once: int = 4 << 20):
    """Joined text and open runs -> the runs' bytes by bucket of their anchor; hot ones window by window, by bucket of the window."""
    schema = pa.schema([("bucket", pa.int32()), ("bytes", pa.binary()), ("runs", pa.binary()), ("done", pa.binary())])

    def send(cold: list, hot: list) -> pa.RecordBatch:
        found, windows = cold[:], hot[:]
        cold.clear()
        hot.clear()
        done = [np.zeros(0, SPAN)]
        for text, runs in windows:
            own, repeated = SuffixArray.of(text, runs, size)
            done.append(repeated)
            doc, pos = own.places(own.at)
            single = np.empty(len(own), SPAN)
            single["doc"], single["pos"], single["windows"] = doc, pos, 1
            data = np.lib.stride_tricks.sliding_window_view(text, size)[own.at].ravel()
            found.append((data, single, Prefix(text, BASES[0]).of(own.at, own.at + size)))
        data, runs, route = (np.concatenate([x[k] for x in found]) for k in range(3))
        ends = np.cumsum(runs["windows"].astype(np.int64) + size - 1)
        begins = ends - runs["windows"] - size + 1
        order, cuts = split_by((route >> np.uint64(24)) % np.uint64(buckets), buckets)
        shares = np.array_split(np.concatenate(done), buckets)
        own = [b for b in range(buckets) if cuts[b] < cuts[b + 1] or len(shares[b])]
        raw = [b"".join(data[begins[i] : ends[i]].tobytes() for i in order[cuts[b] : cuts[b + 1]].tolist()) for b in own]
        return pa.record_batch([pa.array(own, pa.int32()), pa.array(raw, pa.binary()), pa.array([columns_of(runs[order[cuts[b] : cuts[b + 1]]]) for b in own], pa.binary()), pa.array([columns_of(shares[b]) for b in own], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, hot, held = [], [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("runs")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            runs = np.empty(len(flat), SPAN)
            runs["doc"] = np.repeat(batch.column("doc_key").to_numpy(), counts)
            runs["pos"], runs["windows"] = flat.field("pos").to_numpy(), flat.field("windows").to_numpy()
            route, is_hot = flat.field("route").to_numpy().view(np.uint64), flat.field("hot").to_numpy(zero_copy_only=False)
            at = np.repeat(offsets[:-1], counts) + runs["pos"]
            inside = at + runs["windows"] + size - 1 <= np.repeat(offsets[1:], counts)  # another row of the same id may be shorter
            for sel, to in ((inside & ~is_hot, cold), (inside & is_hot, hot)):
                for part in np.array_split(np.flatnonzero(sel), 1 + sel.sum() // 1000):
                    if not len(part):
                        continue
                    a, r = at[part], runs[part]
                    length = r["windows"].astype(np.int64) + size - 1
                    take = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(length.sum())
                    to.append((data[take], r, route[part])[: 3 if to is cold else 2])
                    held += int(length.sum()) * (1 if to is cold else 25)
                    if held >= at_once:
                        yield send(cold, hot)
                        held = 0
        if held:
            yield send(cold, hot)

    return run


def _index_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixFamily(size)
        for batch in batches:
            for raw, runs, done in zip(*(batch.column(c).to_pylist() for c in ("bytes", "runs", "done")), strict=True):
                yield _spans(joined(np.concatenate([from_columns(done, SPAN), *family.add(np.frombuffer(raw, np.uint8), from_columns(runs, SPAN))])))
        for x in family.close():
            yield _spans(x)

    return run


def joined(x: np.ndarray) -> np.ndarray:
    """Spans that touch or overlap as one."""
    if len(x) < 2:
        return x
    x = x[np.lexsort((x["pos"], x["doc"]))]
    new = np.ones(len(x), bool)
    end = x["pos"].astype(np.int64) + x["windows"]
    new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["pos"][1:] > end[:-1])
    first = np.flatnonzero(new)
    out = x[first]
    out["windows"] = np.maximum.reduceat(end, first) - x["pos"][first]
    return out


def repeat_spans(texts: DataFrame, min_bytes: int = 100, hot_runs: int = 20_000) -> DataFrame:
    """(doc_key, text) -> rows (doc_key, spans), a written table: of each span (pos, windows) ``windows`` strings of ``min_bytes`` from ``pos`` on also start earlier."""
    spark = texts.sparkSession
    if not 4 <= min_bytes <= 20_000:
        raise ValueError("min_bytes must lie between 4 and 20000")
    small_batches(spark)
    n = partitions(spark)
    with Scratch(spark) as scratch:
        hot = spark.sparkContext.broadcast(hot_anchors(texts, min_bytes, hot_runs, scratch))  # HOT_SHARE numbers at most
        sent = texts.mapInArrow(_deal_runs(min_bytes, n, hot), "bucket int, runs binary, done binary")
        found = scratch.written(sent.repartitionById(n, "bucket").mapInArrow(_settle_runs(hot), SPANS), "runs")
        opened = found.where("open").groupBy("doc_key").agg(F.collect_list(F.struct("pos", "windows", "route", "hot")).alias("runs"))
        windows = (
            texts.join(opened, "doc_key")
            .mapInArrow(_open_runs(min_bytes, n), "bucket int, bytes binary, runs binary, done binary")
            .repartitionById(n, "bucket")
            .mapInArrow(_index_windows(min_bytes), SPANS)
        )
        spans = found.where("not open").unionByName(windows).groupBy("doc_key").agg(F.collect_list(F.struct("pos", "windows")).alias("spans"))
        return written(spans, "spans")


def removed_ranges(spans: list | None, n_bytes: int, size: int) -> np.ndarray:
    """Sorted ranges (start, end) that do not touch; what a span covers beyond the text is cut off."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    x = np.array([(s["pos"], s["windows"]) for s in spans], np.int64)
    lo, hi = x[:, 0], np.minimum(x[:, 0] + x[:, 1] + size - 1, n_bytes)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    out = np.stack([lo[first], hi[np.append(first[1:], len(lo)) - 1]], 1)
    return out[out[:, 1] > out[:, 0]]


def _digest(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            rows = []
            for text, own in zip(texts, spans, strict=True):
                raw = (text or "").encode()
                gone = removed_ranges(own, len(raw), size)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                rows.append((len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(left).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in gone]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([batch.column("doc_key"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def within_characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The range without the characters that it cuts."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


REMOVED = "removed array<struct<start:bigint,end:bigint>>"


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100, **more) -> DataFrame:
    """Per document, to the byte: doc_key, n_bytes, n_removed, n_spans, kept_sha256, removed ranges."""
    texts = docs.select(id_key(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    return texts.join(repeat_spans(texts, min_bytes, **more), "doc_key", "left").mapInArrow(_digest(min_bytes), f"doc_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {REMOVED}")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100, **more) -> DataFrame:
    """``docs`` with the repeats cut out of the text, at whole characters; all columns and rows stay.

    The text of a document is replaced; a null text stays null.
    """
    row = own_keys(docs, id_col, text_col)
    cut = row.join(repeat_spans(row.select("doc_key", "text"), min_bytes, **more), "doc_key", "left")
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(_cut_text(min_bytes)(F.col("text"), F.col("spans")))
    out = cut.select("row", kept.alias("kept"))
    return out.select(*[(F.col("kept") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def _cut_text(size: int):
    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            raw, kept, at = t.encode(), [], 0
            for a, b in removed_ranges(list(own), len(raw), size):
                a, b = within_characters(raw, int(a), int(b))
                kept.append(raw[at:a])
                at = max(at, b)
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    return cut
