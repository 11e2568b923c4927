"""Best-fit packing of pieces into sequences of a fixed capacity, by exact-complement hashing.

Only the number of pieces of each length matters for the plan, so the driver sees a histogram of at most ``capacity``
counts, however many pieces there are.  ``SumIndex`` is a hash of the sums of one, two and three lengths to the combinations
that make them, with the counts that are still available.  ``plan`` takes the longest length that is left, looks its gap
up in the index, and uses the combination as often as the counts allow; what has no exact complement is packed best-fit,
longest first.  Pieces then find their place by their rank among the pieces of
their length: a rank is a count within a salt plus the counts of the salts before, so no length is ever in one task,
and pieces that fill a sequence alone need none.

Defined cases: an empty table has no sequences; pieces longer than the capacity or shorter than one token are an error;
repeated rows are pieces of their own.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointset.llm.common import partitions


class SumIndex:
    """Combinations of available lengths by their sum: singles are the counts themselves, pairs are listed by sum, the longer length first, and a triple is a longest length and a sum of pairs.

    Counts only fall, so a combination that they no longer allow is taken out of the index when it is met.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        top = len(left) - 1
        have = np.flatnonzero(left).astype(np.int16 if top < 1 << 15 else np.int64)
        have = have[have > 0]
        #: sum -> the longer lengths of its pairs, longest first; and the shortest of them
        self.pairs: dict[int, np.ndarray] = {}
        least = np.full(top + 1, top + 1)
        for s in range(2, top + 1):
            longer = have[(2 * have.astype(np.int64) >= s) & (have < s)]
            longer = longer[left[s - longer] > 0][::-1]
            if len(longer):
                self.pairs[s], least[s] = longer, longer[-1]
        #: sum -> the longest lengths of its triples, longest first
        self.triples: dict[int, np.ndarray] = {}
        for s in range(3, top + 1):
            first = have[have < s - 1]
            first = first[least[s - first] <= first][::-1]
            if len(first):
                self.triples[s] = first

    def pair(self, total: int, longest: int, beside: int = 0) -> tuple[int, int] | None:
        """The pair with this sum whose longer length is the longest up to ``longest``, available beside another length."""
        found = self.pairs.get(total)
        if found is None:
            return None
        other = total - found
        free = (self.left[found] > 0) & (self.left[other] > (found == other))
        if not free.all():
            found = self.pairs[total] = found[free]
            other = other[free]
        used = (found == beside).astype(np.int64) + (other == beside)
        fits = (found <= longest) & ((used == 0) | (self.left[beside] > used))
        return (int(found[k := int(fits.argmax())]), total - int(found[k])) if fits.any() else None

    def find(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to ``gap``, the longest first."""
        if self.left[gap]:
            return (gap,)
        two = self.pair(gap, gap)
        if two:
            return two
        first = self.triples.get(gap)
        while first is not None and len(first):
            a = int(first[0])
            rest = self.pair(gap - a, a, a) if self.left[a] else None
            if rest:
                return (a, *rest)
            first = self.triples[gap] = first[1:]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that hold every piece of a histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left[length] += n
    index = SumIndex(left)
    out: dict[tuple[int, ...], int] = {}
    residual = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        while left[length]:
            gap, left[length] = capacity - length, left[length] - 1
            found = () if gap == 0 else index.find(gap)
            left[length] += 1
            if found is None:
                residual[length], left[length] = left[length], 0
                break
            whole = (length, *found)
            times = min(int(left[x]) // whole.count(x) for x in whole)
            for x in whole:
                left[x] -= times
            out[whole] = out.get(whole, 0) + times
    # best fit, longest first: open sequences are grouped by what they hold
    gaps: list[int] = []
    open_: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(residual[length])
        while n:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                per = capacity // length
                for holds, times in ((per, n // per), (n % per, 1)):
                    if holds and times:
                        _open(gaps, open_, capacity - holds * length, [(length,) * holds, times])
                break
            gap = gaps[k]
            group = open_[gap][-1]
            per = min(gap // length, n)
            times = min(group[1], n // per)
            _open(gaps, open_, gap - per * length, [group[0] + (length,) * per, times])
            group[1] -= times
            n -= per * times
            if not group[1]:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.remove(gap)
    for groups in open_.values():
        for lengths, times in groups:
            out[lengths] = out.get(lengths, 0) + times
    return sorted(out.items(), reverse=True)


def _open(gaps: list[int], open_: dict[int, list[list]], gap: int, group: list) -> None:
    if gap not in open_:
        open_[gap] = []
        bisect.insort(gaps, gap)
    open_[gap].append(group)


def places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, copies in a sequence, first sequence, offset of the first copy)."""
    out, used, sequence = [], {}, 0
    for lengths, times in planned:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            copies = lengths.count(x)
            out.append((x, used.get(x, 0), used.get(x, 0) + copies * times, copies, sequence, offset))
            used[x] = used.get(x, 0) + copies * times
            offset += copies * x
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_key", "piece", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` (with a column length) plus sequence_id and offset.

    Reads ``pieces`` twice, so give a table that is written.  ``order`` names the columns that tell pieces apart.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    planned = plan({k: v for k, v in counts.items() if k != capacity}, capacity)
    slots = places(planned)
    if len(slots) > 64 * capacity:
        raise ValueError("the plan is too large to broadcast")
    total = sum(times for _, times in planned)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(total) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    salts = partitions(spark)
    rest = pieces.where(F.col("length") != capacity).withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = rest.groupBy("length", "salt").count()
    before = before.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    table = spark.createDataFrame(slots, "length long, lo long, hi long, copies long, sequence long, place long")
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(table["length"])
    nth = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("copies"))).withColumn("offset", F.col("place") + F.pmod(nth, F.col("copies")) * F.col("length"))
    return full.unionByName(placed.select(*full.columns))
