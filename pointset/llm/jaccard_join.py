"""Exact self-join of documents on the Jaccard similarity of word shingles, by signature trees.

Two documents link when ``similar[1] * |A and B| >= similar[0] * |A or B|`` for their sets of distinct shingles.  The
result is one row per document with the smallest id that it reaches over links.

How it runs on Spark
--------------------
1. *Routing.*  Sets of a size class are cut into k parts by hash.  A linked pair differs in at most
   H = 2U(q-p)/(q+p) shingles (U: the class's largest size, p/q the similarity), so with k > H parts at least k - H parts
   are equal.  A document sends the fingerprint of each part, and of its parts in the next class if a partner can be
   there; empty parts only if it has k - H of them.  Of parts that a pair shares at least, all but one are spared: in one
   order of all parts, by size, each document leaves out so many of its smallest.  Equal part fingerprints make candidate links to the smallest id of
   their group: a star, never all pairs.  Within a map batch equal sets and equal parts collapse first, so of copies a bucket
   sees one for each batch, and of empty sets none.
2. *Blocks.*  Candidate links whose bitmaps rule the similarity out go; components of the others are blocks.  A
   block's sets are gathered in chunks of bounded size, each with the block's first document.
3. *Signature trees.*  A chunk's documents become a tree: nodes hold the OR of their token bitmaps, their size range, and
   how many tokens may share a bit.  A dual traversal of the tree with itself prunes a pair of nodes by size range, by
   the largest possible overlap, and when both are known to lie in one component.  What remains at the leaves is
   verified on the sets.
4. Blocks of several chunks that are not one component yet: the documents outside the largest component meet all chunks
   of the block, tree against tree.
5. Groups of an equal part that still hold several components (a passage that many documents share can make a part): the
   same dual traversal, on bitmaps only, marks the documents of a group that it cannot rule out, never their pairs; these
   alone meet again, with their sets.  Like documents share
   most of their groups: a document carries the group that each of a few orders of all groups puts first among its own,
   and a pair that has the same group in one of them is looked at in that group alone.
   So every pair with an equal part is verified, proved too far apart by a bound, or already connected; no link that
   changes a component is lost, whatever the sizes.

Shingles are compared by 64-bit fingerprints, equal sets by 128-bit fingerprints.

Defined cases: null and empty texts and texts without words have no shingles, link with nothing and are their own
component; fewer words than a shingle has make one shingle of the whole sequence; equal texts link (similarity 1).  In
``link_components`` rows that repeat an id are one document in the links and keep a row each, and null ids are one id below
all others; ``keep_one`` tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointset.llm.common import Prefix, Scratch, id_key, mixed, own_keys, partitions, small_batches, split_by, text_bytes
from pointset.llm.components import components

SPLIT = np.zeros(256, bool)
SPLIT[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BASE = 0x9FB21C651E98DF25
FAN = 8
#: A chunk of a block holds so many shingles and documents at most, on average.
CHUNK_SHINGLES, CHUNK_DOCS = 1 << 21, 2000
#: Orders of groups in which a pair looks for one group to be named by.
ORDERS = 4


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and where each text's words begin."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    gap = SPLIT[low]
    before, after = np.ones(len(low), bool), np.ones(len(low), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(low))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return Prefix(low, WORD_BASE).of(starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, at = word_hashes(data, offsets)
    roll = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(roll)]
    roll = mixed(roll)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(roll[a : b - words + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                short = mixed(short * np.uint64(0xC2B2AE3D27D4EB4F) + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Routing:
    """Size classes and the part fingerprints of a set."""

    def __init__(self, similar: tuple[int, int]):
        self.p, self.q = similar
        if not 0 < self.p <= self.q:
            raise ValueError("similar must be a fraction (p, q) with 0 < p <= q")
        self.tops = [1]

    def size_class(self, n: int) -> int:
        while self.tops[-1] < n:
            top = self.tops[-1]
            self.tops.append(max(top + 1, top * self.q // self.p, int(top * 1.35)))
        return int(np.searchsorted(self.tops, n))

    def parts(self, c: int) -> tuple[int, int]:
        """The number of parts of a class, and how many of them a linked pair has equal at least."""
        differ = 2 * self.tops[c] * (self.q - self.p) // (self.q + self.p)
        k = differ + 1 + differ // 8
        return k, k - differ

    def keys(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        n = len(shingles)
        own = self.size_class(n)
        classes = [own]
        if n * self.q // self.p > self.tops[own]:
            self.size_class(self.tops[own] + 1)
            classes.append(own + 1)
        out = []
        for c in classes:
            k, equal = self.parts(c)
            part = ((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            first = np.ones(n, bool)
            first[1:] = part[1:] != part[:-1]
            first = np.flatnonzero(first)
            salt = np.uint64(c) << np.uint64(40)
            named = mixed(np.add.reduceat(weights, first) + mixed(part[first] + salt))
            spare = equal - (k - len(first)) - 1
            if spare > 0:  # the prefix filter: of what a pair shares at least, all but one may go, the smallest parts first
                named = named[np.lexsort((named, -np.diff(np.append(first, n))))][: len(named) - spare]
            out.append(named)
            if k - len(first) >= equal:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), part[first])
                out.append(mixed(mixed(empty + salt) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        return np.concatenate(out)


IDENTITY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("n", "<i8")])
KEY = np.dtype([("key", "<u8"), ("doc", "<i8")])
COPY = np.dtype([("doc", "<i8"), ("centre", "<i8"), ("n", "<i8")])


def _pack(x: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)


def _unpack(raws: list[bytes], dtype: np.dtype) -> np.ndarray:
    parts = []
    for raw in raws:
        n, at = len(raw) // dtype.itemsize, 0
        out = np.empty(n, dtype)
        for f in dtype.names:
            out[f] = np.frombuffer(raw, dtype[f], n, at)
            at += n * dtype[f].itemsize
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def stars(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest id of each key; the distinct links (id, smallest id) of the other ids; the rows of keys that come more than once.  Rows that repeat count once."""
    keys = keys[np.lexsort((keys["doc"], keys["key"]))]
    if len(keys):
        keys = keys[np.append(True, (keys["key"][1:] != keys["key"][:-1]) | (keys["doc"][1:] != keys["doc"][:-1]))]
    first = np.ones(len(keys), bool)
    first[1:] = keys["key"][1:] != keys["key"][:-1]
    group = np.cumsum(first) - 1
    centre = keys["doc"][np.flatnonzero(first)][group] if len(keys) else keys["doc"]
    links = np.stack([keys["doc"][~first], centre[~first]], 1)
    shared = keys[np.bincount(group)[group] > 1] if len(keys) else keys
    return keys[first], np.unique(links[links[:, 0] != links[:, 1]], axis=0), shared


def without_copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each set of a batch; and the others with that id, and empty sets with their own."""
    x = x[np.lexsort((x["doc"], x["b"], x["a"]))]
    first = np.ones(len(x), bool)
    first[1:] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])
    first |= x["n"] == 0
    centre = x["doc"][np.flatnonzero(first)][np.cumsum(first) - 1] if len(x) else x["doc"]
    sent = first & (x["n"] > 0)
    copies = np.empty(int((~sent).sum()), COPY)
    copies["doc"], copies["centre"], copies["n"] = x["doc"][~sent], centre[~sent], x["n"][~sent]
    return x[sent], copies


def _route(words: int, similar: tuple[int, int], buckets: int, docs: int = 2000, shingles: int = 1 << 19):
    schema = pa.schema([("bucket", pa.int32()), ("sets", pa.binary()), ("copies", pa.binary()), ("keys", pa.binary()), ("shared", pa.binary())])

    def send(found: list[tuple[int, np.ndarray]], routing: Routing) -> pa.RecordBatch:
        identity, keys, seen = np.empty(len(found), IDENTITY), [], {}
        for i, (doc, s) in enumerate(found):
            w = mixed(s ^ np.uint64(0x27D4EB2F165667C5))
            identity[i] = (w.sum(), mixed(w).sum(), doc, len(s))
            if len(s):
                known = (int(identity[i]["a"]), int(identity[i]["b"]))
                if known not in seen or doc < seen[known][0]:
                    seen[known] = (doc, s, w)
        for doc, s, w in seen.values():
            k = routing.keys(s, w)
            keys.append(np.empty(len(k), KEY))
            keys[-1]["key"], keys[-1]["doc"] = k, doc
        centres, _, shared = stars(np.concatenate(keys) if keys else np.zeros(0, KEY))
        identity, copies = without_copies(identity)
        by_set, set_cuts = split_by((identity["a"] >> np.uint64(20)) % np.uint64(buckets), buckets)
        by_key, key_cuts = split_by((centres["key"] >> np.uint64(20)) % np.uint64(buckets), buckets)
        identity, centres, shares = identity[by_set], centres[by_key], [shared[(shared["key"] >> np.uint64(20)) % np.uint64(buckets) == b] for b in range(buckets)]
        return pa.record_batch([pa.array(np.arange(buckets, dtype=np.int32)), pa.array([_pack(identity[set_cuts[b] : set_cuts[b + 1]]) for b in range(buckets)], pa.binary()), pa.array([_pack(x) for x in np.array_split(copies, buckets)], pa.binary()), pa.array([_pack(centres[key_cuts[b] : key_cuts[b + 1]]) for b in range(buckets)], pa.binary()), pa.array([_pack(x) for x in shares], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routing, found, held = Routing(similar), [], 0
        for batch in batches:
            ids = batch.column("doc_key").to_pylist()
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets):
                for doc, s in zip(ids[lo:hi], shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words), strict=True):
                    found.append((doc, s))
                    held += len(s)
                    if held >= shingles or len(found) >= docs:
                        yield send(found, routing)
                        found, held = [], 0
        if found:
            yield send(found, routing)

    return run


def slices(offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


ROUTED = "kind int, u long, v long, n long"


def _routed(kind: int, u: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "u", "v", "n"])


#: A bucket's keys meet in so many pieces, one after the other.
PIECES = 8


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document of each set of a batch, the smallest id with the same set, and the set's size; kind 3: the batch's other documents and that document; kind 1: candidate links; kind 2: parts (u) and the documents that share them (v)."""
    sets, pieces = [], [[] for _ in range(PIECES)]
    for batch in batches:
        copies = _unpack(batch.column("copies").to_pylist(), COPY)
        yield _routed(3, copies["doc"], copies["centre"], copies["n"])
        sets.append(_unpack(batch.column("sets").to_pylist(), IDENTITY))
        for column in ("keys", "shared"):
            keys = _unpack(batch.column(column).to_pylist(), KEY)
            order, cuts = split_by((keys["key"] >> np.uint64(52)) % np.uint64(PIECES), PIECES)
            for k, piece in enumerate(pieces):
                piece.append(keys[order[cuts[k] : cuts[k + 1]]])
    if not sets:
        return
    x = np.concatenate(sets)
    del sets
    x = x[np.lexsort((x["doc"], x["b"], x["a"]))]
    first = np.ones(len(x), bool)
    first[1:] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])
    yield _routed(0, x["doc"], x["doc"][np.flatnonzero(first)][np.cumsum(first) - 1] if len(x) else x["doc"], x["n"])
    del x
    found, known = [], np.zeros(0, np.uint64)
    while pieces:
        _, links, members = stars(np.concatenate(pieces.pop()))
        found.append(links)
        name, doc = named_groups(members)
        new = ~np.isin(name, known)
        known = np.union1d(known, name)
        yield _routed(2, name[new].view(np.int64), doc[new], np.zeros(int(new.sum())))
    links = np.unique(np.concatenate(found), axis=0)
    yield _routed(1, links[:, 0], links[:, 1], np.zeros(len(links)))


def named_groups(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of documents under a name that their ids give, so that parts shared by the same documents are one group.

    Two groups that got one name by chance would be joined as one: more pairs to rule out, none lost.
    """
    if not len(members):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.ones(len(members), bool)
    first[1:] = members["key"][1:] != members["key"][:-1]
    at = np.flatnonzero(first)
    name = np.add.reduceat(mixed(members["doc"].astype(np.int64).view(np.uint64)), at)
    _, once = np.unique(name, return_index=True)
    keep = np.zeros(len(at), bool)
    keep[once] = True
    group = np.cumsum(first) - 1
    return name[group][keep[group]], members["doc"][keep[group]].astype(np.int64)


class Forest:
    """Union-find over the documents of a group; ``labels`` are roots, all paths flat after ``flatten``."""

    def __init__(self, labels: np.ndarray):
        self.parent = labels

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def flatten(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def bits_for(n: int) -> int:
    return 2 << max(5, (max(1, n) - 1).bit_length())


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, np.uint64)
    at = shingles & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def narrowed(b: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at fewer bits: the low bits of a token still name its place."""
    return np.bitwise_or.reduce(b.reshape(-1, words), axis=0)


def needed(n, m, similar: tuple[int, int]):
    """The least overlap of linked sets of n and m shingles."""
    p, q = similar
    return (p * (n + m) + p + q - 1) // (p + q)


class SignatureTree:
    """Level 0 are the documents, in an order that puts like sets together; each further level joins FAN nodes."""

    def __init__(self, members: np.ndarray, maps: list[np.ndarray], sizes: np.ndarray, words: int):
        rows = {i: narrowed(maps[i], words) for i in members.tolist()}
        order = sorted(rows, key=lambda i: (rows[i][: min(4, words)].tolist(), int(sizes[i])))
        self.members = np.array(order, np.int64)
        level, size = np.stack([rows[i] for i in order]), sizes[self.members]
        self.maps, self.least, self.most = [level], [size], [size]
        self.shared = [size - np.bitwise_count(level).sum(1, dtype=np.int64)]
        while len(self.maps[-1]) > 1:
            cut = np.arange(0, len(self.maps[-1]), FAN)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], cut, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], cut))
            self.most.append(np.maximum.reduceat(self.most[-1], cut))
            self.shared.append(np.maximum.reduceat(self.shared[-1], cut))

    def components(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level the component of a node whose documents are all in one, else -1."""
        out = [labels[self.members]]
        for _ in self.maps[1:]:
            cut = np.arange(0, len(out[-1]), FAN)
            lo, hi = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
            out.append(np.where(lo == hi, lo, -1))
        return out


def dual_traversal(one: SignatureTree, two: SignatureTree, forest: Forest, similar: tuple[int, int], linked: Callable[[int, int], bool], at_once: int = 1 << 20) -> None:
    """Calls ``linked`` for pairs of documents of two trees (or of one with itself) that no bound rules out and that are not connected yet; connects them where it says so."""
    p, q = similar
    same = one is two
    at_once = max(64, min(1 << 13, at_once // one.maps[0].shape[1]))  # pairs of nodes; the limit is in words of their bitmaps
    stack = [(len(one.maps) - 1, len(two.maps) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    labels = forest.flatten()
    comps = (one.components(labels), two.components(labels))
    while stack:
        la, lb, a, b = stack.pop()
        least_a, least_b = one.least[la][a], two.least[lb][b]
        can = (one.most[la][a] * q >= least_b * p) & (two.most[lb][b] * q >= least_a * p)
        can &= (comps[0][la][a] != comps[1][lb][b]) | (comps[0][la][a] < 0)
        a, b, need = a[can], b[can], needed(least_a[can], least_b[can], similar)
        overlap = np.bitwise_count(one.maps[la][a] & two.maps[lb][b]).sum(1, dtype=np.int64) + np.minimum(one.shared[la][a], two.shared[lb][b])
        can = overlap >= need
        a, b = a[can], b[can]
        if same and la == lb == 0:
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        if la == lb == 0:
            changed = False
            for i, j in zip(one.members[a].tolist(), two.members[b].tolist(), strict=True):
                r, s = forest.find(i), forest.find(j)
                if r != s and linked(i, j):
                    forest.parent[max(r, s)] = min(r, s)
                    changed = True
            if changed:
                labels = forest.flatten()
                comps = (one.components(labels), two.components(labels))
            continue
        na, nb = (len(one.maps[la - 1]) if la else 0), (len(two.maps[lb - 1]) if lb else 0)
        ka = a[:, None] * FAN + np.arange(FAN) if la else a[:, None]
        kb = b[:, None] * FAN + np.arange(FAN) if lb else b[:, None]
        ca = np.repeat(ka, kb.shape[1], axis=1).ravel()
        cb = np.tile(kb, (1, ka.shape[1])).ravel()
        real = np.ones(len(ca), bool)
        if la:
            real &= ca < na
        if lb:
            real &= cb < nb
        la, lb = max(la - 1, 0), max(lb - 1, 0)
        if same:
            real &= (ca < cb) if la == 0 else (ca <= cb)
        ca, cb = ca[real], cb[real]
        for k in range(0, len(ca), at_once):
            stack.append((la, lb, ca[k : k + at_once], cb[k : k + at_once]))


def similar_sets(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common * similar[1] >= similar[0] * (len(x) + len(y) - common)


def named_here(one: list[int], two: list[int], block: int) -> bool:
    """Whether this block looks at a pair, from the first blocks of either document: the first that is the same does, and every block if none is."""
    return next((x == block for x, y in zip(one, two, strict=True) if x == y), True)


def join_group(doc: np.ndarray, side: np.ndarray, comp: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], sets: list[np.ndarray] | None, similar: tuple[int, int], firsts: list[list[int]] | None = None, block: int = 0) -> np.ndarray:
    """With sets: rows (u, v) of components of the group's documents that are linked.  Without: the places of the documents of which the bitmaps do not rule out some pair.  With firsts: of the pairs that ``block`` looks at."""
    _, labels = np.unique(comp, return_inverse=True)
    first = np.full(labels.max() + 1, len(comp), np.int64)
    np.minimum.at(first, labels, np.arange(len(comp)))
    forest, open_ = Forest(first[labels]), bytearray(len(comp))
    words = min(len(m) for m in maps)

    def linked(i: int, j: int) -> bool:
        if sets is None and open_[i] and open_[j]:
            return False
        if firsts is not None and not named_here(firsts[i], firsts[j], block):
            return False
        if sets is not None:
            return similar_sets(sets[i], sets[j], similar)
        open_[i] = open_[j] = 1
        return False

    left = SignatureTree(np.flatnonzero(side == 0), maps, sizes, words)
    right = left if (side == 0).all() else SignatureTree(np.flatnonzero(side == 1), maps, sizes, words)
    dual_traversal(left, right, forest, similar, linked)
    if sets is None:
        return np.flatnonzero(np.frombuffer(open_, bool))
    links = np.stack([comp, comp[forest.flatten()]], 1)
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def _tree_join(similar: tuple[int, int], *more: str):
    """Rows sorted by (block, a, b) -> links (u, v), or without shingles the rows that it leaves open (block, doc_key, comp, n, firsts).  b = -1: a group joined with itself; else its side 0 with its side 1.  ``more``: shingles, firsts."""
    names = ("doc_key", "side", "comp", "n", "map", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if now is not None and (now[2] == -1 or len({r[1] for r in held}) == 2):
                column = dict(zip(names, zip(*held, strict=True), strict=True))
                doc, side, comp, size = (np.array(column[c], np.int64) for c in names[:4])
                sets = [np.frombuffer(x, np.uint64) for x in column["shingles"]] if "shingles" in more else None
                found = join_group(doc, side, comp, size, [np.frombuffer(x, np.uint64) for x in column["map"]], sets, similar, column.get("firsts"), now[0])
                if sets is None:
                    yield pa.record_batch([pa.array(np.full(len(found), now[0])), *[pa.array(x[found]) for x in (doc, comp, size)], pa.array([column["firsts"][i] for i in found], pa.list_(pa.int64()))], names=["block", "doc_key", "comp", "n", "firsts"])
                else:
                    yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        for batch in batches:
            for block, a, b, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "a", "b", *names)), strict=True):
                if (block, a, b) != now:
                    yield from close()
                    held, now = [], (block, a, b)
                held.append(row)
        yield from close()

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets):
                found = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                yield pa.record_batch([batch.column("doc_key").slice(lo, hi - lo), pa.array([len(s) for s in found], pa.int64()), pa.array([bitmap(s, bits_for(len(s))).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_key", "n", "map", "shingles"])

    return run


def _possible(similar: tuple[int, int]):
    """Pairs (u, v, and what both hold) that the bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, *n in zip(*(batch.column(c).to_pylist() for c in ("u_map", "v_map", "u_n", "v_n")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                x, y = narrowed(x, words), narrowed(y, words)
                shared = min(n[0] - int(np.bitwise_count(x).sum()), n[1] - int(np.bitwise_count(y).sum()))
                keep.append(int(np.bitwise_count(x & y).sum()) + shared >= needed(*n, similar))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _both_ends(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for end in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("doc_key").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return pairs


def _tasks(rows: DataFrame, most: int, shingles: int, what: list[str]) -> DataFrame:
    """Rows (block, doc_key, comp, n, ...) as groups to join: a block of at most ``most`` documents and ``shingles`` shingles with itself; of a larger one the documents outside the largest component, in chunks, with the whole block, in chunks."""
    counts = rows.groupBy("block", "comp").agg(F.greatest(F.count("*") / most, F.sum("n") / shingles).alias("c"))
    block = counts.groupBy("block").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.max("c").alias("c"), F.sum("c").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    block = block.select("block", "largest", F.greatest(F.ceil(F.col("all") - F.col("c")), F.lit(1)).cast("int").alias("queries"), F.ceil("all").cast("int").alias("targets"))
    own = rows.join(block, "block")
    whole = own.where("targets = 1").select("block", F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("side"), *what)
    hashed = F.xxhash64("doc_key")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    query = own.where("targets > 1 and comp != largest").select("block", F.pmod(hashed, "queries").cast("int").alias("a"), to("targets").alias("b"), F.lit(0).alias("side"), *what)
    target = own.where("targets > 1").select("block", to("queries").alias("a"), F.pmod(hashed, "targets").cast("int").alias("b"), F.lit(1).alias("side"), *what)
    return whole.unionByName(query).unionByName(target)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similar: tuple[int, int] = (90, 100), chunk_docs: int = CHUNK_DOCS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_key, n_shingles, component (keys; see ``id_key``)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(id_key(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        return Scratch(spark).written(_linked(texts, words, similar, chunk_docs, chunk_shingles, scratch), "components")


def _linked(texts: DataFrame, words: int, similar: tuple[int, int], chunk_docs: int, chunk_shingles: int, scratch: Scratch) -> DataFrame:
    n = partitions(scratch.spark)
    routed = scratch.written(texts.mapInArrow(_route(words, similar, n), "bucket int, sets binary, copies binary, keys binary, shared binary").repartitionById(n, "bucket").mapInArrow(_meet, ROUTED), "routed")
    own = routed.where("kind = 0").select(F.col("u").alias("doc_key"), F.col("v").alias("rep"), F.col("n").alias("n_shingles"))
    copies = routed.where("kind = 3").join(own.groupBy(F.col("doc_key").alias("v")).agg(F.min("rep").alias("rep")), "v", "left").select(F.col("u").alias("doc_key"), F.coalesce("rep", "v").alias("rep"), F.col("n").alias("n_shingles"))
    rows = scratch.written(own.unionByName(copies), "rows")
    reps = rows.groupBy("doc_key").agg(F.min("rep").alias("rep"))
    rep_of = rows.where("rep != doc_key").groupBy("doc_key").agg(F.min("rep").alias("rep"))

    def of_reps(df: DataFrame, *ends: str) -> DataFrame:
        for end in ends:
            df = df.join(rep_of.withColumnRenamed("doc_key", end), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
        return df.distinct()

    candidates = scratch.written(of_reps(routed.where("kind = 1").select("u", "v").distinct(), "u", "v").where("u != v"), "candidates")
    wanted = candidates.select(F.explode(F.array("u", "v")).alias("doc_key")).distinct()  # grows with the documents: never broadcast
    sets = scratch.written(texts.join(wanted.hint("merge"), "doc_key").mapInArrow(_sets(words), "doc_key long, n long, map binary, shingles binary").where("n > 0"), "sets")
    possible = _both_ends(candidates, sets, "map", "n").mapInArrow(_possible(similar), "u long, v long")
    block_of = components(possible, scratch).toDF("doc_key", "block")
    blocked = sets.join(block_of, "doc_key")
    # first each chunk of a block, and with it the block's first document
    chunks = scratch.written(block_of.join(sets.select("doc_key", "n"), "doc_key").groupBy("block").agg(F.ceil(F.greatest(F.count("*") / chunk_docs, F.sum("n") / chunk_shingles)).cast("int").alias("chunks")), "chunks")
    chunk = F.pmod(F.xxhash64("doc_key"), F.col("chunks")).cast("int")
    every = F.when(F.col("doc_key") == F.col("block"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    what = ["doc_key", "comp", "n", "map"]
    alone = blocked.join(chunks, "block").select("block", F.explode(every).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("side"), "doc_key", F.col("doc_key").alias("comp"), "n", "map", "shingles")
    tree = "u long, v long"
    links = scratch.written(_grouped(alone, n).mapInArrow(_tree_join(similar, "shingles"), tree), "chunk-links")
    # then what chunks have not connected in large blocks
    large = chunks.where("chunks > 1").select("block")
    if not large.isEmpty():
        rest = blocked.join(large, "block").join(components(links, scratch).toDF("doc_key", "comp"), "doc_key", "left").withColumn("comp", F.coalesce("comp", "doc_key"))
        links = scratch.written(links.unionByName(_grouped(_tasks(rest, chunk_docs, chunk_shingles, [*what, "shingles"]), n).mapInArrow(_tree_join(similar, "shingles"), tree)), "block-links")
    # then groups of an equal part that still hold several components
    label = components(links, scratch).toDF("rep", "comp")
    comp_of = reps.join(label, "rep", "left").select(F.col("doc_key").alias("v"), "rep", F.coalesce("comp", "rep").alias("comp"))
    parts = scratch.written(routed.where("kind = 2").select(F.col("u").alias("block"), "v").join(comp_of, "v").select("block", F.col("rep").alias("doc_key"), "comp"), "parts")
    mixed_parts = parts.groupBy("block").agg((F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").select("block")
    across = scratch.written(parts.join(mixed_parts, "block").distinct(), "mixed-parts")
    firsts = across.groupBy("doc_key").agg(*[F.min_by("block", F.xxhash64("block", F.lit(i))).alias(f"first{i}") for i in range(ORDERS)])
    across = across.join(sets.select("doc_key", "n", "map"), "doc_key").join(firsts.select("doc_key", F.array(*[f"first{i}" for i in range(ORDERS)]).alias("firsts")), "doc_key")
    marked = _grouped(_tasks(across, chunk_docs, 4 * chunk_shingles, [*what, "firsts"]), n).mapInArrow(_tree_join(similar, "firsts"), "block long, doc_key long, comp long, n long, firsts array<long>")
    open_ = scratch.written(marked.distinct(), "open")
    exact = _tasks(open_, chunk_docs, chunk_shingles, ["doc_key", "comp", "n", "firsts"]).join(sets.select("doc_key", "map", "shingles").hint("merge"), "doc_key")
    found = _grouped(exact, n).mapInArrow(_tree_join(similar, "shingles", "firsts"), tree)
    # what is found across joins the components that are known
    one = components(label.toDF("u", "v").unionByName(found), scratch).toDF("rep", "component")
    one = reps.join(one, "rep", "left").select("doc_key", F.coalesce("component", "rep").alias("component"))
    return rows.select("doc_key", "n_shingles").join(one, "doc_key")


def _grouped(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "block", "a", "b").sortWithinPartitions("block", "a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similar: tuple[int, int] = (80, 100), **more) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest id stays, all of its columns with it.

    Rows of one id with unlike texts, and rows without id, are documents of their own that come after all others (see
    ``own_keys``); of rows that repeat both id and text one stays.
    """
    rows = own_keys(docs, id_col, text_col)
    found = link_components(rows, "doc_key", "text", words, similar, **more)
    keep = found.where("component = doc_key").select("doc_key").distinct()
    return rows.join(keep, "doc_key").dropDuplicates(["doc_key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
