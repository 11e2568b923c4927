"""Token counts and token ids of whole texts, with the whole-token shortcut.

``prove_whole_tokens`` finds offline which vocabulary entries are what the library makes of their own string: those
pre-tokens are one token, with no merging.  Every other pre-token goes to the library's merges.  Both are kept per
white-space chunk in a bounded memory of each Python worker: no pre-token of the tokenizers meant here (pre-tokens never
contain white space, white space is dropped) spans two chunks, so a chunk's ids do not depend on its neighbours.

Defined cases: null is the empty text, which has no tokens; special strings inside a text are what the library makes of
them by default; nothing is cut or padded.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointset.llm.common import id_key, small_batches

#: What ``str.split`` takes for white space and the tokenizers' \\s does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Chunks of a generation that a worker remembers, and the characters of the longest; longer ones hardly come again.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 64
#: Letters below this are one code point each under NFC, and their lower case is the same everywhere.
LATIN_END = "\u0130"
#: Marks that may end a chunk; an apostrophe may belong to the letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_level() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + k) for k, b in enumerate(other)}


BYTE_LEVEL = byte_level()


def pack(ids: list[int]) -> bytes:
    return FORMATS[len(ids)].pack(*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


FORMATS = [struct.Struct(f"<{n}I") for n in range(32)]


def word_end(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"].get("end_of_word_suffix") or ""


def check_white_space(path: str) -> None:
    """Chunks are independent only where white space is dropped and ends a pre-token."""
    tokenizer = Tokenizer.from_file(path)
    for space in " \t\n\r\x0b\x0c\x85\xa0 　":
        alone = [tokenizer.encode(x, add_special_tokens=False).ids for x in ("ab", "c,")]
        if tokenizer.encode(f"{space}ab{space}{space}c,{space}", add_special_tokens=False).ids != alone[0] + alone[1]:
            raise ValueError(f"{path} does not drop white space; its chunks depend on each other")


def prove_whole_tokens(path: str) -> dict[str, int]:
    """Pre-tokens, as the model gets them, that the library encodes as one token."""
    tokenizer, end = Tokenizer.from_file(path), word_end(path)
    found = {}
    for piece, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if piece.endswith(end) and len(piece) > len(end):
            own = piece[: len(piece) - len(end)]
            merged = tokenizer.model.tokenize(own)
            if len(merged) == 1 and merged[0].id == i:
                found[own] = i
    return found


class Chunks(dict):
    """chunk -> its ids as little-endian unsigned 32-bit numbers.

    A full memory becomes the older of two generations; what is met there again goes into the new one, so frequent chunks stay.
    """

    def __init__(self, path: str, whole: dict[str, int]):
        super().__init__()
        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.model, self.normal, self.pre = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[str, bytes] = {}
        #: marks -> their ids, or None where letters before them change what the library makes of them
        self.tails: dict[str, bytes | None] = {}
        self.marks = "" if any(not (head := x.rstrip(MARKS)) or head.isalpha() for x in self.special) else MARKS

    def __missing__(self, chunk: str) -> bytes:
        packed = self.older.get(chunk)
        if packed is None:
            packed = self.made(chunk)
        if len(chunk) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = packed
        return packed

    def made(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii() or max(chunk) < LATIN_END:
                low = chunk.lower()
                return self.one(low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LEVEL))
        elif (head := chunk.rstrip(self.marks)).isalpha() and (head.isascii() or max(head) < LATIN_END):
            tail = self.tail(chunk[len(head) :])
            if tail is not None:
                return self[head] + tail  # letters that NFC keeps, then marks
        if any(x in chunk for x in self.special):
            return pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        return b"".join(map(self.one, self.pieces(chunk)))

    def pieces(self, text: str) -> list[str]:
        return [piece for piece, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(text) if self.normal else text)]

    def tail(self, marks: str) -> bytes | None:
        """The ids of marks behind letters, if the library parts them there."""
        if marks in self.tails:
            return self.tails[marks]
        own = self.pieces(marks)
        packed = b"".join(map(self.one, own)) if self.pieces("ab" + marks) == ["ab", *own] else None
        if len(marks) <= REMEMBERED_LENGTH and len(self.tails) < REMEMBERED:
            self.tails[marks] = packed
        return packed

    def one(self, piece: str) -> bytes:
        """A pre-token's ids: the proven ones directly, the rest by the library's merges."""
        whole = self.whole.get(piece)
        return pack([whole] if whole is not None else [t.id for t in self.model.tokenize(piece)])

    def ids(self, text: str) -> bytes:
        chunks = text.split() if not NOT_SPACE.search(text) else [x for x in SPACE.split(text) if x]
        return b"".join(map(self.__getitem__, chunks))


_WORKER: dict[str, Chunks] = {}


def of_worker(path: str, whole: Broadcast) -> Chunks:
    if path not in _WORKER:
        _WORKER[path] = Chunks(path, whole.value)
    return _WORKER[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: doc_key, n_bytes, n_tokens, over_limit.  ``path``: a tokenizers file that the executors have too."""
    small_batches(docs.sparkSession)
    check_white_space(path)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))  # no more than the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = of_worker(path, whole)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = [len(chunks.ids(x)) // 4 for x in texts]
            yield pa.record_batch([batch.column("doc_key"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(id_key(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_key long, n_bytes long, n_tokens long, over_limit boolean")


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Each document's ids and then ``end_id``, cut into pieces of ``capacity`` (the last may be shorter): doc_key, piece, start, length, ids_crc32 and, if asked for, ids."""
    small_batches(docs.sparkSession)
    check_white_space(path)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))
    kinds = [("doc_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end = of_worker(path, whole), struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = chunks.ids(text or "") + end
                for k in range(0, len(raw), 4 * capacity):
                    piece = raw[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), *([memoryview(piece).cast("I").tolist()] if with_ids else [])))
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for _, t in kinds], names=[k for k, _ in kinds])

    rows = docs.select(id_key(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_key long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
