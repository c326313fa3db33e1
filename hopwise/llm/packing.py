"""Bounded-space online packing of token sequences.

A document's tokens are its ids and an end id. Each input partition is packed where it is read, in one pass with OPEN open windows of
WINDOW tokens: what a document has beyond whole windows goes, whole, into the open window that it fills best. Where none has
room, the fullest window is emitted; a gap of at least LEAST_CUT tokens in it is first filled with the head of the document, as cutting
is free, and the rest of the document goes on. So an emitted window is short of fewer than LEAST_CUT tokens. At
the end of a partition its open windows are left over, at most OPEN * WINDOW ids.

The leftovers of all partitions are merged at last: they are laid end to end in the order of the partitions and cut at every WINDOW
tokens. Only the numbers of tokens left over, one for each partition, are added up for that. What remains at the very end
is cut into sequences whose lengths are powers of two, so it needs no padding. No text is shuffled, and a document of any
length is cut into whole windows.

Ids come from a file of a public tokenizer, which must be at the same path on all executors. A tokenizer that drops white space gives a
text the ids of its words one after another, so texts are split at spaces and line ends, and the ids of words are remembered (WORDS of up
to WORD_CHARS characters, in each task). New words of letters go to the tokenizer's model, others to the whole tokenizer.

A null text is empty: its one token is the end id. Ids of documents may be null or repeat: rows are packed one by one. Pieces of equal
documents are alike. Sequence ids are unique, not gapless: above 2**32 they name the partition and its window. Which documents meet in
a sequence depends on the partitions of the input; what each partition gives is written once, so that all later steps see the same packing.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.llm.shared import discard, small_batches, stored

WINDOW, OPEN, LEAST_CUT, END_ID = 4096, 64, 32, 2
WORDS, WORD_CHARS = 400_000, 32
# Letters whose folding and splitting is plain, and marks after them. How a tokenizer file with word ends folds and splits texts.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?]*)")
FOLDS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
Piece = tuple[int, int, int]  # document, start, length


class WordIds:
    """Ids, as bytes, of texts by a tokenizer that splits words as SPLIT says and drops white space; ids of words and of their letters are remembered."""

    def __init__(self, made, most: int = WORDS):
        from tokenizers.pre_tokenizers import ByteLevel

        self.made, self.most = made, most
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: bytewise.pre_tokenize_str(chr(c))[0][0] for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]}
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def part(self, letters: str) -> bytes:
        """Ids of letters or marks that the tokenizer does not split further."""
        ids = self.parts.get(letters)
        if ids is None:
            if len(self.parts) >= self.most:
                self.parts = {"": b""}
            ids = self.parts[letters] = array("I", [t.id for t in self.made.model.tokenize(letters.translate(self.table))]).tobytes()
        return ids

    def word(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word) if len(word) <= WORD_CHARS else None
        if plain is None:
            return array("I", self.made.encode(word, add_special_tokens=False).ids).tobytes()
        return self.part(plain[1].lower()) + self.part(plain[2])

    def __call__(self, text: str) -> bytes:
        for c in "\t\n\r":
            text = text.replace(c, " ")
        words = text.split(" ")
        found = [*map(self.known.get, words)]
        if None in found:
            new = {w: self.word(w) for w, x in zip(words, found, strict=True) if x is None}
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
            short = {w: x for w, x in new.items() if len(w) <= WORD_CHARS}
            if len(self.known) + len(short) > self.most:
                self.known = {"": b""}
            self.known |= short
        return b"".join(found)


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as unsigned 32-bit integers. Tokenizers of another kind get whole texts."""
    import json

    from tokenizers import Tokenizer

    made, text = Tokenizer.from_file(path), Path(path).read_text()
    if json.loads(text).get("normalizer") == FOLDS and json.loads(text).get("pre_tokenizer") == SPLITS:
        return WordIds(made)
    return lambda text: array("I", made.encode(text, add_special_tokens=False).ids).tobytes()


class Packer:
    """Open windows; `put` gives the windows that it emits, each a list of pieces."""

    def __init__(self, window: int = WINDOW, most: int = OPEN, least_cut: int = LEAST_CUT):
        self.window, self.most, self.least_cut = window, most, least_cut
        self.gaps: list[tuple[int, int]] = []  # (room, number) of the open windows, ascending
        self.open: dict[int, list[Piece]] = {}
        self.made = 0

    def put(self, doc: int, length: int) -> Iterator[list[Piece]]:
        whole = length // self.window
        for i in range(whole):
            yield [(doc, i * self.window, self.window)]
        start = whole * self.window
        while start < length:
            need = length - start
            at = bisect_left(self.gaps, (need, -1))
            if at < len(self.gaps):
                room, n = self.gaps.pop(at)
                self.open[n].append((doc, start, need))
                start = length
                if room == need:
                    yield self.open.pop(n)
                else:
                    insort(self.gaps, (room - need, n))
            elif len(self.gaps) < self.most:
                self.open[self.made] = []
                insort(self.gaps, (self.window, self.made))
                self.made += 1
            else:
                room, n = self.gaps.pop(0)
                if room >= self.least_cut:
                    self.open[n].append((doc, start, room))
                    start += room
                yield self.open.pop(n)

    def left(self) -> Iterator[list[Piece]]:
        """The windows that are open at the end."""
        yield from self.open.values()


def _schema(doc_id: T.StructField) -> T.StructType:
    return T.StructType([doc_id, *T._parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, place long, ids binary")])


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def _packed(path: str, end_id: int, window: int, most: int, least_cut: int, names: list[str]):
    """Pieces of the windows that are emitted, and those left over with their ids and their place among the leftovers of the partition."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
        encode, packer, part = encoder(path), Packer(window, most, least_cut), TaskContext.get().partitionId()
        end = array("I", [end_id]).tobytes()
        held: dict[int, list] = {}  # documents with pieces in open windows: id, ids from a place on, that place, tokens, tokens not emitted
        rows: list[tuple] = []
        n, sequence, id_type = 0, (part + 1) << 32, None

        def emitted(pieces: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, length in pieces:
                doc_id, ids, base, tokens, _ = held[doc]
                rows.append((doc_id, start, length, checksum(ids[start - base : start - base + length]), tokens, sequence, at, None, None, None))
                at += length
                held[doc][4] -= length
                if not held[doc][4]:
                    del held[doc]
            sequence += 1

        def taken():
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([id_type, *kinds])], names=names)
            rows.clear()
            return out

        for batch in batches:
            id_type = batch.schema.types[0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode(text or "") + end, "<u4")
                held[n] = [doc_id, ids, 0, len(ids), len(ids)]
                for pieces in packer.put(n, len(ids)):
                    emitted(pieces)
                if n in held and len(ids) > window:
                    base = len(ids) - len(ids) % window
                    held[n][1:3] = ids[base:].copy(), base
                n += 1
                if len(rows) > 4096:
                    yield taken()
        place = 0
        for pieces in packer.left():
            if sum(x[2] for x in pieces) > window - least_cut:
                emitted(pieces)
                continue
            for doc, start, length in pieces:
                doc_id, ids, base, tokens, _ = held[doc]
                rows.append((doc_id, start, length, None, tokens, None, None, part, place, ids[start - base : start - base + length].astype("<u4").tobytes()))
                place += length
        if rows:
            yield taken()

    return run


def cuts(begin: int, end: int, total: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(sequence, offset, begin, end): the parts of a stretch of a stream of so many tokens, cut at every window and in its last window at powers of two."""
    last = total - total % window
    while begin < end:
        first, n = begin - begin % window, begin // window
        stop = first + window
        if begin >= last:
            # the last window's sequences: its length's powers of two, the largest first
            first, bit = last, 1 << window.bit_length()
            while True:
                bit >>= 1
                if bit & (total - last):
                    if first <= begin < first + bit:
                        break
                    first, n = first + bit, n + 1
            stop = first + bit
        yield n, begin - first, begin, min(end, stop)
        begin = min(end, stop)


def _merged(total: int, window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_id, start, length, doc_tokens, place, raw = row
                ids = np.frombuffer(raw, "<u4")
                for sequence, offset, a, b in cuts(place, place + length, total, window):
                    out.append((doc_id, start + a - place, b - a, checksum(ids[a - place : b - place]), doc_tokens, sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([batch.schema.types[0], *[pa.int64()] * 6])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, window: int = WINDOW, most: int = OPEN, least_cut: int = LEAST_CUT) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of a document. path: the tokenizer's file."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _schema(rows.schema["doc_id"])
    made = stored(rows.mapInArrow(_packed(path, end_id, window, most, least_cut, schema.names), schema))
    show = [*schema.names[:7]]
    left = made.where("part is not null")
    sizes = left.groupBy("part").agg(F.sum("length").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(sizes.select("part", "n", before.alias("before")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    left = left.join(sizes.select("part", "before"), "part").select("doc_id", "start", "length", "doc_tokens", (F.col("before") + F.col("place")).alias("place"), "ids")
    merged = stored(left.mapInArrow(_merged(total, window), T.StructType(schema.fields[:7])))
    discard(sizes)
    return made.where("part is null").select(*show).union(merged)
