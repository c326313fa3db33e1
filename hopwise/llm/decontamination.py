"""Benchmark decontamination by templates: typed placeholders, a hash join of template windows, consistent slots.

A text's tokens are its words without punctuation, lower-cased; every character of a script without spaces (Chinese, Japanese,
Thai, Lao, Khmer, Burmese) is a token. Numbers (digits, also with separators or a short suffix such as `5km`), names (capitalised
words) and units after a number become the placeholders of their type; the word itself is the value of the slot. Windows of 13
tokens are hashed; a shorter item is one window of its own length, down to `shortest` tokens (a parameter: 1 searches every
item, and then an item of one word is found wherever the word stands).

Every window is hashed in four readings: names only inside sentences; names anywhere, but for the words that often open a sentence
(OPENERS); numbers and units only, whatever the case; and plain words. The plain reading always counts, so a verbatim copy is
found whatever its case, punctuation and slots. The readings with slots count for windows of 5 tokens or more of which at
most half are numbers or names.

The items' window hashes fill a bit set of a fixed size at most (8 MB); what documents have outside of it is dropped where
it is made. The rest meets the items in a hash join, and a pair counts if equal slot values of the item have equal values in the
document, in that order, so a question asked again with other numbers or names is found. That depends on an item's
pattern of equal slots only, so each hash has one row for each pattern, with the smallest item id. A document is contaminated if it
has one such window; windows are counted once, whatever readings and items they match.

Null and empty texts hold nothing. Rows that repeat a doc_id count as one document; rows with null ids are not
reported, and `without_contaminated` judges them by their text if `null_ids` is set. Of several items the smallest id is named; a null item id is named only if no other fits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm import hashing as H
from hopwise.llm.shared import bit_set, checkpointed, set_apart, small_batches, stored

WINDOW, SHORTEST, SHORTEST_PLAIN, LEAST_BITS, MOST_BITS, BROADCAST_WINDOWS, BROADCAST_IDS = 13, 5, 3, 20, 26, 200_000, 1_000_000
# Units that may follow a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds ounce ounces oz ml l liter liters litre litres gallon gallons "
    "second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years degree degrees celsius fahrenheit kelvin dollar dollars cent cents euro euros usd eur percent "
    "mph kmh hz khz mhz ghz watt watts kw kwh volt volts v w joule joules j n newton newtons pa kpa mol byte bytes kb mb gb tb"
).split()
# Words that often open a sentence or a question and are no names.
OPENERS = (
    "a an the this that these those there here it its he she they we you i his her their our your my what which who whom whose when where why how whether is are was were be do does did has have had can could will would shall should may might must "
    "if then so and but or nor for as at by in on of to from with without into over under after before during while until since because although though once each every all any some no not only both either neither one two three many most more few several other another such "
    "find compute calculate solve determine evaluate simplify name list give write explain describe choose select identify consider suppose assume let draw complete state show prove estimate compare define discuss use using given read answer true false yes please "
    "der die das ein eine was wer wie wo wann warum welche welcher welches ist sind wenn und aber in im auf mit von le la les un une que qui quel quelle quels quelles comment pourquoi quand est sont si et dans el los las una quien cual cuando donde como cuanto es son en con"
).split()

_NUM, _NAME, _UNIT = H.mix(np.array([11, 12, 13], np.uint64))
_alnum = np.zeros(256, bool)
_alnum[48:58] = _alnum[65:91] = _alnum[97:123] = _alnum[128:] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in ".!?:\n"]] = True


def _words_of(texts: list[str]) -> H.Words:
    data = " ".join(texts).encode()
    return H.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


_unit_hashes = np.sort(_words_of(UNITS).hash)
_opener_hashes = np.sort(_words_of(sorted(set(OPENERS))).hash)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with capital Latin (ASCII and Latin-1), Greek and Cyrillic letters in lower case."""
    out = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    lead, last = data[:-1], data[1:]
    to = out[1:]
    for first, low, high, shift, up in ((0xC3, 0x80, 0x9E, 32, 0), (0xCE, 0x91, 0x9F, 32, 0), (0xCE, 0xA0, 0xA9, -32, 1), (0xD0, 0x90, 0x9F, 32, 0), (0xD0, 0xA0, 0xAF, -32, 1)):
        hit = (lead == first) & (last >= low) & (last <= high) & ~((first == 0xC3) & (last == 0x97))
        to[hit] = last[hit] + np.uint8(shift % 256)
        out[:-1][hit] += np.uint8(up)
    return out


def apart(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space on both sides of each character of a script without spaces, and their new offsets."""
    if not (data >= 0xE0).any():
        return data, ends
    second = np.append(data[1:], np.uint8(0))
    hit = (data >= 0xE3) & (data <= 0xE9) & ~((data == 0xE3) & (second == 0x80))  # kana and Han, not their punctuation
    hit |= (data == 0xE0) & (second >= 0xB8) & (second <= 0xBB)  # Thai, Lao
    hit |= (data == 0xE1) & (((second >= 0x80) & (second <= 0x82)) | (second == 0x9E) | (second == 0x9F))  # Burmese, Khmer
    at = np.flatnonzero(hit)
    if not len(at):
        return data, ends
    cuts = np.sort(np.concatenate((at, at + 3)))
    moved = ends + np.searchsorted(cuts, ends, "right")
    moved[0] = 0
    return np.insert(data, cuts, np.uint8(32)), moved


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters and digits: ASCII punctuation and that of Latin-1, of the general and CJK blocks and of full width do not count."""
    keep = _alnum[data]
    if len(data) > 2 and (data >= 0xC2).any():
        lead, second, third = data[:-2], data[1:-1], data[2:]
        at = np.flatnonzero(((lead == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((lead == 0xE3) & (second == 0x80) & (third != 0x85) & (third != 0x86) & (third != 0x87)))
        wide = np.flatnonzero((lead == 0xEF) & (((second == 0xBC) & ((third <= 0x8F) | ((third >= 0x9A) & (third <= 0xA0)) | (third >= 0xBB))) | ((second == 0xBD) & ((third == 0x80) | ((third >= 0x9B) & (third <= 0xA5))))))
        for i in range(3):
            keep[at + i] = keep[wide + i] = False
    if len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] <= 0xBF) & ~np.isin(data[1:], (0xAA, 0xB5, 0xBA)))
        keep[at] = keep[at + 1] = False
    return keep


class Template:
    """The tokens of some texts: words (with their own hashes), and the readings: hashes, slots, and which of them are numbers or names."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        data, ends = apart(data, ends)
        plain = lowered(data)
        keep = _letters(data)
        if len(data) > 2:
            inner = np.zeros(len(data), bool)
            inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & _digit[data[:-2]] & _digit[data[2:]]
            keep |= inner
        plain[~keep] = 32
        self.words = words = H.Words(plain, ends)
        own = words.hash
        none = np.zeros(len(own), bool)
        self.readings = [(words, none, none)] * 4
        if not len(own):
            return
        sums = lambda flags: np.concatenate(([0], np.cumsum(flags)))
        digits = sums(_digit[data])
        n_digits = digits[words.stop] - digits[words.start]
        letters = words.stop - words.start - n_digits
        number = _digit[data[words.start]] & (letters <= np.maximum(2, n_digits // 2))
        marks = sums(_mark[data])
        opens = np.ones(len(own), bool)
        opens[1:] = marks[words.start[1:]] > marks[words.stop[:-1]]
        starts = words.first[:-1][np.diff(words.first) > 0]
        opens[starts] = True
        first, second = data[words.start], data[np.minimum(words.start + 1, len(data) - 1)]
        name = (first >= 65) & (first <= 90) & (second >= 97) & (words.stop - words.start > 1)
        unit = np.zeros(len(own), bool)
        unit[1:] = number[:-1] & _among(own[1:], _unit_hashes)
        unit[starts] = False

        def reading(units, names):
            names = names & ~units & ~number
            return words.rehashed(np.select([number, units, names], [_NUM, _UNIT, _NAME], own)), number | units | names, number | names

        self.readings = [reading(unit & ~opens, name & ~opens), reading(unit, name & ~_among(own, _opener_hashes)), reading(unit, none), (words, none, none)]


def _chunks(column):
    data, ends = H.text_buffers(column)
    row, n = 0, len(ends) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + H.CHUNK, "right")) - 1)
        yield row, Template(data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


def _literal_enough(free: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(free)))
    return 2 * (sums[at + k] - sums[at]) <= k


def _emit(ids, words, slots, at, k, h, values):
    """One row for each window; values: of the slots of one window."""
    import pyarrow as pa

    doc = np.searchsorted(words.first, at, "right") - 1
    lists = [values(words.hash[a : a + k][slots[a : a + k]]) for a in at]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(v) for v in lists]))).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(doc)),
            pa.array(H.signed(h)),
            pa.array(np.full(len(at), k, np.int32)),
            pa.array((at - words.first[doc]).astype(np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))),
        ],
        names=["id", "h", "k", "place", "slots"],
    )


def _pattern(values: np.ndarray) -> np.ndarray:
    """For each slot, the first slot with its value."""
    _, first, same = np.unique(values, return_index=True, return_inverse=True)
    return first[same].astype(np.int64)


def _used(k: int, readings: list) -> list:
    """The readings in which windows of k tokens are looked for."""
    return readings if k >= SHORTEST else readings[-1:]


def _item_windows(shortest: int):
    def run(batches):
        for batch in batches:
            for row, found in _chunks(batch.column(1)):
                words = found.words
                n = np.diff(words.first)
                ids = batch.column(0).slice(row, len(n))
                for k in range(shortest, WINDOW + 1):
                    at = words.first[:-1][n == k] if k < WINDOW else words.windows(WINDOW)[0]
                    for typed, slots, free in _used(k, found.readings):
                        good = at[_literal_enough(free, at, k)]
                        yield _emit(ids, words, slots, good, k, typed.spans(good, good + k), _pattern)

    return run


def _document_windows(lengths: list[int], bits):
    def run(batches):
        filled = np.frombuffer(bits.value, np.uint64)
        mask = H.U(len(filled) * 64 - 1)
        for batch in batches:
            for row, found in _chunks(batch.column(1)):
                words = found.words
                ids = batch.column(0).slice(row, len(words.first) - 1)
                for k in lengths:
                    before: list[np.ndarray] = []
                    for typed, slots, _ in _used(k, found.readings):
                        at, h = typed.windows(k)
                        place = h & mask
                        hit = (filled[(place >> H.U(6)).astype(np.int64)] >> (place & H.U(63))) & H.U(1) == 1
                        for same in before:  # equal hashes of a window are equal readings of it
                            hit &= h != same
                        before.append(h)
                        if hit.any():
                            yield _emit(ids, words, slots, at[hit], k, h[hit], H.signed)

    return run


def _found(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, shortest: int) -> DataFrame:
    """(id, item_id, place, k) of the windows that count, once for each reading and pattern; docs: (id, text), the id of any type."""
    spark = docs.sparkSession
    small_batches(spark)
    made = "h long, k int, place long, slots array<long>"
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = stored(items.mapInArrow(_item_windows(shortest), f"id long, {made}").groupBy("h", "k", "slots").agg(F.min("id").alias("item_id")))
    about = items.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("k")).alias("lengths")).first()
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * about["n"]).bit_length()))
    bits = spark.sparkContext.broadcast(bit_set(items.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("place")), size))
    kind = docs.schema["id"].dataType.simpleString()
    hits = docs.select("id", "text").mapInArrow(_document_windows(about["lengths"], bits), f"id {kind}, {made}").withColumnRenamed("slots", "values")
    items = F.broadcast(items) if about["n"] <= BROADCAST_WINDOWS else items
    pairs = hits.join(items, ["h", "k"])
    return pairs.where(F.size(F.array_distinct(F.arrays_zip("slots", "values"))) == F.size(F.array_distinct("slots")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shortest: int = SHORTEST_PLAIN) -> DataFrame:
    """(doc_id, item_id, n_windows): one row per contaminated document."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    found = _found(texts, benchmark, item_col, item_text_col, shortest)
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.min("item_id").alias("item_id"), F.count_distinct("place", "k").alias("n_windows"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST_PLAIN, null_ids: bool = False) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; null_ids: rows with null ids are judged too, each by its text."""
    columns = docs.columns
    docs, named = set_apart(docs)
    id_col, text = named[id_col], F.col(named[text_col]).cast("string")
    own = F.when(F.col(id_col).isNull(), F.xxhash64(text))
    texts = docs.select(F.struct(F.col(id_col).cast("long").alias("i"), own.alias("t")).alias("id"), text.alias("text"))
    texts = texts if null_ids else texts.where("id.i is not null")
    lost = checkpointed(_found(texts, benchmark, "item_id", "text", shortest).select(F.col("id.i").alias("__lost"), F.col("id.t").alias("__text")).distinct())
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost
    return docs.join(lost, docs[id_col].cast("long").eqNullSafe(F.col("__lost")) & own.eqNullSafe(F.col("__text")), "left_anti").toDF(*columns)
