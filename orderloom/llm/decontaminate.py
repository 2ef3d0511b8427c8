"""Benchmark items in documents, also with other numbers, names or units.

Texts become words without punctuation and case. In the template form numbers (digits or words, also before a
hyphen), units and names (words with a capital in front and a small letter) are typed placeholders, and what stood
there is kept as the slot's value. At the start of a sentence such a word may be a name or not, so its windows have
a template of each kind; in documents it is only a word if it is common in lower case and no name elsewhere in the
text. Windows of ``WINDOW`` words are hashed as words and as templates, and joined by hash: equal words are a match,
and so are equal templates if the slots agree. They agree if along one alignment of document and item each value of
the item always stands for one value of the document; windows with a value that stands for several are no match.

A document holds an item if ``SHARE`` of the item's windows or more are matched. Windows with fewer than
``LITERALS`` words that are no slots are not looked up as templates; they also match where matched windows of the
same alignment cover all their words.

A bit map of fixed size over the item windows' hashes goes to the tasks and lets most document windows drop out
before anything moves; what it lets through is joined on the whole hash, so more items only make it coarser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import BROADCAST_CELLS, KEY, as_bytes, give_back, joined_to_texts, text_key, unused, written

WINDOW = 5
SHARE = 0.8
LITERALS = 3
MAP_BITS = 24
KEEP_WORDS = 400_000
TOGETHER = 1 << 19

# Fixed values.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz lb lbs "
    "pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr "
    "hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur gbp percent "
    "mph kmh kph hz khz mhz ghz kb mb gb tb v volt volts w watt watts kw c f k celsius fahrenheit degree degrees".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
# Words that open sentences and are no names; the lower-case words of the benchmark are added.
OPENERS = frozenset(
    "a an the this that these those here there he she it we they you i his her its their our your my who whom whose what "
    "which when where why how if then so but and or nor yet because since while although though after before until as at "
    "by for from in into of off on onto out over to under up with without about is are was were be been am do does did "
    "has have had can could may might must shall should will would not no yes all any both each every either neither "
    "some many much more most few several other another such find calculate compute determine solve suppose assume given "
    "let consider write show prove explain now also however therefore thus finally first next later once only even".split()
)
COMMON = 50_000  # lower-case words of the benchmark, the most frequent first
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
WITH_UNIT = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(\w{1,12})")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")

WORD, NUM, UNIT, NAME, DROP, MAYBE = range(6)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MARKS = np.array([0, 11, 13, 17, 0], np.uint64) * _MIX  # what stands for a slot of each kind


def _word_hash(low: str) -> int:
    return xxhash.xxh64_intdigest(low.encode())


def _number(low: str) -> str | None:
    """What follows the number in a word that begins with one ('page' of '3-page'), units aside; None without one."""
    if NUMBER.fullmatch(low) or low in NUMBER_WORDS or ((m := WITH_UNIT.fullmatch(low)) and m[1] in UNITS):
        return ""
    if "-" not in low:
        return None
    parts = low.split("-")
    n = next((i for i, p in enumerate(parts) if not (p in NUMBER_WORDS or NUMBER.fullmatch(p))), len(parts))
    rest = "-".join(parts[n:])
    return None if not n else "" if rest in UNITS else rest


class Words(dict):
    """Numbers of the words seen, and by number their hash, kind, mark and flags; emptied when too many.

    Words of ``common`` hashes and OPENERS are no names at the start of a sentence, if common is not None.
    """

    def __init__(self, common: frozenset[int] | None = None) -> None:
        super().__init__()
        self.common = common
        self.rows: list[tuple[int, int, int, bool, bool, bool]] = []
        self.arrays: tuple = ()

    def __missing__(self, raw: bytes) -> int:
        text = raw.decode("utf-8", "replace")
        word = EDGES.sub("", text)
        low = word.lower()
        if not low:
            kind = DROP
        elif (rest := _number(low)) is not None:
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        else:
            kind = WORD
        titled = kind == WORD and word[0].isupper() and not word.isupper() and len(word) > 1
        hashed = _word_hash(low)
        plain = titled and self.common is not None and (low in OPENERS or hashed in self.common)
        mark = _word_hash("-" + rest) if kind == NUM and rest else int(_MARKS[kind])
        ends = text.rstrip("\"')]}»”’").endswith((".", "!", "?"))
        self.rows.append((hashed, kind, mark, titled, plain, ends))
        self[raw] = number = len(self.rows) - 1
        return number

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, kind and mark as a slot of each word that is not mere punctuation."""
        return self.of_texts([text])[:3]

    def of_texts(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for the words of several texts behind each other, and the number of each word's text."""
        if len(self) > KEEP_WORDS:
            self.clear()
            self.rows, self.arrays = [], ()
        split = [text.split() for text in texts]
        lengths = [len(words) for words in split]
        if not any(lengths):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, sum(lengths))
        text_of = np.repeat(np.arange(len(split)), lengths)
        if not self.arrays or len(self.arrays[0]) < len(self.rows):
            done = len(self.arrays[0]) if self.arrays else 0
            new = list(zip(*self.rows[done:]))
            new = [np.array(c, t) for c, t in zip(new, (np.uint64, np.int8, np.uint64, bool, bool, bool))]
            self._grow(done, new)
        hashes, kinds, marks, titled, plain, ends = (a[numbers] for a in self.arrays)
        start = np.concatenate([[True], ends[:-1] | (text_of[1:] != text_of[:-1])])
        named, first = np.flatnonzero(titled & ~start), np.flatnonzero(titled & start)
        if self.common is not None and len(first):
            own = lambda at: hashes[at] + text_of[at].astype(np.uint64) * _STEP  # noqa: E731  a name of the same text
            first = first[~plain[first] | np.isin(own(first), own(named))]
        kinds[named], kinds[first] = NAME, MAYBE
        marks[named] = marks[first] = _MARKS[NAME]
        kept = kinds != DROP
        return hashes[kept], kinds[kept], marks[kept], text_of[kept]

    def _grow(self, done: int, new: list[np.ndarray]) -> None:
        """Room doubles, so that adding words costs little however many there are."""
        size = done + len(new[0])
        room = getattr(self, "room", None)
        if room is None or not done or len(room[0]) < size:
            grown = [np.zeros(max(2 * size, 1024), a.dtype) for a in new]
            for g, a in zip(grown, self.arrays):
                g[:done] = a
            self.room = room = grown
        for r, a in zip(room, new):
            r[done:size] = a
        self.arrays = tuple(r[:size] for r in room)


def _windows(values: np.ndarray, size: int) -> np.ndarray:
    n = len(values) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _STEP + values[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def readings(kinds: np.ndarray) -> list[np.ndarray]:
    """The kinds with what may be a name as a word, and as a name."""
    maybe = kinds == MAYBE
    if not maybe.any():
        return [kinds]
    return [np.where(maybe, WORD, kinds), np.where(maybe, NAME, kinds)]


def plain_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows as words."""
    return _windows(hashes, size) ^ np.uint64(size) if len(hashes) >= size else np.zeros(0, np.uint64)


def template_hashes(
    plain: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, marks: np.ndarray, size: int
) -> np.ndarray:
    """Hashes of the windows as templates; the plain one where there is no slot or too few words beside them."""
    slots = kinds != WORD
    if not len(plain) or not slots.any():
        return plain
    inside = np.cumsum(np.concatenate([[0], slots]))
    inside = inside[size:] - inside[:-size]
    usable = (inside > 0) & (size - inside >= min(LITERALS, size - 1))
    marked = np.where(slots, marks, hashes)
    return np.where(usable, _windows(marked, size) ^ np.uint64(size) ^ np.uint64(1 << 63), plain)


def _slots(hashes: np.ndarray, kinds: np.ndarray, at: int, size: int) -> list[int]:
    """The values in a window's slots, in order."""
    inside = np.flatnonzero(kinds[at : at + size] != WORD) + at
    return hashes[inside].view(np.int64).tolist()


_WINDOWS = "item_id long, size int, windows long, place long, hash long, slots array<long>"


def item_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, size, windows, place, hash, slots): every window of every item, as words and as template.

    An item of fewer than WINDOW words is one window; one without words has none.
    """
    slim = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            out = []
            for item, content in zip(batch.column("item_id").to_pylist(), as_bytes(batch.column("text"))):
                hashes, kinds, marks = words.of(content)
                size = min(WINDOW, len(hashes))
                if not size:
                    continue
                before = [plain_hashes(hashes, size)]
                plain = before[0].view(np.int64).tolist()
                out += [(item, size, len(plain), at, p, None) for at, p in enumerate(plain)]
                for read in readings(kinds):
                    template = template_hashes(before[0], hashes, read, marks, size)
                    for at in np.flatnonzero(np.all([template != b for b in before], axis=0)).tolist():
                        t = int(template[at].view(np.int64))
                        out.append((item, size, len(plain), at, t, _slots(hashes, read, at, size)))
                    before.append(template)
            if out:
                kinds_ = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds_)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "size", "windows", "place", "hash", "slots"])

    return slim.mapInArrow(run, _WINDOWS)


def bit_map(windows: DataFrame) -> np.ndarray:
    """2^MAP_BITS bits, one set for each hash; at most 2^MAP_BITS / 64 numbers come to the driver."""
    place = F.col("hash").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bit = F.expr(f"shiftleft(1L, cast((hash & {(1 << MAP_BITS) - 1}) % 64 as int))")
    rows = windows.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _probe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << MAP_BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def common_words(benchmark: DataFrame, text: str = "text") -> frozenset[int]:
    """Hashes of the words that stand in lower case in two items or more, COMMON at most."""
    words = F.array_distinct(F.split(F.col(text), r"[^\p{L}\p{N}'-]+"))
    rows = benchmark.select(F.explode(words).alias("w")).filter("w != '' AND w = lower(w)").groupBy("w").count()
    rows = rows.filter("count > 1").orderBy(F.desc("count"), "w").limit(COMMON).collect()
    return frozenset(_word_hash(r["w"]) for r in rows)


def _together(texts: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts that follow each other, some TOGETHER bytes at a time, and the number of the first: arrays of short
    texts cost more to make than to fill."""
    begin, held, size = 0, [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield begin, held
            begin, held, size = begin + len(held), [], 0
    if held:
        yield begin, held


def _document_windows(texts: DataFrame, bits: np.ndarray, sizes: list[int], common: frozenset[int]) -> DataFrame:
    """(k1, k2, hash, at, doc_slots): the windows that the bit map lets through."""
    schema = T.StructType(
        [*(texts.schema[c] for c in KEY), *T._parse_datatype_string("hash long, at long, doc_slots array<long>").fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(common)
        for batch in batches:
            rows, out = [], []
            for begin, texts_ in _together(as_bytes(batch.column("text"))):
                hashes, kinds, marks, of = words.of_texts(texts_)
                starts = np.searchsorted(of, np.arange(len(texts_)))
                read = readings(kinds)
                for size in sizes:
                    plain = plain_hashes(hashes, size)
                    whole = of[: len(plain)] == of[len(of) - len(plain) :]  # the window lies in one text
                    at = np.flatnonzero(_probe(bits, plain) & whole)
                    rows += (begin + of[at]).tolist()
                    out += [(h, p, None) for h, p in zip(plain[at].view(np.int64).tolist(), (at - starts[of[at]]).tolist())]
                    before = plain
                    for own in read:
                        template = template_hashes(plain, hashes, own, marks, size)
                        new = np.flatnonzero((template != plain) & (template != before) & whole)
                        at = new[_probe(bits, template[new])]
                        rows += (begin + of[at]).tolist()
                        places = zip(template[at].view(np.int64).tolist(), (at - starts[of[at]]).tolist(), at.tolist())
                        out += [(h, p, _slots(hashes, own, i, size)) for h, p, i in places]
                        before = template
            if out:
                chosen = pa.array(rows, pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(chosen) for c in KEY), *columns], [*KEY, "hash", "at", "doc_slots"]
                )
        del words
        give_back()

    return texts.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, item_id, matched, windows): texts, known by the hash of their content, and the items they hold."""
    items = written(item_windows(benchmark), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # five values at most
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select("text", *text_key(F.col("text")))
    found = _document_windows(texts.select(*KEY, "text"), bit_map(items), sizes, common_words(benchmark))
    pairs = found.join(items, "hash").select(
        *KEY, "item_id", "windows", "place", (F.col("at") - F.col("place")).alias("line"), "slots", "doc_slots"
    )
    pairs = written(pairs.distinct(), "window-pairs")
    by_line = [*KEY, "item_id", "line"]
    slotted = pairs.filter("slots IS NOT NULL AND doc_slots IS NOT NULL AND size(slots) = size(doc_slots)")
    values = slotted.select(*by_line, F.explode(F.arrays_zip("slots", "doc_slots")).alias("v"))
    values = values.select(*by_line, F.col("v.slots").alias("own"), F.col("v.doc_slots").alias("other"))
    # Each value of the item must go with one value of the document.
    clash = values.groupBy(*by_line, "own").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a != b")
    clash = clash.groupBy(*by_line).agg(F.collect_set("own").alias("clash"))
    agreed = slotted.join(clash, by_line, "left").filter("clash IS NULL OR NOT arrays_overlap(slots, clash)")
    plain = pairs.filter("slots IS NULL AND doc_slots IS NULL")
    columns = [*by_line, "windows", "place"]
    found = plain.select(*columns).unionByName(agreed.select(*columns)).distinct()
    # All words of a window are covered if the matched windows around it overlap or touch.
    after = F.lead("place").over(Window.partitionBy(*by_line).orderBy("place"))
    found = found.withColumn("next", F.when(after - F.col("place") <= WINDOW, after))
    places = F.sequence("place", F.greatest(F.coalesce("next", "place") - 1, "place"))
    matched = found.select(*KEY, "item_id", "windows", F.explode(places).alias("place"))
    counted = matched.distinct().groupBy(*KEY, "item_id").agg(
        F.count("*").alias("matched"), F.max("windows").alias("windows")
    )
    return counted.filter(F.col("matched") >= SHARE * F.col("windows"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, matched, windows): a row for every document row and item that it holds.

    Clean documents have no row. A NULL or empty text holds nothing, and an item without words is held by none.
    Items with one id count as one of the larger size, all their windows together; repeated document rows have a
    row each; other columns are not read; empty tables give an empty result.
    """
    held = written(contaminated(docs, benchmark, text), "held")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.select("doc_id", *text_key(F.col("_t")))
    return joined_to_texts(rows, held).select("doc_id", "item_id", "matched", "windows")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with their columns as they were."""
    held = written(contaminated(docs, benchmark, text).select(*KEY).distinct(), "held")
    whole, *names = unused(docs, "_text_or_empty", *(f"_held_{c}" for c in KEY))
    held = held.select(*(F.col(c).alias(n) for c, n in zip(KEY, names)))
    marked = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    marked = marked.withColumns(dict(zip(names, text_key(F.col(whole)))))
    small = F.broadcast(held) if held.count() <= BROADCAST_CELLS else held
    return marked.join(small, names, "left_anti").select(*docs.columns)
