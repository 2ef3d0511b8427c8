"""Token ids as ORC files: one row a document, in ascending id order over the files.

Ids are integer lists, which ORC stores run-length encoded; a row index every ``STRIDE`` rows and Bloom filters on
doc_id let a reader skip stripes for a document or a range, and the stripes of a file can be read apart. A row
also holds the number of ids before it in its file, so that a place in the corpus is found from per-file sums.

Plain text is encoded by its different pieces, a stretch at a time, through a table of those seen last; ``Encoder``
says why that is exact.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import as_bytes, give_back, lengths_to_offsets, stretches, written
from orderloom.sources.store import scratch_folder

END_ID = 1
STRIDE = 1000
STRIPE_BYTES = 16 << 20
TOKENIZER = "word_bpe_49k.json"


# How the tokenizer splits normalised text, here for texts of plain characters only: printable ASCII,
# tab, line ends and the letters of Latin-1, which no normalisation but lower case changes.
_SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ASCII = bytes([9, 10, 13, *range(32, 127)])
_LETTERS = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
# Of the bytes of plain text: the lower-case one, and what it is part of.
_LOWER = bytes(b + 32 if 65 <= b <= 90 or (128 <= b <= 158 and b != 151) else b for b in range(256))
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[[*range(97, 123), *range(128, 192), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
# So much plain text is split and looked up at a time.
TOGETHER = 2 << 20
_NONE = np.zeros(0, "<u4")


def is_plain(text: bytes) -> bool:
    """Whether the text has plain characters only, and no token's name."""
    return _LETTERS.fullmatch(text.translate(None, _ASCII)) is not None and b"<|" not in text


def _byte_characters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: the byte's own, if visible, else the next free."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


_CHARACTERS = _byte_characters()


def splits_so(tokenizer) -> bool:
    """Whether the tokenizer has the settings under which plain text falls into those pieces."""
    told = json.loads(tokenizer.to_str())
    return all(told.get(k) == v for k, v in _SETTINGS.items()) and all("<|" in t["content"] for t in told["added_tokens"])


def pieces_of(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of plain texts, one after the other, and how many there are before each text and in all.

    Pieces are 's 't 're 've 'm 'll 'd, runs of letters, single digits and runs of other characters but white space; an
    apostrophe inside a run of others begins nothing.
    """
    joined = b" ".join(texts)
    data = np.frombuffer(joined.translate(_LOWER), np.uint8)
    kind = _KIND[data]
    filled = kind != _SPACE
    begins = kind == _DIGIT
    begins[:1] |= filled[:1]
    begins[1:] |= filled[1:] & (kind[1:] != kind[:-1])
    at = np.flatnonzero(data == ord("'"))
    if len(at):
        at = at[(at == 0) | (kind[at - 1] != _OTHER)]
        near = np.concatenate([data, np.zeros(2, np.uint8)])
        second, third = near[at + 1], near[at + 2]
        size = np.where(np.isin(second, list(b"stmd")), 2, 0)
        size[np.isin(second, list(b"rv")) & (third == ord("e")) | (second == ord("l")) & (third == ord("l"))] = 3
        at, behind = at[size > 0], (at + size)[size > 0]
        begins[at + 1] = False
        behind = behind[behind < len(data)]
        begins[behind] = filled[behind]
    packed = data[filled]
    offsets = np.append(np.flatnonzero(begins[filled]), len(packed)).astype(np.int32)
    starts = lengths_to_offsets(np.array([len(t) + 1 for t in texts]))
    pieces = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(packed))
    return pieces, np.searchsorted(np.flatnonzero(begins), starts)


def _gathered(values: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted ones of lists that lie one after the other."""
    own = sizes[wanted]
    ends = np.cumsum(own)
    first = (np.cumsum(sizes) - sizes)[wanted] - (ends - own)
    return values[np.repeat(first.astype(np.int32), own) + np.arange(own.sum(), dtype=np.int32)]


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers.

    A tokenizer with other settings than ``_SETTINGS`` gets every text whole, and nothing is looked up.

    The different pieces of a stretch of plain texts are looked up in a bounded table of those seen last: arrays of
    names, numbers of ids and ids, of some 40 bytes a piece. Of more than ``words`` pieces those used last stay,
    ``pieces`` of them; none of over ``longest`` bytes stays. Pieces that are not in the table go to the tokenizer's
    model alone, as they are normalised and split already. Other text goes through the whole tokenizer. Long texts go
    a stretch at a time, which changes nothing: the tokenizer splits at white space and drops it.
    """

    def __init__(self, path: str, words: int = 300_000, pieces: int = 200_000, longest: int = 32):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limits, self.longest = (words, pieces), longest
        self.names = pa.array([], pa.string())
        self.sizes, self.used, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")
        self.round = 0
        self.model = self.tokenizer.model
        self.by_pieces = splits_so(self.tokenizer)

    @property
    def words(self) -> dict[str, bytes]:
        """The pieces in the table, with their ids."""
        ends = np.cumsum(self.sizes)
        spans = zip((ends - self.sizes).tolist(), ends.tolist())
        return {p: self.ids[a:b].tobytes() for p, (a, b) in zip(self.names.to_pylist(), spans)}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _new_piece(self, piece: str) -> list[int]:
        text = piece if piece.isascii() else "".join([_CHARACTERS[b] for b in piece.encode()])
        return [token.id for token in self.model.tokenize(text)]

    def _places(self, asked: pa.StringArray) -> np.ndarray:
        """Where the table has each of these different pieces; new ones come behind the others."""
        at = pc.fill_null(pc.index_in(asked, value_set=self.names), -1).to_numpy().copy()
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = len(self.names) + np.arange(len(missing))
            new = asked.take(pa.array(missing))
            found = [self._new_piece(p) for p in new.to_numpy(zero_copy_only=False).tolist()]
            self.names = pa.concat_arrays([self.names, new])
            self.sizes = np.concatenate([self.sizes, np.array([len(i) for i in found], np.int32)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), "<u4")])
            self.used = np.concatenate([self.used, np.zeros(len(found), np.int32)])
        self.round += 1
        self.used[at] = self.round
        return at

    def _forget(self) -> None:
        short = pc.less_equal(pc.binary_length(self.names), self.longest).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(short)
        if len(kept) > self.limits[0]:
            kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[: self.limits[1]]])
        if len(kept) < len(self.names):
            self.ids = _gathered(self.ids, self.sizes, kept)
            self.names, self.sizes, self.used = self.names.take(pa.array(kept)), self.sizes[kept], self.used[kept]

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        pieces, bounds = pieces_of(texts)
        coded = pieces.dictionary_encode()
        wanted = self._places(coded.dictionary)[coded.indices.to_numpy()]
        ids = _gathered(self.ids, self.sizes, wanted)
        bounds = lengths_to_offsets(self.sizes[wanted])[bounds].tolist()
        self._forget()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_pieces:
            return [self._whole(t.decode()) for t in texts]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, bytes]] = []

        def look_up() -> None:
            for (i, k, _), ids in zip(held, self._plain([part for _, _, part in held])):
                parts[i][k] = ids
            held.clear()

        weight = 0
        for i, text in enumerate(texts):
            for k, part in enumerate(stretches(text, TOGETHER // 2)):
                if is_plain(part):
                    parts[i].append(_NONE)
                    held.append((i, k, part))
                    weight += len(part)
                    if weight >= TOGETHER:
                        look_up()
                        weight = 0
                else:
                    parts[i].append(self._whole(part.decode()))
        if held:
            look_up()
        return [own[0] if len(own) == 1 else np.concatenate([_NONE, *own]) for own in parts]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, at, ids): documents in ascending id order, NULL first, ``at`` being the ids before it in its partition.

    Every document ends in ``END_ID``, so an empty or NULL text has that alone. Documents with one id follow each
    other in the order of their texts; other columns are not read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = T.StructType(
        [ordered.schema["doc_id"], T.StructField("at", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder, end, at = encoder_of(tokenizer), np.array([END_ID], "<u4"), 0
        for batch in batches:
            # A few rows at a time: the ids of very long texts need not lie side by side.
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000)
                ids = encoder.encode_all(list(as_bytes(rows.column("text"))))
                offsets = lengths_to_offsets(np.array([len(i) + 1 for i in ids]))
                values = np.concatenate([a for i in ids for a in (i, end)])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(at + offsets[:-1]), listed], ["doc_id", "at", "ids"]
                )
                at += int(offsets[-1])
        give_back()

    return ordered.mapInArrow(run, schema)


def write_ids(encoded: DataFrame, path: str) -> None:
    """One ORC file a partition, numbered in id order."""
    encoded.write.options(
        **{
            "compression": "zstd",
            "orc.create.index": "true",
            "orc.row.index.stride": str(STRIDE),
            "orc.stripe.size": str(STRIPE_BYTES),
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": "0.01",
        }
    ).orc(path)


def read_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, at, ids, file): the rows of the files; docs gives the type of doc_id."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("at", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    rows = docs.sparkSession.read.schema(schema).orc(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    return rows.select("doc_id", "at", "ids", number.alias("file"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # All ids are in the files: the tables of a worker that encoded before must not lie beside what the readers hold.
    _ENCODERS.clear()
    give_back()
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4").tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        columns = [batch.column("doc_id"), batch.column("file"), batch.column("at"), pa.array(np.diff(offsets), pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sums, pa.int64())], ["doc_id", "file", "at", "n_tokens", "ids_crc32"]
        )


def documents_of(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that were read, start counting over all files."""
    fields = [rows.schema["doc_id"], rows.schema["file"], T.StructField("at", T.LongType())]
    fields += [T.StructField(n, T.LongType()) for n in ("n_tokens", "ids_crc32")]
    seen = written(rows.mapInArrow(_crc, T.StructType(fields)), "token-rows")
    # One row a file.
    files = seen.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("file").alias("of_file"), before.alias("before"))
    out = seen.join(files, F.col("file") == F.col("of_file"))
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode, write and read back: where each document's ids lie, how many they are and their checksum.

    An empty table leaves no ids and gives an empty result.
    """
    path = scratch_folder(docs.sparkSession, "tokens")
    encoded = encode(docs, tokenizer or public_tokenizers.path(TOKENIZER), text, doc_id)
    write_ids(encoded, path)
    return documents_of(read_ids(encoded, path))
