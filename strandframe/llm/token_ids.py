"""Token-id shards: texts become raw ids in shard files, and a minimal perfect hash index finds a document's ids by its key.

Shard `ids-00000.bin`: the ids of its documents one after the other, 2 or 4 bytes each, then a table of
its rows (the end of each in ids, its key, whether the key is null), then a trailer of 40 bytes. All
numbers are little-endian. `manifest.json` lists the shards in order, with their rows, ids and null keys.

Index file `index-00000.mph`, for the keys whose hash begins with its number: levels of bits, in each of
which a key that meets no other owns a bit; the rank of that bit is the key's slot, and a slot holds a
fingerprint of its key, shard, row, number of rows and offset. So a key costs a few reads, however large
the corpus. A key not stored meets a slot with another fingerprint but once in 2^32, and the key in the
shard's table decides.
"""

from __future__ import annotations

import contextlib
import json
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.files import file_system
from . import common

MAGIC = b"SFTOKID1"
_TRAILER = struct.Struct("<8sQQQII")
#: Keys of an index file on average, where there are more than _LEAST_FILES * KEYS of them.
KEYS = 1 << 20
_LEAST_FILES = 64
#: Entries of a generation of the parts of words whose ids a worker keeps (of words it keeps twice as many), and the most characters of such a word.
KEPT, SHORT = 1 << 18, 64
#: White space of the pre-tokenizer, and letters that it surely takes as such.
_S = " \\t\\n\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02af"
#: Where a space has white space before it, it may be of the token before.
_JOINED = re.compile(f" (?<=[{_S}] )")
_SPACED = re.compile(f"[{_S}]*[^{_S}]+|[{_S}]+")
#: Tokens end where letters end, and where white space begins that follows none: texts may be cut there.
_PIECE = re.compile(f"\\n(?=[^{_S}])| ?[{_LETTERS}]+(?=[\\x00-@\\[-`{{-\\x7f]|\\Z)|[{_S}]*[^{_S}]+|[{_S}]+")
_WORD = re.compile(f" ?[{_LETTERS}]+")


class _Kept(dict):
    """Values of keys, made when they are asked for: two generations of entries, of which the older goes when the younger has `most`."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > SHORT:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts, as bytes of 4 a little-endian id, by a file of the tokenizers library.

    special_as_text: the strings of special tokens are ordinary text, else they become these tokens as the
    library has it. With a byte-level pre-tokenizer texts are cut where no token goes on, and pieces that come
    again aren't encoded again; a piece that is one word of the pre-tokenizer's goes to the model at once.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        plain = made["normalizer"] is None and all(not t["content"].strip().isalpha() for t in made["added_tokens"])
        self.pieces = bool(plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"))
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = (chr(c) for c in range(0x2B0) if _WORD.fullmatch(chr(c)))
        self.table = {ord(c): level.pre_tokenize_str(c)[0][0] for c in (" ", *letters)}
        self.cut = _Kept(self._piece, KEPT)
        self.words = _Kept(self._word, 2 * KEPT)  # words behind a space

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[piece[0] == " " :].isalpha():  # the bytes of these stand for themselves
            mapped = self.table[32] + piece[1:] if piece[0] == " " else piece
        elif _WORD.fullmatch(piece):
            mapped = piece.translate(self.table)
        else:
            return self._whole(piece)
        return self._mapped(mapped)

    def _mapped(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # kept here, not as a piece once more
            return self._mapped(self.table[32] + word) if word.isascii() else self._piece(" " + word)
        head, mark = word[:-1], word[-1:]
        if mark.isascii() and head.isalpha() and not mark.isalpha():  # letters end there
            return self.words[head] + self.cut[mark]
        return self._spaced(" " + word)

    def _spaced(self, piece: str) -> bytes:
        """The ids of a piece that may be cut further."""
        return b"".join([self.cut[p] for p in _PIECE.findall(piece)])

    def __call__(self, text: str) -> bytes:
        if not self.pieces:
            return self._whole(text)
        if _JOINED.search(text):
            return b"".join(map(self._spaced, _SPACED.findall(text)))
        first, *words = text.split(" ")
        return self._spaced(first) + b"".join(map(self.words.__getitem__, words))


@cache
def _encoder(path: str, special_as_text: bool) -> Encoder:
    """One for a worker, whatever tasks it has."""
    return Encoder(path, special_as_text)


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = 2, special_as_text: bool = False) -> DataFrame:
    """(key long, ids binary): the ids of each whole text, little-endian, in 4 bytes, and the end id; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, special_as_text)
        tail = b"" if end is None else struct.pack("<I", end)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encoder(t or "") + tail for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ids binary")


@dataclass
class _Shard(WriterCommitMessage):
    part: int
    path: str
    rows: int
    tokens: int
    nulls: int


class _ShardWriter(DataSourceArrowWriter):
    """Each task writes its rows to a hidden file; the commit names the files by the order of the tasks and writes the manifest."""

    def __init__(self, path: str, width: int, tokenizer: str | None, end: int | None, special_as_text: bool) -> None:
        self.path, self.width, self.tokenizer, self.end, self.special_as_text = path, width, tokenizer, end, special_as_text

    def _ids(self, cells: pa.Array) -> Iterator[np.ndarray]:
        """Of cells that hold ids, or texts to be encoded here, so that ids needn't pass through the JVM."""
        if self.tokenizer is None:
            yield from (np.frombuffer(c or b"", dtype="<u4") for c in common.utf8(cells))
            return
        encoder = _encoder(self.tokenizer, self.special_as_text)
        tail = b"" if self.end is None else struct.pack("<I", self.end)
        for lo in range(0, len(cells), 256):
            yield from (np.frombuffer(encoder(t or "") + tail, dtype="<u4") for t in cells.slice(lo, 256).to_pylist())

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = file_system(self.path)
        system.create_dir(folder)
        name = f"{folder}/.ids-{context.partitionId()}-{context.taskAttemptId()}"
        ends, keys, null, n = array("Q"), array("q"), bytearray(), 0
        with system.open_output_stream(name) as f:
            for batch in batches:
                for key, found in zip(batch.column(0).to_pylist(), self._ids(batch.column(1)), strict=True):
                    f.write(found.astype(f"<u{self.width}", copy=False).tobytes())
                    n += len(found)
                    ends.append(n)
                    keys.append(key or 0)
                    null.append(key is None)
            f.write(np.asarray(ends, dtype="<u8").tobytes())
            f.write(np.asarray(keys, dtype="<i8").tobytes())
            f.write(bytes(null))
            f.write(_TRAILER.pack(MAGIC, len(ends), n, sum(null), self.width, 0))
        if not ends:
            system.delete_file(name)
        return _Shard(context.partitionId(), name if ends else "", len(ends), n, sum(null))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder)
        shards = []
        for m in sorted((m for m in messages if m and m.path), key=lambda m: m.part):
            name = f"ids-{len(shards):05d}.bin"
            system.move(m.path, f"{folder}/{name}")
            shards.append([name, m.rows, m.tokens, m.nulls])
        with system.open_output_stream(f"{folder}/manifest.json") as f:
            f.write(json.dumps({"width": self.width, "shards": shards}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m and m.path:
                with contextlib.suppress(OSError):
                    system.delete_file(m.path)


class TokenIdSource(DataSource):
    """df.write.format("token_ids").option("width", 2 or 4).save(path): the columns key and ids of `encode`, a shard a partition.

    With the options tokenizer, end and special_as_text the columns are key and text, and the writer encodes the texts.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        end = self.options.get("end")
        return _ShardWriter(self.options["path"], int(self.options.get("width", 4)), self.options.get("tokenizer"), int(end) if end else None, self.options.get("special_as_text") == "true")


@dataclass
class Manifest:
    """Shards in order: names, rows, ids and null keys of each, and the ids before each."""

    path: str
    width: int
    names: list[str]
    rows: np.ndarray
    tokens: np.ndarray
    nulls: np.ndarray

    @classmethod
    def read(cls, path: str) -> Manifest:
        system, folder = file_system(path)
        with system.open_input_stream(f"{folder}/manifest.json") as f:
            said = json.loads(f.read())
        cols = list(zip(*said["shards"], strict=True)) or [(), (), (), ()]
        return cls(path, said["width"], list(cols[0]), *[np.array(c, dtype=np.int64) for c in cols[1:]])

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.tokens) - self.tokens


class Shard:
    """Reads a shard: its table of rows, and ids by their place."""

    def __init__(self, path: str) -> None:
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        magic, self.rows, self.tokens, self.nulls, self.width, _ = _TRAILER.unpack(self._at(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise OSError(f"{path} is no shard of token ids")
        self.table_at = self.tokens * self.width
        self.keys_at = self.table_at + 8 * self.rows

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def table(self, first: int = 0, n: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts and, one longer, ends of the rows in ids; keys; whether they are null) from a row on."""
        n = self.rows - first if n is None else n
        before = self._at(self.table_at + 8 * (first - 1), 8) if first else bytes(8)
        edges = np.frombuffer(before + self._at(self.table_at + 8 * first, 8 * n), dtype="<u8").astype(np.int64)
        keys = np.frombuffer(self._at(self.keys_at + 8 * first, 8 * n), dtype="<i8")
        return edges, keys, np.frombuffer(self._at(self.keys_at + 8 * self.rows + first, n), dtype=np.bool_)

    def ids(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self._at(start * self.width, n * self.width), dtype=f"<u{self.width}").astype(np.uint32)

    def close(self) -> None:
        self.file.close()


def write_shards(encoded: DataFrame, path: str, width: int = 4) -> None:
    """The rows of `encode`, already in order within and across partitions, as shards under a path."""
    _write(encoded, path, width=width)


def _write(rows: DataFrame, path: str, **options) -> None:
    rows.sparkSession.dataSource.register(TokenIdSource)
    rows.write.format("token_ids").options(**{k: v for k, v in options.items() if v is not None}).mode("append").save(path)


def build_shards(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = 2, special_as_text: bool = False) -> None:
    """Encodes whole texts and writes them in ascending order of their integer keys: nulls first, rows of a key by their texts.

    A shard is a partition of the sort by ranges, so spark.sql.shuffle.partitions sets their number and
    adaptive execution joins small ones. Rows of a key are split among shards as others are. Null texts are
    empty: they have the end id alone. An empty table gives no shard.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), hashed.alias("h"))
    ordered = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text")
    wide = Encoder(tokenizer).wide or (end or 0) >= 1 << 16
    _write(ordered.select("key", "text"), path, width=4 if wide else 2, tokenizer=tokenizer, end=end, special_as_text=special_as_text)


# the index


_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("row", "<u8"), ("rows", "<u8"), ("offset", "<u8")])
_INDEX = struct.Struct("<8sQII")
_INDEX_MAGIC = b"SFMPHIX1"
#: Bits of a level for each key that is still without one, in percent.
GAMMA = 200
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of hashes, another one for each seed; equal only for equal hashes."""
    a, b, c = (np.uint64(x) for x in _MIX)
    with np.errstate(over="ignore"):
        x = h + c * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * a
        x = (x ^ (x >> np.uint64(27))) * b
    return x ^ (x >> np.uint64(31))


def _places(h: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    return (_mixed(h, level) % np.uint64(n_bits)).astype(np.int64)


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return (_mixed(h, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0 to n-1 of n different 64-bit hashes: at each level keys that are alone at their bit get it, the others go on to the next."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.first = np.concatenate([[0], np.cumsum([s // 64 for s in sizes], dtype=np.int64)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, sizes, words = hashes.astype(np.uint64), [], []
        while len(left):
            n_bits = max(64, -(-len(left) * GAMMA // 6400) * 64)
            at = _places(left, len(sizes), n_bits)
            alone = np.bincount(at, minlength=n_bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(n_bits)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where no level knows it. Hashes that weren't built in get a slot of another or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        hashes = hashes.astype(np.uint64)
        for level, n_bits in enumerate(self.sizes):
            at = _places(hashes[left], level, n_bits)
            word = self.first[level] + (at >> 6)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (self.words[word] & bit) != 0
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(self.words[word[hit]] & (bit[hit] - np.uint64(1)))
            left = left[~hit]
            if not len(left):
                break
        return out


def _index_bytes(hashes: np.ndarray, entries: np.ndarray) -> bytes:
    """An index file: header, sizes of the levels, their bits, slots. entries: the slots' values in the order of the hashes."""
    made = PerfectHash.build(hashes)
    slots = np.zeros(len(hashes), dtype=_SLOT)
    slots[made.slots(hashes)] = entries
    return b"".join([_INDEX.pack(_INDEX_MAGIC, len(hashes), len(made.sizes), 0), np.array(made.sizes, dtype="<u8").tobytes(), made.words.tobytes(), slots.tobytes()])


class Index:
    """Reads an index file. Bits are read at once (some 4 for a key); slots one by one or all."""

    def __init__(self, path: str) -> None:
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        magic, self.n, levels, _ = _INDEX.unpack(self.file.read(_INDEX.size))
        if magic != _INDEX_MAGIC:
            raise OSError(f"{path} is no index of token ids")
        sizes = np.frombuffer(self.file.read(8 * levels), dtype="<u8").astype(np.int64).tolist()
        self.hash = PerfectHash(sizes, np.frombuffer(self.file.read(sum(sizes) // 8), dtype="<u8"))
        self.slots_at = _INDEX.size + 8 * levels + sum(sizes) // 8

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash has a slot with its fingerprint, these slots)."""
        at = self.hash.slots(hashes)
        if len(hashes) < 64:
            got = np.zeros(len(hashes), dtype=_SLOT)
            for i in np.flatnonzero(at >= 0):
                self.file.seek(self.slots_at + int(at[i]) * _SLOT.itemsize)
                got[i] = np.frombuffer(self.file.read(_SLOT.itemsize), dtype=_SLOT)[0]
        else:
            self.file.seek(self.slots_at)
            slots = np.frombuffer(self.file.read(self.n * _SLOT.itemsize), dtype=_SLOT)
            got = slots[np.maximum(at, 0)] if self.n else np.zeros(len(hashes), dtype=_SLOT)
        return (at >= 0) & (got["fingerprint"] == _fingerprints(hashes)), got

    def close(self) -> None:
        self.file.close()


def _bits_of_part(n_keys: int) -> int:
    """Bits of the hash that name the index file: files of KEYS keys or less on average, _LEAST_FILES at least so that tasks share small tables."""
    return (max(_LEAST_FILES, -(-n_keys // KEYS)) - 1).bit_length()


def _part(h: Column | str, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def _put(folder: str, name: str, data: bytes) -> None:
    """A file as a whole, or not at all: tasks that run twice write the same."""
    system, top = file_system(folder)
    hidden = f"{top}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as f:
        f.write(data)
    system.move(hidden, f"{top}/{name}")


def _rows_of_shards(spark: SparkSession, manifest: Manifest) -> DataFrame:
    names = list(enumerate(manifest.names))
    return spark.createDataFrame(names, "shard long, name string").repartition(max(1, min(len(names), 10_000)))


def build_index(spark: SparkSession, path: str) -> None:
    """Index files beside the shards, from their tables alone. Rows whose key is null have no slot: they are the first of all."""
    manifest = Manifest.read(path)
    n_keys = int(manifest.rows.sum() - manifest.nulls.sum())
    bits = _bits_of_part(n_keys)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(f"{path}/{r['name']}")
                edges, keys, null = shard.table()
                shard.close()
                edges, keys = edges[:-1][~null], keys[~null]
                rows = np.flatnonzero(~null)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.full(len(first), r["shard"], np.int64)), pa.array(rows[first]), pa.array(n), pa.array(edges[first])], ["key", "shard", "row", "rows", "offset"])

    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        cols = {c: table.column(c).to_numpy() for c in ("h", "shard", "row", "rows", "offset")}
        order = np.lexsort((cols["shard"], cols["h"]))  # a key that goes on in other shards has an entry of each
        cols = {c: v[order] for c, v in cols.items()}
        first = np.flatnonzero(np.concatenate([[True], cols["h"][1:] != cols["h"][:-1]]))
        hashes = cols["h"][first].view(np.uint64)
        entries = np.zeros(len(first), dtype=_SLOT)
        entries["fingerprint"] = _fingerprints(hashes)
        for c in ("shard", "row", "offset"):
            entries[c] = cols[c][first]
        entries["rows"] = np.add.reduceat(cols["rows"], first)
        _put(path, f"index-{part:05d}.mph", _index_bytes(hashes, entries))
        return pa.table({"keys": pa.array([len(first)], pa.int64())})

    hashed = _rows_of_shards(spark, manifest).mapInArrow(tables, "key long, shard long, row long, rows long, offset long")
    hashed = hashed.select(F.xxhash64("key").alias("h"), "shard", "row", "rows", "offset").withColumn("part", _part("h", bits))
    keys = hashed.groupBy("part").applyInArrow(write, "keys long").agg(F.sum("keys").alias("n")).first().n
    _put(path, "index.json", json.dumps({"bits": bits, "keys": keys or 0}).encode())


def _read_json(path: str, name: str) -> dict:
    system, folder = file_system(path)
    with system.open_input_stream(f"{folder}/{name}") as f:
        return json.loads(f.read())


def _pieces(manifest: Manifest, shard: int, row: int, rows: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first row, rows) of a stretch of rows that may go on in further shards."""
    while rows > 0 and shard < len(manifest.names):
        n = min(rows, int(manifest.rows[shard]) - row)
        if n > 0:
            yield shard, row, n
        shard, row, rows = shard + 1, 0, rows - n


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of the asked keys: (key, shard, row, start, n_tokens, ids). A null asks for the rows without a key; keys not stored give no row.

    A key is asked for once, however often it comes. Keys go to their index file's task, what that finds
    goes to the tasks of the shards, which read in the order of the file. start: ids before the row in all
    shards. ids: binary, little-endian, 4 bytes each.
    """
    manifest, bits = Manifest.read(path), _read_json(path, "index.json")["bits"]
    starts = manifest.starts
    asked = keys.select(F.col(key).cast("long").alias("key")).distinct()
    nulls = int(manifest.nulls.sum())

    def find(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        out: list[tuple] = []
        if part is None:  # the rows without a key are the first
            out = [(None, *p) for p in _pieces(manifest, 0, 0, nulls)]
        else:
            name = f"{path}/index-{part:05d}.mph"
            system, local = file_system(name)
            if system.get_file_info(local).is_file:
                index = Index(name)
                hit, slots = index.find(table.column("h").to_numpy().view(np.uint64))
                index.close()
                asked = table.column("key").to_numpy()[hit].tolist()
                for k, s in zip(asked, slots[hit].tolist(), strict=True):
                    out += [(k, *p) for p in _pieces(manifest, s[1], s[2], s[3])]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("key", "shard", "row", "rows"), cols, strict=True)})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, edges, held, null = -1, None, None, None, None
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "shard", "row", "start", "n_tokens", "ids"])

        for b in batches:
            for k, s, first, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if s != number:
                    if shard is not None:
                        shard.close()
                    number, shard = s, Shard(f"{path}/{manifest.names[s]}")
                    edges, held, null = shard.table()
                for row in range(first, first + n):
                    if bool(null[row]) != (k is None) or k is not None and held[row] != k:
                        continue  # a fingerprint that another key has
                    at, stop = int(edges[row]), int(edges[row + 1])
                    ids = shard.ids(at, stop - at)
                    out.append((k, s, row, int(starts[s]) + at, stop - at, ids.astype("<u4").tobytes()))
                    size += 4 * (stop - at)
                    if size > 8 << 20:
                        yield batch()
                        out, size = [], 0
        if out:
            yield batch()
        if shard is not None:
            shard.close()

    hashed = asked.withColumn("h", F.when(F.col("key").isNotNull(), F.xxhash64("key"))).withColumn("part", _part("h", bits))
    places = hashed.groupBy("part").applyInArrow(find, "key long, shard long, row long, rows long")
    places = places.repartition("shard").sortWithinPartitions("shard", "row")
    return places.mapInArrow(fetch, "key long, shard long, row long, start long, n_tokens long, ids binary")


class Store:
    """Keyed access from one process: get(key) reads an index file's bits once, then a slot, a row and its ids."""

    def __init__(self, path: str) -> None:
        self.path, self.manifest, self.bits = path, Manifest.read(path), _read_json(path, "index.json")["bits"]
        self.open: dict[str, Index | Shard] = {}

    def _opened(self, kind: type, name: str) -> Index | Shard:
        if name not in self.open:
            self.open[name] = kind(f"{self.path}/{name}")
        return self.open[name]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row of a key; none for a key that isn't stored."""
        import xxhash

        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        try:
            index = self._opened(Index, f"index-{h >> (64 - self.bits):05d}.mph")
        except FileNotFoundError:
            return []
        hit, slots = index.find(np.array([h], dtype=np.uint64))
        out = []
        if hit[0]:
            for s, row, n in _pieces(self.manifest, int(slots[0]["shard"]), int(slots[0]["row"]), int(slots[0]["rows"])):
                shard = self._opened(Shard, self.manifest.names[s])
                edges, keys, null = shard.table(row, n)
                out += [shard.ids(int(edges[i]), int(edges[i + 1] - edges[i])) for i in range(n) if keys[i] == key and not null[i]]
        return out

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def op11_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of each document, by its key, from shards that are written first.

    A row for each row: repeated ids give a row each. Nulls in doc_id come first in the shards and are found too.
    """
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    build_shards(docs, path, public_tokenizers.path(tokenizer))
    build_index(spark, path)
    found = lookup(spark, path, docs)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard")
