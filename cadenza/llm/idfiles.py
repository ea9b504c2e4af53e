"""Token ids of a corpus in binary files: one id array per file, document boundaries in Elias-Fano form.

Documents are dealt out by ranges of doc_id and sorted, so file after file the ids stand in ascending doc_id order. A task
starts a new file after FILE_IDS ids; it may hold one document of any length more. The files become visible through a
manifest table that Spark commits: files of failed or repeated attempts have other names and are never read.

File: magic, nine unsigned 64-bit numbers (documents, null doc_ids, ids, bytes per id, smallest doc_id, and the sizes of
the four parts), then boundaries, doc_ids (both Elias-Fano) and ids (unsigned 16 or 32 bit, little-endian).

Null texts are empty (only the end id). Null doc_ids come first; repeated doc_ids keep one entry per row, ordered by a
hash of their text. Very long texts are one document of a file; an empty table gives no files and no rows; other columns are
ignored, whatever their names."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, map_texts, new_folder, text_bytes
from .tokens import WordIds

MAGIC = b"CDZIDS1\n"
FILE_IDS = 4 << 20
SAMPLE = 256  # a select sample for every so many entries
MANIFEST = "part int, file int, path string, documents long, ids long"


class EliasFano:
    """An ascending list of n numbers below u in about n * (2 + log2(u / n)) bits, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, int(v[-1] // max(n, 1)).bit_length() - 1) if n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4") if not n or ones[-1] < 1 << 32 else ones[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        parts = [a.tobytes() for a in (self.low, self.high, self.samples)]
        return struct.pack("<QQQQQQ", self.n, self.low_bits, *map(len, parts), self.samples.itemsize) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, bits, a, b, c, width = struct.unpack_from("<QQQQQQ", data)
        return cls(n, bits, np.frombuffer(data, np.uint8, a, 48), np.frombuffer(data, "<u8", b // 8, 48 + a), np.frombuffer(data, f"<u{width}", c // width, 48 + a + b))

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | low

    def select(self, i: int) -> int:
        """The i-th number, from its sample and the words after it."""
        at, seen = int(self.samples[i // SAMPLE]), i - i % SAMPLE
        word = at // 64
        bits = int(self.high[word]) >> at % 64 << at % 64
        while seen + bits.bit_count() <= i:
            seen += bits.bit_count()
            word += 1
            bits = int(self.high[word])
        for _ in range(i - seen):
            bits &= bits - 1
        high = word * 64 + (bits & -bits).bit_length() - 1 - i
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8
        return high << self.low_bits | low & (1 << self.low_bits) - 1


class IdFile:
    """One file's content, ready for reading by document number."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an id file")
        self.documents, self.nulls, n, width, self.first, a, b, _, _ = struct.unpack_from("<QQQQqQQQQ", data, 8)
        self.bounds, self.names = EliasFano.from_bytes(data[80 : 80 + a]), EliasFano.from_bytes(data[80 + a : 80 + a + b])
        self.ids = np.frombuffer(data, f"<u{width}", n, 80 + a + b)

    @staticmethod
    def pack(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
        """doc_ids ascend, nulls first; ids are unsigned 32-bit little-endian."""
        nulls = sum(x is None for x in doc_ids)
        first = doc_ids[nulls] if nulls < len(doc_ids) else 0
        names = EliasFano.of(np.array(doc_ids[nulls:], np.int64) - first).to_bytes()
        bounds = EliasFano.of(np.cumsum([0, *(len(x) // 4 for x in ids)])).to_bytes()
        flat = np.frombuffer(b"".join(ids), "<u4")
        width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
        head = MAGIC + struct.pack("<QQQQqQQQQ", len(doc_ids), nulls, len(flat), width, first, len(bounds), len(names), len(flat) * width, 0)
        return head + bounds + names + flat.astype(f"<u{width}").tobytes()

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.names.select(i - self.nulls)

    def doc_ids(self) -> list[int | None]:
        return [self.doc_id(i) for i in range(self.documents)]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> str:
    """Writes the ids of every document, each followed by end_id; returns the folder."""
    folder = folder or new_folder(docs.sparkSession, "ids")

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        words, end, part_no = WordIds.of(tokenizer), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        fs, path = file_system(folder)
        fs.create_dir(path)
        names, held, size, made = [], [], 0, 0

        def flush() -> dict:
            nonlocal names, held, size, made
            name = f"ids-{part_no:06d}-{made:06d}-{uuid.uuid4().hex[:12]}.bin"
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(IdFile.pack(names, held))
            row = {"part": [part_no], "file": [made], "path": [name], "documents": [len(names)], "ids": [size // 4]}
            names, held, size, made = [], [], 0, made + 1
            return row

        for part in parts:
            texts = [t or b"" for t in text_bytes(part["text"])]
            for doc_id, ids in zip(part["doc_id"].to_pylist(), words.texts(texts)):
                names.append(doc_id)
                held.append(ids + end)
                size += len(held[-1])
                if size >= 4 * FILE_IDS:
                    yield flush()
        if names:
            yield flush()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    map_texts(ordered, ["doc_id", "text"], work, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


READ_IDS = 32 << 20  # ids that one task reads, about


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with_ids the ids, read from the files.

    Files are dealt to as many tasks as their ids ask for. A document's place is selected from the boundaries; they are
    never expanded."""
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    count, ids = files.agg(F.count("*"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-ids // READ_IDS))))

    def work(parts: Iterator[dict]) -> Iterator[dict]:
        fs, path = file_system(folder)
        for part in parts:
            for name, base in zip(part["path"].to_pylist(), part["base"].to_pylist()):
                with fs.open_input_stream(f"{path}/{name}") as source:
                    file = IdFile(source.read())
                for first in range(0, file.documents, 4096):
                    some = range(first, min(first + 4096, file.documents))
                    at = [file.bounds.select(i) for i in (*some, some[-1] + 1)]
                    cut = [file.ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:])]
                    out = {"doc_id": [file.doc_id(i) for i in some], "start": [a + base for a in at[:-1]], "n_tokens": [len(x) // 4 for x in cut], "ids_crc32": list(map(zlib.crc32, cut))}
                    yield out | ({"ids": [np.frombuffer(x, "<i4") for x in cut]} if with_ids else {})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_texts(files.repartition(tasks, "path"), ["path", "base"], work, schema)
