"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds documents in ascending identifier order:

    magic  8 bytes, "KNTOK001"
    ids    little-endian unsigned 16-bit (or 32-bit) ids of all documents, one after another
    sections of the Elias-Fano sequences: document boundaries (0 and the end of each document), and
           the identifiers that aren't null, less the smallest
    footer JSON with the places of all sections, then its length in 8 bytes

An Elias-Fano sequence of n values below u keeps floor(log2(u/n)) low bits of each value packed and the
rest as a unary bit vector of about 2n bits, with the place of every 256th one bit stored in 32 bits:
select(i) decodes one value from at most 256 one bits, select(i, j) a run of them. All reading goes through
it, a block of documents at a time; no table of 64-bit offsets is ever made.

Null text is an empty document (its end id only). Null identifiers come first. Rows that tie in
identifier are ordered by their ids; if they fill several files, first by a hash of ids and place in the input. Repeated rows are documents of their own. Empty input makes no
file and gives an empty result. Other columns are not read.

A task that is run again writes a file of another name; the manifest, which Spark commits, names the
files that count. Memory: the ids of a file are streamed to it; only lengths and identifiers are held.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, group_order, range_groups, scratch_path, table, tie_of
from .tokenizing import END_ID, tokenizer, vocabulary_path

MAGIC = b"KNTOK001"
SAMPLE = 256
#: Documents of a file, about.
FILE_DOCS = 8192


class EliasFano:
    """A non-decreasing sequence of integers from 0; encode() and the constructor's buffers are inverse."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict, list[bytes]]:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = np.zeros((n, bits), dtype=np.uint8)
        for b in range(bits):
            low[:, b] = (v >> np.uint64(b)) & np.uint64(1)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        if n and ones[-1] >= 1 << 32:
            raise ValueError(f"{n} values are too many for one sequence")
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        parts = [np.packbits(low.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()]
        return {"n": n, "low_bits": bits}, parts

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int, stop: int | None = None) -> int | np.ndarray:
        """Value i, or those from i up to `stop`, from the sampled place before i."""
        end = i + 1 if stop is None else stop
        if not 0 <= i < end <= self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE + end - i
        found, byte, skip = [], at >> 3, at & 7
        while left > 0:
            # as many bytes as hold the missing ones if all of their bits are set, or a cache line
            take = max(64, left >> 3)
            bits = np.unpackbits(self.high[byte : byte + take], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)[:left]
            found.append(ones + byte * 8)
            left, byte, skip = left - len(ones), byte + take, 0
        index = np.arange(i, end, dtype=np.int64)
        values = ((np.concatenate(found)[i % SAMPLE :] - index) << self.low_bits) | self._low(index)
        return int(values[0]) if stop is None else values

    def all(self) -> np.ndarray:
        """Every value, for short sequences."""
        return self.select(0, self.n) if self.n else np.zeros(0, dtype=np.int64)

def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FileWriter:
    """Streams documents into one file under `folder`."""

    def __init__(self, folder: str, name: str, dtype: np.dtype):
        self.fs, base = _filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{folder}/{name}-{uuid.uuid4().hex}.ktok"
        self.out = self.fs.open_output_stream(f"{base}/{self.path.rpartition('/')[2]}")
        self.out.write(MAGIC)
        self.dtype, self.lengths, self.ids, self.nulls = dtype, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.lengths.append(len(ids) // self.dtype.itemsize)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        ends = np.concatenate([[0], np.cumsum(np.array(self.lengths, dtype=np.int64))])
        least = self.ids[0] if self.ids else 0
        at = len(MAGIC) + int(ends[-1]) * self.dtype.itemsize
        foot = {"docs": len(self.lengths), "tokens": int(ends[-1]), "width": self.dtype.itemsize, "nulls": self.nulls, "least": least}
        # identifiers may span more than 63 bits: Python integers until they are relative
        relative = np.array([i - least for i in self.ids], dtype=np.uint64)
        for name, values in (("ends", ends), ("doc_ids", relative)):
            head, parts = EliasFano.encode(values)
            foot[name] = head | {"at": [at + sum(map(len, parts[:i])) for i in range(4)]}
            at += sum(map(len, parts))
            for p in parts:
                self.out.write(p)
        raw = json.dumps(foot).encode()
        self.out.write(raw + struct.pack("<Q", len(raw)))
        self.out.close()
        return self.path, len(self.lengths), int(ends[-1])


class FileReader:
    """Random access to a file: doc_id(i), bounds(i), tokens(i)."""

    def __init__(self, path: str):
        fs, base = _filesystem(path)
        self.file = fs.open_input_file(base)
        size = self.file.size()
        (n,) = struct.unpack("<Q", self._read(size - 8, size))
        self.foot = json.loads(self._read(size - 8 - n, size - 8))
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        self.dtype = np.dtype(f"<u{self.foot['width']}")
        self.ends, self.doc_ids = (EliasFano(s["n"], s["low_bits"], *(self._read(*s["at"][i : i + 2]) for i in range(3))) for s in (self.foot["ends"], self.foot["doc_ids"]))

    def _read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(stop - start)

    def __len__(self) -> int:
        return self.foot["docs"]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.foot["nulls"] else self.doc_ids.select(i - self.foot["nulls"]) + self.foot["least"]

    def some_doc_ids(self, i: int, stop: int) -> list[int | None]:
        nulls = self.foot["nulls"]
        known = self.doc_ids.select(max(i, nulls) - nulls, stop - nulls).tolist() if stop > nulls else []
        return [None] * (min(stop, nulls) - min(i, nulls)) + [x + self.foot["least"] for x in known]

    def bounds(self, i: int) -> tuple[int, int]:
        return tuple(self.ends.select(i, i + 2).tolist())

    def slice(self, start: int, stop: int) -> np.ndarray:
        w, first = self.dtype.itemsize, len(MAGIC)
        return np.frombuffer(self._read(first + start * w, first + stop * w), dtype=self.dtype)

    def tokens(self, i: int) -> np.ndarray:
        return self.slice(*self.bounds(i))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(id, ids binary) with the end id appended."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        end = np.array([end_id], dtype=t.dtype).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [x + end for x in t.encode(v or "" for v in part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, file_docs: int = FILE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents and return the manifest (file_no, path, docs, tokens), a table. Files follow one another in identifier order.

    File numbers come from quantiles of the identifiers alone; texts are tokenized where they are read and only
    their ids move, once. Rows that share an identifier are dealt to several files if they are many.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    ids = docs.select(F.col(id_col).alias("id"))
    rows = encode_documents(docs, id_col, text_col, path)
    rows = range_groups(rows, ids, file_docs, tie_of("ids"), "file_no")
    files = -(-ids.count() // file_docs)
    parts = max(1, min(files, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, dtype = None, None, tokenizer(path).dtype

        def row(no, done):
            return pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int64()), "path": [done[0]], "docs": pa.array([done[1]], pa.int64()), "tokens": pa.array([done[2]], pa.int64())})

        for b in batches:
            for no, doc_id, ids in zip(*(b.column(c).to_pylist() for c in ("file_no", "id", "ids")), strict=True):
                if no != now:
                    if out:
                        yield row(now, out.close())
                    out, now = FileWriter(folder, f"{no:020d}", dtype), no
                out.add(doc_id, ids)
        if out:
            yield row(now, out.close())

    sorted_rows = rows.repartition(parts, "file_no").sortWithinPartitions("file_no", F.asc_nulls_first("id"), "ids")
    return table(sorted_rows.mapInArrow(write, "file_no long, path string, docs long, tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files; start counts over all files."""
    spark = manifest.sparkSession
    order = group_order(manifest.select(F.col("file_no").alias("grp"), "tokens"), F.col("tokens"))
    files = manifest.join(order, F.col("file_no") == F.col("grp")).select("path", F.col("before").alias("base"))
    files = files.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                f = FileReader(path)
                for i in range(0, len(f), 512):
                    stop = min(i + 512, len(f))
                    e, ids = f.ends.select(i, stop + 1), f.some_doc_ids(i, stop)
                    all_ids = f.slice(int(e[0]), int(e[-1])).astype("<u4")
                    crc = [zlib.crc32(all_ids[x:y]) for x, y in zip((e[:-1] - e[0]).tolist(), (e[1:] - e[0]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + e[:-1], pa.int64()), pa.array(np.diff(e), pa.int64()), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    return read_token_files(write_token_files(documents(spark, sf_dir), folder)).withColumnRenamed("id", "doc_id")
