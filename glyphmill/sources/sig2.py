"""Signature datasets as single files ("SIG2"), for exchange; inside the engine they are Parquet.

A file has columns of scales, labels and bands; ids of a band are written as gaps, and numbers as bytes of 7 bits.
Whole columns are encoded and decoded at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytestr import to_byte_string
from ..session import file_system

MAGIC, VERSION = b"SIG2", 2  # fixed values
BANDS = ("L", "C", "R")
SCHEMA = "path string, idx int, scale int, cur_word int, next_word int, L array<int>, C array<int>, R array<int>, size int"


def varints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers in groups of 7 bits, lowest first, the high bit set on all but the last."""
    v = np.asarray(values, np.uint64)
    width = 1 + sum((v >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 5))
    start = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(5):
        has = width > k
        out[start[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(width[has] > k + 1, 128, 0).astype(np.uint64)
    return out.tobytes()


def read_varints(data: np.ndarray, at: int, n: int) -> tuple[np.ndarray, int]:
    """The next n numbers and where they end."""
    if not n:
        return np.zeros(0, np.int64), at
    ends = np.flatnonzero(data[at : at + 5 * n] < 128)
    if len(ends) < n:
        raise ValueError("the file is cut off")
    ends = ends[:n]
    start = np.concatenate(([0], ends[:-1] + 1))
    out = np.zeros(n, np.int64)
    for k in range(5):
        has = start + k <= ends
        out[has] |= (data[at + start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out & 0xFFFFFFFF, at + int(ends[-1]) + 1


@dataclass
class Dataset:
    """A size of the id space, words by id, and records: (scale, cur_word, next_word, L, C, R); a label may be None."""

    size: int
    vocabulary: list[str]
    records: list[tuple]


def encode(data: Dataset) -> bytes:
    """The bytes of a dataset; words are byte strings."""
    columns = list(zip(*data.records, strict=True)) if data.records else [()] * 6
    kinds = [pa.int32()] * 3 + [pa.list_(pa.int32())] * 3
    return encode_columns(data.size, data.vocabulary, [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)])


def encode_columns(size: int, vocabulary: list[str], columns: list[pa.Array]) -> bytes:
    """The bytes of records given as Arrow columns: scale, cur_word, next_word, L, C, R."""
    out = [MAGIC, struct.pack("<BBHIII", VERSION, 0, 0, size, len(vocabulary), len(columns[0]))]
    for word in vocabulary:
        raw = word.encode("latin-1")
        if len(raw) > 0xFFFF:
            raise ValueError("a word is longer than 65535 bytes")
        out += [struct.pack("<H", len(raw)), raw]
    out.append(np.asarray(columns[0].cast(pa.uint8())).tobytes())
    for labels in columns[1:3]:
        out.append(varints(np.asarray(labels.cast(pa.int64()).fill_null(-1)) + 1))
    for band in columns[3:]:
        n = np.asarray(pc.fill_null(pc.list_value_length(band), 0)).astype(np.int64)
        ids = np.asarray(band.flatten()).astype(np.int64)
        gaps = np.diff(ids, prepend=0)
        first = (np.cumsum(n) - n)[n > 0]
        gaps[first] = ids[first]
        out += [varints(n), varints(gaps)]
    return b"".join(out)


def decode_columns(raw: bytes) -> tuple[int, list[str], list[pa.Array]]:
    """The size, the words, and the records as Arrow columns, see encode_columns()."""
    if raw[:4] != MAGIC:
        raise ValueError("this is no SIG2 file")
    if raw[4] != VERSION:
        raise ValueError(f"version {raw[4]} is not known")
    _, _, _, size, words, n = struct.unpack_from("<BBHIII", raw, 4)
    at = 20
    vocabulary = []
    for _ in range(words):
        (length,) = struct.unpack_from("<H", raw, at)
        vocabulary.append(raw[at + 2 : at + 2 + length].decode("latin-1"))
        at += 2 + length
    data = np.frombuffer(raw, np.uint8)
    columns, at = [pa.array(data[at : at + n].astype(np.int32))], at + n
    for _ in range(2):
        v, at = read_varints(data, at, n)
        columns.append(pa.array((v - 1).astype(np.int32), mask=v == 0))
    for _ in BANDS:
        pop, at = read_varints(data, at, n)
        gaps, at = read_varints(data, at, int(pop.sum()))
        edge = np.concatenate(([0], np.cumsum(pop)))
        run = np.cumsum(gaps)
        base = np.repeat(np.concatenate(([0], run))[edge[:-1]], pop)
        columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array((run - base).astype(np.int32))))
    return size, vocabulary, columns


def decode(raw: bytes) -> Dataset:
    size, vocabulary, columns = decode_columns(raw)
    return Dataset(size, vocabulary, list(zip(*(c.to_pylist() for c in columns), strict=True)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, idx, scale, cur_word, next_word, L, C, R, size) of all files under the path, a task a file or more."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "idx", "scale", "cur_word", "next_word", *BANDS, "size"]
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                size, _, columns = decode_columns(content.as_py())
                n = len(columns[0])
                idx, sizes = pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, size, np.int32))
                got = pa.RecordBatch.from_arrays([pa.array([where.as_py()] * n, pa.string()), idx, *columns, sizes], names=names)
                yield from (got.slice(a, 10_000) for a in range(0, n, 10_000))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(part, SCHEMA)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, word_id, word) of the vocabularies of all files under the path; words are byte strings."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                _, words, _ = decode_columns(content.as_py())
                n = len(words)
                yield pa.RecordBatch.from_arrays([pa.array([where.as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(words, pa.string())], names=["path", "word_id", "word"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(part, "path string, word_id int, word string")


def listed_words(vocabulary: DataFrame, most: int = 1_000_000) -> list[str]:
    """The words of (word_id, word) rows with ids dense from 0, as byte strings; every file holds them all, so a
    vocabulary of more than `most` words is refused."""
    rows = vocabulary.select("word_id", to_byte_string(F.col("word")).alias("word")).orderBy("word_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} words")
    if [r["word_id"] for r in rows] != list(range(len(rows))):
        raise ValueError("the ids of the words are not dense from 0")
    return [r["word"] for r in rows]


def write(records: DataFrame, vocabulary: list[str] | DataFrame, size: int, folder: str, per_file: int = 100_000) -> int:
    """SIG2 files of at most per_file of the records (idx, scale, cur_word, next_word, L, C, R); returns their number.

    The folder must be one that all executors share; it is reached by its URL. A file's name tells the partition and
    the place in it, and a file appears whole or not at all, so a task that is run again leaves the same files. The
    records of a partition stand in the order of idx.
    """
    words = vocabulary if isinstance(vocabulary, list) else listed_words(vocabulary)
    shared = records.sparkSession.sparkContext.broadcast(words)
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        task = TaskContext.get()
        made = 0

        def save(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            name = f"{at}/part-{task.partitionId():05d}-{made:05d}.sig2"
            with fs.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as f:
                f.write(encode_columns(size, shared.value, [c.combine_chunks() for c in table.columns]))
            fs.move(f"{name}.{task.taskAttemptId()}.tmp", name)

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, per_file - rows)
                held.append(some)
                rows += some.num_rows
                batch = batch.slice(some.num_rows)
                if rows == per_file:
                    save(held)
                    made, held, rows = made + 1, [], 0
        if rows:
            save(held)
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int32())], names=["n"])

    ordered = records.sortWithinPartitions("idx").select("scale", "cur_word", "next_word", *BANDS)
    return ordered.mapInArrow(part, "n int").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
