"""A binary format of token ids with a shared zstandard dictionary.

A data set is a folder of two Parquet tables. ``dictionary`` has one row: the dictionary's
bytes and their sha256. ``blocks`` has a row for up to ``BLOCK`` documents in ascending doc_id
order: the documents' ids and token counts, the byte offset of each document's frame (one
more entry at the end), the payload of frames, how many ids stand before it in its part, and
the dictionary's sha256. Each frame is one document's ids, little-endian, compressed by
itself against the dictionary, so one short document is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import bucket_count, new_path
from .tokenfiles import chunk_encoder, default_path

VOCABULARY = "byte_bpe_50k.json"
END = 2
BLOCK = 256
#: The dictionary is trained on so many documents (by hash of their id), so much of each.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 2_000, 4_000, 64 << 10
LEVEL = 3


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from a bounded sample; empty if there is too little to learn from."""
    chosen = docs.where("length(text) > 0").select(
        F.xxhash64("doc_id").alias("h"), "doc_id"
    ).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id").distinct()
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    sample = rows.orderBy("doc_id", "text").limit(SAMPLE).collect()  # ids may repeat
    encode = chunk_encoder(path, spaced=True)
    ids = [narrow(encode(r.text)) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ids)[:DICTIONARY_BYTES] if sum(map(len, ids)) >= 8 else b""


def narrow(ids: bytes) -> bytes:
    """uint32 ids as uint16 after a mark where all fit, else unchanged after another."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def widen(data: bytes) -> bytes:
    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes() if data[0] == 2 else data[1:]


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Write the token ids of docs (doc_id, text; each then ``end``) as a data set in folder.

    Null and empty texts have the end id only. Rows are ordered by doc_id (null first), rows
    of one doc_id by text; repeated rows are all kept; an empty table makes a data set
    without blocks. Other columns are ignored.
    """
    path = path or default_path(VOCABULARY)
    spark = docs.sparkSession
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    dictionary = train_dictionary(slim, path)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame(
        [(name, bytearray(dictionary))], "sha256 string, dictionary binary"
    ).coalesce(1).write.parquet(f"{folder}/dictionary")
    tail = np.array([end], "<u4").tobytes()

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(path, spaced=True)
        press = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        ).compress
        part, block, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, BLOCK):
                some = [encode(x.as_py()) + tail for x in texts.slice(at, BLOCK)]
                frames = [press(narrow(x)) for x in some]
                offsets = np.cumsum([0, *map(len, frames)])
                counts = [len(x) // 4 for x in some]
                own = batch.column("doc_id").slice(at, BLOCK)
                row = {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "n_ids": pa.array([sum(counts)], pa.int64()),
                    "first_id": own.slice(0, 1),
                    "last_id": own.slice(len(own) - 1, 1),
                    "dictionary": pa.array([name]),
                    "doc_ids": pa.array([own.to_pylist()], pa.list_(pa.int64())),
                    "counts": pa.array([counts], pa.list_(pa.int32())),
                    "offsets": pa.array([offsets.tolist()], pa.list_(pa.int64())),
                    "payload": pa.array([b"".join(frames)], pa.binary())
                }
                yield pa.RecordBatch.from_pydict(row)
                block, before = block + 1, before + sum(counts)

    schema = "part int, block int, before long, n_ids long, first_id long, last_id long, dictionary string, doc_ids array<long>, counts array<int>, offsets array<long>, payload binary"
    ordered = slim.repartitionByRange(
        bucket_count(docs), "doc_id", F.xxhash64("text")
    ).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(encode_part, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.sha256:
        raise ValueError("the dictionary's bytes don't have its hash")
    return row.sha256, bytes(row.dictionary)


def _frames(row_counts: list[int], offsets: list[int], payload: bytes, expand) -> Iterator[bytes]:
    for n, a, z in zip(row_counts, offsets[:-1], offsets[1:], strict=True):
        ids = widen(expand(payload[a:z], max_output_size=4 * n + 1))
        if len(ids) != 4 * n:
            raise ValueError("a frame doesn't hold as many ids as its index says")
        yield ids


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, read from the files."""
    name, dictionary = _dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per written file
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_before"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(
            dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        ).decompress
        for batch in batches:
            doc, start, count, crc = [], [], array("q"), array("q")
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("a block was written with another dictionary")
                at = row["at"]
                doc.extend(row["doc_ids"])
                for ids in _frames(row["counts"], row["offsets"], row["payload"], expand):
                    start.append(at)
                    count.append(len(ids) // 4)
                    crc.append(zlib.crc32(ids))
                    at += len(ids) // 4
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc, pa.int64()),
                    "start": pa.array(start, pa.int64()),
                    "n_tokens": pa.array(count, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64())
                }
            )

    joined = blocks.join(F.broadcast(before), "part").select(
        (F.col("before") + F.col("part_before")).alias("at"), "dictionary", "doc_ids", "counts", "offsets", "payload"
    )
    return joined.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of each row with this doc_id; other blocks are skipped by their first and last id."""
    name, dictionary = _dictionary(spark, folder)
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
    found = []
    for row in spark.read.parquet(f"{folder}/blocks").where(
        (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    ).orderBy("part", "block").collect():
        if row.dictionary != name:
            raise ValueError("a block was written with another dictionary")
        for i, own in enumerate(row.doc_ids):
            if own == doc_id:
                frame = _frames(row.counts[i : i + 1], row.offsets[i : i + 2], bytes(row.payload), expand)
                found += [np.frombuffer(x, "<u4").tolist() for x in frame]
    return found


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs' token ids to a new data set in the shared folder, and read it back."""
    folder = new_path(docs.sparkSession, "tokens")
    write(docs, folder, path)
    return read_digests(docs.sparkSession, folder)
