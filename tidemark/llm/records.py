"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A record file is a sequence of

    uint64 length | uint32 masked crc of those 8 bytes | payload | uint32 masked crc of the payload | LF

all little-endian. The payload is ``uint8 has_id | int64 doc_id | uint64 n_ids | n_ids x uint16``. The mask is
``rotate_right(crc, 15) + 0xa282ead8``: a checksum of data that holds checksums stays meaningful. The line
feed is a fixed end mark, and lets Spark's own text writer put the bytes down: so the files get its
commit protocol on any Hadoop file system, and a lost executor leaves no half-written or double file.

Texts are encoded and framed where they are read; the frames are what is shuffled, to the shard of their id range, and
sorted there. The ranges are quantiles of the ids, joined up to ``shard_bytes`` of text. Each shard is one folder with one file.
The index (Parquet: shard, record, doc_id, offset, length, n_ids, ids_crc32) is made by reading the files back.

Defined cases: a null or empty text is the end id alone; null ids come first; rows of equal id are ordered by
record and each gets one; an empty table gives no files and an empty index. A shard is read back as one value, so the
texts of one id range that no quantile divides (one id, repeated) must stay under 2 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import memo, slices
from tidemark.runtime import scratch_path, ship, small_batches

SHARD_BYTES = 16 << 20  # of text; one shard is read as one value, so this bounds a task's memory. Raise it with that
HEAD, PAYLOAD_HEAD = struct.Struct("<QI"), struct.Struct("<BqQ")
MASK_DELTA = 0xA282EAD8
INDEX = "shard int, record long, doc_id long, offset long, length long, n_ids long, ids_crc32 long"
RECORDS = "shard int, record long, doc_id long, n_ids long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


def pack(doc_id: int | None, ids: bytes) -> bytes:
    return PAYLOAD_HEAD.pack(doc_id is not None, doc_id or 0, len(ids) // 2) + ids


def read_at(content: bytes | memoryview, offset: int) -> tuple[int | None, bytes, int]:
    """The document id, the ids and the next record's offset; checks both checksums and the end mark."""
    length, check = HEAD.unpack_from(content, offset)
    if check != masked(content[offset : offset + 8]):
        raise ValueError(f"damaged length at {offset}")
    begin = offset + HEAD.size
    payload = content[begin : begin + length]
    end = begin + length
    if len(payload) != length or struct.unpack_from("<I", content, end)[0] != masked(payload) or content[end + 4 : end + 5] != b"\n":
        raise ValueError(f"damaged record at {offset}")
    has_id, doc_id, n = PAYLOAD_HEAD.unpack_from(payload)
    ids = bytes(payload[PAYLOAD_HEAD.size :])
    if len(ids) != 2 * n:
        raise ValueError(f"wrong number of ids at {offset}")
    return (doc_id if has_id else None), ids, end + 5


def walk(content: bytes | memoryview) -> Iterator[tuple[int, int, int | None, bytes]]:
    """(offset, length, doc_id, ids) of each record of a file."""
    at = 0
    while at < len(content):
        doc_id, ids, end = read_at(content, at)
        yield at, end - at, doc_id, ids
        at = end


def shard_edges(rows: DataFrame, shard_bytes: int) -> list[int]:
    """The largest id of every shard but the last: quantiles of the ids, neighbours joined up to ``shard_bytes`` of text."""
    size = F.octet_length("text").cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    fine = 4 * max(1, -(-total // shard_bytes))
    cuts = np.asarray(sorted(set(map(int, rows.approxQuantile("doc_id", [i / fine for i in range(1, fine)], 1 / (4 * fine)))) if total > shard_bytes else []), dtype=np.int64)
    if not len(cuts):
        return []

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(cuts) + 1, dtype=np.int64)
        for batch in batches:
            np.add.at(sums, shard_of(batch.column(0), cuts), batch.column(1).to_numpy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["r", "n"])

    sizes = rows.select("doc_id", size.alias("size")).mapInArrow(weigh, "r long, n long").groupBy("r").agg(F.sum("n"))
    weights = dict(map(tuple, sizes.collect()))  # four per shard
    edges, held = [], 0
    for i, cut in enumerate(cuts.tolist()):
        held += weights.get(i, 0)
        if held + weights.get(i + 1, 0) > shard_bytes:
            edges.append(cut)
            held = 0
    return edges


def shard_of(doc_ids: pa.Array, edges: np.ndarray) -> np.ndarray:
    """The number of edges below each id; null ids are in the first range."""
    return np.searchsorted(edges, doc_ids.fill_null(-(1 << 63)).to_numpy(), side="left")


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) and write one record each, in ascending order of id across the shards."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    edges = shard_edges(rows, shard_bytes)
    cuts = np.asarray(edges, dtype=np.int64)
    end = np.asarray([end_id], dtype="<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = memo(vocabulary)
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())
            frames = [frame(pack(d, i + end))[:-1] for d, i in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(batch.column(0), cuts).astype(np.int32)), batch.column(0), pa.array(frames, pa.binary())], ["shard", "doc_id", "frame"])

    framed = rows.mapInArrow(encode, "shard int, doc_id long, frame binary")
    # Shard n goes to partition n, without the sampling pass of a range partitioning, which would encode twice.
    ordered = framed.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame")
    # The text writer adds the line feed that ends each record.
    with small_batches(docs.sparkSession):
        ordered.select("shard", F.col("frame").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("int").alias("shard"), "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records, checked: (shard, record, doc_id, n_ids, ids)."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(d, ids) for _, _, d, ids in walk(memoryview(content.as_buffer()))]
                for at in range(0, len(found), 1024):
                    part = found[at : at + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * len(part), pa.int32()),
                            pa.array(range(at, at + len(part)), pa.int64()),
                            pa.array([d for d, _ in part], pa.int64()),
                            pa.array([len(i) // 2 for _, i in part], pa.int64()),
                            pa.array([i for _, i in part], pa.binary()),
                        ],
                        ["shard", "record", "doc_id", "n_ids", "ids"],
                    )

    return _files(spark, path).mapInArrow(read, RECORDS)


def build_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read the record files, check them, and write their offset index, with a checksum of each record's ids."""
    ship(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(shard, i, d, at, length, len(ids) // 2, wide_crc32(ids)) for i, (at, length, d, ids) in enumerate(walk(memoryview(content.as_buffer())))]
                columns = list(zip(*found, strict=True)) or [[]] * 7
                kinds = [pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "record", "doc_id", "offset", "length", "n_ids", "ids_crc32"])

    _files(spark, path).mapInArrow(scan, INDEX).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def shuffled_reads(index: DataFrame, seed: int = 1) -> DataFrame:
    """A reading order: every record's shard, offset and length, by a seeded random key."""
    return index.select(F.xxhash64(F.lit(seed), "shard", "record").alias("key"), "shard", "offset", "length", "doc_id").orderBy("key")


def read_at_offsets(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records at the (shard, offset) rows of ``wanted``: each file is opened once, at its offsets only."""
    ship(spark)
    offsets = wanted.groupBy("shard").agg(F.collect_list("offset").alias("offsets"))  # at most one shard's records
    files = _files(spark, path).join(offsets, "shard").select("shard", "content", "offsets")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = [(shard, o, *read_at(content, o)[:2]) for o in at]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "offset", "doc_id", "ids"])

    return files.mapInArrow(read, "shard int, offset long, doc_id long, ids binary")


def wide_crc32(ids: bytes) -> int:
    """Checksum of the ids as 32-bit values."""
    return zlib.crc32(np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes())


def document_records(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Contract rows, all read back from the files: from the index that is made of them."""
    path = scratch_path(docs.sparkSession, "records")
    write_records(docs, f"{path}/data", vocabulary)
    index = build_index(docs.sparkSession, f"{path}/data", f"{path}/index")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before.orderBy("shard")), F.lit(0)).alias("base"))  # one row per shard
    local = index.withColumn("local", F.coalesce(F.sum("n_ids").over(before.partitionBy("shard").orderBy("record")), F.lit(0)))
    return local.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
