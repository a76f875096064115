"""Token sequences written in training order: fixed-stride shards that are read in sequence and from any slot on.

Texts become ids, ids of one task's rows a stream that is cut into sequences. Their dense numbers go through a keyed
Feistel permutation; where its power-of-two domain is larger than the number of sequences, it is applied again until the
result is inside (cycle-walking). So every sequence has a global slot without sorting by random numbers, and any slot
can be computed from key and count alone. Ranges of slots are the shards.

A record is a header, the ids padded with zeros, and one line feed, always of the same length, so slot s of a shard that
begins at slot f is at byte (s - f) * stride. Shards are written by Spark's committing writer: a lost executor's tasks
run again and leave one copy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.bpe import load, portions
from tabwright.llm.common import let_go, slices, written
from tabwright.llm.packing import END, id_type
from tabwright.session import scratch_path

LENGTH = 2048
#: sequences in a shard, with 2-byte ids 8.5 MB
PER_SHARD = 2_048
#: texts, and characters of each, that tell which ids are common
SAMPLE, EXCERPT = 300, 2_000
ROUNDS = 6
#: records handled together, which keeps batches on both sides of a task's pipe small
RECORDS = 100
#: sequence number, first document (NO_DOC for null), its first token here, tokens, CRC-32 of the ids as 32-bit integers
HEADER = "<qqqII"
NO_DOC = -(1 << 63)


@dataclass(frozen=True)
class Order:
    """All that a reader needs to know."""

    sequences: int
    length: int
    per_shard: int
    key: int
    ids: str

    @property
    def stride(self) -> int:
        return struct.calcsize(HEADER) + self.length * np.dtype(self.ids).itemsize + 1


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser, as the round function's source of bits."""
    x = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slot_of(number: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of sequence numbers below ``count``: a permutation of 0 .. count-1 that ``key`` selects."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x):
        left, right = x >> bits, x & mask
        for r in range(rounds):
            left, right = right, left ^ (_mix(right, key * 64 + r) & mask)
        return left << bits | right

    out = once(np.asarray(number, np.uint64))
    while (outside := out >= count).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def number_of(slot: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The sequence number in each slot: the inverse of `slot_of`."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x):
        left, right = x >> bits, x & mask
        for r in reversed(range(rounds)):
            left, right = right ^ (_mix(left, key * 64 + r) & mask), left
        return left << bits | right

    out = once(np.asarray(slot, np.uint64))
    while (outside := out >= count).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def common_first(df: DataFrame, path: str, text: str = "text") -> np.ndarray:
    """All ids, those common in a few texts first. Only how small ids get on the way depends on it."""
    texts = df.select(F.substring(F.col(text).cast("string"), 1, EXCERPT)).limit(SAMPLE).collect()
    bpe = load(path)
    met = np.bincount(np.frombuffer(b"".join(bpe.encode_batch([r[0] for r in texts])), "<u4"), minlength=bpe.size)
    return np.argsort(-met, kind="stable").astype(id_type(bpe.size))


def squeezed(places: np.ndarray) -> bytes:
    """Places in the order of `common_first`, compressed: all low bytes, then all higher ones, which are mostly zero."""
    return pa.compress(places.view("u1").reshape(-1, places.itemsize).T.tobytes(), "zstd", asbytes=True)


def restored(packed: bytes, n: int, ids: np.ndarray) -> np.ndarray:
    """The ids of `squeezed` places, given the order."""
    width = ids.itemsize
    flat = np.frombuffer(pa.decompress(packed, n * width, "zstd", asbytes=True), "u1")
    return ids[np.ascontiguousarray(flat.reshape(width, n).T).view(ids.dtype).ravel()]


def sequences(df: DataFrame, path: str, order: np.ndarray, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of sequences: the task that made it (part), its place there, first document and token, number of ids, and the ids.

    The ids are compressed one sequence at a time, and so stay small in the table and in the shuffle after it.
    """
    place_of = np.empty_like(order)
    place_of[order] = np.arange(len(order))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, place = load(path), TaskContext.get().partitionId(), 0
        kind, tail = id_type(bpe.size), np.array([end], "<u4").tobytes()
        width = np.dtype(kind).itemsize * length
        held, begins, base = bytearray(), [], 0  # ids not yet given out, and (document, place of its first id in the stream)

        def cut(all_of_it):
            nonlocal held, begins, base, place
            out, at, k = [], 0, 0
            while len(held) - at >= width or (all_of_it and len(held) > at):
                first = base + at
                while k + 1 < len(begins) and begins[k + 1][1] <= first:
                    k += 1
                out.append((part, place, begins[k][0], (first - begins[k][1]) // np.dtype(kind).itemsize, len(held[at:at + width]) // np.dtype(kind).itemsize, squeezed(place_of[np.frombuffer(bytes(held[at:at + width]), kind)])))
                at, place = min(at + width, len(held)), place + 1
            del held[:at]
            base += at
            while len(begins) > 1 and begins[1][1] <= base:
                begins.pop(0)
            columns = list(zip(*out)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                              ["part", "place", "doc_id", "start", "n", "ids"])

        for b in portions(batches):
            for doc, ids in zip(b.column(0).to_pylist(), bpe.encode_batch(b.column(1).to_pylist())):
                begins.append((doc, base + len(held)))
                held += np.frombuffer(ids + tail, "<u4").astype(kind).tobytes()
            yield cut(False)
        yield cut(True)
        let_go()

    return written(rows.mapInArrow(work, "part int, place long, doc_id long, start long, n int, ids binary"), "sequences", "none")


def write_in_order(df: DataFrame, path: str, tokenizer: str, key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD,
                   doc_id: str = "doc_id", text: str = "text") -> Order:
    """Write all texts of ``df`` as shards below ``path`` and return the order, which is written there too.

    Every text is followed by the end id, so a null or empty text is that one id. The last sequence of each task may be
    shorter; its record is padded. Repeated rows are written each for itself; an empty table writes no shard. Other
    columns are not read.
    """
    spark = df.sparkSession
    ids = common_first(df, tokenizer, text)
    made = sequences(df, tokenizer, ids, length, doc_id=doc_id, text=text)
    parts = made.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task of the scan, which bounds the broadcast
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Order(int(parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), length, per_shard, key, id_type(load(tokenizer).size))
    numbered = made.join(F.broadcast(starts), "part").select((F.col("first") + F.col("place")).alias("number"), "doc_id", "start", "n", "ids")

    @F.pandas_udf("long")
    def slots(number: pd.Series) -> pd.Series:
        return pd.Series(slot_of(number.to_numpy(), order.sequences, key))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load.cache_clear()  # this worker may have encoded before; records need no vocabulary
        let_go()
        for b in slices(batches, RECORDS):
            records = []
            for number, doc, start, n, packed in zip(*[c.to_pylist() for c in b.columns[2:]]):
                own = restored(packed, n, ids)
                head = struct.pack(HEADER, number, NO_DOC if doc is None else doc, start, n, zlib.crc32(own.astype("<u4").tobytes()))
                records.append((head + own.tobytes()).ljust(order.stride - 1, b"\0"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(records, pa.binary())], ["shard", "slot", "record"])
        let_go()

    if order.sequences:
        shards = -(-order.sequences // per_shard)
        (numbered.withColumn("slot", slots("number")).withColumn("shard", F.floor(F.col("slot") / F.lit(per_shard)))
         .repartitionById(shards, F.col("shard").cast("int"))  # a range of slots is a partition
         .select("shard", "slot", "number", "doc_id", "start", "n", "ids").mapInArrow(work, "shard long, slot long, record binary")
         .sortWithinPartitions("shard", "slot")
         .select("shard", F.col("record").cast("string").alias("value"))  # the text writer takes the bytes as they are
         .write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(f"{path}/shards"))
    spark.createDataFrame([tuple(asdict(order).values())], "sequences long, length int, per_shard int, key long, ids string").coalesce(1).write.json(f"{path}/order")
    return order


def read_in_order(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """The sequences of slots ``start`` to before ``end``: slot, shard, byte, sequence_id, doc_id, start, n_tokens, ids, ids_crc32.

    ``ids`` is binary, as written. Only the shards of the range are read, so a stopped run goes on where it was.
    A record that does not hold what its checksum says raises.
    """
    schema = "slot long, shard long, byte long, sequence_id long, doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"
    r = spark.read.schema("sequences long, length int, per_shard int, key long, ids string").json(f"{path}/order").first()
    order = Order(**r.asDict())
    end = order.sequences if end is None else min(end, order.sequences)
    if start >= end:
        return spark.createDataFrame([], schema)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
             .where(F.col("shard").between(start // order.per_shard, (end - 1) // order.per_shard)).select("shard", "content"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            shard, content = b.column(0)[0].as_py(), memoryview(b.column(1)[0].as_buffer())
            first = shard * order.per_shard
            for low in range(0, len(content) // order.stride, RECORDS):
                out = []
                for k in range(low, min(low + RECORDS, len(content) // order.stride)):
                    if start <= first + k < end:
                        at = k * order.stride
                        number, doc, begin, n, crc = struct.unpack_from(HEADER, content, at)
                        raw = bytes(content[at + struct.calcsize(HEADER):at + struct.calcsize(HEADER) + n * np.dtype(order.ids).itemsize])
                        if zlib.crc32(np.frombuffer(raw, order.ids).astype("<u4").tobytes()) != crc:
                            raise ValueError(f"slot {first + k} of shard {shard} is damaged")
                        out.append((first + k, shard, at, number, None if doc == NO_DOC else doc, begin, n, raw, crc))
                kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)],
                                                 ["slot", "shard", "byte", "sequence_id", "doc_id", "start", "n_tokens", "ids", "ids_crc32"])
        let_go()

    return files.mapInArrow(work, schema)


def in_order(df: DataFrame, tokenizer: str, key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write ``df`` in training order below the shared folder and read all of it back."""
    path = scratch_path(df.sparkSession, "training-order")
    write_in_order(df, path, tokenizer, key, length, per_shard)
    return read_in_order(df.sparkSession, path)
