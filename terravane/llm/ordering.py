"""Training-order materialisation: token ids in fixed-stride shards, every sequence at a slot of a keyed permutation.

Texts become sequences of up to ``length`` ids (padded), numbered in order of doc_id and text. A keyed Feistel network with
cycle-walking permutes the numbers; a shard is one file that holds a range of slots, each in ``stride`` bytes, so a reader
needs only a slot to resume. Shards are written by Spark's own committer, which a lost executor cannot leave half done: its
text writer ends every record with a line feed, which is the last byte of the stride.

Ids take two bytes, or four where the tokenizer has ids of 0xFFFF and more; the largest number pads. Numbers follow from the rows
alone, so reruns agree whatever the files, splits, partitions and cores.

Edge cases: a null or empty text is one sequence of the end id; a null doc_id comes first; a document longer than a sequence is
cut, never shortened; repeated rows are sequences of their own, alike in all but their slots, and are put in order by one task; an
empty table gives an empty layout. Other columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, freed_shuffles, mix, new_path, stash, text_bytes
from .tokens import END, encoded, largest_id, tokenizer_path

LENGTH, SHARD_BYTES, MOST_SHARDS, ROUNDS = 256, 8 << 20, 1 << 18, 6


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of numbers below n: a Feistel network over the least even number of bits, walked until it is below n again."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([key], np.uint64)))

    def step(v: np.ndarray) -> np.ndarray:
        left, right = v >> U64(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << U64(half)) | right

    out = step(x.astype(np.uint64))
    while True:
        far = np.flatnonzero(out >= U64(n))
        if not len(far):
            return out.astype(np.int64)
        out[far] = step(out[far])


@dataclass
class Layout:
    """Where a materialised corpus is and how slots map to bytes."""

    path: str
    sequences: int
    length: int
    width: int
    per_shard: int
    index: DataFrame

    @property
    def stride(self) -> int:
        return self.length * self.width + 1

    def shard(self, slot: Column) -> Column:
        return F.floor(slot / self.per_shard).cast("long")

    def offset(self, slot: Column) -> Column:
        """Where a slot starts in its shard's file."""
        return (F.pmod(slot, F.lit(self.per_shard)) * self.stride).cast("long")


def _key(x) -> tuple:
    return (0, 0) if x is None else (1, x)


def ranges(docs: DataFrame) -> tuple[list, list[int]]:
    """Where ranges of doc_id start, as many as the session has shuffle partitions, and into how many parts each is cut.

    Only doc_id is read. An id with over twice a range's share of the rows is a range of its own.
    """
    want = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = stash(docs.groupBy("doc_id").count(), "ids")
    share = max(1.0, (ids.agg(F.sum("count")).first()[0] or 0) / want)
    lows = ids.repartitionByRange(want, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low")).collect()  # a row a range
    hot = {_key(r.doc_id): r["count"] for r in ids.where(F.col("count") > 2 * share).collect()}  # half as many as ranges at most
    cuts = sorted({(_key(r.low), 0) for r in lows if r.low is not None} | {(k, side) for k in hot for side in (0, 1)})
    subs = [1] * (len(cuts) + 1)
    for k, n in hot.items():
        subs[bisect_right(cuts, (k, 0))] = math.ceil(n / share)
    return cuts, subs


def materialise(docs: DataFrame, path: str | None = None, key: int = 7, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, tokenizer: str = "word_bpe_49k.json", end: int = END) -> Layout:
    """Write the shards below ``path`` (the shared folder by default); index: doc_id, piece, slot for every sequence.

    Shards take ``shard_bytes``, or more where that would make over MOST_SHARDS of them. Ids are put in order of doc_id and text
    before they are numbered, as the numbers must not depend on how the table is split.
    """
    spark, where = docs.sparkSession, tokenizer_path(tokenizer)
    path = path or new_path(spark, "training-order")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    width = 2 if largest_id(where) < 0xFFFF else 4
    kind = f"<u{width}"

    cuts, subs = ranges(docs)
    base = np.concatenate([[0], np.cumsum(subs)]).tolist()

    def cut(batches):
        """Ids of whole texts, sent to their range of doc_id, where a hot doc_id has several by the hash of its texts."""
        for rows, ids in encoded(batches, where, end):
            at = [bisect_right(cuts, (_key(x), 0)) for x in rows["doc_id"].to_pylist()]
            to = [base[i] + ((v + (1 << 63)) * subs[i] >> 64) for i, v in zip(at, rows["v"].to_pylist(), strict=True)]
            many = np.array([-(-len(x) // (4 * length)) for x in ids], np.int64)
            small = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), rows["v"], pa.array(many), rows["doc_id"], pa.array(small, pa.binary())], names=["task", "v", "many", "doc_id", "ids"])

    def number(batches):
        local = 0
        for batch in batches:
            many = np.asarray(batch["many"])
            before = local + np.cumsum(many) - many
            local += int(many.sum())
            yield pa.RecordBatch.from_arrays([batch["task"], pa.array(before), batch["many"], batch["doc_id"], batch["ids"]], names=["task", "before", "many", "doc_id", "ids"])

    rows = docs.select("doc_id", text_bytes().alias("b")).select("doc_id", F.xxhash64("b").alias("v"), "b")
    sent = rows.mapInArrow(cut, f"task int, v long, many long, doc_id {id_type}, ids binary").repartitionById(base[-1], "task")
    ordered = sent.sortWithinPartitions("doc_id", "v", "ids").mapInArrow(number, f"task int, before long, many long, doc_id {id_type}, ids binary")
    tokens = stash(ordered, "sequences")
    sums = {r.task: r.n for r in tokens.groupBy("task").agg(F.sum("many").alias("n")).collect()}  # a number for each task
    first = np.zeros(max(sums, default=-1) + 2, np.int64)
    first[1:] = np.cumsum([sums.get(t, 0) for t in range(len(first) - 1)])
    n = int(first[-1])
    stride = length * width + 1
    per_shard = max(1, shard_bytes // stride, -(-n // MOST_SHARDS))
    start = spark.sparkContext.broadcast(first)

    def deal(batches):
        """Each task sends a shard one packed value: slots, lengths and ids."""
        held: dict[int, list] = {}
        size = 0

        def out():
            body = []
            for parts in held.values():
                slot, ids = zip(*parts, strict=True)
                head = np.array([len(parts), *slot, *[len(x) // width for x in ids]], np.int64).tobytes()
                body.append(zstandard.ZstdCompressor(level=3).compress(head + b"".join(ids)))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(body, pa.binary())], names=["shard", "body"])

        for batch in batches:
            number = start.value[np.asarray(batch["task"])] + np.asarray(batch["before"])
            many = np.asarray(batch["many"])
            slots = permuted(np.repeat(number - np.cumsum(many) + many, many) + np.arange(many.sum()), n, key).tolist()
            j = 0
            for ids in batch["ids"].to_pylist():
                for a in range(0, len(ids), width * length):
                    held.setdefault(slots[j] // per_shard, []).append((slots[j], ids[a : a + width * length]))
                    j += 1
                size += len(ids)
            if size > 16 << 20:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    def gather(batches):
        """The records of one shard in order of their slots."""
        shard = TaskContext.get().partitionId()
        whole = np.full((min(per_shard, n - shard * per_shard), length), -1, f"<i{width}").view(kind)
        for batch in batches:
            for body in batch["body"].to_pylist():
                raw = zstandard.ZstdDecompressor().decompress(body)
                m = int(np.frombuffer(raw, np.int64, 1)[0])
                slot, size = np.frombuffer(raw, np.int64, m, 8), np.frombuffer(raw, np.int64, m, 8 + 8 * m)
                ids = np.frombuffer(raw, kind, int(size.sum()), 8 + 16 * m)
                at = np.repeat(slot - shard * per_shard, size) * length + np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
                whole.ravel()[at] = ids
        for a in range(0, len(whole), 4096):
            part = whole[a : a + 4096]
            offsets = pa.py_buffer((np.arange(len(part) + 1, dtype=np.int32) * (width * length)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(part), [None, offsets, pa.py_buffer(part.tobytes())])], names=["value"])

    if n:
        dealt = tokens.select("task", "before", "many", "ids").mapInArrow(deal, "shard int, body binary").repartitionById(-(-n // per_shard), "shard")
        with freed_shuffles(spark):
            dealt.select("body").mapInArrow(gather, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path)

    def listed(batches):
        for batch in batches:
            many = np.asarray(batch["many"])
            owner = np.repeat(np.arange(batch.num_rows), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            slot = permuted((start.value[np.asarray(batch["task"])] + np.asarray(batch["before"]))[owner] + piece, n, key)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(slot)], names=["doc_id", "piece", "slot"])

    index = tokens.select("task", "before", "many", "doc_id").mapInArrow(listed, f"doc_id {id_type}, piece int, slot long")
    return Layout(path, n, length, width, per_shard, index)


def globs(first: int, last: int) -> list[str]:
    """Patterns for the numbers from first to last as Spark names its files: five digits, or more where they need more."""
    out = []
    while first <= last:
        k = 0
        while k < 5 and first % 10 ** (k + 1) == 0 and first + 10 ** (k + 1) - 1 <= last:
            k += 1
        name = f"{first:05d}"
        out.append(name[: len(name) - k] + "[0-9]" * k)
        first += 10**k
    return out


def read_slots(spark: SparkSession, layout: Layout, first: int, last: int, schema: str, emit) -> DataFrame:
    """What emit(slots, padded ids, sizes) makes of the slots from first to before last, run by run; only their shards are opened."""
    per, length, stride, width = layout.per_shard, layout.length, layout.stride, layout.width
    if first >= last:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load([f"{layout.path}/part-{g}-*" for g in globs(first // per, (last - 1) // per)])
    files = files.select(F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("long").alias("shard"), "content")
    pad = (1 << 8 * width) - 1

    def read(batches):
        for batch in batches:
            for shard, body in zip(batch["shard"].to_pylist(), batch["content"], strict=True):
                raw = np.frombuffer(body.as_buffer(), np.uint8).reshape(-1, stride)
                for a in range(0, len(raw), 4096):
                    table = np.ascontiguousarray(raw[a : a + 4096, :-1]).view(f"<u{width}")
                    slots = shard * per + a + np.arange(len(table))
                    mine = (slots >= first) & (slots < last)
                    if mine.any():
                        yield emit(slots[mine], table[mine], (table[mine] != pad).sum(1))

    return files.mapInArrow(read, schema)


def sequences(spark: SparkSession, layout: Layout, first: int = 0, last: int | None = None) -> DataFrame:
    """slot, ids (bytes, padding off) as the shards hold them; a read resumes at any slot."""

    def emit(slots, table, size):
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array([x[:n].tobytes() for x, n in zip(table, size, strict=True)], pa.binary())], names=["slot", "ids"])

    return read_slots(spark, layout, first, layout.sequences if last is None else last, "slot long, ids binary", emit)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, piece, slot, shard, offset, length, ids_crc32 (of the ids as the shard holds them) of every sequence."""
    layout = materialise(docs, **options)

    def emit(slots, table, size):
        sums = [zlib.crc32(x[:n].tobytes()) for x, n in zip(table, size, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(size.astype(np.int64)), pa.array(sums, pa.int64())], names=["_slot", "length", "ids_crc32"])

    read = read_slots(docs.sparkSession, layout, 0, layout.sequences, "_slot long, length long, ids_crc32 long", emit)
    slot = F.col("slot")
    return layout.index.join(read, slot == F.col("_slot")).select("doc_id", "piece", "slot", layout.shard(slot).alias("shard"), layout.offset(slot).alias("offset"), "length", "ids_crc32")
