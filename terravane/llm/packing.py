"""Best-fit packing by exact-complement hashing over the histogram of piece lengths.

A plan is made from counts by length alone (``capacity`` numbers, whatever the size of the corpus): the longest length left
opens a sequence, the gap is looked up in indexes of the sums of one, two and three lengths, and a combination that fills it
exactly is used as often as the counts of its lengths allow; gaps that nothing fills exactly take the longest length that fits
(best fit). Pieces then find their place by their rank among the pieces of their length.

Edge cases: a null or empty text is one piece of length 1; longer documents alone are cut; pieces of equal length are ranked
by doc_id and piece, repeated rows in any order; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .tokens import pieces

CAPACITY = 4096


class Sums:
    """Counts of lengths that are left, and indexes from a sum to the one, two or three lengths that make it.

    An index's entries for a sum are listed when it is first asked for, best last, and go once their counts are used up:
    counts only fall. ``used`` holds what the sequence at hand has taken already.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).tolist()
        self.lengths = np.flatnonzero(counts)
        self.alive = self.lengths.tolist()
        self.pairs: dict[int, list[int]] = {}  # sum: the larger of two lengths
        self.triples: dict[int, list[int]] = {}  # sum: the largest of three lengths

    def free(self, n: int, used: dict) -> int:
        return self.left[n] - used.get(n, 0) if 0 < n < len(self.left) else 0

    def single(self, total: int, used: dict) -> tuple | None:
        return (total,) if self.free(total, used) > 0 else None

    def pair(self, total: int, used: dict, most: int | None = None) -> tuple | None:
        if total not in self.pairs:
            a = self.lengths[np.searchsorted(self.lengths, (total + 1) // 2) : np.searchsorted(self.lengths, total)]
            self.pairs[total] = a[np.isin(total - a, self.lengths, assume_unique=True)].tolist()
        held = self.pairs[total]
        while held and not self.both(held[-1], total - held[-1], {}):
            held.pop()
        dead = 0
        for a in reversed(held):
            if (most is None or a <= most) and self.both(a, total - a, used):
                return a, total - a
            dead += not self.both(a, total - a, {})
        if 2 * dead > len(held):
            self.pairs[total] = [a for a in held if self.both(a, total - a, {})]
        return None

    def both(self, a: int, b: int, used: dict) -> bool:
        return self.free(a, used) > (a == b) and self.free(b, used) > 0

    def triple(self, total: int, used: dict) -> tuple | None:
        if total not in self.triples:
            self.triples[total] = self.lengths[np.searchsorted(self.lengths, -(-total // 3)) : np.searchsorted(self.lengths, total - 1)].tolist()
        held = self.triples[total]
        while held and not self.left[held[-1]]:
            held.pop()
        for a in reversed(held):
            if self.free(a, used) > 0 and (found := self.pair(total - a, used | {a: used.get(a, 0) + 1}, a)):
                return (a, *found)
        # Nothing makes the sum now: of its entries only those stay that a later sequence, which has taken others, may use.
        self.triples[total] = [a for a in held if self.left[a] and self.pairs.get(total - a, True)]
        return None

    def largest(self, most: int, used: dict) -> int:
        i = bisect_right(self.alive, most) - 1
        while i >= 0 and self.free(self.alive[i], used) <= 0:
            i -= 1
        return self.alive[i] if i >= 0 else 0

    def take(self, used: dict) -> int:
        """How often a sequence of these lengths can be made; all of them are taken."""
        times = min(self.left[k] // n for k, n in used.items())
        for k, n in used.items():
            self.left[k] -= n * times
            if not self.left[k]:
                del self.alive[bisect_left(self.alive, k)]
        return times


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); counts[n] is the number of pieces of length n.

    Each step uses up at least one length, but for what a length's own multiples leave, so steps follow the capacity.
    """
    sums, out = Sums(counts), []
    for first in range(capacity, 0, -1):
        while sums.left[first] > 0:
            chosen, used, gap = [first], {first: 1}, capacity - first
            while gap:
                fill = sums.single(gap, used) or sums.pair(gap, used) or sums.triple(gap, used)
                if not fill:
                    best = sums.largest(gap, used)
                    fill = (best,) if best else None
                if not fill:
                    break
                for n in fill:
                    chosen.append(n)
                    used[n] = used.get(n, 0) + 1
                    gap -= n
            out.append((tuple(chosen), sums.take(used)))
    return out


def runs(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces of ranks ``rank`` and on of a length go to sequences ``sequence`` and on, at ``offset``."""
    rows, used, sequence = [], {}, 0
    for chosen, times in planned:
        offset = 0
        for n in chosen:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "rank": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3]}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), which must be a table that rereads alike.

    Ranks come from counts by (length, salt), so a length that many pieces share is ranked by many tasks. A length has 4,096 salts
    at most, whose sums one task adds up.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in cut.groupBy("length").count().collect():  # one number a length: capacity rows at most
        counts[n] = c
    found = runs(plan(counts, capacity))
    salts = max(1, min(4096, math.ceil(counts.sum() / 1000)))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    heads = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    heads = heads.select(F.col("length").alias("_length"), F.col("_salt").alias("_s"), (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in cut.columns]))
    ranked = salted.join(heads, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_before") + local - 1)
    plan_rows = cut.sparkSession.sparkContext.broadcast(found)  # a few runs a length

    def run(batches):
        p = plan_rows.value
        key = (p["length"] << 44) + p["rank"]
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["_rank"])
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            keep = [c for c in batch.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*cut.columns, "_rank").mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return place(stash(pieces(docs, capacity, tokenizer), "pieces", gather=True), capacity)
