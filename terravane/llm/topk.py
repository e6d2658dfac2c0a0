"""Exact top-k inner products: candidates in order of falling length, pruned by partial sums and Cauchy-Schwarz.

Components are scaled and floored to integers, so scores are exact. The rotation by the corpus' singular vectors puts most of
every product into its first components; what the rest can add is at most the product of the rests' lengths. Candidates are
ranked by falling length. A first pass scores every query against a block of the longest, which sets a bar: the least length at
which a candidate can still reach the query's k-th best. The others are cut into groups of bounded bytes, of neighbours in
length, and every candidate travels once, to its group's task; a query's row goes to those groups that hold the length it needs.
A task holds its group and streams the queries, by rising need. A run of ``query_block`` queries looks at the blocks of ``block``
candidates that pass its bar; runs that look equally far are multiplied together, first components first, and whole scores are
computed only where the bound leaves a candidate.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part; an empty vector has a product of 0 with
other empty ones; vectors of another dimension than a query's share no product with it; equal scores go by smaller id; a query
is never its own candidate, nor are rows repeated under its id; a repeated query id is one query (its least vector); fewer
candidates than k give fewer ranks; components and scores beyond 64 bits stay at the largest number of their sign.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_view, stash

FIRST = 16
GROUP_BYTES = 1 << 25  # of vectors that a task holds
TILE = 256  # queries multiplied at once
LARGEST = 2.0**62
TOP = (1 << 63) - 1
SLACK = 1e-9  # of a bar, for rounding


def usable(rows: DataFrame, scale: float) -> DataFrame:
    """id, dim, norm and v (little-endian 64-bit integers) of the vectors that take part."""
    given = F.col("vector")
    sound = given.isNotNull() & F.forall(given, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(np.asarray(batch["vector"].offsets))
            flat = np.clip(np.floor(scale * np.asarray(batch["vector"].flatten())), -LARGEST, LARGEST).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), flat.astype(float) ** 2, len(size)))
            raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size.astype(np.int32)), pa.array(norm), pa.array(raw, pa.binary()), batch["is_query"]], names=["id", "dim", "norm", "v", "is_query"])

    return rows.where(sound).mapInArrow(run, "id long, dim int, norm double, v binary, is_query boolean")


def gram(rows: DataFrame) -> dict[int, np.ndarray]:
    """The sum of v v' by dimension: one small matrix a task, added on the driver."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for d in np.unique(dims).tolist():
                m = np.frombuffer(b"".join(batch["v"].filter(pa.array(dims == d)).to_pylist()), np.int64).reshape(-1, d).astype(float)
                sums[d] = sums.get(d, 0) + m.T @ m
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["dim", "g"])

    total: dict[int, np.ndarray] = {}
    for r in rows.where("dim > 0").select("dim", "v").mapInArrow(run, "dim int, g binary").toLocalIterator():
        total[r.dim] = total.get(r.dim, 0) + np.frombuffer(bytes(r.g)).reshape(r.dim, r.dim)
    return total


def products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of rows with rows; those beyond 64 bits stay at the largest number."""
    if not c.size or float(np.abs(c).max()) * float(np.abs(q).max()) * c.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", c, q)
    return np.array([max(-TOP, min(TOP, sum(int(x) * int(y) for x, y in zip(*rows, strict=True)))) for rows in zip(c, q, strict=True)], np.int64)


def search(rows: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, scale: float = 256.0, query_block: int = 1024, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query with all other rows."""
    spark = rows.sparkSession
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    got = stash(usable(given.where("id is not null"), scale), "vectors")
    rotations = {0: np.zeros((0, 0))} | {d: np.linalg.eigh(g)[1][:, ::-1] for d, g in gram(got).items()}
    turn = spark.sparkContext.broadcast(rotations)  # one dim x dim matrix for each dimension
    tasks = 4 * spark.sparkContext.defaultParallelism

    # Longest first. Lengths are levels of a 64th of an octave, so what is ranked is few.
    level = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 64)).otherwise(-9999).cast("int")
    leveled = got.withColumn("level", level)
    step = leveled.groupBy("dim", "level").agg(F.count("*").alias("_n"))
    falling = Window.partitionBy("dim").orderBy(F.desc("level"))
    step = step.withColumn("_before", F.sum("_n").over(falling) - F.col("_n"))
    held = F.least(F.floor(GROUP_BYTES / F.greatest(8 * F.col("dim"), F.lit(64))), F.ceil(F.sum("_n").over(Window.partitionBy("dim")) / tasks))
    step = step.withColumn("_held", F.greatest(held, F.lit(block)))
    part = lambda size: F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / size))
    ranked = leveled.join(step, ["dim", "level"])
    lead = (F.col("_before") < block) & (part(F.lit(block)) == 0)
    cands = ranked.select("id", "dim", "v", "norm", F.floor(F.col("_before") / F.col("_held")).alias("cb"), part(F.col("_held")).alias("part"), lead.alias("lead"))
    cands = stash(cands, "candidates")
    queries = stash(got.where("is_query").groupBy("id", "dim").agg(F.min(F.struct("v", "norm")).alias("q")).select("id", "dim", "q.v", "q.norm"), "queries")
    schema = "query_id long, vec_id long, score long"

    def run(batches):
        held, side, now = [], None, None
        for batch in batches:
            d, g, asks = (np.asarray(batch[c]) for c in ("dim", "g", "asks"))
            starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (asks[1:] != asks[:-1])]) if len(d) else []
            for a, b in zip(starts, [*starts[1:], len(d)], strict=True):
                if now != (d[a], g[a]):
                    held, side, now = [], None, (d[a], g[a])
                some = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((np.array(some["id"]), vectors(some["v"], d[a])))
                elif held:
                    side = side or ordered(held, turn.value[d[a]])
                    least, bar = np.asarray(some["least"]), np.asarray(some["bar"])
                    yield best(np.asarray(some["id"]), vectors(some["v"], d[a]), least, bar, side, turn.value[d[a]], k, query_block, block)

    def meet(candidates: DataFrame, asking: DataFrame, parts: int) -> DataFrame:
        """The k best rows of each group g for the queries sent to it; a group is one task's."""
        sides = candidates.select("dim", "g", F.lit(False).alias("asks"), "id", "v", F.lit(0.0).alias("least"), F.lit(-TOP).alias("bar"))
        both = sides.union(asking.select("dim", "g", F.lit(True).alias("asks"), "id", "v", "least", "bar"))
        return both.repartitionById(parts, F.pmod("g", F.lit(parts)).cast("int")).sortWithinPartitions("dim", "g", "asks", "least").mapInArrow(run, schema)

    # A first pass against one block of the longest candidates gives each query a bar, and so the least length it still needs.
    slices = queries.groupBy("dim").agg(F.least(F.ceil(F.count("*") / query_block), F.lit(tasks)).alias("_m"))
    probes = queries.join(F.broadcast(slices), "dim").withColumn("g", F.pmod(F.xxhash64("id"), F.col("_m")))
    probes = probes.withColumns({"least": F.lit(0.0), "bar": F.lit(-TOP)})
    longest = cands.where("lead").join(F.broadcast(slices), "dim").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    first = stash(meet(longest, probes, tasks), "leads")
    bars = first.groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("found"))
    full = F.col("found") >= k
    least = F.when(full & (F.col("bar") > 0) & (F.col("norm") > 0), (F.col("bar") * (1 - SLACK) - 1e-3) / F.col("norm"))
    needed = queries.join(bars, F.col("id") == F.col("query_id"), "left")
    needed = needed.select("id", "dim", "v", F.coalesce(least, F.lit(0.0)).alias("least"), F.when(full, F.col("bar")).otherwise(-TOP).alias("bar"))

    # Groups are as few as the bytes a task holds allow, a row each on the driver.
    rest = cands.where("not lead")
    groups = sorted(map(tuple, rest.groupBy("dim", "cb", "part").agg(F.max("norm")).collect()))
    numbered = spark.createDataFrame([(n, *g) for n, g in enumerate(groups)], "g long, dim int, cb long, part long, top double")
    tops = F.broadcast(numbered.groupBy("dim").agg(F.collect_list(F.struct("g", "top")).alias("_tops")))
    reached = F.transform(F.filter("_tops", lambda x: x["top"] >= F.col("least")), lambda x: x["g"])
    asking = needed.join(tops, "dim").withColumn("g", F.explode(reached))
    others = rest.join(F.broadcast(numbered.drop("top")), ["dim", "cb", "part"])
    near = first.union(meet(others, asking, min(10_000, max(1, len(groups)))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vectors(col: pa.Array, d: int) -> np.ndarray:
    data, offs = byte_view(col)
    return np.frombuffer(data[offs[0] : offs[-1]].tobytes(), np.int64).reshape(len(col), d)


def turned(x: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths; the first components after the rotation, and beside them the length of the rest."""
    y = x @ rotation
    return np.sqrt((x.astype(float) ** 2).sum(1)), np.column_stack([y[:, :FIRST], np.sqrt((y[:, FIRST:] ** 2).sum(1))])


def ordered(held: list, rotation: np.ndarray) -> tuple:
    """The candidates of one group, longest first: ids, vectors, lengths, heads and the largest component."""
    cid, c = (np.concatenate(x) for x in zip(*held, strict=True))
    norm = np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.lexsort((cid, -norm))
    cid, c = cid[order], c[order]
    return cid, c, *turned(c, rotation), float(np.abs(c).max()) if c.size else 0.0


def best(qid: np.ndarray, q: np.ndarray, least: np.ndarray, bar: np.ndarray, side: tuple, rotation: np.ndarray, k: int, query_block: int, block: int) -> pa.RecordBatch:
    """The k best candidates of one group for each query, those under a query's bar left out; queries come by rising need."""
    norm = side[2]
    length, head = turned(q, rotation)
    # Each run of queries looks at the blocks that its least need leaves; neighbours that look equally far go together.
    first = np.arange(0, len(qid), query_block)
    live = np.minimum(-(-np.searchsorted(-norm, -least[first], "right") // block) * block, len(norm))
    out, a = [], 0
    while a < len(first):
        b = a + 1
        while b < len(first) and live[b] == live[a] and (b - a) * query_block < TILE:
            b += 1
        for i in range(first[a], min(len(qid), first[a] + (b - a) * query_block), TILE):
            cut = slice(i, min(len(qid), first[a] + (b - a) * query_block, i + TILE))
            out.append(tile(qid[cut], q[cut], length[cut], head[cut], bar[cut], side, int(live[a]), k))
        a = b
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])


def tile(qid: np.ndarray, q: np.ndarray, length: np.ndarray, head: np.ndarray, bar: np.ndarray, side: tuple, live: int, k: int) -> tuple:
    """Query ids, candidate ids and scores of the k best among the first candidates."""
    cid, c, norm, head_c, most = side
    small = most * float(np.abs(q).max() if q.size else 0) * q.shape[1] < 2.0**53  # then products of floats are exact
    bar, last = bar.copy(), np.full(len(qid), TOP)  # the k-th score so far and its id
    at, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    lo, size = 0, 64
    while lo < live:
        hi = min(live, lo + size)
        upper = head @ head_c[lo:hi].T
        under = np.where(bar <= -TOP, -np.inf, bar - 1e-3 - SLACK * (np.abs(bar) + 2 * norm[lo] * length))
        passing = upper >= under[:, None]
        if small and np.count_nonzero(passing) * 16 > passing.size:
            score = q.astype(float) @ c[lo:hi].astype(float).T
            i, j = np.nonzero(score >= bar[:, None])
            s = score[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(passing)
            s = np.concatenate([products(c[lo + j[x : x + 65536]], q[i[x : x + 65536]]) for x in range(0, max(1, len(i)), 65536)])
        j = cid[lo + j]
        good = (j != qid[i]) & ((s > bar[i]) | (s == bar[i]) & (j <= last[i]))
        at, ids, scores = np.concatenate([at, i[good]]), np.concatenate([ids, j[good]]), np.concatenate([scores, s[good]])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kth = rank == k - 1
        bar[at[kth]], last[at[kth]] = scores[kth], ids[kth]
        at, ids, scores = at[rank < k], ids[rank < k], scores[rank < k]
        lo, size = hi, min(4096, 4 * size)
    return qid[at], ids, scores
