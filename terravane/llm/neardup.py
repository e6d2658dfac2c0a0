"""Near-duplicate classes by DartMinHash signatures, bands, and an exact check.

A text is the weighted set of its runs of five words: each weighs as often as it occurs (or 1, with ``weights="set"``). Every element throws darts into
the region [0, weight) x [0, rank) of an endless plane that its hash fixes; a coordinate keeps the dart of least rank, so two
texts agree on a coordinate with the probability of their weighted Jaccard similarity, and a text costs its length plus
k ln k darts instead of k hashes a word. Bands of coordinates give candidates; those of a bucket are compared with its least
member, and beyond that only where the triangle inequality of the Jaccard distance leaves a link open.

Edge cases: equal texts are one node and share a class; a null text or one without words is alone unless its text is
repeated (null never is); a text under five words is one element; different texts that share a doc_id are compared each on
its own; a class is named by its least doc_id that is not null, so rows of a class of null ids alone get null; ``keep_one``
keeps one row of a class, repeated rows included, and rows of null texts as they are; an empty table gives no rows. Other
columns do not matter. No bucket is cut and no candidate is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.neighbours import least_labels
from .common import U64, blocks, boxed, byte_view, mix, per_row, prefix_hash, span_hash, stash, unboxed, words

WIDTH, COORDINATES, BANDS = 5, 128, 32
MASK = (1 << 64) - 1


def shingles(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, occurrences) of the distinct runs of ``width`` words, sorted by row and hash."""
    start, end, row = words(data, offs)
    h = span_hash(prefix_hash(data), start, end)
    n, count = len(h), per_row(row, len(offs) - 1)
    lengths = np.minimum(count, width)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    runs = np.zeros(n, np.uint64)
    reach = lengths[row] if n else np.zeros(0, np.int64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for j in range(width):
        runs = np.where(j < reach, runs * U64(0x9E3779B97F4A7C15) + padded[j : j + n], runs)
    keep = np.arange(n) - (first[row] if n else 0) <= (count - lengths)[row] if n else np.zeros(0, bool)
    row, runs = row[keep], mix(runs[keep] + reach[keep].astype(np.uint64))
    order = np.lexsort((runs, row))
    row, runs = row[order], runs[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (runs[1:] != runs[:-1])
    at = np.flatnonzero(new)
    return row[at], runs[at], np.diff(np.concatenate([at, [len(row)]]))


def dart_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """n signatures of k 64-bit dart names; rows without elements keep zeros. Weights are positive numbers.

    The plane of an element is cut into strips of weight 1; in each, darts arrive along the rank axis as a Poisson process
    of rate 1, each with a coordinate and a height in the strip from its hash. Ranks below t / total weight give about t
    darts a row; rows that still miss a coordinate look twice as far.
    """
    out = np.zeros((n, k), np.uint64)
    total = per_row(row, n, weight)
    reach = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    strips = np.ceil(weight).astype(np.int64)
    strip = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
    row, element, weight = np.repeat(row, strips), np.repeat(element, strips), np.repeat(weight, strips)
    seed = mix(element + strip.astype(np.uint64) * U64(0xA0761D6478BD642F))
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[row])
        rank = np.zeros(len(live))
        found: list[tuple] = []
        i = 0
        while len(live):
            i += 1
            name = mix(seed[live] + U64(i * 0xE7037ED1A0B428DB & MASK))
            rank = rank - np.log1p(-((name >> U64(11)).astype(np.float64) * 2.0**-53))
            inside = rank < reach[row[live]]
            live, rank, name = live[inside], rank[inside], name[inside]
            draw = mix(name ^ U64(0x8EBC6AF09C88C6E3))
            hit = strip[live] + (draw >> U64(40)).astype(np.float64) * 2.0**-24 < weight[live]
            at = live[hit]
            found.append((row[at] * k + (draw[hit] % U64(k)).astype(np.int64), rank[hit] / reach[row[at]], name[hit]))
        slot, rank, name = (np.concatenate([f[j] for f in found]) for j in range(3))
        order = np.lexsort((rank, slot))
        slot, name = slot[order], name[order]
        least = np.ones(len(slot), bool)
        least[1:] = slot[1:] != slot[:-1]
        out.ravel()[slot[least]] = name[least]
        hits = np.bincount(slot[least] // k, minlength=n)
        todo &= hits < k
        reach = reach * 2
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash for each band of a signature, different between bands."""
    n, k = signature.shape
    parts = signature.reshape(n, bands, k // bands)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands))
    for j in range(k // bands):
        h = mix(h * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h


def text_hash() -> Column:
    """16 bytes that name a text, null for a null text."""
    return F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)


def signatures(docs: DataFrame, weights: str = "count") -> DataFrame:
    """doc_id, text_hash (null for a null text), weight (of all shingles), bands (empty where there are no words)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, data, offs in blocks(batch["b"], 1 << 20):
                row, h, times = shingles(data, offs)
                n = b - a
                each = times.astype(float) if weights == "count" else np.ones(len(h))
                count = per_row(row, n, each).astype(np.int64)
                sig = dart_minhash(row, h, each, n)
                bands = band_hashes(sig).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(count > 0, bands.shape[1], 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands[count > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, n), batch["text_hash"].slice(a, n), pa.array(count, pa.int64()), lists], names=["doc_id", "text_hash", "weight", "bands"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    return rows.mapInArrow(run, f"doc_id {id_type}, text_hash binary, weight long, bands array<long>")


def occurrences(row: np.ndarray, h: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted, with a name of its own for each occurrence of a shingle: plain sets of these have the weighted similarity."""
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row, h = np.repeat(row, times), np.repeat(h, times)
    h = np.where(nth > 0, mix(h + nth.astype(np.uint64) * U64(0xA0761D6478BD642F)), h)
    order = np.lexsort((h, row))
    return row[order], h[order]


def shingle_sets(docs: DataFrame, nodes: DataFrame, weights: str = "count") -> DataFrame:
    """(id, set) of nodes (node, text_hash, least): sorted 64-bit shingle hashes as bytes, of the text under its least doc_id."""
    wanted = nodes.select("node", F.col("text_hash").alias("_hash"), "least")
    texts = docs.select("doc_id", text_hash().alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    texts = texts.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "b")

    def sets(batches):
        for batch in batches:
            for a, b, data, offs in blocks(batch["b"]):
                row, h, times = shingles(data, offs)
                if weights == "count":
                    row, h = occurrences(row, h, times)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch["node"].slice(a, b - a), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in range(b - a)], pa.binary())], names=["id", "set"])

    return texts.mapInArrow(sets, "id long, set binary").dropDuplicates(["id"])


def jaccard(x: bytes, y: bytes) -> float:
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, s) for pairs (a, b) of ids: the exact Jaccard similarity of their sets."""
    id_type = pairs.schema["a"].dataType.simpleString()

    def compare(batches):
        for batch in batches:
            s = [jaccard(x, y) for x, y in zip(batch["left"].to_pylist(), batch["right"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(s, pa.float64())], names=["a", "b", "s"])

    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(compare, f"a {id_type}, b {id_type}, s double")


def open_links(placed: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, tile: int = 1 << 18) -> DataFrame:
    """Links (a, b) between members of a bucket in different components that the star of its centre left open.

    placed: band, node, n, s (similarity to the bucket's centre), component. A bucket of up to ``tile`` shingles is one group.
    In a larger one the heaviest component needs no look at itself: its members and those of all others are laid out in tiles
    of about ``tile`` shingles, and only pairs of tiles with one of the others meet, each in a group of its own. A group returns
    links that join components and no more. A pair is looked at in the first band it shares, and only if its sizes and the
    triangle inequality of the Jaccard distance allow a link.
    """
    id_type = nodes.schema["node"].dataType.simpleString()
    shares = placed.groupBy("band", "component").agg(F.sum("n").alias("w"), F.count("*").alias("m"))
    mixed = shares.groupBy("band").agg(F.max(F.struct("w", "component")).alias("home"), F.sum("w").alias("all"), F.sum("m").alias("m"), F.count("*").alias("parts")).where("parts > 1 and m > 2")
    small = F.col("all") <= tile
    others, tiles = F.when(small, 1).otherwise(F.ceil((F.col("all") - F.col("home.w")) / tile)), F.when(small, 0).otherwise(F.ceil(F.col("home.w") / tile))
    mixed = mixed.select("band", F.col("home.component").alias("home"), others.cast("long").alias("others"), tiles.cast("long").alias("tiles"))
    h = F.xxhash64("node")
    at_home = (F.col("component") == F.col("home")) & (F.col("tiles") > 0)
    rows = placed.join(mixed, "band").withColumn("mine", F.when(at_home, F.col("others") + F.pmod(h, F.col("tiles"))).otherwise(F.pmod(h, F.col("others"))))
    most = F.when(at_home, F.col("others")).otherwise(F.col("others") + F.col("tiles"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    rows = rows.select("band", F.least("mine", "j").alias("i"), F.greatest("mine", "j").alias("k"), "mine", "node", "n", "s", "component")
    rows = rows.join(nodes.select("node", "bands"), "node").join(sets.withColumnRenamed("id", "node"), "node")
    apart = 1 - threshold + 1e-9

    def links(key, table):
        band, i, k = (x.as_py() for x in key)
        t = {c: np.asarray(table[c]) for c in ("mine", "n", "s", "component", "node")}
        bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(t["node"]), -1)
        data, offs = byte_view(table["set"].combine_chunks())
        hashes, cut = data[offs[0] : offs[-1]].view(np.uint64), (offs - offs[0]) // 8
        there = np.flatnonzero(t["mine"] == k)
        # The shingles of one tile in order, with the member that holds each: a member of the other counts its own among them.
        owner = np.repeat(np.arange(len(there)), np.diff(cut)[there])
        held = np.concatenate([hashes[cut[y] : cut[y + 1]] for y in there] or [hashes[:0]])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        # Links that join what earlier ones have joined say nothing new: each component goes by the one it has been joined to.
        _, part = np.unique(t["component"], return_inverse=True)
        joined = np.arange(part.max(initial=0) + 1)
        found: list[tuple] = []
        for x in np.flatnonzero(t["mine"] == i).tolist():
            ok = (joined[part[there]] != joined[part[x]]) & (np.minimum(t["n"][there], t["n"][x]) >= threshold * np.maximum(t["n"][there], t["n"][x])) & (np.abs(t["s"][there] - t["s"][x]) <= apart)
            if i == k:
                ok &= there > x
            ok[ok] = bands[x][(bands[there[ok]] == bands[x]).argmax(1)] == band
            if not ok.any():
                continue
            mine = hashes[cut[x] : cut[x + 1]]
            low = np.searchsorted(held, mine, "left")
            many = np.searchsorted(held, mine, "right") - low
            hits = np.bincount(owner[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=len(there))
            y = there[ok]
            for other in y[hits[ok] >= threshold * (len(mine) + np.diff(cut)[y] - hits[ok])].tolist():
                if joined[part[other]] != joined[part[x]]:
                    joined[joined == joined[part[other]]] = joined[part[x]]
                    found.append((min(t["node"][x], t["node"][other]), max(t["node"][x], t["node"][other])))
        return pa.table({"a": pa.array([a for a, _ in found], table["node"].type), "b": pa.array([b for _, b in found], table["node"].type)})

    return rows.groupBy("band", "i", "k").applyInArrow(links, f"a {id_type}, b {id_type}")


def classified(docs: DataFrame, threshold: float = 0.8, weights: str = "count") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash), and for each text (text_hash, class_id, chosen): the least doc_id of its class, and whether the class goes by this text."""
    seen = stash(signatures(docs, weights), "signatures", gather=True)
    # Written down, so that joins with it can split the rows of a text that very many documents hold, and numbers stay.
    first = seen.where("text_hash is not null").groupBy("text_hash").agg(F.min("doc_id").alias("least"))
    first = stash(first.withColumn("node", F.monotonically_increasing_id()), "texts")
    nodes = seen.where("weight > 0").join(first, "text_hash").where("doc_id <=> least")
    nodes = stash(nodes.select("node", F.col("weight").alias("n"), "bands").dropDuplicates(["node"]), "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    members = stash(banded.join(buckets.select("band", "centre"), "band"), "buckets")
    sets = stash(shingle_sets(docs, first.join(members.select("node").distinct(), "node"), weights), "shingle-sets")

    star = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    scored = stash(similarities(star, sets), "star")
    links = scored.where(F.col("s") >= threshold).select("a", "b")
    labels = least_labels(links)
    placed = members.where("node <> centre").join(scored.select(F.col("a").alias("centre"), F.col("b").alias("node"), "s"), ["centre", "node"]).select("band", "node", "n", "s")
    placed = placed.union(members.where("node = centre").select("band", "node", "n", F.lit(1.0)))
    placed = stash(placed.join(labels, "node", "left").select("band", "node", "n", "s", F.coalesce("label", "node").alias("component")), "placed")
    more = stash(open_links(placed, nodes, sets, threshold).distinct(), "open-links")
    if not more.isEmpty():
        labels = least_labels(links.union(more))
    ends = first.join(labels, "node")
    named = ends.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("_none"), "least", "node")).alias("_head"))
    linked = ends.join(named, "label").select(F.col("node").alias("_node"), "_head")
    both = first.join(linked, F.col("node") == F.col("_node"), "left")
    alone = F.col("_head").isNull()
    classes = both.select("text_hash", F.when(alone, F.col("least")).otherwise(F.col("_head.least")).alias("class_id"), (alone | (F.col("_head.node") == F.col("node"))).alias("chosen"))
    return seen.select("doc_id", "text_hash"), classes


def near_duplicates(docs: DataFrame, threshold: float = 0.8, weights: str = "count") -> DataFrame:
    """doc_id, class_id for every row: the least doc_id of those that chains of links at the threshold or equal texts reach."""
    seen, classes = classified(docs, threshold, weights)
    return seen.join(classes, "text_hash", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = 0.8, weights: str = "count") -> DataFrame:
    """The documents less all but one row (of the least doc_id, and of one text under it) of each near-duplicate class."""
    seen, classes = classified(docs, threshold, weights)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("chosen")
    named = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("key").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    rows = boxed(docs, key=docs["doc_id"], hash=text_hash())
    kept = rows.join(named(seen.join(classes, "text_hash").where(~stays)), same, "left_anti")
    twins = stash(seen.where("text_hash is not null").groupBy("doc_id", "text_hash").count().where("count > 1"), "twins")
    if not twins.isEmpty():
        kept = kept.join(named(twins), same, "left_anti").union(kept.join(named(twins), same, "left_semi").dropDuplicates(["key", "hash"]))
    return unboxed(kept, docs.columns)
