"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

Suffixes are ranked by growing prefixes and leave when their rank is unique: first sampled ones by ``gram`` bytes, then the
pair of that rank and the rank of all bytes up to the next sample, and where that still leaves a choice every suffix by
``length`` bytes. Ranks are 64-bit names of strings, so tasks agree on them without a global numbering; equal strings are
told by 96 bits of hashes, not byte by byte. Positions travel packed by bucket and are sorted there; every task ranks its own
rows first. ``plain`` ranks every position at doubled offsets instead, by joins alone; it gives the same rows and is there to
hold the other against.

Edge cases: doc_id is a number; a null text is empty; a null doc_id is the least; texts under ``length`` bytes never match; repeated rows of one
doc_id and text stand at one place, so neither is earlier; very long texts are read in overlapping slices; an empty table
gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import U64, blocks, mix, prefix_hash, span_hash, stash, text_bytes

LENGTH, GRAM = 100, 36
PLACE_BITS = 22


def units(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, most: int = 1 << 19):
    """Yield (row, bytes before, bytes, offsets) pieces of a block: the block whole, or slices of one long row that overlap."""
    if len(offs) > 2 or offs[-1] <= 2 * most:
        yield 0, 0, data, offs
        return
    for a in range(0, max(1, int(offs[-1]) - length + 1), most):
        part = data[a : a + most + length - 1]
        yield 0, a, part, np.array([0, len(part)], np.int64)


def sampled(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of a block: runs of ``length``-byte windows that share their sampled suffix.

    The sampled suffix of a window is the leftmost of least hash among the ``gram``-byte strings inside it, so equal windows
    sample at equal places. Returns row, low and high (first and last window start, from the block's start), name (hash of
    the first ``gram`` bytes of the sampled suffix) and long_name (hash of all bytes under the segment's windows).
    """
    n = len(data)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    starts = np.arange(max(0, n - length + 1))
    ok = starts + length <= offs[1:][row[starts]] if len(starts) else np.zeros(0, bool)
    empty = {k: np.zeros(0, np.int64) for k in ("row", "low", "high")} | {k: np.zeros(0, np.uint64) for k in ("name", "long_name")}
    if not ok.any():
        return empty
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    name = span_hash(prefix, at, at + gram)
    least = (name >> U64(PLACE_BITS) << U64(PLACE_BITS)) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least & U64((1 << PLACE_BITS) - 1)).astype(np.int64)[starts]
    keep = np.flatnonzero(ok)
    place, home = place[keep], row[keep]
    new = np.ones(len(keep), bool)
    new[1:] = (place[1:] != place[:-1]) | (home[1:] != home[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(keep)]]) - 1
    low, high = keep[first], keep[last]
    return {"row": home[first], "low": low, "high": high, "name": name[place[first]], "long_name": span_hash(prefix, low, high + length)}


HOT = 64
FLAT = "doc_id long, version long, item long"
FLAT_ARROW = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("item", pa.int64())])
REMOVED, OPEN, OPEN_HOT, MARK = 0, 1, 2, 3


def pack(doc: np.ndarray, version: np.ndarray, **columns: np.ndarray) -> bytes:
    """Columns of one bucket as one compressed value; documents are stored once, in order."""
    ids, at = np.unique(np.stack([doc, version]), axis=1, return_inverse=True) if len(doc) else (np.zeros((2, 0), np.int64), doc)
    order = np.lexsort((columns["low"], at))
    step = np.diff(at[order], prepend=0).astype(np.uint32)
    parts = [np.int64(ids.shape[1]).tobytes(), np.int64(len(doc)).tobytes(), ids.astype(np.int64).tobytes(), step.tobytes()]
    parts += [np.ascontiguousarray(c[order]).tobytes() for c in columns.values()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(bodies: list[bytes], **kinds: type) -> dict[str, np.ndarray]:
    found: dict[str, list] = {k: [] for k in ("doc", "version", *kinds)}
    for body in bodies:
        raw = zstandard.ZstdDecompressor().decompress(body)
        docs, n = np.frombuffer(raw, np.int64, 2)
        ids = np.frombuffer(raw, np.int64, 2 * docs, 16).reshape(2, docs)
        place = 16 + 16 * int(docs)
        at = np.cumsum(np.frombuffer(raw, np.uint32, n, place), dtype=np.int64)
        place += 4 * int(n)
        found["doc"].append(ids[0][at])
        found["version"].append(ids[1][at])
        for k, kind in kinds.items():
            found[k].append(np.frombuffer(raw, kind, n, place))
            place += int(n) * np.dtype(kind).itemsize
    return {k: np.concatenate(v) for k, v in found.items()}


def items(low: np.ndarray, high: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """A run of window starts and what is known of it, in one number."""
    return (low.astype(np.int64) << 24) | ((high - low).astype(np.int64) << 2) | kind


def earliest(doc: np.ndarray, low: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: is its string met for the first time here, and is it later than that first place."""
    order = np.lexsort((low, doc, *names))
    same = np.ones(max(0, len(order) - 1), bool)
    for x in names:
        same &= x[order[1:]] == x[order[:-1]]
    head = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    lead = order[head][group]
    first, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order] = head
    later[order] = (doc[order] != doc[lead]) | (low[order] != low[lead])
    return first, later


def flat(doc: np.ndarray, version: np.ndarray, item: np.ndarray) -> pa.Table:
    return pa.table([pa.array(doc, pa.int64()), pa.array(version, pa.int64()), pa.array(item, pa.int64())], schema=FLAT_ARROW)


def texts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id (null as the least number), version (a hash of the text, for rows that share a doc_id), b; row: the other columns."""
    rest = [F.struct(F.col("text").isNull().alias("is_null"), *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]).alias("row")] if whole else []
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), text_bytes().alias("b"), *rest)


def routed(rows: dict[str, np.ndarray], to: np.ndarray, names: list[str], buckets: int):
    """One packed row for each bucket that ``rows`` reach."""
    to = (to % U64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(buckets + 1))
    full = [i for i in range(buckets) if ends[i + 1] > ends[i]]
    body = []
    for i in full:
        pick = order[ends[i] : ends[i + 1]]
        body.append(pack(rows["doc"][pick], rows["version"][pick], **{k: rows[k][pick] for k in names}))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(body, pa.binary())], names=["bucket", "body"])


SEGMENT = {"name": np.uint32, "long_name": np.uint64, "low": np.uint32, "span": np.uint16, "kind": np.uint8}
WINDOW = {"name": np.uint32, "full": np.uint64, "low": np.uint32, "span": np.uint16, "kind": np.uint8}


def rank_segments(source: DataFrame, buckets: int, length: int, gram: int, hot: int) -> DataFrame:
    """First ranking: sampled suffixes by their first ``gram`` bytes and, paired with that, by all bytes of their segment.

    A task ranks its own rows before it sends any: of equal segments only the earliest goes on, and a name with over ``hot``
    different segments is spread by segment and only marked at its own bucket, so no bucket holds a common passage whole.
    Returns runs of windows: REMOVED (an equal segment is earlier) or open (their name has other segments).
    """

    def settle(parts: list[dict]):
        r = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        first, later = earliest(r["doc"], r["low"], r["name"], r["long_name"])
        keep = ~later
        r["kind"] = np.where(later, REMOVED, OPEN).astype(np.uint8)
        names, at, count = np.unique(np.where(first, r["name"], 0), return_inverse=True, return_counts=True)
        many = (count > hot)[at] & keep
        r["kind"][many] = OPEN_HOT
        to = np.where(many, mix(r["name"] ^ mix(r["long_name"])), np.where(later, mix(r["doc"].astype(np.uint64)), r["name"]))
        marks = np.flatnonzero(many & first)
        marks = marks[np.unique(r["name"][marks], return_index=True)[1]]
        r = {k: np.concatenate([v, v[marks]]) for k, v in r.items()}
        if len(marks):
            r["kind"][-len(marks) :] = MARK
        to = np.concatenate([to, r["name"][len(to) :]])
        r["name"] = (r["name"] >> U64(32)).astype(np.uint32)
        r["low"] = r["low"].astype(np.uint32)
        return routed(r, to >> U64(8), list(SEGMENT), buckets)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids, versions = np.asarray(batch["doc_id"]), np.asarray(batch["version"])
            for a, _, data, offs in blocks(batch["b"], 1 << 19):
                for _, skip, piece, cut in units(data, offs, length):
                    s = sampled(piece, cut, length, gram)
                    low = s["low"] - cut[s["row"]]
                    parts.append({"doc": ids[a + s["row"]], "version": versions[a + s["row"]], "name": s["name"], "long_name": s["long_name"], "low": low + skip, "span": (s["high"] - s["low"]).astype(np.uint16)})
                    held += len(low)
            if held > 400_000:
                yield settle(parts)
                parts, held = [], 0
        if held:
            yield settle(parts)

    def rank(table):
        r = unpack(table["body"].to_pylist(), **SEGMENT)
        low, high = r["low"].astype(np.int64), r["low"].astype(np.int64) + r["span"]
        gone = r["kind"] == REMOVED
        marked = np.unique(r["name"][r["kind"] == MARK])
        live = np.flatnonzero(~gone & (r["kind"] != MARK))
        first, later = earliest(r["doc"][live], low[live], r["name"][live], r["long_name"][live])
        _, at, count = np.unique(r["name"][live[first]], return_inverse=True, return_counts=True)
        is_hot = (r["kind"][live[first]] == OPEN_HOT) | np.isin(r["name"][live[first]], marked)
        open_ = live[first][(count > 1)[at] | is_hot]
        hot_open = is_hot[(count > 1)[at] | is_hot]
        out = [(np.flatnonzero(gone), REMOVED), (live[later], REMOVED), (open_[~hot_open], OPEN), (open_[hot_open], OPEN_HOT)]
        pick = np.concatenate([x for x, _ in out])
        kind = np.concatenate([np.full(len(x), k) for x, k in out])
        return flat(r["doc"][pick], r["version"][pick], items(low[pick], high[pick], kind))

    return source.select("doc_id", "version", "b").mapInArrow(run, "bucket long, body binary").groupBy("bucket").applyInArrow(rank, FLAT)


def per_document(source: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts with the list of their items."""
    lists = found.groupBy(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).agg(F.collect_list("item").alias("items"))
    return source.join(lists, (F.col("doc_id") == F.col("_d")) & (F.col("version") == F.col("_v")), how).select(*source.columns, "items")


def rank_windows(source: DataFrame, open_: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Last ranking: every window of the open segments by all its bytes, its name a pair of names of overlapping halves.

    Windows that may be equal share their sampled suffix and go to its bucket, or to their own name's if that suffix is hot.
    Returns runs of windows that are not the first of their string.
    """
    half = (length + gram) // 2

    def names(prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
        gram_at = lambda x: span_hash(prefix, x, x + gram)
        half_at = lambda x: mix(gram_at(x) * U64(0x9E3779B97F4A7C15) + gram_at(x + half - gram))
        return mix(half_at(at) * U64(0x9E3779B97F4A7C15) + half_at(at + length - half))

    def settle(parts: list[dict]):
        r = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        _, later = earliest(r["doc"], r["low"], r["name"], r["full"])
        r["kind"] = np.where(later, REMOVED, OPEN).astype(np.uint8)
        to = np.where(later, mix(r["doc"].astype(np.uint64)), np.where(r.pop("hot"), mix(r["full"]), r["name"]))
        r["name"] = (r["name"] >> U64(32)).astype(np.uint32)
        r["span"] = np.zeros(len(to), np.uint16)
        r["low"] = r["low"].astype(np.uint32)
        return routed(r, to >> U64(8), list(WINDOW), buckets)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids, versions = np.asarray(batch["doc_id"]), np.asarray(batch["version"])
            marks, ends = np.asarray(batch["items"].flatten()), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(batch["items"])))])
            for a, b, data, offs in blocks(batch["b"], 1 << 19):
                for _, skip, piece, cut in units(data, offs, length):
                    mine = marks[ends[a] : ends[b]]
                    owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                    s = sampled(piece, cut, length, gram)
                    where = (s["row"] << 40) | (s["low"] - cut[s["row"]] + skip)
                    want = (owner << 40) | (mine >> 24)
                    order = np.argsort(want)
                    at = np.minimum(np.searchsorted(want[order], where), max(0, len(want) - 1))
                    hit = (want[order][at] == where) if len(want) else np.zeros(len(where), bool)
                    is_hot = (mine[order][at[hit]] & 3) == OPEN_HOT
                    seg = np.flatnonzero(hit)
                    size = (s["high"] - s["low"])[seg] + 1
                    low = np.repeat(s["low"][seg] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    row = np.repeat(s["row"][seg], size)
                    parts.append({"doc": ids[a + row], "version": versions[a + row], "name": np.repeat(s["name"][seg], size), "full": names(prefix_hash(piece), low), "low": low - cut[row] + skip, "hot": np.repeat(is_hot, size)})
                    held += len(low)
                if held > 400_000:
                    yield settle(parts)
                    parts, held = [], 0
        if held:
            yield settle(parts)

    def rank(table):
        r = unpack(table["body"].to_pylist(), **WINDOW)
        low = r["low"].astype(np.int64)
        gone = np.flatnonzero(r["kind"] == REMOVED)
        live = np.flatnonzero(r["kind"] != REMOVED)
        _, later = earliest(r["doc"][live], low[live], r["name"][live], r["full"][live])
        pick = np.concatenate([gone, live[later]])
        doc, version, low = r["doc"][pick], r["version"][pick], low[pick]
        order = np.lexsort((low, version, doc))
        doc, version, low = doc[order], version[order], low[order]
        new = np.ones(len(low), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (low[1:] > low[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.concatenate([a[1:], [len(low)]]) - 1
        return flat(doc[a], version[a], items(low[a], low[b], REMOVED))

    both = per_document(source, open_, "inner")
    return both.mapInArrow(run, "bucket long, body binary").groupBy("bucket").applyInArrow(rank, FLAT)


def doubled(source: DataFrame, length: int, first: int = 4) -> DataFrame:
    """Runs of windows whose string also starts earlier, by plain prefix doubling: a position's rank is the least position of its string.

    Pairs of ranks at growing offsets are ranked anew; what is unique leaves, and so does a position whose other half has left.
    """
    size = F.octet_length("b")
    live = source.where(size >= length).select("doc_id", "version", size.alias("n"), "b", F.explode(F.sequence(F.lit(0), size - 1)).alias("low"))
    live = live.select("doc_id", "version", "n", "low", F.expr(f"substring(b, low + 1, {first})").alias("left"), F.lit(None).cast("int").alias("right"))
    have = first
    while True:
        every = Window.partitionBy("left", "right")
        ranked = live.select("doc_id", "version", "n", "low", F.min(F.struct("doc_id", "low")).over(every).alias("rank"), F.count("*").over(every).alias("many"))
        ranked = stash(ranked.where("many > 1").drop("many"), "ranks")
        if have == length:
            break
        step = min(have, length - have)
        there = ranked.select("doc_id", "version", (F.col("low") - step).alias("low"), F.col("rank").alias("right"))
        live = ranked.withColumnRenamed("rank", "left").join(there, ["doc_id", "version", "low"], "left").where(F.col("right").isNotNull() | (F.col("low") + step >= F.col("n")))
        have += step
    later = ranked.where((F.col("low") <= F.col("n") - length) & (F.struct("doc_id", "low") > F.col("rank")))
    return later.select("doc_id", "version", F.shiftleft(F.col("low").cast("long"), 24).alias("item"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, whole: bool = False, plain: bool = False) -> DataFrame:
    """doc_id, version, b (and row) and items: each text with the runs of its windows whose string also starts earlier (null: none)."""
    source = texts(docs)
    if plain:
        return per_document(texts(docs, whole), doubled(source, length), "left")
    total = source.agg(F.coalesce(F.sum(F.octet_length("b")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (32 << 20)))
    ranked = stash(rank_segments(source, buckets, length, gram, hot), "suffix-segments")
    kind = F.col("item").bitwiseAND(3)
    more = rank_windows(source, ranked.where(kind.isin(OPEN, OPEN_HOT)), buckets, length, gram)
    return per_document(texts(docs, whole), ranked.where(kind == REMOVED).union(more), "left")


def cut_out(size: int, found: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Which bytes stay, and how many maximal runs are removed."""
    low, high = found >> 24, (found >> 24) + ((found >> 2) & ((1 << 22) - 1)) + length
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return ~gone, spans


def digests(docs: DataFrame, length: int = LENGTH, plain: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""

    def run(batches):
        for batch in batches:
            out = []
            for body, found in zip(batch["b"], batch["items"], strict=True):
                raw = body.as_buffer()
                found = np.asarray(found.values) if found.is_valid else ()
                if len(found):
                    data = np.frombuffer(raw, np.uint8)
                    stay, spans = cut_out(len(data), found, length)
                    out.append((len(data), int((~stay).sum()), spans, hashlib.sha256(data[stay].tobytes()).hexdigest()))
                else:
                    out.append((raw.size, 0, 0, hashlib.sha256(raw).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            ids = pa.compute.if_else(pa.compute.equal(batch["doc_id"], -(1 << 63)), None, batch["doc_id"])
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats(docs, length, plain=plain).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut from their texts; characters that a cut splits go too; null stays null."""
    found = repeats(docs, length, whole=True).select("row", "b", "items")

    def run(batches):
        for batch in batches:
            kept = []
            for body, found, none in zip(batch["b"], batch["items"], batch["row"].field("is_null").to_pylist(), strict=True):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                found = np.asarray(found.values) if found.is_valid else ()
                kept.append(None if none else (data[cut_out(len(data), found, length)[0]] if len(found) else data).tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(kept, pa.string())], names=["row", "text"])

    out = found.mapInArrow(run, StructType([found.schema["row"], StructField("text", StringType())]))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
