"""Language-model scoring by prediction by partial matching over a byte-context trie, and a unigram base beside it.

Training counts every byte after its six-byte context in all training texts; lower orders follow by summing. All contexts of
up to two bytes count, and all longer ones that occur at least LEAST times, whatever the corpus: what is kept grows with it. A
symbol's probability comes from the longest such context that has seen it: each context that has not gives up its escape
probability (half its distinct symbols over its count), and symbols a longer context has seen are excluded below it; what none
has seen shares the rest evenly. ``adaptive`` learns from the text itself.

No task holds the model. Texts are cut into parts of PART bytes; each part sends its distinct contexts and symbols, held-out texts
too, to buckets by the last three bytes of the context. A bucket has all counts of its contexts of three bytes or more, is
sent those of the shorter ones (a few per possible triple of bytes), and returns a cost for each context and symbol to each
part that asked; the part then adds up its texts.

Edge cases: null and empty texts are their end alone; texts are scored whole; a null doc_id is a training document; with no
training text every symbol has probability 1/256; repeated rows count and are scored one by one; an empty table gives no rows.
Other columns do not matter. A-Z are lower-cased; 0xFF, no byte of UTF-8, stands for the end of a text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, mix, prefix_hash, span_hash, stash, stash_apart, text_bytes, words
from .quality import remainder
from .rules import TO_LOWER

ORDER, END = 6, 0xFF
SHARE = 0.0  # of all training bytes that a context of three bytes or more needs: none, as the model would stop growing
LEAST = 2  # occurrences that it needs
PART = 8 << 20  # bytes of texts that ask for costs together
FREQUENT = 1e-6  # of all training bytes, for a word's count to be sent to every task
SCALE = 4096.0


# ---- counting -------------------------------------------------------------------------------------------------------


def laid_out(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with ORDER end symbols before each and after the last, and where each text starts in that."""
    n = len(offs) - 1
    start = offs[:-1] + ORDER * np.arange(1, n + 1)
    out = np.full(len(data) + ORDER * (n + 1), END, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offs))
    out[np.arange(len(data)) + ORDER * (row + 1)] = TO_LOWER[data]
    return out, start


def predicted(x: np.ndarray, offs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks the places of x that are symbols of texts: their bytes and one end each."""
    mark = np.ones(len(x), bool)
    mark[:ORDER] = False
    ends = start + np.diff(offs)
    for j in range(1, ORDER):
        mark[ends + j] = False
    return mark


def context_symbols(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A number for each symbol: the bytes of its context and its own."""
    x, start = laid_out(data, offs)
    wide = x.astype(np.uint64)
    key = np.zeros(len(x) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        key = (key << U64(8)) | wide[j : len(wide) - ORDER + j]
    return key[predicted(x, offs, start)[ORDER:]]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(count, head) if len(head) else count


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of contexts and symbols, by the last three bytes of the context."""
    return ((mix((key >> U64(8)) & U64(0xFFFFFF)) >> U64(16)) % U64(buckets)).astype(np.int64)


def word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(16)) % U64(buckets)).astype(np.int64)


def by_bucket(to: np.ndarray) -> np.ndarray:
    """Places by bucket, in order within each."""
    return np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")


def known_at(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted known ones, and where."""
    at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
    return (known[at] == key if len(known) else np.zeros(len(key), bool)), at


def tallied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[head], np.diff(np.append(head, len(values)))


def shrunk(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def grown(body: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    ends = np.cumsum(np.concatenate([[8 * len(kinds)], sizes]))
    return [np.frombuffer(raw, k, int(s) // np.dtype(k).itemsize, int(e)) for k, s, e in zip(kinds, sizes, ends[:-1], strict=True)]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = words(data, offs)
    return span_hash(prefix_hash(TO_LOWER[data]), start, end), row


def count_corpus(training: DataFrame, buckets: int, word_least: float) -> DataFrame:
    """(kind, body, n, d): packed counts of two-byte contexts ("c"), of frequent words ("w"), and sums of words and words' kinds.

    Tasks count their own texts first and send each bucket one packed value.
    """

    def out(held: dict):
        rows = []
        for kind, (keys, counts) in held.items():
            key, count = merged(keys, counts)
            to = bucket_of(key, buckets) if kind == "c" else word_bucket(key, buckets)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                pick = order[ends[b] : ends[b + 1]]
                rows.append((kind, b, shrunk(np.diff(key[pick], prepend=U64(0)), count[pick].astype(np.uint32))))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["kind", "bucket", "body"])

    def run(batches):
        held = {k: ([], []) for k in "cw"}
        size = {k: 0 for k in "cw"}
        for batch in batches:
            for _, _, data, offs in blocks(batch["b"]):
                for kind, values in (("c", context_symbols(data, offs) & U64(0xFFFFFF)), ("w", word_hashes(data, offs)[0])):
                    key, count = tallied(values)
                    held[kind][0].append(key)
                    held[kind][1].append(count)
                    size[kind] += len(key)
                    if size[kind] > 1_500_000 and len(held[kind][0]) > 1:
                        key, count = merged(*held[kind])
                        held[kind] = ([key], [count])
                        size[kind] = len(key) // 2
                if max(len(k[0]) for k, _ in held.values() if k) > 4_000_000:
                    yield out(held)
                    held, size = {k: ([], []) for k in "cw"}, {k: 0 for k in "cw"}
        if any(k for k, _ in held.values()):
            yield out({k: v for k, v in held.items() if v[0]})

    def add(key, table):
        kind = key[0].as_py()
        parts = [grown(x, np.uint64, np.uint32) for x in table["body"].to_pylist()]
        keys, count = merged([np.cumsum(k, dtype=np.uint64) for k, _ in parts], [c.astype(np.int64) for _, c in parts])
        rows = []
        if kind == "w":
            pick = count >= word_least
            rows.append(("w", shrunk(keys[pick], count[pick]), int(count.sum()), len(keys)))
        else:
            rows.append(("c", shrunk(keys, count), 0, 0))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "body", "n", "d"])

    sent = training.mapInArrow(run, "kind string, bucket long, body binary")
    return sent.groupBy("kind", "bucket").applyInArrow(add, "kind string, body binary, n long, d long")


def ask(rows: DataFrame, fine: int, buckets: int, common) -> DataFrame:
    """(part, bucket, body, asks): the texts of each part (bucket -1), and what it asks each bucket, with its training counts.

    Buckets below fine are of contexts and symbols, those from fine on of words that are not common.
    """
    names = ["part", "bucket", "body", "asks"]

    def out(part: int, texts: list, asks: list[tuple[list, list]]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for batch in texts:
                writer.write_batch(batch)
        bucket, body = [-1], [sink.getvalue().to_pybytes()]
        for which, first, n in ((0, 0, fine), (1, fine, buckets)):
            key, count = merged(*asks[which])
            to = word_bucket(key, n) if which else bucket_of(key, n)
            order = by_bucket(to)
            ends = np.searchsorted(to[order], np.arange(n + 1))
            for k in np.flatnonzero(np.diff(ends)).tolist():
                pick = order[ends[k] : ends[k + 1]]
                bucket.append(first + k)
                body.append(shrunk(np.diff(key[pick], prepend=U64(0)), count[pick].astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(body), part)), pa.array(bucket, pa.int64()), pa.array(body, pa.binary()), pa.array([b >= 0 for b in bucket])], names=names)

    def run(batches):
        known, part = common.value, TaskContext.get().partitionId() << 32
        texts, asks, size = [], [([], []), ([], [])], 0
        for batch in batches:
            skip = np.asarray(batch["held_out"].cast(pa.uint8()))
            for a, b, data, offs in blocks(batch["b"]):
                found = np.sort((context_symbols(data, offs) << U64(1)) | np.repeat(skip[a:b].astype(np.uint64), np.diff(offs) + 1))
                key = found >> U64(1)
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                h, row = word_hashes(data, offs)
                rare = ~known_at(known, h)[0]
                h, trains = h[rare], 1 - skip[a:b][row[rare]].astype(np.int64)
                for into, k, c in ((asks[0], key[head], np.add.reduceat(1 - (found & U64(1)).astype(np.int64), head)), (asks[1], *merged([h], [trains]))):
                    into[0].append(k)
                    into[1].append(c)
                texts.append(batch.slice(a, b - a))
                size += len(data)
                if size >= PART:
                    yield out(part, texts, asks)
                    part, texts, asks, size = part + 1, [], [([], []), ([], [])], 0
        if texts:
            yield out(part, texts, asks)

    return rows.mapInArrow(run, "part long, bucket long, body binary, asks boolean")


# ---- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Trie:
    """All costs of a small model: classes of bytes, rows of three-byte contexts, first row of each order, children of rows, costs of symbols."""

    classes: np.ndarray
    width: int
    nodes: np.ndarray
    base: np.ndarray
    children: np.ndarray
    costs: np.ndarray


def levels(counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """For each order its contexts in order, and where each one's symbols and counts are; lower orders are sums of order 2."""
    full = dict(counts)
    for order in (1, 0):
        key, count = full[order + 1] if order + 1 in full else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        full[order] = merged([key & U64((1 << 8 * (order + 1)) - 1)], [count])
    out = []
    for order in range(ORDER + 1):
        key, count = full.get(order, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        context, head = np.unique(key >> U64(8), return_index=True)
        out.append({"context": context, "head": np.append(head, len(key)), "symbol": (key & U64(255)).astype(np.int64), "count": count})
    return out


def build(counts: dict[int, tuple[np.ndarray, np.ndarray]], chunk: int = 1024) -> Trie:
    """Lay out the probabilities of all kept contexts."""
    tree = levels(counts)
    seen = np.unique(np.append(tree[0]["symbol"], END))
    width = len(seen) + 1  # one class for all symbols that training has not seen
    classes = np.full(256, len(seen), np.uint8 if width <= 256 else np.uint16)
    classes[seen] = np.arange(len(seen))
    sizes = [max(1, len(t["context"])) if o == 0 else len(t["context"]) for o, t in enumerate(tree)]
    base = np.concatenate([[0], np.cumsum(sizes)])  # rows by order, the empty context first

    def dense(order: int, at: np.ndarray) -> np.ndarray:
        """Counts of contexts (by place in their order; -1: not kept) by class of symbol."""
        t, m = tree[order], np.zeros((len(at), width))
        ok = np.flatnonzero(at >= 0)
        if len(t["context"]) and len(ok):
            n = t["head"][at[ok] + 1] - t["head"][at[ok]]
            where = np.repeat(t["head"][at[ok]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            m[np.repeat(ok, n), classes[t["symbol"][where]]] = t["count"][where]
        return m

    def place(order: int, context: np.ndarray) -> np.ndarray:
        known = tree[order]["context"]
        if not len(known):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        return np.where(known[at] == context, at, -1)

    costs = np.empty((base[-1], width), np.uint16)
    for order in range(ORDER + 1):
        for a in range(0, sizes[order], chunk):
            n = min(chunk, sizes[order] - a)
            context = tree[order]["context"][a : a + n] if len(tree[order]["context"]) else np.zeros(n, np.uint64)
            p, left, out = np.zeros((n, width)), np.ones((n, 1)), np.zeros((n, width), bool)
            for o in range(order, -1, -1):
                m = dense(o, place(o, context & U64((1 << 8 * o) - 1)))
                m[out] = 0
                total, kinds = m.sum(1, keepdims=True), (m > 0).sum(1, keepdims=True)
                twice = np.maximum(1, 2 * total)
                p += left * np.maximum(0, 2 * m - 1) / twice
                left = np.where(total > 0, left * kinds / twice, left)
                out |= m > 0
            rest = 256 - out[:, :-1].sum(1, keepdims=True)
            p = np.where(p > 0, p, left / np.maximum(1, rest))
            costs[base[order] + a : base[order] + a + n] = np.minimum(65535, np.rint(-np.log10(np.maximum(p, 1e-300)) * SCALE))

    def codes(order: int) -> list[np.ndarray]:
        context = tree[order]["context"]
        return [classes[((context >> U64(8 * j)) & U64(255)).astype(np.int64)].astype(np.int64) for j in range(order)]  # last byte first

    nodes = np.zeros(1, np.int32)
    for order in (1, 2, 3):
        nodes = np.tile(nodes, width)
        c = codes(order)
        at = np.zeros(len(tree[order]["context"]), np.int64)
        for j in range(order - 1, -1, -1):
            at = at * width + c[j]
        nodes[at] = base[order] + np.arange(len(at))
    children = np.repeat(np.arange(base[3], base[ORDER], dtype=np.int32), width)
    for order in range(4, ORDER + 1):
        c = codes(order)
        if len(tree[order]["context"]):
            parent = base[order - 1] + place(order - 1, tree[order]["context"] & U64((1 << 8 * (order - 1)) - 1))
            children[(parent - base[3]) * width + c[order - 1]] = base[order] + np.arange(len(parent))
    return Trie(classes, width, nodes, base, children, costs.ravel())


def priced(key: np.ndarray, count: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Costs (-log10 of the probability, times SCALE) of sorted contexts and symbols, whose training counts may be 0.

    They are all that any part holds of their three-byte contexts; low has all two-byte contexts of the corpus. The symbols a
    context has seen are among those of its shorter ones, so what is excluded from a context is what the next longer one has seen.
    """
    tree, down = [None] * (ORDER + 1), [None] * (ORDER + 1)
    for order in range(ORDER, -1, -1):
        if order < ORDER:
            short = tree[order + 1]["key"] & U64((1 << 8 * (order + 1)) - 1)
            if order == 2:
                key, count = merged([low[0], short], [low[1], np.zeros(len(short), np.int64)])
            else:
                key, count = merged([short], [count])
            down[order + 1] = np.searchsorted(key, short)
        context = key >> U64(8)
        first = np.concatenate([[True], context[1:] != context[:-1]])
        head = np.flatnonzero(first)
        tree[order] = {"key": key, "count": count, "head": head, "of": np.cumsum(first) - 1, "n": np.add.reduceat(count, head), "kinds": np.add.reduceat((count > 0).astype(np.int64), head)}
    log = lambda x: np.log10(np.maximum(x, 0.5))  # noqa: E731  0.5: of what is not used
    below = np.full(len(tree[0]["key"]), -log(np.maximum(1, 256 - tree[0]["kinds"][0])))
    whole = np.full(len(below), -math.log10(256))
    for order in range(ORDER + 1):
        t = tree[order]
        if order:
            at, up = down[order], tree[order - 1]
            over = up["of"][at[t["head"]]]
            n = up["n"][over] - np.add.reduceat(np.where(t["count"] > 0, up["count"][at], 0), t["head"])
            escape = np.where(n > 0, log(up["kinds"][over] - t["kinds"]) - log(2 * n), 0.0)
            seen = up["count"][at]
            below = np.where(seen > 0, log(2 * seen - 1) - log(2 * n)[t["of"]], escape[t["of"]] + below[at])
            whole = whole[at]
        twice = log(2 * t["n"])
        own = np.where(t["count"] > 0, log(2 * t["count"] - 1) - twice[t["of"]], (log(t["kinds"]) - twice)[t["of"]] + below)
        whole = np.where((t["n"] >= (LEAST if order > 2 else 1))[t["of"]], own, whole)
    return np.rint(-whole * SCALE).astype(np.uint32)


def answer(asked: DataFrame, fine: int, low) -> DataFrame:
    """(part, bucket, body): costs of contexts and symbols, or training counts of words, in the order in which each part has asked."""

    def run(bucket, table):
        parts = [grown(x, np.uint64, np.uint32) for x in table["body"].to_pylist()]
        keys = [np.cumsum(k, dtype=np.uint64) for k, _ in parts]
        key, count = merged(keys, [c.astype(np.int64) for _, c in parts])
        value = priced(key, count, low.value) if bucket < fine else count
        return pa.table({"part": table["part"], "bucket": table["bucket"], "body": pa.array([shrunk(value[np.searchsorted(key, k)]) for k in keys], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(lambda k, t: run(k[0].as_py(), t), "part long, bucket long, body binary")


def added(texts: list[pa.RecordBatch], costs: list[np.ndarray], fine: int) -> np.ndarray:
    """log10 probability of each text of a part and its end, from the costs by bucket."""
    runs = []
    for batch in texts:
        for _, _, data, offs in blocks(batch["b"]):
            key = context_symbols(data, offs)
            order = np.argsort(key)
            key = key[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            runs.append((key[head], np.diff(np.append(head, len(key))), order.astype(np.int32), offs[:-1] + np.arange(len(offs) - 1)))
    known = merged([r[0] for r in runs], [r[1] for r in runs])[0]
    cost = np.empty(len(known), np.int64)
    cost[by_bucket(bucket_of(known, fine))] = np.concatenate(costs)
    out = []
    for key, times, order, start in runs:
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(cost[np.searchsorted(known, key)], times)
        out.append(np.add.reduceat(each, start))
    return -np.concatenate(out) / SCALE


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one lower-cased text and its end under a trie that learns only from what it has read of it."""
    seen: dict[bytes, dict[int, int]] = {}
    total, past = 0.0, bytes([END]) * order
    for s in [*bytes(TO_LOWER[np.frombuffer(text, np.uint8)]), END]:
        p, out = 1.0, set()
        for o in range(order, -1, -1):
            have = {k: n for k, n in seen.get(past[order - o :], {}).items() if k not in out}
            if not have:
                continue
            twice = 2 * sum(have.values())
            if s in have:
                p *= (2 * have[s] - 1) / twice
                break
            p *= len(have) / twice
            out |= have.keys()
        else:
            p /= 256 - len(out)
        total += math.log10(p)
        for o in range(order + 1):
            counts = seen.setdefault(past[order - o :], {})
            counts[s] = counts.get(s, 0) + 1
        past = (past + bytes([s]))[1:]
    return total


# ---- scoring --------------------------------------------------------------------------------------------------------


@dataclass
class Corpus:
    """What every task is sent: counts of two-byte contexts and of frequent words, and the sums N (tokens), V (distinct), ends."""

    low: tuple[np.ndarray, np.ndarray]
    words: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    @property
    def trie(self) -> Trie:
        """The contexts of up to two bytes, laid out."""
        return build({2: self.low})


def learn(rows: DataFrame) -> tuple[Corpus, int]:
    """Train on the rows (b, held_out) that are not held out; also returns the number of buckets that suits the table."""
    size = rows.groupBy("held_out").agg(F.sum(F.octet_length("b")).alias("n"), F.count("*").alias("d")).collect()
    total, train, ends = sum(r.n for r in size), sum(r.n for r in size if not r.held_out), sum(r.d for r in size if not r.held_out)
    buckets = max(1, -(-total // (64 << 20)))
    found = count_corpus(rows.where("not held_out").select("b"), buckets, max(2.0, FREQUENT * train))
    held: dict[str, tuple[list, list]] = {"c": ([], []), "w": ([], [])}
    n, v = 0, 0
    for r in found.toLocalIterator():  # bounded by all triples of bytes and 1 / FREQUENT words
        for into, x in zip(held[r.kind], grown(bytes(r.body), np.uint64, np.int64), strict=True):
            into.append(x)
        n, v = n + r.n, v + r.d
    low, common = (merged(*h) if h[0] else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for h in held.values())
    return Corpus(low, *common, n + ends, v + (ends > 0), ends), buckets


def scored(docs: DataFrame, of: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Parts of texts ask buckets for the costs of their contexts and the counts of their rarer words, and add up what they are told.
    No word there has more than a millionth of the corpus, so no bucket is hot.
    """
    rows = docs.select("doc_id", F.coalesce(remainder(of) == held, F.lit(False)).alias("held_out"), text_bytes().alias("b"))
    corpus, buckets = learn(rows)
    fine, send = 4 * buckets, docs.sparkSession.sparkContext.broadcast
    common, counts, low = send(corpus.words), send(corpus.counts), send(corpus.low)
    floor = math.log10(corpus.tokens + 0.5 * (corpus.distinct + 1))
    end_part, end_known = math.log10(corpus.ends + 0.5) - floor, int(corpus.ends > 0)

    def run(table):
        by = dict(zip(table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True))
        texts = list(pa.ipc.open_stream(by.pop(-1)))
        score = added(texts, [grown(by[k], np.uint32)[0] for k in sorted(by) if k < fine], fine)
        n, above, found = len(score), 0, []
        for t in texts:
            for a, b, data, offs in blocks(t["b"]):
                h, row = word_hashes(data, offs)
                found.append((h, row + above))
                above += b - a
        h, row = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        hit, at = known_at(common.value, h)
        count = np.zeros(len(h), np.int64)
        count[hit] = counts.value[at[hit]]
        rare = tallied(h[~hit])[0]
        told = np.zeros(len(rare), np.int64)
        told[by_bucket(word_bucket(rare, buckets))] = np.concatenate([np.zeros(0, np.int64), *[grown(by[k], np.int64)[0] for k in sorted(by) if k >= fine]])
        count[~hit] = told[np.searchsorted(rare, h[~hit])]
        base = np.bincount(row, np.log10(count + 0.5) - floor, n) + end_part
        ids, held_out = (pa.chunked_array([t[c] for t in texts]).combine_chunks() for c in ("doc_id", "held_out"))
        return pa.table([ids, held_out, pa.array(np.bincount(row, minlength=n) + 1), pa.array(np.bincount(row[count > 0], minlength=n) + end_known), pa.array(base), pa.array(score)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    asked, texts, drop = stash_apart(ask(rows, fine, buckets, common), "asked", "asks")
    told = stash(answer(asked, fine, low), "told")
    drop()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = texts.unionByName(told).groupBy("part").applyInArrow(lambda t: run(t), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")
