"""Quality rules: base counts of every text, then its divergence from its language's own histograms.

A language's references are the character classes and the commonest words of its documents that pass the base rules (null is a
language of its own); its ``TOP`` commonest words are counted from them too. A document is held against the rest of them: what
it has added itself is taken off. It is kept if the Jensen-Shannon distances of its two histograms stay under a limit that
widens for short texts, as sampling noise does; texts or references below the minimum lengths pass without a verdict.

Edge cases: null and empty texts have no words and fail the base rules; repeated rows are judged alike, row by row; texts
are never cut; an empty table gives no rows. Other columns of the input do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, U64, blocks, boxed, mix, per_row, prefix_hash, span_hash, stash, text_bytes, unboxed, words

SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?'\"()-"
TOP = 50  # common words of a language
LOWER, UPPER, DIGIT, SPACE, MARK, SIGN, WIDE, CONTROL, REST = range(9)


def _classes() -> np.ndarray:
    kind = np.full(256, CONTROL, np.uint8)
    kind[0x21:0x7F] = SIGN
    kind[list(b"abcdefghijklmnopqrstuvwxyz")] = LOWER
    kind[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = UPPER
    kind[list(b"0123456789")] = DIGIT
    kind[list(MARKS)] = MARK
    kind[GAP] = SPACE
    kind[0x80:0xC0] = REST  # continuation bytes are no characters of their own
    kind[0xC0:] = WIDE
    return kind


CLASS = _classes()
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def _twins(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: does another item of its row have its hash; is it not the first that has it."""
    key = mix(h ^ mix(row.astype(np.uint64) + U64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    later = np.zeros(len(h), bool)
    any_ = np.zeros(len(h), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def repeated_words(row: np.ndarray, h: np.ndarray, width: int = 5) -> np.ndarray:
    """Marks the words that lie in a window of ``width`` words found twice or more in their row."""
    n = len(h) - width + 1
    mark = np.zeros(len(h), bool)
    if n <= 0:
        return mark
    window = np.zeros(n, np.uint64)
    for j in range(width):
        window = window * U64(0x9E3779B97F4A7C15) + h[j : j + n]
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    twice, _ = _twins(row[at], mix(window[at]))
    hit = at[twice]
    for j in range(width):
        mark[hit + j] = True
    return mark


def _line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line, split at line feeds alone."""
    feed = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([offs[:-1], feed + 1]))
    cut = cut[cut < len(data)]
    end = np.concatenate([cut[1:], [len(data)]])
    end = end - ((end > cut) & (data[end - 1] == 10))
    return cut, end, np.searchsorted(offs, cut, "right") - 1


def _counts(data: np.ndarray, offs: np.ndarray) -> tuple[dict, tuple]:
    """The base counts and character classes of each row; and the start, end, row and lower-cased hash of every word."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(row * 9 + CLASS[data], minlength=9 * n).reshape(n, 9)
    start, end, at = words(data, offs)
    prefix = prefix_hash(data)
    a, b, line = _line_spans(data, offs)
    inside = np.concatenate([[0], np.cumsum(~GAP[data])])
    full = inside[b] > inside[a]
    _, later = _twins(line[full], span_hash(prefix, a[full], b[full]))
    repeat = repeated_words(at, span_hash(prefix, start, end))
    found = {
        "n_words": per_row(at, n), "word_chars": kinds[:, :REST].sum(1) - kinds[:, SPACE], "n_symbols": per_row(row[IS_SYMBOL[data]], n),
        "n_dup_lines": per_row(line[full][later], n), "n_repeat_words": per_row(at[repeat], n), "classes": kinds[:, :REST],
    }
    return found, (start, end, at, span_hash(prefix_hash(TO_LOWER[data]), start, end))


def failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def word_hashes(said: list[str]) -> np.ndarray:
    raw = [w.encode() for w in said]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    return span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), offs[:-1], offs[1:])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_bytes().alias("b"))


def vocabulary(docs: DataFrame, top: int = TOP, most: int = 200_000) -> DataFrame:
    """(lang, words): each language's commonest words, most common first, in its documents that pass the base rules.

    Tasks add up their own words and let them go as soon as they hold ``most`` different ones.
    """

    def run(batches):
        held: dict = {}

        def out():
            keys = list(held)
            lang, word = [k[0] for k in keys], [k[1].decode() for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            lang = np.array([repr(x) for x in batch["lang"].to_pylist()], object)
            names = dict(zip(lang.tolist(), batch["lang"].to_pylist(), strict=True))
            for a, b, data, offs in blocks(batch["b"]):
                c, (start, end, at, h) = _counts(data, offs)
                keep = ~failed(c["n_words"], c["n_repeat_words"])
                low = TO_LOWER[data].tobytes()
                for name in set(lang[a:b][keep]):
                    mine = np.flatnonzero((keep & (lang[a:b] == name))[at])
                    _, first, many = np.unique(h[mine], return_index=True, return_counts=True)
                    for i, n in zip(mine[first].tolist(), many.tolist(), strict=True):
                        key = (names[name], low[start[i] : end[i]])
                        held[key] = held.get(key, 0) + n
                if len(held) > most:
                    yield out()
                    held = {}
        if held:
            yield out()

    counts = _texts(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("at", rank).where(F.col("at") <= top)
    return best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))


def measure(docs: DataFrame, vocabularies: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms as arrays: character classes, and common words with all others last."""
    said = vocabularies.withColumnRenamed("lang", "_lang")
    rows = _texts(docs).join(said, F.col("lang").eqNullSafe(F.col("_lang")), "left").select("doc_id", "lang", "b", "words")
    fields = [f"{c} long" for c in COUNTS]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            lists = [tuple(x or ()) for x in batch["words"].to_pylist()]
            for a, b, data, offs in blocks(batch["b"]):
                c, (_, _, at, h) = _counts(data, offs)
                n = b - a
                common = np.zeros((n, top + 1), np.int64)
                for name in set(lists[a:b]):
                    if name not in known:
                        known[name] = word_hashes(list(name))
                    order = np.argsort(known[name])
                    mine = np.flatnonzero(np.array([x == name for x in lists[a:b]])[at])
                    slot = np.full(len(mine), top)
                    if len(order):
                        place = np.minimum(np.searchsorted(known[name][order], h[mine]), len(order) - 1)
                        hit = known[name][order[place]] == h[mine]
                        slot[hit] = order[place[hit]]
                    common += np.bincount(at[mine] * (top + 1) + slot, minlength=n * (top + 1)).reshape(n, top + 1)
                cut = batch.slice(a, n)
                arrays = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel(), pa.int32())) for m in (c["classes"], common)]
                yield pa.RecordBatch.from_arrays([cut["doc_id"], cut["lang"], *[pa.array(c[k], pa.int64()) for k in COUNTS], *arrays], names=["doc_id", "lang", *COUNTS, "classes", "common"])

    return rows.mapInArrow(run, f"doc_id {id_type}, lang string, {', '.join(fields)}, classes array<int>, common array<int>")


def references(measured: DataFrame) -> DataFrame:
    """Per language: the summed histograms of its documents that pass the base rules. Each task adds up its own rows first."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            lang = batch["lang"].to_pylist()
            good = ~failed(np.asarray(batch["n_words"]), np.asarray(batch["n_repeat_words"]))
            both = [np.asarray(batch[k].flatten()).reshape(len(lang), -1) for k in ("classes", "common")] if lang else []
            for name in set(lang):
                pick = np.array([x == name for x in lang]) & good
                sums[name] = [m[pick].sum(0) + (sums[name][i] if name in sums else 0) for i, m in enumerate(both)]
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "classes": [v[0].tolist() for v in sums.values()], "common": [v[1].tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))]))

    parts = measured.select("lang", "n_words", "n_repeat_words", "classes", "common").mapInArrow(run, "lang string, classes array<long>, common array<long>")
    both = [parts.select("lang", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "n")) for k in ("classes", "common")]
    cells = both[0].unionAll(both[1]).groupBy("lang", "kind", "i").agg(F.sum("n").alias("n"))
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("i", "n")))), lambda x: x["n"])
    return cells.groupBy("lang").agg(pick("classes").alias("ref_classes"), pick("common").alias("ref_common"))


def js_distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (root of the divergence in bits, 0 to 1) of histograms, row by row; NaN where one is empty."""
    with np.errstate(invalid="ignore", divide="ignore"):
        p, q = (h / h.sum(1, keepdims=True) for h in (left.astype(float), right.astype(float)))
        m = (p + q) / 2
        terms = sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0 * x) for x in (p, q)) / 2
    return np.sqrt(np.maximum(0, terms.sum(1)))


def judge(docs: DataFrame, class_limit: float = 0.16, common_limit: float = 0.265, noise: float = 1.0, least_words: int = 30, least_reference: int = 1000, top: int = TOP) -> DataFrame:
    """doc_id, the base counts, base_failed, the two distances, kept."""
    measured = stash(measure(docs, stash(vocabulary(docs, top), "vocabularies"), top), "rules", gather=True)
    refs = references(measured).withColumnRenamed("lang", "_lang")
    both = measured.join(refs, F.col("lang").eqNullSafe(F.col("_lang")))
    kinds = {f.name: f.dataType.simpleString() for f in measured.schema}

    def verdicts(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            wide = {k: np.asarray(batch[k].flatten()).reshape(n, -1).astype(np.int64) for k in ("classes", "common", "ref_classes", "ref_common")}
            count, repeats = np.asarray(batch["n_words"]), np.asarray(batch["n_repeat_words"])
            bad = failed(count, repeats)
            others = {k: wide[f"ref_{k}"] - np.where(bad, 0, 1)[:, None] * wide[k] for k in ("classes", "common")}
            by_class, by_word = (js_distance(wide[k], others[k]) for k in ("classes", "common"))
            slack = noise / np.sqrt(np.maximum(1, count))
            strange = (by_class > class_limit + 0.8 * slack) | (by_word > common_limit + slack)
            enough = (count >= least_words) & (others["common"].sum(1) >= least_reference)
            found = [pa.array(bad), *[pa.array(x, mask=np.isnan(x)) for x in (by_class, by_word)], pa.array(~bad & ~(enough & strange))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[batch[c] for c in COUNTS], *found], names=["doc_id", *COUNTS, "base_failed", "class_distance", "common_distance", "kept"])

    schema = f"doc_id {kinds['doc_id']}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, class_distance double, common_distance double, kept boolean"
    return both.select("doc_id", *COUNTS, "classes", "common", "ref_classes", "ref_common").mapInArrow(verdicts, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep; rows that share a doc_id are kept or go together, as the best of them is judged."""
    good = judge(docs).where("kept").select(F.col("doc_id").alias("good")).distinct()
    return unboxed(boxed(docs, key=docs["doc_id"]).join(good, F.col("key").eqNullSafe(F.col("good")), "left_semi"), docs.columns)
