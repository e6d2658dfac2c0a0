"""Helpers shared by the training-data operators: shared-folder tables and vectorised byte work."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import freed_shuffles, new_path, own_folder, settle as stash, sweep  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def stash_apart(df: DataFrame, label: str, flag: str) -> tuple[DataFrame, DataFrame, Callable]:
    """As stash, for rows where the boolean column holds and where it does not (without it); the last, called, drops the former."""
    spark = df.sparkSession
    path, kept = new_path(spark, label), df.drop(flag).schema
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").partitionBy(flag).parquet(path)
    folder = lambda v: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{flag}={v}")
    files = folder("true").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    both = [spark.read.schema(kept).parquet(f"{path}/{flag}={v}") if files.exists(folder(v)) else spark.createDataFrame([], kept) for v in ("true", "false")]
    return *both, lambda: files.delete(folder("true"), True)


def boxed(docs: DataFrame, **named: Column) -> DataFrame:
    """Whole rows as one column ``row`` beside the named ones, so that no name of the table can clash with ours."""
    return docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), *[v.alias(k) for k, v in named.items()])


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)])


def id_hash(seed: str, *cols: str) -> Column:
    """A 60-bit hash of the columns' text that SQL engines agree on; nulls count as a text of their own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column as one array, without a copy, and the offsets of its rows."""
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def blocks(col: pa.Array, limit: int = 1 << 20):
    """Split a binary column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets from 0)."""
    data, offs = byte_view(col)
    a, n = 0, len(col)
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1))
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums over data[:i] of a polynomial in BASE; span_hash reads spans from it."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever it stands."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses rows."""
    n = len(data)
    inside = ~GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (or the count) for each of n rows."""
    return np.bincount(row, weights, n)

