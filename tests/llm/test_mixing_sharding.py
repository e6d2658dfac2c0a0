import random
from fractions import Fraction

from pyspark.sql import functions as F

from terravane.llm import mixing, sharding


def brute_targets(sizes, weights=(3, 1, 2)):
    """Shares by weight, caps, and the excess shared again until none is above, in exact numbers."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: Fraction(weights[k % 3]) for k, s in enumerate(names)}
    left, free, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if 2 * sizes[s] < level * w[s]]
        if not over:
            return out | {s: float(level * w[s]) for s in free}
        for s in over:
            out[s] = float(2 * sizes[s])
            left -= 2 * sizes[s]
            free.discard(s)
    return out


def test_targets_and_taken(corpus, by_id):
    got = mixing.mix(corpus).collect()
    sizes = {i: len((t or "").encode().split()) for i, t in by_id.items()}
    assert {r.doc_id: r["size"] for r in got} == sizes
    sums = {}
    for r in got:
        sums[r.source] = sums.get(r.source, 0) + r["size"]
    want = brute_targets(sums)
    taken = dict.fromkeys(sums, 0)
    for r in got:
        assert r.source_size == sums[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(2, 0.03 * want[s]) for s in sums)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(corpus.repartition(5)).collect()))


def test_many_shards_keep_the_targets(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c"])) for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, shard_words=300).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.countDistinct("shard").alias("k")).collect()
    assert max(r.k for r in rows) > 20 and all(abs(r.n - r.t) <= 0.02 * r.t for r in rows)


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(1)
    groups = {g: ([rng.choice([0, 1, 3, 50, 700]) + rng.random() for _ in range(rng.randint(1, 9))], rng.randint(0, 60)) for g in range(25)}
    table = spark.createDataFrame([(g, i, x, n) for g, (ws, n) in groups.items() for i, x in enumerate(ws)], "g int, i int, w double, n long")
    got = {(r.g, r.i): r.seats for r in mixing.sainte_lague(table, ["g", "n"], ["i"], "w", "n", "seats").collect()}
    for g, (ws, n) in groups.items():
        seats = [0] * len(ws)
        for _ in range(n):
            seats[max(range(len(ws)), key=lambda i: (ws[i] / (2 * seats[i] + 1), -i))] += 1
        assert [got[g, i] for i in range(len(ws))] == seats


def test_mixed_documents(corpus, repeated, empty):
    out = mixing.mixed_documents(corpus)
    assert out.columns == corpus.columns and out.count() > 0
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mixed_documents(repeated).count() > 0
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_repeated_rows_are_mixed_as_a_set(repeated):
    again = lambda df: sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.mix(df).collect())
    assert again(repeated) == again(repeated.repartition(4))


def test_shards_are_shallow_and_small(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "x" * rng.choice([0, 1, 10, 100, 900])) for i in range(400)] + [(400, None), (401, "y" * 5000)], "doc_id long, text string")
    rows = sharding.shard(docs, 1000).collect()
    assert len(rows) == 402
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
        assert r["shard"] >> r.depth == 1
    for own in shards.values():
        total = sum(r.bytes for r in own)
        assert all((r.shard_bytes, r.shard_docs) == (total, len(own)) for r in own)
        assert total <= 1000 or len(own) == 1
    # A bucket splits only where it must: a shard and its sibling together are over the limit.
    size = {k: sum(r.bytes for r in v) for k, v in shards.items()}
    for k in size:
        if k > 1:
            under = sum(v for j, v in size.items() if j >> max(0, j.bit_length() - k.bit_length()) == k ^ 1 and j.bit_length() >= k.bit_length())
            assert size[k] + under > 1000


def test_sharding_edges(corpus, repeated, empty, tmp_path):
    assert sharding.shard(corpus).count() == corpus.count()
    assert sharding.shard(repeated, 10).count() == repeated.count()
    assert sharding.shard(empty).count() == 0
    sharding.write_shards(corpus, str(tmp_path / "out"), 2000)
    assert corpus.sparkSession.read.parquet(str(tmp_path / "out")).count() == corpus.count()
