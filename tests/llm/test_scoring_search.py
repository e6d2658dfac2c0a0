import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import ppm, topk

from .conftest import prose


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def trained(by_id):
    """Counts of all contexts of up to ORDER bytes in the training texts."""
    seen = {}
    for i, t in by_id.items():
        if held(i):
            continue
        x = bytes([ppm.END]) * ppm.ORDER + lower(t) + bytes([ppm.END])
        for p in range(ppm.ORDER, len(x)):
            for o in range(ppm.ORDER + 1):
                seen.setdefault(x[p - o : p], Counter())[x[p]] += 1
    return seen


def brute(seen, t, least):
    x = bytes([ppm.END]) * ppm.ORDER + lower(t) + bytes([ppm.END])
    total = 0.0
    for p in range(ppm.ORDER, len(x)):
        prob, out = 1.0, set()
        for o in range(ppm.ORDER, -1, -1):
            have = seen.get(x[p - o : p])
            if have is None or o > 2 and sum(have.values()) < least:
                continue
            have = {s: n for s, n in have.items() if s not in out}
            if not have:
                continue
            twice = 2 * sum(have.values())
            if x[p] in have:
                prob *= (2 * have[x[p]] - 1) / twice
                break
            prob *= len(have) / twice
            out |= have.keys()
        else:
            prob /= 256 - len(out)
        total += math.log10(prob)
    return total


def test_scores_against_brute_force(corpus, by_id):
    got = {r.doc_id: r for r in ppm.scored(corpus).collect()}
    assert set(got) == set(by_id)
    words = Counter()
    for i, t in by_id.items():
        if not held(i):
            words.update([*lower(t).split(), None])
    n, v = sum(words.values()), len(words)
    train = sum(len((t or "").encode()) for i, t in by_id.items() if not held(i))
    seen, least = trained(by_id), max(2.0, ppm.SHARE * train)
    for i, t in by_id.items():
        r, own = got[i], [*lower(t).split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(words[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r.score == pytest.approx(brute(seen, t, least), abs=(1 + len((t or "").encode())) / ppm.SCALE)


def test_contexts_that_occur_twice_count_in_corpora_of_any_size(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = {i: "".join(rng.choices(letters, k=4000)) for i in range(250)}
    twice = "zyxwvutsrqponmlkjihgfedcba" * 3
    texts |= {1000: twice, 1001: twice, 1002: twice, 1003: twice}
    assert 4e-6 * sum(len(t) for i, t in texts.items() if not held(i)) > 2.5
    got = {r.doc_id: r.score for r in ppm.scored(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    seen = trained(texts)
    for i in [*range(8), 1000, 1001]:
        assert got[i] == pytest.approx(brute(seen, texts[i], 2), abs=(1 + len(texts[i])) / ppm.SCALE)


def test_costs_by_bucket_are_those_of_the_whole_trie():
    rng = random.Random(4)
    texts = [prose(rng, 30).encode() for _ in range(40)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    trained_on = int(offs[30])
    key, count = ppm.tallied(ppm.context_symbols(data[:trained_on], offs[:31]))
    low = ppm.merged([key & np.uint64(0xFFFFFF)], [count])
    asked = np.unique(ppm.context_symbols(data, offs))
    whole = ppm.priced(*ppm.merged([key, asked], [count, np.zeros(len(asked), np.int64)]), low)
    every, n = ppm.merged([key, asked], [count, np.zeros(len(asked), np.int64)])
    to = ppm.bucket_of(every, 5)
    for b in range(5):
        assert (ppm.priced(every[to == b], n[to == b], low) == whole[to == b]).all()


def test_probabilities_of_every_context_sum_to_one(corpus, by_id):
    rows = corpus.select(F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    trie = ppm.learn(rows)[0].trie
    p = 10.0 ** (-1.0 * trie.costs.reshape(-1, trie.width) / ppm.SCALE)
    unseen = 256 - (trie.width - 1)
    assert np.allclose(p[:, :-1].sum(1) + unseen * p[:, -1], 1, atol=5e-3)


def test_rare_words_travel_in_several_buckets(corpus, by_id, monkeypatch):
    whole = {r.doc_id: (r.base_score, r.n_known) for r in ppm.scored(corpus).collect()}
    learn = ppm.learn
    monkeypatch.setattr(ppm, "learn", lambda rows: (learn(rows)[0], 7))
    monkeypatch.setattr(ppm, "FREQUENT", 1.0)
    some = {r.doc_id: (r.base_score, r.n_known) for r in ppm.scored(corpus).collect()}
    assert {k: v[1] for k, v in some.items()} == {k: v[1] for k, v in whole.items()}
    assert all(some[k][0] == pytest.approx(whole[k][0]) for k in whole)


def test_scoring_edges(spark, repeated, empty):
    assert ppm.scored(repeated).count() == repeated.count()
    assert ppm.scored(empty).count() == 0
    only = spark.createDataFrame([(i, "abc") for i in range(60) if held(i)], "doc_id long, text string")
    assert {round(r.score, 3) for r in ppm.scored(only).collect()} == {round(4 * math.log10(1 / 256), 3)}


def test_adaptive_learns_repetition():
    rng = random.Random(1)
    plain = prose(rng, 60).encode()
    assert ppm.adaptive(b"") == pytest.approx(math.log10(1 / 256))
    assert ppm.adaptive(b"ab" * 200) > ppm.adaptive(plain[:400]) > 400 * math.log10(1 / 256)


def brute_topk(rows, k, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in dict(sorted(ok, reverse=True, key=lambda r: (r[0], r[1]))).items():
        if i % 50:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_topk_against_brute_force(spark, spread):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * math.exp(spread * rng.standard_normal())).tolist()) for i in range(300)]
    rows[7] = (7, None)
    rows[50] = (50, [math.nan] * 8)
    rows[9] = (9, rows[8][1])
    rows[100] = (100, [0.0] * 8)
    rows += [(900, [None] + [0.5] * 7), (901, [math.inf] * 8), (950, []), (951, []), (None, [1.0] * 8), (1000, [1.0, 2.0]), (1001, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.search(df, "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0, 5, query_block=4, block=37).collect()
    assert {tuple(r) for r in got} == brute_topk(rows, 5) and len(got) == len(set(got))


def test_short_candidates_meet_no_query(spark, monkeypatch):
    """Lengths that fall off: blocks under the bar are not compared."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * 0.97**i).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    made = spark.sparkContext.accumulator(0)
    best = topk.best

    def counted(*a):
        made.add(1)
        return best(*a)

    monkeypatch.setattr(topk, "best", counted)
    got = topk.search(df, "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0, 5, query_block=2, block=20).collect()
    assert {tuple(r) for r in got} == brute_topk(rows, 5)


def test_small_blocks_travel_in_groups(spark, monkeypatch):
    """Tasks grow with the table, not with the pairs of its blocks: 800 pairs here, whose vectors once travelled each."""
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((400, 8)))]
    rows = [(i, (np.array(x) / np.linalg.norm(x)).tolist()) for i, x in rows]
    rows += [(i, rows[0][1]) for i in range(401, 420)]  # copies of a query: ties go by id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    made = spark.sparkContext.accumulator(0)
    best = topk.best

    def counted(*a):
        made.add(1)
        return best(*a)

    monkeypatch.setattr(topk, "best", counted)
    got = topk.search(df, "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0, 5, query_block=1, block=4).collect()
    assert {tuple(r) for r in got} == brute_topk(rows, 5) and len(got) == len(set(got))
    assert 0 < made.value < 100


def test_topk_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int, score long")
    assert topk.search(empty, "vec_id", "embedding", F.col("vec_id") == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = topk.search(huge, "vec_id", "embedding", F.col("vec_id") == 0).collect()
    top = (1 << 63) - 1
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, top), (2, 3, 256 * 768), (3, 2, -top)]
    few = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    got = topk.search(few, "vec_id", "embedding", F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 512 * 256), (0, 2, 1, 512 * 256)]
