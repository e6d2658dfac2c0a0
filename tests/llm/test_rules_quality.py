import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from terravane.llm import quality, rules
from terravane.llm.common import mix, prefix_hash, span_hash

from ..conftest import DATA


def base(text):
    words = (text or "").encode().split()
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_base_counts(corpus, by_id):
    got = rules.judge(corpus).collect()
    assert len(got) == len(by_id)
    for r in got:
        want = base(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)


def test_distance_against_numpy(corpus):
    def js(p, q):
        p, q = np.array(p) / max(1, sum(p)), np.array(q) / max(1, sum(q))
        m = (p + q) / 2
        kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    def classes(text):
        kinds = [0] * 8
        for c in text:
            if c in " \t\n\v\f\r":
                k = rules.SPACE
            elif c > "\x7f":
                k = rules.WIDE
            elif c < " " or c == "\x7f":
                k = rules.CONTROL
            elif c.isalpha():
                k = rules.LOWER if c.islower() else rules.UPPER
            else:
                k = rules.DIGIT if c.isdigit() else rules.MARK if c in ".,;:!?'\"()-" else rules.SIGN
            kinds[k] += 1
        return kinds

    rows = corpus.collect()
    said = {r.doc_id: [w.lower() for w in (r.text or "").encode().split()] for r in rows}
    good = {r.doc_id for r in rows if not (base(r.text)[0] < 10 or 100 * base(r.text)[4] > 20 * base(r.text)[0])}
    got = {r.doc_id: r for r in rules.judge(corpus).collect()}
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        counts = Counter(w for r in mine if r.doc_id in good for w in said[r.doc_id])
        top = sorted(counts, key=lambda w: (-counts[w], w))[: rules.TOP]
        table = {r.doc_id: [Counter(said[r.doc_id])[w] for w in top] + [sum(w not in top for w in said[r.doc_id])] for r in mine}
        kinds = {r.doc_id: classes(r.text or "") for r in mine}
        for r in mine:
            others = [x.doc_id for x in mine if x.doc_id in good and x.doc_id != r.doc_id]
            for name, h in (("class_distance", kinds), ("common_distance", table)):
                rest = np.sum([h[x] for x in others], 0)
                assert got[r.doc_id][name] is None if not sum(h[r.doc_id]) else abs(got[r.doc_id][name] - js(h[r.doc_id], rest)) < 1e-9


def test_verdict_keeps_good_and_rejects_junk(spark):
    labels = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = rules.judge(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.99 and share[0] < 0.1


def test_rules_edges(repeated, empty, corpus):
    assert rules.judge(repeated).count() == repeated.count()
    assert rules.judge(empty).count() == 0 and rules.keep_good(empty).count() == 0
    assert rules.keep_good(corpus).columns == corpus.columns


def test_classifier_on_held_out_labels(spark):
    d = DATA.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in got]), np.array([r.quality for r in got])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97 and np.mean([r.predicted == r.quality for r in got]) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.remainder(4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda x: sorted((r.doc_id, r.score) for r in quality.classify(docs, x).collect())
    assert key(labels) == key(turned)


def name(part):
    return int(span_hash(prefix_hash(np.frombuffer(part, np.uint8)), np.array([0]), np.array([len(part)]))[0])


def finish(x):
    return int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0])


def plain_bag(text, bits=quality.BITS):
    """Words, distances at which a pair of words comes again, and runs of two and four characters, one by one."""
    words = [name(w) for w in text.encode().split()]
    out = list(words)
    pairs = [finish(a * 0x9E3779B97F4A7C15 + b) for a, b in zip(words, words[1:])]
    out += [finish(back) for back in range(1, quality.ECHOES + 1) for i in range(len(pairs) - back) if pairs[i] == pairs[i + back]]
    out += [finish(name(text[i : i + n].encode()) + n) for n in quality.GRAMS for i in range(len(text) - n + 1)]
    found = Counter(h >> 64 - bits for h in out)
    return {k: n / len(out) for k, n in found.items()}


def test_features_one_by_one(by_id):
    for text in by_id.values():
        at, share = quality.bag((text or "").encode())
        want = plain_bag(text or "")
        assert at.tolist() == sorted(want) and np.allclose(share, [want[k] for k in sorted(want)], rtol=1e-5)


def test_descent_one_by_one():
    """The same steps in plain Python, a number at a time."""
    bits, dim, rate, epochs = 4, 3, 0.3, 2
    bags = [(np.array([1, 5], np.int32), np.array([0.25, 0.75], np.float32)), (np.array([5, 9], np.int32), np.array([0.5, 0.5], np.float32)), (np.array([], np.int32), np.array([], np.float32))]
    labels = np.array([1.0, 0.0, 1.0])
    value, bias = quality.train(bags, labels, bits, dim, epochs, rate, seed=4)
    rng = np.random.default_rng(4)
    v = ((rng.random((1 << bits, dim), np.float32) - 0.5) / dim).astype(float).tolist()
    out, b, step = [[0.0] * dim, [0.0] * dim], [math.log(1 / 3), math.log(2 / 3)], 0
    for _ in range(epochs):
        for i in rng.permutation(3).tolist():
            lr, step = rate * (1 - step / (3 * epochs)), step + 1
            at, share = bags[i][0].tolist(), bags[i][1].tolist()
            if not at:
                continue
            hidden = [sum(s * v[k][d] for k, s in zip(at, share, strict=True)) for d in range(dim)]
            z = [sum(o * h for o, h in zip(out[y], hidden, strict=True)) + b[y] for y in (0, 1)]
            miss = [math.exp(z[y]) / (math.exp(z[0]) + math.exp(z[1])) - (y == labels[i]) for y in (0, 1)]
            back = [miss[0] * out[0][d] + miss[1] * out[1][d] for d in range(dim)]
            for y in (0, 1):
                out[y] = [o - lr * miss[y] * h for o, h in zip(out[y], hidden, strict=True)]
                b[y] -= 0.1 * lr * miss[y]
            for k, s in zip(at, share, strict=True):
                v[k] = [x - lr * math.sqrt(s) * g for x, g in zip(v[k], back, strict=True)]
    want = [sum(x * (p - q) for x, p, q in zip(row, out[1], out[0], strict=True)) for row in v]
    assert np.allclose(value, want, atol=1e-5) and abs(bias - (b[1] - b[0])) < 1e-5


def test_scores_are_the_models(spark, corpus, by_id):
    rng = np.random.default_rng(6)
    model = (rng.standard_normal(1 << quality.BITS).astype(np.float32), 0.3)
    for r in quality.score(corpus, model).collect():
        z = 0.3 + sum(float(model[0][k]) * s for k, s in plain_bag(by_id[r.doc_id] or "").items())
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-5


def test_classifier_edges(spark, corpus, repeated, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(corpus, none).collect()} == {0.5}
    odd = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(0, 0), (None, 1), (3, None), (4, 7), (999, 1)], "doc_id long, quality int")
    assert quality.classify(corpus, odd).where("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(repeated, odd).count() == repeated.count()
    assert quality.classify(empty, odd).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert quality.classify(corpus, one).where("predicted = 0").count() == 0
