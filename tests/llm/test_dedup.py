import hashlib
import random

import numpy as np
import pytest

from terravane.llm import neardup, suffix

from .conftest import prose, rows, SCHEMA, texts


def shingles(t, counted=True):
    """Runs of five words, each occurrence an element of its own if counted."""
    w = (t or "").encode().split()
    seen, out = {}, set()
    for i in range(max(1, len(w) - 4) if w else 0):
        run = tuple(w[i : i + 5])
        seen[run] = seen.get(run, 0) + 1
        out.add((run, seen[run] if counted else 1))
    return frozenset(out)


def classes(by_id, threshold=0.8, counted=True):
    ids = sorted(by_id)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: shingles(by_id[i], counted) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            same = by_id[i] is not None and by_id[i] == by_id[j]
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_classes_against_all_pairs(corpus, by_id):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(corpus).collect()}
    assert got == classes(by_id)
    assert len(set(got.values())) < len(got)


def test_weights_decide_links(spark):
    """Texts that mostly repeat: alike as weighted sets, not as sets; and the other way round."""
    rng = random.Random(5)
    repeat, tail = "one two three four five six seven " * 100, [prose(rng, 12) for _ in range(2)]
    base = prose(rng, 60)
    out = [repeat + tail[0], repeat + tail[1], base, base + " " + base + " " + base, prose(rng, 90)]
    docs = spark.createDataFrame(rows(out), SCHEMA)
    for weights in ("count", "set"):
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, weights=weights).collect()}
        assert got == classes(dict(enumerate(out)), counted=weights == "count")
    assert classes(dict(enumerate(out)))[1] == 0 and classes(dict(enumerate(out)), counted=False)[3] == 2


def test_large_groups_of_near_copies(spark):
    """Copies of one text with rising numbers of changed words: some link through others alone, some not at all."""
    rng = random.Random(3)
    base = prose(rng, 120).split(" ")
    out = []
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(len(words)), k % 9):
            words[at] = f"changed{rng.randint(0, 99999)}"
        out.append(" ".join(words))
    docs = spark.createDataFrame(rows(out), SCHEMA).repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    want = classes(dict(enumerate(out)))
    assert got == want and len(set(want.values())) > 1


def test_open_buckets_in_many_tiles(spark, monkeypatch):
    tiled = neardup.open_links
    monkeypatch.setattr(neardup, "open_links", lambda *a: tiled(*a, tile=600))
    test_large_groups_of_near_copies(spark)


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for _ in range(5):
        x, y = rng.random(60) * rng.integers(0, 2, 60) * 4, rng.random(60) * 4
        row = np.repeat([0, 1], 60)
        weight = np.concatenate([x, y])
        keep = weight > 0
        sig = neardup.dart_minhash(row[keep], np.concatenate([elements, elements])[keep], weight[keep], 2, 4096)
        want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert (sig > 0).all() and abs((sig[0] == sig[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / 4096) + 1e-3


def test_near_duplicate_edges(spark, repeated, empty):
    got = neardup.near_duplicates(repeated).collect()
    assert len(got) == repeated.count()
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    plain = neardup.near_duplicates(repeated, weights="set").count()
    assert plain == repeated.count()


def test_keep_one(corpus, by_id):
    kept = neardup.keep_one(corpus)
    want = classes(by_id)
    assert kept.columns == corpus.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_shared_and_null_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e = (prose(rng, 120) for _ in range(5))
    near = lambda t: t + " odd"
    given = [(3, near(a)), (5, a), (5, b), (7, near(b)), (None, c), (None, c), (None, near(c)), (None, d), (9, near(d)), (5, e), (None, None), (None, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    want = [(3, 3), (5, 3), (5, 5), (7, 5), (None, None), (None, None), (None, None), (None, 9), (9, 9), (5, 5), (None, None), (None, None)]
    assert got == sorted(want, key=str)
    kept = [tuple(r) for r in neardup.keep_one(docs).collect()]
    assert sorted((r for r in kept if r[0] is not None), key=str) == sorted([(3, near(a)), (5, b), (9, near(d)), (5, e)], key=str)
    assert len(kept) == 7 and sum(r == (None, None) for r in kept) == 2 and sum(r[1] in (c, near(c)) for r in kept) == 1


def test_one_row_of_repeats_stays(spark):
    """Equal rows, two alike texts under one id, and a text that only shares the id of a copy."""
    rng = random.Random(10)
    a, b = prose(rng, 120), prose(rng, 120)
    given = [(1, a), (1, a), (5, a), (5, b), (6, b), (8, a + " end"), (8, a + " ends"), (2, None), (2, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    kept = sorted((tuple(r) for r in neardup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (2, None), (2, None)], key=str)
    two = [tuple(r) for r in neardup.keep_one(docs.where("doc_id = 8")).collect()]
    assert len(two) == 1 and two[0][0] == 8


def cut(by_id, length=100):
    seen, out = set(), {}
    for i in sorted(by_id, key=lambda x: (x is not None, x)):
        b = (by_id[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def digest(docs, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(docs, **options).collect()}


def test_repeats_against_brute_force(corpus, by_id):
    got = digest(corpus)
    assert got == cut(by_id) and sum(r[1] for r in got.values()) > 1000


def test_plain_doubling_gives_the_same(corpus, by_id):
    assert digest(corpus, plain=True) == cut(by_id)


@pytest.mark.parametrize("hot", [1, 2])
def test_repeats_with_hot_names(spark, hot, monkeypatch):
    """A passage of over 100 bytes inside most documents, spread by segment and window instead of by its name."""
    rng = random.Random(7)
    passage = prose(rng, 30)
    out = [prose(rng, rng.randint(0, 30)) + passage[rng.randint(0, 9) :] + prose(rng, rng.randint(0, 30)) for _ in range(60)]
    docs = spark.createDataFrame(rows(out), SCHEMA).repartition(5)
    found = suffix.repeats
    monkeypatch.setattr(suffix, "repeats", lambda d, length, **k: found(d, length, **k | {"hot": hot}))
    monkeypatch.setattr(suffix, "HOT", hot)
    assert digest(docs) == cut(dict(enumerate(out)))


def test_long_texts_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(suffix.units, "__defaults__", (100, 700))
    rng = random.Random(8)
    long = prose(rng, 900)
    out = [long, long[3000:] + "x" + long[:3500], "ab" * 2000, long[1:900]]
    assert digest(spark.createDataFrame(rows(out), SCHEMA)) == cut(dict(enumerate(out)))


def test_suffix_edges(spark, repeated, empty):
    got = suffix.digests(repeated).collect()
    assert len(got) == repeated.count() and any(r.doc_id is None for r in got)
    assert suffix.digests(empty).count() == 0 and suffix.without_repeats(empty).count() == 0


def test_without_repeats(corpus, by_id):
    out = suffix.without_repeats(corpus)
    assert out.columns == corpus.columns
    want = cut(by_id)
    for r in out.collect():
        assert (r.text is None) == (by_id[r.doc_id] is None)
        if r.text is not None and want[r.doc_id][1] == 0:
            assert r.text == by_id[r.doc_id]
        elif r.text is not None:
            assert len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1]


def test_no_strings_of_letters_cross_documents(spark):
    half = "q" * 60
    got = digest(spark.createDataFrame(rows([half, half, half + half]), SCHEMA))
    assert [v[1] for v in got.values()].count(0) >= 2


def test_units_cover_texts():
    assert texts()  # the fixture's own texts stay as they are
