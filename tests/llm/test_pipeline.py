"""The pipeline against its stages' brute-force versions and its own promises."""

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from terravane.llm import mixing, rules, tokens
from terravane.sources import tables

from ..conftest import DATA
from .test_dedup import classes, cut


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, DATA).cache()
    good = {r.doc_id for r in rules.judge(docs).where("kept").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good
    one = corpus_pipeline.near_dedup(spark, kept, DATA).cache()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id for r in one.collect()} == set(classes(texts).values())
    less = corpus_pipeline.suffix_dedup(spark, one, DATA).cache()
    want = cut({r.doc_id: r.text for r in one.collect()})
    for r in less.collect():
        n_bytes, removed, _, _ = want[r.doc_id]
        assert len(r.text) == r.n_chars and n_bytes - removed - 6 * 4 <= len(r.text.encode()) <= n_bytes - removed
    mixed = corpus_pipeline.mix_sources(spark, less, DATA).cache()
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(less).collect()}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for i, (t, n) in taken.items():
        assert not n or abs(times.get(i, 0) - t / n) < 1
    packed = corpus_pipeline.pack_sequences(spark, mixed, DATA)
    whole = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    ids = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    lengths = np.array([r.length for r in packed.collect()])
    assert lengths.sum() == ids


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "mix_sources", "pack_sequences"]


def test_run_on_odd_tables(spark, corpus, repeated, empty, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table go through all stages; only the last stage's tables stay."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    corpus.union(repeated).select(columns).write.parquet(f"{tmp_path}/odd/documents.parquet")
    empty.select(columns).write.parquet(f"{tmp_path}/empty/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ends = {}
    for r in out:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert out
    for parts in ends.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 4096
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    left = {p.rpartition("/")[2].rpartition("-")[0] for p in tables.written()}
    assert not left & {"quality_rules", "near_dedup", "signatures", "suffix-segments", "mix-sizes"}
