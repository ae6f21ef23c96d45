"""The pipeline against its stages by brute force, and what each keeps."""

from collections import Counter, defaultdict

import corpus_pipeline
from morphspark.llm import near_dedup, packing, queries, toxicity
from tests.llm.test_operators import brute_mix, empty, frame, jaccard, odd, pairs_at

SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir=SF):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).cache())
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, clean, exact, near, mixed, packed = [t.collect() for t in stages(spark, docs)]
    said = {r.doc_id for r in toxicity.toxicity(docs, labels=spark.read.parquet(f"{SF}/labels.parquet")).where("toxic").collect()}
    assert {r.doc_id for r in clean} == {r.doc_id for r in before} - said
    first = {}
    for r in sorted(clean, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert {r.doc_id for r in exact} == set(first.values())
    kept = {r.doc_id for r in near}
    texts = {r.doc_id: " ".join("".join(c.lower() if c.isalnum() else " " for c in r.text).split()) for r in exact}
    assert kept <= set(texts)
    for i in kept:  # none of those that stay are near copies
        for j in kept:
            if i < j and len(texts[i].split()) > 1 and len(texts[j].split()) > 1:
                assert jaccard(texts[i], texts[j]) < 0.75
    want = brute_mix([(r.doc_id, r.text, r.source) for r in near], (0.85,), 0.7)
    assert sorted(r.doc_id for r in mixed) == sorted(x[0] for x in want)
    n, load = {r.doc_id: len(r.text.split()) for r in mixed}, Counter()
    got = defaultdict(int)
    for r in packed:
        got[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            load[r.bin_id] += r.n_tokens
    assert got == n and max(load.values()) <= packing.CAPACITY


def test_near_stage_at_its_threshold(spark):
    """Of copies at the threshold nine in ten go, not only those at 0.75."""
    rows = pairs_at(20, 3000)
    assert near_dedup.THRESHOLD <= jaccard(rows[0][1], rows[1][1]) < 0.75
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, frame(spark, rows), SF).select("doc_id").collect()}
    assert len(rows) - len(kept) >= 0.9 * 3000 and all(i in kept for i in range(0, len(rows), 2))


def test_run_and_names(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd(spark), empty(spark)):
        out = stages(spark, docs)
        assert all(t.columns == docs.columns for t in out[1:5])
    assert out[-1].count() == 0
