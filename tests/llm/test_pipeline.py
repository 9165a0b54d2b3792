"""The corpus pipeline stage by stage against plain versions on a small table."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from lodestone.llm import decontamination, packing
from .test_llm import SF, low, plain_components, plain_hits


def test_stages_match_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    texts = {r.doc_id: r.text for r in results["toxicity"]}
    last = defaultdict(int)
    for doc, text in texts.items():
        last[low(text)] = max(last[low(text)], doc)
    assert {r.doc_id for r in results["exact_dedup"]} == set(last.values())
    left = sorted((i, texts[i]) for i in last.values())
    kept = {i for (i, _), (_, c) in zip(left, plain_components(left, 5), strict=True) if i == c}
    assert {r.doc_id for r in results["near_dedup"]} == kept
    items = {
        str(r.item_id): decontamination.words_of(r.text.encode())
        for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    }
    clean = {r.doc_id: r for r in results["decontamination"]}
    for i in kept:
        words = decontamination.words_of(texts[i].encode())
        hit = plain_hits(words, items, 10)[0]
        if len(hit) >= decontamination.MAX_COVERAGE * len(words) and hit:
            assert i not in clean
        elif not hit:
            assert clean[i].text == texts[i]
        else:
            assert not plain_hits(decontamination.words_of(clean[i].text.encode()), items, 10)[0]
            assert clean[i].n_chars == len(clean[i].text)
    encode = packing.public_encoder()
    tokens = defaultdict(int)
    for r in results["packing"]:
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(encode(r.text)) + 1 for i, r in clean.items()}
