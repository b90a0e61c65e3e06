"""The pipeline's stages, each on what the one before kept, against brute force."""

import re

import corpus_pipeline
from heliograph.llm import pii
from heliograph.llm.shared import written

FOLDER = "/root/testdata/sf0.001"


def shingle_sets(rows, n=5):
    out = {}
    for r in rows:
        w = r.text.encode().lower().split() if r.text else []
        out[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.columns == columns
        kept[name] = docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = {r.doc_id for r in kept["quality"]}
    assert sum(labels[i] == 1 for i in good if i in labels) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(labels[i] == 0 for i in good if i in labels) <= 0.2 * sum(q == 0 for q in labels.values())

    sets = shingle_sets(kept["quality"])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert {r.doc_id for r in kept["near_duplicates"]} == {i for i in ids if find(i) == i}

    assert {r.doc_id for r in kept["personal_data"]} == {r.doc_id for r in kept["near_duplicates"]}
    assert not any(re.search(r"[\w.]+@[\w-]+\.[\w.]+", r.text or "") for r in kept["personal_data"])
    assert pii.report(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert {r.doc_id for r in kept["mixture"]} <= {r.doc_id for r in kept["personal_data"]}

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sum(r.piece == 0 for r in packed) == len(kept["mixture"])
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)
