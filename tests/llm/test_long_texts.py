"""One text of 60,000 words, and a copy of it with another word in the middle, through every document operator."""

import hashlib
import random

import pytest

from heliograph.llm import language_model, mixing, mpeg, ngram_join, packing, pii, quality, suffix_dedup, toxicity

WORDS = 60_000


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(7)
    words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.randrange(4000)}" for _ in range(WORDS)]
    words[100] = "me@mail.example.com"
    other = [*words[: WORDS // 2], "different", *words[WORDS // 2 + 1 :]]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join(other), "en", "a"), (3, "a short one", "en", "b"), (4, None, None, None)]
    rows += [(10 + i, " ".join(rng.choices(words, k=30)), "en", "b") for i in range(40)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def long_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), *[(10 + i, i % 2, int(i % 4 == 0)) for i in range(40)]], "doc_id long, quality int, toxic int")


def test_rows_and_sizes(spark, long_docs, long_labels):
    rows, docs = long_docs
    judged = {r.doc_id for r in quality.judge(docs, long_labels).collect()}
    graded = {r.doc_id for r in toxicity.score(docs, long_labels).collect()}
    assert judged == graded == {r[0] for r in rows}
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert mixed[1].size == mixed[2].size == WORDS and mixed[4].size == 0
    scored = {r.doc_id: r for r in language_model.score(docs).collect()}
    assert scored[1].n_tokens == WORDS + 1 and scored[4].n_tokens == 1 and scored[1].score < 0


def test_copies_and_personal_data(long_docs):
    rows, docs = long_docs
    halves = {(r.doc_id, r.first_word, r.end_word) for r in suffix_dedup.repeats(docs).collect()}
    middle = WORDS // 2
    assert {(d, a, b) for d in (1, 2) for a, b in ((0, middle), (middle + 1, WORDS))} <= halves
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect()}
    assert linked[1][1] == linked[2][1] == 1 and linked[1][0] > WORDS - 10 and linked[3] == (1, 3) and linked[4] == (0, 4)
    found = {r.doc_id: r for r in pii.report(docs).collect()}
    at = rows[0][1].index("me@mail")
    assert found[1].n_email == 1 and f"email:{at}:{at + 19}" in found[1].spans


def test_media_and_packing(long_docs):
    rows, docs = long_docs
    stored = {r.doc_id: r for r in mpeg.digest(docs).collect()}
    for i, text, *_ in rows[:4]:
        raw = (text or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert stored[i].n_bytes == len(raw) and stored[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
    pieces = packing.pack(docs).collect()
    mine = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == 1)
    assert len(mine) > 60 and all(0 < n <= 2048 for _, _, n in mine)
    assert [p for p, _, _ in mine] == list(range(len(mine))) and all(b[1] == a[1] + a[2] for a, b in zip(mine, mine[1:], strict=False))
