"""The language model's scores against a model that reads one word after another, written from its equations."""

import math

import numpy as np
import pyarrow as pa
import pytest

from heliograph.llm import language_model as lm


def vocabulary(words):
    """Head words of two strata in small classes and in trees, and a tail class of each."""
    rows = [(f"{'xy'[i % 2]}{i}a".encode(), 1 + i % 2, 900 // (1 + i) + 2) for i in range(words)] + [(lm.END, 0, 60)]
    head = pa.table({"word": pa.array([r[0] for r in rows], pa.binary()), "lead": [r[1] for r in rows], "c": [r[2] for r in rows]})
    v = lm.build_vocabulary(head, sum(r[2] for r in rows) + 40, words + 9)
    v.tail_log = -np.log10(np.arange(v.classes - v.first_tail) + 7.0)
    return v


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def log_share(logits, k):
    top = logits.max()
    return logits[k] - top - math.log(np.exp(logits - top).sum())


def plain(doc, flat, v):
    p = [x.astype(float) for x in lm.unpack(flat, v)]
    n, h, before, total = lm.STATE, np.zeros(lm.STATE), None, 0.0
    both = np.concatenate([p[lm.DECIDE], -p[lm.DECIDE]])
    for w in doc:
        own = p[lm.TABLE][v.inputs - 1 if before is None else v.input_of[before]]
        back = h @ p[lm.RECUR]
        keep, reset = sigmoid(own[:n] + back[:n]), sigmoid(own[n : 2 * n] + back[n : 2 * n])
        new = np.tanh(own[2 * n :] + reset * back[2 * n :])
        h = keep * h + (1 - keep) * new
        k = v.class_of[w]
        total += log_share(p[lm.CLASS].T @ h + p[lm.CLASS_BIAS], k)
        if w < 0:
            total += math.log(10) * v.tail_log[-1 - w - v.first_tail]
        for c, first, count in v.small:
            if c == k:
                total += log_share(p[lm.WORD][first : first + count] @ h + p[lm.WORD_BIAS][first : first + count], v.row_of[w] - first)
        if w >= 0:
            for at in range(v.tree.ptr[w], v.tree.ptr[w + 1]):
                total += math.log(sigmoid(both[v.tree.row[at]] @ (h @ p[lm.TURN]) + v.tree.bias[at]))
        before = w
    return total / math.log(10)


@pytest.mark.parametrize(("words", "small"), [(12, 64), (300, 5), (1500, 64)])
def test_scores_like_word_by_word(monkeypatch, words, small):
    monkeypatch.setattr(lm, "SMALL", small)
    v = vocabulary(words)
    rng = np.random.default_rng(words)
    start = lm.initial(v)
    flat = start + rng.normal(0, 0.3, len(start)).astype(start.dtype)
    every = [*range(len(v.counts)), *(-1 - k for k in range(v.first_tail, v.classes))]
    docs = [rng.choice(every, size).astype(np.int32) for size in (1, 2, 31, 32, 33, 64, 150, 5, 1)]
    assert lm.score_documents(docs, flat, v) == pytest.approx([plain(d, flat, v) for d in docs], rel=2e-5)
