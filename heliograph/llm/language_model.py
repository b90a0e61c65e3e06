"""A gated recurrent language model over words, trained and applied across partitions with numpy.

Probabilities are class-factored: p(word | history) = p(class | h) * p(word | class, h), h being the state
of a gated recurrent unit. Head words (relative frequency of at least 1/HEAD in training, so at most HEAD of
them) fall into classes by their leading stratum (language) and frequency. Both factors follow from the state
for every one of them: classes of up to SMALL words have a plain softmax, larger ones a softmax in the form of a
binary tree over their words, ordered by their endings and cut at half of their counts, where each decision has
its weights on the state (the most frequent NODES ones their own, others those of their class and depth) and
starts from the counts of its sides. All other words belong to tail classes, chosen by how they end, where
p(word | class) = (c + 1) / (n + v + 1) with the class's training tokens n and words v: unseen words share what
one further word would get. The OWN_INPUT most frequent words have inputs of their own, others those of their
class and a hash of their ending.

Texts become word numbers once. Training passes over every training document with truncated back-propagation:
windows of WINDOW steps, the state carried from one to the next. Documents stand behind one another in lanes, the
state starting anew with each, so memory follows the words at hand and not the longest text. Each partition
trains from the common parameters; their mean, weighted by tokens, opens the next round, so parameters depend on
how rows are dealt to partitions. The trees' gradients are taken at every TREE_EVERY-th of a window's places,
beginning at a random one. Counts come from all training documents. Scoring carries the state through each whole
document. Counts of tail words, which are many, are not sent to workers but joined by word, once a row and word.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

END = b"\n"  # no word contains a line feed
HEAD = 1_000_000
STATE, NODE, WINDOW, LANES = 16, 4, 32, 512
GRADES, STRATA, SMALL = 8, 6, 64
OWN_INPUT, ENDS = 1024, 16
NODES, DEPTHS, TREE_EVERY = 4096, 32, 4
MARKS = ".,;:!?)\"'"
LN10 = math.log(10.0)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# Words

def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded text; a longer text is a piece of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, lower-cased (A-Z), and their number in each text; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end leaves empty words
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
        flat = flat.filter(pa.array(full))
    return flat.cast(pa.binary()), counts


# Counts

MOST_COUNTED = 1_500_000
STRATUM_CODES = 1 << 12


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, stratum, c) summed over a partition, in several goes if there are very many words.

    A stratum is a number below STRATUM_CODES, so that sums and maxima run over numbers alone; the rare two
    strata with one number count as one.
    """
    held: list[pa.Table] = []
    names = ["word", "stratum", "c"]

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by(["word", "stratum"], use_threads=False).aggregate([("c", "sum")]).rename_columns(names)

    for batch in batches:
        for part in slices(batch, 0):
            flat, n = tokenized(part.column(0))
            code = np.array([zlib.crc32((s or "").encode()) % STRATUM_CODES for s in part.column(1).to_pylist()], np.int64)
            of = np.repeat(code, n)
            for s in np.unique(code):
                got = flat.filter(pa.array(of == s)).value_counts()
                held.append(pa.table([got.field("values"), pa.array(np.full(len(got), s)), got.field("counts").cast(pa.int64())], names=names))
                held.append(pa.table([pa.array([END], pa.binary()), pa.array([s], pa.int64()), pa.array([int((code == s).sum())], pa.int64())], names=names))
        if sum(t.num_rows for t in held) > MOST_COUNTED:
            held = [summed()]
            if held[0].num_rows > MOST_COUNTED // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held = []
    if held:
        yield from summed().to_batches(max_chunksize=50_000)


# The model

@dataclass
class Tree:
    """The way to each word of a large class: decisions from ``ptr[word]`` on, each with a row of weights and the bias of the
    side taken. Rows from ``rows`` on stand for the negative weights of the left side."""

    ptr: np.ndarray
    row: np.ndarray
    bias: np.ndarray
    rows: int


def build_tree(words: list[bytes], counts: np.ndarray, word_class: np.ndarray, large: np.ndarray) -> Tree:
    """Trees over the words of classes that are ``large``, level by level over all classes at once."""
    inside = np.flatnonzero(large[word_class]) if len(words) else np.empty(0, np.int64)
    backwards = [words[i][::-1] for i in inside.tolist()]
    inside = inside[np.array(sorted(range(len(inside)), key=lambda i: (word_class[inside[i]], backwards[i])), np.int64)]
    cls, c = word_class[inside], np.concatenate(([0.0], np.cumsum(counts[inside], dtype=np.float64)))
    place = np.arange(len(inside))
    lo, hi = np.searchsorted(cls, cls), np.searchsorted(cls, cls, side="right")
    steps: list[tuple[np.ndarray, ...]] = []
    masses: list[np.ndarray] = []
    shared: list[np.ndarray] = []
    nodes = 0
    while len(i := place[hi - lo > 1]):
        low, high = lo[i], hi[i]
        new = np.concatenate(([True], low[1:] != low[:-1]))
        seg, a, b = np.cumsum(new) - 1, low[new], high[new]
        middle = (c[a] + c[b]) / 2
        cut = np.searchsorted(c, middle)
        cut = np.clip(np.where(middle - c[cut - 1] < c[cut] - middle, cut - 1, cut), a + 1, b - 1)
        bias = np.log((c[b] - c[cut]) / (c[cut] - c[a]))
        right = i >= cut[seg]
        steps.append((i, nodes + seg, right, np.where(right, bias[seg], -bias[seg]).astype(np.float32)))
        masses.append(c[b] - c[a])
        shared.append(NODES + cls[a].astype(np.int64) * DEPTHS + min(len(masses), DEPTHS) - 1)
        lo[i], hi[i] = np.where(right, cut[seg], low), np.where(right, high, cut[seg])
        nodes += len(a)
    length = np.zeros(len(words) + 1, np.int64)
    if not steps:
        return Tree(length, np.empty(0, np.int32), np.empty(0, np.float32), 1)
    row = np.concatenate(shared)
    often = np.argsort(-np.concatenate(masses), kind="stable")[:NODES]
    row[often] = np.arange(len(often))
    word, node, right, bias = (np.concatenate(x) for x in zip(*steps, strict=True))
    rows = NODES + len(large) * DEPTHS
    order = np.argsort(inside[word], kind="stable")  # decisions of a word stay in the order of levels
    length[1:] = np.cumsum(np.bincount(inside[word], minlength=len(words)))
    return Tree(length, np.where(right, row[node], row[node] + rows)[order].astype(np.int32), bias[order], rows)


@dataclass
class Vocabulary:
    """Head words with their counts and classes; the tail classes; what scoring needs of the totals.

    A token is its place among the head words, or -1 - (tail class). The tables by token have the tail classes
    behind the head words in falling order, so that such a number finds its class.
    """

    tokens: int
    kinds: int
    words: pa.Array
    counts: np.ndarray
    class_of: np.ndarray
    input_of: np.ndarray
    row_of: np.ndarray  # row in the output weights of small classes, or -1
    small: list[tuple[int, int, int]]  # (class, first row, rows)
    tree: Tree
    classes: int
    first_tail: int
    endings: pa.Array
    ending_class: np.ndarray
    prior: np.ndarray
    tail_log: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def inputs(self) -> int:
        return OWN_INPUT + self.classes * ENDS + 1

    @property
    def rows(self) -> int:
        return max(1, sum(n for _, _, n in self.small))

    @property
    def end(self) -> int:
        at = pc.index(self.words, pa.scalar(END, pa.binary())).as_py()
        return at if at >= 0 else -1 - self.first_tail

    def tail_classes(self, words: pa.Array) -> np.ndarray:
        """The tail class of each word, by the longest known ending of up to three bytes."""
        bare = pc.ascii_rtrim(words.cast(pa.string()), characters=MARKS).cast(pa.binary())
        out = np.full(len(words), self.first_tail, np.int32)
        for n in (1, 2, 3):
            at = pc.fill_null(pc.index_in(pc.binary_slice(bare, -n), value_set=self.endings), -1).to_numpy(zero_copy_only=False)
            out = np.where(at >= 0, self.ending_class[at], out) if len(self.endings) else out
        return out


def build_vocabulary(head: pa.Table, tokens: int, kinds: int) -> Vocabulary:
    """From (word, lead, c) of the head words: the stratum in which one partition saw a word most, and its count."""
    head = head.sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()
    words = pa.chunked_array(head.column("word").chunks, pa.binary()).combine_chunks()
    raw, counts, lead = words.to_pylist(), head.column("c").to_numpy().astype(np.int64), head.column("lead").to_numpy().astype(np.int64)
    wordy = np.array([w != END for w in raw], bool)
    mass = np.bincount(lead[wordy], weights=counts[wordy], minlength=1)
    strata = np.argsort(-mass, kind="stable")[:STRATA]
    strata = strata[mass[strata] > 0] if mass.any() else strata[:1]
    of = np.full(STRATUM_CODES, len(strata) - 1)
    of[strata] = np.arange(len(strata))
    stratum, label = of[lead], np.zeros(len(raw), np.int64)  # 0: the end token
    for i in range(len(strata)):
        at = np.flatnonzero((stratum == i) & wordy)
        before = np.cumsum(counts[at]) - counts[at]
        label[at] = 1 + i * GRADES + np.minimum(GRADES - 1, GRADES * np.sqrt(before / max(1, counts[at].sum()))).astype(np.int64)
    used, word_class = np.unique(label, return_inverse=True)
    first_tail = max(1, len(used))
    total = first_tail + len(strata)
    mass = np.bincount(word_class, weights=counts, minlength=first_tail)
    members = np.bincount(word_class, minlength=first_tail)
    row, small, rows = np.full(len(raw), -1, np.int32), [], 0
    for k in np.flatnonzero((members > 1) & (members <= SMALL)).tolist():
        at = np.flatnonzero(word_class == k)
        row[at] = rows + np.arange(len(at))
        small.append((k, rows, len(at)))
        rows += len(at)
    votes: dict[bytes, Counter] = {}
    for w, i in zip(raw, stratum.tolist(), strict=True):
        if w != END:
            bare = w.rstrip(MARKS.encode())
            for n in range(1, min(3, len(bare)) + 1):
                votes.setdefault(bare[-n:], Counter())[i] += 1
    ending_class = np.array([first_tail + max(sorted(c), key=c.__getitem__) for c in votes.values()], np.int32)
    prior = np.ones(total)
    prior[:first_tail] += mass
    prior[first_tail:] += max(0.0, tokens - float(counts.sum())) / len(strata)
    own = OWN_INPUT + word_class * ENDS + np.array([zlib.crc32(w[-2:]) % ENDS for w in raw], np.int64)
    own[:OWN_INPUT] = np.arange(min(OWN_INPUT, len(raw)))
    down = np.arange(total)[::-1]
    return Vocabulary(
        tokens, kinds, words, counts, np.concatenate([word_class, down]).astype(np.int32), np.concatenate([own, OWN_INPUT + down * ENDS]).astype(np.int32),
        np.concatenate([row, np.full(total, -1, np.int32)]), small, build_tree(raw, counts, word_class, members > SMALL), total, first_tail,
        pa.array(list(votes), pa.binary()), ending_class, np.log(prior / prior.sum()),
    )


TABLE, RECUR, CLASS, CLASS_BIAS, WORD, WORD_BIAS, TURN, DECIDE = range(8)  # places in the list of parameters


def shapes(v: Vocabulary) -> list[tuple[int, ...]]:
    return [(v.inputs, 3 * STATE), (STATE, 3 * STATE), (STATE, v.classes), (v.classes,), (v.rows, STATE), (v.rows,), (STATE, NODE), (v.tree.rows, NODE)]


def unpack(flat: np.ndarray, v: Vocabulary) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(v):
        n = math.prod(s)
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def initial(v: Vocabulary, seed: int = 7) -> np.ndarray:
    """Small random weights; output biases at the logs of the counts; decisions of the trees as the counts alone say."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.2, s) if len(s) == 2 else np.zeros(s) for s in shapes(v)]
    parts[CLASS] *= 0.1
    parts[WORD] *= 0.1
    parts[DECIDE][:] = 0.0
    parts[CLASS_BIAS][:] = v.prior
    for k, at, n in v.small:
        c = v.counts[v.class_of[: len(v.counts)] == k]
        parts[WORD_BIAS][at : at + n] = np.log(c / c.sum())
    return np.concatenate([x.ravel() for x in parts]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _forward(p: list[np.ndarray], x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple | None]:
    """States behind each step (steps, lanes, STATE) from ``h``, zero where a document begins; what the way back needs."""
    table, recur = p[TABLE], p[RECUR]
    steps, lanes = x.shape
    states = np.empty((steps, lanes, STATE), np.float32)
    former, gates, new, inner = (np.empty((steps if keep else 1, lanes, k * STATE), np.float32) for k in (1, 2, 1, 1))
    begins, lane = np.nonzero(fresh)
    cuts = np.searchsorted(begins, np.arange(steps + 1))
    for t in range(steps):
        was, zr, c, n = (y[t if keep else 0] for y in (former, gates, new, inner))
        was[...] = h
        if cuts[t] < cuts[t + 1]:
            was[lane[cuts[t] : cuts[t + 1]]] = 0.0
        pre, a = table[x[t]], was @ recur
        np.add(pre[:, : 2 * STATE], a[:, : 2 * STATE], out=zr)
        _sigmoid(zr)
        n[...] = a[:, 2 * STATE :]
        np.multiply(zr[:, STATE:], n, out=c)
        c += pre[:, 2 * STATE :]
        np.tanh(c, out=c)
        h = np.subtract(was, c, out=states[t])
        h *= zr[:, :STATE]
        h += c
    return states, (former, gates, new, inner) if keep else None


def _softmax(x: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise softmax of (choices, places), in place, and the log-probability of each place's picked choice."""
    x -= x.max(axis=0)
    log_p = x[picked, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    log_p -= np.log(total)
    return x, log_p


def _decisions(p: list[np.ndarray], tree: Tree, words: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """For words of large classes and their states: the place of each one's first decision; of each decision the row,
    weights, state turned for it, and exp(-logit) of the side taken, so that its probability is 1 / (1 + that)."""
    first = tree.ptr[words]
    n = tree.ptr[words + 1] - first
    starts = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(first - starts, n)
    row = tree.row[at]
    weights, turned = np.concatenate([p[DECIDE], -p[DECIDE]])[row], np.repeat(out @ p[TURN], n, axis=0)
    logit = np.einsum("ij,ij->i", weights, turned)
    logit += tree.bias[at]
    np.negative(logit, out=logit)
    np.minimum(logit, 20.0, out=logit)  # so that the product over a way is finite
    return starts, row, weights, turned, np.exp(logit, out=logit)


def train_window(
    p: list[np.ndarray], v: Vocabulary, x: np.ndarray, ids: np.ndarray, real: np.ndarray, fresh: np.ndarray, h: np.ndarray, every: int = TREE_EVERY, offset: int = 0
) -> tuple[np.ndarray, list[np.ndarray], float]:
    """One window of truncated back-propagation: the state behind it, gradients of the mean loss, the summed loss.

    The trees' part of both is taken at every ``every``-th of their places from ``offset`` on, and multiplied.
    """
    steps, lanes = x.shape
    states, (former, gates, new, inner) = _forward(p, x, fresh, h, True)
    out = states.reshape(-1, STATE)
    real, ids = real.ravel(), ids.ravel()
    n = max(1, int(real.sum()))
    flat, places = v.class_of[ids], np.arange(len(out))
    d, log_p = _softmax(p[CLASS].T @ out.T + p[CLASS_BIAS][:, None], flat)
    loss = -float(log_p[real].sum())
    d[flat, places] -= 1
    d *= (real / n).astype(np.float32)
    grads = [np.zeros_like(p[TABLE]), None, (d @ out).T, d.sum(axis=1), np.zeros_like(p[WORD]), np.zeros_like(p[WORD_BIAS]), np.zeros_like(p[TURN]), np.zeros_like(p[DECIDE])]
    back = d.T @ p[CLASS].T
    rows = v.row_of[ids]
    for k, at, count in v.small:
        hit = np.flatnonzero((flat == k) & real)
        if len(hit):
            w, o = p[WORD][at : at + count], out[hit]
            mine = rows[hit] - at
            e, lp = _softmax(w @ o.T + p[WORD_BIAS][at : at + count, None], mine)
            loss -= float(lp.sum())
            e[mine, np.arange(len(hit))] -= 1
            e /= np.float32(n)
            grads[WORD][at : at + count] = e @ o
            grads[WORD_BIAS][at : at + count] = e.sum(axis=1)
            back[hit] += e.T @ w
    ptr = v.tree.ptr
    hit = np.flatnonzero(real & (ids >= 0))
    hit = hit[ptr[ids[hit] + 1] > ptr[ids[hit]]][offset::every]
    if len(hit):
        o = out[hit]
        starts, row, weights, turned, e = _decisions(p, v.tree, ids[hit], o)
        loss += every * float(np.log1p(e).sum())
        g = (e / (1 + e) * np.float32(-every / n))[:, None]
        turned *= g
        weights *= g
        for i in range(NODE):
            both = np.bincount(row, weights=turned[:, i], minlength=2 * v.tree.rows)
            grads[DECIDE][:, i] = both[: v.tree.rows] - both[v.tree.rows :]
        to_turned = np.add.reduceat(weights, starts, axis=0)
        grads[TURN][...] = o.T @ to_turned
        back[hit] += to_turned @ p[TURN].T
    back = back.reshape(steps, lanes, STATE)
    z, r = gates[:, :, :STATE], gates[:, :, STATE:]
    by_c = 1 - new * new
    by_z = (former - new) * z
    still = 1 - z
    by_z *= still
    by_c *= still
    by_r = inner * r
    by_r *= 1 - r
    to_table = np.empty((steps, lanes, 3 * STATE), np.float32)
    to_recur = np.empty((steps, lanes, 3 * STATE), np.float32)
    dh = np.zeros((lanes, STATE), np.float32)
    turn = np.ascontiguousarray(p[RECUR].T)
    flows = ~fresh[:, :, None]
    for t in range(steps - 1, -1, -1):
        dh += back[t]
        part, own = to_recur[t], to_table[t]
        dc = np.multiply(dh, by_c[t], out=own[:, 2 * STATE :])
        np.multiply(dh, by_z[t], out=part[:, :STATE])
        np.multiply(dc, by_r[t], out=part[:, STATE : 2 * STATE])
        np.multiply(dc, r[t], out=part[:, 2 * STATE :])
        dh *= z[t]
        dh += part @ turn
        dh *= flows[t]  # nothing goes back into the document before
    to_table[:, :, : 2 * STATE] = to_recur[:, :, : 2 * STATE]
    grads[RECUR] = former.reshape(-1, STATE).T @ to_recur.reshape(-1, 3 * STATE)
    order = np.argsort(x.ravel(), kind="stable")
    at = x.ravel()[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    grads[TABLE][at[first]] = np.add.reduceat(to_table.reshape(-1, 3 * STATE)[order], first, axis=0)
    return states[-1], grads, loss


@dataclass
class Adam:
    rate: float
    mean: np.ndarray
    square: np.ndarray
    steps: int = 0

    def __call__(self, flat: np.ndarray, grads: list[np.ndarray]) -> None:
        g = np.concatenate([x.ravel() for x in grads])
        g *= min(1.0, 1.0 / (float(np.sqrt(np.dot(g, g))) + 1e-12))
        self.steps += 1
        self.mean *= 0.9
        self.mean += 0.1 * g
        self.square *= 0.99
        g *= g
        g *= 0.01
        self.square += g
        np.sqrt(self.square, out=g)
        g /= math.sqrt(1 - 0.99**self.steps)
        g += 1e-6
        np.divide(self.mean, g, out=g)
        g *= self.rate / (1 - 0.9**self.steps)
        flat -= g


# Documents as arrays

@dataclass
class Lanes:
    """Documents (arrays of tokens) behind one another in lanes, the longest lane first.

    ``at`` is where each document begins in ``ids``; ``offsets`` and ``loads`` are where each lane begins and its tokens.
    """

    ids: np.ndarray
    inputs: np.ndarray
    fresh: np.ndarray
    at: np.ndarray
    offsets: np.ndarray
    loads: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], v: Vocabulary, lanes: int, seed: int | None = None) -> Lanes:
        """Every document, longest first, goes to the lane with the fewest tokens; with a seed each lane is shuffled."""
        lengths = np.array([len(x) for x in docs])
        heap: list[tuple[int, int]] = [(0, i) for i in range(min(lanes, len(docs)))]
        members: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-lengths, kind="stable").tolist():
            load, i = heap[0]
            members[i].append(d)
            heapq.heapreplace(heap, (load + int(lengths[d]), i))
        heap.sort(reverse=True)
        loads, order = np.array([x[0] for x in heap]), []
        rng = np.random.default_rng(seed)
        for _, i in heap:
            order += rng.permutation(members[i]).tolist() if seed is not None else members[i]
        ids = np.concatenate([docs[d] for d in order])
        begins = np.cumsum(lengths[order]) - lengths[order]
        at, fresh, inputs = np.empty(len(docs), np.int64), np.zeros(len(ids), bool), np.empty(len(ids), np.int32)
        at[order] = begins
        fresh[begins] = True
        inputs[1:] = v.input_of[ids[:-1]]
        inputs[begins] = v.inputs - 1
        return cls(ids, inputs, fresh, at, np.cumsum(loads) - loads, loads)

    def windows(self, steps: int, longest: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``ids``, which are real), both (steps, live lanes); ``longest`` makes them longer where few lanes are left."""
        at, most = 0, int(self.loads[0])
        while at < most:
            live = int(np.count_nonzero(self.loads > at))
            n = min(most - at, max(steps, steps * len(self.loads) // live) if longest else steps)
            step = at + np.arange(n)[:, None]
            yield np.minimum(self.offsets[:live] + step, len(self.ids) - 1), step < self.loads[:live]
            at += n


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, ids binary, tail array<binary>, times array<long>"


def encode(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts one after another, with end tokens; their number in each text; the tail words: words, number of the
    text, place in the words and times, once a text and word, in the order of texts."""
    flat, counts = tokenized(texts)
    n = len(counts)
    doc = np.repeat(np.arange(n), counts)
    at = pc.fill_null(pc.index_in(flat, value_set=v.words), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    miss = np.flatnonzero(at < 0)
    tail = flat.take(pa.array(miss)).dictionary_encode()
    words, code = tail.dictionary, tail.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at[miss] = -1 - v.tail_classes(words)[code]
    ids = np.full(len(flat) + n, v.end, np.int32)
    ids[np.arange(len(flat)) + doc] = at
    pair, times = np.unique(doc[miss] * max(1, len(words)) + code, return_counts=True)
    return ids, counts + 1, words, pair // max(1, len(words)), pair % max(1, len(words)), times


def _list_array(values: pa.Array, doc: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def _encode(shared):
    """ENCODED for (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = shared.value
        log_c = np.log10(v.counts + 1.0)
        every = math.log10(v.tokens + v.kinds + 1)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 2):
                n = part.num_rows
                ids, counts, words, doc, code, times = encode(part.column(2), v)
                of = np.repeat(np.arange(n), counts)
                hit = ids >= 0
                known = np.bincount(of[hit], minlength=n)
                base = np.bincount(of[hit], weights=log_c[ids[hit]], minlength=n) - every * counts
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int64) * 4
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<i4"))])
                tail = _list_array(words.take(pa.array(code)), doc, n)
                cols = [pa.array(np.arange(row, row + n)), part.column(0), part.column(1), pa.array(counts), pa.array(known), pa.array(base), blobs, tail, _list_array(pa.array(times), doc, n)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ENCODED.split(", ")])
                row += n

    return run


def _groups(batches: Iterator[pa.RecordBatch], ids: int, docs: int = 65536, tokens: int = 8_000_000) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Documents of a partition, a bounded number of tokens at a time (a longer one alone), with their rows."""
    held: list[np.ndarray] = []
    rows: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        begin = 0
        for i, blob in enumerate(batch.column(ids)):
            x = np.frombuffer(blob.as_buffer(), "<i4")
            if held and (n + len(x) > tokens or len(held) >= docs):
                yield held, [*rows, batch.slice(begin, i - begin)]
                held, rows, n, begin = [], [], 0, i
            held.append(x)
            n += len(x)
        rows.append(batch.slice(begin))
    if held:
        yield held, rows


PART = 8192  # parameters in a row


def _train(shared, rate: float):
    """A partition's parameters after one pass over its documents, in parts, with its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = shared.value
        flat = start.copy()
        adam = Adam(rate, np.zeros_like(flat), np.zeros_like(flat))
        tokens = 0
        for docs, _ in _groups(batches, 0):
            lanes = Lanes.of(docs, v, max(16, min(LANES, len(docs) // 16)), seed=len(docs))
            rng = np.random.default_rng(len(docs))
            tokens += len(lanes.ids)
            h = np.zeros((len(lanes.loads), STATE), np.float32)
            for at, real in lanes.windows(WINDOW):
                live = at.shape[1]
                h, grads, _ = train_window(unpack(flat, v), v, lanes.inputs[at], lanes.ids[at], real, lanes.fresh[at], h[:live], offset=int(rng.integers(TREE_EVERY)))
                adam(flat, grads)
        if tokens:
            parts = [flat[i : i + PART].astype("<f4").tobytes() for i in range(0, len(flat), PART)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([float(tokens)] * len(parts)), pa.array(parts, pa.binary())], names=["part", "tokens", "value"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, tokens, value): the means of parts, weighted by tokens; all rows of a part are in one partition."""
    sums: dict[int, np.ndarray] = {}
    weights: Counter = Counter()
    for batch in batches:
        for part, tokens, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(value, "<f4") * np.float64(tokens)
            sums[part] = sums[part] + x if part in sums else x
            weights[part] += tokens
    for part, x in sums.items():
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([float(weights[part])]), pa.array([(x / weights[part]).astype("<f4").tobytes()], pa.binary())], names=["part", "tokens", "value"])


def score_documents(docs: list[np.ndarray], flat: np.ndarray, v: Vocabulary) -> np.ndarray:
    """log10 p of each document, tail words without their own counts."""
    p, lanes, ptr = unpack(flat, v), Lanes.of(docs, v, LANES), v.tree.ptr
    log_p = np.zeros(len(lanes.ids))
    h = np.zeros((len(lanes.loads), STATE), np.float32)
    for at, real in lanes.windows(WINDOW, longest=True):
        states, _ = _forward(p, lanes.inputs[at], lanes.fresh[at] & real, h[: at.shape[1]], False)
        h = states[-1]
        at = at[real]
        o, ids = states[real], lanes.ids[at]
        cls, rows = v.class_of[ids], v.row_of[ids]
        got = _softmax(p[CLASS].T @ o.T + p[CLASS_BIAS][:, None], cls)[1].astype(np.float64)
        got += np.where(ids >= 0, 0.0, v.tail_log[np.maximum(cls - v.first_tail, 0)] * LN10)
        for k, first, count in v.small:
            hit = np.flatnonzero((cls == k) & (rows >= 0))
            if len(hit):
                got[hit] += _softmax(p[WORD][first : first + count] @ o[hit].T + p[WORD_BIAS][first : first + count, None], rows[hit] - first)[1]
        hit = np.flatnonzero(ids >= 0)
        hit = hit[ptr[ids[hit] + 1] > ptr[ids[hit]]]
        if len(hit):
            starts, *_, e = _decisions(p, v.tree, ids[hit], o[hit])
            got[hit] -= np.log(np.multiply.reduceat(1 + e.astype(np.float64), starts))
        log_p[at] = got
    order = np.argsort(lanes.at)
    out = np.empty(len(docs))
    out[order] = np.add.reduceat(log_p, lanes.at[order]) / LN10
    return out


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, score_head double"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = shared.value
        for docs, rows in _groups(batches, 6):
            score, at = score_documents(docs, flat, v), 0
            for part in rows:
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(score[at : at + part.num_rows])], names=[x.split()[0] for x in SCORED.split(", ")])
                at += part.num_rows

    return run


def _tail_totals(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        n, kinds = np.zeros(v.classes, np.int64), np.zeros(v.classes, np.int64)
        for batch in batches:
            k = v.tail_classes(batch.column(0))
            n += np.bincount(k, weights=batch.column(1).to_numpy(), minlength=v.classes).astype(np.int64)
            kinds += np.bincount(k, minlength=v.classes)
        yield pa.record_batch([pa.array(np.arange(v.classes, dtype=np.int32)), pa.array(n), pa.array(kinds)], names=["class", "n", "kinds"])

    return run


ROUNDS = ((8, 1e-2), (1, 4e-3))  # every n-th training document by hash, and the step size


def score(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", rounds: tuple[tuple[int, float], ...] = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``held``: rows not trained on. Null and empty texts are the end token alone; repeated rows count each.
    ``stratum_col`` (null: a stratum of its own) only shapes the classes. Without any training document all
    words are unseen. The first round warms up on a fixed share of the documents, the last one takes all.
    """
    sc = docs.sparkSession.sparkContext
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)) if held is None else held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), stratum.alias("stratum"))

    counted = rows.where("not held_out").select("text", "stratum").mapInArrow(_count, "word binary, stratum long, c long")
    counts = counted.groupBy("word").agg(F.sum("c").alias("c"), F.max(F.col("c") * STRATUM_CODES + F.col("stratum")).alias("lead"))
    counts = written(counts.select("word", "c", (F.col("lead") % STRATUM_CODES).alias("lead")), "lm-counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    in_head = F.col("c") * F.lit(HEAD) >= F.lit(tokens)
    v = build_vocabulary(counts.where(in_head).select("word", "lead", "c").toArrow(), tokens, kinds)  # at most HEAD rows
    tail = counts.where(~in_head).select("word", "c")
    shared = sc.broadcast(v)
    totals = tail.mapInArrow(_tail_totals(shared), "class int, n long, kinds long").groupBy("class").agg(F.sum("n"), F.sum("kinds")).collect()
    left = np.ones(v.classes - v.first_tail)
    for k, n, m in totals:
        if k >= v.first_tail:
            left[k - v.first_tail] += n + m
    encoded = written(rows.select("doc_id", "held_out", "text").mapInArrow(_encode(shared), ENCODED), "lm-tokens")
    v.tail_log = -np.log10(left)
    v.prior[v.first_tail :] = np.log(left / max(1, tokens))
    flat = initial(v)
    for every, rate in rounds:
        part = encoded.where("not held_out")
        part = part.where(F.pmod(F.xxhash64("doc_id", "row"), F.lit(every)) == 0) if every > 1 else part
        trained = part.select("ids").mapInArrow(_train(sc.broadcast((v, flat)), rate), "part int, tokens double, value binary")
        means = {r.part: r.value for r in trained.repartition("part").mapInArrow(_mean, "part int, tokens double, value binary").collect()}  # the parameters once
        if means:
            flat = np.concatenate([np.frombuffer(means[i], "<f4") for i in range(len(means))])

    scored = encoded.select(*[x.split()[0] for x in ENCODED.split(", ")][:7]).mapInArrow(_score(sc.broadcast((v, flat))), SCORED)
    words = encoded.select("row", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("row", F.col("w.tail").alias("word"), F.col("w.times").alias("times"))
    met = words.join(tail, "word", "left")
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("tail_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("n_tail"))
    more = F.coalesce("tail_log", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_head") + more).alias("base_score"), (F.col("score_head") + more).alias("score"),
    )
