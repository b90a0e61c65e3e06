"""Whitening, mined URL rules and the conversation trie against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from heliograph.llm import prefix_trie, url_rules, whitening

# --- whitening ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x int, n int, piece string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS).repartition(5)


def test_eigenvalues_keep_relative_accuracy():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 8, 31):
        half = rng.normal(size=(d + 40, d)) * 10.0 ** -np.linspace(0, 6, d)
        values, rows = whitening.jacobi(half.T @ half)
        exact = np.linalg.svd(half, compute_uv=False) ** 2
        assert np.allclose(values, exact, rtol=1e-9)
        assert np.allclose(rows @ rows.T, np.eye(d), atol=1e-13)
        assert np.allclose(rows @ (half.T @ half) @ rows.T, np.diag(values), atol=1e-13 * values[0])


def test_eigenvalues_of_special_matrices():
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0.0] * 3
    values, rows = whitening.jacobi(np.ones((4, 4)))
    assert np.allclose(values, [4, 0, 0, 0], atol=1e-14) and np.allclose(np.abs(rows[0]), 0.5)
    assert np.allclose(whitening.jacobi(np.diag([1.0, 5.0, 5.0, 1e-9]))[0], [5, 5, 1, 1e-9], rtol=1e-14)


def plain_whitening(rows, keep=4):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and v]
    x = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, (_, v) in enumerate(good)}
    points = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, sums = len(points), points.sum(0)
    z = (points - sums / n).astype(float)
    values, vecs = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:keep]
    out = {}
    for k, (i, _) in enumerate(good):
        v = np.array(x[k], dtype=object)
        far = int(((n * v - sums) ** 2).sum())
        y = (v - sums / n).astype(float) @ vecs[:, order] / np.sqrt(values[order])
        out.setdefault((i, far), []).append((n, np.abs(y), values[order] / values.sum()))
    return out


def test_whitening_like_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.1]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third of all rows have one vector
    rows += [(7, rows[8][1]), (None, rows[9][1]), (2000, None), (2001, [1.0, None] * 3), (2002, [math.nan] * 6)]
    rows += [(2003, [math.inf] + [0.0] * 5), (2004, [])]
    want = plain_whitening(rows)
    got = {}
    for r in whitening.whiten(vectors(spark, rows)).collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    assert set(got) == set(want)
    for key, found in got.items():
        times = len(want[key])
        assert sorted(r.component for r in found) == sorted([1, 2, 3, 4] * times)
        for r in found:
            n, y, explained = want[key][0]
            assert r.n == n and 0 <= r.identity_error < 1e-9
            assert abs(abs(r.whitened) - y[r.component - 1]) < 1e-8
            assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [math.nan])])).collect() == []
    same = whitening.whiten(vectors(spark, [(i, [0.5, -0.5]) for i in range(4)])).collect()
    assert len(same) == 8 and {(r.n, r.deviation, r.whitened, r.identity_error) for r in same} == {(1, 0, None, None)}
    # one dimension of two has no variance
    flat = whitening.whiten(vectors(spark, [(i, [i / 4, 1.0]) for i in range(4)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-12
    # the table's length is that of most vectors
    mixed = vectors(spark, [(1, [0.1, 0.2]), (2, [0.3, 0.1]), (3, [1.0])])
    assert {r.vec_id for r in whitening.whiten(mixed).collect()} == {1, 2}


def test_deviation_is_exact_or_null():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert whitening.deviation(x, 1 << 10, (0, 0)) == [None, 25 << 20]
    assert whitening.deviation(x, 1, (1 << 40, 0)) == [None, None]
    assert whitening.deviation(np.array([[5, 6]]), 3, (1, 2)) == [14 * 14 + 16 * 16]


# --- URL rules ---------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, row int, best string"
LABELS = "doc_id long, quality int, toxic int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", 1, "y") for i, u in rows], PAGES).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return m[1].translate(lower), m[2]


def plain_rule(host, path):
    fits = [
        r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_given_rules(spark):
    urls = [
        None, "", "example.net/en/", "http://", "://net/", "http://net", "http://net/", "HTTPS://A.NET/x", "http://xnet/",
        "http://example.net/en/1", "http://a.example.net/EN/1", "http://example.com/de/?q", "http://example.com/de",
        "http://b.org/fr/#f", "http://org/fr/", "http://net?x=/", "http://a.b://c.net/d", "http://x.net/a\nb?c", "ftp://\u00c4.Org/fr/",
        "http://h.net/" + "part/" * 60_000, "http://" + "h" * 200_000 + ".org/fr/", "://" * 90_000, "http://a.org/x?" + "q=1&" * 50_000,
    ]
    got = {r.url: r for r in pages(spark, list(enumerate(urls))).withColumns(
        dict(zip(("host", "path", "rest"), url_rules.parts(url_rules.F.col("url")), strict=True))
    ).withColumn("given", url_rules.given(url_rules.F.col("host"), url_rules.F.col("path"))).collect()}
    for u in urls:
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        assert (got[u].host, got[u].path) == (host, path)
        assert (got[u].given and (got[u].given.rule, got[u].given.verdict)) == (rule and (rule.host + rule.path, rule.verdict))
    with pytest.raises(ValueError):
        url_rules.given(url_rules.F.lit(""), url_rules.F.lit(""), [url_rules.RULES[0]] * 1001)


def test_tokens(spark):
    def of(url):
        return set(pages(spark, [(1, url)]).select(url_rules.tokens(url_rules.F.col("url")).alias("t")).first()[0])

    assert of(None) == of("no address") == set()
    assert of("http://Free-Bets.example.com/en/12.HTML?a=1&b=2&a=3#x") == {
        "scheme=http", "host=free-bets", "word=free", "word=bets", "host=example", "word=example", "host=com", "word=com",
        "path=en", "path=#.html", "ending=html", "field=a", "field=b", "fragment",
    }
    assert len(of("http://h/" + "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)))) == 603


def plain_rules(sets, classes, count, confidence, deviation, widest):
    """All sets by brute force, pruned like the operator."""
    base = sum(classes) / len(classes)
    stats = {}
    for k, (s, b) in enumerate(zip(sets, classes, strict=True)):
        for t in s:
            rows, blocked = stats.setdefault(t, (set(), []))
            rows.add(k)
            blocked.append(b)
    alike = {}
    for t in sorted(stats):
        if len(stats[t][0]) >= count:
            alike.setdefault(frozenset(stats[t][0]), t)
    lean = {t: -abs(sum(stats[t][1]) - len(rows) * base) / math.sqrt(len(rows)) for rows, t in alike.items()}
    narrow = [sorted((t for t in s if t in lean), key=lambda t: (lean[t], t))[:widest] for s in sets]
    seen = {}
    for s, b in zip(narrow, classes, strict=True):
        for k in range(1, len(s) + 1):
            for c in itertools.combinations(sorted(s), k):
                seen.setdefault(c, [0, 0])[b] += 1
    found = {}
    for c, (allow, block) in seen.items():
        if max(allow, block) < count:
            continue
        n = sum(set(c) <= set(s) for s in sets)
        hits = sum(b for s, b in zip(sets, classes, strict=True) if set(c) <= set(s))
        for verdict, h, rate in (("block", hits, base), ("allow", n - hits, 1 - base)):
            if h >= count and h / n >= confidence and (h / n - rate) / math.sqrt(rate * (1 - rate) / n) >= deviation:
                found[c, verdict] = (n, h, h / n)
    return {
        (c, v): x for (c, v), x in found.items()
        if not any(set(o) < set(c) and w == v and y[2] >= x[2] for (o, w), y in found.items())
    }


def some_urls(seed, size):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        bad = rng.random() < 0.3
        host = rng.choice(["casino", "win-big", "news"] if bad and rng.random() < 0.9 else ["news", "blog", "shop"])
        end = rng.choice(["", "?ref=1", "?page=2&ref=x", "#top", ".html"])
        rows.append((i, f"http{rng.choice(['', 's'])}://{host}.site{rng.randrange(3)}.com/{rng.choice(['en', 'de'])}/{i}{end}", int(bad)))
    return rows


@pytest.mark.parametrize("widest", [3, 12])
def test_mined_rules_like_all_sets(spark, widest):
    rows = some_urls(1, 250)
    frame = spark.createDataFrame([(i, u, b) for i, u, b in rows], "row long, url string, block int")
    seen = frame.select("row", url_rules.tokens(url_rules.F.col("url")).alias("tokens"), "block")
    sets, classes = zip(*[(tuple(r.tokens), r.block) for r in seen.orderBy("row").collect()], strict=True)
    found = url_rules.mine(seen, 0.02, 8, 0.5, 3.0, widest).collect()
    got = {(tuple(r["items"]), r.verdict): (r.n, r.hits, r.confidence) for r in found}
    want = plain_rules(sets, classes, 8, 0.5, 3.0, widest)
    assert set(got) == set(want) and len(want) > 2
    for k in want:
        assert got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-12
    for r in found:
        assert r.rule == " ".join(r["items"]) and r.key in r["items"]


def test_judged_pages_like_a_loop(spark):
    train = some_urls(2, 400)
    rows = [(i, u) for i, u, _ in train] + [(9000 + i, u) for i, (_, u, _) in enumerate(some_urls(3, 120))]
    rows += [(1, rows[1][1])] * 2 + [(None, "http://casino.site1.com/en/5"), (9500, None), (9501, "x"), (9502, "http://a.net/")]
    said = [(i, 1, b) for i, _, b in train] + [(1, None, None), (77777, 0, 1), (None, 0, 1), (3, None, 0)]
    got = url_rules.judge(pages(spark, rows), labels(spark, said)).collect()
    assert len(got) == len(rows)
    seen = url_rules.labelled(pages(spark, rows), labels(spark, said)).collect()
    mined = plain_rules([r.tokens for r in seen], [r.block for r in seen], 8, 0.5, 3.0, 12)
    assert mined
    plain = {}
    tokens = {
        r.url: set(r.t) for r in pages(spark, rows).select("url", url_rules.tokens(url_rules.F.col("url")).alias("t")).collect()
    }
    for i, u in rows:
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        fits = [(-x[2], -x[0], " ".join(c), v) for (c, v), x in mined.items() if set(c) <= tokens[u]]
        best = min(fits, default=None)
        verdict = rule.verdict if rule else best[3] if best else "allow"
        plain.setdefault((i, host, path), []).append((rule and rule.host + rule.path, verdict, best and best[2]))
    for r in got:
        assert (r.rule, r.verdict, r.mined) in plain[r.page_id, r.host, r.path]
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_nothing_to_mine(spark):
    rows = [(1, "http://a.net/x"), (2, "http://a.com/x"), (3, None)]
    for said in ([], [(1, 0, 1)], [(1, 0, 1), (2, 1, 0)], [(1, None, None), (4, 0, 1)]):
        got = {r.page_id: (r.rule, r.verdict, r.mined) for r in url_rules.judge(pages(spark, rows), labels(spark, said)).collect()}
        assert got == {1: ("net/", "block", None), 2: (None, "allow", None), 3: (None, "allow", None)}
    assert url_rules.judge(pages(spark, []), labels(spark, [])).collect() == []


def test_one_long_url_many_times(spark):
    """A URL of 200 tokens that a third of the labelled rows have does not make 2^200 sets."""
    long = "http://long.com/" + "/".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    rows = [(i, long + ("/x" if i % 2 else "")) for i in range(60)] + [(100 + i, u) for i, u, _ in some_urls(4, 120)]
    said = [(i, 1, int(i < 45 or i % 5 == 0)) for i, _ in rows]
    got = url_rules.judge(pages(spark, rows), labels(spark, said)).collect()
    assert {r.verdict for r in got if r.page_id < 60} == {"block"}


def test_rules_of_items_beyond_the_twelve_most_telling(spark):
    """Two tokens that tell something only together, in URLs of twelve others that each tell something."""
    rows = []
    for i in range(200):
        x, y, j = i % 2, i // 2 % 2, i // 4
        kept = [f"t{k:02d}" for k in range(12) if x == y or j >= 2 * (k + 1)]
        rows.append((i, kept + ["x"] * x + ["y"] * y, int(x == y)))
    seen = spark.createDataFrame(rows, "row long, tokens array<string>, block int")
    found = {r.rule: (r.verdict, r.n, r.hits) for r in url_rules.mine(seen).collect()}
    assert found["x y"] == ("block", 50, 50)


# --- conversation trie -------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, owner int, piece int, words string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], TURNS).repartition(4)


def plain_trie(rows):
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children, sums, out = {}, {}, []
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(sums[q][0] for q in below) or 1
        saved = sum(sums[q][1] for q in below) + (len(members[p]) - 1) * words
        sums[p] = leaves, saved
        text = ",".join(map(str, sorted(ends.get(p, []))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(below), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def same_trie(spark, rows):
    got = sorted(map(tuple, prefix_trie.trie(talks(spark, rows)).collect()), key=lambda r: r[:2])
    assert got == plain_trie(rows)
    return got


def test_trie_of_odd_conversations(spark):
    rows = [
        (40, 0, "user", "a b c"), (40, 1, "assistant", "d e"), (40, 2, None, None), (41, 0, "user", "a b c"), (41, None, "user", "first"),
        (42, 5, "user", "a b c"), (43, 0, None, ""), (44, 0, "user", "a  b\tc"), (60, 0, "user", "x " * 5000), (61, 0, "user", "x " * 5000),
        (61, 1, "user", "y"), (-5, 0, "user", "a b c"), (-20, 0, "user", "z"), (-21, 1, "user", "z"), (None, 0, "user", "lost"),
        (100, 0, "user", "same"), (100, 0, "user", "same"), (101, 0, "user", "same"), (101, 0, "user", "same"), (7, 0, "", "q"), (8, 0, "", "q"),
    ]
    same_trie(spark, rows)
    assert prefix_trie.trie(talks(spark, [])).collect() == []
    assert prefix_trie.trie(talks(spark, [(None, 1, "user", "x")])).collect() == []
    assert len(same_trie(spark, [(1, 0, "user", "x")])) in (1, 2)


def test_trie_of_random_conversations(spark):
    rng = random.Random(11)
    rows = []
    for c in rng.sample(range(-50, 400), 150):
        rows += [(c, t, "user", rng.choice("ab") * (1 + t % 2)) for t in range(rng.choice([1, 2, 3, 5, 8]))]
    assert len(same_trie(spark, rows)) > 100


def test_deep_tries_small_pages_and_pieces(spark, monkeypatch):
    """Chains that hang on chains, searches over several strides, and ends in several pieces."""
    monkeypatch.setattr(prefix_trie, "FAN", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(45) for t in range(c + 1)]  # each one turn longer
    rows += [(20 * c, t, "user", f"turn {t}" if t < c else f"own {c}") for c in range(50, 90) for t in range(1 + 7 * c % 60)]
    rows += [(2000 + 20 * c, t, "user", f"copy {t}") for c in range(60) for t in range(3)]  # a group of copies
    got = same_trie(spark, rows)
    assert max(r[1] for r in got) > 40
