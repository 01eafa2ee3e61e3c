"""Whitening, dual-tree search and phrase mining against brute force, on rows that cover the odd cases."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from contrasieve.llm import _vectors, collocations, cover_trees, whitening

NAN, INF = float("nan"), float("inf")
EXTRA = "label int, key string, cell int, part string, v double, score long, n long"
SCHEMA = f"vec_id bigint, embedding array<float>, {EXTRA}"


def vectors(spark, rows, parts=5):
    return spark.createDataFrame([(i, None if e is None else [None if c is None else float(c) for c in e], 1, "k", 2, "p", 0.5, 3, 4) for i, e in rows], SCHEMA).repartition(parts)


def some(n, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in row] for row in r.normal(size=(n, dims)) * spread]


ODD = [(None, [0.5] * 6), (901, None), (902, [NAN] * 6), (903, [1.0, INF, 0, 0, 0, 0]), (904, [1.0, None, 0, 0, 0, 0]), (905, [0.25, 1.0]), (906, [])]


# --- whitening ----------------------------------------------------------------------------------------------------


def integers(rows, factor, shift, dims):
    out = []
    for i, e in rows:
        if e is None or any(c is None or not math.isfinite(c) for c in e):
            continue
        out.append((i, [math.floor(factor * c) + shift for c in e] + [shift] * (dims - len(e))))
    return out


def check_whitening(spark, rows, dims, k=16):
    kept = integers(rows, 64, 1_000_000, dims)
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    k = min(k, dims)
    assert len(got) == len(kept) * k
    assert {r["n"] for r in got} == {n}
    want = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept for _ in range(k))
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == want
    # centre exactly, then use doubles
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    by = defaultdict(dict)
    for r in got:
        by[r["component"]].setdefault(r["vec_id"], []).append(r)
    for c in range(1, k + 1):
        mine = [r for rs in by[c].values() for r in rs]
        if e[c - 1] < 1e-9 * max(e[0], 1e-300):
            assert all(r["whitened"] is None for r in mine)
            continue
        assert abs(mine[0]["explained"] - e[c - 1] / e.sum()) < 1e-9
        assert mine[0]["identity_error"] < 1e-9
        alone = all(abs(e[c - 1] - x) > 1e-6 * e[0] for j, x in enumerate(e) if j != c - 1)
        if alone:
            at = {i: (np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ v[:, c - 1]) / math.sqrt(e[c - 1]) for i, x in kept}
            gap = [max(abs(r["whitened"] - s * at[r["vec_id"]]) for r in mine) for s in (1, -1)]
            assert min(gap) < 1e-6
    return got


def test_whitening_with_odd_rows_and_copies(spark):
    rows = [(i, e) for i, e in enumerate(some(60, 6, 1))]
    check_whitening(spark, rows + rows[:20] + [(100 + i, rows[3][1]) for i in range(50)] + ODD, 6)


def test_whitening_of_many_dimensions(spark):
    check_whitening(spark, [(i, e) for i, e in enumerate(some(90, 24, 2, 0.3))], 24)


def test_whitening_of_low_rank_and_equal_eigenvalues(spark):
    axes = [[s if i == j else 0.0 for j in range(5)] for i in range(3) for s in (1.0, -1.0)] + [[0, 0, 0, 0.5, 0], [0, 0, 0, -0.5, 0]]
    got = check_whitening(spark, list(enumerate(axes)), 5)
    assert {r["identity_error"] < 1e-12 for r in got} == {True}
    assert len({r["whitened"] for r in got if r["component"] == 5}) == 1


def test_whitening_of_equal_vectors_and_no_rows(spark):
    got = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [NAN])])).count() == 0


def test_whitening_of_huge_entries(spark):
    rows = [(i, [x * 1e12 for x in e]) for i, e in enumerate(some(40, 4, 3))]
    kept = integers([(i, [float(np.float32(c)) for c in e]) for i, e in rows], 64, 0, 4)
    found = whitening.fit(vectors(spark, rows))
    assert found.sums == [sum(c) for c in zip(*(x for _, x in kept))]
    assert found.error < 1e-9
    assert whitening.transform(vectors(spark, rows), found).where("deviation is null").count() == 160


def test_gram_of_large_integers_is_exact():
    rows = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, (50, 3))
    whole = rows.astype(object)
    assert (whitening.gram(rows) == whole.T.dot(whole)).all()


def test_characteristic_polynomial_of_a_singular_matrix():
    a = np.random.default_rng(1).integers(-99, 99, (7, 5)).astype(object)
    m = a.dot(a.T)
    chosen = whitening.primes(whitening.coefficient_bits(7, int(np.trace(m))))
    poly = whitening.combine([(p, whitening.polynomial_mod((m % p).astype(np.int64), p).tolist()) for p in chosen])
    # traces of powers by Newton's identities
    power, sums, want = np.eye(7, dtype=int).astype(object), [], [1]
    for k in range(1, 8):
        power = power.dot(m)
        sums.append(int(np.trace(power)))
        want.append(-sum(want[k - i] * sums[i - 1] for i in range(1, k + 1)) // k)
    assert poly == want[::-1] and poly[:2] == [0, 0]
    roots = whitening.leading_roots(poly, 16)
    assert np.allclose([float(r) for r, _, _ in roots], np.linalg.eigvalsh(m.astype(float))[::-1][:5])


def test_close_and_repeated_roots_are_told_apart():
    values = [10**9, 10**9, 10**9 + 1, 7, 7, 7, 1, 0]
    poly = [1]
    for v in values:
        poly = [a - v * b for a, b in zip([0, *poly], [*poly, 0])]
    found = whitening.leading_roots(poly, 16)
    assert [(round(r), m) for r, m, _ in found] == [(10**9 + 1, 1), (10**9, 2), (7, 3), (1, 1)]


# --- search -------------------------------------------------------------------------------------------------------


def best(rows, k=5, every=50):
    kept = integers(rows, 256, 0, max((len(e) for _, e in rows if e), default=0))
    out = []
    for a, (i, x) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), j is not None, j or 0, j) for b, (j, y) in enumerate(kept) if b != a]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def found(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("block, query_block, leaf", [(8192, 1024, 48), (64, 8, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, query_block, leaf):
    for name, value in (("BLOCK", block), ("QUERY_BLOCK", query_block), ("LEAF", leaf)):
        monkeypatch.setattr(cover_trees, name, value)
    r = random.Random(4)
    heads = some(12, 6, 5, 2.0)
    rows = [(i, [h + r.gauss(0, 0.05) for h in heads[i % 12]]) for i in range(1200)]
    rows = [(i, [float(np.float32(c)) for c in e]) for i, e in rows]
    rows += [(2000 + i, rows[7][1]) for i in range(300)] + [(5000, rows[3][1]), (5050, rows[3][1])]
    assert found(cover_trees.top_k(vectors(spark, rows))) == best(rows)


def test_top_k_sends_no_copies_of_queries_through_the_driver(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(cover_trees, name, value)
    rows = [(i, e) for i, e in enumerate(some(600, 6, 6))]
    out = cover_trees.top_k(vectors(spark, rows))
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    deep = [len(line) - len(line.lstrip(" :|+-")) for line in plan]
    assert any("sent(" in line for line in plan)
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(plan)) if deep[j] <= deep[i]), len(plan))
            assert not any("sent(" in x for x in plan[i:end])
    assert found(out) == best(rows)


def test_top_k_of_odd_rows_and_repeated_ids(spark):
    rows = [(i, e) for i, e in enumerate(some(120, 6, 6))] + ODD
    assert found(cover_trees.top_k(vectors(spark, rows))) == best(rows)
    rows += [(50, rows[9][1]), (50, rows[9][1]), (50, rows[50][1]), (None, rows[50][1]), (None, rows[1][1]), (9, rows[50][1])]
    assert found(cover_trees.top_k(vectors(spark, rows))) == best(rows)


def test_top_k_with_few_or_no_rows(spark):
    assert found(cover_trees.top_k(vectors(spark, [(0, [1.0, 2.0])]))) == Counter()
    rows = [(0, [1.0, -2.0]), (1, [0.0, 0.0]), (100, [-1.0, 2.0])]
    assert found(cover_trees.top_k(vectors(spark, rows))) == best(rows)
    for rows in ([], [(1, [1.0])], [(0, None)], [(0, []), (50, [])]):
        assert found(cover_trees.top_k(vectors(spark, rows))) == Counter()


def test_top_k_of_huge_entries(spark):
    rows = [(i, [x * 1e6 for x in e]) for i, e in enumerate(some(60, 3, 8))]
    exact = [(i, [float(np.float32(c)) for c in e]) for i, e in rows]
    assert found(cover_trees.top_k(vectors(spark, rows))) == best(exact)


def test_cover_tree_covers_and_separates():
    x = (np.random.default_rng(2).normal(size=(40, 3))[np.random.default_rng(3).integers(0, 40, 900)] * 99 + np.random.default_rng(4).normal(size=(900, 3))).round()
    tree = cover_trees.build(x)
    assert sorted(tree["order"].tolist()) == list(range(900))
    for node in range(len(tree["begin"])):
        inside = x[tree["order"][tree["begin"][node] : tree["end"][node]]]
        assert (np.linalg.norm(inside - x[tree["centre"][node]], axis=1) <= tree["radius"][node]).all()
        kids = range(tree["child"][node], tree["child"][node] + tree["children"][node])
        heads = x[[tree["centre"][c] for c in kids]]
        if len(heads) > 1:
            gaps = np.linalg.norm(heads[:, None] - heads[None], axis=2) + np.eye(len(heads)) * 1e9
            assert gaps.min() > np.linalg.norm(inside - x[tree["centre"][node]], axis=1).max() / 2 - 1e-6
            assert sorted(p for c in kids for p in range(tree["begin"][c], tree["end"][c])) == list(range(tree["begin"][node], tree["end"][node]))


def test_search_prunes():
    r = np.random.default_rng(5)
    x = (r.normal(size=(30, 4))[r.integers(0, 30, 4000)] * 5000 + r.normal(size=(4000, 4)) * 40).astype(np.int64)
    scored = []
    whole = cover_trees._dots
    cover_trees._dots = lambda a, b: scored.append(len(a) * len(b)) or whole(a, b)
    try:
        q = {"points": x[:60], "tree": cover_trees.build(x[:60])}
        ids = np.arange(4000)
        block = {"points": x, "tree": cover_trees.build(x), "ids": ids, "first": ids, "n_ids": np.ones(4000, int)}
        lists = cover_trees.Lists(60, 6)
        beat = np.sort(x[:60] @ x.T, axis=1)[:, -6][q["tree"]["order"]]
        cover_trees.search(q, block, lists, beat)
    finally:
        cover_trees._dots = whole
    assert (lists.score[np.argsort(q["tree"]["order"])] == np.sort(x[:60] @ x.T, axis=1)[:, ::-1][:, :6]).all()
    assert sum(scored) < 60 * 4000 / 2


# --- phrases ------------------------------------------------------------------------------------------------------


def phrases(docs, least, first):
    import re

    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    frequent = {p: a for p, a in f.items() if a >= least}
    inside = {(lang, w[i:j], a) for (lang, w), a in frequent.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w)}
    rows = defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) < 2 or (lang, w, a) in inside:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        rows[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:first]))


def mined(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus(spark, docs):
    rows = [(t, lang, 1, "k", 2, 3, "w") for t, lang in docs]
    return spark.createDataFrame(rows, "text string, lang string, doc_id int, key string, f int, places int, words string").repartition(4)


def texts():
    r = random.Random(3)
    vocabulary = ["the", "The", "of", "Ä", "ä", "x　y", "été", "a", "b", "New", "York", "in", "'", "日本", "z"]
    weight = [9, 5, 8, 2, 2, 2, 3, 6, 6, 3, 3, 5, 1, 2, 1]
    docs = []
    for i in range(60):
        words = r.choices(vocabulary, weight, k=r.randint(0, 200))
        text = "".join(w + r.choice([" ", " ", "\t", "  ", ", ", ".\n", "\x0b", "!"] if r.random() < 0.3 else [" "]) for w in words)
        docs.append((text + " new york city hall at night" * r.randint(0, 3), r.choice(["en", "fr", None, "und"])))
    return docs + [(None, "en"), ("", None), (" .,;\n", "fr"), ("a " * 5000, "en"), ("only once here", "xx")] + [("the a of the a of the", "en")] * 40


@pytest.mark.parametrize("shard", [1 << 19, 7])
def test_phrases_equal_brute_force(spark, shard):
    docs = texts()
    assert mined(collocations.mine(corpus(spark, docs), least=12, first=25, shard=shard)) == phrases(docs, 12, 25)


def test_phrases_of_empty_tables(spark):
    assert mined(collocations.mine(corpus(spark, []))) == []
    assert mined(collocations.mine(corpus(spark, [(None, None), ("a b", "en")]))) == []


def test_trie_finds_what_it_holds():
    r = np.random.default_rng(6)
    for length in (1, 2, 4):
        symbols = np.unique(r.integers(1, 31, (2000, length)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), axis=0)
        langs = np.array(["a" if i % 3 else "b" for i in range(len(symbols))], object)
        trie = collocations.Trie(langs, symbols)
        own = np.unique(symbols)
        places = r.integers(0, len(own) + 1, 5000).astype(np.uint16)
        for lang in ("a", "b", "c"):
            held = {tuple(s): i for i, (s, x) in enumerate(zip(symbols.tolist(), langs)) if x == lang}
            at, number = trie.run(lang, own, places)
            full = [0, *own.tolist()]
            want = {i: held[w] for i in range(5000 - length + 1) if (w := tuple(full[p] for p in places[i : i + length])) in held}
            assert dict(zip(at.tolist(), number.tolist())) == want


def test_keys_keep_vectors():
    rows = np.array([[0, 1, -1], [127, -128, 0], [128, 0, 0], [-40000, 5, 6], [1 << 40, 0, -(1 << 62)]])
    assert (_vectors.unpack(_vectors.pack(rows), 3) == rows).all()
