import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import awkward, docs, prose
from tidemark.llm import suffix_dedup
from tidemark.llm.substring_words import difference_cover, remove_repeated_windows
from tidemark.llm.suffix_dedup import reaches, remove_repeated_strings


def brute(units, window, join):
    seen = Counter(tuple(u[k : k + window]) if isinstance(u, list) else u[k : k + window] for u in units for k in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if seen[tuple(u[k : k + window]) if isinstance(u, list) else u[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(u), sum(gone), spans, join([x for x, g in zip(u, gone, strict=True) if not g])))
    return out


@pytest.mark.parametrize("period", [1, 7, 13, 21, 30])
def test_cover_has_every_difference(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize(("window", "period", "seed"), [(35, 21, 0), (8, 5, 1), (5, 5, 2)])
def test_words_equal_brute_force(spark, window, period, seed):
    rows = awkward(seed)
    want = brute([(t or "").encode().split() for _, t in rows], window, b" ".join)
    got = remove_repeated_windows(docs(spark, rows), window=window, period=period, chunks=3).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == Counter((i, n, k, s, hashlib.sha256(x).hexdigest()) for (i, _), (n, k, s, x) in zip(rows, want, strict=True))
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_empty_tables(spark):
    assert remove_repeated_windows(docs(spark, [])).collect() == []
    assert remove_repeated_strings(docs(spark, [])).collect() == []


@pytest.mark.parametrize(("window", "gram", "hot", "seed"), [(200, 50, 50_000, 0), (40, 10, 50_000, 1), (40, 10, 2, 2), (12, 3, 50_000, 3), (12, 12, 1, 4)])
def test_bytes_equal_brute_force(spark, window, gram, hot, seed):
    rows = awkward(seed)
    want = brute([(t or "").encode() for _, t in rows], window, bytes)
    got = remove_repeated_strings(docs(spark, rows), window=window, gram=gram, hot=hot, chunks=3).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter((i, n, k, s, hashlib.sha256(x).hexdigest()) for (i, _), (n, k, s, x) in zip(rows, want, strict=True))


def groups(seed, n, window):
    r = np.random.default_rng(seed)
    left, many, contexts = [], [], []
    for _ in range(n):
        a, b = int(r.integers(0, window)), int(r.integers(3, window))
        contexts.append(bytes(r.integers(97, 99, a).astype(np.uint8)) + b"gra" + bytes(r.integers(97, 99, b).astype(np.uint8)))
        left.append(a)
        many.append(0)
    return np.zeros(n, dtype=np.uint64), np.array(left), np.array(many), contexts


def pairwise(left, contexts, window):
    out = []
    for k, (a, c) in enumerate(zip(left.tolist(), contexts, strict=True)):
        best = (0, 0)
        for j, (b, d) in enumerate(zip(left.tolist(), contexts, strict=True)):
            if j != k:
                x = next((i for i, (p, q) in enumerate(zip(c[:a][::-1], d[:b][::-1], strict=False)) if p != q), min(a, b))
                y = next((i for i, (p, q) in enumerate(zip(c[a:], d[b:], strict=False)) if p != q), min(len(c) - a, len(d) - b))
                if x + y >= window:
                    best = (max(best[0], x), max(best[1], y))
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_reaches_equal_all_pairs(seed):
    gram, left, many, contexts = groups(seed, 60, 9)
    a, b = reaches(gram, left, many, contexts, 9)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == pairwise(left, contexts, 9)


def test_hash_collisions_are_noticed(monkeypatch):
    """With hashes that tell nothing apart, the bytes still decide."""
    monkeypatch.setattr(suffix_dedup, "_BYTES", np.zeros(256, dtype=np.uint64))
    gram, left, many, contexts = groups(1, 30, 9)
    a, b = reaches(gram, left, many, contexts, 9)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == pairwise(left, contexts, 9)


def test_one_text_repeats_itself(spark):
    text = prose(5, 80)
    got = remove_repeated_strings(docs(spark, [(1, text + " # " + text)]), window=100, gram=20).first()
    assert got["n_removed"] >= 2 * len(text) and got["n_bytes"] == 2 * len(text) + 3
