"""Periodic runs against brute force, on texts with structure and on odd rows."""

import hashlib
import time
import zlib

import numpy as np
import pytest

from casewright.llm import periodic


def brute_runs(words):
    """All runs by trying every period at every place."""
    n, seen = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                seen.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in seen.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(rng):
    yield from ["", " \t\n ", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "x a b a b a b a b y"]
    for size in (1, 2, 3, 5, 30):
        for n in (7, 40, 300):
            yield " ".join(f"w{k}" for k in rng.integers(0, size, n))
    for _ in range(60):  # runs within runs, at seams, next to rare words
        parts = []
        for _ in range(rng.integers(1, 6)):
            unit = [f"w{k}" for k in rng.integers(0, 4, rng.integers(1, 9))]
            parts += unit * int(rng.integers(1, 8)) + unit[: rng.integers(0, len(unit) + 1)]
            parts += [f"r{k}" for k in rng.integers(0, 50, rng.integers(0, 3))]
        yield "  ".join(parts) + "\n"
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield " ".join(fibonacci[-1])


def test_runs_and_collapsed_texts(spark, docs, rng):
    rows = list(enumerate(texts(rng)))
    found = {r["doc_id"]: r for r in periodic.find_runs(docs(rows)).collect()}
    for i, text in rows:
        words = text.split()
        runs = [(r["start"], r["length"], r["period"]) for r in found[i]["runs"]]
        assert runs == brute_runs(words), text
        assert found[i]["collapsed"] == brute_collapsed(words, runs)


def test_word_is_what_lies_between_ascii_white_space(spark, docs):
    rows = [(1, "é x " * 6), (2, "a b\x0bc\x1cd " * 5), (3, "A a " * 3)]
    found = {r["doc_id"]: r["runs"] for r in periodic.find_runs(docs(rows)).collect()}
    assert [tuple(r) for r in found[1]] == [(0, 6, 1)]
    assert [tuple(r) for r in found[2]] == [(0, 10, 2)]
    assert found[3] == []


def test_odd_rows(spark, docs):
    rows = [(None, "b " * 7), (4, None), (4, ""), (5, "b " * 7), (5, "b " * 7)]
    found = periodic.find_runs(docs(rows, clash="runs")).collect()
    assert found[0]["runs"] and found[0]["collapsed"] == "b" and found[0]["doc_id"] is None
    assert [(r["runs"], r["collapsed"]) for r in found[1:3]] == [([], "")] * 2
    assert found[3] == found[4]
    assert periodic.find_runs(docs([])).collect() == []


def test_chains_of_splits_are_followed_to_their_end(monkeypatch):
    # Each round frees one more word at the rim of the large segment.
    n = 400
    chain = []
    for i in range(n):
        chain += [i, i + 1, i, i + 1, i] if i else [0, 1, 0, 1]
    codes = np.array(chain)
    before = np.array([0, len(codes)])
    rounds = periodic._split_rounds(codes, before)
    alone = periodic._split_alone(codes, 0, len(codes))
    assert sorted(rounds) == sorted(alone)
    for a, b in alone:
        assert min(np.unique(codes[a:b], return_counts=True)[1]) >= periodic.PERIODS
    assert periodic.runs_of(codes, before) == brute_runs(chain)


@pytest.mark.parametrize("make", [
    lambda rng, n: np.zeros(n, int),
    lambda rng, n: np.arange(n) % 1000,
    lambda rng, n: rng.integers(0, 2, n),
    lambda rng, n: np.where(np.arange(n) % 1001, 0, 1),
])
def test_very_long_texts_take_seconds(rng, make):
    codes = make(rng, 200_000)
    began = time.process_time()
    runs = periodic.runs_of(codes, np.array([0, len(codes)]))
    assert time.process_time() - began < 60
    for s, n, q in runs[:: max(1, len(runs) // 50)]:
        assert (codes[s : s + n - q] == codes[s + q : s + n]).all()


def test_query_on_ids_that_make_texts_periodic(spark, docs, tmp_path, prose):
    rows = [(i, prose(1 + 7 * i % 90)) for i in range(300)] + [(None, "a"), (40, None), (990, "")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic.op12(spark, str(tmp_path)).collect() if r["doc_id"] != 40}
    made = 0
    for i, text in rows:
        if i in (40, None):
            continue
        h, words = zlib.crc32(str(i).encode()), text.split()
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            made += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        row = got[i]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert made > 10
