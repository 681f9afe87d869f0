"""Ranked search against brute force, with copies, ties, odd rows and small blocks."""

import math
import re
from collections import Counter

import pytest

from casewright.llm import search
from casewright.llm.search import text_terms

ITEMS = "item_id bigint, text string"


def terms(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    size = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 25 + 75 * sum(bag.values()) * len(bags) // size
            score = 0
            for t, q in Counter(terms(text)).items():
                if t in bag:
                    w = math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1)))
                    score += q * w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(df.dtypes)["rank"] == "int" and dict(df.dtypes)["score"] == "bigint"
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("text", ["", "a-b_C", "é ÀB x y 1٢", "Ab\x00cd\x7fef", "İI", "---", None])
def test_terms(text):
    assert [t.decode() for t in text_terms(text)] == terms(text)


@pytest.fixture
def corpus(prose, rng):
    """Documents among which many are copies, some up to case or with other words apart."""
    base = [prose(int(n)) for n in rng.integers(1, 60, 40)]
    rows = [(i, base[i % 40] if i % 3 else prose(12)) for i in range(160)]
    rows += [(1000 - i, base[3].upper()) for i in range(40)]
    rows += [(2000 + i, base[5] + " zz" + str(i)) for i in range(20)]  # other terms, equal bags
    return rows


def test_ranks(spark, docs, corpus, prose):
    items = [(i, prose(9)) for i in range(12)] + [(50, corpus[3][1] + " " + corpus[3][1])]
    df = search.search(docs(corpus), spark.createDataFrame(items, ITEMS))
    assert got(df) == brute(corpus, items)


def test_blocks_and_chunks_do_not_change_ranks(spark, docs, corpus, prose, monkeypatch):
    items = [(i, prose(9)) for i in range(9)]
    monkeypatch.setattr(search, "CLASSES", 3)
    monkeypatch.setattr(search, "ITEMS", 2)
    df = search.search(docs(corpus), spark.createDataFrame(items, ITEMS), k=4, block_bytes=150)
    assert got(df) == brute(corpus, items, 4)


def test_odd_rows(spark, docs):
    rows = [(3, "a b"), (3, "a b"), (None, "a b"), (1, "b a"), (5, None), (6, "..."), (7, "c " * 5000), (2, "A,B")]
    items = [(1, "a"), (2, None), (3, ""), (4, "nowhere"), (None, "b"), (9, "c c a"), (9, "c c a")]
    df = search.search(docs(rows, clash="terms"), spark.createDataFrame(items, ITEMS))
    assert got(df) == brute(rows, items)


def test_empty_tables(spark, docs):
    some, none = spark.createDataFrame([(1, "a")], ITEMS), spark.createDataFrame([], ITEMS)
    assert search.search(docs([]), some).collect() == []
    assert search.search(docs([(1, None)]), some).collect() == []
    assert search.search(docs([(1, "a")]), none).collect() == []
    assert search.search(docs([]), none).collect() == []
