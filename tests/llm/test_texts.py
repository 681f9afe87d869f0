"""Line dedup, near-dedup, substring dedup, mixing and packing against brute force."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright.llm import common, line_dedup, minhash, mixing, packing, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def least_ids(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return label


# --- helpers -------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["a b  c", None, "", " \t", "x y é", "b", "b", "no\nnewline ", "w" * 100_000]
    column = pa.array(texts)
    for piece in (8, 1000, 10**7):
        got = []
        for _, _, data, offsets in common.text_bytes(column, piece):
            begins, ends, before = common.words(data, offsets)
            hashes, same = common.word_hashes(data, offsets)
            assert (before == same).all()
            for i in range(len(offsets) - 1):
                span = range(before[i], before[i + 1])
                got.append([(bytes(data[begins[k]:ends[k]]).decode(), hashes[k]) for k in span])
        assert [[w for w, _ in g] for g in got] == [WORD.findall(t or "") for t in texts]
        by_word = defaultdict(set)
        for w, h in itertools.chain(*got):
            by_word[w].add(h)
        assert all(len(h) == 1 for h in by_word.values())
        assert len(set.union(*by_word.values())) == len(by_word)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 200 + i) for i in range(50)] + [(7, 7)]
    edges = spark.createDataFrame(chain + star, "a bigint, b bigint")
    got = {r.node: r.component for r in common.components(edges, "a", "b").collect()}
    assert got == least_ids({x for e in chain + star[:-1] for x in e}, chain + star)
    assert common.components(edges.where("a < 0"), "a", "b").collect() == []


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in "cabdz"], "s string")
    got = common.numbered(df, [F.col("s").asc()], "n").collect()
    assert {r.s: r.n for r in got} == {"a": 1, "b": 2, "c": 3, "d": 4, "z": 5}


# --- line dedup ----------------------------------------------------------------


def removed_lines(texts):
    """Kept text and counts by plain loops."""
    seen = {}
    windows = []
    for i, t in texts:
        lines = [] if t is None else t.split("\n")
        solid = [k for k, x in enumerate(lines) if WORD.search(x)]
        for at in range(len(solid) - 2):
            w = tuple(lines[k] for k in solid[at : at + 3])
            windows.append((w, i, at, solid))
            seen[w] = min(seen.get(w, (i, at)), (i, at))
    gone = defaultdict(set)
    for w, i, at, solid in windows:
        if (i, at) > seen[w]:
            gone[i].update(solid[at : at + 3])
    out = {}
    for i, t in texts:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if k not in gone[i]]
        out[i] = (None if t is None else "\n".join(kept), len(lines), len(gone[i]))
    return out


def test_line_dedup(docs, rng):
    texts = [(i, "\n".join(rng.choice(list("abcd \t"), rng.integers(1, 12)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "a\na\na\na\na\na"), (103, "x\n" * 3000), (104, "only\ntwo"), (105, "\n\n\n")]
    got = line_dedup.dedup_lines(docs(texts, clash="n_lines")).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == removed_lines(texts)


def test_line_dedup_odd_rows(docs):
    same = "p\nq\nr"
    got = line_dedup.dedup_lines(docs([(5, same), (5, same), (None, same), (7, same)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 3), (5, 0), (5, 0), (7, 3)]
    assert line_dedup.dedup_lines(docs([])).collect() == []


# --- near-dedup ----------------------------------------------------------------


def shingles(text, width):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def near_truth(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    label = least_ids(sets, links)
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, prose, rng, width, percent):
    texts = []
    for g in range(6):
        base = prose(80).split()
        for k in range(14):
            copy = list(base)
            for at in rng.choice(80, rng.integers(0, 7), replace=False):
                copy[at] = f"new{k}"
            texts.append((100 * g + k, " ".join(copy).upper() if k % 5 == 0 else "  ".join(copy)))
    texts += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "É one"), (905, "é one"), (906, "\n ")]
    got = minhash.near_duplicates(docs(texts, clash="id"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_truth(texts, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(docs):
    a, b = " ".join(map(str, range(40))), " ".join(map(str, range(100, 140)))
    rows = [(4, a), (4, b), (2, a), (3, b), (None, a), (4, a), (9, "w " * 50_000)]
    got = minhash.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True), (2, 2, True), (3, 2, False), (4, 2, False), (4, 2, False), (4, 2, False), (9, 9, True)]
    assert minhash.near_duplicates(docs([])).collect() == []


def test_signatures_are_circulant():
    values = common.mix64(np.arange(1, 40, dtype=np.uint64))
    got = minhash.signatures(values, np.array([0, 10, 39]), 16)
    second = minhash._second(np.arange(2**16, dtype=np.uint32))
    assert len(set(second.tolist())) == 2**16
    placed = (values >> np.uint64(32)).astype(np.uint32)
    for shift in range(16):
        want = minhash._second(placed[:10] + np.uint32(shift)).min()
        assert got[shift, 0] == want


# --- substring dedup -----------------------------------------------------------


def cut_truth(texts, width):
    split = {i: WORD.findall(t or "") for i, t in texts}
    first = {}
    for i in sorted(split):
        for at in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][at : at + width]), (i, at))
    out = {}
    for i, w in split.items():
        gone = set()
        for at in range(len(w) - width + 1):
            if first[tuple(w[at : at + width])] < (i, at):
                gone.update(range(at, at + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("group, fold", [(1_000_000, 8_000_000), (50, 300)])
def test_remove_repeats(docs, rng, monkeypatch, group, fold):
    monkeypatch.setattr(substring, "FOLD", fold)
    pool = [f"w{k}" for k in range(30)]
    passages = [list(rng.choice(pool, 30)) for _ in range(4)]
    texts = []
    for i in range(50):
        parts = list(rng.choice(pool, rng.integers(0, 40)))
        for k in rng.choice(4, rng.integers(0, 3)):
            parts += passages[k][rng.integers(0, 8) :] + list(rng.choice(pool, 5))
        texts.append((int(i * 7 % 50), "  ".join(parts)))
    texts += [(60, None), (61, ""), (62, "z " * 400), (63, "É é " * 30)]
    got = substring.remove_repeats(docs(texts, clash="covers"), 20, group).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == cut_truth(texts, 20)


def test_remove_repeats_odd_rows(docs):
    a = " ".join(f"k{i}" for i in range(25))
    got = substring.remove_repeats(docs([(5, a), (5, a), (None, a), (7, a), (8, "x")])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 25), (5, 0), (5, 0), (7, 25), (8, 0)]
    assert substring.remove_repeats(docs([])).collect() == []


def test_groups_split_large_cells():
    counts = np.array([10, 0, 500, 3, 90])
    first, spread, groups = substring.plan_groups(counts, 100, 1)
    assert spread.tolist() == [1, 1, 5, 1, 1] and groups >= 6
    assert (first + spread <= groups).all()


# --- mixing --------------------------------------------------------------------


def level_truth(sizes, weights, total):
    """Share by weight, cut at twice the size, deal again what was cut."""
    target = dict.fromkeys(sizes, 0.0)
    rest = total
    while rest > 1e-9:
        free = [s for s in sizes if target[s] < 2 * sizes[s] - 1e-9]
        per = rest / sum(weights[s] for s in free)
        for s in free:
            target[s] += per * weights[s]
        rest = sum(max(0, target[s] - 2 * sizes[s]) for s in free)
        for s in free:
            target[s] = min(target[s], 2 * sizes[s])
    return target


def test_mixing(docs, rng):
    names = ["b", "a", "é", None, "Z", "zz"]
    rows = [(i, "w " * int(rng.integers(0, 60)), names[int(rng.integers(0, 6)) if i % 3 else 1]) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", "nothing")]
    planned = mixing.mix_plan(docs(rows)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = level_truth(size, weights, 1.5 * sum(size.values()))
    taken = Counter()
    for r in planned:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in size:
        assert taken[s] == pytest.approx(want[s], rel=0.25, abs=1)
    mixed = mixing.mix(docs(rows, clash="size"))
    assert mixed.columns[-1] == "size" and {r.size for r in mixed.collect()} == {"mine"}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in planned if r.copies})


def test_mixing_odd_rows(docs):
    assert mixing.mix_plan(docs([])).collect() == []
    got = mixing.mix_plan(docs([(None, "a b", None), (None, "a b", None), (3, None, None)])).collect()
    assert {(r.size, r.target) for r in got} == {(2, 6.0), (0, 6.0)}


def test_rows_without_ids_meet_their_target(docs, prose):
    rows = [(None, prose(40), "b") for _ in range(600)]
    rows += [(i, prose(40), source) for i, source in enumerate("ac" * 600)]
    planned = mixing.mix_plan(docs(rows)).collect()
    for source in "abc":
        own = [r for r in planned if r.source == source]
        assert sum(r.size * r.copies for r in own) == pytest.approx(own[0].target, rel=0.1)
    assert len({r.copies for r in planned if r.source == "b"}) == 2


# --- packing -------------------------------------------------------------------


def score(at, cost, cuts, size):
    total, last = 0, 0
    for x in cuts[:-1]:
        if x - last > size:
            return float("inf")
        total, last = total + size - (x - last) + cost[at.index(x)], x
    return total if cuts[-1] - last <= size else float("inf")


def test_best_cuts_against_all_choices(rng):
    for _ in range(200):
        size = int(rng.integers(4, 12))
        at = sorted(rng.choice(np.arange(1, 40), int(rng.integers(1, 11)), replace=False).tolist())
        if max(b - a for a, b in itertools.pairwise([0, *at])) > size:
            continue
        cost = rng.choice([0, 2, 5], len(at)).tolist()
        best = min(
            score(at, cost, [*k, at[-1]], size) for r in range(len(at)) for k in itertools.combinations(at[:-1], r)
        )
        assert score(at, cost, packing.best_cuts(at, cost, size), size) == best


def test_pack_is_a_partition_of_the_ids(docs, prose, monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 8)
    texts = [(i, prose(int(n))) for i, n in enumerate([5, 9000, 300, 1, 2500, 40, 700] * 6)]
    texts += [(90, None), (91, ""), (92, "x" * 20_000), (93, "a<|endoftext|>b\x1cc d"), (94, "Don't, É. é,x 。" * 50)]
    pieces = packing.pack(docs(texts, clash="start")).collect()
    tokenizer = packing.vocabulary(packing.TOKENIZER).tokenizer
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    for i, t in texts:
        want = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], np.uint32)
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert b"".join(bytes(p.ids) for p in own) == want.tobytes()
        assert {p.doc_tokens for p in own} == {len(want)}
    padding = total = 0
    for own in by_window.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in own])
        assert [p.offset for p in own] == [0, *ends[:-1]] and ends[-1] <= 4096
        total += ends[-1]
        padding += 4096 - ends[-1] if ends[-1] & (ends[-1] - 1) else 0
    assert padding < 0.03 * total


def test_vocabulary_holds_parts_in_little_memory(monkeypatch):
    voc = packing.Vocabulary(packing.TOKENIZER)
    texts = [" ".join(f"{k:x}y{k * 7919 % 1000:x}" for k in range(a, a + 10_000)) for a in range(0, 40_000, 10_000)]
    want = [voc.whole(text).tolist() for text in texts]
    batches = []
    real = voc.tokenizer

    class Counted:
        def encode_batch_fast(self, parts, add_special_tokens):
            batches.append(len(parts))
            return real.encode_batch_fast(parts, add_special_tokens=add_special_tokens)

    voc.tokenizer = Counted()
    column = pa.array([*texts, *texts[:1]])
    got = [ids.tolist() for _, _, data, offsets in common.text_bytes(column, 1) for ids, *_ in [voc(data, offsets)]]
    assert got == [*want, want[0]]
    # Each part once, in batches of bounded size, and kept as numbers in a row.
    assert sum(batches) == 40_000 == len(voc.known) and max(batches) <= packing.AT_ONCE
    kept = [v for v in vars(voc).values() if v is not voc.tokenizer]
    assert all(isinstance(v, np.ndarray) for v in kept) and sum(v.nbytes for v in kept) < 64 * 40_000
    monkeypatch.setattr(packing, "MEMORY", 15_000)
    assert [voc(data, offsets)[0].tolist() for _, _, data, offsets in common.text_bytes(column, 1)] == [*want, want[0]]
    assert len(voc.known) <= 20_000


def test_spans_are_hashed_in_blocks_alike(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 400_000).astype(np.uint8)
    places = np.sort(rng.choice(np.arange(1, 400_000), 3_000, replace=False))
    begins, ends = np.append(0, places), np.append(places, 400_000)
    # One span is longer than a block.
    begins, ends = np.append(begins, 0), np.append(ends, 300_000)
    want = common._block_hashes(data, begins, ends)
    seen = []
    monkeypatch.setattr(common, "_block_hashes", lambda d, b, e, real=common._block_hashes: seen.append((len(b), (e - b).sum())) or real(d, b, e))
    assert (common.span_hashes(data, begins, ends) == want).all()
    assert len(seen) > 2 and all(n == 1 or size <= common._BLOCK for n, size in seen)


def test_pack_empty_and_repeated(docs):
    assert packing.pack(docs([])).collect() == []
    got = packing.pack(docs([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert total == {1: 6, None: 2}
