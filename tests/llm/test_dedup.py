import random

import numpy as np

from tidemark.llm import dedup

SCHEMA = "doc_id long, text string"
SEEDS = (1059, 1221, 3220, 4608, 10483, 11592, 12497, 15500)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, words, times):
    words = list(words)
    for at in rng.sample(range(len(words)), times):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def kept(spark, rows):
    return {r.doc_id for r in dedup.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}


def test_edited_copies(spark):
    rng = random.Random(5)
    rows, copies = [], {}
    for words, times in ((60, 1), (100, 1), (200, 1), (200, 3), (400, 3), (400, 7), (1000, 3), (1000, 20)):
        for _ in range(30):
            text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
            other = edited(rng, text, times)
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, other)]
            copies[rows[-1][0]] = similar(" ".join(text), other)
    left = kept(spark, rows)
    assert {i for i, _ in rows} - copies.keys() <= left
    assert all(i in left for i, same in copies.items() if not same)
    want = [i for i, same in copies.items() if same]
    assert len(want) >= 200 and sum(i not in left for i in want) >= 0.99 * len(want)


def test_what_is_not_similar_stays(spark):
    rng = random.Random(7)
    line = " ".join(f"common{i}" for i in range(40))
    rows = [(i, f"{line} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(60)]
    rows += [(100, "one two three four"), (101, "one two three four five"), (102, "ONE two three\tfour"), (103, None), (104, " "), (105, "")]
    assert not any(similar(a, b) for i, a in rows[:60] for j, b in rows[:60] if i < j)
    assert kept(spark, rows) == {*range(60), 100, 101, 103}


def test_parts_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART_SETS", 16)
    rng = random.Random(11)
    text = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, text, 1)) for i in range(100)] + [(100 + i, " ".join(f"x{rng.random()}" for _ in range(30))) for i in range(5)]
    assert kept(spark, rows) == {0, *range(100, 105)}


def test_clashing_names_and_nulls(spark):
    given = [(1, "a b c d e f", 9, "x", 7, None), (2, "A b c d e  f", 8, "y", 6, [1]), (None, None, 0, "z", 5, []), (3, "", 1, None, 4, [2])]
    docs = spark.createDataFrame(given, "doc_id long, text string, own_row int, own_fp string, n long, bands array<long>")
    assert sorted(map(tuple, dedup.keep_one(docs).collect()), key=str) == sorted([given[0], given[3]], key=str)
    assert dedup.keep_one(docs.limit(0)).count() == 0


def test_edited_copies_without_a_common_minimum(spark):
    # Pairs that share none of 14 keys of four minima (the fingerprints' forerunners).
    rows = []
    for seed in SEEDS:
        rng = random.Random(seed)
        text = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, edited(rng, text, 1))]
        assert similar(rows[-2][1], rows[-1][1])
    assert kept(spark, rows) == set(range(0, len(rows), 2))


def test_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SHARD", 16)
    monkeypatch.setattr(dedup, "CELL", 8)
    rng = random.Random(13)
    texts = []
    for length in [*(rng.randrange(1, 120) for _ in range(90)), *[70] * 90]:
        text = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        texts += [" ".join(text), edited(rng, text, 1), " ".join([*text, *(f"x{rng.random()}" for _ in range(rng.randrange(1 + length // 4)))])]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similar(texts[i], texts[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 100 < len(set(root)) < len(texts) - 100
    assert kept(spark, list(enumerate(texts))) == set(root)


def brute_pairs(size, words):
    far = np.bitwise_count(words[:, None] ^ words[None]).astype(int)
    fits = (far[..., 0] <= dedup.FIRST) & (far[..., :2].sum(axis=2) <= dedup.TWO) & (far.sum(axis=2) <= dedup.RADIUS) & (size[None] <= size[:, None]) & (5 * size[None] >= 4 * size[:, None])
    return [(i, j) for i, j in np.argwhere(fits) if i != j]


def drawn(rng, rows, sizes):
    words = rng.integers(0, 2**64, (rows, dedup.WORDS), dtype=np.uint64)
    bits = np.unpackbits(words[rng.integers(0, rows, rows)].view(np.uint8), axis=1) ^ (rng.random((rows, 64 * dedup.WORDS)) < 0.25)
    return rng.integers(*sizes, rows), np.concatenate([words, np.packbits(bits, axis=1).view(np.uint64)])


def test_asked_leaves_hold_every_candidate():
    rng = np.random.default_rng(3)
    for sizes in ((1, 2000), (100, 101), (100, 140)):
        size, words = drawn(rng, 600, sizes)
        size = np.concatenate([size, size])
        tree = dedup.Tree.built(size, words[:, 0], 40, random.Random(1))
        (who, home), (asker, leaf) = tree.leaves(size, words[:, 0], False), tree.leaves(size, words[:, 0], True)
        assert sorted(who) == list(range(len(size))) and len(set(home)) > 8
        assert sizes != (1, 2000) or len(leaf) < 0.3 * len(size) * len(set(home))
        home, asked = dict(zip(who, home, strict=True)), set(zip(asker, leaf, strict=True))
        pairs = brute_pairs(size, words)
        assert len(pairs) > 20 and all((i, home[j]) in asked for i, j in pairs)


def test_candidates_of_a_shard(monkeypatch):
    rng = np.random.default_rng(4)
    size, words = drawn(rng, 300, (100, 140))
    noise = rng.random((600, 256)) < rng.choice([0.05, 0.35], (600, 1), p=[0.8, 0.2])
    alike = np.packbits(np.unpackbits(words[:1].view(np.uint8), axis=1) ^ noise, axis=1).view(np.uint64)
    check(monkeypatch, rng, np.concatenate([size, size]), words, 20)
    check(monkeypatch, rng, np.concatenate([size, size]), alike, 1)  # a large group, with some that are near few or none


def check(monkeypatch, rng, size, words, least):
    fp = rng.permutation(600) - 300
    root = np.arange(600)
    for i, j in brute_pairs(size, words):
        root[root == max(root[i], root[j])] = min(root[i], root[j])
    want = [set(fp[root == r].tolist()) for r in set(root) if (root == r).sum() > 1]
    assert len(want) >= least and sum(map(len, want)) < 600
    for pairs in (1 << 17, 500):
        monkeypatch.setattr(dedup, "PAIRS", pairs)
        found, sizes, key = dedup.near((fp, size, words), (fp, size, words))
        groups = {}
        for f, k in zip(found.tolist(), key.tolist(), strict=True):
            groups.setdefault(k, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want)) and all(k == min(g) for k, g in groups.items())
        assert dict(zip(found, sizes, strict=True)) == {f: n for f, n in zip(fp, size, strict=True) if f in set(found)}
