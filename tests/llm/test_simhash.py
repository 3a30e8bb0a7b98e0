import random
import re

import numpy as np
import xxhash

from tidemark.llm import simhash as sh


def print_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(given):
    prints = [print_of(t) for _, t in given]
    parent = list(range(len(given)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(given):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(given)), key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"Wört{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 300))) for _ in range(120)]
    given = [(i, t) for i, t in enumerate(base)]
    for i in range(400):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        given.append((1000 + i, "\n\t".join(w).upper().replace("Ö", "ö")))
    given += [(5, None), (6, ""), (6, ""), (None, " \n"), (7, "one"), (8, "ONE"), (9, "one two"), (None, base[3]), (10, "long " * 30_000)]
    df = spark.createDataFrame([(*g, 1, "x") for g in given], "doc_id long, text string, component_id int, fp string")
    assert sorted(map(tuple, sh.near_duplicates(df).collect()), key=str) == brute(given)
    assert sh.near_duplicates(df.limit(0)).count() == 0


def test_links_cover_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))) for b in base for _ in range(4)]
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    old = sh.SHARD, sh.CELL
    sh.SHARD, sh.CELL = 20, 16  # many leaves and cells
    try:
        edges = {(r.u, r.v) for r in sh.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()}
    finally:
        sh.SHARD, sh.CELL = old
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for u, v in edges:
        parent[find(u)] = find(v)
    signed = fps.view(np.int64).tolist()
    close = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    groups = {}
    for i, j in close:
        assert find(signed[i]) == find(signed[j])
    for x in signed:
        groups.setdefault(find(x), []).append(x)
    # and nothing is linked that has no chain of close pairs
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in close:
        root[top(i)] = top(j)
    assert len(groups) == len({top(i) for i in range(len(fps))})


def test_long_chain(spark):
    rows = {(r.node, r.root) for r in sh.connected(spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "u long, v long")).collect()}
    assert rows == {(i, 0) for i in range(1, 71)} | {(101, 100)}
