import random
import zlib
from collections import Counter, defaultdict

from tidemark.llm import sharding as sh


def test_tree_is_a_sorted_list():
    rng, tree, known = random.Random(1), sh.RemainingCapacity(), []
    for i in range(3000):
        if known and rng.random() < 0.45:
            tree.remove(*known.pop(rng.randrange(len(known))))
        else:
            known.append((rng.randint(0, 50), i))
            tree.insert(*known[-1])
        size = rng.randint(0, 55)
        assert tree.tightest(size) == min((x for x in known if x[0] >= size), default=None)
        if known:
            assert tree.emptiest() == max(known)


def rows_of(spark, given, shards=24):
    df = spark.createDataFrame(given, "doc_id long, text string, size string, shard string")
    return sh.numbered(sh.pack(df, shards)).collect()


def test_law_groups_and_slots(spark):
    rng = random.Random(5)
    texts = ["x" * rng.randint(1, 900) + str(i) for i in range(2500)] + ["same text " * 30] * 200 + [None, "", ""]
    given = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(7, texts[7], "", "")]
    rows = rows_of(spark, given)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in given)
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[bytes(r.h)].add(r.shard)
    assert set(load) == set(range(24)) and max(load.values()) < 1.01 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    cap = sum(load.values()) / 24
    for group, shards in where.items():
        size = sum(r.size for r in rows if bytes(r.h) == group) if len(shards) > 1 else 0
        assert len(shards) == 1 or size > cap


def plain(sizes, shards):
    """Best-fit decreasing, group by group, by looking at every shard."""
    left = [float(max(1, -(-sum(sizes) // shards)))] * shards
    for size in sorted(sizes, reverse=True):
        fits = [i for i in range(shards) if left[i] >= size]
        at = min(fits, key=lambda i: (left[i], i)) if fits else max(range(shards), key=lambda i: (left[i], i))
        left[at] -= size
        yield size, at


def test_runs_are_best_fit_decreasing():
    rng = random.Random(8)
    for shards, sizes in ((24, [rng.randint(9, 400) for _ in range(3000)]), (5, [8] * 999 + [17] * 40), (24, [rng.randint(9, 60) for _ in range(30)]), (3, [int(rng.paretovariate(0.7)) + 8 for _ in range(500)])):
        capacity = max(1, -(-sum(sizes) // shards))
        got = Counter()
        for size, low, high, shard in sh.runs_of(list(Counter(sizes).items()), shards, capacity):
            got[size, shard] += high - low
        assert got == Counter(plain(sizes, shards))


def test_shards_are_those_of_best_fit_decreasing(spark):
    rng = random.Random(15)
    texts = [f"{i} " + "y" * rng.randint(1, 300) for i in range(600)]
    given = [(i, t, "", "") for i, t in enumerate(texts + texts[:50])]
    rows = rows_of(spark, given, 7)
    sizes, shard = Counter(), {}
    for r in rows:
        sizes[bytes(r.h)] += r.size
        assert shard.setdefault(bytes(r.h), r.shard) == r.shard
    assert Counter((sizes[h], s) for h, s in shard.items()) == Counter(plain(list(sizes.values()), 7))


def test_a_repeated_row_is_cut(spark):
    load = Counter(r.shard for r in rows_of(spark, [(7, "equal", "", "")] * 480, 4))
    assert set(load) == {0, 1, 2, 3} and max(load.values()) < 2 * min(load.values())


def test_edge_tables(spark):
    assert rows_of(spark, []) == []
    rows = rows_of(spark, [(1, None, "", "")] * 3 + [(None, "a", "", "")])
    assert sorted(r.size for r in rows) == [8, 8, 8, 9] and len({(r.shard, r.slot) for r in rows}) == 4
    one = rows_of(spark, [(i, "equal", "", "") for i in range(500)], 4)  # one group larger than a shard
    load = Counter(r.shard for r in one)
    assert set(load) == {0, 1, 2, 3} and max(load.values()) < 2 * min(load.values())
