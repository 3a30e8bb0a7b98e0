import random
import re
import struct
from collections import Counter, defaultdict

import xxhash

from tidemark.llm import mixing


def prime(n):
    if n % 2 == 0:
        return False
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = goal - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        if not (above := {s for s in share if share[s] > 2 * sizes[s]}):
            return share | {s: 2.0 * sizes[s] for s in full}
        full |= above


def test_multipliers_are_prime():
    assert all(p > 2**43 and prime(p) for p in mixing.PRIMES)


def test_targets_and_taken(spark):
    rng = random.Random(2)
    given = []
    for i in range(1200):
        source = rng.choice(["src0"] * 8 + ["src1", "src2", "a", "Z", "é", "", None])
        given.append((i, source, rng.choice(["w  x\ty\n", "one ", "\x0b", ""]) * rng.randint(0, 900), "x", 1))
    given += [(3, "src1", "again and again", "x", 1)] * 2 + [(None, "src1", "no id", "x", 1), (9999, "src2", None, "x", 1), (10000, "tiny", "a b c", "x", 1)]
    docs = spark.createDataFrame(given, "doc_id long, source string, text string, taken string, size int")
    rows = [r.asDict() for r in mixing.taken(mixing.sized(docs)).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, size(t)) for i, _, t, _, _ in given)
    sums = Counter()
    for i, s, t, _, _ in given:
        sums[s] += size(t)
    want = targets(dict(sums))
    source_of = defaultdict(set)
    for i, s, t, _, _ in given:
        source_of[i, size(t)].add(s)
    got = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        (source,) = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sums[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        got[source] += r["taken"]
    for s in sums:
        assert abs(got[s] - want[s]) <= 2 * mixing.BLOCK, s
    again = [r.asDict() for r in mixing.taken(mixing.sized(docs.repartition(7))).collect()]
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def chained(*values):
    """Spark's xxhash64 of several columns: each value hashed with the hash so far as seed; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, I) else "<q", v), h)
    return h - (1 << 64) if h >> 63 else h


class I(int):  # a 32-bit literal  # noqa: E742
    pass


def brute(given, block, shard_slots):
    """taken, first and last shard of each row of (doc_id, source, size), step by step as the module says it."""
    sizes = Counter()
    for _, s, n in given:
        sizes[s] += n
    want, out, plan = targets(dict(sizes)), {}, {}
    for s, total in sizes.items():
        blocks = -(-total // block)
        whole = int(want[s] // total) if total else 0
        plan[s] = blocks, whole * blocks + min(blocks, int((want[s] - whole * total) / block + 0.5))
    shards = max(1, -(-sum(n for _, n in plan.values()) // shard_slots))
    for s, (blocks, n) in plan.items():
        key = "n" if s is None else f"s{s}"
        counts = Counter(int((chained(I(20), key, i) % (1 << 64) >> 11) / (1 << 53) * shards) for i in range(n))
        times, seen, i = Counter(), defaultdict(list), 0
        for shard in sorted(counts):
            for _ in range(counts[shard]):
                turn = i // blocks
                prime = mixing.PRIMES[chained(I(17), key, turn) % len(mixing.PRIMES)]
                at = (prime * (i % blocks) + chained(I(18), key, turn) % blocks) % blocks
                times[at] += 1
                seen[at].append(shard)
                i += 1
        rows = sorted((r for r in given if r[1] == s), key=lambda r: (chained(I(17), r[0], r[2]) % mixing.BUCKETS, chained(I(19), r[0]), r[0], r[2]))
        at = 0
        for doc, _, size in rows:
            mine = range(at // block, (at + size - 1) // block + 1) if size else []
            got = sum((min(at + size, (b + 1) * block) - max(at, b * block)) * times[b] for b in mine)
            where = [x for b in mine for x in seen[b]]
            out[doc] = (got, min(where, default=None), max(where, default=None))
            at += size
    return out


def test_taken_of_each_document(spark):
    rng = random.Random(12)
    given = [(i, rng.choice(["src0"] * 6 + ["a", "é", None]), rng.choice([0, 1, 30, 127, 128, 500, 2000])) for i in range(400)]
    docs = spark.createDataFrame(given, "doc_id long, source string, size long").repartition(3)
    got = {r.doc_id: (r.taken, r.first_shard, r.last_shard) for r in mixing.taken(docs, shard_slots=100).collect()}
    want = brute(given, mixing.BLOCK, 100)
    assert got == want and len({x for _, *s in want.values() for x in s}) > 5


def test_shards_are_drawn(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 40_000) for i in range(60)], "doc_id long, source string, size long")
    _, _, slots = mixing.mix(docs, shard_slots=1000)
    counts = Counter((r.shard, r.source_key) for r in slots.collect())
    totals, n = Counter(), sum(counts.values())
    for (_, source), k in counts.items():
        totals[source] += k
    shards = 1 + max(s for s, _ in counts)
    assert shards == -(-n // 1000)
    # Chi-squared of independent draws: about as large as its degrees of freedom, neither nothing nor much more.
    chi = sum((counts[s, source] - totals[source] / shards) ** 2 / (totals[source] / shards) for s in range(shards) for source in totals)
    free = (shards - 1) * len(totals)
    assert free - 5 * (2 * free) ** 0.5 < chi < free + 5 * (2 * free) ** 0.5 and chi > 0.3 * free


def test_blocks_of_the_mix_and_clashing_names(spark):
    rng = random.Random(1)
    given = [(i, rng.choice(["a", "b", None]), " ".join(f"w{i}.{k}" for k in range(rng.randint(0, 400))), 777, [i], "x") for i in range(80)] + [(None, "a", None, 1, None, "")]
    docs = spark.createDataFrame(given, "doc_id long, source string, text string, size int, words array<long>, at string")
    rows = mixing.mixed_blocks(docs, shard_slots=50).collect()
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.shard, r.source_key, r["pass"], r.block].append(r)
    full = 0
    for parts in blocks.values():
        parts.sort(key=lambda r: r.offset)
        assert all(a.offset + len(a.words) == b.offset for a, b in zip(parts, parts[1:])) and parts[0].offset == 0
        full += sum(len(r.words) for r in parts) == mixing.BLOCK
    assert full >= len(blocks) - 6  # all but the last block of a source are full
    times = Counter()
    for r in rows:
        times[r.doc_id] += len(r.words)
    assert {r.doc_id: r.taken for r in mixing.taken(mixing.sized(docs)).collect() if r.taken} == dict(times)
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    whole = {g[0]: g for g in given}
    got = texts.collect()
    assert got and all((r.source, r["size"], r.words, r.at) == (whole[r.doc_id][1], *whole[r.doc_id][3:]) for r in got)


def test_slots_cover_blocks_evenly(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 1000 + i) for i in range(100)], "doc_id long, source string, size long")
    _, _, slots = mixing.mix(docs)
    times = Counter((r.source_key, r["pass"], r.block) for r in slots.collect())
    assert set(times.values()) == {1}
    assert mixing.taken(docs.limit(0)).count() == 0
