import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import pitman_yor as py
from tidemark.llm import seating


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def corpus():
    rng = random.Random(4)
    usual = [f"W{i}" for i in range(120)]
    given = []
    for i in range(500):
        word, out = 0, []
        for _ in range(rng.randint(0, 60)):
            word = (word * 7 + rng.choice([1, 1, 1, 2, 50])) % 120  # the next word hangs on the last
            out.append(usual[word] if rng.random() < 0.95 else f"new{rng.random()}")
        given.append((i, rng.choice([" ", "\n"]).join(out)))
    return [*given, (9000, None), (9001, ""), (None, "no id"), (3, given[3][1]), (9002, "W1 " * 30_000)]


def frame(spark, given):
    df = spark.createDataFrame([(*g, held(g[0]), "x") for g in given], "doc_id long, text string, held boolean, score string")
    return df.repartition(5, "doc_id") if given else df


def training_counts(given):
    return Counter(w for i, t in given if not held(i) for w in tokens(t))


def test_counts_and_base(spark):
    given = corpus()
    old = py.BLOCK_BYTES
    py.BLOCK_BYTES = 4000  # many blocks
    try:
        rows = py.score(frame(spark, given)).collect()
    finally:
        py.BLOCK_BYTES = old
    count = training_counts(given)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(w := tokens(t)), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, t in given), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str) == want
    whole = py.score(frame(spark, given).coalesce(1)).collect()  # one block: the same model
    key = lambda r: (str(r.doc_id), r.n_tokens)
    assert all(abs(a.score - b.score) < 1e-6 * max(1, abs(a.score)) for a, b in zip(sorted(rows, key=key), sorted(whole, key=key)))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # held-out texts are likelier than under the base
    report = {r.held_out: r for r in py.perplexity(spark.createDataFrame(rows)).collect()}
    assert report[True].perplexity < report[True].base_perplexity
    assert py.score(frame(spark, [])).count() == 0
    nothing = py.score(frame(spark, [(i, "a b") for i in range(40) if held(i)])).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in nothing) and nothing


def stirling(c, d):
    """S(c, t) for t = 1..c, by the recurrence."""
    row = [1.0]
    for n in range(1, c):
        row = [(row[t - 1] if t else 0) + (row[t] * (n - d * (t + 1)) if t < len(row) else 0) for t in range(len(row) + 1)]
        top = max(row)
        row = [x / top for x in row]
    return row


def seat(c, rest, parent, d, u):
    """Tables for c customers from the conditional, weight by weight; parent(m): the parent's probability after m tables."""
    weights, product = [], 1.0
    for t, ways in enumerate(stirling(c, d)):
        product *= (py.STRENGTH + d * (rest + t)) * parent(t)
        weights.append(ways * product)
    total, aim = 0.0, u * sum(weights)
    for t, x in enumerate(weights):
        total += x
        if total >= aim:
            return t + 1
    return c


def share(c, t, whole, tables, d, parent):
    """The probability of a dish with c customers at t tables, after m more customers."""
    t = min(t, max(c, 0))
    rest = (py.STRENGTH + d * tables) * parent

    def p(m):
        if m == 0:
            return (max(c, 0) - d * t + rest) / (py.STRENGTH + whole)
        return (c + m - d * max(t, 1) + rest + (d * parent if t == 0 else 0)) / (py.STRENGTH + whole + m)

    return p


def word_hash(w):
    h, data = len(w.encode()) + 7, w.encode()
    mix = lambda x: int(py.mixed(np.array([x], dtype=np.uint64))[0])
    h = mix(h)
    for i in range(0, len(data), 8):
        h = mix(h ^ int.from_bytes(data[i : i + 8], "little"))
    return h


class Sampler:
    """The same model with dictionaries, one dish after the other."""

    def __init__(self, given, places):
        self.count, self.uses, self.texts = Counter(), Counter(), []
        for i, text in given:
            h = [int(py.END) if w is None else word_hash(w) for w in tokens(text)]
            path = [int(py.START)] * 2 + h
            self.texts.append(list(zip(path, path[1:], h)))
            self.uses.update([int(py.START), *h])
            for x in self.texts[-1]:
                self.count[x] += not held(i)
        mix = lambda x: int(py.mixed(np.array([x], dtype=np.uint64))[0])
        of_place = {}
        for h in self.uses:
            of_place.setdefault(mix(h) % places, []).append(h)
        self.number = {h: rank * places + place for place, all_ in of_place.items() for rank, h in enumerate(sorted(all_, key=lambda h: (-self.uses[h], h)))}
        word = lambda x: (1 << 64) - 1 & x
        n = self.number
        self.seed3 = {(a, b, w): mix(word(mix(word(mix(n[a]) + n[b])) + n[w])) for a, b, w in self.count}
        self.seed2 = {(b, w): mix(word(mix(n[b]) + n[w])) for _, b, w in self.count}
        self.seed1 = {h: mix(n[h]) for h in self.uses}
        self.known = len({w for (_, _, w), c in self.count.items() if c})
        self.base = 1 / (self.known + 1)
        self.t3 = {k: min(c, 1) for k, c in self.count.items()}
        self.t2 = {k: min(c, 1) for k, c in self.pairs().items()}
        self.d = [self.discount(self.count.values()), self.discount(self.pairs().values()), self.discount(self.roots().values())]
        self.root()
        self.t1 = {w: min(c, 1) for w, c in self.c1.items()}
        self.kept = []
        for sweep in range(py.SWEEPS + py.SAMPLES):
            if sweep == py.SWEEPS:
                self.root(py.SWEEPS - 1)
            self.sweep(sweep)
            if sweep >= py.SWEEPS:
                self.kept.append((dict(self.t3), dict(self.t2)))
        self.states = []
        for k, (self.t3, self.t2) in enumerate(self.kept):
            self.root(py.SWEEPS + k)
            self.states.append((self.t3, self.t2, self.c1, self.t1))

    @staticmethod
    def discount(counts):
        ones, twos = (sum(c == k for c in counts) for k in (1, 2))
        return (ones + 0.5) / (ones + 2 * twos + 1)

    def pairs(self):
        out = Counter()
        for (_, b, w), t in self.t3.items():
            out[b, w] += t
        return out

    def roots(self):
        out = Counter()
        for (_, w), t in self.t2.items():
            out[w] += t
        return out

    def root(self, sweep=None):
        self.c1, self.sent = self.roots(), dict(self.t2)
        if sweep is not None:
            self.t1 = {w: min(c, 1) if c < 2 else seat(c, 0, lambda m: self.base, self.d[2], self.u(self.seed1[w], 0, sweep)) for w, c in self.c1.items()}

    def u(self, seed, level, sweep):
        return float(py.uniform(np.array([seed], dtype=np.uint64), level, sweep)[0])

    def p1(self, w, without=0):
        t = min(self.t1[w], max(self.c1[w] - without, 0))
        return share(self.c1[w] - without, self.t1[w], sum(self.c1.values()) - without, sum(self.t1.values()) - self.t1[w] + t, self.d[2], self.base)

    def p2(self, b, w, without=0):
        c = self.now2[b, w] - without
        t = min(self.t2[b, w], max(c, 0))
        parent = self.p1(w) if c > 0 else self.p1(w, self.sent[b, w])
        return share(c, self.t2[b, w], self.whole2[b] - without, self.tables2[b] - self.t2[b, w] + t, self.d[1], parent(0))

    def totals(self):
        self.now2, self.whole2, self.tables2, self.tables3 = self.pairs(), Counter(), Counter(), Counter()
        for (b, w), c in self.now2.items():
            self.whole2[b] += c
            self.tables2[b] += self.t2[b, w]
        for (a, b, _), t in self.t3.items():
            self.tables3[a, b] += t

    def sweep(self, sweep):
        for half in (0, 1):
            self.totals()
            self.t3 |= {k: seat(c, self.tables3[k[:2]] - self.t3[k], self.p2(k[1], k[2], self.t3[k]), self.d[0], self.u(self.seed3[k], 2, sweep)) for k, c in self.count.items() if c > 1 and self.seed3[k] & 1 == half}
        now = self.pairs()
        self.t2 = {k: min(max(self.t2[k], 1), c) if c > 1 else min(c, 1) for k, c in now.items()}
        for half in (0, 1):
            self.totals()
            self.t2 |= {k: seat(c, self.tables2[k[0]] - self.t2[k], self.p1(k[1], self.sent[k]), self.d[1], self.u(self.seed2[k], 1, sweep)) for k, c in now.items() if c > 1 and self.seed2[k] & 1 == half}

    def predict(self, a, b, w):
        """The mean of the samples' probabilities; w may be a word that no text holds."""
        out, whole = 0, sum(c for (x, y, _), c in self.count.items() if (x, y) == (a, b))
        for self.t3, self.t2, self.c1, self.t1 in self.states:
            self.sent = self.t2
            self.totals()
            if w not in self.c1:
                self.c1[w], self.t1[w] = 0, 0
            if (b, w) not in self.t2:
                self.t2[b, w] = 0
            tables = self.tables3[a, b]
            out += (self.count[a, b, w] - self.d[0] * self.t3.get((a, b, w), 0) + (py.STRENGTH + self.d[0] * tables) * self.p2(b, w)(0)) / (py.STRENGTH + whole)
        return out / len(self.states)


SMALL = [(i, " ".join(random.Random(i).choices("a b c d e f g h".split(), weights=[30, 20, 9, 5, 4, 3, 2, 1], k=i % 12))) for i in range(70)] + [(500, "a b a b " * 40), (501, None)]


def test_scores_against_a_plain_sampler(spark):
    model = Sampler(SMALL, 4)
    assert max(model.count.values()) > 30 and any(t > 1 for t in model.kept[0][0].values()) and any(t > 1 for t in model.kept[0][1].values()) and model.kept[0] != model.kept[1]
    want = {i: sum(math.log10(model.predict(*x)) for x in model.texts[k]) for k, (i, _) in enumerate(SMALL)}
    for parts in (1, 5):
        got = {r.doc_id: r.score for r in py.score(frame(spark, SMALL).repartition(parts)).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 1e-5 * (len(tokens(t)) + 1) for i, t in SMALL)


def test_predictive_sums_to_one():
    """Over the known words and the unknown one, in contexts that occur and in one that doesn't."""
    model = Sampler(SMALL, 4)
    known = {w for (_, _, w), c in model.count.items() if c}
    contexts = [k[:2] for k in list(model.count)[:6]] + [(1, 2)]
    for a, b in contexts:
        assert abs(sum(model.predict(a, b, w) for w in known) + model.predict(a, b, 12345) - 1) < 1e-9


def test_split_words_and_many_buckets(spark, monkeypatch):
    given = corpus()
    whole = {(r.doc_id, r.n_tokens): r for r in py.score(frame(spark, given)).collect()}
    monkeypatch.setattr(py, "BUCKET_KEYS", 700)  # the words of the corpus are used more often
    parts = {(r.doc_id, r.n_tokens): r for r in py.score(frame(spark, given)).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k].base_score - parts[k].base_score) < 1e-6 for k in whole)
    out = [k for k in whole if whole[k].held_out]
    a, b = sum(whole[k].score for k in out), sum(parts[k].score for k in out)
    assert abs(a - b) < 0.01 * abs(a) and all(abs(whole[k].score - parts[k].score) < 0.05 * abs(whole[k].score) + 0.1 for k in whole)


def test_stirling_numbers_of_many_customers():
    for d in (0.2, 0.5, 0.8, 0.95):
        table = seating.stirling_table(d)
        t = np.array([1, 2, 3, 7, 20, 60, 200, 500])
        assert np.abs(seating.log_stirling(np.full(8, 1000.0), t.astype(float), d) - table[1000, t]).max() < 0.06
        assert all(abs(math.log(b) - math.log(a) - table[40, i + 2] + table[40, i + 1]) < 1e-9 for i, (a, b) in enumerate(zip(stirling(40, d), stirling(40, d)[1:])))


def test_large_dishes_are_drawn_like_small_ones():
    n, rng = 2000, np.random.default_rng(3)
    for d, first, rest in ((0.3, 1e-4, 20.0), (0.5, 0.02, 300.0), (0.8, 0.01, 50.0)):
        args = np.full(n, rest), np.full(n, first), np.full(n, 0.2), np.full(n, 500.0)
        u = rng.random(n)
        exact = seating.drawn(np.full(n, 900), *args, d, 1.0, u)
        grid = seating.drawn_large(np.full((n, 1), 900.0), *(x[:, None] for x in args), d, 1.0, u)
        assert abs(exact.mean() - grid.mean()) < 0.05 * exact.mean() + 0.05 and exact.min() >= 1 and grid.min() >= 1
    huge = seating.drawn(np.array([10**7, 1, 0, 2]), np.full(4, 9.0), np.full(4, 0.01), np.full(4, 0.5), np.full(4, 99.0), 0.7, 1.0, np.full(4, 0.5))
    assert 1 <= huge[0] < 10**6 and huge.tolist()[1:3] == [1, 0]


def test_hashes():
    given = ["", "a", "abcdefgh", "abcdefghi", "é" * 30, "x" * 1000, "a\0", "a\0\0"]
    got = py.hashes_of(pa.array(given)).tolist()
    assert got == [word_hash(w) for w in given] and len(set(got)) == len(given)


def test_packing():
    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 50, 3000), rng.integers(0, 9, 3000), rng.integers(0, 2**40, 3000)
    order, new, at = py.sorted_runs(b, w, a)
    head = order[new]
    data = [*py.packed(a[head], b[head], w[head]), py.planes(b[head][py.runs(b[head])] + 7)]
    back = py.unpacked(data)
    assert all(np.array_equal(x, y) for x, y in zip(back, (a[head], b[head], w[head], b[head] + 7)))
    assert np.array_equal(b[head][at], b) and np.array_equal(w[head][at], w)
    for x in (np.array([], dtype=np.int64), np.array([0, 255, 2**32 - 1]), np.array([2**40, 3])):
        assert np.array_equal(py.from_planes(py.planes(x)), x)
