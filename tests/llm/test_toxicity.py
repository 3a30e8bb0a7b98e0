import random
import zlib

from tidemark.llm import toxicity

BAD = ["vile", "rotten", "nasty", "foul"]


def corpus(n, seed=3):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 10 == 0
        words = [rng.choice(common) if rng.random() < 0.8 else f"r{rng.random()}" for _ in range(rng.randint(20, 400))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(BAD).upper() + ","
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    given = corpus(1500)
    extra = [(10_000, None), (10_001, ""), (None, "vile rotten nasty foul text"), (1, given[1][1]), (10_002, "fine " * 50_000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in given] + [(*e, 9) for e in extra], "doc_id long, text string, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    # Labels of held-out rows are wrong here: they must not be used.
    labels = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in given] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(given) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    truth = {i: y for i, _, y in given}
    judged = [(truth[r.doc_id], r.score >= 0.5) for r in rows if r.doc_id in truth and held(r.doc_id)]
    assert sum(y == p for y, p in judged) >= 0.97 * len(judged) and sum(p for y, p in judged if not y) <= 2
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[None] >= 0.5 and by_id[10_000] == by_id[10_001] < 0.5 and by_id[10_002] < 0.5
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.scored(docs, none).collect()] == [0.0, 0.0]
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scored(docs, one).collect()} == {1.0}
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_rare_words_and_length(spark):
    import numpy as np
    import pyarrow as pa

    given = corpus(1000)
    rare = [i for i, _, y in given if y and zlib.crc32(str(i).encode()) % 5][:3]
    docs = spark.createDataFrame([(i, f"{t} grim" if i in rare else t) for i, t, _ in given], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in given], "doc_id long, toxic int"))
    once, twice, grim, unknown = model.evidence(pa.array(["vile w1 w2", "vile w1 w2 vile w1 w2", "grim", "never seen"]), np.zeros(4, dtype=np.int64))
    assert once > 0 and abs(once - twice) < 1e-12
    assert grim > unknown  # in three texts of the sample only


def brute(train, texts, folds=None):
    """Evidence of each text by models of (text, toxic) pairs, word by word."""
    import math
    from collections import Counter

    split = lambda t: [w.strip(toxicity.EDGES) for w in t.lower().split()]
    c = {y: Counter(w for t, z in train if z == y for w in set(split(t))) for y in (0, 1)}
    words = set(c[0]) | set(c[1])
    follows = {w: sum(w in c[y] for y in (0, 1)) + 0.5 for w in words} | {None: 0.5}
    whole = sum(follows.values())

    def p(w, y):
        n = [1 + sum(v == k for v in c[y].values()) for k in (1, 2, 3, 4)]
        y_ = n[0] / (n[0] + 2 * n[1])
        d = [min(k, max(0, k - (k + 1) * y_ * n[k] / n[k - 1])) for k in (1, 2, 3)]
        off = lambda v: min(v, d[min(v, 3) - 1]) if v else 0
        return (c[y][w] - off(c[y][w]) + sum(map(off, c[y].values())) * follows.get(w, 0.5) / whole) / sum(c[y].values())

    out = []
    for t in texts:
        each = [lambda s, r=p(w, 1) / p(w, 0): math.log(1 - s + s * r) for w in split(t)]
        out.append(lambda s, each=each: sum(f(s) for f in each) / max(1, len(each)))
    return out


def test_models_against_brute_force(spark):
    import numpy as np
    import pyarrow as pa

    given = [(i, " ".join(t.split()[:40]), y) for i, t, y in corpus(160)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in given], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in given], "doc_id long, toxic int"))
    train = [(i, t, y) for i, t, y in given if zlib.crc32(str(i).encode()) % 5]
    texts = [t for _, t, _ in given[:50]] + ["", "vile unseen words"]
    want = brute([(t, y) for _, t, y in train], texts)
    got = model.evidences(pa.array(texts), np.zeros(len(texts), dtype=np.int64), toxicity.SHARES)
    assert all(abs(got[k, i] - f(s)) < 1e-9 for i, f in enumerate(want) for k, s in enumerate(toxicity.SHARES))
    fold = lambda i: zlib.crc32(b"fold %d" % i) % toxicity.FOLDS
    crossed = {}
    for k in range(toxicity.FOLDS):
        mine = [x for x in train if fold(x[0]) == k]
        crossed |= {x[0]: f for x, f in zip(mine, brute([(t, y) for i, t, y in train if fold(i) != k], [x[1] for x in mine]))}
    best = max((max(f1(s, cut, train, crossed) for cut in {crossed[i](s) for i, _, _ in train}), -toxicity.SHARES.index(s), s) for s in toxicity.SHARES)
    assert model.share == best[2] and abs(f1(model.share, model.centre, train, crossed) - best[0]) < 1e-12
    assert all((score >= 0.5) == (f(model.share) >= model.centre) for score, f in zip(model.scores(pa.array(texts)), want))


def f1(share, cut, train, crossed):
    said = [(crossed[i](share) >= cut, y) for i, _, y in train]
    return 2 * sum(a and b for a, b in said) / (sum(a for a, _ in said) + sum(b for _, b in said))


def test_labels_of_one_class_reject_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert sorted(r.doc_id for r in toxicity.accepted(docs, model).collect()) == [1, 2]


def test_one_row_of_each_sampled_doc_id(spark, monkeypatch):
    taken = []
    whole = toxicity.count
    monkeypatch.setattr(toxicity, "count", lambda sample: taken.append(sample.count()) or whole(sample))
    given = corpus(100)
    docs = spark.createDataFrame([(i, t) for i, t, _ in given] + [(1, given[1][1])] * 500, "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in given], "doc_id long, toxic int"))
    assert taken == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in given)]
