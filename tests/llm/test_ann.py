import numpy as np

from tidemark.llm import ann


def brute(ids, rows, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = rows @ rows[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def frame(spark, ids, rows, extra=()):
    return spark.createDataFrame([*((int(i), [float(x) for x in r], "x") for i, r in zip(ids, rows)), *extra], "vec_id long, embedding array<float>, query_id string")


def results(df):
    out = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((9000, 24)).astype(np.float32)
    rows[:3000] = rows[0]  # one vector holds a third
    rows[3000:6000] += 3 * rows[:20][rng.integers(0, 20, 3000)]
    ids = rng.permutation(9000)
    odd = [(20_000, None, ""), (20_020, [0.0] * 24, ""), (20_040, [1.0] * 23, ""), (20_060, [float("nan")] + [1.0] * 23, ""), (20_080, [float("inf")] * 24, ""), (None, [100.0] * 24, ""), (20_100, [None] + [1.0] * 23, "")]
    want, got = brute(ids, rows.astype(np.float64)), results(frame(spark, ids, rows, odd))
    assert want.keys() == got.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q in want:
        assert len(got[q]) == 20 and [x for x in got[q]] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        exact = {int(i): float(rows[k].astype(np.float64) @ rows[np.flatnonzero(ids == q)[0]].astype(np.float64)) for k, i in enumerate(ids) if int(i) in {x for x, _ in got[q]}}
        assert all(abs(s - exact[i]) < 1e-9 * max(1, abs(s)) for i, s in got[q])


def test_few_rows(spark):
    rows = np.random.default_rng(1).standard_normal((7, 5)).astype(np.float32)
    ids = np.arange(0, 140, 20)
    got = results(frame(spark, [*ids, 0], [*rows, rows[0]]))  # a repeated row
    want = brute(ids, rows.astype(np.float64))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert ann.nearest(frame(spark, [], [])).count() == 0
    assert ann.nearest(frame(spark, [20], [[0.0] * 4])).count() == 0
    assert ann.nearest(frame(spark, [20], [[1.0] * 4])).count() == 0


def exact(monkeypatch):
    """All lists visited, nothing abandoned in error: the answers must be those of brute force."""
    monkeypatch.setattr(ann.Index, "_visits", lambda self, *_: len(self.centres))
    monkeypatch.setattr(ann, "EPSILON", 50.0)


def test_repeated_rows(spark, monkeypatch):
    exact(monkeypatch)
    rng = np.random.default_rng(6)
    rows, ids = rng.standard_normal((400, 12)).astype(np.float32), np.arange(400)
    want = brute(ids, rows.astype(np.float64))
    for times in (np.full(400, 2), np.where(ids == 7, 1000, 1)):
        got = results(frame(spark, np.repeat(ids, times), np.repeat(rows, times, axis=0)))
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_rows_of_one_vec_id(spark, monkeypatch):
    exact(monkeypatch)
    rng = np.random.default_rng(8)
    rows, ids = rng.standard_normal((900, 12)).astype(np.float32), np.arange(900) // 3
    ids[:600] = 401  # one vec_id with many vectors counts with its best
    got = results(frame(spark, ids, rows))
    wide = rows.astype(np.float64)
    for q in set(ids[ids % 20 == 0].tolist()):
        query = np.array(min(map(list, wide[ids == q])))
        best = {}
        for i, s in zip(ids.tolist(), (wide @ query).tolist()):
            if i != q:
                best[i] = max(s, best.get(i, s))
        assert [i for i, _ in got[q]] == sorted(best, key=lambda i: (-best[i], i))[:20]


def test_recall_comes_from_the_lists(spark, monkeypatch):
    """With a sample of a tenth of the rows, what isn't in it can only be found by the scan."""
    monkeypatch.setattr(ann, "SAMPLE", 500)
    monkeypatch.setattr(ann, "BOUNDS", 100)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32)) * 2
    rows = (centres[rng.integers(0, 40, 5000)] + rng.standard_normal((5000, 32))).astype(np.float32)
    ids = np.arange(5000)
    want, got = brute(ids, rows.astype(np.float64)), results(frame(spark, ids, rows))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert ann.Index(ids[:500], rows[:500].astype(np.float64), 30.0, 5000).visits < 31  # of 31 lists


def test_scan_abandons_candidates_and_loses_no_near_one():
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((4000, 64))
    rows[:400] += 3 * rng.standard_normal((1, 64))
    ids, longest = np.arange(4000), float(np.sqrt((rows**2).sum(1)).max())
    index = ann.Index(ids[::8], rows[::8], longest, 4000)
    queries, asked = rows[:400:10], ids[:400:10]
    bound = index.bounds(asked, queries)
    qi, pi, score, abandoned = index.scan(ids, rows, asked, queries, bound)
    want = brute(ids * 20, rows)  # every id is a query
    hits = sum(len({int(i) for i in ids[pi[qi == k]]} & {i // 20 for i, _ in want[int(q) * 20]}) for k, q in enumerate(asked))
    assert hits >= 0.99 * 20 * len(asked)
    assert abandoned > 0.5 * len(queries) * len(rows)  # most candidates go before their last column
    assert np.allclose(score, (queries[qi] * rows[pi]).sum(1))
