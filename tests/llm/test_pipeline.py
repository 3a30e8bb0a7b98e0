import hashlib
import os
import random
import re
from collections import Counter

import corpus_pipeline as cp
from test_bpe import PATH, reference  # noqa: F401
from test_simhash import brute as components
from test_toxicity import corpus

WORD = r"[^\x20\x09-\x0D]+"


def test_stages(spark, tmp_path, reference):  # noqa: F811
    rng = random.Random(9)
    given = corpus(700)
    docs = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t)) for i, t, _ in given]
    docs += [(10_000 + i, docs[i][1].upper(), "en", "src1", len(docs[i][1])) for i in range(1, 80)]  # near copies
    docs += [(10_001, docs[1][1].upper(), "en", "src1", 1)] + [(20_000, None, "en", "src2", 0), (None, "", "fr", "src2", 0), (None, "words of a row without id", None, None, 1), (30_000, "v " * 40_000, "en", "big", 1)]
    rng.shuffle(docs)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    os.makedirs(tmp_path / "t")
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in given], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/t/labels.parquet")
    sf = f"{tmp_path}/t"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    frames = []
    for name, stage in cp.STAGES:
        out = stage(spark, before, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        frames.append([tuple(r) for r in before.collect()])
        assert name == "token_ids" or before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, single, mix, ids = frames
    assert not Counter(clean) - Counter(docs)
    bad = {i for i, _, y in given if y}
    assert sum(r[0] in bad for r in clean) <= 0.1 * len(bad) and sum(r[0] is not None and r[0] < 9000 and r[0] not in bad for r in clean) >= 0.99 * (700 - len(bad))
    groups = components([(r[0], r[1]) for r in clean])
    want = Counter(c for _, _, c in set(groups) if c is not None)
    assert Counter(r[0] for r in single if r[0] is not None) == Counter(dict.fromkeys(want, 1)) and not Counter(single) - Counter(clean)
    own = {r[0]: r for r in single}
    size = lambda t: len(re.findall(WORD, t or ""))
    times = Counter()
    for doc, text, lang, source, n in mix:
        whole = own[doc]
        assert (lang, source) == whole[2:4] and n == len(text)
        if text != whole[1]:
            words = iter(re.findall(WORD, whole[1]))
            assert all(w in words for w in text.split(" "))  # a part, in its order
        times[doc] += size(text)
    assert all(times[d] <= 2 * size(own[d][1]) for d in times)
    total = sum(size(r[1]) for r in single)
    assert abs(sum(times.values()) - 1.5 * total) <= 6 * 128
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter((d, len(e := reference.encode_ordinary(t)), sha(",".join(map(str, e)).encode()), sha(t.encode())) for d, t, *_ in mix) == Counter(r[:4] for r in ids)
    assert all(sha(",".join(map(str, r[4])).encode()) == r[2] for r in ids)
    assert sorted(map(str, cp.run(spark, sf).select("doc_id", "ids_sha256").collect())) == sorted(f"Row(doc_id={r[0]}, ids_sha256='{r[2]}')" for r in ids)
    for _, stage in cp.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf).count() == 0


def test_columns_of_any_name_are_kept(spark, tmp_path):
    given = [(i, t, "en", f"s{i % 2}", len(t), 777 + i, [f"w{i}"], "row", i / 2, None, b"x") for i, t, _ in corpus(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, words array<string>, own_row string, at double, bucket int, spans binary"
    docs = spark.createDataFrame(given, schema)
    spark.createDataFrame([(i, 1, y) for i, _, y in corpus(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = {g[0]: g for g in given}
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert rows and all(tuple(r)[5:] == tuple(bytes(x) if isinstance(x, bytearray) else x for x in whole[r.doc_id][5:]) for r in rows), name
