import hashlib
import zlib

from tidemark.llm import media


def test_round_trip(spark, tmp_path):
    given = [(1, "é" * 300), (2, "é" * 300), (2, "é" * 300), (3, None), (4, ""), (5, "x" * 576), (6, "y" * 200_000), (None, "z")]
    df = spark.createDataFrame([(*g, 7) for g in given], "doc_id long, text string, digest int")
    folder = f"file://{tmp_path}/shards"
    rows = media.media(df, folder).collect()
    assert len(rows) == len(given)
    want = {}
    for i, t in given:
        raw = (t or "").encode()
        want[i] = raw, raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
    for r in rows:
        raw, data = want[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.width, r.height, r.bits) == (576, len(data) // 576, 8)
    files = [p.read_bytes() for p in (tmp_path / "shards").iterdir()]
    stored = {hashlib.sha256(data).hexdigest(): data for f in files for data in media.members(f).values()}
    assert all(len(stored[r.media_sha256]) == r.media_bytes and hashlib.sha256(media.from_png(stored[r.media_sha256])).hexdigest() == r.payload_sha256 for r in rows)
    assert all(name == f"{hashlib.sha256(media.from_png(data)).hexdigest()}.png" for f in files for name, data in media.members(f).items())
    assert len(stored) == 5 == sum(len(media.members(f)) for f in files)  # each content once
    for r in rows:
        data = want[r.doc_id][1]
        assert r.feature == f"sum={sum(data)};squares={sum(x * x for x in data)};range={min(data)}-{max(data)};bins=" + ",".join(str(sum(x // 16 == k for x in data)) for k in range(16))
    _, places = media.store(df, f"file://{tmp_path}/again")
    heads = media.metadata(media.in_order(places), f"file://{tmp_path}/again").collect()
    assert len(heads) == 5 and {h.height for h in heads} == {2, 1, 348}
    assert media.media(df.limit(0)).count() == 0


def test_one_copy_over_many_tasks(spark, tmp_path):
    texts = [f"text {i % 10}" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    df.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    rows, places = media.store(df, f"file://{tmp_path}/shards")
    assert df.rdd.getNumPartitions() > 1 and places.count() == 10 and rows.count() == 200
    names = [n for p in (tmp_path / "shards").iterdir() for n in media.members(p.read_bytes())]
    assert len(names) == len(set(names)) == 10
