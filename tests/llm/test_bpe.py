import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.llm.common import flat

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n):
    rng = random.Random(7)
    parts = ["it's", "we'll", "'re", "'r", "''s", " 's", "\n", "\n\n", "  ", " ", "é", "Ⅷ", "１２", "don't", "'", "l", "ll", "e", "ve", "!", "?!", "　", " ", "中文", "ab", "X", "7", "\x1c", "​", "🙂", "'m", "'d'd", "\t", "r", "v"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ids_match(reference):
    given = [*texts(4000), "", None, "a" * 3000, " " * 500, "ab" * 5000 + "!" * 999, "<|endoftext|>"]
    got = bpe.model(PATH).encode(pa.array(given))
    for i, text in enumerate(given):
        ids = got.ids[got.tokens[i] : got.tokens[i + 1]].tolist()
        assert ids == reference.encode_ordinary(text or ""), repr(text)
    data, at = bpe.model(PATH).decode(got.ids)
    assert data.tobytes() == "".join(x or "" for x in given).encode()
    assert np.array_equal(flat(pa.array(given))[1], at[got.tokens])


def test_frames(spark, reference):
    given = [(1, "it's a  test\n", "x"), (1, "it's a  test\n", "x"), (2, None, "y"), (None, "", None), (5, "é" * 40_000, "")]
    df = spark.createDataFrame(given, "doc_id long, text string, ids string")
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(ids := reference.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, _ in given}
    assert rows == want
    encoded = bpe.encode(df, PATH)
    assert sorted((r.bytes for r in bpe.decode(encoded, PATH).collect())) == sorted((t or "").encode() for _, t, _ in given)
    first = encoded.where("doc_id = 1").first()
    assert first.starts[:3] == [0, 2, 4] and first.first_ids[0] == 0
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
