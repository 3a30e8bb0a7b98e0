import random

import public_tokenizers as P
import pyarrow as pa
import sentencepiece

from tidemark.llm import token_counts as tc

PATH = P.path("piece_bpe_32k.model")


def test_counts_are_the_librarys():
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "▁", "é", "中文", "<s>", "</s>", "<unk>", "a", ".", "\t", "🙂", "ing", " \n", "ﬁ", "<0x0A>"]
    given = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(5000)]
    given += ["", None, " ", "a ", " a", "a  ", "▁ a", "a ▁b", "x" * 3000, "word " * 4000, " " * 700]
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [len(own.encode(x or "")) for x in given]
    got = tc.count(pa.array(given), PATH).tolist()
    assert [(g, w, t) for g, w, t in zip(got, want, given) if g != w] == []


def test_frame(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (2, None, 7), (None, "", 8), (4, "word " * 4096, 9)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, tc.token_counts(df, PATH).collect()), key=str)
    assert rows == sorted([(1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (None, 0, 0, False), (4, 20480, 4097, True)], key=str)
    assert tc.token_counts(df.limit(0), PATH).count() == 0


def test_a_model_that_merges_over_spaces_is_refused(monkeypatch):
    import pytest

    monkeypatch.setattr(tc, "counted", lambda texts, library, cache: tc.np.zeros(len(texts), dtype=int))
    tc.model.cache_clear()
    with pytest.raises(ValueError):
        tc.model(PATH)
    monkeypatch.undo()
    tc.model.cache_clear()
    tc.model(PATH)
