"""Token counts by a SentencePiece model.

No piece of the model holds a white-space mark behind another character, so no merge ever crosses a space that follows
something else: there a text may be cut, and the counts of its parts add up to the count of the whole. The mark that
the library puts before each text takes the place of the space that the cut removed. Parts are deduplicated per batch,
each distinct part is encoded once, and only lengths leave the task. A model without this property is refused.

A null or empty text has no tokens; rows of equal doc_id are all kept, equal texts have equal counts. Empty table: empty
result. Columns other than doc_id and the text are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, documents, flat, lengths, pieces

LIMIT = 4096
#: The white-space mark of the library.
MARK = "▁"
#: Random texts that a model is tried on, and what they are made of.
PROBES, PROBE = 400, "  \t\n\u00a0\u3000▁aabetTé中🙂.,'-<s>019"
#: Parts whose counts a task keeps.
CACHE = 1_000_000


@functools.cache
def model(path: str):
    import sentencepiece

    got = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(re.search(f"[^{MARK}]{MARK}", got.id_to_piece(i)) for i in range(got.get_piece_size())):
        raise ValueError("a piece holds a white-space mark behind another character; texts can't be cut at spaces")
    if "".join(got.encode("a  b", out_type=str)) != f"{MARK}a{MARK}{MARK}b":
        raise ValueError("the model changes white space; texts can't be cut at spaces")
    # Texts of all that cuts may meet, whole and in parts.
    rng = random.Random(1)
    probes = ["".join(rng.choices(PROBE, k=rng.randint(0, 60))) for _ in range(PROBES)]
    if counted(pa.array(probes), got, {}).tolist() != [len(x) for x in got.encode(probes)]:
        raise ValueError("parts of a text don't add up to the whole with this model")
    return got


@functools.cache
def known(path: str) -> dict[bytes, int]:
    return {}


def safe_parts(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where parts begin, and which of them had a space before it that is cut away. A cut is a space behind something
    that is neither a space nor the mark itself, within one row."""
    space = data == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[:1] = False
    cut[rows[:-1][rows[:-1] < len(data)]] = False
    at = np.flatnonzero(cut)
    mark = np.frombuffer(MARK.encode(), dtype=np.uint8)
    after_mark = at >= 3
    for k in range(3):
        after_mark &= data[np.maximum(at - 3 + k, 0)] == mark[k]
    return at[~after_mark], cut


def count(texts: pa.Array, path: str) -> np.ndarray:
    return counted(texts, model(path), known(path))


def counted(texts: pa.Array, library, cache: dict[bytes, int]) -> np.ndarray:  # noqa: ANN001
    data, rows = flat(texts)
    if not len(data):
        return np.zeros(len(texts), dtype=np.int64)
    at, _ = safe_parts(data, rows)
    filled = rows[:-1][rows[:-1] < rows[1:]]  # rows that hold something
    kept = np.ones(len(data), dtype=bool)
    kept[at] = False
    place = np.cumsum(kept) - kept  # offsets when cut spaces are gone
    first = np.concatenate([filled, at])
    order = np.argsort(first, kind="stable")
    starts, cut = place[first][order], (np.arange(len(first)) >= len(filled))[order]
    column = pieces(data[kept], starts, int(kept.sum())).dictionary_encode()
    index, parts = column.indices.to_numpy(zero_copy_only=False), column.dictionary.to_pylist()
    if len(cache) > CACHE:
        cache.clear()
    missing = [x for x in parts if x not in cache]
    cache.update(zip(missing, map(len, library.encode([x.decode() for x in missing], num_threads=1)), strict=True))
    each = np.fromiter(map(cache.__getitem__, parts), dtype=np.int64, count=len(parts))[index]
    empty = np.diff(np.append(starts, kept.sum())) == 0
    each[empty & cut] = 1  # a space that ends a text: its mark stands alone
    total = np.zeros(len(each) + 1, dtype=np.int64)
    np.cumsum(each, out=total[1:])
    return np.diff(total[np.searchsorted(first[order], rows)])


def token_counts(df: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every whole text. The text itself never leaves the task that scans it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            n = count(batch.column("text"), path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths(batch.column("text"))), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
