"""Byte-level BPE with vectorised pre-tokenisation.

Each text becomes an array of codepoint classes. A small automaton over the classes knows where the pre-tokeniser's
pattern cuts; each class is a function from states to states, and functions compose, so one associative scan gives the
state before every codepoint of a whole batch at once. Slices between cuts are deduplicated, each distinct slice is
merged once (and cached), and the ids of all slices are gathered by their dictionary index.

A null text is empty, an empty text has no ids, equal texts get equal ids, rows of equal doc_id are all kept. Empty
table: empty result. Columns other than doc_id and text (or ids) are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_BYTES, by_bytes, documents, flat, pieces

# Classes of codepoints: space, other white space, number, letter; the letters of contractions; the rest; apostrophe.
SP, WS, NUM, LET, ONE, RV, EE, EL, REST, APO, END = range(11)
# States: a token ended; in letters; in numbers; in the rest; at an apostrophe that begins a token; after a space;
# after other white space; after such an apostrophe and r or v; after it and l.
FRESH, IN_L, IN_N, IN_R, AT_A, AFTER_SP, AFTER_WS, AT_RV, AT_EL = range(9)
LETTERS = (LET, ONE, RV, EE, EL)
#: Distinct slices whose ids a task keeps.
CACHE = 400_000
#: Bytes from which a slice is merged alone, through a heap.
LONG = 200
NONE = np.uint64(1 << 40)


@functools.cache
def codepoint_classes() -> np.ndarray:
    table = np.full(0x110000, REST, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = LET if kind == "L" else NUM
    #: The white space of the Unicode standard.
    for a, b in ((0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[a : b + 1] = WS
    table[0x20] = SP
    table[0x27] = APO
    for letters, kind in (("stmd", ONE), ("rv", RV), ("e", EE), ("l", EL)):
        for x in letters:
            table[ord(x)] = kind
    return table


def step(state: int, kind: int) -> int:
    if kind in (SP, WS, NUM, REST):
        return {SP: AFTER_SP, WS: AFTER_WS, NUM: IN_N, REST: IN_R}[kind]
    if kind == APO:
        return IN_R if state in (IN_R, AT_A, AFTER_SP) else AT_A
    if state == AT_A:
        return {ONE: FRESH, RV: AT_RV, EL: AT_EL}.get(kind, IN_L)
    return FRESH if (state, kind) in ((AT_RV, EE), (AT_EL, EL)) else IN_L


def cut_before(state: int, kind: int, following: int) -> bool:
    if state == FRESH:
        return True
    if kind in (SP, WS):
        return following not in (SP, WS, END) if state in (AFTER_SP, AFTER_WS) else True
    if state == AFTER_SP:
        return False
    if kind == NUM:
        return state != IN_N
    if kind in (REST, APO):
        return state not in (IN_R, AT_A)
    if state == AT_A:
        return not (kind == ONE or (kind == RV and following == EE) or (kind == EL and following == EL))
    return state not in (IN_L, AT_RV, AT_EL)


@functools.cache
def scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that classes and their compositions make: function of a class (a row's first codepoint in the
    second half), composition, the state where it is constant (else 255); and cuts by state, class and next class."""
    states = range(9)
    basic = [tuple(step(s, k) for s in states) for k in range(10)]
    basic += [(f[FRESH],) * 9 for f in basic]
    known = list(dict.fromkeys(basic))
    place = {f: i for i, f in enumerate(known)}
    for f in known:
        for g in list(dict.fromkeys(basic)):
            h = tuple(g[x] for x in f)
            if h not in place:
                place[h] = len(known)
                known.append(h)
    compose = np.array([[place[tuple(g[x] for x in f)] for g in known] for f in known], dtype=np.uint8)
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in known], dtype=np.uint8)
    cuts = np.array([[[cut_before(s, k, n) for n in range(11)] for k in range(10)] for s in states])
    return np.array([place[f] for f in basic], dtype=np.uint8), compose, constant, cuts


def pre_tokens(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Byte offsets at which the slices of all rows begin; data holds whole UTF-8 texts, rows their offsets."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    of_class, compose, constant, cuts = scan_tables()
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where codepoints begin
    kind = codepoint_classes()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    first = np.zeros(len(at), dtype=bool)
    first[np.searchsorted(at, rows[:-1][rows[:-1] < rows[1:]])] = True
    scan = of_class[kind + 10 * first]
    reach = 1
    while len(left := np.flatnonzero(constant[scan] == 255)):  # each round doubles what a function covers
        scan[left] = compose[scan[left - reach], scan[left]]
        reach *= 2
    before = np.empty(len(at), dtype=np.uint8)
    before[0], before[1:] = FRESH, constant[scan[:-1]]
    before[first] = FRESH
    following = np.empty(len(at), dtype=np.uint8)
    following[:-1], following[-1] = kind[1:], END
    following[np.flatnonzero(first)[1:] - 1] = END
    return at[cuts[before, kind, following]]


class PairTable:
    """Pairs of ids and what they merge to, in open addressing, for lookups of whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        left_keys, left = np.fromiter(pairs, dtype=np.uint64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.uint64, count=len(pairs))
        self.bits = max(16, int(len(pairs)).bit_length() + 3)
        self.keys, self.values = np.full(1 << self.bits, 2**64 - 1, dtype=np.uint64), np.full(1 << self.bits, NONE)
        self.probes = 0
        while len(left_keys):
            slot = self._slot(left_keys, self.probes)
            free = np.flatnonzero(self.keys[slot] == 2**64 - 1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = left_keys[put], left[put]
            left_keys, left = np.delete(left_keys, put), np.delete(left, put)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)) + np.uint64(probe) & np.uint64((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        out, there = self.values[slot], self.keys[slot]
        left = np.flatnonzero(there != keys)
        out[left] = NONE
        for probe in range(1, self.probes):
            left = left[self.keys[self._slot(keys[left], probe - 1)] != 2**64 - 1]  # behind a free slot there is nothing
            slot = self._slot(keys[left], probe)
            hit = self.keys[slot] == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


@dataclass
class Encoded:
    """ids of all rows; tokens: each row's first id (one more at the end); slices: byte offsets of the pre-tokens; slice_ids: each slice's first id."""

    ids: np.ndarray
    tokens: np.ndarray
    slices: np.ndarray
    slice_ids: np.ndarray


class ByteBPE:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        size = by_rank[-1][1] + 1
        table = [b""] * size
        for token, rank in by_rank:
            table[rank] = token
        self.table = pa.array(table, pa.large_binary())
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        #: What two neighbouring tokens merge to: the rank is also the id.
        self.pairs = {a << 32 | b: rank for token, rank in by_rank for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None}
        self.lookup = PairTable(self.pairs)
        self._forget()

    def _forget(self) -> None:
        """Cached slices: their place among the sizes, and the ids of all, one slice after another."""
        self.cache: dict[bytes, int] = {}
        self.ids, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def merge_all(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct slices and how many each has. Slices of usual length are merged together: each round joins, in every slice that still has one, the pair of the lowest rank that stands first."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # slots, sizes, ids

        def finish(slots: list[int], lists: list[list[int]]) -> None:
            done.append((np.array(slots, dtype=np.int64), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)), np.array([x for ids in lists for x in ids], dtype=np.uint64)))

        whole = list(map(self.ranks.get, found))
        finish(slots := [i for i, x in enumerate(whole) if x is not None], [[whole[i]] for i in slots])
        finish(slots := [i for i, x in enumerate(whole) if x is None and len(found[i]) > LONG], [self._long([self.single[x] for x in found[i]]) for i in slots])
        short = [i for i, x in enumerate(whole) if x is None and len(found[i]) <= LONG]
        slots, size = np.array(short, dtype=np.int64), np.fromiter((len(found[i]) for i in short), dtype=np.int64, count=len(short))
        ids = np.array(self.single, dtype=np.uint64)[np.frombuffer(b"".join(found[i] for i in short), dtype=np.uint8)]
        rank = np.full(len(ids), NONE, dtype=np.uint64)
        rank[:-1] = self.lookup.get(ids[:-1] << np.uint64(32) | ids[1:])
        rank[np.cumsum(size) - 1] = NONE
        while len(slots):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            if over.any():
                out = np.repeat(over, size)
                done.append((slots[over], size[over], ids[out]))
                ids, rank, size, slots, best = ids[~out], rank[~out], size[~over], slots[~over], best[~over]
                starts = np.cumsum(size) - size
                if not len(slots):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            at = hit[np.searchsorted(hit, starts)]  # in each slice the first pair of its best rank
            ids[at] = best
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, rank, size = ids[keep], rank[keep], size - 1
            at, starts = at - np.arange(len(at)), np.cumsum(size) - size
            last = at == starts + size - 1
            rank[at[last]] = NONE
            for i in (at[~last], at[at > starts] - 1):
                rank[i] = self.lookup.get(ids[i] << np.uint64(32) | ids[i + 1])
        slots, size, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(slots, kind="stable")
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), pa.array(ids.astype(np.int32)))
        return lists.take(pa.array(order)).flatten().to_numpy(), size[order]

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges with a heap over a linked list: n log n for slices of any length."""
        get, n = self.pairs.get, len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                ahead[after[i]] = i
            for left, right in ((ahead[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def encode(self, texts: pa.Array) -> Encoded:
        data, rows = flat(texts)
        starts = pre_tokens(data, rows)
        column = pieces(data, starts, len(data)).dictionary_encode()
        distinct, index = column.dictionary.to_pylist(), column.indices.to_numpy(zero_copy_only=False)
        if len(self.cache) > CACHE:
            self._forget()
        if missing := [x for x in distinct if x not in self.cache]:
            self.cache.update(zip(missing, range(len(self.sizes), len(self.sizes) + len(missing)), strict=True))
            ids, size = self.merge_all(missing)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, size])
        place = np.fromiter(map(self.cache.__getitem__, distinct), dtype=np.int64, count=len(distinct))[index] if len(index) else index.astype(np.int64)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(self.sizes)]), pa.array(self.ids))
        ids = lists.take(pa.array(place)).flatten().to_numpy() if len(index) else np.zeros(0, dtype=np.int32)
        slice_ids = np.zeros(len(index) + 1, dtype=np.int64)
        np.cumsum(self.sizes[place], out=slice_ids[1:])
        return Encoded(ids, slice_ids[np.searchsorted(starts, rows)], starts, slice_ids)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the offset of each (one more at the end)."""
        got = self.table.take(pa.array(ids))
        return flat(got)


@functools.cache
def model(path: str) -> ByteBPE:
    return ByteBPE(path)


@functools.cache
def decimals(size: int) -> pa.Array:
    return pa.array([b"%d," % i for i in range(size)], pa.large_binary())


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id; ids array; ends: for each pre-token the offset in bytes at which it begins, and first_ids: its first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in by_bytes(batches, "text"):
            got = bpe.encode(batch.column("text"))
            _, rows = flat(batch.column("text"))
            cut = np.searchsorted(got.slices, rows)
            row_of = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(got.tokens, got.ids, pa.int32()), lists(cut, got.slices - rows[row_of], pa.int64()), lists(cut, got.slice_ids[:-1] - got.tokens[row_of], pa.int64())], ["doc_id", "ids", "starts", "first_ids"])

    return df.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, first_ids array<long>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of `ids`; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("ids")
                each = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                data, offsets = bpe.decode(ids.flatten().to_numpy(zero_copy_only=False))
                ends = offsets[np.concatenate([[0], np.cumsum(each)])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pieces(data, ends[:-1], int(ends[-1])).cast(pa.binary())], ["doc_id", "bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(df: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes every text, decodes its ids again, and returns digests of both; also the ids, if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        text_of = decimals(len(bpe.table))
        for batch in by_bytes(batches, "text", BATCH_BYTES // 2):
            got = bpe.encode(batch.column("text"))
            back, back_at = bpe.decode(got.ids)
            listed, listed_at = flat(text_of.take(pa.array(got.ids)))
            cut = lambda data, at: [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            ends = listed_at[got.tokens]
            joined = [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            ids = {"ids": pa.ListArray.from_arrays(pa.array(got.tokens, pa.int32()), pa.array(got.ids, pa.int32()))} if with_ids else {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(got.tokens)), pa.array(joined, pa.string()), pa.array(cut(back, back_at[got.tokens]), pa.string()), *ids.values()], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *ids])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir, "doc_id", "text"), default_path())
