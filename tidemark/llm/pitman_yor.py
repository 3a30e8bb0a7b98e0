"""Language-model scoring with a hierarchical Pitman-Yor model of words in the context of the two words before.

Every pair of words is a context with a restaurant of its own, in which the words that follow are dishes and tokens are
customers. Its parent is the restaurant of its second word, in which each table of a child is a customer; the parent of
these is one root restaurant, and the root's is uniform over the known words and one unknown. Seats are sampled by
Gibbs: dish by dish, all customers of a dish are removed and seated anew given all else (`seating.py`: the conditional of
the number of tables, whatever the number of customers), in sweeps over the contexts of two words, then of one, then the
root. SWEEPS sweeps are burnt in, then SAMPLES seatings are kept, and the predictive probabilities of a text's tokens are
averaged over them. Discounts come from the counts of counts of each level; strengths are STRENGTH.

How it runs: texts are encoded once, in blocks of bounded size. Words get whole numbers, the frequent small ones, with one
exchange of each block's dictionary. A block sends its distinct triples, sorted and packed, to buckets: all triples that
end in the same two words meet in one bucket, and so do those of a middle word, unless it is so frequent that it is split
by last words. A bucket merges its triples once, is written, and holds the restaurants of its two lower levels; sweeps
run inside buckets. Between rounds of sweeps, sums of tables are exchanged: for each word to the root, and for contexts of
split words (whose customers several buckets hold) to their totals. Within a round a bucket sees what other buckets hold
as it was when the round began, and a half of its dishes sees the other half as drawn before; so sweeps are parallel, not
strictly one customer after the other. Random numbers are hashes of the dish, level and sweep: a lost task draws the same
seats again. In the end a bucket answers each block's triples in the order it was asked, with no keys.

Messages between a block and a bucket carry thousands of triples each, as a bucket takes about BUCKET_KEYS tokens and
buckets are as many as that needs. No vocabulary meets in one task, and the driver sees a few totals. Words are told
apart by 64-bit hashes. A dish of one pair of words has at most a row for each word before it, so no bucket holds more of
a hot pair than the vocabulary.

Tokens of a text: the words `[^\\x20\\x09-\\x0D]+`, lower-cased (A-Z), then one end. A null or empty text has the end
alone. Rows of equal doc_id are all kept, each counts. Without training rows all probabilities are uniform. Empty table:
empty result. Columns other than doc_id, held and text are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import seating
from tidemark.llm.common import bucketed, by_bytes, documents, flat, remainder, words, written

#: Bytes of text in a block, and of those that are split into words at once; tokens of a bucket, about.
BLOCK_BYTES, PART_BYTES, BUCKET_KEYS = 8 << 20, 2 << 20, 1 << 20
#: Sweeps before the first seating is kept, and seatings kept.
SWEEPS, SAMPLES = 2, 2
STRENGTH = 1.0
END, START = np.uint64(0x45), np.uint64(0x53)
#: Answers are logarithms to base 10, in these parts.
PARTS = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, as many bytes as the largest has, compressed: the high bytes, mostly zero, lie together."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    data = b"".join((values >> 8 * k).astype(np.uint8).tobytes() for k in range(wide))
    return bytes([wide]) + len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def from_planes(data: bytes) -> np.ndarray:
    wide, size = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[9:], size, asbytes=True), dtype=np.uint8).reshape(wide, -1)
    out = raw[0].astype(np.int64)
    for k in range(1, wide):
        out |= raw[k].astype(np.int64) << 8 * k
    return out


def hashes_of(names: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings: eight bytes after eight are mixed in, of all strings at once."""
    data, ends = flat(names)
    start, size = ends[:-1], np.diff(ends)
    out = mixed(size.astype(np.uint64) + np.uint64(7))
    lanes = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, dtype=np.uint8)), 8)
    left, at = np.arange(len(size)), 0
    while len(left := left[size[left] > at]):
        eight = lanes[start[left] + at].view("<u8")[:, 0]
        short = np.minimum(size[left] - at, 8).astype(np.uint64)
        eight = eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
        out[left] = mixed(out[left] ^ eight)
        at += 8
    return out


BLOCK_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens long, hashes binary, ids binary"


def encode_block(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    """Rows of doc_id, held and text as one row: documents, tokens of each, word hashes, and all tokens as places among them."""
    parts, counts = [], []
    for batch in batches:
        found, rows = words(batch.column("text"))
        parts.append(found.dictionary_encode())
        counts.append(np.diff(rows))
    column = pa.chunked_array(parts, parts[0].type).unify_dictionaries()
    names = column.chunk(column.num_chunks - 1).dictionary  # the whole of it is in the last one
    index = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in column.chunks])
    count = np.concatenate(counts)
    order = np.argsort(-np.bincount(index, minlength=len(names)), kind="stable")  # frequent words get small numbers
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32) + 2
    ids = np.ones(len(index) + len(count), dtype=np.int32)  # 0 is the start, 1 the end
    inside = np.ones(len(ids), dtype=bool)
    inside[np.cumsum(count + 1) - 1] = False
    ids[inside] = place[index]
    hashes = np.concatenate([np.array([START, END]), hashes_of(names)[order]])
    table = pa.Table.from_batches([b.select(["doc_id", "held"]) for b in batches]).combine_chunks()
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), *(whole(table.column(c).chunk(0)) for c in ("doc_id", "held")), whole(pa.array(count + 1, pa.int32())), pa.array([len(ids)], pa.int64()), pa.array([hashes.tobytes()], pa.binary()), pa.array([planes(ids)], pa.binary())],
        ["block", "doc_ids", "held", "sizes", "tokens", "hashes", "ids"],
    )


def encoded(df: DataFrame) -> DataFrame:
    """A row for each block of rows of doc_id, held and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0
        for batch in by_bytes(batches, "text", PART_BYTES):
            waiting.append(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield encode_block(waiting, number)
                waiting, size, number = [], 0, number + 1
        if waiting:
            yield encode_block(waiting, number)

    return bucketed(df.select("doc_id", "held", "text").mapInArrow(run, BLOCK_SCHEMA), "lm-blocks", "block")


#: kind: what a row is about; place: the bucket or block it goes to; sender: the block or bucket it comes from.
ROW = "kind int, place int, sender long, data array<binary>"
ROW_TYPES = {"kind": pa.int32(), "place": pa.int32(), "sender": pa.int64(), "data": pa.list_(pa.binary())}
WORDS, TRIPLES, SEATS, SUMS, TOTALS = 0, 1, 2, 3, 4


def rows_of(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(ROW_TYPES.values())], names=list(ROW_TYPES))


def dealt(kind: int, at: np.ndarray, places: int, sender: int, numbers: list[np.ndarray], raw: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple]]:
    """The order in which numbers are dealt out to places, and a row for each place that gets any. raw: 64-bit hashes sent along as they are."""
    order = np.argsort(small(at), kind="stable")
    cut = np.searchsorted(at[order], np.arange(places + 1))
    rows = []
    for k in range(places):
        if cut[k] < cut[k + 1]:
            part = order[cut[k] : cut[k + 1]]
            rows.append((kind, k, sender, ([raw[part].tobytes()] if raw is not None else []) + [planes(x[part]) for x in numbers]))
    return order, rows


def by_sender(table: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: (r["sender"], r["place"]))


def joined(rows: list[dict], column: int) -> np.ndarray:
    return np.concatenate([from_planes(r["data"][column]) for r in rows])


@dataclass
class Block:
    """What the tokens of a block give, the same each time."""

    number: int
    doc_ids: pa.Array
    held: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        return cls(row["block"], row["doc_ids"], np.array(row["held"], dtype=bool), np.array(row["sizes"], dtype=np.int64), np.frombuffer(row["hashes"], dtype=np.uint64), from_planes(row["ids"]))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training tokens, and how often a word is the one before a token, for each word of the dictionary."""
        trained = np.repeat(~self.held, self.sizes)
        uses = np.bincount(self.ids, minlength=len(self.hashes))
        uses[0] = len(self.sizes)
        return np.bincount(self.ids[trained], minlength=len(self.hashes)), uses

    def word_places(self, places: int) -> np.ndarray:
        return (mixed(self.hashes) % np.uint64(places)).astype(np.int64)

    def triples(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Dictionary places a, b and w of the distinct triples, in the order of the words' ranks for b, w, a; training count of each, and each token's triple."""
        first = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[first] = 0
        earlier = np.empty_like(before)
        earlier[1:] = before[:-1]
        earlier[first] = 0
        order, new, at = sorted_runs(rank[before], rank[self.ids], rank[earlier])
        head = order[new]
        count = np.bincount(at[np.repeat(~self.held, self.sizes)], minlength=len(head))
        return earlier[head], before[head], self.ids[head], count, at


def order_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by all columns, the first one first, and where a new row of values begins in it: by one key, where they fit into 64 bits together."""
    size = [int(x.max()) + 1 if len(x) else 1 for x in columns]
    if math.prod(size) >= 1 << 64:  # fewer values in their own order
        columns = tuple(np.searchsorted(np.unique(x), x) for x in columns)
        size = [int(x.max()) + 1 for x in columns]
        if math.prod(size) >= 1 << 64:
            order = np.lexsort(columns[::-1])
            return order, runs(*(x[order] for x in columns))
    key = np.zeros(len(columns[0]), dtype=np.uint64)
    for x, n in zip(columns, size, strict=True):
        key *= np.uint64(n)
        key += x.astype(np.uint64)
    order = np.argsort(key)
    return order, runs(key[order])


def small(places: np.ndarray) -> np.ndarray:
    """Numbers of few places in the narrowest kind, which sorts fastest."""
    return places.astype(np.uint16) if not len(places) or places.max() < 1 << 16 else places


def sorted_runs(b: np.ndarray, w: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by b, w, a; where a new triple begins in it; and the number of each row's triple."""
    order, new = order_of(b, w, a)
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return order, new, at


def bucket_of(b: np.ndarray, w: np.ndarray, splits: np.ndarray, places: int) -> np.ndarray:
    part = mixed(w.astype(np.uint64)) % splits.astype(np.uint64)
    return (mixed(mixed(b.astype(np.uint64)) + part) % np.uint64(places)).astype(np.int64)


def splits_of(uses: np.ndarray) -> np.ndarray:
    """Parts of a word's contexts: one, unless the word is used more often than a bucket should hold."""
    return np.maximum(1, -(-uses // BUCKET_KEYS))


def numbered(table: pa.Table, places: int) -> pa.Table:
    """Numbers the words of a place, frequent ones first, and answers each block: number, training tokens, uses, in the order it has asked."""
    rows = by_sender(table, WORDS)
    keys = [np.frombuffer(r["data"][0], dtype=np.uint64) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    train, uses = (np.bincount(at, weights=joined(rows, k), minlength=len(distinct)).astype(np.int64) for k in (1, 2))
    number = np.empty(len(distinct), dtype=np.int64)
    number[np.lexsort((distinct, -uses))] = np.arange(len(distinct))
    number = number * places + rows[0]["place"]
    out = [(TOTALS, -1, rows[0]["place"], [planes(np.array([int((train > 0).sum()), int(train.sum())]))])]
    for r, own in zip(rows, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        out.append((WORDS, r["place"], r["sender"], [planes(x[own]) for x in (number, train, uses)]))
    return rows_of(out)


def known(block: Block, rows: list[dict], places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, training tokens and uses of a block's words, from the answers of all places."""
    order = np.argsort(small(block.word_places(places)), kind="stable")
    rows = sorted((r for r in rows if r["kind"] == WORDS), key=lambda r: r["place"])
    out = []
    for k in range(3):
        x = np.empty(len(order), dtype=np.int64)
        x[order] = joined(rows, k)
        out.append(x)
    return tuple(out)


@dataclass
class Asked:
    """What a block asks the buckets, the same each time: its triples by the numbers of their words, in order of bucket, then b, w, a."""

    a: np.ndarray
    b: np.ndarray
    w: np.ndarray
    count: np.ndarray
    uses: np.ndarray
    cuts: np.ndarray
    #: Each token's triple.
    at: np.ndarray

    @classmethod
    def of(cls, block: Block, number: np.ndarray, uses: np.ndarray, places: int) -> Asked:
        rank = np.empty(len(number), dtype=np.int64)
        rank[np.argsort(number)] = np.arange(len(number))
        a, b, w, count, at = block.triples(rank)
        bucket = bucket_of(number[b], number[w], splits_of(uses[b]), places)
        order = np.argsort(small(bucket), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return cls(number[a[order]], number[b[order]], number[w[order]], count[order], uses[b[order]], np.searchsorted(bucket[order], np.arange(places + 1)), place[at])

    def rows(self, sender: int) -> list[tuple]:
        out = []
        for k, (i, j) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            if i < j:
                a, b, w = self.a[i:j], self.b[i:j], self.w[i:j]
                out.append((TRIPLES, k, sender, [*packed(a, b, w), planes(self.uses[i:j][runs(b)]), planes(self.count[i:j])]))
        return out


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def steps(values: np.ndarray, restart: np.ndarray) -> np.ndarray:
    """Differences from the value before; the value itself where a run begins."""
    out = values.copy()
    out[1:] = np.where(restart[1:], values[1:], values[1:] - values[:-1])
    return out


def sums(steps_: np.ndarray, restart: np.ndarray) -> np.ndarray:
    """The inverse of steps."""
    total = np.cumsum(steps_)
    first = np.flatnonzero(restart)
    return total - (total[first] - steps_[first])[np.cumsum(restart) - 1]


def packed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[bytes]:
    """Triples in order of b, w, a."""
    new_b, new_w = runs(b), runs(b, w)
    return [planes(steps(b, np.zeros(len(b), dtype=bool))), planes(steps(w, new_b)), planes(steps(a, new_w))]


def unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, w, and the uses of b."""
    b = np.cumsum(from_planes(data[0]))
    new = runs(b)
    w = sums(from_planes(data[1]), new)
    return sums(from_planes(data[2]), runs(b, w)), b, w, from_planes(data[3])[np.cumsum(new) - 1]


@dataclass
class Model:
    """The fixed numbers: words known, training tokens, buckets, and discounts of the levels of two words, one, none."""

    types: int
    tokens: int
    places: int
    discounts: tuple[float, float, float | None] = (0.5, 0.5, 0.5)

    @property
    def base(self) -> float:
        return 1 / (self.types + 1)


def discount(ones: int, twos: int) -> float:
    return (ones + 0.5) / (ones + 2 * twos + 1)


class Bucket:
    """The restaurants of a bucket: its triples, dishes of the contexts of two words; and the pairs that end them, dishes of the contexts of one."""

    def __init__(self, number: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, uses: np.ndarray, count: np.ndarray):
        self.number, self.a, self.b, self.w, self.count = number, a, b, w, count
        self.pair = np.cumsum(runs(b, w)) - 1
        first = np.flatnonzero(runs(b, w))
        self.pair_b, self.pair_w = b[first], w[first]
        self.lower = np.cumsum(runs(self.pair_b)) - 1  # the restaurant of a pair's first word
        first_b = np.flatnonzero(runs(self.pair_b))
        self.lower_b, self.split = self.pair_b[first_b], uses[first[first_b]] > BUCKET_KEYS
        order, new = order_of(self.lower[self.pair], a)
        self.upper = np.empty(len(a), dtype=np.int64)  # the restaurant of a triple's first two words
        self.upper[order] = np.cumsum(new) - 1
        head = order[new]
        self.upper_a, self.upper_b = a[head], b[head]
        # Dishes that can have more than one customer: of others the seats are known.
        self.many = np.flatnonzero(count > 1)
        self.pair_many = np.flatnonzero(np.bincount(self.pair, weights=count) > 1)
        number_of = lambda x, at: x[at].astype(np.uint64)
        self.seed = mixed(mixed(mixed(number_of(a, self.many)) + number_of(b, self.many)) + number_of(w, self.many))
        self.pair_seed = mixed(mixed(number_of(self.pair_b, self.pair_many)) + number_of(self.pair_w, self.pair_many))
        self.shared_upper, self.shared_lower = np.flatnonzero(self.split[self.lower[self.pair[head]]]), np.flatnonzero(self.split)
        self.words, self.word_of = np.unique(self.pair_w, return_inverse=True)

    def first_seats(self) -> tuple[np.ndarray, np.ndarray]:
        tables = np.minimum(self.count, 1)
        return tables, np.minimum(self.pair_customers(tables), 1)

    def pair_customers(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair, weights=tables, minlength=len(self.pair_b)).astype(np.int64)

    def per_upper(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.upper, weights=x, minlength=len(self.upper_a)).astype(np.int64)

    def per_lower(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.lower, weights=x, minlength=len(self.lower_b)).astype(np.int64)

    def reports(self, seatings: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """Keys and numbers of what is summed over buckets: tables of each word for the root; customers and tables of shared restaurants, of two words and of one."""
        word, upper, lower = [], [self.per_upper(self.count)[self.shared_upper]], []
        for tables, pair_tables in seatings:
            word.append(np.bincount(self.word_of, weights=pair_tables, minlength=len(self.words)).astype(np.int64))
            upper.append(self.per_upper(tables)[self.shared_upper])
            lower += [self.per_lower(self.pair_customers(tables))[self.shared_lower], self.per_lower(pair_tables)[self.shared_lower]]
        two = mixed(mixed(self.upper_b[self.shared_upper].astype(np.uint64)) ^ self.upper_a[self.shared_upper].astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        one = mixed(self.lower_b[self.shared_lower].astype(np.uint64)) & ~np.uint64(1)
        return [(self.words.astype(np.uint64), word), (two, upper), (one, lower)]

    def asks(self, seatings: list[tuple[np.ndarray, np.ndarray]], places: int) -> list[tuple]:
        out = []
        for k, (keys, numbers) in enumerate(self.reports(seatings)):
            if len(keys):
                out += dealt(SUMS + 2 * k, (mixed(keys) % np.uint64(places)).astype(np.int64), places, self.number, numbers, keys)[1]
        return out

    def heard(self, rows: list[dict], places: int) -> tuple[list[list[np.ndarray]], np.ndarray]:
        """What summed() has answered to asks(), in its order: numbers of words, of shared restaurants of two words and of one; and the root's totals."""
        out = []
        for k, (keys, _) in enumerate(self.reports([])):
            order = np.argsort(small((mixed(keys) % np.uint64(places)).astype(np.int64)), kind="stable")
            mine = sorted((r for r in rows if r["kind"] == SUMS + 2 * k), key=lambda r: r["place"])
            got = []
            for column in range(len(mine[0]["data"]) - (k == 0) if mine else 0):
                x = np.empty(len(keys), dtype=np.int64)
                x[order] = joined(mine, column)
                got.append(x)
            out.append(got)
        return out, sum(from_planes(r["data"][-1]) for r in rows if r["kind"] == SUMS)

    def states(self, model: Model, rows: list[dict]) -> tuple[list[State], np.ndarray]:
        """The kept seatings with what the other buckets hold, and the root's totals."""
        (words_, upper, lower), root = self.heard(rows, model.places)
        if model.discounts[2] is None:
            model = Model(model.types, model.tokens, model.places, (*model.discounts[:2], discount(*root[-2:].tolist())))
        seats = [from_planes(x) for r in rows if r["kind"] == SEATS for x in r["data"]] or list(self.first_seats())
        none = np.zeros(0, dtype=np.int64)
        out = []
        for s in range(len(seats) // 2):
            shared = (upper[0], upper[1 + s]) if upper else (none, none), (lower[2 * s], lower[2 * s + 1]) if lower else (none, none)
            out.append(State(self, model, seats[2 * s], seats[2 * s + 1], (words_[2 * s], words_[2 * s + 1]), *shared, (int(root[2 * s]), int(root[2 * s + 1]))))
        return out, root


class State:
    """A bucket's seats and what it knows of the others, for one seating."""

    def __init__(self, bucket: Bucket, model: Model, tables: np.ndarray, pair_tables: np.ndarray, word: tuple[np.ndarray, np.ndarray], upper: tuple[np.ndarray, np.ndarray], lower: tuple[np.ndarray, np.ndarray], root: tuple[int, int]):
        self.k, self.model, self.tables, self.pair_tables = bucket, model, tables, pair_tables
        self.word_customers, self.word_tables, self.root = word[0], word[1], root
        # Customers of the pairs; tables of the restaurants of two words, and their customers; customers and tables of those of one.
        self.customers = bucket.pair_customers(tables)
        self.upper_all, self.upper_tables = bucket.per_upper(bucket.count), bucket.per_upper(tables)
        self.lower_all, self.lower_tables = bucket.per_lower(self.customers), bucket.per_lower(pair_tables)
        # Of shared restaurants what all buckets hold.
        for own, everywhere, at in ((self.upper_all, upper[0], bucket.shared_upper), (self.upper_tables, upper[1], bucket.shared_upper), (self.lower_all, lower[0], bucket.shared_lower), (self.lower_tables, lower[1], bucket.shared_lower)):
            own[at] = everywhere
        # The root stays as it was when the round began: with all of a pair's tables among its customers, and without them.
        self.with_own, self.without_own = self.root_share(0)[0], self.root_share(pair_tables)

    def root_share(self, without: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The root's probability of each pair's word without some of its customers; and what its numerator and denominator are but for new customers."""
        k, (customers, tables), d = self.k, self.root, self.model.discounts[2]
        return share(self.word_customers[k.word_of] - without, self.word_tables[k.word_of], customers - without, tables, d, self.model.base)

    def pair_share(self, pair: np.ndarray, without: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, lower = self.customers[pair] - without, self.k.lower[pair]
        # Without any customer left, the pair's own tables are no customers of the root.
        parent = np.where(left > 0, self.with_own[pair], self.without_own[0][pair])
        return share(left, self.pair_tables[pair], self.lower_all[lower] - without, self.lower_tables[lower], self.model.discounts[1], parent)

    def seat_pairs(self, at: np.ndarray, tables: np.ndarray) -> None:
        np.add.at(self.lower_tables, self.k.lower[at], tables - self.pair_tables[at])
        self.pair_tables[at] = tables

    def sweep(self, number: int) -> None:
        """All dishes once: half after half of the triples, then of the pairs."""
        k, (d2, d1, _) = self.k, self.model.discounts
        for half in (0, 1):
            own = (k.seed & np.uint64(1)) == half
            at, seed = k.many[own], k.seed[own]
            if len(at):
                old = self.tables[at]
                new = seating.drawn(k.count[at], self.upper_tables[k.upper[at]] - old, *self.pair_share(k.pair[at], old), d2, STRENGTH, uniform(seed, 2, number))
                moved = np.flatnonzero(new != old)
                at, more = at[moved], (new - old)[moved]
                self.tables[at] += more
                for counts, of in ((self.upper_tables, k.upper[at]), (self.customers, k.pair[at]), (self.lower_all, k.lower[k.pair[at]])):
                    np.add.at(counts, of, more)
        # Where customers have come or gone, a pair keeps one table at least and one for each customer at most.
        kept = np.minimum(np.maximum(self.pair_tables, self.customers > 0), self.customers)
        at = np.flatnonzero(kept != self.pair_tables)
        self.seat_pairs(at, kept[at])
        for half in (0, 1):
            own = ((k.pair_seed & np.uint64(1)) == half) & (self.customers[k.pair_many] > 1)
            at, seed = k.pair_many[own], k.pair_seed[own]
            if len(at):
                first, more, over = (x[at] for x in self.without_own)
                self.seat_pairs(at, seating.drawn(self.customers[at], self.lower_tables[k.lower[at]] - self.pair_tables[at], first, more, over, d1, STRENGTH, uniform(seed, 1, number)))

    def predictive(self) -> np.ndarray:
        """P(w | a, b) of every triple."""
        k, d = self.k, self.model.discounts[0]
        parent = self.pair_share(np.arange(len(k.pair_b)), 0)[0][k.pair]
        return (k.count - d * self.tables + (STRENGTH + d * self.upper_tables[k.upper]) * parent) / (STRENGTH + self.upper_all[k.upper])


def share(customers: np.ndarray, tables: np.ndarray, whole: np.ndarray, all_tables: np.ndarray, discount: float, parent: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A restaurant's probability of a dish; and, for the probability once m more customers have come, (more + m) / (over + m)."""
    now = np.minimum(tables, np.maximum(customers, 0))
    rest = (STRENGTH + discount * (all_tables - tables + now)) * parent
    over = STRENGTH + whole
    first = (np.maximum(customers, 0) - discount * now + rest) / over
    new = now == 0
    more = customers - discount * np.maximum(now, 1) + rest + np.where(new, discount * parent, 0)
    return first, np.maximum(more, -1 + 1e-12), over


def uniform(seed: np.ndarray, level: int, sweep: int) -> np.ndarray:
    return (mixed(seed + mixed(np.full(1, 3 * sweep + level, dtype=np.uint64))) >> np.uint64(11)).astype(float) / (1 << 53)


def merged(table: pa.Table, model: Model) -> pa.Table:
    """The triples of a bucket, each once, with the place of each block's triples among them; the first seats' reports; counts of counts."""
    rows = by_sender(table, TRIPLES)
    parts = [unpacked(r["data"]) for r in rows]
    a, b, w, uses = (np.concatenate([x[i] for x in parts]) for i in range(4))
    # The words before the last are few in a bucket.
    names = np.unique(np.concatenate([x[1][runs(x[1])] for x in parts]))
    order, new, at = sorted_runs(np.searchsorted(names, b), w, a)
    head = order[new]
    a, b, w, uses = a[head], b[head], w[head], uses[head]
    count = np.bincount(at, weights=joined(rows, 4), minlength=len(head)).astype(np.int64)
    number = rows[0]["place"]
    maps = [planes(steps(x, np.arange(len(x)) == 0)) for x in np.split(at, np.cumsum([len(x[0]) for x in parts])[:-1])]
    bucket = Bucket(number, a, b, w, uses, count)
    seats = bucket.first_seats()
    customers = bucket.pair_customers(seats[0])
    ones = [int((x == k).sum()) for x in (count, customers) for k in (1, 2)]
    data = [*packed(a, b, w), planes(uses[runs(b)]), planes(count), planes(np.array([r["sender"] for r in rows])), *maps]
    return rows_of([(TRIPLES, number, number, data), (TOTALS, -1, number, [planes(np.array(ones))]), *bucket.asks([seats], model.places)])


def summed(table: pa.Table, model: Model, sweep: int) -> pa.Table:
    """Sums the reports of all buckets and answers each in the order it has asked; of words, with tables of the root drawn
    for them (one for each word at first), and its totals to every bucket."""
    out, place = [], table.column("place")[0].as_py()
    for k in range(3):
        rows = by_sender(table, SUMS + 2 * k)
        if not rows:
            continue
        keys = [np.frombuffer(r["data"][0], dtype=np.uint64) for r in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        numbers = [np.bincount(at, weights=joined(rows, 1 + i), minlength=len(distinct)).astype(np.int64) for i in range(len(rows[0]["data"]) - 1)]
        last = []
        if k == 0:
            drawn = []
            for i, c in enumerate(numbers):
                none = np.zeros(len(c))
                drawn.append(np.minimum(c, 1) if sweep < 0 else seating.drawn(c, none, none + model.base, None, None, model.discounts[2], STRENGTH, uniform(mixed(distinct), 0, sweep + i)))
            ones = [int((numbers[0] == j).sum()) for j in (1, 2)]
            numbers = [x for both in zip(numbers, drawn, strict=True) for x in both]
            last = [planes(np.array([int(x.sum()) for x in numbers] + ones))]
        asked = {r["sender"]: x for r, x in zip(rows, np.split(at, np.cumsum([len(x) for x in keys])[:-1]), strict=True)}
        for bucket in range(model.places) if k == 0 else asked:
            own = asked.get(bucket, np.zeros(0, dtype=np.int64))
            out.append((SUMS + 2 * k, place, bucket, [planes(x[own]) for x in numbers] + last))
    return rows_of(out)


def opened(row: dict) -> Bucket:
    a, b, w, uses = unpacked(row["data"])
    return Bucket(row["place"], a, b, w, uses, from_planes(row["data"][4]))


def turned(left: pa.Table, right: pa.Table, model: Model, sweep: int, sweeps: int, keep: int) -> pa.Table:
    """A round in a bucket: sweeps, the last `keep` seatings, and their reports."""
    if not left.num_rows:
        return rows_of([])
    bucket = opened(left.to_pylist()[0])
    (state,), root = bucket.states(model, right.to_pylist())
    seats = []
    for k in range(sweeps):
        state.sweep(sweep + k)
        if k >= sweeps - keep:
            seats.append((state.tables.copy(), state.pair_tables.copy()))
    return rows_of([(SEATS, bucket.number, bucket.number, [planes(x) for both in seats for x in both]), (TOTALS, -1, bucket.number, [planes(root[-2:])]), *bucket.asks(seats, model.places)])


def answered(left: pa.Table, right: pa.Table, model: Model) -> pa.Table:
    """Each block's answers from a bucket: -log10 of the mean probability, in parts."""
    if not left.num_rows:
        return rows_of([])
    row = left.to_pylist()[0]
    bucket = opened(row)
    states, _ = bucket.states(model, right.to_pylist())
    parts = np.rint(-np.log10(sum(s.predictive() for s in states) / len(states)) * PARTS).astype(np.int64)
    senders = from_planes(row["data"][5])
    return rows_of([(TRIPLES, bucket.number, int(block), [planes(np.maximum(parts[np.cumsum(from_planes(m))], 0))]) for block, m in zip(senders, row["data"][6:], strict=True)])


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORE_TYPES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def finished(left: pa.Table, right: pa.Table, model: Model) -> pa.Table:
    if not left.num_rows:
        return pa.table([pa.array([], kind) for kind in SCORE_TYPES.values()], names=list(SCORE_TYPES))
    block, rows = Block.read(left.to_pylist()[0]), right.to_pylist()
    number, train, uses = known(block, rows, model.places)
    asked = Asked.of(block, number, uses, model.places)
    logs = joined(sorted((r for r in rows if r["kind"] == TRIPLES), key=lambda r: r["place"]), 0)[asked.at] / -PARTS
    base = np.log10((train + 0.5) / (model.tokens + 0.5 * (model.types + 1)))[block.ids]
    cut = np.cumsum(block.sizes) - block.sizes
    columns = [block.doc_ids, block.held, block.sizes, np.add.reduceat((train[block.ids] > 0).astype(np.int64), cut), np.full(len(cut), model.tokens), np.add.reduceat(base, cut), np.add.reduceat(logs, cut)]
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, SCORE_TYPES.values(), strict=True)], names=list(SCORE_TYPES))


def totals(df: DataFrame) -> list[int]:
    """The sums of what all places say of themselves, a row of a few numbers for each."""
    out = [0, 0, 0, 0]
    for row in df.where(F.col("kind") == TOTALS).select("data").toLocalIterator():
        for i, x in enumerate(from_planes(bytes(row.data[0])).tolist()):
            out[i] += x
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of rows of doc_id, held and text; rows that are held teach nothing."""
    spark = docs.sparkSession
    blocks = encoded(docs)
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_KEYS))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                yield from rows_of(dealt(WORDS, block.word_places(places), places, block.number, list(block.counts()), block.hashes)[1]).to_batches()

    names = written(blocks.mapInArrow(ask_words, ROW).groupBy("place").applyInArrow(lambda t: numbered(t, places), ROW), "lm-words")
    types, seen, *_ = totals(names)
    model = Model(types, seen, places)
    for_blocks = names.where(F.col("kind") == WORDS).withColumnRenamed("sender", "block")

    def ask_triples(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return rows_of([])
        block = Block.read(left.to_pylist()[0])
        number, _, uses = known(block, right.to_pylist(), places)
        return rows_of(Asked.of(block, number, uses, places).rows(block.number))

    triples = blocks.groupBy("block").cogroup(for_blocks.groupBy("block")).applyInArrow(ask_triples, ROW)
    first = bucketed(triples.groupBy("place").applyInArrow(lambda t: merged(t, model), ROW), "lm-buckets", "sender")
    ones = totals(first)
    model = Model(types, seen, places, (discount(*ones[:2]), discount(*ones[2:]), None))
    buckets = first.where(F.col("kind") == TRIPLES)

    def replies(state: DataFrame, model: Model, sweep: int) -> DataFrame:
        """What goes to the buckets after a round: the sums of all reports, and their own seats."""
        sums = state.where(F.col("kind").isin(SUMS, SUMS + 2, SUMS + 4)).groupBy("place").applyInArrow(lambda t: summed(t, model, sweep), ROW)
        return sums.unionByName(state.where(F.col("kind") == SEATS))

    def turn(state: DataFrame, model: Model, drawn: int, sweep: int, sweeps: int, keep: int) -> DataFrame:
        both = buckets.groupBy("sender").cogroup(replies(state, model, drawn).groupBy("sender"))
        return written(both.applyInArrow(lambda a, b: turned(a, b, model, sweep, sweeps, keep), ROW), "lm-round")

    state = turn(first, model, -1, 0, SWEEPS, 1)
    row = state.where(F.col("kind") == TOTALS).select("data").first()
    model = Model(types, seen, places, (*model.discounts[:2], discount(*from_planes(bytes(row.data[0])).tolist()) if row else 0.5))
    state = turn(state, model, SWEEPS - 1, SWEEPS, SAMPLES, SAMPLES)
    last = buckets.groupBy("sender").cogroup(replies(state, model, SWEEPS).groupBy("sender")).applyInArrow(lambda a, b: answered(a, b, model), ROW)
    both = for_blocks.unionByName(last.withColumnRenamed("sender", "block"))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(lambda a, b: finished(a, b, model), SCORE)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity a token of all texts, trained on and held out, under the model and under the base."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(power("score").alias("perplexity"), power("base_score").alias("base_perplexity"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held", remainder(F.col("doc_id")) == 1)
    return score(docs)
