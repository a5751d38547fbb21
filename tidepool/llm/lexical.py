"""Ranked lexical search with an Aho-Corasick scan (operator 12).

The automaton holds the terms of all items, each between boundary symbols, so that a match
in a text, whose other characters all become the boundary symbol, is a whole term. A scan
counts the terms of each document from its text; there is no index of documents. An output
of the automaton is a term number, which maps to the items that hold it, with how often.

Two scans. The first sums up N, L and each term's df: a task adds up its documents, a
shuffle the tasks. The second scores: a task keeps the best `k` documents of each item,
these are merged by rank. Items are dealt in blocks of about BLOCK_TERMS distinct terms (an
item is never cut); only a block's terms, weights and ids are a broadcast, and more blocks
take two scans each. A worker holds one automaton at a time, and scores of CELLS (document,
item) pairs.

Terms are maximal runs of 0-9, A-Z, a-z and characters from U+0080; only A-Z become lower
case. With tf of a term in a document of n terms, m = 100 - 75 + (75 n N) div L and
w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's score is the sum over the item's
terms, repeats included, of w * (10^9 tf div (1000 tf + 8 m)).

Defined cases: a null or empty text has no terms, counts not in N, and an item without
terms gets no rows; only scores above 0 are listed (w of a term in nearly all documents is 0);
ties go to the smaller doc_id, null last; repeated rows of documents count and rank
as they are; equal rows of items are one item, rows with the same item_id and other texts
are items of their own; a null item_id is kept; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import written

K = 10
#: Distinct terms of the items of one block, on average: it bounds a broadcast.
BLOCK_TERMS = 200_000
#: (document, item) scores that a task works out at once.
CELLS = 1 << 21
#: Fixed values of the score.
LENGTH_SHARE, SCALE, TF_UNIT = 75, 1_000_000_000, 1000
_TERM_BYTES = frozenset([*range(48, 58), *range(97, 123), *range(128, 256)])
_NORMAL = bytes((y if (y := x + 32 if 65 <= x <= 90 else x) in _TERM_BYTES else 32) for x in range(256))


def normal(text: bytes | None) -> bytes:
    """The text with every character outside of terms as a blank, and one at each end."""
    return b" " + (text or b"").translate(_NORMAL) + b" "


def length(norm: bytes) -> int:
    """The number of terms of a normalised text."""
    inside = np.frombuffer(norm, np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """(item, terms, counts) of the items that have terms, in blocks."""
    kind = dict(items.dtypes)[id_col]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, counts = [], [], []
            for i, text in enumerate(batch.column("text")):
                own: dict[bytes, int] = {}
                for t in normal(text.as_py()).split():
                    own[t] = own.get(t, 0) + 1
                if own:
                    rows.append(i)
                    terms.append([*own])
                    counts.append([*own.values()])
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows, pa.int64())), pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))], ["item", "terms", "counts"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text")).distinct()
    rows = written(rows.mapInArrow(counted, f"item {kind}, terms array<binary>, counts array<long>"), "items")
    blocks = max(1, -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item", "terms", "counts"), F.lit(blocks))
    return [rows.where(block == b) for b in range(blocks)]


class Block:
    """The terms of a block of items as a broadcast; the automaton is built where it is used."""

    _built: dict[str, ahocorasick.Automaton] = {}

    def __init__(self, rows: DataFrame) -> None:
        found = rows.collect()
        self.items = [r.item for r in found]
        numbers: dict[bytes, int] = {}
        posted: list[list[tuple[int, int]]] = []
        for i, r in enumerate(found):
            for term, n in zip(r.terms, r.counts):
                at = numbers.setdefault(bytes(term), len(numbers))
                if at == len(posted):
                    posted.append([])
                posted[at].append((i, n))
        starts = np.cumsum([0, *map(len, posted)])
        flat = np.array([x for own in posted for x in own], np.int64).reshape(-1, 2)
        self.terms = len(numbers)
        self._shipped, self._id = rows.sparkSession.sparkContext.broadcast(([*numbers], starts, flat[:, 0], flat[:, 1])), uuid.uuid4().hex

    def automaton(self) -> ahocorasick.Automaton:
        if self._id not in self._built:
            self._built.clear()  # one at a time
            out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for at, term in enumerate(self._shipped.value[0]):
                # a byte is one symbol; both boundaries belong to the pattern
                out.add_word(f" {term.decode('latin-1')} ", at)
            out.make_automaton()
            self._built[self._id] = out
        return self._built[self._id]

    def outputs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts by term, and the items and counts of each term's output."""
        return self._shipped.value[1:]


def term_counts(automaton: ahocorasick.Automaton, norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the block's terms in a normalised text, and the tf of each."""
    found = np.fromiter((v for _, v in automaton.iter(norm.decode("latin-1"))), np.int64)
    return np.unique(found, return_counts=True)


def _statistics(block: Block):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton() if block.terms else None
        docs = total = 0
        df = np.zeros(block.terms, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                norm = normal(text.as_py())
                n = length(norm)
                docs, total = docs + (n > 0), total + n
                if n and block.terms:
                    df[term_counts(automaton, norm)[0]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([docs, total, *df[held].tolist()], pa.int64())], ["term", "n"])

    return scan


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each term of the block."""
    sums = {r.term: r.n for r in docs.mapInArrow(_statistics(block), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(t, 0) for t in range(block.terms)], np.int64)


class Best:
    """The best k documents of each item so far."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.least = np.ones(n_items, np.int64)
        self.rows = np.empty((4, 0), np.int64)  # item, score, 1 if the id is null, id

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents x items."""
        bound = self.least
        if len(scores) > self.k:
            bound = np.maximum(bound, np.partition(scores, -self.k, axis=0)[-self.k])
        at, item = np.nonzero(scores >= bound)
        rows = np.hstack([self.rows, np.stack([item, scores[at, item], null[at], ids[at]])])
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, np.arange(rows.shape[1]) - first < self.k]
        full = np.bincount(self.rows[0], minlength=len(self.least)) >= self.k
        last = np.searchsorted(self.rows[0], np.flatnonzero(full), "right") - 1
        self.least[full] = self.rows[1, last]


def _scores(block: Block, n_docs: int, total: int, weights, k: int):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, (starts, items, repeats) = block.automaton(), block.outputs()
        w, width = weights.value, len(block.items)
        best = Best(width, k)
        many = max(1, CELLS // width)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            null, filled = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for begin in range(0, batch.num_rows, many):
                part = range(begin, min(begin + many, batch.num_rows))
                scores = np.zeros((len(part), width), np.int64)
                for row, at in enumerate(part):
                    norm = normal(texts[at].as_py())
                    terms, tf = term_counts(automaton, norm)
                    if not len(terms):
                        continue
                    m = 100 - LENGTH_SHARE + LENGTH_SHARE * length(norm) * n_docs // total
                    gain = w[terms] * (SCALE * tf // (TF_UNIT * tf + 8 * m))
                    held = starts[terms + 1] - starts[terms]
                    place = np.repeat(starts[terms] - (np.cumsum(held) - held), held) + np.arange(held.sum())
                    np.add.at(scores[row], items[place], repeats[place] * np.repeat(gain, held))
                own = slice(begin, begin + len(part))
                best.add(scores, null[own].astype(np.int64), filled[own])
        item, score, gone, doc = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=gone.astype(bool))], ["n", "score", "doc_id"])

    return scan


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind, out = dict(items.dtypes)["item_id"], None
    for rows in item_blocks(items):
        block = Block(rows)
        n_docs, total, df = statistics(src.select("text"), block)
        weights = spark.sparkContext.broadcast(np.array([weight(n_docs, int(x)) for x in df], np.int64))
        names = spark.createDataFrame([*enumerate(block.items)], f"n long, item_id {kind}")
        if not block.items:
            found = names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.col("n").alias("score"))
        else:
            best = src.mapInArrow(_scores(block, n_docs, total, weights, k), "n long, score long, doc_id long")
            order = Window.partitionBy("n").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            # the names of a block are bounded by its terms
            found = best.join(F.broadcast(names), "n").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
