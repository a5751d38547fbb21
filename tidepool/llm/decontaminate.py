"""Benchmark decontamination with a generalised suffix automaton (operator 10).

The automaton holds all normalised test items. The words of each document stream
through it; the longest match that ends at each word tells whether the last
`window` words occur in an item. Items are dealt in blocks of about BLOCK_WORDS words
(long ones in pieces that overlap by a window). One block is one map stage: its words are
a broadcast of bounded size, from which each worker builds the automaton, and nothing is
shuffled. More blocks take one pass each, of which only hits are written, so a worker
never holds more than one automaton; no item is left out.

Normalising: A-Z become lower case, words are runs of digits, letters a-z and
characters from U+0080. A window is `window` consecutive words of an item; an item
with fewer words, but not none, is one window.

Defined cases: a null text has no words; an item without words has no window; a
null item_id hits words but is not counted as an item; repeated rows of either
table count as they are (an item_id once); empty tables give no rows or no hits;
other columns are ignored by find_overlaps and kept by remove_overlaps.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

WINDOW = 10
#: Words of test items in one automaton, on average, and of one piece of an item, at most:
#: they bound the size of a broadcast.
BLOCK_WORDS, PIECE_WORDS = 200_000, 10_000
#: remove_overlaps drops a document if over this share of its words is hit.
MAX_COVERAGE = 0.5
_WORD_BYTES = frozenset([*range(48, 58), *range(97, 123), *range(128, 256)])
_NORMAL = bytes((y if (y := x + 32 if 65 <= x <= 90 else x) in _WORD_BYTES else 32) for x in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences. items: of each state that the
    streaming needs, the ids of the items that hold its strings."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, tuple[int, set[int]]] = {}
        for item, words in items:
            state = 0
            for word in words:
                state = self.next[state][word]
                if len(words) >= window and self.length[state] >= window:
                    at = self._suffix(state, window)
                    self.items.setdefault(at, set()).add(item)
            if len(words) < window:
                at = self._suffix(state, len(words))
                self.short.setdefault(at, {}).setdefault(len(words), set()).add(item)
        #: the shortest window: shorter matches need no look
        self.least = min([window, *(n for x in self.short.values() for n in x)])

    def _extend(self, last: int, word: bytes) -> int:
        following = self.next[last].get(word)
        if following is not None and self.length[following] == self.length[last] + 1:
            return following
        if following is not None:
            return self._clone(last, word, following)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._clone(at, word, target)
        return new

    def _clone(self, at: int, word: bytes, target: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[target])
        self.link[target] = copy
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _suffix(self, state: int, n: int) -> int:
        """The state of the last n words of a match in state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (start, end exclusive) that windows cover, merged, and the items."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nexts, links, lengths, least, window = self.next, self.link, self.length, self.least, self.window
        state = length = 0
        for i, word in enumerate(words, 1):
            following = nexts[state].get(word)
            while following is None and state:
                state = links[state]
                length = lengths[state]
                following = nexts[state].get(word)
            if following is None:
                length = 0
                continue
            state = following
            length += 1
            if length < least:
                continue
            if length >= window and (hit := self.items.get(self._suffix(state, window))):
                spans.append((i - window, i))
                found |= hit
            if self.short:
                at = state
                while at > 0:
                    for n, hit in self.short.get(at, {}).items():
                        if n <= length:
                            spans.append((i - n, i))
                            found |= hit
                    at = links[at]
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The words of the items (item, words as bytes) in blocks."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, sizes = [], [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                w = words_of(text)
                for at in range(0, max(1, len(w) - window + 1), PIECE_WORDS) if w else ():
                    part = w[at : at + PIECE_WORDS + window - 1]
                    ids.append(item)
                    words.append(b" ".join(part))
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.binary()), pa.array(sizes, pa.int64())], ["item", "words", "n"])

    cut_up = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    cut_up = written(cut_up.mapInArrow(pieces, "item string, words binary, n long"), "items")
    blocks = max(1, -(-(cut_up.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    return [cut_up.where(block == b).select("item", "words") for b in range(blocks)]


_built: dict[int, Automaton] = {}


class Shipped:
    """A block of items as a broadcast; the automaton is built where it is used."""

    def __init__(self, block: DataFrame, window: int) -> None:
        rows = [(r.item, bytes(r.words)) for r in block.collect()]
        self._words, self._window, self._id = block.sparkSession.sparkContext.broadcast(rows), window, uuid.uuid4().int

    def automaton(self) -> Automaton:
        if self._id not in _built:
            _built.clear()  # one at a time
            _built[self._id] = Automaton([(i, w.split()) for i, w in self._words.value], self._window)
        return _built[self._id]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def _found(shipped: Shipped, key: str, all_rows: bool):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shipped.automaton()
        for batch in batches:
            rows, counts, spans, ids = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                own, hit = automaton.stream(words)
                if all_rows or own:
                    rows.append(i)
                    counts.append(len(words))
                    spans.append(_spans(own))
                    ids.append(sorted(x for x in hit if x is not None))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(ids, pa.list_(pa.string()))], [key, "n_words", "spans", "items"])

    return scan


def _hits(rows: DataFrame, blocks: list[Shipped]) -> DataFrame:
    """(n, spans, items) of the rows (n, text) that any block hits; spans not yet merged."""
    out = None
    for shipped in blocks:
        one = written(rows.select("n", "text").mapInArrow(_found(shipped, "n", False), "n long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"), "hits")
        out = one if out is None else out.unionByName(one)
    return written(out.groupBy("n").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits")


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, spans (array of word positions start, end
    exclusive; merged) and items (ids as strings, sorted)."""
    blocks = [Shipped(b, window) for b in item_blocks(items, window)]
    schema = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if len(blocks) == 1:
        return src.mapInArrow(_found(blocks[0], "doc_id", True), schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(words_of(t.as_py())) for t in batch.column("text")]
            spans = [_spans(merged([(x["start"], x["end"]) for x in own or ()])) for own in batch.column("spans").to_pylist()]
            ids = [sorted(own or ()) for own in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    rows = written(src.withColumn("n", F.monotonically_increasing_id()), "rows")
    return rows.join(_hits(rows, blocks).hint("shuffle_hash"), "n", "left").mapInArrow(merge, schema)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without these words and what is between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def cut(text: bytes, automaton: Automaton, max_coverage: float = MAX_COVERAGE) -> bytes | None:
    """text without its hit spans, until none is left; None if over max_coverage of
    the words are hit."""
    total, lost = None, 0
    while True:
        words = words_of(text)
        total = len(words) if total is None else total
        spans = automaton.stream(words)[0]
        if not spans:
            return text
        lost += sum(b - a for a, b in spans)
        if lost > max_coverage * total:
            return None
        text = without(text, spans)


def _replaced(batch: pa.RecordBatch, names: list[str], new: list[str | None], stay: list[bool]) -> pa.RecordBatch:
    """The batch with new texts, and n_chars set where a text changed."""
    columns, at = list(batch.columns), names.index("text")
    old = columns[at].to_pylist()
    columns[at] = pa.array(new, batch.schema.field(at).type)
    if "n_chars" in names:
        k = names.index("n_chars")
        columns[k] = pa.array([n if x == y or y is None else len(y) for n, x, y in zip(columns[k].to_pylist(), old, new)], columns[k].type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stay, pa.bool_()))


def remove_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs (all columns) with the spans of test items cut from text, n_chars set
    to the new length where a text changed and the column exists, and documents
    hit in over max_coverage of their words left out."""
    blocks = [Shipped(b, window) for b in item_blocks(items, window)]
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = blocks[0].automaton()
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            kept = [x if x is None else cut(x.encode(), automaton, max_coverage) for x in texts]
            yield _replaced(batch, names, [y.decode() if isinstance(y, bytes) else y for y in kept], [x is None or y is not None for x, y in zip(texts, kept)])

    if len(blocks) == 1:
        return docs.mapInArrow(scan, docs.schema)

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, total, lost in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "total", "lost"))):
                spans = merged([(x["start"], x["end"]) for x in spans])
                total = len(words_of(text)) if total is None else total
                out.append((without(text, spans), total, lost + sum(b - a for a, b in spans)))
            columns = [batch.column("n"), *(pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "text", "total", "lost"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed rows with their new text, if it has changed."""
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column("c_row"))
            old = rows.column(names.index("text")).to_pylist()
            new, lost, total = (batch.column(c).to_pylist() for c in ("c_text", "lost", "total"))
            stay = [n is None or n <= max_coverage * t for n, t in zip(lost, total)]
            yield _replaced(rows, names, [x if y is None else y.decode() for x, y in zip(old, new)], stay)

    # rounds over all blocks, until none hits; documents beyond max_coverage take no part
    rows = written(docs.select(F.struct("*").alias("c_row"), F.monotonically_increasing_id().alias("c_n")), "rows")
    state = rows.select(F.col("c_n").alias("n"), F.col("c_row")["text"].cast("binary").alias("text"), F.lit(None).cast("long").alias("total"), F.lit(0).cast("long").alias("lost"))
    changed = None
    while True:
        hits = _hits(state, blocks)
        if not hits.limit(1).count():
            break
        met = state.join(hits.hint("shuffle_hash"), "n")
        state = written(met.select("n", "text", "spans", "total", "lost").mapInArrow(shorter, "n long, text binary, total long, lost long"), "shorter")
        changed = state if changed is None else changed.hint("merge").join(state.select("n").hint("merge"), "n", "left_anti").unionByName(state)
        state = state.where(F.col("lost") <= max_coverage * F.col("total"))
    if changed is None:
        return docs
    final = changed.select(F.col("n").alias("c_m"), F.col("text").alias("c_text"), "lost", "total")
    joined = rows.join(final.hint("shuffle_hash"), F.col("c_n") == F.col("c_m"), "left").select("c_row", "c_text", "lost", "total")
    return joined.mapInArrow(put, docs.schema)


def digest(ids: list) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find_overlaps(docs, items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
