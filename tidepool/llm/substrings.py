"""Removal of repeated substrings by bucket-pointer refinement (operator 3).

Every byte that is covered by a LENGTH-byte string that starts anywhere else too, in
the same document or another, goes. The method is that of suffix sorting by bucket
pointers: positions start in buckets of equal q-grams; a bucket is refined by the
identifiers of the buckets at later offsets, and what a round has told apart is the key
of the next one, until LENGTH bytes are told apart.

* Identifiers (`pointers`). Level 0 is the bucket of the GRAM bytes at a position; level
  k + 1 is the bucket of the pair (level k here, level k at GRAM * 2^k later), so each
  round reuses the identifiers of the one before, and level 3 tells LENGTH bytes apart.
  A string of any other size is named by two overlapping identifiers. A bucket's name is
  a hash of the pair, not its rank, so every task finds the same one and nothing is
  shuffled to look one up.
* Anchors. Not all suffixes are dealt out. Each LENGTH-byte window has one anchor, the
  position of its least q-gram hash (the last of equals). Equal windows have equal
  anchors at equal offsets, so only anchors need buckets: about one for every 170 bytes.
  An anchor stands for the run of windows whose anchor it is.
* Rounds. Round 0 makes buckets of equal anchors and drops those with one member. In a
  bucket, members whose whole stretch is equal are repeated as a whole, and one of them
  stays to speak for them; only buckets that still differ go on. Their offsets are cut in
  cells of the sizes CELLS; the new bucket is (old bucket, cell, identifier of the bytes
  that all windows of the cell share). At size 1 these bytes are the window itself, and to
  share them is to be repeated.

A round is a count by bucket and joins with the counts, so no bucket, however large, is
gathered anywhere, and no two members are compared. Members are matched on two
independent 64-bit hashes. Texts are known by their hash and size, so copies share ranges.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; repeated
rows are documents of their own, so texts of LENGTH bytes or more go as a whole; null
doc_id is kept; an empty table gives no rows; other columns are ignored. What stays may
not be whole UTF-8; in `text` broken characters are U+FFFD, kept_sha256 has the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

LENGTH = 400
#: Bytes of an anchor, and of the identifiers of level 0.
Q, GRAM = 64, LENGTH // 8
#: Offsets of a cell, round by round.
CELLS = (48, 8, 1)
#: Window starts taken at once: bounds memory, whatever the size of a text.
CHUNK = 1 << 17
#: Members whose bytes are taken at once.
MEMBERS = 512
#: Tasks that the members of one bucket are dealt over.
SALTS = 16
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Two independent numberings of the bytes.
_BYTE, _OTHER = (np.array([xxhash.xxh64_intdigest(bytes([x]), seed) for x in range(256)], np.uint64) for seed in (42, 43))


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])


_pow: list[np.ndarray] = []


def gram_hashes(data: np.ndarray, q: int, numbers: np.ndarray = _BYTE) -> np.ndarray:
    """A hash of the q bytes at each position: polynomial, then mixed."""
    if not _pow:
        n = CHUNK + (1 << 20)
        _pow.extend([_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))])
    n = len(data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(numbers[data] * _pow[0][:n], out=total[1:])
    h = (total[q:] - total[:-q]) * _pow[1][: n - q + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _anchors(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of data the position of its anchor; and the hashes of all positions."""
    h = gram_hashes(data, q)
    low = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    width, span = length - q + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (_PLACE - (low & _PLACE)).astype(np.int64), h


def anchors_of(texts: list[bytes], length: int = LENGTH, q: int = Q) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, hash, anchor, first and last window start) of each run of windows
    with the same anchor. Short texts share a pass; long ones are cut in chunks."""
    group: list[int] = []
    held = 0

    def settle() -> Iterator[tuple[int, int, int, int, int]]:
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        sizes = np.array([len(texts[i]) for i in group])
        first = np.cumsum(sizes) - sizes
        last: tuple[int, int, int, int, int] | None = None
        for at in range(0, len(data) - length + 1, CHUNK):
            part = data[at : at + CHUNK + length - 1]
            anchor, h = _anchors(part, length, q)
            start = at + np.arange(len(anchor))
            owner = np.searchsorted(first, start, "right") - 1
            ok = np.flatnonzero(start + length <= first[owner] + sizes[owner])
            if not len(ok):
                continue
            # a run ends where the anchor changes; anchors lie in their text, so it does not cross texts
            cut = np.flatnonzero(np.diff(anchor[ok])) + 1
            begin, end = np.append(0, cut), np.append(cut, len(ok)) - 1
            a, b = ok[begin], ok[end]
            own, p = owner[a], anchor[a] + at
            for row in zip(own.tolist(), h[anchor[a]].view(np.int64).tolist(), (p - first[own]).tolist(), (a + at - first[own]).tolist(), (b + at - first[own]).tolist()):
                if last is not None and last[0] == row[0] and last[2] == row[2]:
                    last = (*last[:4], row[4])  # the run goes on in the next chunk
                    continue
                if last is not None:
                    yield (group[last[0]], *last[1:])
                last = row
        if last is not None:
            yield (group[last[0]], *last[1:])

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        group.append(i)
        held += len(text)
        if held >= CHUNK:
            yield from settle()
            group, held = [], 0
    if group:
        yield from settle()


def _id(data: bytes, *seed: int) -> int:
    x = xxhash.xxh64_intdigest(data, hash(seed) & ((1 << 64) - 1))
    return x - (1 << 64) if x >= 1 << 63 else x


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts: a row for each anchor."""
    for part in _slices(batches):
        texts = part.column("text").to_pylist()
        keys, dids = part.column("t").to_pylist(), part.column("did").to_pylist()
        rows = list(anchors_of(texts))
        cols = (
            [r[1] for r in rows], [_id(texts[i][lo : hi + LENGTH], p - lo, p - hi) for i, _, p, lo, hi in rows], [keys[r[0]] for r in rows], [len(texts[r[0]]) for r in rows],
            [dids[r[0]] for r in rows], [(p << 20) | ((p - lo) << 10) | (p - hi) for _, _, p, lo, hi in rows],
        )
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "u", "t", "n", "did", "place"])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the pair (a, b)."""
    h = (a ^ (a >> np.uint64(31))) * _MIX + (b ^ (b >> np.uint64(29))) * np.uint64(_BASE)
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def pointers(data: np.ndarray, numbers: np.ndarray = _BYTE) -> list[np.ndarray]:
    """Level k: the bucket of the GRAM * 2^k bytes at each position."""
    levels = [gram_hashes(data, GRAM, numbers)]
    while GRAM << len(levels) <= min(LENGTH, len(data)):
        later = GRAM << (len(levels) - 1)
        levels.append(_pair(levels[-1][:-later], levels[-1][later:]))
    return levels


def _named(levels: list[np.ndarray], at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The name of the `size` bytes at each position, by two identifiers that overlap; all
    sizes are within one level."""
    k = min(len(levels) - 1, (int(np.min(size)) // GRAM).bit_length() - 1)
    return _pair(levels[k][at], levels[k][at + size - (GRAM << k)]) + np.asarray(size, np.uint64)


CELL = "key long, whole long, t long, n long, p long, far long, near long"
CONTEXT = "t long, n long, p long, far0 long, ctx binary, cells array<struct<key:long,far:long,near:long>>"
RANGES = "t long, n long, start long, end long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their members of contested buckets: the bytes of each run."""
    kinds = (*[pa.int64()] * 4, pa.binary(), pa.list_(pa.struct([("key", pa.int64()), ("far", pa.int64()), ("near", pa.int64())])))
    for batch in _slices(batches):
        for text, t, members in zip(batch.column("text").to_pylist(), batch.column("t").to_pylist(), batch.column("members").to_pylist()):
            for at in range(0, len(members), MEMBERS):
                rows = []
                for m in members[at : at + MEMBERS]:
                    p, far, near = m["place"] >> 20, (m["place"] >> 10) & 1023, m["place"] & 1023
                    rows.append((t, len(text), p, far, text[p - far : p - near + LENGTH], [{"key": m["a"], "far": far, "near": near}]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["t", "n", "p", "far0", "ctx", "cells"])


def cells_of(data: np.ndarray, begin: np.ndarray, far0: np.ndarray, key: np.ndarray, far: np.ndarray, near: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs of offsets far to near cut in cells of `size`: (run, key, whole, far, near) of
    each cell. The bytes of a run's member start at begin in data, with offset far0."""
    per = far // size - near // size + 1
    run = np.repeat(np.arange(len(per)), per)
    cell = near[run] // size + np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per)
    low, zero = cell * size, begin[run] + far0[run]
    levels = pointers(data)
    core = _named(levels, zero - low, LENGTH - size + 1)
    own_far, own_near = np.minimum(far[run], low + size - 1), np.maximum(near[run], low)
    whole = _named(pointers(data, _OTHER), zero - own_far, LENGTH + own_far - own_near)
    whole = _pair(whole, (own_far * 1024 + own_near).astype(np.uint64))
    return run, _pair(_pair(key[run].view(np.uint64), core), cell.astype(np.uint64)), whole, own_far, own_near


def _cells(size: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, MEMBERS):
            ctx = batch.column("ctx").to_pylist()
            if not ctx:
                continue
            lists = batch.column("cells")
            of = np.repeat(np.arange(len(ctx)), np.diff(lists.offsets.to_numpy()))
            cells = lists.flatten()
            key, far, near = (cells.field(k).to_numpy() for k in range(3))
            sizes = np.array(list(map(len, ctx)))
            begin = np.cumsum(sizes) - sizes
            own = {c: batch.column(c).to_numpy() for c in ("t", "n", "p", "far0")}
            run, key, whole, far, near = cells_of(np.frombuffer(b"".join(ctx), np.uint8), begin[of], own["far0"][of], key, far, near, size)
            who = of[run]
            columns = [key.view(np.int64), whole.view(np.int64), own["t"][who], own["n"][who], own["p"][who], far, near]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "whole", "t", "n", "p", "far", "near"])

    return scan


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sizes, removed, spans, digests, left = [], [], [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            runs = removed_runs([(r["start"], r["end"]) for r in ranges or ()])
            cuts = [0, *(x for run in runs for x in run), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            sizes.append(len(text))
            removed.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept.decode("utf-8", "replace"))
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def removed_runs(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("did"))


def _of_buckets(groups: DataFrame, key: str, stretch: str) -> DataFrame:
    """The groups (one row for each stretch of a bucket) of buckets with several. The
    members of a bucket are dealt over SALTS tasks."""
    differ = groups.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(key, F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = groups.withColumn("salt", F.pmod(stretch, F.lit(SALTS)).cast("int"))
    return salted.hint("merge").join(differ.hint("merge"), [key, "salt"], "left_semi").drop("salt")


def _refined(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round over cells (CELL): the ranges of members that another one equals as a whole,
    and one member for each stretch of the buckets that still differ."""
    groups = written(cells.groupBy("key", "whole").agg(F.count("*").alias("c"), F.min(F.struct("t", "n", "p", "far", "near")).alias("m")), "groups")
    repeated = groups.where("c > 1").select("key", "whole")
    start, end = F.col("p") - F.col("far"), F.col("p") - F.col("near") + LENGTH
    found = cells.hint("merge").join(repeated.hint("merge"), ["key", "whole"], "left_semi").select("t", "n", start.alias("start"), end.alias("end")).distinct()
    return found, _of_buckets(groups, "key", "whole").select("key", "m.*")


def repeated_ranges(docs: DataFrame, sizes: tuple[int, ...] = CELLS) -> DataFrame:
    """(t, n, start, end): byte ranges of repeated windows, for each text, known by hash and
    size. sizes: of the cells, round by round; the last is 1."""
    keyed = _keyed(docs)
    # round 0: buckets of equal anchors
    all_ = written(keyed.select("text", "t", "did").mapInArrow(_scan, "a long, u long, t long, n long, did long, place long"), "anchors")
    shared = written(all_.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "buckets")
    anchors = written(all_.hint("merge").join(shared.hint("merge"), "a", "left_semi"), "members")
    dropped(all_)
    # whole stretches
    groups = anchors.groupBy("a", "u").agg(F.count("*").alias("c"), F.min(F.struct("did", "t", "n", "place")).alias("m"))
    groups = written(groups.select("a", "u", "c", "m.*"), "groups")
    whole = groups.where("c > 1").select("a", "u")
    start = F.shiftright("place", 20) - F.shiftright("place", 10).bitwiseAND(1023)
    end = F.shiftright("place", 20) - F.col("place").bitwiseAND(1023) + LENGTH
    out = anchors.hint("merge").join(whole.hint("merge"), ["a", "u"], "left_semi").select("t", "n", start.alias("start"), end.alias("end")).distinct()
    # buckets that still differ, one member for each stretch, with their bytes
    contested = _of_buckets(groups, "a", "u")
    per_text = written(contested.groupBy("did", "t", "n").agg(F.collect_list(F.struct("a", "place")).alias("members")), "contested")
    texts = keyed.select("did", "t", "n", "text")
    contexts = texts.join(per_text.hint("shuffle_hash"), ["did", "t", "n"]).select("text", "t", "members")
    contexts = written(contexts.mapInArrow(_contexts, CONTEXT), "contexts")
    current = contexts
    for size in sizes:
        cells = written(current.mapInArrow(_cells(size), CELL), "cells")
        found, left = _refined(cells)
        out = out.unionByName(found)
        if size > 1:
            per_member = written(left.groupBy("t", "n", "p").agg(F.collect_list(F.struct("key", "far", "near")).alias("cells")), "left")
            current = contexts.drop("cells").hint("merge").join(per_member.hint("merge"), ["t", "n", "p"])
    return out


def dedup(docs: DataFrame, sizes: tuple[int, ...] = CELLS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of each row of docs; text
    is what remains."""
    ranges = repeated_ranges(docs, sizes).groupBy("t", "n").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    ranges = written(ranges, "ranges")
    joined = _keyed(docs).select("doc_id", "text", "t", "n").join(ranges.hint("shuffle_hash"), ["t", "n"], "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
