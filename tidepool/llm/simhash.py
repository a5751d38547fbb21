"""SimHash near-dedup with deletion-variant signatures (operator 1).

Fingerprints: XXH64 (seed 42) of word shingles, bit-wise majority. Two fingerprints link
if at most `max_bits` of their 64 bits differ. Cut into max_bits // 2 + 1 segments, so
many differing bits leave at least one segment with at most one differing bit; each
fingerprint is indexed under all 64 one-wildcard variants of its segments, equal
variants meet, and every link is verified on the whole 64 bits.

Only distinct fingerprints are indexed, so exact copies, however many, are one
entry. A bucket emits its links if they are few, else spanning edges of them, never all
pairs of a dense group.

`representatives` is the form for a Jaccard similarity of word shingles, as the corpus
pipeline needs. The variants find the pairs within 4 bits, which reach down to a similarity
of about 0.95. A pair at 0.8 differs in 10 bits on average and in up to 20, for which segments
would be of 6 bits and tell nothing apart; so for the pairs beyond 4 bits there are, beside the
variants, the bands of minhash.py as buckets. Every link of either is verified on the whole
sets. Spanning edges span groups of near fingerprints; of sets some of them are no links, and
others that a bucket did not send are. So buckets that sent spanning edges are looked at again
where their members are in more than one component after that: all their pairs of different
components are verified, but for those that sizes or sketches exclude (`open_pairs`).

Defined cases: null text is an empty text; texts without words have fingerprint 0
and link like any other; repeated rows share a component; a null doc_id takes
part but is never a component_id (null if a component has no other id); an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .minhash import BANDS, bands
from .shared import connected_components, written

WORDS, MAX_BITS = 4, 4
#: Of `representatives`: words of a shingle, least Jaccard similarity (a fraction), and the
#: bits of candidates: the nearest come first where a bucket emits spanning edges.
SET_WORDS, SIMILAR, SET_BITS = 5, (4, 5), (9, 20)
#: A bucket with more links than this for each member emits spanning edges, over runs of at
#: most CUT members.
DENSE, CUT = 8, 4096
#: Members of a block of a bucket whose pairs are looked through, and bits of a set's sketch.
BLOCK, SKETCH = 1024, 2048
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_PAIR = np.uint64(0x0000000100000001)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each run of `words` words; of the whole sequence if it is shorter."""
    w = (text or b"").translate(_LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    runs = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64, max(1, len(w) - words + 1))


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprint of each segment of hashes: two 32-bit counters share a word."""
    n = np.diff(np.append(starts, len(hashes))).astype(np.uint64)
    out = np.zeros(len(starts), np.uint64)
    for i in range(32):
        s = np.add.reduceat((hashes >> np.uint64(i)) & _PAIR, starts)
        out |= (np.uint64(2) * (s & _LOW) > n).astype(np.uint64) << np.uint64(i)
        out |= (np.uint64(2) * (s >> np.uint64(32)) > n).astype(np.uint64) << np.uint64(i + 32)
    return out


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments, of which one differs by at most one bit."""
    n = max_bits // 2 + 1
    sizes = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def _fingerprints(words: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            rows: list[int] = []
            parts: list[np.ndarray] = []
            held = 0
            for i, text in enumerate(batch.column("text")):
                h = shingle_hashes(text.as_py(), words)
                if len(h):
                    rows.append(i)
                    parts.append(h)
                    held += len(h)
                if held > 200_000 or (rows and i == batch.num_rows - 1):
                    fp[rows] = majority(*_segmented(parts))
                    rows, parts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return scan


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of each row of docs."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def variants(fp: Column, max_bits: int = MAX_BITS) -> list[Column]:
    """The 64 one-wildcard variants of the segments of column fp, as longs: the
    segment without bit j, times 64, plus j."""
    out = []
    for first, bits in segments(max_bits):
        for j in range(first, first + bits):
            mask = ((1 << bits) - 1) ^ (1 << (j - first))
            out.append(F.shiftleft(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(mask).cast("long")), 6).bitwiseOR(F.lit(j).cast("long")))
    return out


def bucket_edges(f: np.ndarray, most: int = MAX_BITS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (places i, j) among the fingerprints f (uint64) of a bucket: all of them, or,
    if there are over DENSE for each member, edges that span the same groups. A bucket with
    many members is first cut by exact pieces: of most + 1 pieces of the 64 bits one is
    equal in linked ones."""
    return _edges(f, most, seed)[:2]


def _edges(f: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket_edges, and the places of the members of which not all links are there."""
    if len(f) <= CUT:
        found = _all(f, most)
        return (*_tree(f, most, seed), np.arange(len(f))) if found is None else (*found, np.empty(0, np.int64))
    found, thin = [], [np.empty(0, np.int64)]
    for lo, hi in ((i * 64 // (most + 1), (i + 1) * 64 // (most + 1)) for i in range(most + 1)):
        piece = (f >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        order = np.argsort(piece, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
            if len(part) > 1:
                links_ = _all(f[part], most)
                i, j = _tree(f[part], most, seed) if links_ is None else links_
                found.append((part[i], part[j]))
                thin += [part] if links_ is None else []
    return (*_joined(found), np.unique(np.concatenate(thin)))


def candidates(f: np.ndarray, most: tuple[int, ...] = SET_BITS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket to be verified: all of a small one, all within the last of `most`
    bits if they are few, else spanning edges for each of `most`. Large buckets are cut in
    runs that share their first member."""
    if len(f) <= 2 * DENSE + 1:
        return np.triu_indices(len(f), 1)
    order = np.random.default_rng(seed).permutation(len(f))
    found = []
    for at in range(1, len(f), CUT):
        part = np.append(order[0], order[at : at + CUT])
        links_ = _all(f[part], most[-1])
        for i, j in [links_] if links_ is not None else [_tree(f[part], x, seed) for x in most]:
            found.append((part[i], part[j]))
    return _joined(found)


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(none, *found))


def _all(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All links of f; None if they are over DENSE for each member."""
    found, n = [], 0
    for at in range(0, len(f), 256):
        i, j = np.nonzero(np.bitwise_count(f[at : at + 256, None] ^ f[None, at:]) <= most)
        ahead = j > i
        found.append((i[ahead] + at, j[ahead] + at))
        n += int(ahead.sum())
        if n > DENSE * len(f):
            return None
    return _joined(found)


def _tree(f: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the groups of f: a search from one member to all near ones that are
    not yet reached. Buckets start at different members (seed)."""
    left = np.random.default_rng(seed).permutation(len(f))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    front: list[int] = []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        at = front.pop()
        near = np.bitwise_count(f[left] ^ f[at]) <= most
        hit, left = left[near], left[~near]
        a.append(np.full(len(hit), at))
        b.append(hit)
        front.extend(hit.tolist())
    return np.concatenate(a), np.concatenate(b)


def _links(most: int | None, thinned: bool):  # noqa: ANN202
    """most: bits of a link; None: `candidates`. thinned: members of buckets that did not send
    all their pairs follow as rows (node, null, key)."""
    every = lambda f, seed: (*candidates(f, seed=seed), np.arange(len(f) if len(f) > 2 * DENSE + 1 else 0))
    meet = every if most is None else (lambda f, seed: _edges(f, most, seed))
    lags = range(1, 8) if most is not None else ()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, fp, node) sorted by key: the links of each run of equal keys."""

        def settle(k: np.ndarray, f: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            starts = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
            sizes = np.diff(np.append(starts, len(k)))
            least = 8 if lags else 1
            small = np.repeat(sizes <= least, sizes)
            for lag in lags:
                hit = np.flatnonzero((k[:-lag] == k[lag:]) & small[lag:] & (np.bitwise_count(f[:-lag] ^ f[lag:]) <= most))
                a.append(node[hit])
                b.append(node[hit + lag])
            parts = [np.empty(0, np.int64)]
            for s, n in zip(starts[sizes > least].tolist(), sizes[sizes > least].tolist()):
                i, j, part = meet(f[s : s + n], seed=int(k[s]) & 0xFFFFFFFF)
                a.append(node[s + i])
                b.append(node[s + j])
                parts += [s + part] if thinned else []
            # a link that many variants of this task found is sent once
            a_, b_ = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
            e = np.unique(np.stack([np.minimum(a_, b_), np.maximum(a_, b_)], 1), axis=0)
            at = np.concatenate(parts)
            rest = [node[at], np.zeros(len(at), np.int64), k[at]]
            is_link = np.arange(len(e) + len(at)) < len(e)
            columns = [np.concatenate(x) for x in zip((e[:, 0], e[:, 1], np.zeros(len(e), np.int64)), rest)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=~is_link), pa.array(columns[2], mask=is_link)], ["a", "b", "thin"])

        held: list[list[np.ndarray]] = []
        rows, most_rows = 0, 200_000
        for batch in batches:
            held.append([batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()])
            rows += batch.num_rows
            if rows < most_rows:
                continue
            all_ = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(all_[0], all_[0][-1]))
            if cut:
                yield settle(*(x[:cut] for x in all_))
            held = [[x[cut:] for x in all_]]
            rows = len(held[0][0])
            most_rows = max(200_000, 2 * rows)  # a bucket that goes on is joined rarely
        if rows:
            yield settle(*(np.concatenate(x) for x in zip(*held)))

    return scan


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that connect the nodes (node, fp)."""
    return _met(_varied(nodes, max_bits), max_bits).select("a", "b")


def _varied(nodes: DataFrame, max_bits: int) -> DataFrame:
    return nodes.select("fp", "node", F.explode(F.array(*variants(F.col("fp"), max_bits))).alias("key"))


def _met(keyed: DataFrame, most: int | None) -> DataFrame:
    """(a, b, thin): links, where thin is null, and, for `candidates`, members of buckets that
    did not send all their pairs: node, null and key."""
    return _scanned(keyed, most, most is None)


def _scanned(keyed: DataFrame, most: int | None, thinned: bool) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "node").select("key", "fp", "node").mapInArrow(_links(most, thinned), "a long, b long, thin long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs; component_id is the smallest
    doc_id reachable over links, itself included."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = written(connected_components(links(nodes.select("fp", F.col("fp").alias("node")))), "roots")
    linked = nodes.hint("merge").join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left")
    linked = written(linked.select("fp", "rep", F.coalesce("root", "fp").alias("root")), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = written(linked.hint("merge").join(least.hint("merge"), "root").select("fp", "component_id"), "component")
    return fps.hint("merge").join(component.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """Column fp as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows of equal doc_id and text."""
    return F.xxhash64(F.lit("row"), doc_id.isNull(), doc_id.cast("long"), text.isNull(), text.cast("binary"))


def _signed_with_bands(words: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                every = [shingle_hashes(t.as_py(), words) for t in batch.column("text")]
                sets = [np.unique(h) for h in every]
                fp, keys = np.zeros(len(every), np.uint64), np.zeros((len(every), BANDS), np.uint64)
                some = [i for i, h in enumerate(every) if len(h)]
                if some:
                    fp[some] = majority(*_segmented([every[i] for i in some]))
                    keys[some] = bands(*_segmented([sets[i] for i in some]))
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                columns = [batch.column("key"), batch.column("doc_id"), pa.array(node.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(fp.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "node", "n", "fp", "bands"])

    return scan


def _segmented(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def _sets(words: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    return scan


def _similar(similar: tuple[int, int]):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = similar
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both * whole >= part * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return scan


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int = SET_WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes (node, any, n) whose sets are similar enough. texts has key
    and text; any is the key of a text of the node."""
    size = lambda c, n: nodes.select(F.col("node").alias(c), F.col("n").alias(n)).hint("merge")
    sized = pairs.hint("merge").join(size("a", "n"), "a").hint("merge").join(size("b", "m"), "b")
    # a smaller share of the larger set excludes the link
    pairs = written(sized.where(F.least("n", "m") * similar[1] >= F.greatest("n", "m") * similar[0]).select("a", "b"), "pairs")
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge").join(nodes.select("node", F.col("any").alias("key")).hint("merge"), "node")
    one = texts.join(written(need, "need").hint("shuffle_hash"), "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = written(one.mapInArrow(_sets(words), "node long, hashes binary"), "sets")
    side = lambda c, x: sets.select(F.col("node").alias(c), F.col("hashes").alias(x)).hint("merge")
    both = pairs.hint("merge").join(side("a", "x"), "a").hint("merge").join(side("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_similar(similar), "a long, b long")


def unsettled(thin: DataFrame, roots: DataFrame) -> DataFrame:
    """(bits, key, node, root) of the buckets of thin (bits, key, node) whose members are in more
    than one component of roots (node, root): a link between them may have been left out.
    Buckets of equal members are there once."""
    members = written(thin.hint("merge").join(roots.hint("merge"), "node"), "thin")
    sums = members.groupBy("bits", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("sign"))
    once = sums.where("low <> high").groupBy("bits", "n", "first", "sign").agg(F.min("key").alias("key")).select("bits", "key")
    return members.hint("merge").join(once.hint("merge"), ["bits", "key"]).select("bits", "key", "node", "root")


def open_pairs(left: DataFrame, nodes: DataFrame, texts: DataFrame, words: int = SET_WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs (a, b) of members of one bucket of left (see `unsettled`) that are in different
    components, differ in at most bits of their fingerprints and can be similar enough by the
    sizes and sketches of their sets (nodes, texts: see `verified`); none that is similar is
    left out. Buckets are cut in blocks of BLOCK members that all meet each other, so a task
    holds two blocks, however large the bucket is."""
    need = left.select("node").distinct().hint("merge").join(nodes.select("node", F.col("any").alias("key"), "n", "fp").hint("merge"), "node")
    one = texts.join(need.hint("shuffle_hash"), "key").groupBy("node").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    marks = written(one.mapInArrow(_sketches(words), "node long, n long, fp long, sketch binary"), "sketches")
    place = F.row_number().over(Window.partitionBy("bits", "key").orderBy("root", "node")) - 1
    rows = written(left.withColumn("block", F.floor(place / BLOCK)).hint("merge").join(marks.hint("merge"), "node"), "blocks")
    blocks = rows.groupBy("bits", "key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    other = blocks.select("bits", "key", F.col("block").alias("other"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    # two blocks of one component have nothing to settle
    units = blocks.hint("merge").join(other.hint("merge"), ["bits", "key"]).where("least(low, o_low) <> greatest(high, o_high)").select("bits", "key", "block", "other")
    sent = rows.hint("merge").join(units.hint("merge"), ["bits", "key", "block"]).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    pairs = sent.select("bits", "key", "i", "j", "block", "node", "root", "n", "fp", "sketch").groupBy("bits", "key", "i", "j").applyInArrow(_open(similar), "a long, b long")
    return pairs.distinct()


def _sketches(words: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each of SKETCH residues whether an odd number of the set's hashes has it: sketches
        differ in at most as many bits as sets in members."""
        for batch in batches:
            sets = (np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column("text"))
            odd = [np.packbits(np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "fp")), pa.array(odd, pa.binary())], ["node", "n", "fp", "sketch"])

    return scan


def _open(similar: tuple[int, int]):  # noqa: ANN202
    part, whole = similar

    def meet(rows: pa.Table) -> pa.Table:
        bits, i, j = (rows.column(c)[0].as_py() for c in ("bits", "i", "j"))
        node, root, n, fp, block = (rows.column(c).to_numpy() for c in ("node", "root", "n", "fp", "block"))
        fp = fp.view(np.uint64)
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = [np.empty((0, 2), np.int64)]
        for at in range(0, len(left), 64):
            x, y = left[at : at + 64, None], right[None]
            hit = (root[x] != root[y]) & (np.minimum(n[x], n[y]) * whole >= np.maximum(n[x], n[y]) * part) & (np.bitwise_count(fp[x] ^ fp[y]) <= bits)
            if i == j:
                hit &= x < y
            x, y = (z[k] for z, k in zip((left[at : at + 64], right), np.nonzero(hit)))
            for k in range(0, len(x), 1 << 14):
                u, v = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                apart = np.bitwise_count(sketch[u] ^ sketch[v]).sum(1, dtype=np.int64)
                # of sets with s members together and d in only one of them the similarity is (s - d) / (s + d)
                s = n[u] + n[v]
                can = (s - apart) * whole >= part * (s + apart)
                found.append(np.stack([np.minimum(node[u], node[v]), np.maximum(node[u], node[v])], 1)[can])
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    return meet


def representatives(docs: DataFrame, words: int = SET_WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(key, rows): of each component of similar texts the row key of the least doc_id (of
    equal ones the least key; null comes last), and how many rows have it. Texts without
    words are copies of each other."""
    src = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = src.mapInArrow(_signed_with_bands(words), "key long, doc_id long, node long, n long, fp long, bands array<long>")
    signed = written(signed, "signed")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = signed.groupBy("node").agg(F.min(own).alias("least"), F.min("key").alias("any"), F.max("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    some = nodes.where("n > 0")
    near = _scanned(_varied(some, MAX_BITS), MAX_BITS, True).withColumn("bits", F.lit(MAX_BITS))
    met = near.unionByName(_met(some.select("fp", "node", F.explode("bands").alias("key")), None).withColumn("bits", F.lit(64)))
    met = written(met, "met")
    texts = src.select("key", "text")
    found = written(verified(met.where("thin is null").select("a", "b").distinct(), nodes, texts, words, similar), "links")
    roots = written(connected_components(found), "roots")
    rooted = nodes.hint("merge").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = written(unsettled(met.where("thin is not null").select("bits", F.col("thin").alias("key"), F.col("a").alias("node")), rooted.select("node", "root")), "unsettled")
    if not left.isEmpty():
        rooted = written(rooted.select("node", "root", "least"), "rooted")
        more = written(verified(open_pairs(left, nodes, texts, words, similar), nodes, texts, words, similar), "links")
        root = lambda c: rooted.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge")
        ends = more.hint("merge").join(root("a"), "a").hint("merge").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        above = written(connected_components(ends), "roots").select(F.col("node").alias("root"), F.col("root").alias("above"))
        rooted = rooted.hint("merge").join(above.hint("merge"), "root", "left").withColumn("root", F.coalesce("above", "root"))
    placed = rooted.groupBy("root").agg(F.min("least").alias("least"))
    least = placed.select(F.col("least.key").alias("key"))
    return signed.select("key").hint("merge").join(least.hint("merge"), "key").groupBy("key").agg(F.count("*").alias("rows"))
