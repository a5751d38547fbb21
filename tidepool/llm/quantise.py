"""Embedding near-dedup by iterative quantisation (operator 11).

Fitting, on a bounded sample by hash: vectors are centred and projected on their principal
axes, and a rotation is learned that brings them nearest to the corners of a cube, so that the
signs are balanced bits. More than one rotation (from other starts) gives longer codes.

Index: codes are cut into segments of at least SEGMENT_BITS bits, more for more vectors, each
of which is one Hamming table. A code enters a table under its segment and all segments one
bit away, so two codes meet in a table where their segments differ by at most two bits. So
many tables are made that sampled vectors and made-up partners of exactly the least cosine
meet in some table with probability RECALL at least; nearer ones meet more often.

Two passes over the tables. The first works on codes alone: in each bucket it looks for
partners that meet there first (of all tables and keys) and whose whole codes are near.
Only members with a partner go to the second pass, with their vectors: cosines of the same
pairs in double precision are compared with the bound, links are counted, and a spanning
forest of the bucket's links is kept. A pair is looked at in one bucket only, so counts add
up, and no pair is ever a row. Buckets of more than PIECE members are cut into pieces, and
each pair of pieces is a task's unit, so that a hot bucket is dealt over tasks.

Equal vectors are one class from the start: copies are counted, not compared.
Components come from the forests by star contraction.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
whose vec_id is null, link with nothing: n_links 0, component_id = vec_id, kept (a null
vec_id has a null component_id and is kept). Vectors of unequal length are as if padded
with 0. Rows of equal vec_id are vectors of their own, and link if they are near. Empty
tables give no rows; other columns, labels too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, written

COSINE = 0.9
#: Vectors that the rotations are fitted on, about; steps of the fit; bits of one rotation.
SAMPLE, STEPS, WIDTH = 4096, 30, 64
#: Bits of a segment, at least; vectors of a bucket, about, which decide on more.
SEGMENT_BITS, BUCKET = 16, 256
#: The probability of meeting at exactly the least cosine; and tables at most.
RECALL, MOST_TABLES = 0.98, 64
#: Members of a bucket that are worked through in one unit; a table of fewer large buckets is broadcast.
PIECE, BROADCAST_BUCKETS = 2048, 50_000
#: Members of a block of rows that are compared with a whole piece at once.
ROWS = 256


@dataclass
class Model:
    """Rotations (features x bits, each for centred vectors) and the cut into segments."""

    mean: np.ndarray
    rotations: np.ndarray  # features x (tables * bits)
    bits: int
    tables: int
    #: differing bits of whole codes of partners, at most; and how many sampled ones meet
    radius: int = 0
    found: float = 0.0

    def segments(self, x: np.ndarray) -> np.ndarray:
        """vectors x tables: each segment of each code as a number."""
        bits = ((x - self.mean) @ self.rotations > 0).reshape(len(x), self.tables, self.bits)
        return bits @ (1 << np.arange(self.bits, dtype=np.int64))


def rotation(x: np.ndarray, width: int, rng: np.random.Generator, steps: int = STEPS) -> np.ndarray:
    """Iterative quantisation of centred vectors: features x width."""
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :width]
    flat = x @ axes
    turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
    for _ in range(steps):
        # the nearest corners, then the rotation that brings the vectors nearest to them
        corners = np.where(flat @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(corners.T @ flat)
        turn = (left @ right).T
    return axes @ turn


def partners(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another of exactly this cosine, moved the way the vectors differ."""
    away = x[rng.permutation(len(x))] + 1e-3 * rng.standard_normal(x.shape)
    away = away - (away * x).sum(1, keepdims=True) * x
    away = away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    return cosine * x + np.sqrt(1 - cosine**2) * away


def fit(sample: np.ndarray, n: int, cosine: float = COSINE) -> Model:
    """The model of a sample of unit vectors for an index of n vectors. Where one group of near
    vectors is most of the sample, planes through its middle would cut the group to pieces:
    then tables of centred vectors don't suffice, and planes go through the origin."""
    sample = sample[np.lexsort(sample.T)] if len(sample) else np.zeros((1, sample.shape[1]))
    centred = tables_of(sample, sample.mean(0), n, cosine)
    return centred if centred.found >= RECALL else max(centred, tables_of(sample, np.zeros(sample.shape[1]), n, cosine), key=lambda m: m.found)


def tables_of(sample: np.ndarray, mean: np.ndarray, n: int, cosine: float) -> Model:
    """Rotations are added until there are tables enough."""
    rng = np.random.default_rng(11)
    bits = max(SEGMENT_BITS, int(np.ceil(np.log2(max(n, 1) / BUCKET))) + 5)
    width = min(WIDTH, sample.shape[1])
    far = np.repeat(sample, -(-1024 // len(sample)), axis=0)
    near = partners(far, cosine, rng)
    columns = np.empty((sample.shape[1], 0))
    while True:
        columns = np.hstack([columns, rotation(sample - mean, width, rng)])
        tables = min(columns.shape[1] // bits, MOST_TABLES)
        if not tables:
            continue
        model = Model(mean, columns[:, : tables * bits], bits, tables)
        apart = np.bitwise_count(model.segments(far) ^ model.segments(near))
        met = ((apart <= 2).cumsum(1) > 0).mean(0)
        if met[-1] >= RECALL or tables == MOST_TABLES:
            tables = int(np.argmax(met >= min(RECALL, met[-1]))) + 1
            radius = int(np.quantile(apart[:, :tables].sum(1), 0.999)) + 1
            return Model(mean, columns[:, : tables * bits], bits, tables, radius, float(met[tables - 1]))


def padded(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    width = max(map(len, rows), default=0)
    return np.array([r + [0.0] * (width - len(r)) for r in rows]).reshape(len(rows), width)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, k1, k2, x) of the rows that take part: x has length 1, equal vectors equal keys."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    # by the largest component first, so that squares neither overflow nor vanish
    most = F.array_max(F.transform("x", lambda c: F.abs(c)))
    rows = rows.withColumn("most", most).where("most > 0").withColumn("x", F.transform("x", lambda c: c / F.col("most")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    rows = rows.withColumn("norm", norm).select("vec_id", F.transform("x", lambda c: c / F.col("norm")).alias("x"))
    return rows.select("vec_id", F.xxhash64("x").alias("k1"), F.xxhash64("x", F.lit(7)).alias("k2"), "x")


def ball(bits: int) -> np.ndarray:
    return np.append(0, 1 << np.arange(bits, dtype=np.int64))


def meets_first(a: np.ndarray, b: np.ndarray, table: int, key: int) -> np.ndarray:
    """Whether pairs of codes (pairs x tables) meet in no earlier table, and in this one under
    no smaller key: the one place where the pair is looked at."""
    x = a ^ b
    apart = np.bitwise_count(x)
    now, both, own = apart[:, table], a[:, table] & b[:, table], x[:, table]
    # 0 bits apart: the code without its highest bit; 1: the smaller code; 2: the smaller of
    # the two codes in between, which keeps only the common bits and, where one code has both
    # bits, the lower of them
    spread = now == 2
    one_has_both = spread & (((a[:, table] & own) == 0) | ((b[:, table] & own) == 0))
    top = np.where(both > 0, 1 << np.maximum(np.int64(np.log2(np.maximum(both, 1))), 0), 0)
    least = np.where(now == 0, both - top, np.where(one_has_both, both | (own & -own), both))
    return (now <= 2) & (apart[:, :table] > 2).all(1) & (least == key)


def _dealt(model: Model):  # noqa: ANN202
    """Codes under all their keys."""
    steps = ball(model.bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array(batch.column("code").to_pylist(), np.int64).reshape(batch.num_rows, model.tables)
            many = max(1, 65_536 // (len(steps) * model.tables))
            for i in range(0, len(codes), many):
                part = codes[i : i + many]
                keys = part[:, :, None] ^ steps
                n = model.tables * len(steps)
                at = pa.array(np.repeat(np.arange(i, i + len(part)), n))
                table = np.tile(np.repeat(np.arange(model.tables, dtype=np.int32), len(steps)), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(keys.ravel()), batch.column("c").take(at), batch.column("code").take(at)], ["t", "key", "c", "code"])

    return scan


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The units of a partition that is sorted by `names`: key and rows. A unit has two pieces
    of a bucket at most."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in names]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = np.flatnonzero(change) + 1
        for begin, end in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
            own = tuple(int(c[begin]) for c in columns)
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(begin, end - begin))
    if held:
        yield key, pa.Table.from_batches(held)


UNIT = ["t", "key", "i", "j"]


def _pairs(rows: pa.Table, unit: tuple, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a unit that meet here first and have near codes, as places of rows."""
    if rows.num_rows < 2:
        return
    codes = np.array(rows.column("code").to_pylist(), np.int64).reshape(rows.num_rows, model.tables)
    piece = rows.column("piece").to_numpy()
    t, key, i, j = unit
    left = np.flatnonzero(piece == i)
    right = left if i == j else np.flatnonzero(piece == j)
    for begin in range(0, len(left), ROWS):
        own = left[begin : begin + ROWS]
        apart = np.zeros((len(own), len(right)), np.uint16)
        for s in range(model.tables):
            apart += np.bitwise_count(codes[own, s][:, None] ^ codes[right, s])
        a, b = np.nonzero(apart <= model.radius)
        a, b = own[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if len(a):
            here = meets_first(codes[a], codes[b], t, key)
            yield a[here], b[here]


def _with_partner(model: Model):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in _runs(batches, UNIT):
            found = np.zeros(rows.num_rows, bool)
            for a, b in _pairs(rows, unit, model):
                found[a] = found[b] = True
            if found.any():
                out = rows.filter(pa.array(found)).select([*UNIT, "piece", "c"]).combine_chunks()
                yield from out.to_batches()

    return scan


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is joined with by links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _linked(model: Model, cosine: float):  # noqa: ANN202
    """Each member of a unit with its links and, as an edge, the least class joined with it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in _runs(batches, UNIT):
            x, copies, ids = padded(rows.column("x").combine_chunks()), rows.column("copies").to_numpy(), rows.column("c").to_numpy()
            links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for a, b in _pairs(rows, unit, model):
                for k in range(0, len(a), 65_536):
                    p, q = a[k : k + 65_536], b[k : k + 65_536]
                    near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                    p, q = p[near], q[near]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    # what is joined so far counts as links of the next step
                    root = forest(len(ids), np.concatenate([p, np.arange(len(ids))]), np.concatenate([q, root]))
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(links[hit])], ["a", "b", "links"])

    return scan


def in_units(rows: DataFrame) -> DataFrame:
    """rows (t, key, c, ...) with piece and the units (i, j) that need them: a bucket of up to
    PIECE members is one unit; of a larger one each pair of pieces is."""
    large = written(rows.groupBy("t", "key").agg(F.count("*").alias("size")).where(F.col("size") > PIECE), "large")
    hint = "broadcast" if large.count() <= BROADCAST_BUCKETS else "merge"
    sized = rows.join(large.hint(hint), ["t", "key"], "left")
    pieces = F.coalesce(F.ceil(F.col("size") / PIECE), F.lit(1)).cast("int")
    out = sized.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("c", "t"), F.col("pieces")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: F.struct(F.least(p, F.col("piece")).alias("i"), F.greatest(p, F.col("piece")).alias("j")))
    return out.withColumn("_unit", F.explode(others)).select("t", "key", "_unit.i", "_unit.j", "piece", *(c for c in rows.columns if c not in ("t", "key")))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors."""
    rows = unit_vectors(vectors, id_col, vec_col)
    classes = written(rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("x").alias("x")).withColumn("c", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    sample = classes.where(F.shiftrightunsigned(F.xxhash64("k1", F.lit(5)), 11) / float(1 << 53) < SAMPLE / max(n, 1)).select("x").collect()
    width = classes.agg(F.max(F.size("x"))).first()[0] or 1
    model = fit(np.array([r.x + [0.0] * (width - len(r.x)) for r in sample]).reshape(len(sample), width), n, cosine)
    shipped = vectors.sparkSession.sparkContext.broadcast(model)  # features x bits numbers

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = padded(batch.column("x"))
            code = shipped.value.segments(np.hstack([x, np.zeros((len(x), width - x.shape[1]))]))
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(code.tolist(), pa.list_(pa.int64()))], ["c", "code"])

    codes = written(classes.select("c", "x").mapInArrow(coded, "c long, code array<long>"), "codes")
    buckets = codes.mapInArrow(_dealt(model), "t int, key long, c long, code array<long>")
    units = in_units(buckets).repartition(*UNIT).sortWithinPartitions(*UNIT)
    partnered = written(units.mapInArrow(_with_partner(model), "t int, key long, i int, j int, piece int, c long"), "partnered")
    wide = classes.select("c", "copies", "x").join(codes.hint("merge"), "c")
    again = partnered.hint("merge").join(wide, "c").select(*UNIT, "piece", "c", "copies", "code", "x")
    links = written(again.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_linked(model, cosine), "a long, b long, links long"), "links")
    roots = connected_components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    own = classes.select("k1", "k2", "c", "copies", "least").join(counts.hint("merge"), "c", "left").join(roots.select(F.col("node").alias("c"), "root").hint("merge"), "c", "left")
    own = written(own.select("k1", "k2", "least", F.coalesce("root", "c").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "own")
    # component ids are the least vec_id over the classes of a component
    # written, so that the join is a plain one and a large component is split in it
    least = written(own.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = own.hint("merge").join(least.hint("merge"), "root").select("k1", "k2", "n_links", "component_id")
    members = rows.select("vec_id", "k1", "k2").hint("merge").join(named.hint("merge"), ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = unlinked(vectors, id_col, vec_col).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def unlinked(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id) of the rows that take no part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("vec_id").isNull() | F.col("x").isNull() | bad | ~F.exists("x", lambda c: c != 0)).select("vec_id")
