"""Merkle manifest of a dataset by cogrouped subtree exchange (operator 13).

Each row is a leaf, a hash of its fields. The leaves of a language, in the order of doc_id,
are the lowest level of its tree: while a level has more than one node, every FAN consecutive
nodes (the last run may be shorter) become their hash. What remains of each language, in the
order of the languages, is the lowest level of the tree on top.

A superblock is FAN ** DEPTH consecutive nodes of one level, at most. First each superblock is
reduced to its root on its own (a group of bounded size), and the roots are the nodes of the
next round, until one a language is left; two rounds hold 16 million rows of a language, three
68 billion. Then proofs go down: the nodes of a superblock and the outer nodes that their
proofs need, found one round higher, meet in a cogroup. There the local levels are built
again, local and outer siblings are joined into proofs, and the tampered leaf is folded with
them up to a root. So a row is shuffled once for the first reduction and once for the proofs,
and no level is ever joined to rows one by one.

Numbers in a language come from ranges of the order, so a language of any size is dealt over
tasks.

Hash: sha256 of the concatenated inputs, as lowercase hex text. A field is `-` if null, else
its number of UTF-8 bytes, `:` and its value.

Defined cases: the null language comes first, then bytewise; a null doc_id comes before
others, rows of equal doc_id are ordered by their leaf, and equal rows are leaves of their own;
the only leaf of a language is its subroot, the only subroot is the root; a proof without
siblings is the hash of nothing; a row whose doc_id is null is not tampered with; empty and
long texts are hashed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.ranges import numbered_in_key

from .shared import written

FAN = 8
#: Levels of a superblock: a group has FAN ** DEPTH rows at most.
DEPTH = 4
#: Rows of a range when a language is numbered, about.
RANGE_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The hash of a row's fields, some of them changed."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def tampered() -> Column:
    """Where 3 divides the crc32 of doc_id, the text with A-Z in lower case."""
    hit = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return F.when(hit, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str], n: int, depth: int) -> list[list[str]]:
    """The levels of a superblock, of a tree whose lowest level has n nodes, from below: depth
    steps up, or fewer if the tree ends before."""
    out = [nodes]
    while len(out) <= depth and n > 1:
        low = out[-1]
        out.append([digest("".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
        n = -(-n // FAN)
    return out


def siblings(built: list[list[str]], at: int) -> list[tuple[str, str]]:
    """For each level that is reduced, the hashes of the node's run before and behind it."""
    out = []
    for level in built[:-1]:
        first = at - at % FAN
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + FAN])))
        at //= FAN
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, behind in path:
        node = digest(before + node + behind)
    return node


def in_superblocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("r") / FAN**depth).cast("long"))


def rounds(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """nodes (key, r, n, hash) and the superblock roots above, up to one node a key."""

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        top = levels(pdf.sort_values("r")["hash"].tolist(), n, depth)[-1][0]
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "r": [pdf["block"].iloc[0]], "n": [-(-n // FAN**depth)], "hash": [top]})

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        roots = in_superblocks(out[-1], depth).groupBy("key", "block").applyInPandas(root, "key string, r long, n long, hash string")
        out.append(written(roots, "roots"))
    return out


def proofs(levels_up: list[DataFrame], top: DataFrame, depth: int) -> DataFrame:
    """(key, r, path, subroot, root) of the nodes one round above the lowest, from those of the
    highest (top: one row a key)."""
    names = ["key", "r", "path_before", "path_behind", "subroot", "root"]

    def down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """A superblock's nodes: the siblings in it, then those of the outer nodes."""
        if not len(nodes):
            return pd.DataFrame(columns=names)
        nodes, above = nodes.sort_values("r"), outer.iloc[0]
        built = levels(nodes["hash"].tolist(), int(nodes["n"].iloc[0]), depth)
        paths = [siblings(built, i) for i in range(len(nodes))]
        return pd.DataFrame({
            "key": nodes["key"].to_numpy(), "r": nodes["r"].to_numpy(), "path_before": [[*(a for a, _ in p), *above["path_before"]] for p in paths],
            "path_behind": [[*(b for _, b in p), *above["path_behind"]] for p in paths], "subroot": above["subroot"], "root": above["root"],
        })

    known = top
    for nodes in reversed(levels_up[1:-1]):
        below = in_superblocks(nodes, depth).groupBy("key", "block")
        found = below.cogroup(known.withColumnRenamed("r", "block").groupBy("key", "block")).applyInPandas(down, "key string, r long, path_before array<string>, path_behind array<string>, subroot string, root string")
        known = written(found, "proofs")
    return known


def finished(leaves: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """Superblocks of leaves and their outer nodes: local levels, proofs, and the fold of what
    was tampered with."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def finish(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=names)
        rows, above = rows.sort_values("r"), above.iloc[0]
        built = levels(rows["hash"].tolist(), int(rows["n"].iloc[0]), depth)
        up = [*zip(above["path_before"], above["path_behind"])]
        proof, folded = [], []
        for i, own in enumerate(rows["shown"]):
            path = siblings(built, i) + up
            proof.append(digest("".join(a + b for a, b in path)))
            folded.append(fold(own, path))
        out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "leaf": rows["hash"].to_numpy(), "subroot": above["subroot"], "root": above["root"], "proof_sha256": proof, "folded_root": folded})
        out["verified"] = np.array(folded) == above["root"]
        return out[names]

    # an id with nulls would become a float in pandas
    whole = in_superblocks(leaves, depth).select("key", "block", "r", "n", "hash", "shown", F.col("doc_id").cast("string").alias("doc_id")).groupBy("key", "block")
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = whole.cogroup(outer.withColumnRenamed("r", "block").groupBy("key", "block")).applyInPandas(finish, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (key, ...) with r, the number in the key, and n, the key's rows."""
    ranges = max(64, rows.count() // RANGE_ROWS)
    return numbered_in_key(rows, "key", *order, ranges=ranges)


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row a document."""
    lang = F.col("lang").cast("string")
    rows = docs.select(
        F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), lang)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("hash"), leaf(text=tampered()).alias("shown"),
    )
    # both hashes are made once; from here on rows are narrow
    leaves = written(numbered(written(rows, "leaves"), "doc_id", "hash"), "leaves")
    per_lang = rounds(leaves.select("key", "r", "n", "hash"), depth)
    subroots = per_lang[-1].select(F.lit("").alias("key"), F.col("key").alias("lang"), "hash")
    langs = written(numbered(subroots, "lang"), "langs")
    on_top = rounds(langs.select("key", "r", "n", "hash"), depth)
    none = F.array().cast("array<string>")
    peak = on_top[-1].select("key", "r", none.alias("path_before"), none.alias("path_behind"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    # the proofs of the subroots are those of the lowest level of the tree on top
    by_lang = proofs([langs, *on_top], peak, depth).select("r", "path_before", "path_behind", "root")
    top = by_lang.join(langs.select(F.col("lang").alias("key"), "r", F.col("hash").alias("subroot")).hint("merge"), "r")
    top = top.select("key", F.lit(0).cast("long").alias("r"), "path_before", "path_behind", "subroot", "root")
    return finished(leaves, proofs(per_lang, top, depth), depth)
