import hashlib
import zlib

import pytest

from tests.compare import oracle, same
from tests.llm.conftest import SCHEMA, edge_rows
from tidepool.llm import merkle
from tidepool.llm.queries import ORACLE_SQL, QUERIES


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and the siblings of each lowest node, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % 8 : a - a % 8 + 8]
            paths[i].append((run[: a % 8], run[a % 8 + 1 :]))
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [a // 8 for a in at]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own, subroots = {}, []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r[0], r[3], r[2], r[4], r[1])))
        subroot, paths = tree([leaf_of(r[0], r[3], r[2], r[4], r[1]) for r in mine])
        subroots.append(subroot)
        own[lang] = mine, paths
    root, tops = tree(subroots)
    out = []
    for lang, subroot, top in zip(langs, subroots, tops):
        for (doc_id, text, _, source, n_chars), path in zip(*own[lang]):
            shown = text
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                shown = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(doc_id, source, lang, n_chars, shown)
            for before, behind in path + top:
                node = digest("".join([*before, node, *behind]))
            out.append((doc_id, leaf_of(doc_id, source, lang, n_chars, text), subroot, root, digest("".join("".join(a + b) for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


def run(spark, rows, depth=merkle.DEPTH):
    docs = spark.createDataFrame([(*r, *["clash"] * 11) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.manifest(docs, depth).collect()), key=str)


def many(n):
    langs = ["en", "de", None, "fr", "日本", "z", "", "é"]
    return [(i // 2 if i % 50 == 0 else i, f"Text {i} of ALL" if i % 3 else f"text {i}", "en" if i % 3 == 0 else langs[i % 8] + str(i % 5) if langs[i % 8] else langs[i % 8], f"s{i % 4}", i) for i in range(n)]


def test_sql(spark, sf_dir):
    same(QUERIES["op13_merkle"](spark, sf_dir).toPandas(), oracle(ORACLE_SQL["op13_merkle"], sf_dir))


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_brute_force(spark, depth):
    """Small superblocks: several rounds up and down, languages of 1 to 220 leaves."""
    rows = many(650)
    got = run(spark, rows, depth)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_edges(spark):
    rows = [r[:5] for r in edge_rows()]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    one = [(7, "Only ONE", "en", None, None)]
    assert run(spark, one) == brute(one)
    big = (1 << 60) + 1
    assert run(spark, [(big, "a", None, "s", 1), (None, "b", None, "s", 1)]) == brute([(big, "a", None, "s", 1), (None, "b", None, "s", 1)])


def test_levels_end_at_the_depth_or_the_top():
    assert [len(x) for x in merkle.levels(["a"] * 20, 20, 4)] == [20, 3, 1]
    assert [len(x) for x in merkle.levels(["a"], 5000, 4)] == [1, 1, 1, 1, 1]
    assert [len(x) for x in merkle.levels(["a"], 1, 4)] == [1]
