import hashlib

import numpy as np
import pytest

from tidepool.llm import substrings

from .conftest import edge_rows, sentence


def slow(texts, length=400):
    seen = {}
    for b in texts:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(1 for j in range(len(b)) if cover[j] and (j == 0 or not cover[j - 1]))
        out.append((len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows(docs, sizes):
    out = substrings.dedup(docs, sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("sizes", [substrings.CELLS, (1,), (7, 3, 1)])
def test_against_brute_force(spark, sizes):
    base, other = sentence(1, 200), sentence(2, 300)
    texts = [base, base[:900] + other, other[100:1500], base[500:] + base[500:], "q" * 1000, "pq" * 700, other[:399], other[:400], None, "", *(sentence(10 + i, 20) + base[300:760] + sentence(40 + i, 30) for i in range(6)), base[:450] + "!" + base[451:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(((i, *x) for i, x in enumerate(slow([(t or "").encode() for t in texts]))), key=str)
    assert rows(docs, sizes) == want


def test_given_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = sorted(((d, *x) for (d, _), x in zip(texts, slow([b for _, b in texts]))), key=str)
    assert rows(docs, substrings.CELLS) == want and any(r[2] for r in want)


def test_identifiers_are_made_of_those_at_later_offsets():
    text = np.frombuffer(("ab" * 30 + sentence(3, 120) * 2).encode(), np.uint8)
    levels = substrings.pointers(text)
    assert len(levels) == 4
    for k in range(1, 4):
        later = substrings.GRAM << (k - 1)
        below = levels[k - 1]
        assert (levels[k] == substrings._pair(below[:-later], below[later:])).all()
    for k, level in enumerate(levels):
        named = {}
        for i, x in enumerate(level.tolist()):
            named.setdefault(x, set()).add(bytes(text[i : i + (substrings.GRAM << k)]))
        assert all(len(v) == 1 for v in named.values()) and len(named) == len(set().union(*named.values()))


def test_text_is_what_remains(spark):
    base = "é" * 300
    docs = spark.createDataFrame([(1, "xx" + base + "tail"), (2, base + "end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in substrings.dedup(docs).collect()}
    assert got == {1: ("xxtail", 600), 2: ("end", 600), 3: ("short", 0)}


def test_edges(edge_docs, empty_docs):
    got = {(r.doc_id, r.n_bytes): r for r in substrings.dedup(edge_docs).collect()}
    own = [(d, (t or "").encode()) for d, t, *_ in edge_rows() if len(t or "") < 20_000]
    for (d, b), (n, removed, runs, sha) in zip(own, slow([b for _, b in own])):
        r = got[(d, len(b))]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, runs, sha)
    # the two long texts share all but the tail
    long = [r for r in got.values() if r.n_bytes > 100_000]
    assert sorted(r.n_bytes - r.n_removed for r in long) == [0, 5]
    assert substrings.dedup(empty_docs).count() == 0


def test_anchor_runs_cross_chunks(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 700)
    text = sentence(5, 900).encode()
    short = list(substrings.anchors_of([text]))
    monkeypatch.setattr(substrings, "CHUNK", 1 << 17)
    assert short == list(substrings.anchors_of([text]))
    covered = sorted(s for _, _, _, lo, hi in short for s in range(lo, hi + 1))
    assert covered == list(range(len(text) - 399))
