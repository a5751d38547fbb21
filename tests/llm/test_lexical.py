import math
import re

from tests.compare import oracle, same
from tests.llm.conftest import SCHEMA, sentence
from tidepool.llm import lexical
from tidepool.llm.queries import ORACLE_SQL, QUERIES

ITEMS = "item_id long, text string, n string, rank string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    words = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, w in words:
            score = 0
            for t in terms(text):
                tf, df = w.count(t), sum(t in x for _, x in words)
                if tf:
                    m = 100 - 75 + (75 * len(w) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((score, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, d, s) for r, (s, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items):
    rows = [(d, t, "en", "s", 1, *["clash"] * 11) for d, t in docs]
    out = lexical.search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS))
    return sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = [(i, sentence(i % 9, 30 + i) + (" Straße ÄB über" if i % 4 == 0 else "") + (" x-ray_7" * (i % 3))) for i in range(40)] + [(None, "x ray straße"), (None, None), (50, ""), (51, " -- "), (3, "x ray"), (52, sentence(5, 20_000))]
LIST = [(1, "X-Ray x 7"), (2, sentence(3, 12)), (3, "STRAße über ÄB Äb"), (4, None), (5, "..."), (None, "ray"), (7, "nowhere to find zzz"), (1, "the quick brown0"), (2, sentence(3, 12)), (8, sentence(5, 300))]


def test_sql(spark, sf_dir):
    same(QUERIES["op12_lexical"](spark, sf_dir).toPandas(), oracle(ORACLE_SQL["op12_lexical"], sf_dir))


def test_brute_force(spark):
    assert run(spark, DOCS, LIST) == brute(DOCS, LIST)


def test_blocks_and_small_steps(spark, monkeypatch):
    """Many blocks of items and scores worked out a few documents at once."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    assert run(spark, DOCS, LIST) == brute(DOCS, LIST)


def test_best_keeps_ties_in_order(monkeypatch):
    import numpy as np

    best = lexical.Best(2, 3)
    for ids, scores in (([9, 4, 7], [5, 5, 1]), ([2, 8], [5, 5]), ([1, 3, 6, 0], [0, 5, 9, 5])):
        best.add(np.array([[s, 0] for s in scores]), np.zeros(len(ids), np.int64), np.array(ids))
    assert best.rows[1].tolist() == [9, 5, 5] and best.rows[3].tolist() == [6, 0, 2]


def test_empty_tables(spark):
    assert run(spark, [], LIST) == [] and run(spark, DOCS, []) == [] and run(spark, [(1, None)], LIST) == []


def test_boundaries_and_length():
    for text in ("", "a", " a ", "a,b", "ß-ß", "A1 b2", "..", "é", "a" * 10_000):
        assert lexical.length(lexical.normal(text.encode())) == len(terms(text))
