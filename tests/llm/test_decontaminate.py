import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool.llm import decontaminate as d

from .conftest import edge_rows


def slow(words, items, window):
    hit, found = set(), set()
    for item, w in items:
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return hit, found


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=200, deadline=None)
@given(words, st.lists(words, max_size=4), st.integers(1, 5))
def test_automaton_against_brute_force(text, items, window):
    numbered = list(enumerate(items))
    spans, found = d.Automaton(numbered, window).stream(text)
    assert ({x for a, b in spans for x in range(a, b)}, found) == slow(text, numbered, window)


def test_blocks_give_the_same(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(map(tuple, d.report(docs, items).collect()))
    cut = sorted(map(tuple, d.remove_overlaps(docs, items).collect()), key=str)
    monkeypatch.setattr(d, "BLOCK_WORDS", 300)
    monkeypatch.setattr(d, "PIECE_WORDS", 40)
    assert len(d.item_blocks(items)) > 2
    assert sorted(map(tuple, d.report(docs, items).collect())) == one
    assert sorted(map(tuple, d.remove_overlaps(docs, items).collect()), key=str) == cut
    assert any(a.text != b.text for a, b in zip(d.remove_overlaps(docs, items).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()))


def test_edges(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "the quick"), (2, None), (3, ""), (None, "x"), (9, "Text"), (9, "text")], "item_id long, text string")
    got = d.report(edge_docs, items).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[11].contaminated and by[11].n_items == 0 and by[11].items_sha256 == d.digest([])
    assert by[7].n_items == 1 and by[7].items_sha256 == d.digest([9])
    assert by[5].n_words == by[4].n_words == 0
    for r in got:
        assert r.n_hit <= r.n_words
    assert d.report(empty_docs, items).count() == 0
    assert not any(r.contaminated for r in d.report(edge_docs, items.limit(0)).collect())


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Start here, {item.upper()}! and then a long clean tail that goes on and on for many more words than that", 1), (2, item, 2), (3, "clean", 5), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in d.remove_overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1].text.startswith("Start here, ! and") and got[1].n_chars == len(got[1].text)
    assert got[3].n_chars == 5 and got[4].text is None
    assert not re.search("ONE", got[1].text)


def test_text_ids(spark):
    """Ids that are no numbers stay as they are and are ordered as strings."""
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "before " + text + " after")], "doc_id long, text string")
    items = spark.createDataFrame([("q-10", text), ("q-9", text), ("10", text), (None, text)], "item_id string, text string")
    r = d.report(docs, items).first()
    assert r.n_items == 3 and r.items_sha256 == d.digest(["10", "q-10", "q-9"])
    assert d.remove_overlaps(docs, items).count() == 0
