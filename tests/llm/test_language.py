import zlib

import duckdb
from pyspark.sql import functions as F

from tidepool.llm import language

from .conftest import edge_rows


def slow_phrases(sample, symbols):
    n = i = 0
    while i < len(symbols):
        k = 0
        while i + k < len(symbols) and symbols[i : i + k + 1] in sample:
            k += 1
        i += max(k, 1)
        n += 1
    return n


def test_phrases_against_substring_search():
    samples = {"aa": ["the cat sat on the mat and the rat", "that hat"], "bb": ["der hund und die katze", "und das haus"]}
    m = language.Model(samples)
    texts = ["the hat and the hund", "katze die der " * 60, "zzz", "und"]
    joined = {}
    for k, v in samples.items():
        joined[k] = " ".join(v) + " "
    names, scores, rates = language.predict(m, texts)
    for text, name, score, rate in zip(texts, names, scores, rates):
        normal = "".join(map(chr, language.normal_codes(text)))
        letters = sum(c != " " for c in normal)
        slow = {k: slow_phrases(joined[k], normal) / letters for k in samples}
        best = min(slow, key=lambda k: (slow[k], k))
        other = min(v for k, v in slow.items() if k != best)
        assert (name, round(rate, 12), round(score, 12)) == (best, round(slow[best], 12), round(1 - slow[best] / other, 12))


def test_state_is_carried_from_lane_to_lane(monkeypatch):
    import random

    r = random.Random(4)
    sample = "".join(r.choice("ab c") for _ in range(3000)) + "日本語の文章です" * 30 + "".join(chr(0x4E00 + i) for i in range(2000))
    model = language.Model({"x": [sample], "y": ["ba" * 400 + " " + sample[500:700]]})
    joined = {"x": sample, "y": "ba" * 400 + " " + sample[500:700]}
    joined = {k: "".join(map(chr, language.normal_codes(v + " "))) for k, v in joined.items()}
    texts = [sample[100:2400], "ab" * 900, sample[10:90] * 15, "日本語" * 50 + "の文", "c", "".join(chr(0x4E00 + 17 * i % 2100) for i in range(700)), "q" * 300]
    parts = [language.normal_codes(t) for t in texts]
    want = [[slow_phrases(joined[k], "".join(map(chr, x))) for k in "xy"] for x in parts]
    for block, lanes in ((256, 4096), (7, 4096), (7, 5), (1, 3)):
        monkeypatch.setattr(language, "BLOCK", block)
        monkeypatch.setattr(language, "LANES", lanes)
        assert model.phrases([model.to_symbols(x) for x in parts]).tolist() == want


def test_very_long_text():
    model = language.Model({"x": ["the cat sat on the mat and the rat"], "y": ["der hund und die katze"]})
    names, _, rates = language.predict(model, ["the cat " * 300_000, "the cat " * 32])
    assert names == ["x", "x"] and abs(rates[0] - rates[1]) < 0.01


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id"))).collect()
    assert len(got) > 40
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    ids = duckdb.sql(f"select doc_id from '{sf_dir}/documents.parquet'").fetchall()
    assert sorted(r.doc_id for r in got) == sorted(i for (i,) in ids if zlib.crc32(str(i).encode()) % 3 == 1)


def test_edges(spark, edge_docs, empty_docs):
    model = language.learn(edge_docs)
    assert model.languages == ["de", "en"]
    got = language.identify(edge_docs, model).collect()
    assert len(got) == len(edge_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert by[4] == by[5] == by[6] == {("und", 0.0)}
    assert len(by[14]) == 1 and all(0 <= r.score <= 1 for r in got)
    none = language.learn(empty_docs)
    assert {r.lang_pred for r in language.identify(edge_docs, none).collect()} == {"und"}
    assert language.identify(empty_docs, model).count() == 0
    kept = language.filter_known(edge_docs, model, 10.0)
    assert kept.columns == edge_docs.columns and {4, 5, 6}.isdisjoint(r.doc_id for r in kept.collect())
    unlabelled = language.filter_known(edge_docs, none, 0.6).collect()
    assert len(unlabelled) == len(edge_rows()) - 4
