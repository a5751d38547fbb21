import collections
import re
import zlib

import corpus_pipeline as p
from pyspark.sql import functions as F

from tidepool.llm import language, mixing
from tidepool.llm.shared import shared_dir

from .test_language import slow_phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_hits(text, windows):
    """Whether the text has a window of an item."""
    w = item_words(text)
    return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


def slow_language(docs):
    """Kept ids by a search for substrings of the sample; the sample is learn()'s."""
    model = language.learn(docs)
    kept = set()
    samples = {}
    real = language.Model.__init__

    def spy(self, chosen):
        samples.update(chosen)
        real(self, chosen)

    language.Model.__init__ = spy
    try:
        language.learn(docs)
    finally:
        language.Model.__init__ = real
    joined = {k: "".join("".join(map(chr, language.normal_codes(t))) + " " for t in v)[: language.SAMPLE_CHARS] for k, v in samples.items()}
    assert sorted(joined) == model.languages
    for r in docs.collect():
        normal = "".join(map(chr, language.normal_codes(r.text or "")))
        letters = sum(c != " " for c in normal)
        if letters and min(slow_phrases(x, normal) for x in joined.values()) <= p.MAX_RATE * letters:
            kept.add(r.doc_id)
    return kept


def slow_near(rows):
    """doc_ids that stay: of each component of Jaccard >= 0.8 the least."""
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if (not x and not y) or (both and both * 5 >= 4 * (len(x) + len(y) - both)):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {find(d) for d in ids}


def slow_mix(rows):
    """Kept ids by raking in plain numbers; probabilities bounded by one."""
    cells = collections.Counter()
    own = {}
    for r in rows:
        text = r.text or ""
        topic = "legal" if "licens" in text or "copyright" in text else "contact" if "@" in text else "table" if " | " in text else "prose"
        own[r.doc_id] = (r.source or "", r.lang or "", topic)
        cells[own[r.doc_id]] += len(WORD.findall(text))
    cells = {c: float(n) for c, n in cells.items() if n}
    total, keep = sum(cells.values()), mixing.KEEP
    goals = []
    for d in range(3):
        mass = collections.Counter()
        for c, n in cells.items():
            mass[c[d]] += n
        raw = {v: m**mixing.TEMPER for v, m in mass.items()}
        goals.append(level({v: m / keep for v, m in mass.items()}, raw, total))
    m = dict.fromkeys(cells, 1.0)
    for _ in range(400):
        for d in range(3):
            for v, goal in goals[d].items():
                mine = [c for c in cells if c[d] == v]
                new = level({c: cells[c] / keep for c in mine}, {c: cells[c] * m[c] for c in mine}, goal)
                for c in mine:
                    m[c] *= new[c] / (cells[c] * m[c]) if new[c] < cells[c] / keep * (1 - 1e-12) else max(1.0, new[c] / (cells[c] * m[c]))
    return {d: min(1.0, keep * min(cells[c] * m[c], cells[c] / keep) / cells[c]) if c in cells else 1.0 for d, c in own.items()}


def level(cap, x, goal):
    """least(cap, f * x) that sums to goal (all caps if they are less), by bisection."""
    if sum(cap.values()) <= goal:
        return dict(cap)
    low, high = 0.0, max(cap[k] / x[k] for k in x)
    for _ in range(200):
        f = (low + high) / 2
        low, high = (f, high) if sum(min(cap[k], f * x[k]) for k in x) < goal else (low, f)
    return {k: min(cap[k], high * x[k]) for k in x}


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # 1: language
    stage = p.identify_language(spark, docs, sf_dir)
    kept = {r.doc_id for r in stage.collect()}
    assert stage.columns == docs.columns and kept == slow_language(docs)
    # 2: one of each component
    known = docs.where(F.col("doc_id").isin(sorted(kept)))
    stage = p.drop_near_duplicates(spark, known, sf_dir)
    kept = slow_near([(d, rows[d].text) for d in sorted(kept)])
    assert sorted(r.doc_id for r in stage.collect()) == sorted(kept) and stage.columns == docs.columns
    # 3: no test item is left, and nothing else changed
    known = docs.where(F.col("doc_id").isin(sorted(kept)))
    clean = p.remove_benchmark(spark, known, sf_dir)
    words = [item_words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in words if w for i in range(max(1, len(w) - 9))}
    after = {r.doc_id: r for r in clean.collect()}
    assert not any(slow_hits(r.text, windows) for r in after.values()) and clean.columns == docs.columns
    untouched = {d for d in kept if not slow_hits(rows[d].text, windows)}
    assert untouched and all(after[d] == rows[d] for d in untouched)
    # 4: probabilities by raking in plain numbers decide
    mixed = {r.doc_id for r in p.mix_sources(spark, clean, sf_dir).collect()}
    told = {r.doc_id: r for r in clean.select("doc_id", *mixing.measured(clean)).collect()}
    want = slow_mix(after.values())
    assert all((told[d].c_draw < want[d]) == (d in mixed) for d in want if abs(told[d].c_draw - want[d]) > 2e-3)
    # 5: near equal bytes, gapless slots, each row once
    placed = p.shard(spark, clean, sf_dir).collect()
    assert sorted(r.doc_id for r in placed) == sorted(after)
    slots = collections.defaultdict(list)
    size = collections.Counter()
    for r in placed:
        slots[r.shard].append(r.slot)
        size[r.shard] += len((r.text or "").encode()) + 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(len((r.text or "").encode()) + 8 for r in placed)
    assert all(abs(size[k] - sum(size.values()) / 24) <= 2 * largest for k in range(24))


def test_run_chains_the_stages(spark, sf_dir):
    out = p.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < len(out) < docs.count() and len({r.doc_id for r in out}) == len(out)
    again = {(r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in p.run(spark, sf_dir).collect()}
    assert again == {(r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in out}


def test_edges_written_as_the_driver_does(spark, edge_docs, empty_docs, sf_dir, tmp_path):
    clashing = edge_docs
    for name in ("slot", "c_doc_id", "c_n", "c_near_key", "c_rows", "c_key", "n_rows"):
        clashing = clashing.withColumn(name, F.lit("clash"))
    for k, start in enumerate((clashing, empty_docs)):
        chained = start
        for name, stage in p.STAGES:
            # alone on all rows, and in the chain
            if k == 0 and name != "language":
                stage(spark, start, sf_dir).write.parquet(str(tmp_path / f"{k}-{name}-alone"))
            chained = stage(spark, chained, sf_dir)
            chained.write.parquet(path := str(tmp_path / f"{k}-{name}"))
            chained = spark.read.parquet(path)
            if name != "sharding":
                assert chained.columns == start.columns
    # every row is placed once: null and repeated ids too
    placed = spark.read.parquet(str(tmp_path / "0-sharding-alone")).collect()
    ids = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in placed))
    assert ids == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in edge_docs.collect())
    assert {r.c_doc_id for r in placed} == {"clash"} and all(isinstance(r.shard, int) for r in placed)
    kept = spark.read.parquet(str(tmp_path / "0-near_dedup-alone")).collect()
    ids = [r.doc_id for r in kept]
    # a null id with a text of its own stays
    assert ids.count(None) == 1 and len(ids) == len(set(ids)) and 14 in ids and 2 not in ids


def test_repeated_and_null_ids(spark, sf_dir):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, a), (1, b), (None, b + " x y z u v w q"), (None, "alpha beta gamma delta eps zeta"), (3, a), (3, a)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in p.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == sorted([("1", a), ("1", b), ("None", b + " x y z u v w q"), ("None", "alpha beta gamma delta eps zeta")])


def test_a_shared_folder_is_required_on_a_cluster():
    import pytest

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
