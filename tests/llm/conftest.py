import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, size string, shard string, t string, n string, key string, c_tokens string, c_row string, found string, range string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions beneath old stone towers near the silent river bank".split()


def sentence(seed: int, n: int) -> str:
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 50))
    return " ".join(out)


def edge_rows() -> list[tuple]:
    long = sentence(99, 30_000)
    texts = [
        (1, sentence(1, 120)), (2, sentence(1, 120)), (3, sentence(1, 119)), (4, ""), (5, None), (6, "  \n\t "), (7, "Ünïcode → 日本語 text"), (8, "AKIA only"), (9, long), (10, long + " tail"),
        (11, "x"), (12, "X"), (13, "a b c"), (14, sentence(2, 200)), (15, sentence(3, 60) + " " + sentence(1, 120)), (None, sentence(4, 80)), (None, None), (14, sentence(2, 200)), (16, "a" * 2500), (17, "ab" * 900 + "c"),
    ]
    out = []
    for i, (d, t) in enumerate(texts):
        out.append((d, t, None if i % 5 == 4 else ("en", "de")[i % 2], None if i % 7 == 3 else f"s{i % 3}", None if i % 6 == 5 else len(t or ""), *["clash"] * 11))
    return out


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
