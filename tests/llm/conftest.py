import random

import pytest

EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "o ne"), (7, "été à la plage 😀"), (8, "x" * 5000), (9, "a b " * 3000),
    (10, "mail me at ann@example.org or +1 (427) 555-5262 from 10.0.0.1, card 4111 1111 1111 1111"), (None, "no id here"), (12, "same row"), (12, "same row"),
]


def words(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8))) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Edge cases, plain texts, and exact, near and passage copies of some."""
    rng = random.Random(11)
    out = list(EDGE)
    base = [words(rng, rng.randint(40, 300)) for _ in range(25)]
    out += [(100 + i, t) for i, t in enumerate(base)]
    out += [(200 + i, base[i % 5].replace(" ", "  ", i)) for i in range(8)]
    for i in range(8):
        parts = base[5 + i % 3].split()
        parts[rng.randrange(len(parts))] = "changed"
        out.append((300 + i, " ".join(parts)))
    passage = words(rng, 60)
    out += [(400 + i, f"{base[10 + i]} {passage} {base[11 + i]}") for i in range(3)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns whose names operators use themselves."""
    rows = [(i, t, ["en", "fr", None][k % 3], f"s{k % 4}", len(t or ""), k, "x", 1.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk int, kept string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
