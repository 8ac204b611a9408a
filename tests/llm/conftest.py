import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    made = [f"w{int(rng.paretovariate(0.7)) % vocabulary}" + rng.choice(["", "", "", ",", "."]) for _ in range(words)]
    return " ".join(w.capitalize() if rng.random() < 0.1 else w for w in made).replace(". ", ".\n")


def corpus(seed: int = 1, count: int = 120) -> list[tuple]:
    """Documents with copies, near copies, a shared passage, nulls, empty, short and very long texts and repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(count):
        text = prose(rng, rng.choice([3, 12, 40, 150, 300]))
        if i % 7 == 3 and rows:
            text = rng.choice(rows)[1] or text
        if i % 7 == 5 and rows:
            words = (rng.choice(rows)[1] or text).split(" ")
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 9 == 0:
            text = text + "\n" + passage
        rows.append((i, text, "en", f"s{i % 4}" if i % 5 else "s0", len(text)))
    long = prose(rng, 30_000)
    rows += [
        (count, None, None, None, None),
        (count + 1, "", "en", "s1", 0),
        (count + 2, " \t\n ", "en", None, 4),
        (count + 3, "one", "en", "s1", 3),
        (count + 4, "漢字" * 3000, "zh", "s2", 6000),
        (count + 5, long, "en", "s2", len(long)),
        (None, "no id " * 20, "en", "s3", 120),
        (None, "no id either " * 20, None, None, None),
        (None, None, None, None, None),
        rows[0],
        rows[0],
        (count, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(docs, names):
    """``docs`` with further columns whose names the operator uses for its results."""
    from pyspark.sql import functions as F

    return docs.select("*", F.lit("other").alias("more"), *[F.lit("clash").alias(n) for n in names])
