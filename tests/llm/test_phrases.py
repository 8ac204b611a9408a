import random
import re
from collections import Counter

import numpy as np
import pytest

from evenhand.llm import phrases
from tests.llm.conftest import with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least, longest=5, top=2000):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        sizes[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    often = {p: f for p, f in counts.items() if f >= least}
    out = {}
    for p, a in often.items():
        lang, words = p[0], p[1:]
        if len(words) < 2:
            continue
        inside = any(f >= a and len(q) > len(p) and q[0] == lang and any(q[i : i + len(words)] == words for i in range(1, len(q))) for q, f in often.items())
        if not inside:
            n = sizes[lang]
            cuts = [(1000 * a * n // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]], n))
    found = []
    for lang, listed in out.items():
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(listed)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(found)


def corpus(seed=2, count=150):
    rng = random.Random(seed)
    words = ["The", "the", "red", "Ünter", "fox", "ran", "to", "so", "x", "y\x00z", "naïve", "of"]
    rows = []
    for _ in range(count):
        said = [rng.choice(words) for _ in range(rng.choice([2, 9, 40]))]
        if rng.random() < 0.4:
            said[1:1] = rng.choice([["new", "york", "city"], ["as", "soon", "as", "possible", "to", "day"], ["ha"] * 7])
        text = "".join(w + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!? "]) for w in said)
        rows.append((text, rng.choice(["en", "en", "en", "de", None])))
    rows += [(None, "en"), ("", None), (None, None), (" \t ", "fr"), ("ha " * 4000, "en"), ("字 " * 900, "zh"), rows[0], rows[0], ("und so weiter " * 20, "und")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)


@pytest.mark.parametrize("share", [1e-6, 0.3, 1.0])
@pytest.mark.parametrize("least", [4, 25])
def test_equals_brute_force_whatever_the_sample(spark, share, least):
    """With an empty sample all words are border and every frequent phrase is a failure or found around one."""
    rows = corpus()
    found = phrases.collocations(table(spark, rows), least=least, share=share)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, least)


def test_ranks_stop_at_the_top_and_can_be_left_out(spark):
    rows = corpus(7)
    found = phrases.collocations(table(spark, rows), least=4, top=5, share=0.3)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, 4, top=5)
    every = phrases.collocations(table(spark, rows), least=4, top=None, share=0.3)
    assert every.count() == len(brute_force(rows, 4, top=10**9))


@pytest.mark.parametrize("longest", [2, 3])
def test_shorter_phrases(spark, longest):
    rows = corpus(8, 80)
    found = phrases.collocations(table(spark, rows), least=5, longest=longest, share=0.5)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, 5, longest)


def test_a_full_filter_only_counts_more(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "HELD", 40)
    monkeypatch.setattr(phrases, "PER_RANGE", 500)
    rows = corpus(5, 60)
    found = phrases.collocations(table(spark, rows), least=4, share=0.3)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, 4)


def test_scores_beyond_64_bits(spark):
    counted = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 900_000_000_000_000, 5_000_000_000_000)], "f long, l long, n long, r long")
    from pyspark.sql import functions as F

    upper = F.lit(1000).cast("decimal(4,0)") * phrases._whole(F.col("f")) * phrases._whole(F.col("n"))
    row = counted.select(upper.alias("_upper"), (phrases._whole(F.col("l")) * phrases._whole(F.col("r"))).alias("_lower")).selectExpr("_upper div _lower as score").first()
    assert row.score == 1000 * 3_000_000_000_000 * 900_000_000_000_000 // (4_000_000_000_000 * 5_000_000_000_000)


def test_equal_first_hashes_are_told_apart():
    g = np.array([5, 7, 5, 5, 7], np.uint64)
    e = np.array([1, 3, 9, 1, 3], np.uint32)
    order, first = phrases._groups(g, e)
    assert [(int(g[order[i]]), int(e[order[i]])) for i in first] == [(5, 1), (5, 9), (7, 3)]


def test_clashing_columns_and_empty_tables(spark, docs, empty):
    found = phrases.collocations(with_clashes(docs, ["rank", "phrase", "a", "n", "score", "f"]), least=20).collect()
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, found)) == brute_force(rows, 20)
    assert phrases.collocations(empty).collect() == []
