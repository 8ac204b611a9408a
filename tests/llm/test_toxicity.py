import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import toxicity
from tests.llm.conftest import with_clashes

LABELS = "doc_id long, quality int, toxic int"


def talk(count=900, seed=4):
    """Texts that are toxic where an insult meets a group's name; each alone is harmless more often than not."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "lo")]
    rows, labels = [], []
    for i in range(count):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 60, 200]))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            words.insert(rng.randrange(len(words)), rng.choice(["grumph", "Grumphling!", "GRUMPHISH"]))
        if group:
            words.insert(rng.randrange(len(words)), "zorblins")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = talk()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    given = spark.createDataFrame(labels, LABELS)
    return docs, toxicity.fit(toxicity.labelled(docs, given)), dict((i, t) for i, _, t in labels)


def test_value_is_the_sum_over_terms_and_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(9), rng.normal(size=9), rng.normal(size=(9, 4)), -0.7)
    for terms in ([], [2], [0, 3], [1, 4, 5, 8], list(range(9))):
        pairs = sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(terms) for j in terms[n + 1 :])
        assert machine.value(terms) == pytest.approx(-0.7 + machine.weights[terms].sum() + pairs)


def test_held_out_documents_are_told_apart_by_a_pair(spark, fitted):
    docs, machine, truth = fitted
    found = toxicity.score(docs, machine).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    number = {int(b): i for i, b in enumerate(machine.buckets)}
    insult, group = (toxicity.Terms(number).of(w) for w in ("grumph", "zorblins"))
    alone = machine.value(sorted(insult)) - machine.constant + machine.value(sorted(group)) - machine.constant
    assert machine.value(sorted(insult | group)) - machine.constant > alone  # the pair adds to what both weigh alone


def test_scores_match_a_plain_loop(spark, fitted):
    docs, machine, _ = fitted
    number = {int(b): i for i, b in enumerate(machine.buckets)}
    for row in toxicity.score(docs, machine).limit(60).collect():
        terms = sorted(toxicity.Terms(number).of(row.text))
        value = machine.constant + sum(machine.weights[t] for t in terms)
        value += sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(terms) for b in terms[i + 1 :])
        assert row.score == pytest.approx(1 / (1 + np.exp(-value)), abs=1e-9)
        assert row.predicted == int(row.score >= 0.5) and row.n_terms == len(terms)


def test_selected_terms_match_a_count(spark):
    rows, labels = talk(200, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = toxicity.labelled(docs, spark.createDataFrame(labels, LABELS))
    texts = [(r.text, r.label) for r in given.collect()]
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    terms, total, toxic = toxicity.Terms(), len(texts), sum(y for _, y in texts)
    counts = {}
    for text, label in texts:
        for t in terms.of(text):
            n, k = counts.get(t, (0, 0))
            counts[t] = (n + 1, k + label)

    def ratio(n, k):
        cells = [(k, n * toxic / total), (n - k, n * (1 - toxic / total)), (toxic - k, (total - n) * toxic / total), (total - toxic - n + k, (total - n) * (1 - toxic / total))]
        return sum(2 * o * np.log(o / e) for o, e in cells if o > 0)

    want = {t for t, (n, k) in counts.items() if n >= 3 and ratio(n, k) >= 25}
    assert set(toxicity.select_terms(given)) == want and want
    assert toxicity.select_terms(given, most=1)[0] in want


def test_sample_is_bounded_and_stable(spark):
    rows, labels = talk(400, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels + labels[:50] + [(None, 1, 1), (5, 1, None)], LABELS)
    first, again = (sorted(map(tuple, toxicity.labelled(docs, given.repartition(n), most=100).collect())) for n in (2, 5))
    assert first == again and len(first) == 100


def test_odd_texts_and_clashing_columns(spark, docs, rows, fitted):
    _, machine, _ = fitted
    found = toxicity.score(with_clashes(docs, ["score", "predicted", "n_terms"]), machine).collect()
    assert len(found) == len(rows)
    bare = 1 / (1 + np.exp(-machine.constant))
    for r in found:
        assert 0 <= r.score <= 1 and r.more == "other"
        if not r.text or not r.text.strip():
            assert r.score == pytest.approx(bare) and r.n_terms == 0


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_kind(spark, docs, label):
    given = spark.createDataFrame([(i, 1, label) for i in range(40)], LABELS)
    machine = toxicity.fit(toxicity.labelled(docs, given))
    assert {r.predicted for r in toxicity.score(docs, machine).collect()} == {label}


def test_empty_tables(spark, docs, empty):
    machine = toxicity.fit(toxicity.labelled(docs, spark.createDataFrame([], LABELS)))
    assert {round(r.score, 9) for r in toxicity.score(docs, machine).collect()} == {0.5}
    assert toxicity.score(empty, machine).collect() == []
