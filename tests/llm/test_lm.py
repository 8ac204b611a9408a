import collections
import math
import zlib

import numpy as np
import pytest

from evenhand.llm import lm
from evenhand.llm.common import WordHashes

from .conftest import with_clashes


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.mark.parametrize(("head", "most_mb"), [(lm.HEAD, 512), (50, 512), (0, 0.02)])
def test_scores_equal_exact_counts_and_the_filter(spark, docs, rows, head, most_mb):
    marked = docs.withColumn("held_out", lm.is_held_out())
    model = lm.train(marked.filter("not held_out"), buckets=16)
    got = lm.score(with_clashes(marked, ["score", "n_known"]), model, head=head, most_mb=most_mb).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    words, pairs, started = collections.Counter(), collections.Counter(), 0
    for doc_id, text, *_ in rows:
        if not held(doc_id):
            t = tokens(text)
            words.update(t)
            pairs.update(zip([0, *t], t, strict=False))
            started += 1
    total = sum(words.values())
    below = total + 0.5 * (len(words) + 1)
    typical = lm.typical_counts()
    level = lambda n: float(typical[lm.level_of(np.array([n]))[0]]) if n else 0.0
    expected = []
    for doc_id, text, *_ in rows:
        t, score = tokens(text), 0.0
        for h, w in zip([0, *t], t, strict=False):
            unigram = (level(words[w]) + 0.5) / below
            history = started if h == 0 else level(words[h])
            pair = min(level(pairs[h, w]), history)
            score += math.log10(lm.SHARE * pair / history + (1 - lm.SHARE) * unigram if history else unigram)
        base = sum(math.log10((words[w] + 0.5) / below) for w in t)
        expected.append((doc_id, held(doc_id), len(t), sum(words[w] > 0 for w in t), base, score))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got]
    key = lambda r: (repr(r[0]), r[2], round(r[4], 4))
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))
        assert abs(a[5] - b[5]) <= 0.02 * abs(b[5]) + 1  # the filter lets a few unseen n-grams through


def test_the_filter_never_forgets_and_seldom_invents():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2))
    counts = rng.geometric(0.4, len(keys))
    bits = lm.segment(keys, counts)
    filter_ = lm.Filter(1, {(lm.PAIRS, 0): len(bits)})
    filter_.put(lm.PAIRS, 0, bits)
    levels = filter_.levels(lm.PAIRS, keys)
    assert (levels >= lm.level_of(counts)).all() and (levels > lm.level_of(counts)).mean() < 0.02
    assert (filter_.levels(lm.PAIRS, keys + np.uint64(1)) > 0).mean() < 0.02
    assert not filter_.levels(lm.WORDS, keys).any()


def test_levels_and_their_counts():
    n = np.arange(1, 5000)
    levels = lm.level_of(n)
    assert (np.diff(levels) >= 0).all() and levels[0] == 1
    assert (np.abs(lm.typical_counts()[levels] - n) <= 0.34 * n).all()


def test_held_out_copies_score_better_and_empty_models_work(spark, docs, empty):
    nothing = lm.train(empty)
    got = lm.score(docs.select("doc_id", "text"), nothing).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)
    model = lm.train(docs)
    assert lm.score(empty, model).count() == 0
    scored = lm.score(docs.filter("doc_id = 50"), model).first()
    assert scored["score"] > scored["base_score"]


def test_hash_memory_is_bounded():
    hashes = WordHashes(most=10)
    hashes.of([str(i).encode() for i in range(1000)])
    assert len(hashes) == 10
