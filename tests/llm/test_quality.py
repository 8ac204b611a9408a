import collections
import re

import numpy as np
from pyspark.sql import functions as F

from evenhand.llm import quality

from .conftest import with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), failed


def test_counts_and_scores_equal_brute_force(spark, docs, rows):
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    ratios = quality.model(docs, trusted)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        for i in range(len(data) - 2):
            bucket = quality.buckets_of(data[i : i + 3].decode("latin-1"))[0] if data[i : i + 3].isascii() else None
            if bucket is None:
                gram = int.from_bytes(data[i : i + 3], "big") * 0x9E3779B97F4A7C15 % 2**64
                bucket = (gram >> 32) % quality.BUCKETS
            raw[bucket] += 1
            target[bucket] += doc_id is not None and doc_id < 60 and doc_id % 2 == 0
    expected = np.log((target + 1) / (target.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    assert np.allclose(ratios, expected)
    names = [f.split()[0] for f in quality.RESULT.split(", ")]
    got = quality.assess(with_clashes(docs, names), ratios).collect()
    assert sorted(map(repr, (r["text"] for r in got))) == sorted(repr(r[1]) for r in rows)
    for r in got:
        assert r["more"] == "other"
        assert tuple(r[n] for n in names[:6]) == brute(r["text"])
        grams = quality.buckets_of(r["text"] or "")
        assert abs(r["score"] - expected[grams].sum() / (len(grams) + quality.PRIOR)) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_unlike_documents_go_and_empty_tables_work(spark, docs, empty, rows):
    junk = spark.createDataFrame([(1000 + i, " ".join(f"#{i}{j}&&&" for j in range(40))) for i in range(5)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(junk)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = quality.assess(both, quality.model(both, quality.trusted_ids(labels)))
    assert got.filter("doc_id >= 1000 and kept").count() == 0
    assert got.filter("doc_id < 1000 and not kept and not base_failed").count() == 0
    nobody = quality.trusted_ids(labels.limit(0))
    assert not quality.model(docs, nobody).any()
    assert not quality.model(empty, nobody).any()
    assert quality.assess(empty, np.zeros(quality.BUCKETS)).count() == 0
    assert quality.trusted_ids(labels.select("doc_id", "quality", F.lit(None).cast("int").alias("toxic")), most=7).count() == 7
