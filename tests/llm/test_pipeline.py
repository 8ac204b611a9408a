import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from evenhand.llm import pii, quality
from evenhand.llm.common import stored
from evenhand.llm.tokens import Encoder

from .conftest import with_clashes
from .test_jaccard import sets_of
from .test_mixing import target_of


def test_each_stage_and_the_whole_equal_brute_force(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, base), "test-stage")
        frames.append(docs.collect())
    good, single, clean, mixed, packed = frames
    for rows in frames[:-1]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]

    trusted = quality.trusted_ids(spark.read.parquet(f"{base}/labels.parquet"))
    ratios = quality.model(spark.read.parquet(f"{base}/documents.parquet"), trusted)
    verdict = {r["doc_id"]: r["kept"] for r in quality.assess(spark.read.parquet(f"{base}/documents.parquet"), ratios).collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(i for i, kept in verdict.items() if kept)

    rows = sorted((tuple(r) for r in good), key=lambda r: r[0])
    sets, root = sets_of(rows, 5), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r["doc_id"] for r in single) == [rows[i][0] for i in range(len(rows)) if find(i) == i]

    before = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        text = before[r["doc_id"]]
        spans = pii.in_order(pii.plain(text) + pii.disguised(text, pii.plain(text)))
        assert r["text"] == pii.redacted(text, spans) and r["n_chars"] == len(r["text"])
        assert not pii.plain(r["text"])
    assert len(clean) == len(single)

    words = lambda r: len(r["text"].encode().split())
    sizes, taken, copies = {}, {}, {}
    for r in clean:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r)
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r)
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3 and {tuple(r) for r in mixed} <= {tuple(r) for r in clean}
    for source, target in target_of(sizes).items():
        assert abs(taken.get(source, 0) - target) <= max(words(r) for r in clean if r["source"] == source)

    encoder, pieces = Encoder(), []
    for r in mixed:
        ids = np.append(np.frombuffer(encoder.encode(r["text"]), "<u2"), 2).astype("<u4")
        pieces += [(r["doc_id"], s, len(ids), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    assert sorted(pieces) == sorted((r["doc_id"], r["start"], r["doc_tokens"], r["ids_crc32"]) for r in packed)

    whole = corpus_pipeline.run(spark, base).collect()
    key = lambda r: (r["doc_id"], r["start"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    assert len(given) > len(good) > len(single)


def test_all_stages_take_nulls_and_empty_tables(spark, docs, empty, base):
    for frame in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            frame = stored(stage(spark, frame, base), "test-stage")
        assert "sequence_id" in frame.columns
    assert frame.count() == 0


def test_stages_carry_columns_named_like_results(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    names = [f.split()[0] for f in (quality.RESULT + ", " + pii.RESULT).split(", ")]
    names += ["redacted", "size", "source_size", "target", "copies", "taken", "_key", "a.b"]
    extra = with_clashes(docs, names)
    extra = extra.withColumn("size", F.octet_length("text"))
    extra, docs = stored(extra, "test-extra"), stored(docs, "test-plain")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stored(stage(spark, extra, base), "test-stage")
        assert got.columns == extra.columns and got.count()
        given = ["doc_id", "text", "lang", "source", "n_chars"]
        expected = stage(spark, docs, base).select(given).collect()
        assert sorted(map(repr, got.select(given).collect())) == sorted(map(repr, expected))
        kept = {tuple(r) for r in got.select(*[f"`{n}`" for n in names if n != "size"]).collect()}
        assert kept == {("clash",) * (len(names) - 1)}
        sizes = {(r["doc_id"], r["size"]) for r in got.collect()}
        assert sizes <= {(r["doc_id"], r["size"]) for r in extra.collect()}
