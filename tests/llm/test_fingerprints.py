import random
import re

from pyspark.sql import functions as F

from evenhand.llm import fingerprints
from evenhand.llm.queries import op5_closed_syncmers

from .conftest import with_clashes


def units(text):
    """Three characters from a word's start on, or one with 16 of its word before or after it."""
    out = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        at = 0
        while at < len(word):
            n = 1 if len(word) - at > 16 or at >= 16 else 3
            out.append(word[at : at + n])
            at += n
    return out


def test_anchors_are_the_closed_syncmers(spark, docs, rows, empty):
    got = fingerprints.fingerprint(with_clashes(docs, ["positions", "hashes", "fingerprint"])).collect()
    assert len(got) == len(rows) and got[0]["more"] == "other"
    inner = {}
    before = fingerprints.K - 1
    padded = {r[1]: [None] * before + units(r[1]) for r in rows}
    pairs = {p for u in padded.values() for p in zip(u, u[1:], strict=False)}
    table = spark.createDataFrame(list(pairs), "a string, b string")
    one, other = (F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c)) for c in "ab")
    for r in table.select("a", "b", F.xxhash64(one, other).alias("h")).collect():
        inner[r["a"], r["b"]] = r["h"]
    for r in got:
        u = padded[r["text"]]
        h = [inner[p] for p in zip(u, u[1:], strict=False)]
        w = fingerprints.K - fingerprints.S + 1
        runs = range(len(u) - fingerprints.K + 1)
        expected = [i + 1 - before for i in runs if min(h[i : i + w]) in (h[i], h[i + w - 1])] or [i + 1 - before for i in runs]
        assert r["positions"] == expected
        assert len(r["hashes"]) == len(expected) and all(0 <= x < 2**31 for x in r["hashes"])
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.fingerprint(empty).count() == 0


def test_equal_passages_have_equal_anchors_wherever_they_stand(spark):
    rng = random.Random(4)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(100)]
    left = [f"a{i}" for i in range(37)]
    frame = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(left + passage + left))], "doc_id long, text string")
    alone, inside = fingerprints.fingerprint(frame).orderBy("doc_id").collect()
    ahead = len(units(" ".join(left)))
    moved = {(p - ahead, h) for p, h in zip(inside["positions"], inside["hashes"], strict=True)}
    found = {(p, h) for p, h in zip(alone["positions"], alone["hashes"], strict=True) if p > 0}
    assert len(found) > 60 and found <= moved


def chain(rows):
    """Next row by descending id, missing ids last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0)))
    return {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}


def test_next_row_by_descending_id(spark, empty):
    for ids in ([5], [3, 9], list(range(0, 4000, 7)), [10**12, -5, 0, 17], [4, None]):
        frame = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string").repartition(3)
        frame = frame.withColumn("_hash", F.xxhash64("text"))
        got = {r["text"]: r["next_text"] for r in fingerprints.with_next(frame, ["text"]).collect()}
        rows = [(i,) for i in ids]
        assert got == {f"text of {ids[a]}": f"text of {ids[b]}" for a, b in chain(rows).items()}
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, "d")], "doc_id long, text string")
    got = fingerprints.with_next(ties.withColumn("_hash", F.xxhash64("text")), ["text"]).collect()
    assert len(got) == 6
    assert sorted(r["next_text"] for r in got) == ["a", "a", "b", "c", "c", "d"]
    assert fingerprints.with_next(empty.withColumn("_hash", F.xxhash64("text")), ["text"]).count() == 0


def test_query_edits_and_likeness(spark, base):
    rows = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()
    following = chain(rows)
    got = {r["doc_id"]: r for r in op5_closed_syncmers(spark, base).collect()}
    assert len(got) == len(rows)
    import hashlib

    for i, r in enumerate(rows):
        half = len(r["text"]) // 2
        after = rows[following[i]]
        edited = r["text"][: len(r["text"]) - half] + after["text"][:half]
        out = got[r["doc_id"]]
        assert out["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out["n_chars"] == len(r["text"])
        a, b, c = (set(f.split()) for f in (out["fingerprint"], out["edited_fingerprint"], got[after["doc_id"]]["fingerprint"]))
        for near, other in ((out["near_edited"], b), (out["near_next"], c)):
            assert abs(near - (len(a & other) / len(a | other) if a | other else 1.0)) < 1e-12


def test_short_edited_and_shifted_unspaced_texts_are_like_their_source(spark, tmp_path):
    rng = random.Random(5)
    unspaced = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(600))
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = [
        "a sentence of six words only",
        " ".join(words[:12]),
        unspaced,
        unspaced[:50] + "x" + unspaced[50:],
        " ".join(words[:12]) + " " + " ".join(words[20:]),
        "",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_closed_syncmers(spark, str(tmp_path)).collect()}
    assert got[0]["near_edited"] > 0.1 and got[1]["near_edited"] > 0.1
    assert got[3]["near_next"] > 0.9  # the next one down, without the inserted character
    short, long = (set(got[i]["fingerprint"].split()) for i in (1, 4))
    assert short & long  # a passage of 12 words
    assert got[5]["fingerprint"] == ""


def test_likeness_does_not_jump_with_the_length(spark):
    """A text with itself and a few characters more, and with its first half, at lengths from 64 to 2,000."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["ta", "re", "oni", "ing", "s", "the", "qu"]) for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(3000)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(12_000))
    rows = []
    for n in [64, 100, 160, 260, 271, 272, 273, 274, 300, 600, 1000, 2000]:
        for _ in range(25):
            at = rng.randrange(len(prose) - n)
            text = prose[at : at + n]
            rows += [(n, "half", text, text[: n // 2]), (n, "more", text, text + " added"[: rng.choice([3, 6])])]
    frame = spark.createDataFrame(rows, "n int, kind string, a string, b string")
    for c in "ab":
        frame = fingerprints.with_anchors(frame, F.col(c), f"{c}_at", f"{c}_hashes")
    near = fingerprints.likeness(F.col("a_hashes"), F.col("b_hashes"))
    found = {(r["n"], r["kind"]): (r["mean"], r["least"]) for r in frame.groupBy("n", "kind").agg(F.avg(near).alias("mean"), F.min(near).alias("least")).collect()}
    for (n, kind), (mean, least) in found.items():
        if kind == "half":
            assert 0.42 < mean < 0.6 and least > 0.2, (n, mean, least)
        else:
            assert mean > (0.9 if n >= 250 else 0.75), (n, mean)


def test_small_windows(spark, docs):
    for k, s in ((2, 1), (3, 1), (3, 2), (4, 1), (9, 4)):
        for r in fingerprints.fingerprint(docs, k=k, s=s).collect():
            assert bool(r["positions"]) == bool(units(r["text"]))
