import random

from pyspark.sql import functions as F

from evenhand.llm import edits
from evenhand.llm.tokens import Encoder, default_path

from .conftest import prose, with_clashes


def whole(text, tokenizer):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def own_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_counts_after_many_edits_equal_encoding_afresh():
    rng, encoder, fresh = random.Random(5), Encoder(), own_tokenizer()
    for size in (0, 1, 2, 3, 17, 200):
        for _ in range(25):
            text = prose(rng, size) if size else ""
            tree = edits.CountTree(text, encoder)
            assert (tree.n_chars, tree.n_tokens) == (len(text), whole(text, fresh))
            for _ in range(12):
                start = rng.randint(0, len(text) + 2)
                stop = start + rng.choice([0, 0, 1, 5, 40, len(text)])
                new = rng.choice(["", " ", "x", "it's", "a b\nc ", "\n\n", "né " * 3, "a\x08b\x7f \x1c", "漢 e\u0301"])
                tree.edit(start, stop, new)
                text = text[:start] + new + text[stop:]
                assert tree.present() == text
                assert (tree.n_chars, tree.n_tokens) == (len(text), whole(text, fresh)), repr(text)


def test_only_touched_words_are_encoded_again():
    tree = edits.CountTree(prose(random.Random(6), 5000), Encoder())
    tree.edit(9000, 9010, "new words here")
    assert tree.reencoded < 12


def test_operator(spark, docs, empty, rows):
    names = [f.split()[0] for f in edits.RESULT.split(", ")]
    frame = with_clashes(docs, names)
    got = edits.count(frame, edits.sample_edits(), with_text=True).collect()
    assert len(got) == len(rows) and got[0]["more"] == "other"
    encoder = own_tokenizer()
    asked = {repr((r[0], r[1])): r[2] for r in docs.select("doc_id", "text", edits.sample_edits()).collect()}
    for r in got:
        text = r["text"] or ""
        assert (r["n_chars"], r["n_tokens"]) == (len(text), whole(text, encoder))
        after = []
        for e in asked[repr((r["doc_id"], r["text"]))] if r["doc_id"] is not None else []:
            start = min(e["start"], len(text))
            stop = min(max(e["stop"], start), len(text))
            text = text[:start] + e["new"] + text[stop:]
            after.append(whole(text, encoder))
        if r["doc_id"] is not None:
            assert r["edited_text"] == text and r["tokens_after"] == after
        assert r["edited_tokens"] == whole(r["edited_text"], encoder) and r["edited_chars"] == len(r["edited_text"])
    nothing = edits.count(docs, F.lit(None).cast("array<struct<start:int,stop:int,new:string>>")).collect()
    assert all(r["edited_tokens"] == r["n_tokens"] and r["n_reencoded"] == 0 for r in nothing)
    holes = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(3).alias("stop"), F.lit("x").alias("new")))
    assert all(r["edited_tokens"] == r["n_tokens"] for r in edits.count(docs, holes).collect())
    assert edits.count(empty, edits.sample_edits()).count() == 0
