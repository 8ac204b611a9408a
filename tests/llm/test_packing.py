import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenhand.llm import packing
from evenhand.llm.tokens import Encoder, default_path

from .conftest import with_clashes


def test_ids_equal_the_tokenizers(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    encoder = Encoder(most=50)  # small, so that memories are cleared on the way
    odd = ["it's we'LL x's", "ab<|endoftext|>cd <|startoftext|>", "İstanbul Σίσυφος ΟΔΟΣ ﬁn Å", "a\tb\x0bc d e\x1ff", "x" * 500, "ª²½ µß'S", "😀 é".encode("utf-16", "surrogatepass").decode("utf-16")]
    for text in [r[1] for r in rows if r[1]] + odd + [""]:
        got = np.frombuffer(encoder.encode(text), "<u2").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("form", ["a{}b", "{}b", "a{}", "x a {} b"])
def test_every_character_encodes_as_the_tokenizer_does(form):
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(default_path()), Encoder()
    texts = [form.format(chr(c)) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    expected = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, ids in zip(texts, expected) if np.frombuffer(encoder.encode(t), "<u2").tolist() != ids]
    assert not wrong, [hex(ord(c)) for t in wrong[:20] for c in t]


def naive_best_fit(lengths, window):
    room, placed = [], []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= length]
        if fits:
            _, i = min(fits)
        else:
            room.append(window)
            i = len(room) - 1
        placed.append((length, window - room[i]))
        room[i] -= length
    return sorted(placed), sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_runs_are_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    placed, room, used = [], {}, set()
    for length, first, last, sequence, offset in packing.best_fit(counts, 64):
        for i in range(last - first):
            assert (sequence + i, offset) not in used
            used.add((sequence + i, offset))
            placed.append((length, offset))
            room[sequence + i] = room.get(sequence + i, 64) - length
    expected, expected_room = naive_best_fit(lengths, 64)
    assert sorted(room.values()) == expected_room
    assert sorted(n for n, _ in placed) == sorted(lengths)


@pytest.mark.parametrize("window", [4096, 64])
def test_pieces_cover_documents_and_sequences_have_no_gaps(spark, docs, rows, window):
    packed = packing.pack(with_clashes(docs, ["offset", "sequence_id", "length", "ids"]), window=window).toPandas()
    encoder = Encoder()
    whole = [tuple(np.frombuffer(encoder.encode(r[1]), "<u2").tolist()) + (packing.END,) for r in rows]
    assert packed["length"].sum() == sum(map(len, whole))
    pieces = sorted((zlib.crc32(np.array(w[s : s + window], "<u4").tobytes()), s, len(w)) for w in whole for s in range(0, len(w), window))
    assert pieces == sorted(zip(packed["ids"].map(zlib.crc32), packed["start"], packed["doc_tokens"], strict=True))
    packed = packed.sort_values(["sequence_id", "offset"])
    ends = packed.groupby("sequence_id")["length"].cumsum()
    assert (packed["offset"] == ends - packed["length"]).all() and ends.max() <= window
    assert packed["sequence_id"].nunique() == packed["sequence_id"].max() + 1 == len(naive_best_fit(packed["length"], window)[1])


def test_sequences_are_padded_and_empty_tables_work(spark, docs, empty):
    packed = packing.pack(docs)
    rows = packing.sequences(packed).collect()
    assert sum(r["length"] for r in rows) == packed.agg({"length": "sum"}).first()[0]
    for r in rows:
        size = len(r["ids"]) // 4
        assert size == 4096 or (size == r["length"] and size & (size - 1) == 0)
    assert packing.pack(empty).count() == 0


def test_the_tree_finds_the_tightest_capacity():
    rng, tree, open_ = random.Random(2), packing.Capacities(100), set()
    for _ in range(3000):
        c = rng.randrange(101)
        (open_.add if rng.random() < 0.5 else open_.discard)(c)
        tree.set(c, c in open_)
        want = rng.randrange(101)
        assert tree.least(want) == min((o for o in open_ if o >= want), default=None)


def test_used_sequences_are_filled_before_the_next_one():
    rng = random.Random(6)
    cases = [[33, 33, 1, 1], [40] * 5 + [7] * 11, [33, 33, 33, 10, 10, 10, 10, 10, 1, 1, 1]]
    cases += [[rng.choice([1, 2, 3, 5, 9, 20, 33, 40]) for _ in range(rng.randrange(80))] for _ in range(400)]
    for lengths in cases:
        room = {}
        for length, first, last, sequence, offset in packing.best_fit({n: lengths.count(n) for n in set(lengths)}, 64):
            for i in range(sequence, sequence + last - first):
                assert room.get(i, 64) == 64 - offset
                room[i] = 64 - offset - length
        assert sorted(room.values()) == naive_best_fit(lengths, 64)[1]
