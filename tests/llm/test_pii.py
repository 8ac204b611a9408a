import hashlib
import random
import re

import pytest

from evenhand.llm import pii

from .conftest import with_clashes


def brute(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and check % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return pii.in_order(found)


def test_plain_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "B", ".", ".", "@", "1", "2", "59", "+", "-", " ", "(", ")", "%", "_", "é", "255", "4111111111111111", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.plain(text) == brute(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 150_000, "+1(" * 100_000):
        pii.plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("so john dot doe at example dot com.", "email", "john dot doe at example dot com"),
        ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
        ("no. ４１１１ 1111 1111 1111 ok", "card", "４１１１ 1111 1111 1111"),
        ("at 192[.]168[.]0[.]1 now", "ip", "192[.]168[.]0[.]1"),
        ("a j​ohn@mail.example.org", "email", "j​ohn@mail.example.org"),
        ("cero uno dos tres cuatro cinco seis siete ocho nueve", "phone", "cero uno dos tres cuatro cinco seis siete ocho nueve"),
    ],
)
def test_disguises_are_found_at_their_place_in_the_source(text, kind, part):
    start = text.index(part)
    assert (kind, start, start + len(part)) in pii.disguised(text, pii.plain(text))


@pytest.mark.parametrize(
    "text",
    ["look at the dot com", "we met at noon (at home) and one two three went", "naïve ünïcode 3.14.15", "Это текст без данных", "five (5) dots ..."],
)
def test_clean_texts_are_left_alone(text):
    assert pii.plain(text) == pii.disguised(text, []) == []


def test_operator(spark, docs, empty, rows):
    more = [(2000, "write a@b.cd or +1 (234) 567-8900", None, None, 5), (2001, "me [at] x.yz, 10.0.0.1", None, None, 5)]
    all_docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    names = [f.split()[0] for f in pii.RESULT.split(", ")] + ["redacted"]
    got = pii.find(with_clashes(all_docs, names), redact=True).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        base = brute(r["text"] or "")
        assert r["more"] == "other"
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.as_text(base).encode()).hexdigest()
        if not r["spans"]:
            assert r["redacted"] == r["text"]
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2000]["redacted"] == "write <EMAIL> or <PHONE>"
    assert by_id[2001]["redacted"] == "<EMAIL>, <IP>"
    assert by_id[2001]["spans"] == "email:0:12,ip:14:22"
    assert pii.find(empty, redact=True).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("ask jane@example dot com today", "email", "jane@example dot com"),
        ("ask jane at example [dot] com today", "email", "jane at example [dot] com"),
        ("ask me at mail.example dot com today", "email", "me at mail.example dot com"),
        ("ask: jane dot doe [at] example dot com, today", "email", "jane dot doe [at] example dot com"),
        ("ask: jane (dot) doe@example.com", "email", "jane (dot) doe@example.com"),
        ("ask: jane.doe {at} mail dot example [.] org", "email", "jane.doe {at} mail dot example [.] org"),
        ("ring +49 one seven one five five five 1 2 3 4 now", "phone", "+49 one seven one five five five 1 2 3 4"),
        ("ring plus 49 171 five five five 1234 now", "phone", "plus 49 171 five five five 1234"),
        ("ring 0171 five five five 12 34, now", "phone", "0171 five five five 12 34"),
        ("in 2020 1999 one five five five one two three four five six seven", "phone", "one five five five one two three four five six seven"),
        ("card 4111 1111 1111 one one one one ok", "card", "4111 1111 1111 one one one one"),
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host one nine two.one six eight.zero.one up", "ip", "one nine two.one six eight.zero.one"),
        ("host 10 dot 0 dot 0 dot seven up", "ip", "10 dot 0 dot 0 dot seven"),
        ("no. ൪൧൧൧ 1111 1111 1111 ok", "card", "൪൧൧൧ 1111 1111 1111"),
        ("no. 𝟒𝟏𝟏𝟏 1111 1111 1111 ok", "card", "𝟒𝟏𝟏𝟏 1111 1111 1111"),
        ("x 𝐣𝐚𝐧𝐞@ⓔxample﹒com y", "email", "𝐣𝐚𝐧𝐞@ⓔxample﹒com"),
        ("x jane＠ﬁsh.org y", "email", "jane＠ﬁsh.org"),
        ("ask jane at studio dot photography today", "email", "jane at studio dot photography"),
        ("a.b.c.d.e.f.g.h.i.j.k at studio dot com", "email", "a.b.c.d.e.f.g.h.i.j.k at studio dot com"),
        ("a dot b dot c dot d dot e dot f dot g dot h dot i dot j dot k (at) x.org", "email", "a dot b dot c dot d dot e dot f dot g dot h dot i dot j dot k (at) x.org"),
        ("eins null zwei drei vier fünf sechs sieben acht neun", "phone", "eins null zwei drei vier fünf sechs sieben acht neun"),
        ("tel: 0171 fünf null fünf 12 34", "phone", "0171 fünf null fünf 12 34"),
        ("plus four nine - one seven one 55 55 12 34", "phone", "plus four nine - one seven one 55 55 12 34"),
    ],
)
def test_styles_of_disguise_may_be_mixed(text, kind, part):
    start = text.index(part)
    assert (kind, start, start + len(part)) in pii.disguised(text, pii.plain(text))


@pytest.mark.parametrize(
    "text",
    [
        "we met at example.com", "one. two. three. four. five", "1. 2. 3. 4. and 5", "in 2019, 2020 and one more", "about 1,000,000 two by two",
        "thanks @bob dot by dot", "5 at a dot",
        "values: null, 1500, null, 2300, 17 end", "chapter one 10 20 30 40 two 50", "pages six 100-200, seven 300-400", "6 dos 2020 1999 uno 15",
        "null null null null null null null null null null null null", "| null | 15 | null | 2300 | 17 | one | 20240101 |", "null;1500;null;2300;17;neuf",
        "one, two, three, four, five, six, seven, eight, nine, zero", "One. Two. Three. Four. Five. Six. Seven. Eight. Nine. Zero.",
        "one 1 two 2 three 3 four 4 five 5 six 6 seven 7 eight 8", "null 10 null 20 null 30 null 40 null 50", "NULL\tNULL\t1999\t2000\tNULL\t17\t18",
        "rows 1-20 two 21-40 three 41-60 four 61-80", "uno 100 dos 200 tres 300 cuatro 400", "null.null.null.null", "sept 2019 neuf 2020 10 11 12", "m² of ½ and … №", "from 1999 2000 to 2001 one",
    ],
)
def test_prose_with_the_same_words_is_left_alone(text):
    assert pii.plain(text) == pii.disguised(text, []) == []


def test_words_after_a_plain_number_are_not_part_of_it():
    for text in ("call +1 555 123 4567 two times", "at 192.168.0.1 one or two", "mail a@example.com dot the i"):
        assert pii.disguised(text, pii.plain(text)) == []


def test_long_disguises_take_linear_time():
    for text in ("1 " * 40_000 + "one", "one " * 20_000, "a dot " * 40_000, "a." * 40_000 + " dot b", "a at " * 40_000 + " dot ", "1." * 40_000 + " one", "[dot]" * 40_000):
        pii.disguised(text, [])


def test_many_identifiers_take_linear_time():
    import time

    def seconds(n):
        text = "е " + " ".join(f"a{i}@b.org call one {i + 10**9} two" for i in range(n))
        start = time.process_time()
        pii.disguised(text, pii.plain(text))
        return time.process_time() - start

    seconds(100)
    assert seconds(16_000) < 12 * seconds(2_000) + 0.2


def test_spans_that_meet_a_stretch():
    spans = pii.Spans([(5, 9), (9, 12), (20, 30)])
    for start in range(35):
        for end in range(start + 1, 36):
            assert spans.met(start, end) == [(s, e) for s, e in spans.spans if s < end and start < e]
