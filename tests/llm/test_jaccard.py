import collections

import pytest

from evenhand.llm import jaccard
from evenhand.llm.graph import components

from .conftest import with_clashes


def sets_of(rows, n):
    out = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        out.append(frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset())
    return out


def brute(rows, n, num, den):
    """For each row: set size, class, links of its class, component."""
    sets = sets_of(rows, n)
    ids = [r[0] for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = collections.defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                if sets[i] != sets[j]:
                    linked[sets[i]].add(sets[j])
                    linked[sets[j]].add(sets[i])

    def least(members):
        known = [ids[m] for m in members if ids[m] is not None]
        return min(known) if known else None

    out = []
    for i, s in enumerate(sets):
        same = [j for j in range(len(rows)) if sets[j] == s] if s else [i]
        group = [j for j in range(len(rows)) if find(j) == find(i)]
        out.append((ids[i], len(s), least(same), len(linked[s]) if s else 0, least(group)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "num", "group"), [(4, 85, 10**6), (5, 80, 10**6), (2, 50, 10**6), (2, 50, 40), (4, 85, 300), (4, 85, 2)])
def test_links_and_components_equal_brute_force(docs, rows, n, num, group):
    clashing = with_clashes(docs, ["n_shingles", "component_id", "class_id"])
    got = jaccard.similar(clashing, n, num, 100, group=group).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, n, num, 100)


def test_one_row_of_each_component_stays(docs, rows, empty):
    kept = jaccard.keep_one(docs).collect()
    assert kept[0].__fields__ == docs.columns
    expected = {r[4] for r in brute(rows, 5, 80, 100) if r[1]}
    with_words = [r for r in kept if r["text"] and r["text"].split()]
    assert {r["doc_id"] for r in with_words if r["doc_id"] is not None} == expected - {None}
    assert len(with_words) == len({frozenset(s) for s in [[r["doc_id"], r["text"]] for r in with_words]})
    assert len(with_words) == len(expected - {None}) + sum(r["doc_id"] is None for r in with_words)
    assert len(kept) - len(with_words) == sum(not (r[1] or "").split() for r in rows)
    assert jaccard.keep_one(empty).count() == 0
    assert jaccard.similar(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + hub + [(7, 7), (9, 8), (9, 8)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1000 + i: 1000 for i in range(50)} | {8: 8, 9: 8}
    assert components(edges.limit(0)).count() == 0


def test_a_large_group_with_a_common_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(i % 50)), None, None, None) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for group in (60, 700, 5000):
        got = jaccard.similar(frame, 4, 85, 100, group=group).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85, 100)
