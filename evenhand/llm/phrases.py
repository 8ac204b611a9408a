"""Phrase collocations by Toivonen's sampling method.

A share of the documents proposes the phrases that are probably frequent (a lowered threshold). One pass over all documents then
counts exactly these and their negative border: the phrases that are not proposed although all of their words but the last, and
all but the first, are. A border phrase that turns out to be frequent is a failure; it may have frequent extensions that nothing
counted. A further pass counts every phrase around a failure whose parts are frequent or counted by that same pass, which closes the search:
all frequent phrases are then found, with exact counts.

The border is never listed: whether an occurrence belongs to it follows from the proposed phrases, which workers hold as a filter of
bounded size. A wrong yes of the filter only makes a pass count a phrase too many. Phrases are identified by hashes of 95 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.joins import join_small
from evenhand.llm.common import mix, slices, small_batches, stored, text_or_empty

LONGEST = 5
LEAST = 100
#: Share of documents in the sample, and how far below its share of the threshold a phrase is still proposed.
SHARE = 0.1
EASE = 0.6
#: Bits of the filter per phrase, up to the most bits that it may have (32 MB); probes per phrase.
BITS, MOST_BITS, PROBES = 16, 1 << 28, 4
#: Words of a language that a task remembers at a time.
MOST_WORDS = 500_000
#: Counts that a task holds before it sums them up; characters that it handles at a time.
HELD = 1_500_000
CHARACTERS = 1_000_000
#: Occurrences per range of hashes; the ranges' number follows the words in the sample.
PER_RANGE = 3_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP2 = np.uint64(0xD6E8FEB86659FD93)

#: A-Z lower-cased, every separator of pieces as a full stop, tab as space.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def words_of(texts: list[str]) -> list[bytes]:
    """Lower-cased words of texts, with a full stop on its own wherever a piece ends."""
    whole = ".".join(texts).encode("utf-8", "replace")
    return whole.translate(_BYTES).replace(b".", b" . ").split()


class Words(dict):
    """Numbers of a language's words, with two 64 bit hashes and the occurrences of each, and whether filters have it; number 0 marks the end of a piece."""

    def __init__(self, lang: str, *filters: Membership | None):
        super().__init__({b".": 0})
        self.filters = filters
        self.salt = lang.encode("utf-8", "replace") + b" "
        self.fresh: list[int] = []
        self.first, self.second, self.counts = np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64)
        self.inside = [np.zeros(1, bool) for _ in filters]

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(xxhash.xxh3_128_intdigest(self.salt + word))
        number = self[word] = len(self)
        return number

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.fresh:
            low = np.array([h & 0xFFFFFFFFFFFFFFFF for h in self.fresh], np.uint64)
            self.first = np.concatenate([self.first, low])
            self.second = np.concatenate([self.second, np.array([h >> 64 for h in self.fresh], np.uint64)])
            for i, members in enumerate(self.filters):
                here = np.ones(len(low), bool) if members is None else members.has(low)
                self.inside[i] = np.concatenate([self.inside[i], here])
            self.counts = np.concatenate([self.counts, np.zeros(len(low), np.int64)])
            self.fresh = []
        return ids


def _by_lang(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[str]]]:
    for batch in (part for whole in batches for part in slices(whole, "_text", CHARACTERS)):
        for lang, rows in batch.groupby("_lang", sort=False):
            yield lang, rows["_text"].tolist()


class Membership:
    """Bloom filter of phrase hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
        step = (mix(keys) | np.uint64(1)) >> np.uint64(1)
        for probe in range(PROBES):
            yield (keys + step * np.uint64(probe)) & np.uint64(size - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        left = np.arange(len(keys))
        for probe, place in enumerate(self.places(keys, 8 * len(self.bits))):
            at = place if not probe else place[left]
            yes = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            out[left[~yes]] = False
            left = left[yes]
        return out


def membership(keys: DataFrame, column: str = "g") -> Membership:
    """The filter of a table of hashes. Its size follows the number of rows, within a bound; tasks fill stretches of it."""
    count = keys.count()
    size = min(MOST_BITS, 1 << max(10, (BITS * count - 1).bit_length()))
    stretch = min(size, 1 << 16)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(np.concatenate(list(Membership.places(batch[column].to_numpy().view(np.uint64), size))))
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] // stretch != at[:-1] // stretch])) if len(at) else []
            rows = [
                (int(at[s]) // stretch, (at[s:e] % stretch).astype(np.uint16).tobytes())
                for s, e in zip(cuts, [*cuts[1:], len(at)], strict=True)
            ]
            yield pd.DataFrame(rows, columns=["stretch", "at"])

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(stretch, np.uint8)
        for at in group["at"]:
            flags[np.frombuffer(at, np.uint16)] = 1
        return pd.DataFrame({"stretch": group["stretch"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    found = keys.select(column).mapInPandas(places, "stretch int, at binary").groupBy("stretch").applyInPandas(fill, "stretch int, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in found.toLocalIterator():  # at most 32 MB in all
        bits[row["stretch"] * (stretch // 8) :][: stretch // 8] = np.frombuffer(row["bits"], np.uint8)
    return Membership(bits)


def _groups(g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hash pairs together, and where in it each distinct pair begins."""
    order = np.argsort(g)
    in_order, other = g[order], e[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    if np.any(~new[1:] & (other[1:] != other[:-1])):  # equal in the first hash, not in the second
        order = np.lexsort((e, g))
        new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (e[order][1:] != e[order][:-1])])
    return order, np.flatnonzero(new)


def _tag(second: np.ndarray) -> np.ndarray:
    """What is kept of the second hash: 31 bits, never 0."""
    return second.astype(np.uint32) | np.uint32(1)


class Counts:
    """Occurrences by hash pair, summed up whenever enough have come together and handed on in ranges of the first hash."""

    def __init__(self, ranges: int) -> None:
        self.ranges = ranges
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, g: np.ndarray, e: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((g, e, n))
        self.rows += len(g)

    def out(self, most: int) -> Iterator[pd.DataFrame]:
        """What is held, if that is more than ``most`` also after summing up."""
        if self.rows <= most:
            return
        g, e, n = map(np.concatenate, zip(*self.parts, strict=True))
        order, first = _groups(g, e)
        g, e, n = g[order[first]], e[order[first]], np.add.reduceat(n[order], first)
        self.parts, self.rows = [(g, e, n)], len(g)
        if self.rows > most // 2:
            self.parts, self.rows = [], 0
            n = n.astype(np.uint32)
            bounds = np.searchsorted((g >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32), np.arange(self.ranges + 1, dtype=np.uint64))
            filled = np.flatnonzero(np.diff(bounds))
            for some in np.array_split(filled, max(1, len(filled) // 1000)):
                cuts = [slice(bounds[r], bounds[r + 1]) for r in some]
                yield pd.DataFrame({"range": some, "g": [g[c].tobytes() for c in cuts], "e": [e[c].tobytes() for c in cuts], "n": [n[c].tobytes() for c in cuts]})


def _merging(least: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        g, e, n = (np.frombuffer(b"".join(group[c]), t) for c, t in (("g", np.uint64), ("e", np.uint32), ("n", np.uint32)))
        order, first = _groups(g, e)
        sums = np.add.reduceat(n[order], first, dtype=np.int64)
        enough = first[sums >= least]
        return pd.DataFrame({"g": g[order[enough]].view(np.int64), "e": e[order[enough]].view(np.int32), "n": sums[sums >= least]})

    return merge


def _counting(shortest: int, longest: int, probed: int, known: object, ranges: int):
    """Counts phrases of ``shortest`` to ``longest`` words, each task those of its own documents.

    Both parts of a phrase that lack one end word must be in ``known`` if they have at most ``probed`` words. Words are all
    counted where ``shortest`` is 1, and a row of a language's hash and 0 then holds their sum.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members = known and Membership(known.value)
        vocabularies: dict[str, Words] = {}
        counts = Counts(ranges)

        def words_seen(lang: str, words: Words) -> None:
            if shortest == 1:
                seen = np.flatnonzero(words.counts)
                counts.add(words.first[seen], _tag(words.second[seen]), words.counts[seen])
                key = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), seed=42)  # as Spark hashes a string
                counts.add(np.array([key], np.uint64), np.zeros(1, np.uint32), words.counts.sum(keepdims=True))

        for lang, texts in _by_lang(batches):
            words = vocabularies.setdefault(lang, Words(lang, members if probed else None))
            ids = words.numbers(words_of(texts))
            words.counts += np.bincount(ids, minlength=len(words.counts))
            words.counts[0] = 0
            g, e, inside = words.first[ids], words.second[ids], words.inside[0][ids]
            for k in range(2, longest + 1):
                at = np.flatnonzero(inside[:-1] & inside[1:])
                last = ids[at + k - 1]
                g[at] = here = mix(g[at] * STEP + words.first[last])
                e[at] = there = mix(e[at] * STEP2 + words.second[last])
                if k >= shortest:
                    counts.add(here, _tag(there), np.ones(len(at), np.int64))
                if k < longest:
                    inside = np.zeros(len(ids), bool)
                    inside[at] = members.has(here) if k <= probed else True
            if len(words) > MOST_WORDS:
                words_seen(lang, vocabularies.pop(lang))
            yield from counts.out(HELD)
        for lang, words in vocabularies.items():
            words_seen(lang, words)
        yield from counts.out(0)

    return count


def _naming(longest: int, known: object, fresh: object):
    """Counts and spells out the phrases of ``fresh``. With ``known``, also every longer phrase around one of them whose
    parts that lack one end word are in ``known`` or counted here themselves."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members, new = known and Membership(known.value), Membership(fresh.value)
        vocabularies: dict[str, Words] = {}
        for lang, texts in _by_lang(batches):
            words = vocabularies.setdefault(lang, Words(lang, new, members))
            tokens = words_of(texts)
            ids = words.numbers(tokens)
            g, e, novel, usable = words.first[ids], words.second[ids], words.inside[0][ids], (words.inside[0] | words.inside[1])[ids]
            found = [(1, np.flatnonzero(novel))]
            hashes = [(g[found[0][1]], e[found[0][1]])]
            for k in range(2, longest + 1):
                at = np.flatnonzero(usable[:-1] & usable[1:])
                last = ids[at + k - 1]
                g[at] = here = mix(g[at] * STEP + words.first[last])
                e[at] = there = mix(e[at] * STEP2 + words.second[last])
                hit = new.has(here)
                if members is not None:
                    hit |= novel[at] | novel[at + 1]
                found.append((k, at[hit]))
                hashes.append((here[hit], there[hit]))
                if k < longest:
                    novel, usable = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
                    novel[at] = hit
                    usable[at] = True if members is None else hit | members.has(here)
            for (k, at), (here, there) in zip(found, hashes, strict=True):
                if len(at):
                    there = _tag(there)
                    order, first = _groups(here, there)
                    one, n = order[first], np.diff([*first, len(at)])
                    spelled = [b" ".join(tokens[i : i + k]).decode() for i in at[one]]
                    yield pd.DataFrame({"g": here[one].view(np.int64), "e": there[one].view(np.int32), "n": n, "lang": lang, "phrase": spelled})
            if len(words) > MOST_WORDS:
                vocabularies.pop(lang)

    return name


def _shared(docs: DataFrame, filter_: Membership | None):
    return None if filter_ is None else docs.sparkSession.sparkContext.broadcast(filter_.bits)


def _counted(docs: DataFrame, least: int, shortest: int, longest: int, probed: int, words: int, known: Membership | None = None) -> DataFrame:
    """Phrases met at least ``least`` times, stored: g, e, n. ``words`` is about the number of words in ``docs``."""
    ranges = max(4, -(-words // PER_RANGE))
    count = _counting(shortest, longest, probed, _shared(docs, known), ranges)
    rows = docs.mapInPandas(count, "range int, g binary, e binary, n binary")
    return stored(rows.groupBy("range").applyInPandas(_merging(least), "g long, e int, n long"), "phrase-counts")


def _named(docs: DataFrame, least: int, longest: int, fresh: Membership, known: Membership | None = None) -> DataFrame:
    """Phrases with their words, stored: g, e, n, lang, phrase."""
    rows = docs.mapInPandas(
        _naming(longest, _shared(docs, known), _shared(docs, fresh)), "g long, e int, n long, lang string, phrase string"
    )
    summed = rows.groupBy("g", "e").agg(F.sum("n").alias("n"), F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
    return stored(summed.filter(F.col("n") >= least), "phrase-names")


def frequent(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    text_col: str = "text",
    lang_col: str = "lang",
    share: float = SHARE,
    id_col: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times in a language: lang, phrase, f; and the languages' words: lang, n.

    Exact whatever the sample holds: it only decides how much the passes count. The sample takes rows by a hash of id and text.
    Both tables are stored.
    """
    small_batches(docs.sparkSession, 3000)
    given = docs.select(
        text_or_empty(text_col).alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.col(id_col).alias("_id")
    )
    chosen = F.pmod(F.xxhash64(F.lit("phrases"), "_id", "_text"), F.lit(1_000_000)) < int(1_000_000 * share)
    sample = stored(given.filter(chosen).drop("_id"), "phrase-sample")
    given = given.drop("_id")
    lowered = max(1, int(EASE * share * least))
    # About as many words as the sample has characters over six; only the number of ranges depends on it.
    words = int((sample.agg(F.sum(F.length("_text"))).first()[0] or 0) / 6) + 1

    proposed = _counted(sample, lowered, 1, min(2, longest), 0, words).filter("e <> 0").select("g", "e")
    if longest > 2:
        longer = _counted(sample, lowered, 3, longest, 2, 2 * words, membership(proposed))
        proposed = stored(proposed.unionByName(longer.select("g", "e")), "phrase-proposed")
    members = membership(proposed)
    named = _named(sample, 1, longest, members).select("g", "e", "lang", "phrase")

    counted = _counted(given, least, 1, longest, longest - 1, int(words / share), members)
    found = counted.filter("e <> 0")
    failures = stored(found.join(proposed, ["g", "e"], "left_anti").select("g", "e"), "phrase-failures")
    known = membership(stored(proposed.unionByName(failures), "phrase-known"))
    more = _named(given, least, longest, membership(failures), known)

    # The sample named what it proposed, the last pass names whatever it counts.
    first = found.join(named, ["g", "e"]).select("g", "e", "lang", "phrase", F.col("n").alias("f"))
    both = first.unionByName(more.join(first, ["g", "e"], "left_anti").select("g", "e", "lang", "phrase", F.col("n").alias("f")))
    totals = counted.filter("e = 0").select(F.col("g").alias("_key"), "n")
    langs = given.groupBy(F.col("_lang").alias("lang")).count().select("lang", F.xxhash64("lang").alias("_key"))
    return stored(both.select("lang", "phrase", "f"), "phrases"), stored(langs.join(totals, "_key").select("lang", "n"), "phrase-languages")


def _whole(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int | None = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    share: float = SHARE,
    id_col: str = "doc_id",
) -> DataFrame:
    """Phrases of 2 to ``longest`` words by how far they exceed chance: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, words end at space or tab; a null text is empty, a null
    language is ``und``. ``a`` is the number of occurrences, at least ``least``. Cutting a phrase in two gives the
    score floor(1000 a n / (l r)), l and r being the parts' occurrences and n all words of the language; the lowest-scoring cut
    counts, of equal ones the first. Phrases that never occur outside one longer phrase are dropped. ``top`` keeps
    each language's best (score, then a, then phrase); None keeps all, without ranks. Repeated rows count as
    often as they occur, other columns are left out, an empty table gives no rows.
    """
    phrases, languages = frequent(docs, least, longest, text_col, lang_col, share, id_col)
    words = F.split("phrase", " ")
    listed = phrases.withColumn("_words", words)
    candidates = listed.filter(F.size("_words") > 1)

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("_words", start, length), " ")

    size = F.size("_words")
    # What lies inside a longer candidate as often as it occurs also lies so inside one that has a word more.
    inner = candidates.filter(size > 2).select(
        "lang", F.explode(F.array(joined(F.lit(1), size - 1), joined(F.lit(2), size - 1))).alias("phrase"), F.col("f").alias("_longer")
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    left = candidates.join(inner, ["lang", "phrase"], "left").filter(F.coalesce("_longer", F.lit(0)) < F.col("f")).drop("_longer")
    cuts = left.withColumn("_k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"_left": joined(F.lit(1), F.col("_k")), "_right": joined(F.col("_k") + 1, size - F.col("_k"))}).drop("_words")
    cuts = join_small(cuts, phrases.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
    cuts = join_small(cuts, phrases.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
    cuts = join_small(cuts, languages, ["lang"])
    upper = F.lit(1000).cast("decimal(4,0)") * _whole(F.col("f")) * _whole(F.col("n"))
    cuts = cuts.withColumns({"_upper": upper, "_lower": _whole(F.col("l")) * _whole(F.col("r"))}).withColumn("score", F.expr("_upper div _lower"))
    scored = cuts.groupBy("lang", "phrase").agg(
        F.first("f").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "_k", "l", "r")).alias("_cut")
    )
    scored = scored.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    if top is None:
        return scored
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each group of a language hands on its best, so that no task sorts a whole language.
    groups = scored.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = groups.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
