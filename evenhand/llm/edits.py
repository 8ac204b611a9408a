"""Edit-aware token counts: a segment tree of pre-token counts per document.

Leaves hold a word with the white space after it: its characters and its number of tokens. An edit finds its
leaves by descending on characters, re-encodes only them (the words it touches and the word it may have
joined on either side), and updates the sums on their paths. All other words keep their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import small_batches, text_or_empty
from evenhand.llm.tokens import Encoder, encoder_of, split_words


class CountTree:
    """Characters and tokens of a text's leaves, summed up a binary tree kept in two arrays."""

    def __init__(self, text: str, encoder: Encoder):
        self.encoder = encoder
        words = split_words(text)
        chars = np.fromiter(map(len, words), np.int64, len(words)) + 1
        chars[-1] -= 1  # no white space after the last word
        tokens = np.fromiter(map(len, encoder.parts(words)), np.int64, len(words)) // 2
        self.size = 1 << max(len(words) - 1, 1).bit_length()
        self.sums = [self._tree(chars), self._tree(tokens)]
        stops = chars.cumsum()
        self.text, self.starts, self.stops = text, stops - chars, stops
        self.changed: dict[int, str] = {}
        self.reencoded = 0

    def _tree(self, leaves: np.ndarray) -> list[int]:
        levels = [np.zeros(self.size, np.int64)]
        levels[0][: len(leaves)] = leaves
        while len(levels[-1]) > 1:
            levels.append(levels[-1][0::2] + levels[-1][1::2])
        return np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tolist()

    @property
    def n_chars(self) -> int:
        return self.sums[0][1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and the number of characters before it; at the end, the last one with any."""
        chars, node, before = self.sums[0], 1, 0
        if not self.n_chars:
            return 0, 0
        at = min(at, self.n_chars - 1)
        while node < self.size:
            node *= 2
            if at - before >= chars[node]:
                before += chars[node]
                node += 1
        return node - self.size, before

    def _text(self, leaf: int) -> str:
        if leaf in self.changed:
            return self.changed[leaf]
        return self.text[self.starts[leaf] : self.stops[leaf]] if leaf < len(self.starts) else ""

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.changed[leaf] = text
        for sums, value in zip(self.sums, (len(text), tokens), strict=True):
            node = leaf + self.size
            change = value - sums[node]
            while node and change:
                sums[node] += change
                node //= 2

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters ``start`` to ``stop`` of the present text, both held inside it, by ``new``."""
        start = min(max(start, 0), self.n_chars)
        stop = min(max(stop, start), self.n_chars)
        first, before = self._leaf(start)
        last, before_last = self._leaf(stop)
        old = self._text(first)
        head = old[: start - before]
        tail = self._text(last)[stop - before_last :]
        region = head + new + tail
        parts = self.encoder.parts(split_words(region))
        self._set(first, region, sum(map(len, parts)) // 2)
        leaf = first + 1
        while leaf <= last:
            if self.sums[0][leaf + self.size]:
                self._set(leaf, "", 0)
            leaf += 1
        self.reencoded += len(parts)

    def present(self) -> str:
        return "".join(self._text(leaf) for leaf in range(max(len(self.starts), 1)))


RESULT = "n_chars long, n_tokens long, n_leaves long, edited_chars long, edited_tokens long, n_reencoded long, tokens_after array<long>"


def count(
    docs: DataFrame, edits: Column, text_col: str = "text", tokenizer: str | None = None, with_text: bool = False
) -> DataFrame:
    """``docs`` with characters and tokens before and after their edits; columns named like the results are replaced.

    ``edits`` is an array of structs (start, stop, new), applied in turn, each to the text the one before left.
    Positions are code points and are held inside the text; null edits, or nulls in one, change nothing.
    tokens_after has the count after each edit, n_reencoded the words that were encoded again, edited_text (on
    request) the text itself. A null or empty text has no tokens and can be inserted into. Rows are independent.
    """
    small_batches(docs.sparkSession)
    result = RESULT + (", edited_text string" if with_text else "")
    names = [f.split()[0] for f in result.split(", ")]
    given = F.coalesce(edits.cast("array<struct<start:int,stop:int,new:string>>"), F.array().cast("array<struct<start:int,stop:int,new:string>>"))

    @F.pandas_udf(result)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        for texts, lists in batches:
            rows = []
            for text, todo in zip(texts, lists, strict=True):
                tree = CountTree(text, encoder)
                row = [tree.n_chars, tree.n_tokens, len(tree.starts)]
                after = []
                for e in todo:
                    if e is not None and not any(pd.isna(e[k]) for k in ("start", "stop", "new")):
                        tree.edit(int(e["start"]), int(e["stop"]), e["new"])
                    after.append(tree.n_tokens)
                row += [tree.n_chars, tree.n_tokens, tree.reencoded, after]
                rows.append([*row, tree.present()] if with_text else row)
            yield pd.DataFrame(rows, columns=names)

    kept = [F.col(c) for c in docs.columns if c not in names]
    return docs.select(*kept, run(text_or_empty(text_col), given).alias("_n")).select(*kept, "_n.*")


def sample_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits per document, from checksums of its id: a cut, a passage of its own repeated, a stretch replaced."""
    text = text_or_empty(text_col)
    n = F.length(text)

    def at(k: int) -> Column:
        return F.pmod(F.crc32(F.concat_ws("/", F.col(id_col).cast("string"), F.lit(str(k)))), n + 1).cast("int")

    def edit(start: Column, length: int, new: Column) -> Column:
        return F.struct(start.alias("start"), (start + length).alias("stop"), new.alias("new"))

    return F.array(
        edit(at(1), 40, F.lit("")),
        edit(at(2), 0, F.substring(text, at(3) + 1, F.lit(25))),
        edit(at(4), 12, F.lit("[removed] ")),
    )
