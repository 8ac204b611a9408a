"""Token ids of a public tokenizer, word by word, with bounded memories of words already seen.

The tokenizer (lower case, white space dropped, byte-level BPE with word ends) encodes every piece
between white space on its own. So a word's ids are looked up, and only new words reach the model.
Ids are kept as two bytes each, which holds for vocabularies of up to 65,536 entries.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable

#: The tokenizer's own split into pre-tokens, as its file states it, for lower-cased Latin-1: its letters, digits and white space spelled out.
PRETOKEN = re.compile(
    r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\t-\r\x20\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """Ids of strings; short ones are remembered, up to a bound."""

    def __init__(self, ids: Callable[[str], bytes], most: int):
        super().__init__()
        self.ids, self.most = ids, most

    def __missing__(self, string: str) -> bytes:
        found = self.ids(string)
        if len(string) <= 64 and len(self) < self.most:
            self[string] = found
        return found


class Encoder:
    """Ids of texts from remembered pre-tokens; ``most`` pre-tokens and ``most`` words at any time."""

    def __init__(self, path: str | None = None, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 65_536:
            raise ValueError("ids of this vocabulary do not fit into two bytes")
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces = Memory(self._piece, most)
        self.words = Memory(self._word, most)

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        mapped = piece if plain else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join(t.id.to_bytes(2, "little") for t in self.model.tokenize(mapped))

    def _latin(self, text: str) -> bytes | None:
        """Ids of a text in Latin-1, which needs no composing and has one lower-case letter per letter; special tokens start with ``<|``."""
        if "<|" in text:
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return b"".join(map(self.pieces.__getitem__, PRETOKEN.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        found = self._latin(word)
        if found is None:
            ids = self.tokenizer.encode(word.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
            found = b"".join(i.to_bytes(2, "little") for i in ids)
        return found

    def parts(self, words: list[str]) -> list[bytes]:
        """The ids of each word, two bytes each."""
        return list(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, two bytes each, the same as the tokenizer's own."""
        if not text:
            return b""
        found = self._latin(text)
        return b"".join(self.parts(split_words(text))) if found is None else found


def encoder_of(path: str | None) -> Encoder:
    """The Python worker's encoder for a tokenizer file, kept between its tasks with the words that it remembers."""
    kept = vars(sys.modules.setdefault("_evenhand_encoders", types.ModuleType("_evenhand_encoders")))
    name = path or default_path()
    if name not in kept:
        kept[name] = Encoder(name)
    return kept[name]


def split_words(text: str) -> list[str]:
    """Pieces between spaces and line feeds; other white space stays inside and the tokenizer drops it."""
    return text.replace("\n", " ").split(" ")
