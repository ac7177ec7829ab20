"""Token ids of texts, from the vocabulary file of a public byte-level BPE tokenizer."""

from __future__ import annotations

import re
from array import array
from functools import cache

import regex
from tokenizers import Tokenizer

# ---- fixed value: how byte-level vocabularies split a text before merging -------------------
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

# Signs that end a word without being letters, numbers or white space.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

# Distinct words, and pieces of words, whose ids a Python worker remembers.
REMEMBERED = 300_000
ID_BYTES = 4
# A space with white space on both sides; only there a word's ids depend on its neighbours.
_INSIDE_GAP = re.compile(r"\s \s")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pieces_of(word: str) -> list[str]:
    """What a word and the space before it are split into; letters and signs after them are two pieces."""
    stem = word.rstrip(SIGNS)
    if stem.isalpha():
        return [" " + stem, word[len(stem) :]] if len(stem) < len(word) else [" " + stem]
    return PIECES.findall(" " + word)


class _Pieces(dict):
    """Piece -> its ids as little-endian bytes, worked out by the tokenizer's model when missing."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.model = tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        packed = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = packed
        return packed


class _Words(dict):
    """Word -> its ids with the space before it, put together from its pieces when missing."""

    def __init__(self, pieces: _Pieces) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        packed = b"".join(map(self.pieces.__getitem__, pieces_of(word)))
        if len(self) < REMEMBERED:
            self[word] = packed
        return packed


class TokenEncoder:
    """Ids of whole texts, equal to those of `Tokenizer.encode(text, add_special_tokens=False)`.

    With `added_tokens` the strings of added tokens in a text are those tokens, as the library has it
    by default, and texts that hold one are encoded as a whole; without it they are ordinary text
    (the library's `encode_special_tokens`). No piece that is merged reaches over a space that
    has something other than white space on one side, so texts are encoded word by word and words
    are remembered; the few texts with spaces inside longer gaps are encoded as a whole.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added_tokens and added else None
        self.words = _Words(_Pieces(self.tokenizer))

    def encode(self, text: str) -> bytes:
        """Unsigned 32-bit little-endian ids."""
        if _INSIDE_GAP.search(text) or (self.added and self.added.search(text)):
            return self._whole(text)
        first, *words = text.split(" ")
        return self._whole(first) + b"".join(map(self.words.__getitem__, words))

    def _whole(self, text: str) -> bytes:
        if not text:
            return b""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@cache
def encoder(path: str, added_tokens: bool = False) -> TokenEncoder:
    """One encoder per Python worker, vocabulary and way with added tokens; it lives as long as the worker."""
    return TokenEncoder(path, added_tokens)
