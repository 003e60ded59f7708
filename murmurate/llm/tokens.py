"""Tokenizers of the box, with caches that make whole corpora affordable. Files are named by a path parameter."""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

#: Words of one of the two generations of a worker's cache, and the longest that is kept: some 25 MB each.
CACHE_WORDS, CACHED_CHARS = 100_000, 64


def public_path(name: str) -> str:
    """Where an installed public tokenizer file lies; looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level BPE: printable bytes stand for themselves, others follow U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


#: The byte that stands for a word's last ASCII character: the tokenizer tells it from the same character inside a word.
_LAST = [bytes([b | 0x80]) for b in range(128)]


def ranks_of(tokenizer):
    """The ASCII part of a word BPE as byte ranks, for a faster encoder of the same results.

    A vocabulary is in the order of its merges, so ids are ranks. The encoder joins any two
    neighbours that make a token, the tokenizer only the two of a merge rule; both give the same if
    every token is what the tokenizer makes of its text, as is seen here for those that end a word;
    those that don't are left out. The tests compare the two on words, runs and random letters.
    """
    import tiktoken

    letters = {c: b for b, c in enumerate(byte_letters())}
    ranks = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        ends = token.endswith("</w>")
        raw = bytes(letters[c] for c in (token.removesuffix("</w>") if ends else token))
        if raw and max(raw) < 0x80:
            raw = raw[:-1] + _LAST[raw[-1]] if ends else raw
            made = [t.id for t in tokenizer.model.tokenize(token.removesuffix("</w>"))] if ends else [i]
            if made == [i]:
                ranks[raw] = i
    return tiktoken.Encoding("word", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})


class WordBpe:
    """Ids of texts under a lower-casing, white-space-dropping word BPE, as little-endian uint32 bytes.

    White space never joins tokens, so a text's ids are those of its blank-separated chunks in
    order. Chunks are kept in a cache of two generations: when the younger is full the older goes,
    so words in use stay and memory is bounded. Chunks of plain Latin letters, digits and
    punctuation skip the normaliser: they are lower-cased, split by the file's own pattern and given
    to the BPE model, or, if they are ASCII, to a faster encoder of its ranks. All others go
    through the whole tokenizer.
    """

    _PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ſ]+").fullmatch
    _L = "a-zß-öø-ſ"
    _PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\\s{_L}0-9]+").findall
    _BLANK = re.compile("[ \t\n\r\x0b\x0c]+").split
    _ODD = re.compile("[\x1c-\x1f]|<\\|").search

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.fast = ranks_of(self.tokenizer)._core_bpe.encode_single_piece
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _put(self, w: str, ids: bytes) -> bytes:
        if len(w) <= CACHED_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[w] = ids
        return ids

    def _piece(self, p: str) -> bytes:
        """A run of the pattern, in lower case."""
        if p.isascii():
            raw = p.encode()
            return array("I", self.fast(raw[:-1] + _LAST[raw[-1]])).tobytes()
        mapped = "".join(map(self.letters.__getitem__, p.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _known_piece(self, p: str) -> bytes:
        ids = self.young.get(p) or self.old.get(p)
        return ids if ids is not None else self._put(p, self._piece(p))

    def _chunk(self, w: str) -> bytes:
        """A chunk that the younger generation does not have."""
        ids = self.old.get(w)
        if ids is None:
            low = w.lower()
            if w.isascii() and w.isalpha():
                ids = self._piece(low)
            elif self._PLAIN(w) and "<|" not in w:
                ids = b"".join(map(self._known_piece, self._PIECES(low)))
            else:
                ids = array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        return self._put(w, ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._ODD(text):  # separators of str.split that are no white space here, or perhaps a special token
            chunks = self._BLANK(text)
        else:
            chunks = (text.lower() if text.isascii() else text).split()
        out, new = [], self._chunk
        for w in chunks:
            ids = self.young.get(w)
            out.append(new(w) if ids is None else ids)
        return b"".join(out)


_WORD: dict[str, WordBpe] = {}
_BYTE: dict[str, tuple] = {}


def word_bpe(path: str | None = None) -> WordBpe:
    path = path or public_path("word_bpe_49k.json")
    if path not in _WORD:
        _WORD[path] = WordBpe(path)
    return _WORD[path]


def byte_bpe(path: str | None = None, pattern: str | None = None):
    """A byte-level encoder and the byte length of each id."""
    import public_tokenizers
    import tiktoken

    path, pattern = path or public_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if path not in _BYTE:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lens = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for b, i in ranks.items():
            lens[i] = len(b)
        _BYTE[path] = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lens
    return _BYTE[path]
