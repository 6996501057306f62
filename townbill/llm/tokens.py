"""Encoding whole texts with a public tokenizer, inside tasks."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

from townbill.llm import common

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
SYMBOLS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


class Encoder(dict):
    """Whole text -> its ids, as the tokenizers library gives them.

    A tokenizer that drops white space, and whose added tokens are ASCII without any, treats what stands
    between ASCII spaces independently. Such texts are cut there and each distinct piece is encoded once:
    normalised, split and handed to the model by the library's own parts, or whole if it holds an added
    token. The pieces' ids (little-endian unsigned 32-bit) are kept in two generations of bounded size, so
    that frequent ones survive. For other tokenizers every text goes to the library whole.

    What saves calls is asked of the loaded tokenizer and not assumed: `lowers` (it takes A-Z as a-z),
    `plain` (letters that give one part together, each with its own share of it) and `symbols` (those
    that are split from a letter before them, alone and in runs).
    """

    LIMIT, LONGEST = 400_000, 64

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.old: dict[bytes, bytes] = {}
        self.model = lru_cache(maxsize=50_000)(self._model)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.longest_added = max(map(len, added), default=1)
        self.added = [t.lower().encode() for t in added if t]
        shown = "".join(self._parts("a \t\n\x0b\x0c\r b")).replace("</w>", "")
        sample = "abc zq, it's 12é -- Ünï"
        self.by_piece = (
            shown == "ab"
            and all(t.isascii() and not any(c.isspace() for c in t) for t in added)
            and self._by_parts(sample)
        )
        self.lowers = self._normal("abcdefghijklmnopqrstuvwxyz") == self._normal("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        self.plain, self.symbols = self._probe() if self.by_piece else ({}, "")
        self.letters = frozenset(map(chr, self.plain))
        self.as_they_are = all(self.plain.get(c) == chr(c) for c in range(ord("a"), ord("z") + 1))

    def _probe(self) -> tuple[dict[int, str], str]:
        """Letters with their share of a part, if all pairs and triples around them agree; symbols split off after any of them."""
        share = {c: p[0] for c in LETTERS if len(p := self._parts(c)) == 1 and not any(c in t.decode() for t in self.added if t.isalpha())}
        apart = [c for c in share if any(self._parts(x + c) != [share[x] + share[c]] or self._parts(x + c + x) != [share[x] + share[c] + share[x]] for x in share)]
        share = {ord(c): p for c, p in share.items() if c not in apart}
        letters = list(map(chr, share))
        symbols = [m for m in SYMBOLS if all(self._parts(c + m) == [share[ord(c)], *self._parts(m)] for c in letters)]
        runs = all(self._parts(c + m + n) == [share[ord(c)], *self._parts(m + n)] for c in letters[:1] for m in symbols for n in symbols)
        return share, "".join(symbols) if runs else ""

    def _normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if self.library.normalizer else text

    def _parts(self, text: str) -> list[str]:
        """What the library hands to the model for a text without added tokens."""
        text = self._normal(text)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if self.library.pre_tokenizer else [text]

    def _by_parts(self, sample: str) -> bool:
        """Whether the library's parts, one by one, give what it gives as a whole; not if it cannot encode the sample."""
        try:
            return self._whole(sample.encode()) == b"".join(map(self._model, self._parts(sample)))
        except Exception:  # the library raises plain Exception where a model has no token for unknown words
            return False

    def _whole(self, text: bytes) -> bytes:
        return pack(self.library.encode(text.decode(), add_special_tokens=False).ids)

    def _model(self, part: str) -> bytes:
        return pack([t.id for t in self.tokenize(part)])

    def _holds_added(self, low: bytes) -> bool:
        for token in self.added:  # a plain loop, as this runs for each text and piece
            if token in low:
                return True
        return False

    def _encode(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.as_they_are and piece.isalpha() and piece.islower():
            return self._model(text)
        if self.letters.issuperset(text):  # no added token is made of these letters alone
            return self._model(text.translate(self.plain))
        if self._holds_added(piece.lower()):
            return self._whole(piece)
        head = text.rstrip(self.symbols) if self.symbols else text
        if not self.letters.issuperset(head) or not head:
            return b"".join(map(self.model, self._parts(text)))
        return self[head.encode()] + self[text[len(head) :].encode()]

    def __missing__(self, piece: bytes) -> bytes:
        if len(piece) > self.LONGEST:
            return self._whole(piece)
        ids = self.old.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        raw = text.encode()
        if not self.by_piece:
            return self._whole(raw)
        if self.lowers:
            low = raw.lower()  # ASCII letters only; added tokens may tell cases apart
            if not self._holds_added(low):
                raw = low
        return b"".join(map(self.__getitem__, raw.split()))


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def encoder(path: str) -> Encoder:
    common.keep_only("tokens")
    return _encoder(path)


common.cached("tokens", _encoder.cache_clear)
