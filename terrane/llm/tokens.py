"""Token ids by the tokenizers library, with every distinct piece of text encoded once.

The vocabulary's pre-tokenizer cuts lower-cased text by the pattern below and encodes each piece by itself, so a text's ids
are the joined ids of its pieces. Plain Latin text is cut here by the same pattern; a word with any other character
goes to the library whole. Strings of special tokens inside a text count as ordinary text.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from .words import kept

#: Fixed value: the pre-tokenizer's pattern in the vocabulary file, for plain text.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\[-`{-~]+")
#: White space, printable ASCII and Latin letters of one byte.
PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: White space as the library sees it; ``str.split`` also cuts at the characters U+001C to U+001F.
WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The end-of-document id.
END = 1


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Holds at most twice ``limit`` pieces, besides those of one call: beyond ``limit`` a fresh table is begun, which takes
    over what is met again from the one before it.
    """

    def __init__(self, path: str, limit: int = 150_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the same model for pieces that are cut and normalised already
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = str.maketrans({chr(c): "".join(x for x, _ in spell(chr(c))) for c in range(0xC0, 0x100)})
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocab.values()) + 3, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the pieces before the last fresh start

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _add_plain(self, pieces: list) -> None:
        """Encode pieces in one call: each piece's last id is one that closes a word, and no other is."""
        joined = " ".join(pieces)
        if not joined.isascii():
            joined = joined.translate(self.spelling)
        ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pieces):
            self.pieces.update((p, self._whole(p)) for p in pieces)
            return
        raw, at = ids.tobytes(), 0
        for p, e in zip(pieces, (ends * 4).tolist()):
            self.pieces[p] = raw[at:e]
            at = e

    def _add(self, new: set) -> None:
        older = self.older
        again = older.keys() & new
        self.pieces.update((p, older[p]) for p in again)
        plain = []
        for p in new - again:
            if PLAIN.fullmatch(p):
                plain.append(p)
            else:
                self.pieces[p] = self._whole(p)
        for i in range(0, len(plain), 2000):
            self._add_plain(plain[i : i + 2000])

    @staticmethod
    def _cut(text: str | None) -> list:
        """Pieces of plain text; elsewhere those of its plain words, and its other words whole."""
        if not text:
            return []
        if PLAIN.fullmatch(text):
            return PIECE.findall(text.lower())
        return list(chain.from_iterable(PIECE.findall(w.lower()) if PLAIN.fullmatch(w) else (w,) for w in WORD.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, without an end id; a null text has none."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list) -> list:
        """``encode`` for several texts, whose new pieces are encoded together."""
        cut = [self._cut(t) for t in texts]
        pieces = set(chain.from_iterable(cut))
        if new := pieces.difference(self.pieces):
            if len(self.pieces) + len(new) > self.limit:
                self.older, self.pieces = self.pieces, {}
                new = pieces
            self._add(new)
        got = self.pieces.__getitem__
        return [b"".join(map(got, c)) for c in cut]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary, kept between the tasks of a Python worker."""
    return kept(("encoder", path), lambda: Encoder(path))
