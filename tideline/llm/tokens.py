"""Token ids of whole texts by the tokenizers library, with the ids of recurring words remembered.

A text is cut where no token can reach across: for the byte-level vocabulary before a blank that a visible character follows, for
the word vocabulary (which drops white space) at every blank and line end. Each piece ("the", " quick", ...) is looked up; a new
piece that is letters of the Latin blocks and ASCII marks after them is one or two words to the vocabulary's own splitting rule
and goes to the library's model directly, any other goes through the whole library by itself. Texts that hold the string of a special token
are never cut: the library alone decides about them. So ids are those of the plain call `encode(text, add_special_tokens=False)`.

The store is two generations, each bounded by BYTES or what a caller gives; pieces of more than LONGEST characters are never stored, so texts without
blanks leave nothing behind. Emptying a store costs time and changes no id.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tideline.llm.common import STORES, only

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Bytes of a generation of the store (an entry takes its piece, its ids and about ENTRY bytes), characters of a piece stored,
#: pieces looked up at once.
BYTES, ENTRY, LONGEST, AT_ONCE = 100_000_000, 200, 64, 200_000
#: A blank after white space that no visible character follows: there, cutting at every blank would cut inside a run.
_INSIDE_RUN = re.compile(r"\s (?!\S)")
#: Letters that are one word to either splitting rule, then ASCII marks (no apostrophe), which are another.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ʯ]+)([!-&(-/:-@\[-`{-~]*)")
#: The byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_encoders: dict[str, Encoder] = {}
STORES["tokens"] = _encoders.clear


def byte_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_BYTES)


class Encoder:
    """Byte-level vocabulary; pieces are looked up without the blank before them."""

    blank = " "

    def __init__(self, path: str):
        self.room = BYTES
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids = max(self.tokenizer.get_vocab().values()) + 1
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the plain call."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def model_ids(self, shown: str) -> bytes:
        """Ids of one word in the byte-level alphabet."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def shown(self, letters: str) -> str:
        return "Ġ" + (letters if letters.isascii() else byte_letters(letters))

    def cut(self, text: str) -> list[str]:
        return text.split(" ")

    def torn(self, text: str) -> bool:
        """Whether cutting at every blank cuts inside a run of white space."""
        return bool(_INSIDE_RUN.search(text))

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        found, other, marks, older, known = {}, [], {}, self.older, self.known
        for p in pieces:
            ids = older.get(p)
            if ids is None:
                plain = _PLAIN.fullmatch(p)
                if plain is None or len(p) > LONGEST:
                    other.append(p)
                    continue
                letters, tail = plain.groups()
                ids = known.get(letters) or older.get(letters) or self.model_ids(self.shown(letters))
                if tail:
                    if tail not in marks:
                        marks[tail] = self.model_ids(tail)
                    found[letters] = ids
                    ids += marks[tail]
            found[p] = ids
        for p, ids in zip(other, self.whole([self.blank + p for p in other]), strict=True):
            found[p] = ids
        for p, ids in found.items():
            if len(p) <= LONGEST and p and not p[0].isspace():
                known[p] = ids
                self.held += len(p) + len(ids) + ENTRY
        return found

    def look(self, texts: list[str], heads: list[bytes], pieces: list[str], ends: list[int]) -> list[bytes]:
        """Ids of texts from those of their first pieces and from their other pieces, which end at `ends`."""
        if self.held > self.room:
            self.known, self.older, self.held = {}, self.known, 0
        ids: list = list(map(self.known.get, pieces))
        missing, at = [], -1
        while True:
            try:
                at = ids.index(None, at + 1)
            except ValueError:
                break
            missing.append(at)
        torn = {bisect_right(ends, i) for i in missing if not pieces[i] or pieces[i][0].isspace()}
        torn = [k for k in torn if self.torn(texts[k])]
        found = self.learn({pieces[i] for i in missing})
        for i in missing:
            ids[i] = found[pieces[i]]
        out: list[bytes | None] = [h + b"".join(ids[lo:hi]) for h, lo, hi in zip(heads, [0, *ends], ends, strict=False)]
        for k, right in zip(torn, self.whole([texts[k] for k in torn]), strict=True):
            out[k] = right
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(texts)
        pieces: list[str] = []
        ends: list[int] = []
        heads: list[str] = []
        open_: list[int] = []
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[k] = self.whole([t])[0]
                continue
            cut = self.cut(t)
            heads.append(cut[0])
            pieces += cut[1:]
            ends.append(len(pieces)), open_.append(k)
            if len(pieces) > AT_ONCE or k == len(texts) - 1:
                self.close(texts, out, pieces, ends, heads, open_)
                pieces, ends, heads, open_ = [], [], [], []
        self.close(texts, out, pieces, ends, heads, open_)
        return out

    def close(self, texts, out, pieces, ends, heads, open_) -> None:
        if open_:
            for k, ids in zip(open_, self.look([texts[k] for k in open_], self.whole(heads), pieces, ends), strict=True):
                out[k] = ids


class WordEncoder(Encoder):
    """Vocabulary of lower-case words with word ends: white space is dropped, so pieces are words."""

    blank = ""

    def shown(self, letters: str) -> str:
        return letters.lower() if letters.isascii() else byte_letters(letters.lower())

    def cut(self, text: str) -> list[str]:
        return ["", *text.replace("\n", " ").split(" ")]

    def torn(self, text: str) -> bool:
        return False


def encoder(path: str | None = None, words: bool = False, room: int | None = None) -> Encoder:
    """One encoder for each worker process and vocabulary file; `room` bounds a generation of its store (BYTES unless given)."""
    only("tokens")
    path = path or public_tokenizers.path(WORD_VOCABULARY if words else DEFAULT_VOCABULARY)
    if path not in _encoders:
        _encoders[path] = (WordEncoder if words else Encoder)(path)
    _encoders[path].room = room or BYTES
    return _encoders[path]
