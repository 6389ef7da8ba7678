"""Fast exact use of public tokenizers on whole texts.

The tokenizers split at a space between two other characters, so a text may
be cut there and equal pieces encoded once: pieces seen before come from a
table in the worker.  New pieces that are plain Latin words, with ASCII
punctuation at most after them, go straight to the tokenizer's BPE model; all others go
through the whole tokenizer.  Where a space meets white space, or where an added
token of the tokenizer stands in a text, the text is encoded whole instead.  The
ids are those of the library's ``encode`` whatever the worker has seen before.
"""

from __future__ import annotations

import os
import re
from array import array

from .bytewords import KEPT_IN_WORKER

_ODD_SPACE = re.compile(r" \s|\s |^ | \Z")
_RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: ASCII punctuation: after a word it is one run for both tokenizers.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
#: Pieces kept by a worker; the table starts anew beyond it.
KEPT = 900_000

#: Byte-level alphabet: printable Latin-1 characters stand for their bytes, the other bytes for characters from U+0100.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def default_path(name: str) -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd(text: str) -> bool:
    """Whether a space meets other white space or an end of the text."""
    if any(c in text for c in _RARE_SPACES):
        return bool(_ODD_SPACE.search(text))
    return "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "


class Pieces(dict):
    """Ids of pieces after a space; a piece that is missing is encoded as it is looked up."""

    def __init__(self, piece):
        self.piece = piece

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.piece(piece)
        return ids


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers in bytes.

    ``path``: a file of the tokenizers library, used as it is; the library adds no
    tokens of its own at the ends of a text.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.lead = whole(" a") != whole("a")
        self.lower = whole("A") == whole("a")
        self.space = _ALPHABET[32] if self.lead else ""
        self.seen = Pieces(self._piece)
        self.kept = KEPT
        self.runs: dict[str, bytes] = {"": b""}
        self.line_end = array("I", whole("\n")).tobytes()
        probes = ["the", "Word", "été", "lügen", "ñandú", "ends.", "Comma,", "straße.", "ÀÉÎ", "a***", "b!!", "end.\nNext", "x\ny,\nz%%%", "it'", "a...,"]
        self.direct = True
        self.direct = all(self._plain(p) == array("I", whole(" " + p)).tobytes() for p in probes)

    @classmethod
    def of(cls, path: str, kept: int = KEPT) -> Encoder:
        """One encoder a worker and path; ``kept`` bounds its table of pieces."""
        if path not in cls._open:
            cls._open[path] = cls(path)
            if not any(held is cls._open for held in KEPT_IN_WORKER):
                KEPT_IN_WORKER.append(cls._open)
        cls._open[path].kept = kept
        return cls._open[path]

    def _word(self, word: str, lead: str) -> bytes | None:
        """Ids of a plain Latin word after ``lead``; None for other texts."""
        if not word.isalpha() or not word.isascii() and max(word) >= "Ā":
            return None
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(lead + word)]).tobytes()

    def _marks(self, marks: str) -> bytes:
        """Ids of a run of ASCII punctuation that follows a word."""
        if marks not in self.runs:
            if len(self.runs) > 10_000:
                self.runs = {"": b""}
            self.runs[marks] = array("I", [t.id for t in self.model.tokenize(marks)]).tobytes()
        return self.runs[marks]

    def _plain(self, piece: str) -> bytes | None:
        """Ids of a space and ``piece``, if that is words and trailing punctuation with single line ends between; else None."""
        if not self.direct:
            return None
        if "\n" not in piece:
            word = piece.rstrip(_MARKS)
            # an entry of letters alone is what ``_word`` gives; other entries may be marks that join those after them
            own = word.isascii() and word.isalpha() and self.seen.get(word) or self._word(word, self.space)
            return None if own is None else own + self._marks(piece[len(word) :])
        ids, lead = b"", self.space
        for n, part in enumerate(piece.split("\n")):
            word = part.rstrip(_MARKS)
            own = self._word(word, lead)
            if own is None:
                return None
            ids += (self.line_end if n else b"") + own + self._marks(part[len(word) :])
            lead = ""
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and ``piece``."""
        ids = (self._word(piece, self.space) if piece.isalpha() else self._plain(piece)) if self.direct else None
        return self._whole([" " + piece])[0] if ids is None else ids

    def _has_added(self, text: str) -> bool:
        low = text.lower()
        return any(t in low for t in self.added)

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), 1024):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)]
        return out

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text is empty."""
        if len(self.seen) > self.kept:
            self.seen.clear()
        known = self.seen.__getitem__
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        alone: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if _odd(text) or self._has_added(text):
                alone.append((i, text))
                continue
            first, *rest = text.split(" ")
            alone.append((i, first))
            if rest:
                cut.append((i, rest))
        for (i, _), ids in zip(alone, self._whole([t for _, t in alone])):
            out[i] = ids
        for i, rest in cut:
            out[i] += b"".join(map(known, rest))
        return out
