"""Token ids of whole texts, encoded once per distinct piece and worker."""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memory import keeps

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Bytes of the pieces and their ids, and of what goes with each, that a worker remembers before it starts afresh.
REMEMBERED_BYTES, ENTRY_BYTES = 192 << 20, 150
#: Longest piece that is remembered; longer ones seldom repeat.
_REMEMBERED = 64
# Characters that are certainly no white space to any version of Unicode are "solid".
_SOLID = r"!-~\u00a1-\u167f"
_NEITHER = re.compile(rf"[^\n {_SOLID}]")
_SOLID_SPACE = re.compile(rf"(?<=[{_SOLID}]) (?=[{_SOLID}])")
_SOLID_LINE = re.compile(rf"(?<=[{_SOLID}])\n(?=[{_SOLID}])")
# The same for Arrow: texts in which not every space and line break stands alone between two solid characters.
_UNEVEN = r"[^\n !-~\x{a1}-\x{167f}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Bytes of texts that are encoded together.
TOGETHER_BYTES = 8 << 20


# Latin letters, letters to every version of Unicode.
_LETTERS = r"[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_WORD = re.compile(_LETTERS)
_MARKED_WORD = re.compile(rf"( ?{_LETTERS})([!-/:-@\[-`{{-~]+)")


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids of pieces seen so far, each with ``lead`` before it; an unknown one is encoded when asked for."""

    size = 0

    def __init__(self, lead: str, encode, limit: int):
        self._lead, self._encode, self._limit = lead, encode, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self._encode(self._lead + piece)
        if len(piece) <= _REMEMBERED:
            held = len(piece) + len(ids) + ENTRY_BYTES
            self.size += held
            if self.size > self._limit:
                self.clear()
                self.size = held
            self[piece] = ids
        return ids


class Encoder:
    """Ids of a byte-level BPE tokenizer as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins characters across a space that stands between
    two characters that are not white space: what comes before ends there and the
    space opens the next pre-token. So a text is cut at such spaces, and the ids
    of the pieces in a row are the ids of the text. Words repeat, so nearly all
    pieces are found in the worker's table.
    """

    def __init__(self, path: str, remembered_bytes: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config["pre_tokenizer"] or {}
        added = config["added_tokens"]
        self._cut = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and config["normalizer"] is None and config["post_processor"] is None
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        # A piece with one of these goes to the library as it is.
        self._special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)").search
        letters = _byte_letters()
        self._space = letters[0x20]
        self._letters = dict(enumerate(letters))
        self._first = _Pieces("", self._piece, remembered_bytes // 8)
        self._after_space = _Pieces(" ", self._piece, remembered_bytes - remembered_bytes // 8)

    def _library(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Encode a piece seen for the first time.

        A word of plain letters, with or without the space before it, is one
        pre-token and goes to the model directly; a line break between two solid
        characters and a run of marks at the end are pre-tokens of their own.
        """
        body = piece[1:] if piece[:1] == " " else piece
        if body.isascii() and body.isalpha():  # such letters stand for themselves
            mapped = body if body is piece else self._space + body
            return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()
        if _WORD.fullmatch(body):
            mapped = piece.encode().decode("latin-1").translate(self._letters)
            return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()
        if self._special(piece):
            return self._library(piece)
        if "\n" in body:
            lines = _SOLID_LINE.split(piece)
            if len(lines) > 1:
                after = [self._first["\n"] + self._first[line] for line in lines[1:]]
                return b"".join([self._own(lines[0]), *after])
        if marked := _MARKED_WORD.fullmatch(piece):
            return self._own(marked[1]) + self._first[marked[2]]
        return self._library(piece)

    def _own(self, piece: str) -> bytes:
        return self._after_space[piece[1:]] if piece[:1] == " " else self._first[piece]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; nothing for a null or empty one."""
        if not text:
            return b""
        if not self._cut or sys.byteorder != "little":
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "  " in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text or _NEITHER.search(text):
            words = _SOLID_SPACE.split(text)
        else:
            words = text.split(" ")
        return self._first[words[0]] + b"".join(map(self._after_space.__getitem__, words[1:]))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """What ``encode`` gives for each text of an Arrow array; pieces are looked up once per distinct one of a few MB."""
        if not self._cut or sys.byteorder != "little":
            yield from map(self.encode, (text.as_py() for text in texts))
            return
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            bound = (ends[first - 1] if first else 0) + TOGETHER_BYTES
            last = max(first + 1, int(np.searchsorted(ends, bound, "right")))
            yield from self._together(texts.slice(first, last - first))
            first = last

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        even = pc.and_not(pc.greater(pc.binary_length(texts), 0), uneven).fill_null(False)
        # A line break opens a piece, as a space does.
        split = pc.split_pattern(pc.replace_substring(texts.filter(even), "\n", " \n"), " ")
        found = self._looked_up(split) if len(split) else iter(())
        for text, is_even in zip(texts, even.to_pylist()):
            yield next(found) if is_even else self.encode(text.as_py())

    def _looked_up(self, split: pa.ListArray) -> Iterator[bytes]:
        """The ids of each list of pieces: distinct pieces from the tables, then put in order."""
        coded = split.flatten().dictionary_encode()
        at, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        begins = bounds[:-1]
        openers = coded.dictionary.take(coded.indices.take(pa.array(begins))).to_pylist()
        at[begins] = n + np.arange(len(begins))
        wanted = np.zeros(n + len(begins), dtype=bool)
        wanted[at] = True
        first, after, line = self._first, self._after_space, self._first["\n"]
        known = [
            b"" if not w else line + first[piece[1:]] if piece[0] == "\n" else after[piece]
            for piece, w in zip(coded.dictionary.to_numpy(zero_copy_only=False), wanted.tolist())
        ]
        known += [first[piece] for piece in openers]
        lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat((starts[at] - stops[:-1]).astype(np.int32), sizes)
        place += np.arange(len(place), dtype=np.int32)
        ids = np.frombuffer(b"".join(known), dtype="<u4")[place]
        cuts = stops[bounds]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield ids[a:b].tobytes()


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: a byte that
    prints stands for itself, the others follow from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@lru_cache(maxsize=4)
def encoder(path: str, remembered_bytes: int = REMEMBERED_BYTES) -> Encoder:
    """One encoder per worker process, vocabulary and bound."""
    return Encoder(path, remembered_bytes)


keeps("tokens", encoder.cache_clear)
