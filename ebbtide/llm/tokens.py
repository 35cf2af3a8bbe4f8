"""Tokenizing whole texts with the ``tokenizers`` library, a piece at a time.

Both public vocabularies cut a text before any merge: at white space, and between
letters, digits and other characters. So the ids of a text are those of its white-space
pieces one after the other, and those of a piece are those of its parts. Pieces repeat
far more often than texts: each task keeps the ids of pieces and of parts (as little-
endian bytes) in tables of bounded size and has the library's merge model encode unseen
parts only, which leaves out its normalizing and cutting of text that is cut already.
Before all else a text is cut at the strings of the vocabulary's added tokens, as the
library does: each is its one id, and the text between two of them is a text of its own.
The vocabulary file must be readable at the same path by every executor.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ebbtide.llm.common import KEPT

#: Entries of a task's table before the older half of its entries is given up; where texts
#: are encoded together, that of parts is the only large one.
CACHE = 300_000
PARTS_CACHE = 600_000
_ENCODERS: dict[tuple[str, bool], "PieceEncoder"] = {}
KEPT.append(_ENCODERS)

# How the two vocabularies cut a piece before merging.
_PARTS = {
    True: regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    False: regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"),
}


def _byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte in both vocabularies: itself if it is
    printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()
_SPACE = chr(_ALPHABET[32])


def encoder(path: str, spaces: bool) -> "PieceEncoder":
    """The worker's encoder of a vocabulary file; ``spaces``: whether a word's
    preceding space belongs to it (byte-level vocabularies) or is dropped."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = PieceEncoder(path, spaces)
    return _ENCODERS[path, spaces]


class Table(dict):
    """A table that makes a missing value on demand and keeps what was used lately:
    when it is full it starts anew and takes entries over from its predecessor."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value


    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


class PieceEncoder:
    def __init__(self, path: str, spaces: bool, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = {t.content: (k, t) for k, t in self.tok.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for _, t in added.values()):
            raise ValueError("added tokens that are not matched as they stand are not supported")
        self.added = {c.encode(): array("I", [k]).tobytes() for c, (k, _) in added.items()}
        # the longest of those that start at a place, as in the library
        self.find = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or b"(?!)")
        self.merge = self.tok.model.tokenize
        self.spaces = spaces
        self.parts = Table(self._encode_part, max(limit, PARTS_CACHE) if spaces and limit >= CACHE else limit)
        self.words = Table(self._encode_piece, limit)  # a piece as it stands
        self.after = Table(lambda p: self._encode_piece(b" " + p), limit)  # a piece and the space before it

    def _cut(self, piece: bytes) -> list[str] | None:
        """The parts of a piece; None where normalization could move them."""
        t = piece.decode()
        if self.spaces:
            return [t] if t.isascii() and t[1:].isalpha() and t[0] == " " else _PARTS[True].findall(t)
        if t.isascii():
            t = t.lower()
            return [t] if t.isalpha() else _PARTS[False].findall(t)
        if not unicodedata.is_normalized("NFC", t):
            return None
        return _PARTS[False].findall("".join(map(str.lower, t)))

    def _encode_part(self, part: str) -> bytes:
        # plain ASCII stands for itself in the byte alphabet, but for the space
        t = part.replace(" ", _SPACE) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [x.id for x in self.merge(t)]).tobytes()

    def _encode_piece(self, piece: bytes) -> bytes:
        cut = self._cut(piece)
        if cut is None:
            return array("I", self.tok.encode(piece.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.parts.__getitem__, cut))

    def ids(self, text: bytes) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not any(c in text for c in self.added):
            return self._plain(text)
        out, start = [], 0
        for m in self.find.finditer(text):
            out += [self._plain(text[start:m.start()]), self.added[m.group()]]
            start = m.end()
        return b"".join([*out, self._plain(text[start:])]) if out else self._plain(text)

    def _plain(self, text: bytes) -> bytes:
        """The ids of a text without added tokens."""
        if not self.spaces:
            return b"".join(map(self.words.__getitem__, text.split()))
        # a cut is safe where a single space stands between two other characters
        if _spaces_are_safe(text):
            first, *rest = text.split(b" ")
            return self.words[first] + b"".join(map(self.after.__getitem__, rest))
        out, start, t = [], 0, text.decode()
        for m in _SAFE.finditer(t):
            out.append(self.words[t[start:m.start()].encode()])
            start = m.start()
        out.append(self.words[t[start:].encode()])
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Where words carry their space, texts that may be cut at every
        space are encoded together: each distinct word of the batch is looked up once."""
        if not self.spaces:
            return [self.ids(t) for t in texts]
        out: list = [None] * len(texts)
        quick = []
        for k, t in enumerate(texts):
            if t and not any(c in t for c in self.added) and _spaces_are_safe(t):
                quick.append(k)
            else:
                out[k] = self.ids(t)
        for k, ids in zip(quick, self._together([texts[k] for k in quick])):
            out[k] = ids
        return out

    def _together(self, texts: list[bytes]) -> list[bytes]:
        heads = [t.partition(b" ") for t in texts]
        words = pc.split_pattern(pa.array([rest if space else None for _, space, rest in heads], pa.large_binary()), b" ")
        coded = words.flatten().dictionary_encode()
        pool, first, sizes = self._after_space(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)  # a batch of texts, far below 2^31 ids
        ids = pool[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1], dtype=np.int32)]
        at = ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())])]
        return [self.words[head] + ids[a:b].tobytes() for (head, _, _), a, b in zip(heads, at[:-1].tolist(), at[1:].tolist())]

    def _after_space(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces that follow a space, one after the other, and where each one's
        begin and how many they are. All pieces are cut at once: a space begins a piece, so
        the parts up to the next space are its own."""
        parts = _PARTS[True].findall((b" " + b" ".join(pieces)).decode()) if pieces else []
        ids = list(map(self.parts.__getitem__, parts))
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
        starts = [j for j, part in enumerate(parts) if part[0] == " "]
        if len(starts) != len(pieces):
            raise ValueError("pieces and parts do not agree")
        sizes = sizes.astype(np.int32)
        first = sizes[starts]
        return np.frombuffer(b"".join(ids), np.uint32), first, np.diff(first, append=sizes[-1])


def batches(texts: list[bytes | None], size: int = 1 << 20):
    """Runs (start, end) of the texts of about ``size`` bytes each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


# White space as the vocabularies see it (the White_Space property),
# as characters and as the UTF-8 bytes of those beyond ASCII.
_WS = "\t-\r \x85\xa0  -     　"
_WS_BYTES = (b"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: A space between two characters that are not white space.
_SAFE = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
#: Control characters that count as white space somewhere; single bytes are found fastest.
_CONTROLS = [bytes([c]) for c in b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"]
_BESIDE = [x for c in (*_CONTROLS, b"\n") for x in (c + b" ", b" " + c)]
_BEYOND = re.compile(_WS_BYTES)
_RARE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")


def _spaces_are_safe(text: bytes) -> bool:
    """Whether every space stands between two characters that are not white space. Fixed
    strings are looked for one by one, which takes a fraction of the time of one pattern."""
    if b"  " in text or text[:1] == b" " or text[-1:] == b" " or b"\n " in text or b" \n" in text:
        return False
    if any(c in text for c in _CONTROLS) and (any(x in text for x in _BESIDE) or text[-1:] in _CONTROLS or text[:1] in _CONTROLS):
        return False
    return text.isascii() or not (any(x in text for x in _RARE) and _BEYOND.search(text))
