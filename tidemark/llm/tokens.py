"""Whole-text token ids from the public tokenizers, each white-space segment encoded once per memo.

Both vocabularies split at white space before any merge, so the ids of a text are the ids of its segments in a
row. Each worker keeps a bounded memo of segment -> ids. Plain segments (Latin letters, then punctuation) go
straight to the library's merge model; all others, and texts with rarer white space, to its full encoder.
"""

from __future__ import annotations

import re
import struct

#: Rarer white space and separators; a text with any of these is encoded whole.
_RARE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RARE_ASCII = re.compile("[\x1c-\x1f]")
_SEGMENT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Where words aren't one space or line end apart; a segment with one space before it.
_JOINED, _SPACED = re.compile(rb"[ \n][ \t-\r]|[\t\v\f\r]| \Z"), re.compile(rb" [^ \t-\r]")
_MARKS = b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~-"
#: A segment whose pre-tokens are certain: one space or line end, letters, punctuation.
_PLAIN = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{|}~-]*)")
#: Segments that a worker remembers, about 200 bytes each: half of them new, half from before; a segment that is met again stays.
MEMO = 800_000


class Encoder(dict):
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids, as add_special_tokens=False does.

    The mapping itself is the memo: segment -> ids. Where spaces count, a segment's key is what follows its one leading space, a segment that starts
    with a line end itself, and any other with a space before it. Texts in which a special token may stand are encoded whole.
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.special = sorted({t.content[:2] for t in self.tok.get_added_tokens_decoder().values()})
        self.before: dict[bytes, bytes] = {}
        self.drops_space = drops_space
        #: byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
        self.space = chr(self.alphabet[32])
        #: each id's four bytes
        self.four = [struct.pack("<I", i) for i in range(max(self.tok.get_vocab(with_added_tokens=True).values()) + 1)]
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, text: str) -> bytes:
        """Ids of one pre-token."""
        if (ids := self.pieces.get(text)) is None:
            if len(self.pieces) > MEMO // 2:
                self.pieces.clear()
            if text.isascii() and text.isalpha():
                mapped = text
            elif text[0] == " " and text.isascii() and text[1:].isalpha():
                mapped = self.space + text[1:]
            else:
                mapped = text.encode().decode("latin-1").translate(self.alphabet)
            ids = self.pieces[text] = self._merged(mapped)
        return ids

    def _merged(self, mapped: str) -> bytes:
        four = self.four
        return b"".join([four[t.id] for t in self.merge(mapped)])

    def __missing__(self, key: bytes) -> bytes:
        if (ids := self.before.get(key)) is None:
            ids = self._new(key)
        self[key] = ids
        return ids

    def _new(self, key: bytes) -> bytes:
        """Ids of a segment; those of its letters are in the memo as a segment of their own, so words need no second memo."""
        letters = key.rstrip(_MARKS)
        if not letters.isalpha():  # of bytes: letters of ASCII alone
            return self._segment(key if self.drops_space or key[:1] == b"\n" else key[1:] if key[:1] == b" " else b" " + key)
        if self.drops_space:
            letters = letters.lower()
        if letters == key:
            return self._merged(key.decode() if self.drops_space else self.space + key.decode())
        return self[letters] + self._piece(key[len(letters) :].decode()) if len(key) > len(letters) else self[letters]

    def _segment(self, segment: bytes) -> bytes:
        if self.drops_space:
            if segment.isalpha():  # of bytes: letters of ASCII alone
                return self._piece(segment.lower().decode())
        elif segment[:1] == b" " and segment[1:].isalpha():
            return self._piece(segment.decode())
        text = segment.decode()
        if m := _PLAIN.fullmatch(text):
            space, word, marks = m.groups()
            if self.drops_space:
                ids = self._piece(word.lower())
            elif space == "\n":
                ids = self._piece(space) + self._piece(word)
            else:
                ids = self._piece(space + word)
            if marks:
                ids += self._piece(marks)
        else:
            ids = self.whole(text)
        return ids

    def encode(self, text: bytes) -> bytes:
        plain = text.decode()
        if (_RARE if len(plain) < len(text) else _RARE_ASCII).search(plain) or any(x in plain for x in self.special):
            return self.whole(plain)
        if len(self) > MEMO // 2:
            self.before = dict(self)
            self.clear()
        if self.drops_space:
            keys = text.split()
        elif _JOINED.search(text):
            keys = [s[1:] if _SPACED.match(s) else s if s[:1] == b"\n" else b" " + s for s in _SEGMENT.findall(text)]
        else:  # splitting is faster than matching
            first, *keys = text.replace(b"\n", b" \n").split(b" ")
            if first:
                keys.insert(0, b" " + first)
        return b"".join(map(self.__getitem__, keys))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """The worker's encoder for this vocabulary file; workers live on between tasks."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = Encoder(path, drops_space)
    return _ENCODERS[path, drops_space]
