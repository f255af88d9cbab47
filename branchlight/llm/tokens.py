"""Token ids of whole texts by the tokenizers library, fast on texts whose words repeat.

Both public BPE files split a text into pretokens that never span white space and a following word, so a text's ids
are those of its chunks (a word with at most one space before it, or a run of white space) in order. Ids of chunks
are kept as bytes in bounded dictionaries. Unseen chunks are encoded together: those with a character beyond ASCII
and the Latin-1 letters, and runs of white space, go through the whole tokenizer one by one; all others are split by one regular
expression with the meaning of the file's own pattern and handed to the tokenizer as ready pretokens.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Unicode's White_Space, as the tokenizers' patterns understand it.
SPACE = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_RUN = re.compile(f"[^{SPACE}]+")
#: White space for Python, not for the tokenizers.
_ODD = re.compile("[\x1c-\x1f]")
#: White space other than single spaces between words and single line ends between lines.
_UNEVEN = re.compile(f"[\t\x0b-\r\x01\x85\xa0{SPACE[6:]}]|[ \n][ \n]|^[ \n]|[ \n]$")
_PLAIN = re.compile(f" ?[\x00-\x08\x0e-\x1f!-\x7f{_LETTER}]+")
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPLITS = {
    True: re.compile(f"{_TAILS}| ?[{_LETTER}]+| ?[0-9]+| ?[^{SPACE}{_LETTER}0-9]+|\n"),
    False: re.compile(f"{_TAILS}|[{_LETTER}]+|[0-9]|[^{SPACE}{_LETTER}0-9]+|\n"),
}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if it prints, else the next code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkEncoder:
    """Encodes texts with one tokenizer file to little-endian unsigned 32-bit ids. Null counts as the empty text."""

    def __init__(self, path: str, most_chunks: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self._keeps_space = parts["normalizer"] is None
        self._split = _SPLITS[self._keeps_space]
        suffix = parts["model"].get("end_of_word_suffix") or ""
        self._lengths = np.zeros(1 + max(parts["model"]["vocab"].values()), np.int64)
        for piece, i in parts["model"]["vocab"].items():
            self._lengths[i] = len(piece.removesuffix(suffix))
        # The same model without the steps that the split below has done already.
        self._pretokens = Tokenizer.from_str(json.dumps(
            parts | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
        self._letters = _byte_letters() | {10: "\n"}  # the line end parts pretokens here
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._most = most_chunks

    @staticmethod
    def _chunk(name: str) -> str:
        """The chunk of a name in ``_words``."""
        return name[1:] if name[0] == "\x01" else name if name == "\n" else " " + name

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of unseen chunks."""
        out: dict[str, bytes] = {}
        plain = []
        for c in chunks:
            if c.isascii() and not c.isspace() or _PLAIN.fullmatch(c):
                plain.append(c)
            else:
                out[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        if plain:
            out.update(zip(plain, self._learn_plain(plain)))
        return [out[c] for c in chunks]

    def _learn_plain(self, plain: list[str]) -> list[bytes]:
        joined = "\n".join(plain)
        pieces = "\n".join(self._split.findall(joined if self._keeps_space else joined.lower()))
        # Between two chunks stand two empty pieces; within a chunk none is empty.
        flat = pieces.encode().decode("latin-1").translate(self._letters).split("\n")
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        ends = np.append(np.cumsum(size)[np.flatnonzero(size == 0)[::2]], size.sum())
        ids = np.array(self._pretokens.encode_batch_fast([[p for p in flat if p]], is_pretokenized=True,
                                                         add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.searchsorted(np.cumsum(self._lengths[ids]), ends) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def encode(self, texts: list[str | None], most_chars: int = 1 << 20) -> list[bytes]:
        """Ids of each text; about ``most_chars`` characters are worked on at once."""
        out: list[list[bytes | None]] = []
        missing: tuple[list[tuple[list[bytes | None], int, str]], ...] = ([], [])
        done = chars = 0
        for i, text in enumerate(texts):
            text = text or ""
            known = self._chunks
            if not self._keeps_space:
                chunks = _RUN.findall(text) if _ODD.search(text) else text.split()
            elif not text or _UNEVEN.search(text):
                chunks = _CHUNK.findall(text)
            else:
                # The common case, by plain splitting: a name is a word after a space, or 0x01 and a word after none.
                known = self._words
                chunks = ("\x01" + text.replace("\n", " \n \x01")).split(" ")
            parts = list(map(known.get, chunks))
            if None in parts:
                missing[known is self._words].extend((parts, at, chunks[at]) for at, p in enumerate(parts) if p is None)
            out.append(parts)
            chars += len(text)
            if chars >= most_chars or i + 1 == len(texts):
                for names, found in zip((self._chunks, self._words), missing):
                    if found:
                        if len(names) > self._most:
                            names.clear()
                        new = list({c for _, _, c in found})
                        chunks = new if names is self._chunks else [self._chunk(c) for c in new]
                        names.update(zip(new, self._learn(chunks)))
                        for parts, at, chunk in found:
                            parts[at] = names[chunk]
                        found.clear()
                out[done:] = [b"".join(p) for p in out[done:]]
                done, chars = len(out), 0
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a tokenizer file; tasks of the same worker share its dictionary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encoded(path: str, texts: list[str | None], end_id: int) -> list[bytes]:
    """Serialized ids of each text with the end id appended."""
    end = np.array([end_id], "<u4").tobytes()
    return [ids + end for ids in encoder(path).encode(texts)]
