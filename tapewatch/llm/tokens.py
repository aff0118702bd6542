"""Token ids of whole texts by a tokenizer file, encoding every distinct chunk of a text once.

A tokenizer that never lets a token reach from a word into the white space after it gives the same ids for a text as
for its chunks one after the other. Most chunks come again, so their ids are kept in a bounded table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Chunks and ids that are kept at most; beyond, those that came only once since the last time go.
KEPT_CHUNKS, KEPT_IDS = 600_000, 6_000_000
_OTHER_SPACE = re.compile(r"[^\S \n]|\x00")
_WITH_SPACE = re.compile(r"[ \n]*[^ \n\x00]+|[ \n]+")
#: The place between a letter and a mark that ends its chunk: tokenizers that part letters from marks part here.
_MARK = re.compile(r"(?<=[A-Za-z\u00e0-\u00f6\u00f8-\u00ff])(?=[.,](?:[ \n]|\Z))")


#: Chunks that are one word of Latin letters, as both kinds of tokenizers leave them.
_WORD = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SPACED_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: A chunk that ends with a mark behind a letter, which is a chunk of its own.
_MARKED = re.compile(r"(.*[A-Za-z\u00e0-\u00f6\u00f8-\u00ff])([.,])", re.S)
#: White space other than blank and line feed, and the zero byte that stands before a text's first chunk.
_RARE = [c for c in map(chr, range(0x3001)) if c == "\x00" or (c.isspace() and c not in " \n")]
_START = "\x00"


def _blank_chunks(text: str) -> list[str] | None:
    """The chunks of a text by the blanks in it, which are left out: each but the first, or one that begins with a line feed, stands for itself
    with a blank in front. None where white space comes in other runs than one blank or line feeds, or is of another kind."""
    if "  " in text or " \n" in text or "\n " in text or any(c in text for c in _RARE):
        return None
    if "\n" in text:
        text = text.replace("\n", " \n")
        while "\n \n" in text:
            text = text.replace("\n \n", "\n\n")
    out = text.split(" ")
    out[0] = _START + out[0]
    return out


def _byte_letters() -> dict[int, str]:
    """Byte-level models see a byte as itself where Latin-1 prints it, else as a letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class _Places(dict):
    """Numbers chunks in the order in which they are first asked for."""

    def __init__(self, names: list[str]) -> None:
        super().__init__(zip(names, range(len(names))))
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """``drops_space``: the tokenizer has no tokens for white space and ignores the case of ASCII letters; else a chunk has
    the white space in front of it."""

    def __init__(self, path: str, drops_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word = _WORD if drops_space else _SPACED_WORD
        probe = ["the", "of", "tokenizer", "q", "zzxxqy", "internationalisation", "ouneauxtion", "a" * 40, "straße", "éàü", "ñandú", "ÿø"]
        probe += [] if drops_space else [f" {w.title()}" for w in probe]
        self.plain = all(self._ids([w]) == [self._word_ids(w)] for w in probe)
        self.marks = {m: self._ids([m])[0] for m in ".,"}
        self.place = _Places([])
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 12, dtype=np.int64)  # ends[k + 1]: end of the k-th chunk's ids
        self.hits = np.zeros(1 << 12, dtype=np.int64)

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word_ids(self, word: str) -> list[int]:
        """A word's ids by the library's model alone, without the steps in front of it that leave a word whole."""
        letters = word.replace(" ", _LETTERS[32]) if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def _written(self, chunk: str) -> str:
        """A chunk as it stands in the text."""
        if chunk[:1] in (" ", "\n"):
            return chunk
        return chunk[1:] if chunk[:1] == _START else " " + chunk

    def _parted(self, chunk: str) -> list[str]:
        m = _MARKED.fullmatch(chunk)
        return [m[1], m[2]] if m else [chunk]

    def _quick(self) -> list[list[int] | None]:
        """The ids of new chunks that are an ASCII word behind a blank, perhaps with a mark behind it; None for others."""
        if not self.plain:
            return [None] * len(self.place.new)
        tokenize, blank, marks = self.tokenizer.model.tokenize, _LETTERS[32], self.marks
        out: list[list[int] | None] = []
        for c in self.place.new:
            if not c.isascii():
                out.append(None)
            elif c.isalpha():
                out.append([t.id for t in tokenize(blank + c)])
            elif c[-1:] in marks and c[:-1].isalpha():
                out.append([t.id for t in tokenize(blank + c[:-1])] + marks[c[-1]])
            else:
                out.append(None)
        return out

    def _spaced(self) -> list[list[int]]:
        """The ids of new chunks of a tokenizer whose chunks have white space in front."""
        quick = self._quick()
        parts = [self._parted(self._written(c)) for c, q in zip(self.place.new, quick) if q is None]
        words = [self.plain and self.word.fullmatch(p[0]) is not None for p in parts]
        asked = dict.fromkeys(c for p, w in zip(parts, words) for c in p[w:])
        others = dict(zip(asked, self._ids(list(asked))))
        rest = ([*(self._word_ids(p[0]) if w else ()), *(i for c in p[w:] for i in others[c])] for p, w in zip(parts, words))
        return [next(rest) if q is None else q for q in quick]

    def _add(self) -> None:
        """Encodes the chunks that were asked for first just now."""
        if self.drops_space:
            new, self.place.new = self.place.new, []
            words = [self.plain and self.word.fullmatch(c) is not None for c in new]
            others = iter(self._ids([c for c, w in zip(new, words) if not w]))
            found = [self._word_ids(c) if w else next(others) for c, w in zip(new, words)]
        else:
            found = self._spaced()
            new, self.place.new = self.place.new, []
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        n = len(self.place) - len(new)
        at = int(self.ends[n])
        while len(self.ids) < at + sizes.sum():
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) < n + len(new) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.ids[at:at + sizes.sum()] = [i for x in found for i in x]
        self.ends[n + 1:n + 1 + len(new)] = at + np.cumsum(sizes)
        self.hits[n:n + len(new)] = 0

    def _shrink(self) -> None:
        n = len(self.place)
        keep = self.hits[:n] > 1
        if keep.sum() > KEPT_CHUNKS // 2 or self.ends[n] > KEPT_IDS * 2:
            keep[:] = False
        sizes = np.diff(self.ends[:n + 1])
        self.ids[:sizes[keep].sum()] = self.ids[:self.ends[n]][np.repeat(keep, sizes)]
        names = [c for c, k in zip(self.place, keep.tolist()) if k]
        self.place = _Places(names)
        self.ends[0] = 0
        self.ends[1:len(names) + 1] = np.cumsum(sizes[keep])
        self.hits[:len(names)] = 0

    def _chunks(self, text: str) -> list[str]:
        if not self.drops_space and not any(t in text for t in self.special):
            quick = _blank_chunks(text)
            if quick is not None:
                return quick
        if _OTHER_SPACE.search(text) or any(t in text for t in self.special):
            return [text] if self.drops_space else [_START + text]
        if self.drops_space:
            return [x for x in _MARK.sub(" ", text.encode().lower().decode()).replace("\n", " ").split(" ") if x]
        found = _WITH_SPACE.findall(_MARK.sub("\x00", text))
        return [c if c[:1] in (" ", "\n") else _START + c for c in found]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 borders; a null text is empty."""
        parts = [self._chunks(t or "") for t in texts]
        chunks = [c for p in parts for c in p]
        if len(self.place) > KEPT_CHUNKS or self.ends[len(self.place)] > KEPT_IDS:
            self._shrink()
        at = np.fromiter(map(self.place.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if self.place.new:
            self._add()
        self.hits[:len(self.place)] += np.bincount(at, minlength=len(self.place))
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        chunk_ends = np.cumsum([0, *map(len, parts)])
        return ids, np.append(0, ends)[chunk_ends]


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path, drops_space)


def encoded(batches: Iterator[pa.RecordBatch], path: str, drops_space: bool, end_id: int,
            size: int = 1 << 20) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids of rows, token ids, borders) for slices of (row id, text) batches; each text ends with ``end_id``."""
    encode = encoder(path, drops_space)
    for batch in batches:
        rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(rows):
            to, held = at, 0
            while to < len(rows) and (to == at or held < size):
                held += len(texts[to] or "")
                to += 1
            ids, borders = encode(texts[at:to])
            own = np.diff(borders)
            out = np.full(len(ids) + len(own), end_id, dtype=np.uint32)
            shift = np.repeat(np.arange(len(own)), own)
            out[np.arange(len(ids)) + shift] = ids
            yield rows[at:to], out, borders + np.arange(len(borders))
            at = to
