"""Exact ids of whole texts from a `tokenizers` file, each distinct word-like unit encoded once a worker.

Both vocabularies cut a text before every single space that stands between two non-space
characters, whatever surrounds it: byte_bpe_50k takes such a space as the first character of the
next piece, word_bpe_49k drops it. So the ids of a text are those of its units, joined.
"""
from __future__ import annotations

import os
import re
import struct
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters; longer units are encoded but not remembered.
LONG_UNIT = 200

_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def split_units(text: str) -> list[str]:
    """Units of a text when its blanks may stand in runs: cut only at lone spaces between non-blanks."""
    return _SAFE_CUT.split(text)


def quick_units(text: str) -> list[str]:
    """The same for ordinary texts; a unit without a non-blank shows that `split_units` is needed."""
    return split_units(text) if "\0" in text else text.replace(" ", "\0 ").split("\0")


def units_of(texts: list[str]) -> tuple[list[list[str]], set[str]]:
    """Units of each text, and all distinct ones."""
    parts = [quick_units(t) for t in texts]
    seen = set().union(*parts)
    blank = {u for u in seen if not u or u.isspace()}
    if blank:
        parts = [p if blank.isdisjoint(p) else split_units(t) for p, t in zip(parts, texts)]
        seen = set().union(*parts)
    return parts, seen


#: A word of Latin letters with at most a space before it, then marks: pieces of their own in both vocabularies.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)?([.,!?;:*#$%&|<>]*)")
_PROBES = ["a", " The", "Été", " Straße.", "Ñandú!!", " x|", "***", " And,***"]


def plain_pieces(unit: str) -> list[str] | None:
    """Words (with a space before the first, if any), marks and line breaks of a unit of plain lines; None if it isn't one."""
    found = [_PLAIN.fullmatch(line) for line in unit.split("\n")]
    if not all(m and m[0] for m in found) or any(m[0][0] == " " for m in found[1:]):
        return None
    out: list[str] = []
    for m in found:
        out += ["\n"] * bool(out) + [p for p in m.groups() if p]
    return out


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class UnitEncoder:
    """Encodes texts; remembers at most about `keep` units, and words in two generations of as many, so memory is bounded.

    A unit that is new is put together from its words, marks and line breaks where it is plain, so that only
    words not seen before reach the vocabulary's model; other units go through the whole tokenizer.
    """

    def __init__(self, path: str, keep: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "HI"[self.dtype.itemsize // 2 - 1]
        self.keep, self.now, self.before = keep, {}, {}  # words and marks that units are made of
        # known units, the number of ids of each, and all of these ids
        self.units, self.size, self.every = pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, self.dtype)
        # whether the model sees words as they are, or lower-cased without the space
        self.folds = None
        for folds in (False, True):
            if all(b"".join(self._modelled(p, folds) for p in plain_pieces(u)) == self._whole([u])[0] for u in _PROBES):
                self.folds = folds
                break

    def _whole(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _modelled(self, piece: str, folds: bool) -> bytes:
        """Ids of one plain piece, a word or marks, by the vocabulary's model."""
        if folds:
            piece = piece.strip().lower()
        # printable ASCII is written as it is
        shown = piece.replace(" ", self.letters[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _known(self, piece: str) -> bytes:
        if self.folds:  # a word is one entry, in whatever case, with a space before it or without
            piece = piece.strip().lower()
        ids = self.now.get(piece)
        if ids is None:
            ids = self.before.get(piece)
            self.now[piece] = ids = self._modelled(piece, self.folds) if ids is None else ids
        return ids

    def _composed(self, unit: str) -> bytes | None:
        """Ids of a unit put together from its plain pieces, or None."""
        if self.folds is None:
            return None
        if line := _PLAIN.fullmatch(unit):  # most units have one line
            word, marks = line.groups()
            if not marks:
                return self._known(word) if word else None
            return self._known(word) + self._known(marks) if word else self._known(marks)
        pieces = plain_pieces(unit)
        return None if pieces is None else b"".join([self.line_break if p == "\n" else self._known(p) for p in pieces])

    @cached_property
    def line_break(self) -> bytes:
        return self._whole(["\n"])[0]

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        out = [self._composed(u) if len(u) <= LONG_UNIT else None for u in units]
        new = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(new), 8192):
            some = new[at:at + 8192]
            for i, ids in zip(some, self._whole([units[i] for i in some])):
                out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids (`self.dtype`) of each text, without added special tokens.

        Texts are cut, and their units told apart and looked up among those known, in Arrow; only new units are encoded, each
        once. Units that no call has used since there were more than `keep` are forgotten.
        """
        if not texts:
            return []
        if len(self.now) > self.keep:
            self.before, self.now = self.now, {}
        # large_string: the texts of a call may hold more than 2 GB
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), " ", "\0 "), "\0")
        out, odd = self._encode_cut(parts.flatten(), parts.offsets.to_numpy())
        # blanks in runs or at the ends, or a \0 of the text's own: these texts are cut with more care
        odd |= np.fromiter(("\0" in t for t in texts), bool, len(texts))
        if odd.any():
            at = np.flatnonzero(odd).tolist()
            cut = [split_units(texts[i]) for i in at]
            rows = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
            careful, _ = self._encode_cut(pa.array([u for c in cut for u in c], pa.large_string()), rows, blanks=True)
            for i, ids in zip(at, careful):
                out[i] = ids
        return out

    def _encode_cut(self, cut: pa.Array, rows: np.ndarray, blanks: bool = False) -> tuple[list[bytes], np.ndarray]:
        """(ids, whether it has a blank unit) of each text i, whose units are `cut` from rows[i] to rows[i + 1] (one at least).
        Blank units have no ids unless `blanks`; they are never remembered."""
        unique = cut.dictionary_encode()
        codes, units = unique.indices.to_numpy(), unique.dictionary
        at = pc.index_in(units, value_set=self.units).fill_null(-1).to_numpy().copy()
        fresh = np.flatnonzero(at < 0)
        new = units.take(pa.array(fresh)).to_pylist()
        is_blank = np.fromiter((not u or u.isspace() for u in new), bool, len(new))
        got = [b""] * len(new)
        todo = np.flatnonzero(~is_blank | blanks).tolist()
        for i, ids in zip(todo, self._ids_of([new[i] for i in todo])):
            got[i] = ids
        size = np.concatenate([self.size, np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize])
        every = np.concatenate([self.every, np.frombuffer(b"".join(got), self.dtype)])
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        at[fresh] = np.arange(len(self.units), len(size))
        mine = at[codes]
        ends = np.concatenate([[0], np.cumsum(size[mine])])
        joined = every[np.repeat(first[mine] - ends[:-1], size[mine]) + np.arange(ends[-1])].tobytes()
        edges = (ends[rows] * self.dtype.itemsize).tolist()
        blank = np.zeros(len(units), bool)
        blank[fresh] = is_blank
        odd = np.add.reduceat(blank[codes], rows[:-1]) > 0
        self._remember(units, at, fresh, np.fromiter((len(u) <= LONG_UNIT for u in new), bool, len(new)) & ~is_blank, size, every, first)
        return [joined[a:b] for a, b in zip(edges, edges[1:])], odd

    def _remember(self, units: pa.Array, at: np.ndarray, fresh: np.ndarray, short: np.ndarray, size: np.ndarray, every: np.ndarray, first: np.ndarray) -> None:
        """Adds the new units that are short; above `keep`, only what this call used stays."""
        known = len(self.units)
        if known + int(short.sum()) <= self.keep:
            keep = np.concatenate([np.arange(known), known + np.flatnonzero(short)])
            self.units = pa.concat_arrays([self.units, units.take(pa.array(fresh[short]))])
        else:
            used = np.ones(len(units), bool)
            used[fresh[~short]] = False
            keep, self.units = at[used], units.filter(pa.array(used))
        n = size[keep]
        ends = np.concatenate([[0], np.cumsum(n)])
        self.every = every[np.repeat(first[keep] - ends[:-1], n) + np.arange(ends[-1])]
        self.size = n

    def counts(self, units: list[str]) -> list[int]:
        """Number of ids of each unit."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """The encoder of this Python worker: later tasks go on with what earlier ones have learnt."""
    return UnitEncoder(path)
