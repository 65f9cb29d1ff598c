"""Token ids of whole texts, by a byte-level BPE file of the tokenizers library.

Such a file cuts a text into pieces before it merges bytes, and merges never
cross a cut. Where the cuts of a text of ASCII and Latin letters are can be seen
from its bytes alone, for many texts at once; each different piece goes through
the library once and a bounded memory keeps its ids. Texts with other bytes or
with the text of an added token, and files of another kind, go through the
library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import MIX_1, mixed, text_slices
from .hashing import powers, prefix_sums

#: What a byte is: a letter, a digit, white space, another visible sign, or what only the library reads.
LETTER, DIGIT, WHITE, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[[9, 10, 11, 12, 13, 32]] = WHITE
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
SPACE, APOSTROPHE = 32, 39


def kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte; both bytes of U+00C0 to U+00FF are a letter's, but for the two signs among them."""
    out = KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)
    second = raw[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    out[lead] = out[lead + 1] = LETTER
    return out


def piece_starts(raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin that the library never merges across.

    A cut is where the kind changes, but not beside an apostrophe (contractions
    are left to the library), and a single space belongs to what follows it. Of
    two or more white bytes before a visible one the last is cut off.
    """
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    white = kind == WHITE
    cut = edge[:-1].copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & (raw[1:] != APOSTROPHE) & (raw[:-1] != APOSTROPHE)
    ends_run = white & ~edge[1:] & np.append(~white[1:], True)
    follows_white = np.concatenate([[False], white[:-1]]) & ~edge[:-1]
    cut |= white & ~follows_white
    cut |= ends_run
    cut[1:] |= ~white[1:] & white[:-1] & (raw[:-1] != SPACE)
    cut[1:] &= ~(~white[1:] & (raw[:-1] == SPACE)) | edge[1:-1]
    return np.flatnonzero(cut)


class _Table:
    """Places of 64-bit keys, in open addressing; key 0 is no key."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.at, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Give new, different keys the next places."""
        places = np.arange(self.n, self.n + len(keys))
        left, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            won = self.keys[slot] == keys[left]
            self.at[slot[won]] = places[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & int(self.mask)
        self.n += len(keys)
        return places


class Encoder:
    """Ids of texts; worker processes keep the memory of pieces between tasks."""

    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, bits: int = 21):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        cuts = file.get("pre_tokenizer") or {}
        self.plain = file.get("normalizer") is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.bits = bits
        self.restart()

    def restart(self) -> None:
        self.table = _Table(self.bits)
        self.first, self.count = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids, self.used = np.zeros(1 << 14, self.type), 0

    @classmethod
    def at(cls, path: str, bits: int = 21) -> Encoder:
        if (path, bits) not in cls._made:
            cls._made[path, bits] = cls(path, bits)
        return cls._made[path, bits]

    @classmethod
    def forget(cls) -> None:
        """Give the memory back, for a task that encodes nothing."""
        cls._made.clear()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def _learn(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, some: int = 4096) -> np.ndarray:
        """Put new pieces through the library; their places."""
        places = self.table.add(keys)
        if self.table.n > len(self.first):
            grow = np.zeros(max(len(self.first), self.table.n - len(self.first)), np.int32)
            self.first, self.count = np.concatenate([self.first, grow]), np.concatenate([self.count, grow])
        for k in range(0, len(keys), some):
            words = [raw[a:b].decode() for a, b in zip(start[k : k + some].tolist(), end[k : k + some].tolist())]
            got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids, n = np.array(got.ids, self.type), np.bincount(np.array(got.word_ids, np.int64), minlength=len(words))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.type)])
            self.ids[self.used : self.used + len(ids)] = ids
            here = places[k : k + some]
            self.count[here], self.first[here] = n, self.used + np.cumsum(n) - n
            self.used += len(ids)
        return places

    def _pieces(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts, and where each text's begin."""
        if not len(raw):
            return np.zeros(0, self.type), np.zeros(len(offsets), np.int64)
        start = piece_starts(raw, kind, offsets)
        end = np.append(start[1:], len(raw))
        sums = prefix_sums(raw)
        keys = mixed((sums[end] - sums[start]) * powers(len(raw))[1][start] + (end - start).astype(np.uint64) * MIX_1) | np.uint64(1)
        different, one, of = np.unique(keys, return_index=True, return_inverse=True)
        if self.table.n + len(different) > len(self.table.keys) // 2:
            self.restart()
            while len(different) > len(self.table.keys) // 2:
                self.table = _Table(int(self.table.mask).bit_length() + 1)
        place = self.table.find(different)
        new = place < 0
        if new.any():
            place[new] = self._learn(different[new], raw.tobytes(), start[one[new]], end[one[new]])
        place = place[of]
        n = self.count[place].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.first[place] - (ends - n), n) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, offsets)]

    def slices(self, column: pa.Array):
        """For runs of rows of a text column: first row, last row + 1, their ids
        one after another, and where each row's begin. Nulls are empty."""
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        marked = np.zeros(len(column), bool)
        for text in self.added:
            marked |= pc.fill_null(pc.match_substring(column, text), False).to_numpy(zero_copy_only=False)
        for a, b, raw, offsets in text_slices(column):
            kind = kinds(raw)
            odd = np.concatenate([[0], np.cumsum(kind == OTHER)])
            through = marked[a:b] | (np.diff(odd[offsets]) > 0) | (not self.plain)
            if not through.any():
                yield a, b, *self._pieces(raw, kind, offsets)
                continue
            size = np.diff(offsets)
            keep = np.repeat(~through, size)
            ids, begin = self._pieces(raw[keep], kind[keep], np.concatenate([[0], np.cumsum(np.where(through, 0, size))]))
            parts = [self.whole(raw[offsets[k] : offsets[k + 1]].tobytes().decode()) if t else ids[begin[k] : begin[k + 1]] for k, t in enumerate(through)]
            yield a, b, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def ended(self, column: pa.Array, end_id: int):
        """The same with an end id after each row."""
        for a, b, ids, begin in self.slices(column):
            yield a, b, np.insert(ids, begin[1:], end_id), begin + np.arange(len(begin))

    def encode_one(self, text: str | None) -> np.ndarray:
        return next(self.slices(pa.array([text or ""])))[2]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
