"""Token ids of whole texts with a public tokenizer, chunk by chunk.

The tokenizer lower-cases, drops white space, never joins what white space separates, and ends a run of
letters before a stop or comma. So a text's ids are its chunks' ids one after the other, with chunks cut
at blanks, tabs and line ends and between an ASCII letter and a mark of ``.,;:!?``. A task encodes each
distinct chunk once and remembers it by its 64-bit hash; the memory is bounded and starts anew when full.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from runlake.llm.words import LOWER, gather, hashes, slices, spans

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Marks the end of each document.
END = 1
#: Characters at which a text may be cut without changing its ids.
CUTS = np.zeros(256, bool)
CUTS[[32, 9, 10, 13]] = True
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[list(range(65, 91)) + list(range(97, 123))] = True
MARK[list(b".,;:!?")] = True
#: Letters that neither composition nor lower case turns into anything but one letter.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch
#: Distinct chunks that a task remembers, and the longest (bytes).
REMEMBERED, LONGEST = 1_000_000, 64


class Chunks:
    """Ids by chunk hash: ``keys`` is sorted; the ids of keys[i] are pool[start[i]:start[i] + length[i]]."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for x, i in words.items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each text's ids, and the ids they refer to.

        Texts of Latin letters alone are one word each, and the last id of a word ends it: many are encoded
        as one text and parted there.
        """
        plain = np.fromiter((PLAIN(x) is not None for x in texts), bool, len(texts))
        start, length, pool, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)], 0
        for block in np.array_split(np.flatnonzero(plain), 1 + int(plain.sum()) // 4096):
            ids = np.array(self.tokenizer.encode(" ".join([texts[i] for i in block]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(block):
                length[block] = np.diff(ends, prepend=0)
                start[block] = size + ends - length[block]
                pool.append(ids)
                size += len(ids)
            else:
                plain[block] = False
        rest = np.flatnonzero(~plain)
        for i, x in zip(rest.tolist(), self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if len(rest) else ()):
            start[i], length[i] = size, len(x.ids)
            pool.append(np.array(x.ids, np.uint32))
            size += len(x.ids)
        return start, length, np.concatenate(pool)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of each chunk's ids, and all ids."""
        keys, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        new_start, new_length, ids = self.ids([raw[starts[i] : ends[i]].decode() for i in first[new]])
        new_start += len(self.pool)
        pool = np.concatenate([self.pool, ids])
        start, length = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        start[known], length[known] = self.start[at[known]], self.length[at[known]]
        start[new], length[new] = new_start, new_length
        out = length[inverse], pool[gather(start[inverse], length[inverse])]
        keep = new[(ends - starts)[first[new]] <= LONGEST]
        if len(self.keys) + len(keep) > REMEMBERED:
            self.clear()
        elif len(keep):
            kept = np.isin(new, keep)
            put = at[keep]
            self.keys = np.insert(self.keys, put, keys[keep])
            self.start = np.insert(self.start, put, new_start[kept])
            self.length = np.insert(self.length, put, new_length[kept])
            self.pool = pool
        return out


@lru_cache(2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def encoded(column: pa.Array, path: str = TOKENIZER, end: int | None = END) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds of the rows' ids, ids) for slices of a string column; ``end`` follows each row's ids."""
    for at, data, offsets in slices(column):
        if b"<|" not in data.tobytes():  # else it may hold the name of a special token, which has a case
            data = LOWER[data]
        cut = MARK[data]
        cut[1:] &= LETTER[data[:-1]]
        cut[:1] = False
        starts, ends, words = spans(data, offsets, CUTS, cut)
        length, ids = chunks(path).encode(data, starts, ends)
        before = np.concatenate([[0], np.cumsum(length)])[words]
        if end is not None:
            ids = np.insert(ids, before[1:], end)
            before = before + np.arange(len(before))
        yield at, before, ids.astype(np.uint32, copy=False)


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
