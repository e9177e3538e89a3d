"""Byte-level BPE by pre-tokens: vocabulary strings proven whole are looked up, only the rest is merged.

The tokenizer cuts a text into pre-tokens by a fixed pattern and merges bytes within each of them alone.
``prove`` lists, before any text is read, the vocabulary strings that are one pre-token and encode to
their own id alone; where such a string is a pre-token of a text, its id is known without a merge. Other
pre-tokens go through the tokenizer, each distinct one once; what a task remembers of them is bounded.

The pattern's classes (letter, number, space) come from two Unicode tables, the tokenizer's and Python's,
of different years. Texts within ``SETTLED``, blocks on which both agree (a test compares every code
point), are cut here; any other text is encoded whole by the tokenizer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: First and last code point of blocks that both Unicode tables class alike.
BLOCKS = ((0x0, 0x557), (0x591, 0x85F), (0x900, 0xBFF), (0xE00, 0xE5F), (0x1E00, 0x207F), (0x20A0, 0x20BF), (0x2100, 0x2AFF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF), (0x1F300, 0x1F6FF))
SETTLED = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" if a else f"\\x00-{chr(b)}" for a, b in BLOCKS) + "]*").fullmatch
#: The pattern that cuts texts, as the tokenizer's file means it.
PRE_TOKENS = regex.compile(public_tokenizers.PATTERN).findall
#: Distinct merged pre-tokens that a task remembers, and the longest (characters).
REMEMBERED, LONGEST = 300_000, 64


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str = BYTE_BPE) -> list[bytes]:
    """The bytes of each id; those of added tokens are their strings."""
    tokenizer, table = Tokenizer.from_file(path), byte_of()
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = added[i] if i in added else bytes(table[c] for c in token)
    return out


@lru_cache(2)
def prove(path: str = BYTE_BPE) -> dict[str, int]:
    """id by string of the vocabulary strings that are one pre-token and, encoded alone, are their own single id.

    Strings that are no UTF-8 text cannot be a pre-token. The result is bounded by the vocabulary.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    added = tokenizer.get_added_tokens_decoder()
    strings = {}
    for i, raw in enumerate(token_bytes(path)):
        try:
            strings[raw.decode()] = i
        except UnicodeDecodeError:
            continue
    alone = [s for s, i in strings.items() if i not in added and SETTLED(s) and PRE_TOKENS(s) == [s]]
    found = tokenizer.encode_batch_fast(alone, add_special_tokens=False)
    return {s: strings[s] for s, x in zip(alone, found) if x.ids == [strings[s]]}


class ByLookup:
    """Values of texts' pre-tokens in ``table``: at first those of the whole tokens, ``known``; then also of merged ones.

    ``of_ids`` turns the ids of a merged pre-token into its value. With ``plain_specials`` the strings of
    special tokens are text like any; else each is a special token, of which ``known`` need not say anything.
    """

    def __init__(self, path: str, plain_specials: bool, known: dict, of_ids: Callable[[list[int]], object]):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.merge = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, added = spec["pre_tokenizer"], spec["added_tokens"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        fits = spec["normalizer"] is None and cutter["type"] == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
        if not (fits and plain and spec["truncation"] is None and spec["padding"] is None):
            raise ValueError(f"{path} is no byte-level BPE with the usual pattern")
        self.specials = {} if plain_specials else {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.letters = {b: c for c, b in byte_of().items()}
        self.known, self.of_ids = known, of_ids
        self.start()

    def start(self) -> None:
        self.table, self.long = dict(self.known), []
        self.table |= {s: self.of_ids([i]) for s, i in self.specials.items()}

    def pre_tokens(self, text: str) -> list[str] | None:
        """The pre-tokens of a settled text, special strings among them as they are; else None."""
        if not (text.isascii() or SETTLED(text)):
            return None
        if self.cut is None or not self.cut.search(text):
            return PRE_TOKENS(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += PRE_TOKENS(text[at : m.start()]) + [m.group()]
            at = m.end()
        return out + PRE_TOKENS(text[at:])

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Merges the pre-tokens that are neither whole tokens nor remembered, each within itself."""
        for p in set(pre_tokens).difference(self.table):
            self.table[p] = self.of_ids([t.id for t in self.merge(p.encode().decode("latin-1").translate(self.letters))])
            if len(p) > LONGEST:
                self.long.append(p)

    def forget(self) -> None:
        """Keeps memory bounded between texts: long pre-tokens go, and all merged ones when there are too many."""
        for p in self.long:
            del self.table[p]
        self.long = []
        if len(self.table) > len(self.known) + REMEMBERED:
            self.start()
