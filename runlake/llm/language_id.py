"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word's probability is the sum over
all its segmentations into pieces of the product of their probabilities (the forward algorithm), a
text's the product over its words; pieces do not cross white space. The vocabulary holds every single
byte, so that each text has a segmentation. The probabilities come from expectation-maximisation over
the word counts of all training texts: Spark counts words by language, and each round sums the expected
piece counts of all words (forward and backward) over the partitions into one row a language and piece.

A text's language is the one of highest posterior, with the training texts' bytes as prior evidence;
its score is that posterior. Texts that are null or hold no letter are ``und`` with score 0. What is not
a letter does not count: words are runs of letters (ASCII marks and digits separate, other bytes count).

Rows: null languages and null texts teach nothing; without any training text every row is ``und``. Ties
go to the language first by code point. Repeated rows count as often as they occur. Further columns are
not looked at. The model has VOCABULARY x languages numbers; more than MAX_LANGUAGES raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.llm.shared import stash
from runlake.llm.words import BYTES, LOWER, hashes, mix, powers, slices, spans, sums_by_row

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MAX_LANGUAGES = 512
#: Longer runs of letters are scored in blocks of so many bytes; probabilities then stay above 1e-300.
BLOCK = 40
#: Share of a uniform distribution in each language's probabilities.
SMOOTHING = 1e-2
ROUNDS = 3
#: Distinct words whose probabilities a task remembers.
REMEMBERED = 1_000_000
#: Bytes that separate words: all of ASCII but letters.
GAPS = np.zeros(256, bool)
GAPS[:128] = True
GAPS[list(range(65, 91)) + list(range(97, 123))] = False
_START = 32  # stands before a word's first byte, as the vocabulary's mark of a word start does


def _hash(block: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the rows of a byte matrix, from 0."""
    up, _ = powers(BLOCK + 2)
    sums = np.zeros((block.shape[0], block.shape[1] + 1), np.uint64)
    np.cumsum(BYTES[block] * up[: block.shape[1]], axis=1, out=sums[:, 1:])
    return sums


class Pieces:
    """The vocabulary as byte strings: a piece's number by the hash of its bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = LOWER[np.frombuffer(model.id_to_piece(i).replace("▁", " ").encode(), np.uint8)].tobytes()
                if len(piece) <= BLOCK and b" " not in piece[1:]:
                    found.add(piece)
        by_length: dict[int, list[bytes]] = {}
        for piece in sorted(found):
            by_length.setdefault(len(piece), []).append(piece)
        self.size, self.keys, self.numbers = len(found), {}, {}
        at = 0
        for n, group in sorted(by_length.items()):
            keys = _hash(np.frombuffer(b"".join(group), np.uint8).reshape(-1, n))[:, n]
            order = np.argsort(keys)
            self.keys[n], self.numbers[n] = keys[order], at + order
            at += len(group)

    def lattice(self, block: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end in words of one length (rows of bytes): (start, rows that have a piece there, its numbers)."""
        _, down = powers(BLOCK + 2)
        sums, width = _hash(block), block.shape[1]
        found = []
        for end in range(1, width + 1):
            row = []
            for n, keys in self.keys.items():
                if n > end:
                    break
                own = (sums[:, end] - sums[:, end - n]) * down[end - n]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                rows = np.flatnonzero(keys[at] == own)
                if len(rows):
                    row.append((end - n, rows, self.numbers[n][at[rows]]))
            found.append(row)
        return found


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(lattice: list, rows: int, p: np.ndarray) -> list[np.ndarray]:
    """Summed probabilities of all segmentations up to each place; p is piece x language."""
    alpha = [np.ones((rows, p.shape[1]))]
    for row in lattice:
        total = np.zeros((rows, p.shape[1]))
        for start, at, piece in row:
            total[at] += alpha[start][at] * p[piece]
        alpha.append(total)
    return alpha


def by_width(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their bytes after the mark of a word start), for words of one length at a time."""
    width = ends - starts
    for n in np.unique(width).tolist():
        rows = np.flatnonzero(width == n)
        for some in np.array_split(rows, 1 + len(rows) // 100_000):
            block = np.empty((len(some), n + 1), np.uint8)
            block[:, 0] = _START
            block[:, 1:] = data[starts[some][:, None] + np.arange(n)]
            yield some, block


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the rows as starts, ends and bounds by row; long runs are cut at characters into blocks."""
    starts, ends, bounds = spans(data, offsets, GAPS)
    limit = BLOCK - 4
    if len(starts) and (ends - starts).max() > limit:
        cut = np.zeros(len(data), bool)
        for a, b in zip(starts[ends - starts > limit].tolist(), ends[ends - starts > limit].tolist()):
            cut[a + limit : b : limit] = True
        for at in np.flatnonzero(cut & (data & 0xC0 == 0x80)).tolist():  # inside a character: begin at its first byte
            cut[at] = False
            while at and data[at] & 0xC0 == 0x80:
                at -= 1
            cut[at] = not GAPS[data[at]]
        starts, ends, bounds = spans(data, offsets, GAPS, cut)
    return starts, ends, bounds


def word_counts(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    """lang, word (binary), n: how often each word occurs in the texts of each language, lower-cased in ASCII."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
            for at, data, offsets in slices(batch.column(1), 8 << 20):
                data = LOWER[data]
                starts, ends, bounds = cut_words(data, offsets)
                if not len(starts):
                    continue
                lang_of = np.repeat(codes[at : at + len(offsets) - 1], np.diff(bounds))
                _, first, n = np.unique(mix(hashes(data, starts, ends) + lang_of), return_index=True, return_counts=True)
                raw = data.tobytes()
                words = pa.array([raw[starts[i] : ends[i]] for i in first], pa.binary())
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(lang_of[first].astype(np.int64))), words, pa.array(n, pa.int64())], ["lang", "word", "n"])

    known = docs.select(lang.alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    return known.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected(counts: DataFrame, langs: list[str], p: np.ndarray | None, path: str) -> np.ndarray:
    """Expected piece counts by language (piece x language) over all words; p None: every piece inside a word counts once."""
    size = pieces(path).size

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = pieces(path), np.zeros(len(langs) * size)
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy(zero_copy_only=False)]
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            words = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
            data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
            for some, block in by_width(data, ends[:-1], ends[1:]):
                lattice = table.lattice(block)
                if p is None:
                    for row in lattice:
                        for _, at, piece in row:
                            np.add.at(total, code[some[at]] * size + piece, n[some[at]])
                    continue
                own = [[(s, at, piece, p[piece, code[some[at]]]) for s, at, piece in row] for row in lattice]
                alpha = [np.ones(len(some))]
                for row in own:
                    a = np.zeros(len(some))
                    for s, at, _, q in row:
                        a[at] += alpha[s][at] * q
                    alpha.append(a)
                beta = [np.zeros(len(some)) for _ in own] + [n[some] / alpha[-1]]
                for end in range(len(own), 0, -1):
                    for s, at, piece, q in own[end - 1]:
                        flow = beta[end][at] * q
                        beta[s][at] += flow
                        np.add.at(total, code[some[at]] * size + piece, flow * alpha[s][at])
        total = total.reshape(len(langs), size)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["lang", "piece", "n"])

    out = np.zeros((size, len(langs)))
    sums = counts.mapInArrow(estimate, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most a number for each piece and language
    np.add.at(out, (found["piece"].to_numpy(), found["lang"].to_numpy()), found["n"].to_numpy())
    return out


class Model:
    """Languages by code point, log priors, and piece probabilities (piece x language)."""

    def __init__(self, langs: list[str], prior: np.ndarray, p: np.ndarray, path: str):
        self.langs, self.prior, self.p, self.path = langs, prior, p, path


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """A model learnt from every row of ``docs`` that has a text and a language."""
    counts = stash(word_counts(docs, F.col(lang_col), F.col(text_col)), "words")
    sums = counts.groupBy("lang").agg(F.sum(F.col("n") * F.length("word")).cast("double").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sums) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted((r["lang"] for r in sums), key=lambda x: x.encode())
    size = pieces(path).size
    if not langs:
        return Model([], np.zeros(0), np.zeros((size, 0)), path)
    amount = {r["lang"]: r["n"] for r in sums}
    prior = np.log(np.array([amount[x] for x in langs]) / sum(amount.values()))
    p = None
    for _ in range(rounds):
        n = expected(counts, langs, p, path)
        p = (1 - SMOOTHING) * n / n.sum(0) + SMOOTHING / size
    return Model(langs, prior, p, path)


class Scorer:
    """Log probabilities of words by language; remembers them by hash, sorted."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.logs = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row: its log probability in each language, and its number of words."""
        data = LOWER[data]
        starts, ends, bounds = cut_words(data, offsets)
        keys, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        logs = np.empty((len(keys), len(self.model.langs)), np.float32)
        logs[known] = self.logs[at[known]]
        for some, block in by_width(data, starts[first[new]], ends[first[new]]):
            logs[new[some]] = np.log(forward(pieces(self.model.path).lattice(block), len(some), self.model.p)[-1])
        if len(self.keys) + len(new) > REMEMBERED:
            self.keys, self.logs = keys, logs
        else:
            self.keys, self.logs = np.insert(self.keys, at[new], keys[new]), np.insert(self.logs, at[new], logs[new], axis=0)
        return sums_by_row(logs[inverse], bounds), np.diff(bounds)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    return np.fromiter((x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()), bool, len(texts))


def _scored(model: Model, batch_text: pa.Array, scorer: Scorer) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(first row, languages, scores) for slices of a string column."""
    for at, data, offsets in slices(batch_text, 8 << 20):
        n = len(offsets) - 1
        letters = has_letter(batch_text.slice(at, n))
        names, scores = np.full(n, "und", object), np.zeros(n)
        if model.langs:
            logs, _ = scorer.score(data, offsets)
            logs += model.prior
            posterior = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            names[letters] = np.array(model.langs, object)[logs.argmax(1)[letters]]
            scores[letters] = posterior[letters]
        yield at, pa.array(names.tolist(), pa.string()), pa.array(scores)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row of ``docs``, from its whole text alone."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at, names, scores in _scored(model, batch.column(1), scorer):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(names)), names, scores], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(score, f"`{id_col}` {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a posterior of ``least`` or more, all columns as they were."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at, names, scores in _scored(model, batch.column(text_col), scorer):
                kept = (np.array(names.to_pylist(), object) != "und") & (scores.to_numpy() >= least)
                yield batch.slice(at, len(names)).filter(pa.array(kept))

    return docs.mapInArrow(choose, docs.schema)
