"""Alignment against a plain version that holds all links in one counter."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from test_llm_operators import documents, frame
from tokenizers import Tokenizer

from runlake.llm import alignment as al, byte_bpe, queries

A = Tokenizer.from_file(al.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=al.PIECE_BPE)
BYTE = byte_bpe.byte_of()


def bytes_a(i):
    token = A.id_to_token(i)
    return token.encode() if token == "<|endoftext|>" else bytes(BYTE[c] for c in token)


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, and the counts of the pairs."""
    docs, counts = [], collections.Counter()
    for text in texts:
        a = A.encode(" " + (text or ""), add_special_tokens=False).ids
        b = B.encode(text or "")
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
            docs.append(None)
            continue
        ends, at = {}, 0
        for k, i in enumerate(b):
            at += len(bytes_b(i))
            ends[at] = k
        groups, at, from_a, from_b = [], 0, 0, 0
        for k, i in enumerate(a):
            at += len(bytes_a(i))
            if at in ends:
                groups.append((a[from_a : k + 1], b[from_b : ends[at] + 1]))
                from_a, from_b = k + 1, ends[at] + 1
        links = [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        docs.append((len(a), len(b), len(groups), links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]
    return out, counts, most


ODD = [" two  blanks", "▁literal", "tab\tand\nline", "中文字 é ß ﬁ ①", "<|endoftext|> <s> </s> <unk>", "a\x00b", "🙂 emoji", "՘ \U00010940", " ", "x", "é", "<0x41>", "1234567890" * 3]


def test_odd_texts_align_as_the_plain_version_says(spark):
    rows = documents() + [(2000 + i, t, "en", "s") for i, t in enumerate(ODD)]
    expected, _, _ = plain([t for _, t, _, _ in rows])
    found = [tuple(r) for r in al.align(frame(spark, rows).repartition(4)).collect()]
    assert sorted(found, key=repr) == sorted(((i, *e) for (i, *_), e in zip(rows, expected)), key=repr)


def test_chunks_are_whole_texts():
    assert list(al.chunks(["a" * 5, None, "b" * 3, "c" * 20, "d"], 8)) == [(0, 3), (3, 4), (4, 5)] and list(al.chunks([])) == []


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_levels_of_merges_change_nothing(spark, monkeypatch, fan_in):
    monkeypatch.setattr(al, "FAN_IN", fan_in)  # seven tasks make seven chunks
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("the", "fox", "Quixotic", "jumps,", "naïve", "zzyzx")) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += ["the the the"] * 40  # a third of all rows
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    expected, counts, most = plain(texts)
    found = {r["doc_id"]: tuple(r)[1:] for r in al.align(frame(spark, rows).repartition(7)).collect()}
    assert found == dict(enumerate(expected))
    pairs = {(r["a"], r["b"]): (r["n"], r["best"]) for r in al.pair_counts(frame(spark, rows).repartition(3)).collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_merging_reads_streams_piece_by_piece(monkeypatch):
    monkeypatch.setattr(al, "PIECE", 3)
    rng = random.Random(9)
    runs = [sorted((rng.randrange(50) << al.BITS | rng.randrange(9), rng.randrange(1, 5)) for _ in range(rng.randrange(40))) for _ in range(9)]
    total = collections.Counter()
    for run in runs:
        for key, n in run:
            total[key] += n
    streams = [al.stream_of(run) for run in runs]
    assert list(al.merged(streams)) == sorted(total.items())
    most = {}
    for key, n in total.items():
        most[key >> al.BITS] = max(n, most.get(key >> al.BITS, 0))
    assert list(al.rated(al.merged(streams))) == [(k, 2 * n + (n == most[k >> al.BITS])) for k, n in sorted(total.items())]


def test_runs_hold_every_link(monkeypatch):
    monkeypatch.setattr(al, "RADICES", 4)
    rng = np.random.default_rng(2)
    keys = (rng.integers(0, 9, 500).astype(np.uint64) << np.uint64(al.BITS)) | rng.integers(0, 5, 500).astype(np.uint64)
    docs = np.sort(rng.integers(0, 20, 500))
    found = collections.Counter()
    for radix, pairs, records in al.runs_of(keys, docs, 20):
        own, numbers = al.whole(pairs, al.ENTRY), al.whole(records, "<u4")
        of, times = numbers[len(own) :].reshape(2, -1)
        key = np.repeat(own["key"], numbers[: len(own)])
        assert (np.diff(own["key"].astype(np.int64)) > 0).all() and ((own["key"] >> np.uint64(al.BITS)) % np.uint64(4) == radix).all()
        for k, d, n in zip(key.tolist(), of.tolist(), times.tolist()):
            found[k, d] += n
    assert found == collections.Counter(zip(keys.tolist(), docs.tolist()))


def test_group_text_instead_of_its_digest(spark):
    rows = [(1, "the fox", "en", "s"), (2, None, "en", "s")]
    both = zip(al.align(frame(spark, rows), digest=False).orderBy("doc_id").collect(), al.align(frame(spark, rows)).orderBy("doc_id").collect())
    for r, d in both:
        assert d["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")


def test_empty_table(spark):
    found = al.align(frame(spark, []))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and not found.collect()


def test_query_over_whole_documents(spark, tiny):
    rows = queries.table(spark, tiny, "documents").select("doc_id", "text").collect()
    expected, _, _ = plain([r["text"] for r in rows])
    assert {tuple(r) for r in queries.op12_alignment(spark, tiny).collect()} == {(r["doc_id"], *e) for r, e in zip(rows, expected)}


@pytest.mark.parametrize("ids, n_docs", [(30, 7), (32_000, 1), (32_000, 70_000), (1 << al.BITS, 1 << 20), (1, 1)])
def test_records_are_those_of_a_plain_count_whatever_bits_they_need(ids, n_docs):
    """Few bits are sorted as one number, many by key and record."""
    rng = np.random.default_rng(ids)
    a, b, docs = (rng.integers(0, most, 500) for most in (ids, ids, n_docs))
    keys = ((b % al.RADICES).astype(np.uint64) << np.uint64(2 * al.BITS)) | (b.astype(np.uint64) << np.uint64(al.BITS)) | a.astype(np.uint64)
    own, first, doc_of, times = al._records(keys, docs, n_docs)
    plain = collections.Counter(zip(keys.tolist(), docs.tolist()))
    assert own.tolist() == sorted(set(keys.tolist())) and first[-1] == len(doc_of) == len(plain)
    found = {(k, d): n for i, k in enumerate(own.tolist()) for d, n in zip(doc_of[first[i] : first[i + 1]].tolist(), times[first[i] : first[i + 1]].tolist())}
    assert found == plain
