"""Token counts against the tokenizer itself, and the proof and the cutting they rest on."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_operators import documents, frame
from tokenizers import Tokenizer

from runlake.llm import byte_bpe, queries, token_counts as tc

LIBRARY = Tokenizer.from_file(byte_bpe.BYTE_BPE)
WHOLE = byte_bpe.prove()
ODD = " \n\t\x0b\x1c\x85\xa0　 ab1'sS!?é中ß́\x00Ա՞՘\U00010940<|endoftext|>"


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_blocks_are_cut_as_the_tokenizer_cuts_them():
    for code in itertools.chain.from_iterable(range(a, b + 1) for a, b in byte_bpe.BLOCKS):
        c = chr(code)
        text = f"a{c}1{c}!{c}  {c}\n{c}"
        assert byte_bpe.SETTLED(text)
        assert byte_bpe.PRE_TOKENS(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)], hex(code)
    assert not byte_bpe.SETTLED("՘") and not byte_bpe.SETTLED("a\U00010940")


def test_whole_tokens_encode_alone():
    vocabulary = LIBRARY.get_vocab()
    assert "<|endoftext|>" not in WHOLE and len(WHOLE) > 49_000 and set(WHOLE.values()) <= set(vocabulary.values())
    assert all(LIBRARY.encode(s).ids == [i] for s, i in itertools.islice(WHOLE.items(), 0, None, 7))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ODD, max_size=40), st.text(max_size=20), st.lists(st.sampled_from(["<|endoftext|>", " the", "'s", "  ", "Qx zz", "\n", "1234"]), max_size=9).map("".join)), max_size=10))
def test_counts_are_the_library_s(texts):
    assert tc.count(texts, tc.counter(byte_bpe.BYTE_BPE, frozenset(WHOLE))) == [plain(t) for t in texts]


def test_remembered_pre_tokens_are_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    lookup = byte_bpe.ByLookup(byte_bpe.BYTE_BPE, False, dict.fromkeys(WHOLE, 1), len)
    for text in ("zxqv qwxz vvkq " * 3, "q" * 5000 + " xqzzy wqx", "zxqv kkjq"):
        assert tc.count([text], lookup) == [plain(text)]
    merged = set(lookup.table) - set(WHOLE) - {"<|endoftext|>"}
    assert len(merged) <= 5 and all(len(p) <= byte_bpe.LONGEST for p in merged)


def test_operator_counts_every_row(spark):
    rows = documents() + [(900, "a<|endoftext|>b", "en", "s"), (901, "՘ odd \U00010940", "en", "s"), (902, "x " * 1024, "en", "s")]
    found = tc.token_counts(frame(spark, rows).repartition(3), limit=1024)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = [(i, len((t or "").encode()), plain(t), plain(t) > 1024) for i, t, _, _ in rows]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_clashing_columns_and_an_empty_table(spark):
    odd = spark.createDataFrame([(1, "two words", 7, 8, "x")], "`a.b` long, text string, n_tokens long, kept long, n_bytes string")
    assert tc.token_counts(odd, keep=["a.b", "kept", "n_tokens"]).collect() == [(1, 8, 9, 2, False)]
    assert tc.token_counts(frame(spark, [])).count() == 0


def test_query_over_whole_documents(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, tiny, "documents").collect()}
    found = queries.op13_token_counts(spark, tiny).collect()
    assert len(found) == len(docs) and all(r["n_tokens"] == plain(docs[r["doc_id"]]) for r in found)


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByLookup(byte_bpe.public_tokenizers.path("word_bpe_49k.json"), False, {}, len)
