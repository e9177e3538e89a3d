"""The byte-level helpers against plain Python."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runlake.llm import tokens
from runlake.llm import words as w

TEXT = st.one_of(st.none(), st.text(alphabet=" ab\n\t\x0b\x0c\r.,'é̀Σİ中🙂1<|>", max_size=40))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=12), st.sampled_from([1, 9, 1 << 20]))
def test_words_are_what_split_gives(texts, limit):
    found, seen = [], {}
    for _, data, offsets in w.slices(pa.array(texts, pa.string()), limit):
        starts, ends, bounds = w.spans(data, offsets)
        hashes = w.hashes(data, starts, ends)
        for i in range(len(offsets) - 1):
            own = [bytes(data[starts[j] : ends[j]]) for j in range(bounds[i], bounds[i + 1])]
            found.append(own)
            for word, h in zip(own, hashes[bounds[i] : bounds[i + 1]]):
                assert seen.setdefault(word, h) == h
    assert found == [(t or "").encode().split() for t in texts]
    assert len(set(seen.values())) == len(seen)


PLAIN = Tokenizer.from_file(tokens.TOKENIZER)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(TEXT, st.just("x<|endoftext|>y"), st.just("A<|ENDOFTEXT|> B's it'S"), st.text(max_size=30)), max_size=12))
def test_ids_are_the_tokenizers(texts):
    found = []
    for _, bounds, ids in tokens.encoded(pa.array(texts, pa.string())):
        found += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(bounds) - 1)]
    assert found == [PLAIN.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_hashes_do_not_depend_on_where_a_text_lies(monkeypatch):
    texts = ["one two " * 50, "x" * 300 + " two", "two"]
    whole = [w.hashes(d, *w.spans(d, o)[:2]) for _, d, o in w.slices(pa.array(texts))]
    monkeypatch.setattr(w, "SLICE", 16)
    cut = [w.hashes(d, *w.spans(d, o)[:2]) for _, d, o in w.slices(pa.array(texts), 1)]
    assert [x for a in whole for x in a.tolist()] == [x for a in cut for x in a.tolist()]
