"""Encoding and decoding against the tokenizers library and against merging pair by pair."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import clashing, empty_docs, odd_docs, odd_rows
from tokenizers import Tokenizer

from obsmat.llm import byte_pairs as bp

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def mine(text):
    return np.frombuffer(bp.vocabulary(PATH).encode(text), "<i4").tolist()


def by_merging(word):
    v = bp.vocabulary(PATH)
    ids = [v.id_of[bytes([b])] for b in word]
    while True:
        best = min(((v.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in v.merges), default=None)
        if best is None:
            return ids
        i = best[1]
        ids[i : i + 2] = [v.id_of[v.bytes_of[ids[i]] + v.bytes_of[ids[i + 1]]]]


WORDS = ["a" * 57, "ab" * 33, " " * 19 + "x", "\n" * 11, "\t \n x  ", "-=" * 41, "x<|endoftext|><|endoftext|> y <|endoftext", " <|endoftext|>\n ", "it's we'll I'D", "½ ² 漢字かな 한국어 🙂🙂", "İ՘ \U00010940 ẞ࢏", "é   x\u0085y", "\x00\x01\x7f", "a" + "̀" * 40]


@pytest.mark.parametrize("text", WORDS)
def test_odd_words(text):
    assert mine(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("abAB \n.1", max_size=80), st.text("aeiounrstl", max_size=60)))
def test_any_text(text):
    assert mine(text) == library(text)


def test_runs_of_tokens():
    rng, v = np.random.default_rng(3), bp.vocabulary(PATH)
    for _ in range(3000):
        word = b"".join(v.bytes_of[int(i)] for i in rng.integers(0, 50_256, rng.integers(1, 7)))
        assert v.encode_word(word) == by_merging(word)


def test_the_automaton_names_all_tokens_that_end_at_a_byte():
    words = [(w, i) for i, w in enumerate([b"a", b"b", b"c", b"ab", b"bc", b"abc", b"bca", b"cab", b"aa", b"aab", b"cabca"])]
    a, known = bp.SuffixAutomaton(words), dict(words)
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 100, 400).tolist())
    state = matched = 0
    for at, byte in enumerate(text, 1):
        while byte not in a.next[state]:
            state = a.link[state]
            matched = a.length[state]
        state, matched = a.next[state][byte], matched + 1
        s, got = state if a.ends[state] >= 0 and a.length[state] == matched else a.shorter[state], []
        while s >= 0:
            got.append(a.ends[s])
            s = a.shorter[s]
        assert got == [known[text[at - k : at]] for k in range(min(at, 5), 0, -1) if text[at - k : at] in known]


def test_cutting_agrees_wherever_the_pattern_is_used():
    cut = LIBRARY.pre_tokenizer
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if bp.GROWING.search(c) is None:
            text = f"a{c}1{c}.{c} {c}a {c}  b"
            assert bp.PATTERN.findall(text) == [text[i:j] for _, (i, j) in cut.pre_tokenize_str(text)]


def test_long_words_take_linear_time():
    word = "ab" * 200_000
    assert len(mine(word)) == len(library(word[:2000])) * 200


def expected(rows):
    out = []
    for doc_id, text in rows:
        ids = library(text or "")
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert back == (text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_documents(spark):
    more = [(100 + i, w, None, None, 0) for i, w in enumerate(WORDS)]
    df = odd_docs(spark).union(spark.createDataFrame(more, odd_docs(spark).schema))
    got = bp.digests(bp.decode(bp.encode(clashing(df), PATH), PATH))
    assert sorted(map(tuple, got.collect()), key=str) == expected([r[:2] for r in odd_rows() + more])
    assert bp.encode(empty_docs(spark), PATH).count() == 0


def test_slices_are_only_slices(spark, monkeypatch):
    assert list(bp._slices([5, 1, 9, 0, 2], 6)) == [(0, 2), (2, 3), (3, 5)] and list(bp._slices([], 6)) == []


def test_decoding_any_ids(spark):
    v = bp.vocabulary(PATH)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 50_257, 12).tolist()) for i in range(40)] + [(50, []), (51, None), (52, [-4, 15, 99_999]), (53, [int(v.id_of[b"\xe6"])])]
    got = {r.doc_id: r.text for r in bp.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    for i, ids in rows:
        assert got[i] == LIBRARY.decode([x for x in ids or [] if 0 <= x <= 50_256], skip_special_tokens=False)


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        bp.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
