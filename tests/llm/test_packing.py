"""Packing: ids against the tokenizer, plans against best fit decreasing, and results as whole sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from casewright.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN, IDS = Tokenizer.from_file(FILE), packing.Ids(FILE, packing.read_vocabulary(FILE))
TEXTS = ["", None, "one two  three", " <|endoftext|> in\ttext \x1c odd", "é日本 " * 700, "word " * 5000, "x" * 9000, "same text here", "same text here"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB1é '\n\t\u00a0\u2003.,!?:<|>endoftext日\x1c\x85_"), max_size=60), max_size=4))
def test_ids_equal_the_tokenizer(texts):
    expected = [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in IDS.of(texts)] == expected


def test_memory_of_two_halves(monkeypatch):
    monkeypatch.setattr(packing, "PIECE_CACHE", 20)
    ids = packing.Ids(FILE, packing.read_vocabulary(FILE))
    for i in range(30):
        texts = [f"common words, here {i} {i * 7919}", " ".join(f"w{i}x{j}" for j in range(i))]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(texts)] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0xFF), st.sampled_from(" \n'$.|<>tsreéß×÷\u1680\u2003\u2028\u202f\u205f\u3000\ufeff、日가߿😀")), max_size=40), max_size=4))
def test_ids_of_any_characters(texts):
    texts = [*texts, *(t + "<|endoftext|>" + t for t in texts)]
    assert [np.frombuffer(x, "<u4").tolist() for x in IDS.of(texts)] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_repeated_pieces_are_looked_up_once():
    looked = []

    class Watched(packing.Ids):
        def get(self, *key):
            looked.append(key)
            return super().get(*key)

        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    texts = ["one two, three$$$ four\n" * 3000] * 3
    got = Watched(FILE, packing.read_vocabulary(FILE)).of(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert len(looked) < 30


@pytest.mark.parametrize("token", [AddedToken("[A. b]"), AddedToken("<x>", rstrip=True), AddedToken("<x>", lstrip=True), AddedToken("two", single_word=True)])
def test_added_tokens_are_not_cut(tmp_path, token):
    plain = Tokenizer.from_file(FILE)
    plain.add_tokens([token])
    plain.save(file := str(tmp_path / "own.json"))
    texts = ["one<x>  three <x> a\n<x>\t b", "two.two twotwo,two two", "x[A. b] [A. b]\n[A.", " b] [A", ". b]"]
    got = packing.Ids(file, packing.read_vocabulary(file)).of(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def plain_best_fit(counts):
    limit = len(counts) - 1
    gaps, used = [], 0
    for v in range(limit, 0, -1):
        for _ in range(counts[v]):
            fits = [g for g in gaps if g >= v]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - v)
            else:
                used += 1
                gaps.append(limit - v)
    return used


def checked(plan, counts):
    got = np.zeros(len(counts), np.int64)
    for items, n in plan:
        assert n > 0 and sum(items) < len(counts) and items == sorted(items, reverse=True)
        for v in items:
            got[v] += n
    assert (got == counts).all()
    return sum(n for _, n in plan)


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 40).flatmap(lambda limit: st.tuples(st.just(limit), st.lists(st.integers(1, limit), max_size=80))))
def test_plans_take_all_and_are_never_worse_than_best_fit(case):
    limit, lengths = case
    counts = np.bincount(np.array(lengths, np.int64), minlength=limit + 1)
    plain = plain_best_fit(counts)
    assert checked(packing.best_fit(counts), counts) == plain
    total = checked(packing.packing_plan(counts), counts)
    assert -(-int((counts * np.arange(limit + 1)).sum()) // limit) <= total <= plain


def test_plans_of_any_number_of_documents():
    rnd = np.random.default_rng(3)
    counts = rnd.integers(0, 2, 1025) * rnd.integers(0, 10**9, 1025)
    counts[0] = 0
    counts[10] = 10**10
    used = checked(packing.packing_plan(counts), counts)
    bound = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert used <= 1.02 * bound and used <= checked(packing.best_fit(counts), counts) and len(packing.packing_plan(counts)) < 5000
    assert checked(packing.packing_plan(np.zeros(1025, np.int64)), np.zeros(1025, np.int64)) == 0


def test_fit_repeats_what_fills_exactly():
    counts = np.zeros(1025, np.int64)
    counts[[700, 324, 500, 300, 224]] = [90, 90, 40, 40, 40]
    patterns = packing.exact_patterns(counts)
    assert sorted(map(tuple, patterns.tolist())) == [(500, 300, 224), (700, 324, 0)]
    assert np.allclose(packing.fit(patterns, counts), [90 if p[2] == 0 else 40 for p in patterns], atol=0.01)


@pytest.mark.parametrize("limit", [16, 1024])
def test_packed_documents(spark, limit):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    got = packing.pack(docs, FILE, limit=limit).collect()
    t = Tokenizer.from_file(FILE)
    expected = []
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first, at, piece = len(ids) % limit or min(limit, len(ids)), 0, 0
        while at < len(ids):
            size = first if piece == 0 else limit
            part = np.array(ids[at : at + size], "<u4").tobytes()
            expected.append((i, piece, at, size, zlib.crc32(part)))
            at, piece = at + size, piece + 1
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(sequences) <= plain_best_fit(np.bincount([e[3] for e in expected], minlength=limit + 1))
    assert packing.pack(docs.limit(0), FILE).collect() == []
