"""Tokenisation, look-alike folding and packing."""

import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyard.llm import lookalike, packing, tokenize

FOLDER = "/opt/tokenizers"
DOCS = "doc_id long, text string, ids string, form string, capacity int"


@pytest.fixture(scope="module")
def codec():
    return tokenize.Codec(tokenize.serialise_model(tokenize.read_ranks(f"{FOLDER}/{tokenize.VOCABULARY}")))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=200))
def test_ids_equal_the_public_tokenizer_and_come_back(codec, public, text):
    ids = codec.encode([text])[0]
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert codec.decode([ids]) == [text]


def test_special_strings_long_runs_and_blanks(codec, public):
    texts = ["<|endoftext|> x", "a" * 5000, " " * 3000, "\n\n \t", "don't we'll", "١٢٣ العربية", "", None]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == (public.encode(text, add_special_tokens=False).ids if text else [])


def test_corpus_keeps_every_row_and_ignores_other_columns(spark):
    rows = [(1, "Pump stations", "a", "b", 1), (1, "Pump stations", "a", "b", 1), (2, "", None, None, None), (3, None, None, None, None)]
    got = [(r.doc_id, r.ids) for r in tokenize.encode_corpus(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(x[0] for x in got) == [1, 1, 2, 3]
    assert [i for d, i in got if d in (2, 3)] == [[], []]
    assert tokenize.encode_corpus(spark.createDataFrame([], DOCS)).collect() == []


def slow_form(text):
    if text is None:
        return None
    folded = unicodedata.normalize("NFC", "".join(lookalike._replacement(ord(c)) for c in text))
    out = []
    for i, c in enumerate(folded):
        if ord(c) == lookalike.FARSI_YEH:
            n = ord(folded[i + 1]) if i + 1 < len(folded) else 0
            joined = (0x620 <= n <= 0x64A and n != 0x621) or 0x66E <= n <= 0x6D3
            c = chr(lookalike.YEH if joined else lookalike.ALEF_MAKSURA)
        out.append(c)
    return "".join(out)


POOL = "abcoеІА Ζ̧̣́̈̌ٔایي각ｱﾞﬁ‍\xa0োﻻ\n½²"


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.none() | st.text(alphabet=POOL, max_size=12) | st.text(max_size=12), max_size=6))
def test_vectorised_folding_equals_the_slow_one(texts):
    assert lookalike.fold_array(pa.array(texts, pa.string())).to_pylist() == [slow_form(t) for t in texts]


def test_blocks_smaller_than_a_text(monkeypatch):
    monkeypatch.setattr(lookalike, "BLOCK", 3)
    texts = ["Ｐｕｍｐ​", "", None, "café", "е"]
    assert lookalike.fold_array(pa.array(texts)).to_pylist() == [slow_form(t) for t in texts]


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Pump", "Ｐｕｍｐ", True), ("Pump", "Pu​mp", True), ("a b", "a\xa0b", True), ("é", "é", True),
        ("Safe", "Ѕаfе", True), ("m²", "m2", False), ("½", "1/2", False), ("a\nb", "a b", False), ("é", "e", False),
        ("rn", "m", False), ("٤", "۴", False), ("١", "۱", True), ("و", "ؤ", False), ("A", "a", False), ("-", "‑", True),
    ],
)
def test_what_a_reader_sees(a, b, same):
    x, y = lookalike.fold_array(pa.array([a, b])).to_pylist()
    assert (x == y) is same


def test_pairs_against_brute_force_with_copies_nulls_and_blanks(spark):
    rows = [(1, "Pump"), (2, "Ｐｕｍｐ"), (3, "Pump"), (4, "pump"), (5, ""), (6, None), (7, "​"), (8, "Pu​mp"), (9, "m²"), (10, "m2"), (8, "Pu​mp")]
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)
    form = {i: slow_form(t) for i, t in rows}
    text = dict(rows)
    ids = sorted(i for i in text if text[i])
    expected = {(a, b) for a in ids for b in ids if a < b and form[a] == form[b] and text[a] != text[b]}
    got = [tuple(r) for r in lookalike.same_look_pairs(frame).collect()]
    assert sorted(got) == sorted(expected) and expected == {(1, 2), (1, 8), (2, 3), (2, 8), (3, 8)}
    assert lookalike.same_look_pairs(frame.limit(0)).collect() == []
    ends = {i for p in expected for i in p}
    classes = {(r.pos, r.look, r.n_links) for r in lookalike.look_classes(frame).collect()}
    assert classes == {(i, min(x for x in ends if form[x] == form[i]), len({text[x] for x in ends if form[x] == form[i]}) - 1) for i in ends}


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(0, 50), max_size=60), capacity=st.integers(50, 80))
def test_packing_is_a_partition_within_the_capacity(sizes, capacity):
    bins = packing.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)


def test_packing_is_close_to_the_least_number_of_bins():
    rng = random.Random(3)
    sizes = [rng.randint(1, 400) for _ in range(3000)]
    assert len(packing.pack(sizes, 512)) <= -(-sum(sizes) // 512) * 1.02 + 1


def test_many_open_bins_are_searched_to_the_end():
    rng = random.Random(4)
    sizes = [rng.randint(300, 340) for _ in range(1000)]  # two in each of 500 bins, none of them full
    bins = packing.pack(sizes, 700)
    assert len(bins) == 500
    load = [sum(sizes[i] for i in b) for b in bins]
    for a, b in ((a, b) for a in range(0, 500, 7) for b in range(500) if a != b and load[a] >= load[b]):
        assert packing._improve(bins[a], bins[b], sizes, 700 - load[a]) is None


def test_each_change_raises_the_fuller_bin():
    sizes = [7, 3, 5, 4, 2]
    change = packing._improve([0, 1], [2, 3, 4], sizes, 2)  # 10 held, 2 free
    out, back = change
    assert 0 < sum(sizes[i] for i in out) - sum(sizes[i] for i in back) <= 2


def test_containers_hold_every_text_and_split_only_what_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    monkeypatch.setattr(packing, "TOGETHER", 1)
    words = "pump valve pipe steel cable".split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(200, None), (201, ""), (202, "pump " * 300), (1, "pump")]
    docs = spark.createDataFrame([(i, t, "x", "y", 5) for i, t in rows], DOCS)
    spec = spark.createDataFrame([(1, 32), (2, 128), (3, None), (4, 0)], "container_id int, capacity_tokens int")
    got = packing.fill_containers(docs, spec).collect()
    for container, capacity in ((1, 32), (2, 128)):
        mine = [r for r in got if r.container_id == container]
        load = {}
        for r in mine:
            load[r.bin_id] = load.get(r.bin_id, 0) + r.tokens
        assert max(load.values()) <= capacity
        assert {r.doc_id for r in mine} == {i for i, _ in rows}
        pieces = {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append(r.tokens)
        assert all(len(p) == 1 or sum(p) > capacity or d == 1 for d, p in pieces.items())
        assert sum(load.values()) / (len(load) * capacity) > 0.9
    assert {r.container_id for r in got} == {1, 2}
    assert packing.fill_containers(docs.limit(0), spec).collect() == []
