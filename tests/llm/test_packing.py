import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    """One piece at a time."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fitting = [(g, i) for i, g in enumerate(gaps) if g >= x]
        if fitting:
            gaps[min(fitting)[1]] -= x
        else:
            gaps.append(capacity - x)
    return sorted(gaps)


def spread(counts, runs):
    """(length, rank) -> (sequence, offset), from the runs."""
    out = {}
    for length, n in counts.items():
        own = sorted(r for r in runs.tolist() if r[0] == length)
        for rank in range(n):
            _, first, per, sequence, offset = [r for r in own if r[1] <= rank][-1]
            out[length, rank] = (sequence + (rank - first) // per, offset + (rank - first) % per * length)
    return out


def check_gapless(placed, capacity):
    """placed: (sequence, offset, length)."""
    by = defaultdict(list)
    for s, o, x in placed:
        by[s].append((o, x))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for o, x in sorted(own):
            assert o == at
            at += x
        assert at <= capacity
    return sorted(capacity - sum(x for _, x in own) for own in by.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_supersteps_are_best_fit_decreasing(lengths, capacity):
    counts = Counter(lengths)
    runs, opened = packing.supersteps(counts, capacity)
    at = spread(counts, runs)
    gaps = check_gapless([(s, o, x) for (x, _), (s, o) in at.items()], capacity)
    assert len(gaps) == opened and gaps == best_fit_decreasing(lengths, capacity)


def test_runs_do_not_grow_with_the_data():
    rng = np.random.default_rng(0)
    few = Counter(np.minimum(rng.geometric(0.002, 200_000), 4096).tolist())
    sizes = [len(packing.supersteps({k: v * m for k, v in few.items()})[0]) for m in (1, 100, 10_000)]
    assert sizes[2] < 1.5 * sizes[0] + 4096 and sizes[2] < 12 * 4096
    runs, opened = packing.supersteps(few)
    assert opened <= 1.001 * sum(k * v for k, v in few.items()) / 4096 + 1


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(data):
    return np.frombuffer(data, dtype="<u4").tolist()


TEXTS = ["", None, "Hello world's  3.14\n\tFOO", " \n", "café café ́x", "a\x1cb c", "has <|endoftext|> inside", "<|startoftext|>", "ΣΣ İx  y\x85z᠎w", "\x00 nul", "don't we'LL 12ab", "日本語 \U0001f600 word", "<|endoftext |> x"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abÈİȺℵ½'sStRE1. \n\x1fé́ 日", max_size=30), max_size=5))
def test_words_are_encoded_as_whole_texts(texts):
    own, plain = packing.encoder(PATH), Tokenizer.from_file(PATH)
    texts = [*texts, *(t or "" for t in TEXTS)]
    assert own.by_words and own.by_pieces and [ids_of(x) for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_and_short_memory():
    path = public_tokenizers.path("byte_bpe_50k.json")  # keeps white space
    own, plain = packing.WordEncoder(path), Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS]
    assert not own.by_words and [ids_of(x) for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    own, plain = packing.WordEncoder(PATH, remember=3), Tokenizer.from_file(PATH)
    for _ in range(3):
        assert [ids_of(x) for x in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 16)
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, "x"), (3, "word " * 50_000, 1, "x"), (4, "same", 1, "x"), (4, "same", 1, "x")]
    rows += [(100 + i, "three words here", 1, "x") for i in range(60)]  # a length that most hold
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, piece string")
    made = packing.pieces(docs, PATH, with_ids=True)
    got = packing.packed(made).collect()
    want = []
    for d, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], dtype="<u4").tobytes()
            want.append((str(d), p, s, len(part) // 4, zlib.crc32(part)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    gaps = check_gapless([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert gaps == best_fit_decreasing([w[3] for w in want], 4096)
    whole = {r.sequence_id: r for r in packing.sequences(packing.packed(made)).collect()}
    assert sum(r.n_tokens for r in whole.values()) == sum(w[3] for w in want)
    for r in got:
        assert zlib.crc32(bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32
    assert packing.packed(packing.pieces(docs.where("false"), PATH)).count() == 0


def test_lengths_beyond_a_sequence_are_refused(spark):
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 11)], "row long, length int"), 10)


def test_query_against_the_library(spark, plain):
    at = "/root/testdata/sf0.001"
    got = packing.op12_best_fit_packing(spark, at).collect()
    want = []
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(r.doc_id, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    gaps = check_gapless([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert gaps == best_fit_decreasing([w[3] for w in want], 4096)
    assert len(gaps) <= -(-sum(w[3] for w in want) // 4096) + 1
