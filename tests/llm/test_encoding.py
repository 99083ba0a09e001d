"""Encoding, token counts and packing against the libraries."""

import hashlib
import zlib

import numpy as np
import pytest
from cases import awkward_rows, documents, ordered, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from millrace.llm.byte_bpe import byte_bpe
from millrace.llm.encoding import VOCABULARY, decode_documents, encode_documents
from millrace.llm.packing import cutting_patterns, first_fit, library_bpe, pack, pack_documents, size_of, token_pieces
from millrace.llm.token_counts import VOCABULARY as UNIGRAMS
from millrace.llm.token_counts import count_tokens, unigram_counter, unigram_vocabulary
from millrace.llm.word_cache import WordCache

LIBRARY = Tokenizer.from_file(VOCABULARY)
ALPHABET = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "a", "Z", "é", "1", "²", ".", "!", "'s", "'", "<|endoftext|>", "😀", "中", "\x00"]
texts = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join))


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_are_those_of_the_library(text):
    wanted = np.array(library_ids(text), "<u4").tobytes()
    assert byte_bpe(VOCABULARY).encode(text) == wanted
    assert library_bpe(VOCABULARY).encode(text) == wanted
    assert byte_bpe(VOCABULARY).decode(wanted) == LIBRARY.decode(library_ids(text), skip_special_tokens=False)


def test_every_letter_class_is_cut_as_in_the_library():
    bpe, fast = byte_bpe(VOCABULARY), library_bpe(VOCABULARY)
    for point in [*range(0x3100), *range(0xFE00, 0x10000, 3), *range(0x10000, 0x30000, 97)]:
        text = f"a {chr(point)}{chr(point)}b 1{chr(point)}. {chr(point)}"
        wanted = np.array(library_ids(text), "<u4").tobytes()
        assert bpe.encode(text) == wanted and fast.encode(text) == wanted, hex(point)


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 3000 + "é" * 2000, "x" * 257 + "yz" * 300])
def test_long_words_by_the_heap(word):
    assert byte_bpe(VOCABULARY).word_ids(word.encode()) == library_ids(word)


def test_scan_and_heap_agree():
    bpe = byte_bpe(VOCABULARY)
    for seed in range(50):
        ids = [bpe.byte_id[b] for b in prose(seed, 30).encode()]
        assert bpe._by_scan(list(ids)) == bpe._by_heap(list(ids))


def test_broken_bytes_become_replacement_characters():
    ids = library_ids("é")
    first_byte = byte_bpe(VOCABULARY).byte_id["é".encode()[0]]
    for chosen in ([first_byte], [first_byte, *ids]):
        packed = np.array(chosen, "<u4").tobytes()
        assert byte_bpe(VOCABULARY).decode(packed) == LIBRARY.decode(chosen, skip_special_tokens=False)


def test_documents_round_trip(spark):
    encoded = encode_documents(documents(spark, clashing=True)).collect()
    wanted = [(row[0], np.array(library_ids(row[1] or ""), "<u4").tobytes()) for row in awkward_rows()]
    assert ordered((r[0], bytes(r[1])) for r in encoded) == ordered(wanted)
    decoded = decode_documents(encode_documents(documents(spark))).collect()
    assert ordered(decoded) == ordered((row[0], row[1] or "") for row in awkward_rows())


def test_query_digests(spark, tmp_path):
    from millrace.llm.encoding import op6_bpe_encoding

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for row in awkward_rows():
        ids = np.array(library_ids(row[1] or ""), "<u4")
        wanted.append((row[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert ordered(op6_bpe_encoding(spark, str(tmp_path)).collect()) == ordered(wanted)


def test_cache_is_bounded_and_keeps_what_is_used():
    made = []
    cache = WordCache(lambda word: made.append(word) or word.upper(), 10)
    for k in range(100):
        assert cache[f"w{k}"] == f"W{k}" and cache["often"] == "OFTEN"
        assert len(cache) <= 10 and len(cache.older) <= 10
    assert made.count("often") == 1


VOCAB = unigram_vocabulary(UNIGRAMS)
UNIGRAM_LIBRARY = Tokenizer(models.Unigram(list(VOCAB), unk_id=0, byte_fallback=True))
UNIGRAM_LIBRARY.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="first", split=True)
PIECES = [" ", "  ", "▁", "a", "the", "ing", "é", "中", "😀", "\n", "<s>", "<0x41>", "<unk>", "\x00", "ᄀ", "o"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)))
def test_counts_are_those_of_the_library(text):
    assert unigram_counter(UNIGRAMS).count(text) == len(UNIGRAM_LIBRARY.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_documents(spark):
    counted = count_tokens(documents(spark, clashing=True)).collect()
    wanted = [(row[0], len(row[1] or ""), len(UNIGRAM_LIBRARY.encode(row[1] or "", add_special_tokens=False).ids)) for row in awkward_rows()]
    assert ordered(counted) == ordered(wanted)


def check_packed(rows, sequence):
    by_sequence = {}
    for row in rows:
        by_sequence.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= sequence
    return by_sequence


def test_packing_loses_no_id(spark):
    rows = pack_documents(documents(spark, clashing=True)).collect()
    check_packed(rows, 2048)
    pieces = {}
    for row in rows:
        pieces.setdefault((row.doc_id, row.doc_tokens), []).append((row.start, row.length, row.ids_crc32))
    wanted = {}
    for doc_id, text, *_ in awkward_rows():
        ids = np.array([*library_ids(text or ""), 1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            wanted.setdefault((doc_id, len(ids)), []).append((at, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_packing_leaves_little_room(spark):
    lengths = spark.range(6000).selectExpr(
        "id doc_id", "0L start", "1 + pmod(xxhash64(id), 45) * pmod(xxhash64(id, 1), 45) length", "0L ids_crc32", "0L doc_tokens"
    )
    rows = pack(lengths).collect()
    sequences = check_packed(rows, 2048)
    assert len(rows) == 6000
    assert sum(row.length for row in rows) > 0.985 * 2048 * len(sequences)


def lengths_frame(spark, lengths):
    rows = [(k, 0, int(length), 0, 0) for k, length in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint").repartition(3)


@pytest.mark.parametrize("lengths, wanted", [([1] * 1000, 1), ([9] * 1000, 5), ([1] * 2048 + [2048] * 3, 4), ([65] * 310, 10)])
def test_short_pieces_fill_sequences(spark, lengths, wanted):
    sequences = check_packed(pack(lengths_frame(spark, lengths)).collect(), 2048)
    assert len(sequences) == wanted


def test_packing_of_short_and_mixed_texts(spark):
    draw = np.random.default_rng(8)
    for lengths in (draw.integers(1, 40, 20_000), np.concatenate([draw.integers(1, 12, 9000), draw.integers(60, 700, 9000)])):
        sequences = check_packed(pack(lengths_frame(spark, lengths)).collect(), 2048)
        assert lengths.sum() > 0.985 * 2048 * (len(sequences) - 1)


def test_planned_sizes_hold_the_pieces(spark):
    sizes = spark.range(1, 1002).select("id", size_of(F.col("id"), 1001).alias("size")).collect()
    assert all(row.id <= row["size"] <= min(1001, row.id + row.id // 32) for row in sizes)
    assert all(row["size"] == row.id for row in sizes if row.id <= 64)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 300), max_size=20))
def test_patterns_hold_the_demand(demand):
    for patterns in (cutting_patterns(demand, 32), first_fit({k: v for k, v in demand.items() if v}, 32)):
        held = {}
        for pattern in patterns:
            assert sum(size * number for size, number in pattern.sizes) <= 32
            for size, number in pattern.sizes:
                held[size] = held.get(size, 0) + number * pattern.sequences
        assert all(held.get(size, 0) >= count for size, count in demand.items())
    least = -(-sum(size * count for size, count in demand.items()) // 32)
    assert sum(p.sequences for p in cutting_patterns(demand, 32)) >= least


def test_linear_program_is_near_the_bound():
    demand = {size: 4000 - 130 * size for size in range(3, 30)}
    least = sum(size * count for size, count in demand.items()) / 32
    assert sum(p.sequences for p in cutting_patterns(demand, 32)) <= 1.01 * least + 30


def test_empty_table(spark):
    none = documents(spark, [])
    assert encode_documents(none).count() == 0
    assert count_tokens(none).count() == 0
    assert pack(token_pieces(none)).count() == 0
