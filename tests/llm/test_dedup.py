"""Near duplicates, components, repeated passages and sketches against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from cases import awkward_rows, documents, ordered, prose
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.phrases import parse, rolling_hash, sliding_least
from millrace.llm.repeats import covered, op1_suffix_array_dedup, repeated_windows, without_repeats
from millrace.llm.simhash import (
    GOLAY,
    fingerprint_links,
    fingerprint_of,
    golay_indices,
    keys_of,
    near_duplicate_groups,
    one_of_each,
    op8_simhash_near_dedup,
)
from millrace.llm.sketches import (
    compare_sketches,
    difference,
    digests,
    document_fingerprints,
    in_blocks,
    likeness,
    peeled,
    sketch,
    with_following_text,
)


def roots(nodes, links):
    parent = {node: node for node in nodes}

    def find(node):
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {node: find(node) for node in nodes}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize(("seed", "hub_links"), [(0, 1000), (1, 1000), (2, 5), (3, 0)])
def test_components(spark, seed, hub_links):
    chosen = random.Random(seed)
    links = [(chosen.randrange(60), chosen.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 200 + k) for k in range(30)]
    links += [(-5, 7), (7, -5), (9, 9)]
    chosen.shuffle(links)
    found = connected_components(spark.createDataFrame(links, "a bigint, b bigint"), hub_links)
    nodes = {node for a, b in links if a != b for node in (a, b)}
    assert {(r.node, r.component) for r in found.collect()} == set(roots(nodes, [p for p in links if p[0] != p[1]]).items())


def test_no_links_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_golay_code_is_perfect():
    nearest = golay_indices()
    assert np.bincount(nearest).tolist() == [2048] * 4096
    codeword = int(np.flatnonzero(nearest == 1)[0])
    assert bin(GOLAY).count("1") == 7 and nearest[GOLAY] == nearest[GOLAY ^ 0b101] and codeword >= 0


def test_keys_bring_linked_fingerprints_together():
    chosen = random.Random(2)
    for _ in range(1500):
        one = chosen.getrandbits(64)
        other = one
        for bit in chosen.sample(range(64), chosen.randrange(3)):
            other ^= 1 << bit
        keys = [set(keys_of(np.array([value], np.uint64))[1].tolist()) for value in (one, other)]
        assert keys[0] & keys[1] and len(keys[0]) <= 18


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for row in awkward_rows():
        assert fingerprint_of(row[1]) == brute_fingerprint(row[1])
    assert fingerprint_of("ÀB C d") == brute_fingerprint("Àb c D") != fingerprint_of("àb c d")


def brute_groups(values):
    """For fingerprints by position: the positions' component, linked at two bits."""
    distinct = sorted(set(values))
    held = np.array(distinct, np.uint64)
    links = [
        (a, distinct[k + 1 + j]) for k, a in enumerate(distinct) for j in np.flatnonzero(np.bitwise_count(held[k + 1 :] ^ held[k]) <= 2)
    ]
    return roots(distinct, links)


@pytest.mark.parametrize("large_key", [2, 16, 10**9])
def test_links_of_crowded_fingerprints(spark, large_key):
    chosen = random.Random(1)
    base = chosen.getrandbits(64)
    values = {base, 0} | {base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    values |= {value ^ (7 << chosen.randrange(60)) for value in list(values)[:200]} | {chosen.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(signed(value),) for value in values], "fingerprint bigint")
    found = {(r.node, r.component) for r in connected_components(fingerprint_links(df, large_key)).collect()}
    wanted = {}
    for value, root in brute_groups(values).items():
        wanted.setdefault(root, []).append(signed(value))
    assert found == {(value, min(group)) for group in wanted.values() if len(group) > 1 for value in group}


def test_near_duplicate_groups(spark, tmp_path):
    rows = awkward_rows()
    prints = [brute_fingerprint(row[1]) for row in rows]
    group = brute_groups(prints)
    least = {}
    for row, value in zip(rows, prints, strict=True):
        if row[0] is not None:
            least[group[value]] = min(row[0], least.get(group[value], row[0]))
    wanted = ordered((row[0], f"{value:016x}", least.get(group[value])) for row, value in zip(rows, prints, strict=True))
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert ordered(op8_simhash_near_dedup(spark, str(tmp_path)).collect()) == wanted
    df = documents(spark, clashing=True)
    groups = near_duplicate_groups(df)
    kept = one_of_each(df, groups)
    assert kept.columns == df.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(least.values()))
    assert near_duplicate_groups(documents(spark, [])).count() == 0


def test_texts_without_id_or_with_one_id_stay(spark):
    texts = [prose(7000 + k, 80) for k in range(5)]
    rows = [(None, texts[0], "en", "s", 0), (None, texts[1], "en", "s", 0), (None, texts[1], "en", "s", 0), (5, texts[2], "en", "s", 0)]
    rows += [(5, texts[3], "en", "s", 0), (6, texts[4], "en", "s", 0), (None, texts[4], "en", "s", 0), (7, texts[4], "en", "s", 0)]
    df = documents(spark, rows)
    kept = one_of_each(df, near_duplicate_groups(df)).collect()
    wanted = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4])]
    assert ordered((row.doc_id, row.text) for row in kept) == ordered(wanted)


def test_column_names_with_spaces(spark):
    df = documents(spark).withColumnRenamed("doc_id", "doc id")
    assert near_duplicate_groups(df, "doc id").columns[0] == "doc id"
    assert one_of_each(df, near_duplicate_groups(df, "doc id"), "doc id").columns == df.columns


def brute_repeats(rows, length=100):
    """Per row by id: bytes, removed, spans, what is kept."""
    seen, results = set(), []
    for row, data in rows:
        marks = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                marks[at : at + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for k, mark in enumerate(marks) if mark and not (k and marks[k - 1]))
        results.append((row, len(data), sum(marks), spans, bytes(b for b, mark in zip(data, marks, strict=True) if not mark)))
    return results


def repetitive_rows():
    chosen = random.Random(3)
    line = prose(1, 40)
    rows = [(k, prose(500 + k, chosen.randint(1, 50)) + "\n" + line + "\n" + prose(900 + k, chosen.randint(1, 30))) for k in range(120)]
    rows += [(300, "a" * 3000), (301, "ab" * 2000), (302, "a" * 99), (303, "a" * 100), (304, None), (305, "")]
    rows += [(306, rows[5][1]), (307, rows[5][1][50:]), (308, prose(9, 900) * 2), (309, "a" * 3000), (-4, rows[7][1])]
    return rows


@pytest.mark.parametrize("hot", [10_000, 40, 2])
def test_repeats_are_removed(spark, hot):
    rows = repetitive_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    wanted = brute_repeats(sorted((doc, (text or "").encode()) for doc, text in rows))
    found = [(r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.removed), len(r.removed), bytes(r.kept)) for r in without_repeats(df, hot=hot).collect()]
    assert sorted(found) == sorted(wanted)


def test_repeats_in_awkward_documents(spark, tmp_path):
    rows = [row for row in awkward_rows() if row[0] != 304]
    documents(spark, rows, clashing=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = op1_suffix_array_dedup(spark, str(tmp_path)).collect()
    by_id = sorted(((-(1 << 62) if row[0] is None else row[0]), (row[1] or "").encode()) for row in rows)
    wanted = [(None if doc < -(1 << 60) else doc, n, m, k, hashlib.sha256(kept).hexdigest()) for doc, n, m, k, kept in brute_repeats(by_id)]
    assert ordered(found) == ordered(wanted)


def test_kept_texts_and_carried_columns(spark):
    rows = [(1, prose(1, 200) + "é", "en", "a", 5), (2, "x" + prose(1, 200) + "ê", None, None, None)]
    found = {r.doc_id: r for r in without_repeats(documents(spark, rows), carried=["lang", "source", "n_chars"], kept_text=True).collect()}
    assert found[1].kept == rows[0][1] and (found[1].lang, found[1].source, found[1].n_chars) == ("en", "a", 5)
    assert found[2].kept in ("x", "xê") and found[2].lang is None
    assert without_repeats(documents(spark, [])).count() == 0


def test_phrases_cover_all_windows_and_depend_on_them_alone():
    shared = prose(5, 120).encode()
    texts = [b"q" * 37 + shared, prose(6, 30).encode() + shared + b"zz", b"short", b"", b"a" * 400]
    found = parse(texts, 100, 36)
    for number, text in enumerate(texts):
        mine = found.text == number
        windows = [w for first, n in zip(found.first[mine], found.windows[mine], strict=True) for w in range(first, first + n)]
        assert windows == list(range(max(0, len(text) - 99)))
    keys = {}
    for number, first, n, key in zip(found.text, found.first, found.windows, found.key, strict=True):
        for window in range(first, first + n):
            keys.setdefault(texts[number][window : window + 100], set()).add(key)
    assert all(len(held) == 1 for held in keys.values())


def test_long_texts_are_parsed_in_chunks(monkeypatch):
    text = prose(8, 2000).encode()
    whole = parse([text, text[:500]], 100, 36)
    monkeypatch.setattr("millrace.llm.phrases.CHUNK", 1000)
    cut = parse([text, text[:500]], 100, 36)
    key_of = lambda p: {(t, w): k for t, f, n, k in zip(p.text, p.first, p.windows, p.key, strict=True) for w in range(f, f + n)}
    assert key_of(whole) == key_of(cut)


def test_hash_and_least_by_brute_force():
    data = np.frombuffer(prose(1, 60).encode(), np.uint8)
    hashes = rolling_hash(data, 36)
    assert len(hashes) == len(data) - 35
    same = {}
    for at, value in enumerate(hashes.tolist()):
        assert same.setdefault(data[at : at + 36].tobytes(), value) == value
    for width in (1, 2, 7, 65):
        assert sliding_least(hashes, width).tolist() == [min(hashes[k : k + width].tolist()) for k in range(len(hashes) - width + 1)]


def test_equal_suffixes_and_spans():
    contexts = [b"abcdef", b"xbcdez", b"bcde"]
    phrase, within = repeated_windows(b"".join(contexts), np.array([3, 1, 2]), np.array([0, 0, 9]), np.array([3, 3, 1]), 4)
    assert sorted(zip(phrase.tolist(), within.tolist(), strict=True)) == [(0, 1), (2, 0)]
    assert covered(np.array([10, 0, 12, 60]), np.array([1, 2, 3, 1]), 5) == [(0, 6), (10, 19), (60, 65)]
    assert covered(np.array([0, 5]), np.array([1, 1]), 5) == [(0, 10)]


def pieces(text):
    """Lines, long ones cut after words whose signed 64-bit hash is a multiple of 20, and all after 40 words."""
    found = set()
    for line in text.split("\n"):
        if len(line) > 1000:
            words = [(word, xxhash.xxh64_intdigest(word.encode(), 42)) for word in line.split(" ")]
            line = " ".join(f"{word}\n" if (hashed - (hashed >> 63 << 64)) % 20 == 0 else word for word, hashed in words)
        found |= set(re.findall(r"[^ \n]+(?: +[^ \n]+){0,39}", line))
    return found


def brute_sketches(rows):
    """By id and edited text: likeness of a row to its edited form and to the next row's text."""
    order = sorted(rows, key=lambda row: row[1] or "")
    order = sorted(order, key=lambda row: -(1 << 62) if row[0] is None else row[0], reverse=True)
    order = sorted(rows, key=lambda row: (-(row[0] if row[0] is not None else -(1 << 62)), (row[1] or "").encode()))
    results = []
    for k, row in enumerate(order):
        text, following = row[1] or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        likeness = [len(pieces(text) & pieces(o)) / len(pieces(text) | pieces(o)) if pieces(text) | pieces(o) else 1.0 for o in (edited, following)]
        results.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), *(round(x, 12) for x in likeness)))
    return results


def test_document_fingerprints(spark):
    rows = awkward_rows()
    found = document_fingerprints(documents(spark, clashing=True)).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in found]
    assert ordered(got) == ordered(brute_sketches(rows))
    prints = {}
    for row in rows:
        prints.setdefault(row[1] or "", set())
    by_id = {row[0]: row[1] or "" for row in rows}
    for r in found:
        prints[by_id[r.doc_id]].add(r.fingerprint)
    assert all(len(held) == 1 for held in prints.values())
    assert document_fingerprints(documents(spark, [])).count() == 0
    assert [r.near_next for r in document_fingerprints(documents(spark, [(5, "alone", "en", "s", 5)])).collect()] == [1.0]


def test_no_python_in_the_plan(spark):
    plan = document_fingerprints(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowToArray", ""))


def test_following_text_over_many_ranges(spark):
    rows = [(k * k, f"text {k}", "en", "s", 0) for k in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        found = {r.id: r.following for r in with_following_text(documents(spark, rows), "doc_id", "text").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {k * k: f"text {(k - 1) % 200}" for k in range(200)}


@pytest.mark.parametrize("sizes", [(0, 0), (3, 4), (10, 12), (60, 20), (700, 900)])
def test_peeling_recovers_the_difference(spark, sizes):
    chosen = random.Random(sum(sizes))
    shared = [chosen.getrandbits(63) for _ in range(25)]
    one, other = shared + [chosen.getrandbits(63) for _ in range(sizes[0])], shared + [-chosen.getrandbits(63) for _ in range(sizes[1])]
    df = spark.createDataFrame([(one, other)], "a array<bigint>, b array<bigint>")
    large = df.select(F.expr(in_blocks("a", "b")).alias("d")).first().d
    assert sorted(large.plus) == sorted(one[25:]) and sorted(large.minus) == sorted(other[25:])
    small = df.select(F.expr(peeled(difference(sketch("a", 8), sketch("b", 8)), 8)).alias("d")).first().d
    if sum(sizes) > 24:
        assert small is None
    elif small is not None:
        assert sorted(small.plus) == sorted(one[25:]) and sorted(small.minus) == sorted(other[25:])


def test_an_edit_changes_the_pieces_it_touches_alone(spark):
    line = " ".join(prose(13, 400).split())
    words = line.split(" ")
    edits = [f"one {line}", " ".join(words[:200] + words[201:]), " ".join([*words[:100], "new", "words", *words[100:]])]
    df = spark.createDataFrame([(line, edit) for edit in edits], "old string, new string")
    compared = compare_sketches(df, ["old", "new"]).select(F.expr(likeness("digests_old", "changed_new")).alias("near")).collect()
    assert all(0.8 < row.near < 1 for row in compared)


def test_versions_compared(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd")], "old string, new string")
    row = compare_sketches(df, ["old", "new"]).first()
    hashed = spark.sql("select xxhash64('b') b, xxhash64('x') x, xxhash64('d') d").first()
    assert row.changed_new.plus == [hashed.b] and sorted(row.changed_new.minus) == sorted([hashed.x, hashed.d])
    assert spark.sql(f"select {digests(repr('a b'))} d").first().d == [spark.sql("select xxhash64('a b') h").first().h]
