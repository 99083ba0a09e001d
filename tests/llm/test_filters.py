"""Quality rules and toxicity."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from cases import DOCUMENTS, awkward_rows, documents, ordered, prose
from pyspark.sql import functions as F

from millrace.llm.quality import (
    CLASSES,
    Limits,
    class_counts,
    class_table,
    corpus_counts,
    corpus_references,
    divergence,
    judge_documents,
    kept_documents,
    least_divergence,
    repeated_words,
)
from millrace.llm.toxicity import Training, best_threshold, clean_documents, gradient, language_group, learn, score_documents, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    covered = {k for at, window in enumerate(windows) if times[window] > 1 for k in (at, at + 1, at + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:k] for k, line in enumerate(lines)),
        len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_base_counts(spark):
    rows = [*awkward_rows(), (400, "a b c a b c d", "en", "s", 1), (401, "same\n\nsame\n \nsame\x0b\nsame", "en", "s", 1), (402, "# $ <a> | * %\x0c&", "en", "s", 1)]
    df = documents(spark, rows, clashing=True)
    judged = judge_documents(df, corpus_references(df, Limits()))
    got = ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged.collect())
    assert got == ordered((row[0], *base_counts(row[1])) for row in rows)


def test_repeated_words_by_brute_force():
    for seed in range(60):
        words = [f"w{c}".encode() for c in np.random.default_rng(seed).integers(0, 4, 40)]
        assert repeated_words(words) == base_counts(b" ".join(words).decode())[4]


def test_references_and_divergence_by_brute_force(spark):
    rows = [(k, prose(k, 300), "en" if k % 2 else "fr", "s", 0) for k in range(8)] + [(9, None, "en", "s", 0), (10, "x y", None, "s", 0)]
    limits = Limits(common_share=1 / 40)
    found = corpus_references(documents(spark, rows), limits)
    assert found.languages == ("en", "fr")
    table = class_table()
    for number, language in enumerate(found.languages):
        mine = [row[1] for row in rows if row[2] == language and row[1]]
        classes = sum(class_counts(text, table) for text in mine)
        assert np.allclose(found.classes[number], classes / classes.sum())
        words = Counter(word for text in mine for word in text.lower().encode().split())
        share = {word: n / words.total() for word, n in words.items() if n * 40 >= words.total()}
        assert {w: p for w, p in zip(found.place, found.words[number], strict=True) if p} == share
    text = prose(50, 200)
    mine = Counter(text.lower().encode().split())
    expected = []
    for number in range(2):
        common = {word: p for word, p in zip(found.place, found.words[number], strict=True) if p}
        p = [mine[word] / mine.total() for word in common]
        q = list(common.values())
        p, q = np.array([*p, 1 - sum(p)]), np.array([*q, 1 - sum(q)])
        by_class = divergence(class_counts(text, table) / class_counts(text, table).sum(), found.classes[number])
        expected.append(jensen_shannon(p, q) + by_class)
    got = least_divergence(class_counts(text, table), text.lower().encode().split(), found, 1.0)
    assert math.isclose(got, min(expected), abs_tol=1e-9)


def jensen_shannon(p, q):
    middle = (p + q) / 2
    return sum((a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0) for a, b, m in zip(p, q, middle, strict=True)) / 2


def test_divergence_bounds():
    assert divergence(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert divergence(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


def test_junk_goes_and_prose_stays(spark):
    rows = [(k, prose(k, 150), "en", "s", 0) for k in range(60)]
    junk = " ".join(f"{word.upper()}%%%" for word in prose(70, 150).split())
    rows += [(100, junk, "en", "s", 0), (101, "ab cd ef " * 60, "en", "s", 0), (102, "zq jx " + junk, None, "s", 0), (103, prose(71, 120), "sv", "s", 0)]
    rows += [(104, junk, "xx", "s", 0), (105, junk[: len(junk) // 2], "", "s", 0)]
    df = documents(spark, rows, clashing=True)
    kept = kept_documents(df, corpus_references(df, Limits(common_share=1 / 100, language_share=0.05)))
    assert kept.columns == df.columns
    assert sorted(row.doc_id for row in kept.collect()) == [*range(60), 103]


def test_references_are_bounded_whatever_languages_there_are(spark):
    rows = [(k, prose(k, 60), f"lang{k}", "s", 0) for k in range(300)] + [(400 + k, prose(k, 400), "en", "s", 0) for k in range(20)]
    found = corpus_references(documents(spark, rows), Limits())
    assert found.languages == ("en",) and len(found.classes) == 2 and len(found.place) <= 2 * 500
    everything = Counter(word for _, text, *_ in rows for word in text.lower().encode().split())
    share = {word: n / everything.total() for word, n in everything.items() if n * 500 >= everything.total()}
    assert {w: p for w, p in zip(found.place, found.words[-1], strict=True) if p} == share
    table = class_table()
    classes = sum(class_counts(text, table) for _, text, *_ in rows)
    assert np.allclose(found.classes[-1], classes / classes.sum())


def test_documents_without_any_language(spark):
    junk = " ".join(f"{word.upper()}%%%" for word in prose(70, 150).split())
    df = documents(spark, [(k, prose(k, 150), None, "s", 0) for k in range(40)] + [(50, junk, None, "s", 0), (51, junk, "xx", "s", 0)])
    limits = Limits(common_share=1 / 100, language_share=0.05)
    references = corpus_references(df, limits)
    assert references.languages == ()
    assert sorted(row.doc_id for row in kept_documents(df, references, limits).collect()) == list(range(40))


def test_class_names_match_counts(spark):
    df = documents(spark, [(1, "Ab1 .#\n", "en", "s", 0)])
    counts = {bytes(r["item"]).decode(): r["count"] for r in corpus_counts(df).collect() if r["kind"] == "class"}
    wanted = dict.fromkeys(CLASSES, 0) | {"upper": 1, "lower": 1, "digit": 1, "white": 1, "stop": 1, "symbol": 1, "newline": 1}
    assert counts == wanted


def labelled(count, first=0):
    """Texts of which a fifth have one of a few words that make them toxic."""
    rows = []
    for k in range(first, first + count):
        text = prose(k, 60)
        if k % 5 == 0:
            words = text.split(" ")
            words[k % len(words)] = ["vile,", "Rotten", "scummy"][k // 5 % 3]
            text = " ".join(words)
        rows.append((k, text, "en", "s", 0))
    return rows


def test_toxicity_on_documents_not_learned_from(spark):
    rows = labelled(1500)
    df = documents(spark, [*rows, (5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "word", "en", "s", 0)], clashing=True)
    labels = spark.createDataFrame([*((row[0], 1, int(row[0] % 5 == 0)) for row in rows), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = learn(df, labels, Training(epochs=8))
    scored = {row.doc_id: row for row in score_documents(df, model).collect()}
    assert len(scored) == 1503 and all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in scored.values())
    import zlib

    held_out = [k for k in range(1500) if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum(scored[k].predicted == (k % 5 == 0) for k in held_out)
    assert right >= 0.97 * len(held_out)
    assert scored[5000].score == scored[5001].score < 0.5
    clean = clean_documents(df, model)
    assert clean.columns == df.columns
    assert ordered([row.doc_id] for row in clean.collect()) == ordered([k] for k, row in scored.items() if not row.predicted)


def test_toxicity_is_learned_from_all_labels(spark):
    """Words that only the last half of many toxic documents have, by the hash that once chose some, and very long texts."""
    ids = [k for k in range(12_500) if zlib.crc32(str(k).encode()) % 5]
    toxic = spark.createDataFrame([(k,) for k in ids[:6000]], "doc_id bigint").orderBy(F.xxhash64(F.lit(5), "doc_id")).collect()
    word = {row.doc_id: "early" if place < 3000 else "later" for place, row in enumerate(toxic)}
    rows = [(k, f"{prose(k, 6)} {word.get(k, 'plain')} {prose(k + 1, 3)}", "en", "s", 0) for k in ids]
    rows += [(k, "long " * 41_000 + "endless", "en", "s", 0) for k in range(20_001, 20_120) if zlib.crc32(str(k).encode()) % 5]
    asked = [(30_001, "one early day", "en", "s", 0), (30_002, "one later day", "en", "s", 0), (30_003, "one plain day", "en", "s", 0), (30_004, "an endless day", "en", "s", 0)]
    labels = [(row[0], 1, int(row[0] in word or row[0] > 20_000)) for row in rows]
    held = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = learn(documents(spark, rows).repartition(7), held, Training(epochs=3))
    assert model.learned_from == len(rows)
    assert [row.predicted for row in score_documents(documents(spark, asked), model).orderBy("doc_id").collect()] == [1, 1, 0, 1]
    again = learn(documents(spark, rows).repartition(3), held.repartition(5), Training(epochs=3))
    assert again.thresholds == model.thresholds and (again.embedding == model.embedding).all() and again.intercept == model.intercept


def test_scores_depend_on_the_text_alone(spark):
    model = train([np.array([1, 2, 3]), np.array([4, 5, 6])] * 30, np.array([0, 1] * 30), ["plain"] * 60, Training())
    one = spark.createDataFrame([(1, "some text", "en", "a", 9)], DOCUMENTS)
    other = spark.createDataFrame([(2, "some text", None, "b", 1)], DOCUMENTS)
    assert score_documents(one, model).first().score == score_documents(other, model).first().score


def test_without_labels_nothing_is_toxic(spark):
    df = documents(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {row.predicted for row in score_documents(df, learn(df, labels)).collect()} == {0}
    assert score_documents(documents(spark, []), learn(documents(spark, []), labels)).count() == 0


def test_gradient_by_differences():
    random = np.random.default_rng(1)
    texts, labels = [random.integers(0, 20, n) for n in (5, 9, 1, 0)], np.array([1, 0, 1, 0])
    model = train([random.integers(0, 20, 9) for _ in range(20)], np.array([0, 1] * 10), ["plain"] * 20, Training(seen_in=0, epochs=1, size=3, filters=2))
    for name in ("embedding", "weights"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.kernels = [k.astype(np.float64) for k in model.kernels]
    rows = [np.minimum(t + 1, len(model.embedding) - 1) for t in texts]

    def loss():
        z = model.logits(rows)
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    gradients, _ = gradient(model, rows, labels, np.ones(4))
    for parameter, found in zip([model.embedding, *model.kernels], gradients, strict=False):
        for at in [tuple(random.integers(0, s) for s in parameter.shape) for _ in range(15)]:
            if parameter is model.embedding and at[0] == 0:
                continue
            held = parameter[at]
            parameter[at] = held + 1e-5
            above = loss()
            parameter[at] = held - 1e-5
            below = loss()
            parameter[at] = held
            assert abs((above - below) / 2e-5 - found[at]) < 1e-4


def test_forward_pass_by_loops():
    """Every filter at every place of every text, one after the other."""
    draw = np.random.default_rng(4)
    model = train([np.arange(30), np.arange(20), np.arange(10, 30)], np.zeros(3), ["plain"] * 3, Training(seen_in=0.0))
    for array in (model.embedding, *model.kernels, *model.biases, model.weights):
        array[...] = draw.normal(0, 1, array.shape)
    model.embedding[0] = 0
    texts = [draw.integers(0, len(model.embedding), size) for size in (0, 1, 2, 3, 17, 40)]
    wanted = []
    for text in texts:
        logit = model.intercept
        place = 0
        for kernel, bias in zip(model.kernels, model.biases, strict=True):
            for number in range(len(bias)):
                found = []
                for at in range(len(text) + 1):
                    words = [text[at + step] if at + step < len(text) else 0 for step in range(len(kernel))]
                    found.append(sum(model.embedding[word] @ kernel[step][:, number] for step, word in enumerate(words)) + bias[number])
                logit += max(0, *found) * model.weights[place] if len(found) > 1 else max(0, found[0]) * model.weights[place]
                place += 1
        wanted.append(logit)
    assert np.allclose(model.logits(texts), wanted, rtol=1e-4, atol=1e-4)


def test_thresholds_by_trying_all():
    draw = np.random.default_rng(9)
    for _ in range(40):
        scores, labels = draw.normal(0, 1, 30), draw.integers(0, 2, 30)
        if not labels.sum():
            continue

        def f1(border, scores=scores, labels=labels):
            called = scores >= border
            return 2 * (called & (labels == 1)).sum() / max(1, called.sum() + labels.sum())

        best = max(f1(border) for border in scores)
        assert f1(best_threshold(scores, labels)) == best


def test_languages_are_told_from_letters():
    assert [language_group(t) for t in ("plain words", "schöne große Wörter", "canción pequeña y más", "très élevé à côté", "")] == ["plain", "de", "es", "fr", "plain"]
