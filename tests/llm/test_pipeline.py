"""The pipeline's stages on the small tables, and on tables that are empty or odd."""

import collections
import zlib

import corpus_pipeline
import numpy as np
from featlake.llm import encoder, language_id, near_dedup, quality

from test_numbered_operators import brute_components, counts, exact_fences, exact_ratios, shingle_set


def test_stages_take_effect_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test")
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == names and after <= before, name
        before = after
    kept = near_dedup.near_duplicates(docs).collect()
    assert all(r.kept for r in kept)
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == before
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_decisions_agree_with_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, sf)
    known = corpus_pipeline.identify_language(spark, corpus_pipeline.written(good, "test"), sf)
    left = {r.doc_id for r in known.collect()}
    assert not [i for i in left if labels.get(i) == 0]
    lost = [r for r in good.select("doc_id").collect() if r.doc_id not in left and labels.get(r.doc_id) == 1]
    assert not lost


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test")
    assert docs.count() == 0


def brute_quality(docs):
    """Documents inside the fences, by exact quantiles."""
    measured = []
    for d in docs:
        n_words, chars, symbols, dup, repeat = counts(d.text)
        lines = len([x for x in (d.text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")])
        measured.append({"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines, "base_failed": n_words < 50 or 100 * repeat > 50 * n_words})
    ratios, middle = exact_ratios(measured)
    rows = [(d, x) for d, m, x in zip(docs, measured, ratios, strict=True) if not m["base_failed"]]
    fences = exact_fences([(d.lang, d.source, x) for d, x in rows], middle)
    kept = []
    for d, values in rows:
        own = fences(d.lang, d.source)
        if all(values[n] <= own[f"max_{n}"] for n in quality.RATIOS) and all(values[n] >= own[f"min_{n}"] for n in quality.LOWER):
            kept.append(d)
    return kept


def brute_languages(docs):
    """Documents with a cosine of LEAST_SCORE or more with a language's sum of vectors."""

    def vector(text):
        points = np.array([0, *[ord(c) if c.isalpha() else 0 for c in text.lower()], 0])
        v = language_id.letter_vectors(points).astype(np.int32)
        middle = np.flatnonzero(points[1:-1]) + 1
        return (np.roll(v, 2, axis=1)[middle - 1] * np.roll(v, 1, axis=1)[middle] * v[middle + 1]).sum(axis=0).astype(float)

    sums = collections.defaultdict(lambda: np.zeros(language_id.DIM))
    own = {d.doc_id: vector(d.text or "") for d in docs}
    for d in docs:
        if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 3 != 1:
            sums[d.lang] += own[d.doc_id]
    cosine = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    return [d for d in docs if own[d.doc_id].any() and max(cosine(own[d.doc_id], s) for s in sums.values()) >= language_id.LEAST_SCORE]


def brute_packing(rows, capacity=4096):
    """Sequence and offset of each piece, by a search over all open windows of its group for the tightest one."""
    places = {}
    for group in {r.sequence_id >> 32 for r in rows}:
        windows = []  # (room, when it was last filled)
        for when, r in enumerate(sorted((r for r in rows if r.sequence_id >> 32 == group), key=lambda r: (-r.length, r.doc_id, r.start))):
            fit = [(room, -at, i) for i, (room, at) in enumerate(windows) if room >= r.length]
            if fit:
                room, _, i = min(fit)
            else:
                room, i = capacity, len(windows)
                windows.append(None)
            places[r.doc_id, r.start] = (group << 32 | i, capacity - room)
            windows[i] = (room - r.length, when)
    return places


def test_pipeline_equals_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = {r.item_id: shingle_set(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    good = brute_quality(docs)
    known = brute_languages(good)
    component = brute_components([(d.doc_id, d.text) for d in known])
    single = [d for d in known if component[d.doc_id] == d.doc_id]
    clean = [d for d in single if not any(s and len(s & shingle_set(d.text)) >= 0.8 * len(s) for s in items.values())]
    assert len(docs) > len(good) >= len(known) > len(single) > len(clean) > 0
    rows = corpus_pipeline.run(spark, sf).collect()
    tok = Tokenizer.from_file(encoder.tokenizer_path("word_bpe_49k.json"))
    ids = {d.doc_id: [*tok.encode(d.text or "", add_special_tokens=False).ids, 2] for d in clean}
    want = {}
    for i, x in ids.items():
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            want[i, start] = (len(part), len(x), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.start): (r.length, r.doc_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert {(r.doc_id, r.start): (r.sequence_id, r.offset) for r in rows} == brute_packing(rows)
