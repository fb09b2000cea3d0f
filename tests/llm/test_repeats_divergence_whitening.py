"""Suffix dedup, source divergence and whitening against brute force, on small tables with odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.llm import divergence, suffix_dedup, whitening
from featlake.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, tie string, lo string, term string, n string, place string, kept string"


def frame(spark, rows):
    """Documents from (id, text, lang, source), with extra columns whose names clash."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "d", "t", "l", None, "n", "p", "k") for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op12_source_divergence"])
def test_equals_sql(name, spark, sf, same):
    same(queries()[name](spark, sf), oracle_sql()[name])


# Suffix dedup.


def brute_repeats(docs):
    """(id, text) -> n_bytes, n_removed, n_spans, sha256; documents in order of id (null last) and hash of the text."""
    seen, out = set(), {}
    for i, tie, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if (i, t) in out:
            continue
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i, t] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def digests(spark, rows, **options):
    docs = frame(spark, rows).repartition(4)
    ties = {(r["doc_id"], r["text"]): r["tie"] for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    df = suffix_dedup.without_repeats(docs, **options)
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    got = [tuple(r) for r in df.select("doc_id", "n_bytes", size, F.size("removed"), F.sha2("kept", 256)).collect()]
    order = sorted({(i, t) for i, t, *_ in rows}, key=lambda x: (x[0] is None, x[0] or 0, ties[x]))
    want = brute_repeats([(i, ties[i, t], t) for i, t in order])
    return sorted(map(str, got)), sorted(str((r[0], *want[r[0], r[1]])) for r in rows)


def odd_texts():
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcd ü") for _ in range(2500))
    rows = []
    for i in range(160):
        kind, p = rnd.randrange(6), rnd.randrange(2000)
        t = "aaa" * rnd.randrange(150) if kind == 0 else "spam " * rnd.randrange(80) if kind == 1 else base[p : p + rnd.randrange(90, 300)]
        if kind == 3:
            p = rnd.randrange(600)
            t = base[:p] + "#" + base[p:600]
        elif kind == 4:
            t = "".join(rnd.choice("xy") for _ in range(rnd.randrange(300)))
        elif kind == 5:
            t = "# a header line that all documents share, of sixty-five bytes ####" + "".join(rnd.choice("pqrst") for _ in range(150))
        rows.append((i, t, "en", "a"))
    # Null, empty and short texts, null and repeated ids, repeated rows, a repeat inside a text.
    rows += [(500, None, None, None), (501, "", None, None), (502, "x" * 99, "en", "a"), (503, "x" * 100, "en", "a"), (504, "x" * 101, "en", "a")]
    rows += [(None, base[:700], "en", "a"), (None, base[5:800], "en", "b"), (7, base[100:900], "en", "a"), (7, base[100:900], "en", "a"), (505, base[:400] + base[:400], "fr", "b")]
    return rows


def test_repeated_strings_equal_brute_force(spark):
    got, want = digests(spark, odd_texts())
    assert got == want


def test_spans_of_hot_seeds_are_compared_as_rows(spark):
    got, want = digests(spark, odd_texts(), hot=3)
    assert got == want


def test_copies_over_many_ranges(spark, monkeypatch):
    """One text is most of all rows: its spans fill whole ranges, so only the edges tell that they are not the first."""
    monkeypatch.setattr(suffix_dedup, "RANGE", 20)
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    rows = [(i, text if i % 3 else "".join(rnd.choice("abcdefgh ") for _ in range(130)), "en", "a") for i in range(300)]
    got, want = digests(spark, rows)
    assert got == want


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(4000))
    got, want = digests(spark, [(1, text, "en", "a"), (2, "zz" + text, "en", "a"), (3, text[800:2800], "en", "a"), (4, text + text, "en", "a")])
    assert got == want


def test_every_string_has_one_span_and_equal_strings_equal_anchors():
    rnd = np.random.default_rng(6)
    texts = [bytes(rnd.integers(97, 100, n, dtype=np.uint8)) for n in (0, 50, 99, 100, 101, 700)] + [b"q" * 400]
    ends = np.cumsum([len(t) for t in texts])
    begins = np.append(0, ends[:-1])
    data = b"".join(texts)
    text, lo, n, anchor, _ = suffix_dedup.spans_of(data, begins, ends)
    strings = [s for a, k in zip(lo, n, strict=True) for s in range(a, a + k)]
    assert sorted(strings) == [s for b, e in zip(begins, ends, strict=True) for s in range(b, e - 99)]
    place = collections.defaultdict(set)
    for a, k, at in zip(lo, n, anchor, strict=True):
        for s in range(a, a + k):
            assert 0 <= at - s <= 100 - suffix_dedup.SEED
            place[data[s : s + 100]].add(at - s)
    assert all(len(p) == 1 for p in place.values())


def test_multikey_order_equals_a_stable_sort():
    rnd = np.random.default_rng(7)
    for n in (0, 1, 2, 500):
        words = [rnd.integers(0, 4, n) for _ in range(4)]
        assert suffix_dedup.multikey_order(words).tolist() == sorted(range(n), key=lambda i: tuple(w[i] for w in words))


def test_no_documents_no_rows(spark):
    assert suffix_dedup.without_repeats(frame(spark, [])).collect() == []
    assert divergence.audited(frame(spark, [])).collect() == []


# Source divergence.


def brute_audit(rows, least_docs):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        having = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in having.items() if n >= least_docs)
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if having[t] >= least_docs) for s in {d[1] for d in own}}
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:top], 1)]
    return sorted(out)


def divergent(seed=8, n=120):
    rnd = random.Random(seed)
    terms = [f"{a}{b}{c}" for a in "abÄßé" for b in "xyz" for c in "uvw"]
    rows = []
    for i in range(n):
        lang, source = rnd.choice(["en", "en", "fr", None, "xx"]), rnd.choice(["s1", "s2", "s3", "s4", None])
        text = " ".join(rnd.choice(terms[: 20 if source == "s1" else 45]) + rnd.choice([" ", "1", "_", "-"]) for _ in range(rnd.randrange(60)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang, source))
    rows += [(900, None, "en", "s1"), (901, "", "en", "s9"), (902, "12 34", "only", "s"), (903, "lone words", "de", "a"), (904, "other words", "de", "b")]
    rows += [(905, "hot " * 5000, "en", "s2"), (None, "hot axu", "en", "s2"), (906, "İI ǅ axu", "en", "s3")]
    return rows + rows[:9]


@pytest.mark.parametrize("span,tile", [(1024, 64), (4, 64), (8, 2)])
def test_audit_equals_brute_force(spark, monkeypatch, span, tile):
    """Also with terms in several subtrees and sources in several tiles."""
    monkeypatch.setattr(divergence, "SPAN", span)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = divergent()
    df = divergence.audited(frame(spark, rows).repartition(3), least_docs=3)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, df.collect())) == brute_audit(rows, 3)


def test_a_hot_source_and_few_terms_held(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    rows = [(i, f"term{chr(97 + i % 9)} word", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(90)]
    assert sorted(map(tuple, divergence.audited(frame(spark, rows)).collect())) == brute_audit(rows, 10)


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 64), np.int64)
    counts[1, 5] = 2
    forest = divergence.Forest(counts)
    assert forest.roots[0] == forest.roots[2] != forest.roots[1]
    assert [len(left) for left, _ in forest.levels] == [2] * 6
    assert len(forest.leaves) == 2


def test_shares_are_exact_for_large_counts(spark):
    rows = [(c, n, v) for c, n, v in [(0, 0, 1), (7, 10, 3), (10**13, 10**14 - 10**7, 10**6), (123_456_789_012, 98_765_432_109_876, 77_777)] if c <= n or not n]
    df = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    for c, n, v, p in df.collect():
        assert p == 1 + 10**9 * (c + 2) // (n + 2 * v)
        assert divergence._shares(np.array([c]), np.array([n]), v).tolist() == [p]


# Whitening.

VECTORS = "vec_id long, embedding array<float>, label int, x string, whitened string"


def brute_whitened(vectors, most):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return ((n * x - s) ** 2).sum(axis=1), y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whitened_equals_numpy(spark):
    rnd = np.random.default_rng(9)
    vectors = (rnd.normal(size=(700, 12)) * np.linspace(0.1, 2, 12)).astype(np.float32).tolist()
    rows = [(i, v, None, "x", "w") for i, v in enumerate(vectors)]
    odd = [None, [], [None, *vectors[0][1:]], [float("nan"), *vectors[0][1:]], [float("-inf"), *vectors[0][1:]], [1e30, *vectors[0][1:]], vectors[0][:5]]
    got = whitening.whitened(spark.createDataFrame(rows + [(1000 + i, v, 1, "x", "w") for i, v in enumerate(odd)], VECTORS).repartition(5)).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(700))
    deviation, z, explained = brute_whitened(vectors, 8)
    assert [r["deviation"] for r in got] == deviation.tolist()
    mine = np.array([r["whitened"] for r in got])
    sign = np.sign((mine * z).sum(axis=0))
    np.testing.assert_allclose(mine * sign, z, atol=1e-9)
    np.testing.assert_allclose(got[0]["explained"], explained, rtol=1e-10)
    assert {(r["n"], r["identity_error"] < 1e-9) for r in got} == {(700, True)}


def test_equal_rows_constant_dimensions_and_single_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], None, "", "")] * 40, VECTORS)
    assert whitening.whitened(one).collect() == []
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(i % 3, [float(i % 2), 5.0, float(-(i % 2))], None, "", "") for i in range(60)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 60 and {len(r["whitened"]) for r in got} == {1}
    assert {round(abs(r["whitened"][0]), 9) for r in got} == {1.0}
    assert got[0]["identity_error"] < 1e-9 and got[0]["explained"] == [1.0]


def test_deviations_beyond_64_bits_are_errors(spark):
    rows = [(i, [float((-1) ** i * 2.0**30)] * 3, None, "", "") for i in range(30)]
    with pytest.raises(Exception, match="(?i)too large|overflow|out of"):
        whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()


@pytest.mark.parametrize("d", [1, 2, 3, 40])
@pytest.mark.parametrize("kind", ["dense", "identity", "clusters", "low rank", "diagonal", "zero"])
def test_leading_components(d, kind):
    rnd = np.random.default_rng(d)
    a = rnd.normal(size=(d, d))
    q, _ = np.linalg.qr(a)
    x = rnd.normal(size=(d, 2))
    near = np.where(np.arange(d) < d // 2, 3.0, 1.0) + 1e-9 * np.arange(d)
    a = {"dense": a @ a.T, "identity": np.eye(d), "clusters": q @ np.diag(near) @ q.T, "low rank": x @ x.T, "diagonal": np.diag(np.arange(d) + 1.0), "zero": np.zeros((d, d))}[kind]
    a = (a + a.T) / 2
    values, vectors = whitening.leading_components(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    k = len(values)
    assert k == {"low rank": min(2, d), "zero": 0}.get(kind, min(8, d))
    np.testing.assert_allclose(values, want[:k], rtol=1e-11, atol=1e-11)
    assert np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-11 * max(1, want[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-11


def test_sturm_counts_are_numbers_of_smaller_eigenvalues():
    rnd = np.random.default_rng(10)
    d, e = rnd.normal(size=30), rnd.normal(size=29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = rnd.uniform(-3, 3, 50)
    assert whitening.sturm_counts(d, e, at).tolist() == [(values < x).sum() for x in at]
