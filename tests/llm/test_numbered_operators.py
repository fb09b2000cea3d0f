"""The numbered operators against brute force, round trips and held-out accuracy, on whole small tables."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.llm import chat_format, decontaminate, encoder, language_id, license_scan, near_dedup, packing, quality, sharding, token_codec, url_filter
from featlake.llm.components import components
from featlake.llm.queries import oracle_sql, queries
from featlake.llm.tables import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rec string, row string, key string, kept string, gone string, vslot string, h string, part string"
WORDS = [f"word{i}" for i in range(400)]


def body(start, n, step=1):
    return " ".join(WORDS[(start + i * step) % 400] for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, and extra columns with names that clash."""
    base = body(0, 120)
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("word60", "other"), None, "a"), (4, None, "en", None), (5, "", None, None),
        (6, " \n\t ", "fr", "b"), (7, "one two", "en", "b"), (8, "One  TWO", "en", "b"), (9, body(7, 30_000, 7), "en", "b"), (None, base, "en", "a"), (None, None, None, None),
        (10, "x" * 300_000, "en", "a"), (11, "Licensed under the Apache License, Version 2.0.\n" + body(200, 80, 3), "en", "a"), (12, "1234 5678 !!! ***", "de", "b"), (2, body(100, 90, 5), "en", "a"),
        (13, "ünï çödé\u3000text\u00a0with ^ marks\r\n\ttabs  and <|endoftext|> in it, don't they?", "en", "c"),
    ]
    rows = [(i, t, lang, src, len(t or ""), "r", None, "k", "kept", "g", "v", "h", "p") for i, t, lang, src in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    """Component of each (id, text) row: rows of an id are one document."""
    sets = collections.defaultdict(list)
    for i, t in docs:
        if i is not None:
            sets[i].append(shingle_set(t))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(name, spark, sf, same):
    same(queries()[name](spark, sf), oracle_sql()[name])


# 1: URL rules


def judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = "".join(c.lower() if c.isascii() else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_url_rules_equal_brute_force(spark):
    rules = [("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x/y", "allow"), ("b.a.com", "/", "block"), ("org", "", "block"), ("a.com.", "/", "block"), ("", "/", "allow")]
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/x", "http://a.com/x/y?z", "http://b.a.com/x/y", "http://xa.com/x", "http://c.b.a.com#f", "http://c.b.a.com/#f", "ftp://org", "http://q.org?x=1", "http://a.com./x", "http:///path", "http://u@a.com:80/x", "http://com/" + "p" * 100_000, "x://y://a.com/"]
    pages = spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate(urls * 3)] + [(None, "http://a.com/x", None, None)], "page_id long, url string, host string, rule string").repartition(4)
    got = url_filter.judged(pages, ["page_id", "url", "host"], spark.createDataFrame([*rules, ("a.com", "/x", "block"), (None, "/", "block")], "host string, path string, action string")).collect()
    assert len(got) == 3 * len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(r.rec.url, rules), r.rec.url
    upper = url_filter.judged(pages, ["page_id", "url"], spark.createDataFrame([("A.Com", "/x", "block")], "host string, path string, action string"))
    assert {r.rec.url for r in upper.where("rule = 'a.com/x'").collect()} == {u for u in [*urls, "http://a.com/x"] if u and judge(u, [("a.com", "/x", "block")])[2]}
    none = pages.limit(0)
    assert url_filter.judged(none, ["page_id"], spark.createDataFrame(rules, "host string, path string, action string")).count() == 0
    assert url_filter.judged(pages, ["page_id"], spark.createDataFrame([], "host string, path string, action string")).where("rule is not null").count() == 0


def test_a_hot_long_url_is_cut_into_ranges(spark):
    """Pages of one URL, also one with a long path or host, are in several partitions, and rules of its host reach all of them."""
    rules = spark.createDataFrame([("com", "/", "allow"), ("hot.com", "/p", "block")], "host string, path string, action string")
    for url in ("http://hot.com/p" + "x" * 30, "http://hot.com/p" + "x" * 3000, "http://" + "sub." * 500 + "hot.com/p"):
        pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit(url).alias("url"))
        got = url_filter.judged(pages, ["page_id"], rules)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1800
        assert got.where("verdict = 'block' and rule = 'hot.com/p'").count() == 4000


# 2 and 9: tokens


def check_tokens(rows, docs, name, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encoder.tokenizer_path(name))
    left = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (end,)) for i, t in docs)
    assert collections.Counter((i, tuple(ids)) for i, ids in rows) == left


@pytest.mark.parametrize(("name", "chunks"), [("word_bpe_49k.json", "free"), ("byte_bpe_50k.json", "led")])
def test_marks_behind_any_letter_and_odd_texts(name, chunks):
    """Every letter and digit before a mark, those that the normaliser changes before every mark, and random texts."""
    import random
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = encoder.tokenizer_path(name)
    tok, enc = Tokenizer.from_file(path), encoder.Encoder(path, 2, chunks)
    signs = [c for c in map(chr, range(0x110000)) if c.isalnum()]
    changed = [c for c in signs if unicodedata.normalize("NFC", c.lower()) != c]
    assert len(signs) > 100_000 and len(changed) > 1000
    texts = [" ".join(f"{c}{m}" for c in signs[i : i + 100]) for m in ",-" for i in range(0, len(signs), 100)]
    texts += [" ".join(f"x{c}{m}" for c in changed[i : i + 100]) for m in encoder.TAIL for i in range(0, len(changed), 100)]
    rng = random.Random(5)
    marks = [*"abcXYZ019 \n,.'!^-", *encoder.TAIL, "'s", "\u0301", "\u0338", "\u093c", "\u00a0", "\u3000", "\u0130", "\u03a3", *changed]
    texts += ["".join(rng.choice(marks) if rng.random() < 0.7 else rng.choice(marks[:20]) for _ in range(rng.randint(1, 40))) for _ in range(25_000)]
    for i in range(0, len(texts), 1000):
        want = tok.encode_batch_fast(texts[i : i + 1000], add_special_tokens=False)
        assert [memoryview(x).cast(enc.code).tolist() for x in enc.encode(pa.array(texts[i : i + 1000]))] == [[*w.ids, 2] for w in want]


def test_equal_rows_do_not_meet_in_one_group(spark):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text")).repartition(16)
    rows = packing.packed(docs, "doc_id", "text", encoder.tokenizer_path("word_bpe_49k.json"), 2, "free", per_group=10).collect()
    groups = collections.Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 400 and len(groups) >= 8 and max(groups.values()) <= 200


def test_packing_digest_equals_the_library(spark, sf):
    """ids_crc32 of every piece against the ids of the whole text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encoder.tokenizer_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lengths = collections.Counter()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    for r in packing.query(spark, sf).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(x) for i, x in ids.items()}


def test_ranks_follow_frequency(spark, sf):
    out = new_path(spark, "test")
    token_codec.write_blocks(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", out, encoder.tokenizer_path("byte_bpe_50k.json"), 2, "led")
    rows = spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    assert [(-r.n, r.id) for r in rows] == sorted((-r.n, r.id) for r in rows)


def test_packed_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (1 << 8, 1 << 16, 1 << 24, 1 << 32):
            v = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            assert np.array_equal(token_codec.unpack_values(*token_codec.pack_values(v), n), v)


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_token_files(which, spark, sf, request):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "documents" else request.getfixturevalue(which)
    out = new_path(spark, "test")
    token_codec.write_blocks(docs, "doc_id", "text", out, encoder.tokenizer_path("byte_bpe_50k.json"), 2, "led")
    rows = token_codec.read_blocks(spark, out).orderBy("start").collect()
    check_tokens([(r.doc_id, r.ids) for r in rows], [(r.doc_id, r.text) for r in docs.collect()], "byte_bpe_50k.json", 2)
    assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) for r in rows])][: len(rows)]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)
    digest = {(r.start, r.n_tokens, r.ids_crc32) for r in token_codec.read_digests(spark, out).collect()}
    assert digest == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}


def test_open_windows_take_the_tightest():
    rng = np.random.default_rng(1)
    tree, room = packing.OpenWindows(64), []
    for n in sorted(rng.integers(1, 65, 500).tolist(), reverse=True):
        fit = [r for r in room if r >= n]
        w, at = tree.place(n)
        if fit:
            assert 64 - at == min(fit)
        else:
            assert (w, at) == (len(room), 0)
            room.append(64)
        assert room[w] == 64 - at
        room[w] -= n


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_packing(which, spark, sf, request):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "documents" else request.getfixturevalue(which)
    path = encoder.tokenizer_path("word_bpe_49k.json")
    rows = packing.packed(docs, "doc_id", "text", path, 2, "free").collect()
    pieces = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.start, r.sequence_id)):
        pieces[r.doc_id].append(r)
    texts = collections.Counter(r.doc_id for r in docs.collect())
    whole = [(i, np.frombuffer(b"".join(r.ids for r in p), "<u2").tolist()) for i, p in pieces.items() if texts[i] == 1]
    check_tokens(whole, [(r.doc_id, r.text) for r in docs.collect() if texts[r.doc_id] == 1], "word_bpe_49k.json", 2)
    seqs = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 2 * r.length and r.length <= 4096
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    if which == "documents":
        assert sum(r.length for r in rows) / (4096 * len(seqs)) > 0.97


# 3: near duplicates


def test_components_equal_a_search(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (100, 100), (500, 50), (50, 51)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {**dict.fromkeys(range(31), 0), 100: 100, 200: 100, 500: 50, 50: 50, 51: 50, **dict.fromkeys(range(1000, 1040), 1000)}
    assert {k: v for k, v in got.items() if k not in want} == {} and all(got.get(k, k) == v for k, v in want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_components(docs)
    got = near_dedup.query(spark, sf).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (want[i], len(shingle_set(t)), want[i] == i) for i, t in docs}


def test_links_between_members_of_one_centre(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(140):
        w = [f"w{i}" for i in range(150)]
        for _ in range(rng.integers(0, 6)):
            at, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
            w[at : at + (kind != 1)] = [] if kind == 2 else [f"n{rng.integers(0, 3)}"]
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    want = brute_components(docs)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(set(want.values())) > 1
    assert {r.doc_id: r.component_id for r in got} == want


def test_copies_under_a_foreign_centre_are_not_paired(spark, monkeypatch):
    """Copies of a text that a smaller id resembles: the rows of all intermediate tables grow with the copies, not with their pairs."""
    rng = np.random.default_rng(4)
    shared = [f"c{i}" for i in range(180)]
    rows = {}
    write = near_dedup.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    for n in (100, 200):
        docs = [(0, " ".join(shared + [f"x{i}" for i in range(40)]))]
        for k in range(n):
            w = shared + [f"t{i}" for i in range(40)]
            w[int(rng.integers(0, 220))] = f"n{k}"
            docs.append((k + 1, " ".join(w)))
        got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        want = brute_components(docs)
        assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 2
        assert rows["member-pairs"] <= 3 * n and max(rows.values()) <= near_dedup.BANDS * (n + 1)


def test_near_duplicates_edges(spark, odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    want = brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert {(r.component_id, r.kept, r.n_shingles > 0) for r in got if r.doc_id is None} == {(1, False, True), (None, True, False)}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} | {None}
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


# 4, 8: containment


def test_license_scan_edges(spark, odd, empty):
    templates = spark.createDataFrame([*license_scan.TEMPLATES, ("blank", " "), ("none", None), ("long", body(7, 700, 7))], "license string, text string")
    got = license_scan.scanned(odd, "doc_id", "text", templates).collect()
    assert {(r.doc_id, r.license) for r in got} == {(11, "apache-2.0"), (9, "long")}
    assert {r.n_template for r in got if r.license == "long"} == {400}
    assert license_scan.scanned(empty, "doc_id", "text", templates).count() == 0
    assert license_scan.scanned(odd, "doc_id", "text", templates.limit(0)).count() == 0


def test_few_hashes_are_looked_up_as_bands(spark, sf, odd, monkeypatch):
    """All templates' bands are let through, and of a text's hashes hardly any; with many bands, less than a third."""
    templates = spark.createDataFrame(license_scan.TEMPLATES, "license string, text string")
    long_ones = templates.where(F.length("text") > 90)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    hashes = docs.select(F.explode(license_scan._hashes(F.col("text"))).alias("h"))
    for most, table_of, share in ((2000, templates, 0.01), (0, long_ones, 0.3)):
        monkeypatch.setattr(license_scan, "SET_BANDS", most)
        table = license_scan.template_table(table_of)
        may = license_scan.may_be_band(table)
        assert table.where("kept").where(~may(F.col("h"))).isEmpty()
        assert hashes.where(may(F.col("h"))).count() <= share * hashes.count()
        got = {(r.doc_id, r.license) for r in license_scan.scanned(odd, "doc_id", "text", templates).collect()}
        assert got == {(11, "apache-2.0")}


def test_a_long_license_is_found_whole_only(spark):
    """A text that holds a part of a template, however long, does not hold the template; edits up to the least share do."""
    name, text = next(t for t in license_scan.TEMPLATES if t[0] == "bsd-3-clause-text")
    w = text.split()
    lead = " ".join(WORDS)
    few = [x if i % 29 else "edited" for i, x in enumerate(w)]
    docs = [(1, f"{lead} {text} {lead}"), (2, " ".join(w[: len(w) // 2])), (3, f"{lead} {' '.join(few)}"), (4, " ".join(x if i % 15 else "edited" for i, x in enumerate(w))), (5, f"{text} {lead * 20} {text}"), (5, f"{text} {lead * 20} {text}")]
    templates = spark.createDataFrame([(name, text)], "license string, text string")
    got = collections.Counter(r.doc_id for r in license_scan.scanned(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", templates).collect())
    shingle = lambda t: {tuple(x[i : i + 5]) for x in [re.findall(r"[a-z0-9]+", t.lower())] for i in range(len(x) - 4)}
    want = {i for i, t in docs if len(shingle(t) & shingle(text)) >= 0.8 * len(shingle(text))}
    assert set(got) == want == {1, 3, 5} and got[5] >= 2


def test_sketches_of_long_items_are_small_and_lose_nothing(spark):
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))) for i, n in enumerate([12, 20, 40, 80, 200, 500, 1000] * 3)]
    docs = []
    for i, text in items:
        w = text.split()
        for edits in range(4):  # from whole to about the least share
            kept = list(w)
            for at in rng.choice(len(w), max(0, round(edits * len(w) / 60)), replace=False):
                kept[at] = "edited"
            lead = [f"l{x}" for x in rng.integers(0, 10**6, 3000)]
            docs.append((10 * i + edits, " ".join(lead + kept + lead)))
    item_df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", item_df, "item_id", "text").collect()}
    sets = {i: shingle_set(t) for i, t in items}
    assert got == {(d, d // 10) for d, t in docs if len(sets[d // 10] & shingle_set(t)) >= 0.8 * len(sets[d // 10])}
    table = decontaminate.item_table(item_df, "item_id", "text")
    assert all(r.k == r.n - -(-8 * r.n // 10) + 1 for r in table.groupBy("item_id", "n").agg(F.count_if("kept").alias("k")).collect())
    assert all((r.bound / 2**64 + 0.5) < 0.3 for r in decontaminate.bounds(table).collect() if r.part >= 7)


def test_short_and_long_items_are_found(spark, empty):
    long_text = body(3, 20_000, 11)
    w = long_text.split()
    items = [(i, " ".join(w[100 * i : 100 * i + n])) for i, n in enumerate([5, 6, 9, 15, 30, 60, 120, 300, 600])] + [(90, "absent words of an item here"), (91, None), (92, ""), (None, " ".join(w[:40])), (93, "two words")]
    part = " ".join(w[500:560])
    docs = [(1, long_text), (2, "lead " + part.replace(w[530], "changed") + " tail"), (3, " ".join(w[500:530])), (4, None), (None, part), (5, "TWO words"), (1, long_text)]
    item_df, doc_df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(doc_df, "doc_id", "text", item_df, "item_id", "text").collect()}
    sets = {i: shingle_set(t) for i, t in items if i is not None}
    want = {(d, i) for d, t in docs for i, s in sets.items() if s and len(s & shingle_set(t)) >= 0.8 * len(s)}
    assert got == want and (1, 8) in got and (2, 5) in got and (3, 5) not in got and (None, 5) in got
    clean = decontaminate.keep_clean(doc_df, item_df)
    assert {r.doc_id for r in clean.collect()} == {4}
    assert decontaminate.keep_clean(doc_df, item_df.limit(0)).count() == len(docs)
    assert decontaminate.keep_clean(empty, item_df).count() == 0


def test_a_common_opening_makes_no_candidates(spark, monkeypatch):
    """1000 items and 300 documents with one opening, items made of templates, and documents that hold some."""
    opening = body(0, 14)
    items = [(i, opening + " " + " ".join(f"item{i}x{j}" for j in range(40))) for i in range(1000)]
    templates = [" ".join(f"tem{t}x{j}" for j in range(60)) for t in range(3)]
    items += [(2000 + 40 * t + i, f"{templates[t]} last{i} words{i}") for t in range(3) for i in range(40)]
    docs = [(i, opening + " " + body(20 + i, 60, 3)) for i in range(300)]
    docs += [(400, "lead " + items[7][1]), (401, " ".join(items[9][1].split()[:50])), (402, templates[0]), (403, templates[1] + " last5 words5"), (404, " ".join(templates[2].split()[:30])), (405, " ".join(templates[2].split()[:53]))]
    seen = {}
    monkeypatch.setattr(decontaminate, "written", lambda df, name, keep=decontaminate.written: seen.setdefault(name + str(len(seen)), keep(df, name)))
    args = (spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(*args).collect()}
    sets, texts = {i: shingle_set(t) for i, t in items}, {d: shingle_set(t) for d, t in docs}
    want = {(d, i) for d, s in texts.items() for i, x in sets.items() if len(x & s) >= 0.8 * len(x)}
    assert got == want and (400, 7) in got and {(402, 2000), (403, 2045)} <= got and not any(d == 404 for d, _ in got)
    candidates = [df.count() for name, df in seen.items() if name.startswith("candidates")]
    assert max(candidates) < 1000 and sum(candidates) <= 2 * len(want) + 20


def test_decontamination_edges(spark, odd):
    items = spark.createDataFrame([(1, "one two"), (2, body(0, 20))], "item_id long, text string")
    clean = decontaminate.keep_clean(odd, items)
    assert clean.columns == odd.columns
    assert sorted((r.doc_id for r in clean.collect() if r.doc_id), key=int) == [2, 4, 5, 6, 9, 10, 11, 12, 13]


# 5: chat


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, None, "bob", "first"), (1, 3, None, "who"), (2, 0, "system", "alone"), (None, 0, "cy", "x"), (3, 0, "ann", ""), (3, 0, "ann", ""), (4, 700, "ann", "far" * 50_000)]
    df = spark.createDataFrame([(*r, "c", "m") for r in rows], "conv_id long, turn long, role string, text string, chunk string, mask string")
    got = collections.defaultdict(str)
    for r in chat_format.perspectives(df).orderBy("chunk").collect():
        own = "".join(r.rendered[s.a : s.b] for s in r["mask"])
        got[r.conv_id, r.participant] += own
        assert own.count("<|im_end|>") == len(r["mask"])
    assert got[1, "ann"] == "hi < |im_end|><|im_end|>tie<|im_end|>"
    assert got[1, "bob"] == "first<|im_end|><|im_end|>" and set(got) == {(1, "ann"), (1, "bob"), (None, "cy"), (3, "ann"), (4, "ann")}
    assert got[3, "ann"] == "<|im_end|><|im_end|>" and len(got[4, "ann"]) > 150_000
    assert chat_format.perspectives(df.limit(0)).count() == 0


def test_chunks_are_bounded_by_turns_not_by_turn_numbers(spark):
    """Null and equal turn numbers, and null conversations, are cut into chunks by rank."""
    rows = [(None, None, "ann", f"text {i}") for i in range(300)] + [(1, 5, "bob", f"text {i % 3}") for i in range(200)] + [(2, 10 * i, "cy", f"t{i}") for i in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat_format.perspectives(df).collect()
    size = collections.defaultdict(list)
    for r in got:
        size[r.conv_id].append((r.chunk, r.n_turns))
    assert {k: sorted(v) for k, v in size.items()} == {
        None: [(0, 64), (1, 64), (2, 64), (3, 64), (4, 44)], 1: [(0, 64), (1, 64), (2, 64), (3, 8)], 2: [(0, 64), (1, 64), (2, 2)],
    }
    whole = "".join(r.rendered for r in sorted((r for r in got if r.conv_id is None), key=lambda r: r.chunk))
    assert [x for x in whole.split("\n") if x.startswith("text")] == [f"{x}<|im_end|>" for x in sorted(f"text {i}" for i in range(300))]


# 6: languages


def test_language_accuracy_on_held_out_rows(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in language_id.query(spark, sf).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def brute_vector(text):
    """Sum over letters of the product of the rotated vectors of its trigram, in plain Python integers."""
    out = [0] * language_id.DIM
    s = [c if c.isalpha() else "" for c in text.lower()]
    letters = {c: language_id.letter_vectors(np.array([ord(c) if c else 0]))[0].tolist() for c in set(s) | {""}}
    for i, c in enumerate(s):
        if c:
            before, after = s[i - 1] if i else "", s[i + 1] if i + 1 < len(s) else ""
            for d in range(language_id.DIM):
                out[d] += letters[before][d - 2] * letters[c][d - 1] * letters[after][d]
    return np.array(out, float)


def test_vectors_prototypes_and_cosines_equal_brute_force(spark):
    texts = [("en", "the cat sat on the mat"), ("en", "a dog and the fox"), ("ru", "\u043a\u043e\u0442 \u0441\u0438\u0434\u0438\u0442"), ("zh", "\u6211\u7684\u732b"), ("el", "\u03b7 \u03b3\u03ac\u03c4\u03b1"), ("de", "\u00dc\u00e4\u00f6\u00df stra\u00dfe")]
    asked = ["the fox", "\u0441\u0438\u0434", "\u732b", "\u03b3\u03ac\u03c4\u03b1", "stra\u00dfe", "mixed \u043a\u043e\u0442 cat", "12 34"]
    training = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    langs = sorted({x for x, _ in texts})
    want = {x: sum(brute_vector(t) for l, t in texts if l == x) for x in langs}
    table = language_id.prototypes(training)
    assert {r.lang: r.number for r in table.collect()} == {x: i for i, x in enumerate(langs)}
    for r in table.collect():
        assert np.allclose(np.array(r.v), want[r.lang] / np.linalg.norm(want[r.lang]), atol=1e-5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    for block in (1000, 2):  # all languages at once, and two at a time
        for r in language_id.predicted(docs, table, ["doc_id"], block).collect():
            v = brute_vector(asked[r.rec.doc_id])
            cosines = [(float(v @ want[x]) / np.linalg.norm(v) / np.linalg.norm(want[x]) if v.any() else 0.0) for x in langs]
            best = int(np.argmax(cosines))
            assert (r.lang_pred, r.score) == ((langs[best], pytest.approx(max(0.0, cosines[best]), abs=1e-5)) if v.any() else ("und", 0.0))


def test_letters_of_all_scripts_have_vectors_of_their_own():
    signs = [c for c in range(0x3000) if chr(c).isalpha()]
    vectors = language_id.letter_vectors(np.array(signs)).astype(np.int32)
    dots = vectors @ vectors.T - language_id.DIM * np.eye(len(signs), dtype=np.int32)
    assert np.abs(dots).max() < 0.25 * language_id.DIM


def test_no_language_is_left_out(spark):
    """More languages than a block holds."""
    rng = np.random.default_rng(8)
    texts = [(f"lang{k:03d}", " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(12))) for k in range(70)]
    table = language_id.prototypes(spark.createDataFrame(texts, "lang string, text string"))
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.rec.doc_id: r.lang_pred for r in language_id.predicted(docs, table, ["doc_id"], 16).collect()}
    assert got == {k: f"lang{k:03d}" for k in range(70)}


def test_language_edges(spark, odd, empty):
    table = language_id.prototypes(odd.where("doc_id < 9 or doc_id is null"))
    got = language_id.predicted(odd, table, odd.columns).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r.rec.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language_id.prototypes(empty).count() == 0 and language_id.keep_identified(empty).count() == 0
    assert language_id.keep_identified(odd).columns == odd.columns
    assert language_id.keep_identified(odd.withColumn("lang", F.lit(None).cast("string"))).count() == odd.count()
    none = language_id.predicted(odd, language_id.prototypes(empty), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


# 7: shards


def check_shards(rows, docs, n_shards):
    want = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    assert collections.Counter((r.rec.doc_id, r.rec.text) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert set(places) <= set(range(n_shards)) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards(spark, sf, odd, empty):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd, empty):
        path = new_path(spark, "test")
        check_shards(sharding.write_shards(docs, ["doc_id"], "text", 8, path, 512).collect(), docs, 8)
        assert sharding.load_map(spark, path).count() == 512


def test_rebalancing_writes_a_version_and_moves_edited_slots_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = new_path(spark, "test")
    before = {(r.rec.doc_id): r for r in sharding.write_shards(docs, ["doc_id"], "text", 8, path, 512).collect()}
    files = set(spark.read.parquet(f"{path}/data").inputFiles())
    for version, n in ((2, 9), (3, 8), (4, 9)):
        assert sharding.rebalance(spark, path, n) == version
        rows = sharding.read_shards(spark, path).collect()
        check_shards(rows, docs, n)
        old, new = ({r.vslot: (r.shard, r.since) for r in sharding.load_map(spark, path, v).collect()} for v in (version - 1, version))
        moved = {v for v in old if old[v] != new[v]}
        assert all(new[v][1] == version for v in moved) and len(moved) < 0.25 * len(old)
        assert {v for v in old if old[v][0] != new[v][0]} == moved
        now = set(spark.read.parquet(f"{path}/data").inputFiles())
        assert files <= now and all(f"since={version}" in f for f in now - files)
        files = now
    first = {r.rec.doc_id: (r.shard, r.slot) for r in sharding.read_shards(spark, path, 1).collect()}
    assert first == {i: (r.shard, r.slot) for i, r in before.items()}, "an old version can still be read"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sharding.save_map(spark, path, 2, [])


def test_slots_are_dealt_to_tasks_evenly():
    rng = np.random.default_rng(9)
    sizes = {v: (int(rng.integers(50, 150)), 1) for v in range(4096)}
    mapping = sharding.first_map(sizes, 40, 4096)
    dealt = sharding._dealt(mapping, sizes, 51)
    load, shards = collections.Counter(), collections.defaultdict(set)
    for v, s, task in dealt:
        assert mapping[v] == s
        load[task] += sizes[v][0]
        shards[task].add(s)
    assert set(load) == set(range(51)) and max(load.values()) <= 1.05 * sum(load.values()) / 51
    assert sum(map(len, shards.values())) <= 51 + 40


def test_registered_shards_keep_the_law(spark):
    """40 shards of near-equal bytes, positions without gaps, sizes and checksums of the texts."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sharding.query(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert set(load) == set(range(40)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 40 + max(r["size"] for r in got)


def test_rows_without_an_id_are_spread(spark):
    docs = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")).repartition(12)
    rows = sharding.write_shards(docs, ["doc_id"], "text", 4, new_path(spark, "test"), 64).collect()
    check_shards(rows, docs, 4)
    assert len({r.vslot for r in rows}) > 8 and max(collections.Counter(r.shard for r in rows).values()) < 260


def test_map_edits_move_little_and_balance():
    rng = np.random.default_rng(2)
    sizes = {v: (int(rng.integers(50, 150)), 1) for v in range(4096)}
    total = sum(b for b, _ in sizes.values())
    load = lambda m, n: [sum(sizes[v][0] for v in m if m[v] == s) for s in range(n)]
    old = sharding.first_map(sizes, 40, 4096)
    assert max(load(old, 40)) - min(load(old, 40)) <= 150
    new = sharding.rebalanced(old, sizes, 41)
    moved = [v for v in old if new[v] != old[v]]
    assert {new[v] for v in moved} == {40} and max(load(new, 41)) <= 1.02 * total / 41
    fewer = sharding.rebalanced(old, sizes, 39)
    assert all(new_s == old[v] or old[v] == 39 for v, new_s in fewer.items()) and max(load(fewer, 39)) <= 1.02 * total / 39


# 10: quality


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_quality_counts_equal_brute_force(which, spark, sf, request):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "documents" else request.getfixturevalue(which)
    got = quality.judged(docs, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        want = counts(r.rec.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_drops_junk_and_keeps_clean(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["rec"].doc_id: r for r in quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).collect()}
    assert not [i for i, q in labels.items() if q == 0 and got[i].kept]
    clean = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    assert sum(got[i].kept for i in clean) >= 0.99 * len(clean)


def exact_quantile(values, rank):
    return sorted(values)[max(0, int(np.ceil(rank * len(values) - 1e-9)) - 1)]


def exact_ratios(rows):
    """Ratios from base counts, and the middle lengths, of dicts of which ``base_failed`` tells those that take no part."""
    middle = {c: float(max(exact_quantile([r[c] for r in rows if not r["base_failed"]], 0.5), 1)) for c in quality.LENGTHS}
    ratio = lambda r, name, count, length: r[count] / (r[length] + middle[length] if name in quality.SMOOTHED else max(r[length], 1))
    return [{name: ratio(r, name, *of) for name, of in quality.RATIOS.items()} for r in rows], middle


def exact_fences(rows, middle, tail=quality.TAIL, prior=quality.PRIOR):
    """Fences by exact quantiles, from (lang, source, {ratio: value}) of the documents that pass the base rules."""
    levels = collections.defaultdict(list)
    for lang, source, values in rows:
        for key in ((lang, source), lang, ()):
            levels[key].append(values)

    def ladder(rungs, unit):
        fence = None
        for (p, low), (q, high) in zip(rungs, rungs[1:], strict=False):
            if fence is not None and high > fence:
                break
            fence = high + np.log2((1 - q) / tail) * max((high - low) / np.log2((1 - p) / (1 - q)), unit)
        return fence

    def own(key):
        out = {}
        for name in quality.RATIOS:
            values, unit = [x[name] for x in levels[key]], quality.unit_of(name, middle)
            fence = ladder([(r, exact_quantile(values, r)) for r in quality.RANKS], unit)
            out[f"max_{name}"] = min(fence, quality.MOST_SHARE) if name in quality.SHARES else fence
            if name in quality.LOWER:
                out[f"min_{name}"] = -ladder([(r, -exact_quantile(values, round(1 - r, 4))) for r in quality.RANKS], unit)
        return out

    def drawn(key, parent):
        n = len(levels[key])
        mine = own(key) if n else parent
        return {f: (n * mine[f] + prior * parent[f]) / (n + prior) for f in parent}

    every = own(())
    return lambda lang, source: drawn((lang, source), drawn(lang, every))


def test_quality_verdicts_equal_exact_quantiles(spark, sf):
    """The groups are smaller than a sketch, which then holds all values."""
    got = quality.judged(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 < 2"), ["doc_id"]).collect()
    ratios, middle = exact_ratios([r.asDict() for r in got])
    fences = exact_fences([(r.lang, r.source, x) for r, x in zip(got, ratios, strict=True) if not r.base_failed], middle)
    for r, x in zip(got, ratios, strict=True):
        want = fences(r.lang, r.source)
        assert {n: r[n] for n in quality.RATIOS} == pytest.approx(x)
        assert {f: r[f] for f in quality.FENCES} == pytest.approx(want)
        inside = all(r[n] <= want[f"max_{n}"] for n in quality.RATIOS) and all(r[n] >= want[f"min_{n}"] for n in quality.LOWER)
        assert r.kept == (inside and not r.base_failed)


def ratio_rows(spark, rows, name):
    """Documents that pass the base rules, of one length, with (lang, source, value) of the ratio ``name`` and zero for the others."""
    df = spark.createDataFrame(rows, "lang string, source string, x double")
    return df.select("lang", "source", F.lit(False).alias("base_failed"), *[(F.col("x") if n == name else F.lit(0.0)).alias(n) for n in quality.RATIOS])


def test_a_ratio_moves_its_own_fence_only(spark):
    """Two groups of equal lengths: one with few zeros, one with many. Fences of shares lie inside their range."""
    rows = [("en", "few", (i % 300) / 3000) for i in range(3000)] + [("en", "many", (i % 300) / 3000 if i % 20 == 0 else 0.0) for i in range(3000)]
    for name in quality.RATIOS:
        got = {r.source: r for r in quality.thresholds(ratio_rows(spark, rows, name), {"n_words": 300.0, "n_lines": 30.0}).collect()}
        differ = {f for f in quality.FENCES if got["few"][f] != pytest.approx(got["many"][f])}
        assert differ and {f.split("_", 1)[1] for f in differ} == {name}
        assert all(0 < got[s][f"max_{n}"] < 1 for s in got for n in quality.SHARES)


def test_junk_of_repeated_lines_goes(spark):
    line = lambda i, k: " ".join(WORDS[(i * 37 + k * 11 + j) % 400] for j in range(9))
    clean = [(i, "\n".join(line(i, k) + f" {i} {k}" for k in range(8))) for i in range(300)]
    junk = [(1000 + i, "\n".join([line(i, 0) + " a b c", *[f"{w} {w}x" for w in WORDS[:30]], *["same line"] * 200][: 60 + 100 * (i % 2)])) for i in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in clean + junk], "doc_id long, text string, lang string, source string")
    got = {r.rec.doc_id: r for r in quality.judged(docs, ["doc_id"]).collect()}
    assert all(got[i].kept for i, _ in clean)
    assert all(got[i].dup_line_ratio > got[i].max_dup_line_ratio for i, _ in junk if i % 2)


def test_quality_fences_follow_language_and_source(spark):
    spread = lambda lang, source, top, n: [(lang, source, top * i / n) for i in range(n)]
    rows = spread("en", "prose", 0.01, 3000) + spread("en", "code", 0.4, 3000) + spread("fr", "prose", 0.01, 20) + [("de", "new", 0.0)]
    rows += [("en", "prose", 0.42), ("en", "code", 0.42)]
    df, middle = ratio_rows(spark, rows, "symbol_ratio"), {"n_words": 200.0, "n_lines": 200.0}
    got = {(r.lang, r.source): r.max_symbol_ratio for r in quality.thresholds(df, middle).collect()}
    assert got["en", "prose"] < 0.42 < got["en", "code"], "one document, two verdicts"
    assert got["en", "prose"] < got["fr", "prose"], "a small group is drawn to all"
    assert got["de", "new"] == pytest.approx(got["fr", "prose"], rel=0.4)
    none = quality.thresholds(df.withColumn("base_failed", F.lit(True)), middle).collect()
    assert {r.max_symbol_ratio for r in none} == {None} and len(none) == 4


def test_quality_stage_edges(odd, empty):
    assert quality.keep_good(odd).columns == odd.columns
    assert {r.doc_id for r in quality.keep_good(odd).collect()} >= {1, 2, 3, 11, None}
    assert quality.keep_good(empty).count() == 0


def test_keep_one_keeps_one_row_of_a_repeated_id(spark):
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text.upper()), (1, other), (2, text), (3, None), (3, None), (None, text), (None, text)]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, text.upper()), (1, other), (3, None), (3, None), (None, text), (None, text)], key=str)


# Hot keys: a third of all rows and more are equal.


def test_equal_rows_do_not_make_a_heavy_shard(spark):
    rows = [(i, body(i, 3 + i % 5)) for i in range(2000)] + [(7, body(0, 4))] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.write_shards(docs, ["doc_id"], "text", 40, new_path(spark, "test")).collect()
    check_shards(got, docs, 40)
    load = collections.Counter()
    for r in got:
        load[r.shard] += len((r.rec.text or "").encode()) + 16
    mean = sum(load.values()) / 40
    assert max(load.values()) - mean <= max(0.01 * mean, 100)


def test_rows_without_id_are_many_parts_of_a_token_file(spark):
    docs = spark.range(6000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    docs = docs.union(spark.range(3000).select("id", F.concat(F.lit("text "), "id")))
    out = new_path(spark, "test")
    token_codec.write_blocks(docs, "doc_id", "text", out, encoder.tokenizer_path("byte_bpe_50k.json"), 2, "led")
    parts = [r.n for r in spark.read.parquet(f"{out}/blocks").groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(parts) == 9000 and max(parts) <= 2 * 9000 / len(parts)
    rows = token_codec.read_blocks(spark, out).orderBy("start").collect()
    check_tokens([(r.doc_id, r.ids) for r in rows], [(r.doc_id, r.text) for r in docs.collect()], "byte_bpe_50k.json", 2)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)


def test_repeated_rows_meet_near_copies_once(spark, monkeypatch):
    text = body(0, 200)
    near = [(100 + i, text.replace(f"word{3 + 2 * i}", f"other{i}")) for i in range(50)]
    docs = spark.createDataFrame([(1, text)] * 600 + near + [(100, near[0][1])] * 300, "doc_id long, text string").repartition(4)
    seen = {}
    monkeypatch.setattr(near_dedup, "written", lambda df, name, keep=near_dedup.written: seen.setdefault(name + str(len(seen)), keep(df, name)))
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    want = brute_components([(1, text), *near])
    assert got == {(i, want[i]) for i in want}
    assert [df.count() for name, df in seen.items() if name.startswith("compared")][0] <= 150  # of 51 classes; 45,000 with all rows


def test_texts_of_one_id_are_compared_for_themselves(spark, monkeypatch):
    """A third of all rows have one id and texts of their own: each near copy meets the text that it is like."""
    mine = [(1, body(i * 13, 60, 1 + i % 7) + f" own{i}") for i in range(60)]
    near = [(100 + i, mine[i][1].replace("own", "other")) for i in range(0, 60, 2)]
    rest = [(500 + i, body(i * 5, 40, 11) + f" rest{i} words{i}") for i in range(60)]
    docs = spark.createDataFrame(mine + near + rest, "doc_id long, text string").repartition(4)
    seen = {}
    monkeypatch.setattr(near_dedup, "written", lambda df, name, keep=near_dedup.written: seen.setdefault(name + str(len(seen)), keep(df, name)))
    want = brute_components(mine + near + rest)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == set(want.items())
    assert [df.count() for name, df in seen.items() if name.startswith("compared")][0] < 60 * len(near) / 6  # each near copy with all 60 texts would be 1800
