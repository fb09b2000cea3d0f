"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn by its code point, so letters
of all scripts are told apart; all other signs share one vector. The vector of a
letter trigram is the product of the letters' vectors, permuted (rotated) by
their place; a text's vector is the sum of its trigrams' vectors. A language's
prototype is the sum over its training texts, and a text gets the language with
the largest cosine. All languages are learned; prototypes are a table, and texts
meet LANGS_TOGETHER of them at once.

Defined cases: null text and text without letters give ``und`` with score 0;
rows with null text or lang do not train; ties go to the language first in
order; without training rows every text is ``und``, and the filter keeps all;
very long texts are profiled whole; repeated rows train and are judged each;
extra columns are kept in ``rec``, whatever their names; an empty table gives
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoder import runs
from .tables import written

#: Length of the vectors and seed of the letter vectors.
DIM, SEED = 1024, 11
#: Languages that a text is compared with at once; their vectors are sent to the tasks.
LANGS_TOGETHER = 1000
UND = "und"
#: Rows of trigram vectors, and of letter vectors, a worker keeps.
KEPT_GRAMS, KEPT_LETTERS = 24_000, 8_000
#: Letters below this code point have numbers of their own, by which trigrams are counted in an array.
NEAR, SYMBOLS = 0x100, 64
#: Bits of a code point in the code of a trigram.
BITS = 21
#: Trigrams (of one language) that a worker holds before it hands them on.
HELD_GRAMS = 1 << 20


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """Random +1 and -1, a row for each code point (0 for what is no letter): bits of a hash of code point and place."""
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(SEED, SEED + DIM // 64, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(codes), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


class Profiler:
    """Letters, trigrams and their vectors; one in each worker.

    A trigram's code holds the code points of its letters, 0 for what is none.
    Trigrams of near letters (see NEAR) also have a short code, under which they
    are counted and their vectors kept.
    """

    def __init__(self) -> None:
        self.alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        own = [c for c in range(NEAR) if chr(c).isalpha() and chr(c).lower() == chr(c)]
        self.short = np.zeros(0x110000, np.uint32)
        self.short[self.alpha] = SYMBOLS  # a far letter
        self.short[own] = np.arange(1, len(own) + 1)
        self.code_of = np.zeros(SYMBOLS, np.int64)
        self.code_of[1 : len(own) + 1] = own
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.table = np.zeros((KEPT_GRAMS, DIM), np.int8)
        self.kept = 0
        self.letter_row: dict[int, int] = {}
        self.letters = np.zeros((KEPT_LETTERS, DIM), np.int8)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams around each letter of a text, words being bounded by 0: short codes of those of near letters, codes of the others."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.zeros(len(points) + 2, np.uint32)
        s[1:-1] = self.short[points]
        mid = s[1:-1]
        letter = mid > 0
        if not (mid == SYMBOLS).any():
            return ((s[:-2] * SYMBOLS + mid) * SYMBOLS + s[2:])[letter], np.zeros(0, np.int64)
        near = letter & (s[:-2] < SYMBOLS) & (mid < SYMBOLS) & (s[2:] < SYMBOLS)
        p = np.zeros(len(points) + 2, np.int64)
        p[1:-1] = np.where(self.alpha[points], points, 0)
        far = letter & ~near
        return ((s[:-2] * SYMBOLS + mid) * SYMBOLS + s[2:])[near], ((p[:-2] << 2 * BITS) | (p[1:-1] << BITS) | p[2:])[far]

    def codes(self, short: np.ndarray) -> np.ndarray:
        """Codes of short codes."""
        a, b, c = (self.code_of[x] for x in (short // SYMBOLS**2, short // SYMBOLS % SYMBOLS, short % SYMBOLS))
        return (a << 2 * BITS) | (b << BITS) | c

    def of_letters(self, points: np.ndarray) -> np.ndarray:
        """Vectors of code points, each drawn once as long as there is room for it."""
        distinct, at = np.unique(points, return_inverse=True)
        new = [x for x in distinct.tolist() if x not in self.letter_row]
        if len(self.letter_row) + len(new) > KEPT_LETTERS:
            return letter_vectors(distinct)[at]
        if new:
            rows = range(len(self.letter_row), len(self.letter_row) + len(new))
            self.letters[rows.start : rows.stop] = letter_vectors(np.array(new))
            self.letter_row.update(zip(new, rows, strict=True))
        return self.letters[[self.letter_row[x] for x in distinct.tolist()]][at]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of the trigrams, as rows: the letters' vectors, rotated by their place and multiplied."""
        mask = (1 << BITS) - 1
        out = np.roll(self.of_letters(codes >> 2 * BITS), 2, axis=1)
        out = out * np.roll(self.of_letters(codes >> BITS & mask), 1, axis=1)
        return out * self.of_letters(codes & mask)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each taken ``counts`` times."""
        out = np.zeros(DIM, np.float64)
        for i in range(0, len(codes), 1024):
            out += counts[i : i + 1024].astype(np.float32) @ self.bound(codes[i : i + 1024]).astype(np.float32)
        return out

    def vector(self, text: str) -> np.ndarray | None:
        """The vector of a text; none without letters."""
        near, far = self.grams(text)
        if not len(near) and not len(far):
            return None
        grams, counts = np.unique(near, return_counts=True)
        new = grams[self.row[grams] < 0][: KEPT_GRAMS - self.kept]
        if len(new):
            self.table[self.kept : self.kept + len(new)] = self.bound(self.codes(new))
            self.row[new] = np.arange(self.kept, self.kept + len(new))
            self.kept += len(new)
        out = self.bundle(*np.unique(far, return_counts=True)) if len(far) else np.zeros(DIM, np.float64)
        for i in range(0, len(grams), 1024):
            g, n = grams[i : i + 1024], counts[i : i + 1024].astype(np.float32)
            at = self.row[g]
            has = at >= 0
            if has.all():
                out += n @ self.table[at].astype(np.float32)
            else:
                out += n[has] @ self.table[at[has]].astype(np.float32) + self.bundle(self.codes(g[~has]), n[~has])
        return out


_PROFILER: list[Profiler] = []


def profiler() -> Profiler:
    if not _PROFILER:
        _PROFILER.append(Profiler())
    return _PROFILER[0]


class _Counts:
    """Trigrams of one language in a worker."""

    def __init__(self) -> None:
        self.near = np.zeros(SYMBOLS**3, np.int64)
        self.far: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, near: list[np.ndarray], far: list[np.ndarray]) -> None:
        got = np.bincount(np.concatenate(near))
        self.near[: len(got)] += got
        codes = np.concatenate(far)
        if len(codes):
            self.far.append(np.unique(codes, return_counts=True))

    def held(self) -> int:
        return sum(len(c) for c, _ in self.far)

    def batch(self, lang: str, prof: Profiler) -> pa.RecordBatch:
        at = np.flatnonzero(self.near)
        codes = np.concatenate([prof.codes(at), *[c for c, _ in self.far]])
        counts = np.concatenate([self.near[at], *[n for _, n in self.far]])
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def gram_counts(training: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` over all training rows, summed in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prof = profiler()
        total: dict[str, _Counts] = {}
        for batch in batches:
            for part in runs(batch, "text", 1 << 20, 256):
                by_lang: dict[str, list] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(prof.grams(text))
                for lang, grams in by_lang.items():
                    if lang not in total:
                        if len(total) >= 32:
                            yield from (c.batch(x, prof) for x, c in total.items())
                            total = {}
                        total[lang] = _Counts()
                    total[lang].add([near for near, _ in grams], [far for _, far in grams])
                    if total[lang].held() > HELD_GRAMS:
                        yield total.pop(lang).batch(lang, prof)
        yield from (c.batch(x, prof) for x, c in total.items())

    rows = training.where("text is not null and lang is not null").select("lang", "text")
    return rows.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(training: DataFrame) -> DataFrame:
    """Learned languages: ``lang``, ``number`` (from 0, in order) and ``v``, a vector of length 1. A language without any letter is learned as zeros."""
    counts = written(gram_counts(training), "language-grams")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prof, sums = profiler(), {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM), pa.int32()), pa.array(v, pa.float64())], names=["lang", "d", "v"])
            sums.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            grams, n = np.asarray(batch.column("gram")), np.asarray(batch.column("n"))
            for lang in set(langs.tolist()):
                mine = langs == lang
                sums[lang] = sums.get(lang, 0.0) + prof.bundle(grams[mine], n[mine])
                if len(sums) > LANGS_TOGETHER:
                    yield from flushed()
        yield from flushed()

    rows = counts.select("lang", "gram", "n").mapInArrow(work, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    rows = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "v")))["v"].alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.select("lang", length.alias("length"), "v").select("lang", F.transform("v", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0)).alias("v"))
    # A row per language is numbered, without its vector.
    rows = written(rows, "language-vectors")
    return written(rows.join(rows.select("lang", (F.row_number().over(W.orderBy("lang")) - 1).alias("number")), "lang"), "language-prototypes")


def predicted(docs: DataFrame, learned: DataFrame, keep: list[str], together: int = LANGS_TOGETHER) -> DataFrame:
    """Columns ``keep`` as struct ``rec``, ``lang_pred`` and ``score`` (the cosine, negative ones as 0) of every row.

    ``together`` rows of ``learned`` come to the driver at once. With more
    languages a text's vector is made once and passes through several steps,
    each of which compares it with as many.
    """
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("rec"), docs["text"].alias("text"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["rec"].dataType)
    several = learned.count() > together
    names = ["rec", "lang_pred", "score", "v"]

    def compared(vectors: list[np.ndarray | None], langs: list[str], table: np.ndarray, best: list[tuple[str, float]]) -> list[tuple[str, float]]:
        out = []
        for v, (lang, score) in zip(vectors, best, strict=True):
            if v is not None and langs:
                sims = table @ v.astype(np.float32) / max(float(np.linalg.norm(v)), 1e-9)
                i = int(np.argmax(sims))
                if lang == UND or sims[i] > score:
                    lang, score = langs[i], float(sims[i])
            out.append((lang, score))
        return out

    def batch_of(rec: pa.Array, best: list[tuple[str, float]], vectors: list[np.ndarray | None], last: bool) -> pa.RecordBatch:
        score = [min(1.0, max(0.0, x)) if last else x for _, x in best]
        v = pa.nulls(len(best), pa.binary()) if last else pa.array([x if x is None else x.astype("<f4").tobytes() for x in vectors], pa.binary())
        return pa.RecordBatch.from_arrays([rec, pa.array([x for x, _ in best], pa.string()), pa.array(score, pa.float64()), v], names=names)

    def step(block: int, last: bool):
        chosen = learned.where(F.col("number").between(block * together, (block + 1) * together - 1)).orderBy("number").collect()
        langs, table = [r["lang"] for r in chosen], np.array([r["v"] for r in chosen], np.float32).reshape(len(chosen), DIM)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prof = profiler()
            for batch in batches:
                for part in runs(batch, "text", 1 << 20, 256):
                    vectors = [prof.vector(t) if t and langs else None for t in part.column("text").to_pylist()]
                    yield batch_of(part.column("rec"), compared(vectors, langs, table, [(UND, 0.0)] * len(vectors)), vectors, last)

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = [None if x is None else np.frombuffer(x, "<f4") for x in batch.column("v").to_pylist()]
                best = list(zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True))
                yield batch_of(batch.column("rec"), compared(vectors, langs, table, best), vectors, last)

        return more if block else first

    blocks = -(-learned.count() // together) if several else 1
    for block in range(blocks):
        rows = rows.mapInArrow(step(block, block == blocks - 1), f"rec struct<{fields}>, lang_pred string, score double, v binary")
    return rows.drop("v")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training, by the crc32 of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Below this cosine a text resembles no learned language.
LEAST_SCORE = 0.3


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents that resemble a learned language; those without letters and those below ``least_score`` go."""
    learned = prototypes(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    if learned.isEmpty():
        return docs
    df = predicted(docs, learned, docs.columns)
    return df.where((F.col("lang_pred") != UND) & (F.col("score") >= least_score)).select("rec.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = prototypes(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    df = predicted(docs, learned, ["doc_id"]).select("rec.doc_id", "lang_pred", "score")
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


