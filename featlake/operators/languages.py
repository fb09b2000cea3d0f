"""Languages by ranks of character trigrams, learned from labelled rows.

A profile is the TOP most frequent trigrams of a language, in order. A text's own
most frequent trigrams are compared with each profile: the mean distance of
ranks, where a trigram that the profile lacks is TOP apart. The nearest language
is the text's, unless it is farther than ``limit``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Trigrams of a profile and of a text that are compared.
TOP = 300
#: The share of TOP from which on no language is near enough.
LIMIT = 0.85
UNKNOWN = "unknown"
#: Trigrams that a task counts before it gives out what it has.
HELD = 500_000
_BLANK = 32


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """Trigrams of the words in lower case, with a blank before and behind each word, as numbers that are ordered like them; an array for each ``piece`` signs or so."""
    text = (text or "").lower()
    start = 0
    while start < len(text):
        end = text.find(" ", start + piece)
        end = len(text) if end < 0 else end
        points = np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        # Of what stands between two words the first sign is kept, as a blank.
        keep = letter | np.append(False, letter[:-1])
        signs = np.concatenate([[_BLANK], np.where(letter, points, _BLANK)[keep], [_BLANK] if len(letter) and letter[-1] else []]).astype(np.uint64)
        grams = (signs[:-2] << np.uint64(42)) | (signs[1:-1] << np.uint64(21)) | signs[2:]
        yield grams[signs[1:-1] != _BLANK]
        start = end


def _counted(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(arrays) if arrays else np.zeros(0, np.uint64), return_counts=True)


def _as_text(gram: int) -> str:
    return "".join(chr(gram >> k & 0x1FFFFF) for k in (42, 21, 0))


def _as_number(gram: str) -> int:
    return sum(ord(c) << k for c, k in zip(gram, (42, 21, 0), strict=True))


def learn_profiles(df: DataFrame, text: str, lang: str, top: int = TOP) -> DataFrame:
    """``lang``, ``gram`` and ``rank`` (from 0), of rows with a language; trigrams are counted in every task before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, arrays in found.items():
                grams, n = _counted(arrays)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array([_as_text(g) for g in grams.tolist()], pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            found.clear()

        for batch in batches:
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for grams in trigrams(value):
                    found.setdefault(name, []).append(grams)
                    size += len(grams)
                    if size > 8 * HELD:
                        yield from out()
                        size = 0
        yield from out()

    rows = df.select(df[lang].cast("string").alias("lang"), df[text].alias("text")).where("lang is not null")
    counts = rows.mapInArrow(work, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


def text_language(df: DataFrame, text: str, profiles: DataFrame, limit: float = LIMIT, top: int = TOP) -> DataFrame:
    """``df`` with ``language`` and ``distance`` (0 to 1) of every row; no letters, or none near enough, is ``unknown``.

    The driver and each task hold the profiles: ``top`` rows of each language.
    """
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    known = np.array(sorted({_as_number(r["gram"]) for r in rows}), np.uint64)
    ranks = np.full((len(known) + 1, len(langs)), -1, np.int64)  # the last row is of trigrams that no language has
    for r in rows:
        ranks[np.searchsorted(known, np.uint64(_as_number(r["gram"]))), langs.index(r["lang"])] = r["rank"]

    def judge(value: str | None) -> tuple[str, float]:
        grams, n = _counted(list(trigrams(value)))
        own = grams[np.lexsort((grams, -n))[:top]]
        if not len(own) or not langs:
            return UNKNOWN, 1.0
        at = np.searchsorted(known, own)
        at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own), at, len(known))
        theirs = ranks[at]
        apart = np.where(theirs < 0, top, np.minimum(np.abs(theirs - np.arange(len(own))[:, None]), top)).sum(axis=0)
        best = int(apart.argmin())
        distance = float(apart[best]) / (top * len(own))
        return (langs[best] if distance <= limit else UNKNOWN), distance

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], names=["rec", "language", "distance"])

    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rec"), df[text].alias("text"))
    out = packed.mapInArrow(work, f"rec {packed.schema['rec'].dataType.simpleString()}, language string, distance double")
    return out.select("rec.*", "language", "distance")
