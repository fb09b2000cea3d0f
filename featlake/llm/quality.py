"""Quality rules with adaptive thresholds.

Per-document counts are made with built-in functions. A ratio of a count to a
length is smoothed by the middle length of all documents, (count) / (length +
middle), so that one symbol or line of a short document weighs little. KLL
sketches of the ratios are built per (lang, source) and merged upwards to lang
and to all. A fence follows from a ladder of quantiles (RANKS) of the ratio: from
the median and upper quartile on, a pair of rungs gives the distance over which
the tail halves (at least UNIT counts of a document of middle length), and the
fence lies where a share TAIL would be left. As long as the next rung lies inside the
fence of those below it, it belongs to the same tail, and the fence is drawn from
it; a rung outside is junk, and neither it nor those above it take part. Fences
of shares are at most MOST_SHARE. A group's fence is drawn to its language's, and
that to the fence of all, by the number of documents: (n * own + PRIOR * parent)
/ (n + PRIOR). A document is kept if no base rule fails and no ratio lies beyond
a fence.

Quantiles up to the upper quartile always take part, so fences hold while less
than a quarter of a group is junk.

Defined cases: null or blank text has no words, fails the base rule and goes;
null lang or source is a group of its own; a group without a document that
passes the base rules has its language's fences, such a language those of all;
without any such document only base rules act; very long texts are counted
whole; extra columns, also with names of ours, are kept as they are; repeated
rows are judged each; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import broadcast_if_small, let, words, written

#: Ratio -> (count, length); all but the mean word length are smoothed.
RATIOS = {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "mean_word_chars": ("word_chars", "n_words")}
SMOOTHED = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")
#: Ratios of a part to its whole.
SHARES = ("dup_line_ratio", "repeat_ratio")
MOST_SHARE = 0.75
#: Ratios that have a lower fence as well.
LOWER = ("mean_word_chars",)
LENGTHS = ("n_words", "n_lines")
RANKS = (0.5, 0.75, 0.9, 0.95, 0.99)
#: Share of a group's documents beyond a fence if its tail halves as stated.
TAIL = 1e-4
#: Counts over which a tail halves at least, in a document of middle length.
UNIT = 1.0
#: Documents of the group that weigh as much as the fence of the level above.
PRIOR = 100
#: Sketch size; the rank error of a quantile is about 1 %.
SKETCH_K = 400
#: Fences of a group.
FENCES = (*[f"max_{n}" for n in RATIOS], *[f"min_{n}" for n in LOWER])


def _repeat_words(tokens: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more."""

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            hit = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            places = F.sort_array(F.transform(hit, lambda x: x["p"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of_sorted))

    def windows(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(h, covered))

    return let(tokens, windows)


def counts(text: Column) -> Column:
    """Struct of the base counts of one text, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"))


def scored(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` as struct ``rec`` (so no name can clash), language, source, the base counts and ``base_failed``."""
    df = docs.select(F.struct(*[docs[c] for c in keep]).alias("rec"), docs["lang"].alias("lang"), docs["source"].alias("source"), counts(docs["text"]).alias("c"))
    df = df.select("rec", "lang", "source", "c.w.*", "c.l.*")
    n = F.col("n_words")
    return df.withColumn("base_failed", (n < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * n))


def middle_lengths(scores: DataFrame) -> dict[str, float]:
    """The median of each length over the documents that pass the base rules, at least 1."""
    sound = scores.where(~F.col("base_failed"))
    row = sound.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in LENGTHS]).first()
    return {c: float(max(row[c] or 1, 1)) for c in LENGTHS}


def with_ratios(scores: DataFrame, middle: dict[str, float]) -> DataFrame:
    ratio = lambda name, count, length: F.col(count) / (F.col(length) + middle[length] if name in SMOOTHED else F.greatest(F.col(length), F.lit(1)))
    return scores.select("*", *[ratio(name, *of).cast("double").alias(name) for name, of in RATIOS.items()])


def unit_of(name: str, middle: dict[str, float]) -> float:
    """UNIT counts of a document of middle length."""
    length = middle[RATIOS[name][1]]
    return UNIT / (2 * length if name in SMOOTHED else length)


def _ladder(q: Column, unit: float, tail: float) -> Column:
    """The fence of a rising ladder of quantiles at RANKS."""
    rungs = [F.struct(F.lit(i).alias("i"), F.lit(math.log2((1 - lo) / (1 - hi))).alias("halvings"), F.lit(math.log2((1 - hi) / tail)).alias("left")) for i, (lo, hi) in enumerate(zip(RANKS, RANKS[1:], strict=False))]

    def of(q: Column) -> Column:
        def step(a: Column, r: Column) -> Column:
            low, high = F.get(q, r["i"]), F.get(q, r["i"] + 1)
            inside = a["inside"] & ((r["i"] == 0) | (high <= a["fence"]))
            fence = high + r["left"] * F.greatest((high - low) / r["halvings"], F.lit(unit))
            return F.struct(F.when(inside, fence).otherwise(a["fence"]).alias("fence"), inside.alias("inside"))

        return F.aggregate(F.array(*rungs), F.struct(F.lit(0.0).alias("fence"), F.lit(True).alias("inside")), step, lambda a: a["fence"])

    return let(q, of)


def _fences(sketches: DataFrame, keys: list[str], level: str, tail: float, middle: dict[str, float]) -> DataFrame:
    """Keys as ``<level>_<key>``, the number of documents as ``<level>_n`` and the level's own fences, from a row of sketches each."""
    quantiles = lambda name, ranks: F.expr(f"kll_sketch_get_quantile_double({name}, array({', '.join(f'{r}D' for r in ranks)}))")
    out = [F.col(k).alias(f"{level}_{k}") for k in keys]
    out.append(F.expr("kll_sketch_get_n_double(symbol_ratio)").alias(f"{level}_n"))
    for name in RATIOS:
        unit = unit_of(name, middle)
        fence = _ladder(quantiles(name, RANKS), unit, tail)
        out.append((F.least(fence, F.lit(MOST_SHARE)) if name in SHARES else fence).alias(f"{level}_max_{name}"))
        if name in LOWER:
            mirrored = F.transform(quantiles(name, [round(1 - r, 4) for r in RANKS]), lambda x: -x)
            out.append((-_ladder(mirrored, unit, tail)).alias(f"{level}_min_{name}"))
    return sketches.select(*out)


def thresholds(scores: DataFrame, middle: dict[str, float], tail: float = TAIL, prior: float = PRIOR) -> DataFrame:
    """One row per (lang, source) with FENCES; null where no document passes the base rules.

    Only documents that pass the base rules enter the sketches. The sketches of
    (lang, source) are merged for a language and for all documents, so the
    documents are read once.
    """
    measured = [*RATIOS]
    sketch = scores.where(~F.col("base_failed")).groupBy("lang", "source").agg(
        *[F.expr(f"kll_sketch_agg_double(cast({name} as double), {SKETCH_K})").alias(name) for name in measured]
    )
    groups = scores.select("lang", "source").distinct()
    sketch = written(sketch, "quality-sketches")
    merge = [F.expr(f"kll_merge_agg_double({name})").alias(name) for name in measured]
    own = _fences(sketch, ["lang", "source"], "own", tail, middle)
    lang = _fences(sketch.groupBy("lang").agg(*merge), ["lang"], "any", tail, middle)
    every = _fences(sketch.agg(*merge).where("kll_sketch_get_n_double(symbol_ratio) > 0"), [], "all", tail, middle)
    df = groups.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
    df = df.join(lang, F.col("lang").eqNullSafe(F.col("any_lang")), "left").join(F.broadcast(every), F.lit(True), "left")

    def drawn(level: str, name: str, parent: Column) -> Column:
        n = F.col(f"{level}_n")
        return F.coalesce((n * F.col(f"{level}_{name}") + prior * parent) / (n + prior), parent)

    return df.select("lang", "source", *[drawn("own", f, drawn("any", f, F.col(f"all_{f}"))).alias(f) for f in FENCES])


def judged(docs: DataFrame, keep: list[str], tail: float = TAIL, prior: float = PRIOR) -> DataFrame:
    """``scored`` plus the group's fences and ``kept``; the texts are analysed once, then read from a written table."""
    scores = written(scored(docs, keep), "quality-scores")
    middle = middle_lengths(scores)
    scores = with_ratios(scores, middle)
    fence = broadcast_if_small(written(thresholds(scores, middle, tail, prior), "quality-fences"))
    fence = fence.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *FENCES)
    df = scores.join(fence, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_lang", "f_source")
    beyond = F.lit(False)
    for name in RATIOS:
        beyond = beyond | F.coalesce(F.col(name) > F.col(f"max_{name}"), F.lit(False))
    for name in LOWER:
        beyond = beyond | F.coalesce(F.col(name) < F.col(f"min_{name}"), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~beyond)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs, docs.columns).where("kept").select("rec.*")
