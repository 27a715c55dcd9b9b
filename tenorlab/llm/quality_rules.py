"""Quality rules by distribution divergence, in DataFrame operations only.

Each document's character-class histogram and common-word histogram are compared with references per language by the
Jensen-Shannon distance (base 2, 0 to 1), each histogram by itself: in their mean the word histogram, mostly one bin, hides prose full of
symbols. The references are the summed histograms of the corpus's own labelled rows that pass the base rules, so they cover all data;
since junk among these draws them away from clean text, they are summed again over the rows that lie near the first ones. A document is
measured against its nearest language, so a missing or wrong label costs it nothing. The limits come from the spread of
all documents' distances. Texts below a minimum length carry too few counts for a histogram and are judged by the base rules alone.

One pass over the texts makes a small row of counts per document, written to the shared folder; references, limits and verdicts are
computed from those counts. A row per language and the distances' counts by thousandths reach the driver, nothing else.
"""

from __future__ import annotations

from math import log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.llm._common import SPACE_CLASS, drop_table, let, materialize, read

#: Character classes counted in every text, besides white space and the rest.
CLASSES = (r"\p{Lu}+", r"\p{Ll}+", r"\p{Nd}+", r"[.,;:!?'\"()-]+")
#: Common words of four languages.
COMMON = tuple(sorted(set(
    "the of and to in is that for it was".split()
    + "der die und das den von zu mit ist auf".split()
    + "de la le les et des en un une du".split()
    + "el los las y del se una por con que".split()
)))
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Below so many words no histogram is judged.
GUARD_WORDS = 60
#: Distances are compared in so many steps from 0 to 1.
STEPS = 1000
#: First references hold for texts up to the upper quartile and so many times the middle half's width.
FENCE = 3
#: A text fails over the median and so many times the distance from there to the upper quartile, or so many steps if that is more: classes, words.
SPREAD, LEAST_EXCESS = (8, 4), (150, 150)
#: References up to which they stand in the plan; more are a broadcast row.
IN_PLAN = 64
KINDS = ("class", "word")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(words: Column) -> Column:
    """Words in 8-word windows that the text holds twice or more."""
    each = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(x, i, F.lit(WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(let(pairs, places), start, step, lambda a: a["n"])

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(let(each, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns beside every row's base counts and its two histograms (arrays of long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE_CLASS + "+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            let(
                F.filter(w, lambda x: x.isin(*COMMON)),
                lambda c: F.concat(
                    F.array(*[(F.size(c) - F.size(F.array_remove(c, x))).cast("long") for x in COMMON]), F.array((F.size(w) - F.size(c)).cast("long"))
                ),
            ).alias("word_hist"),
        ),
    )
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = docs.select(
        *keep,
        (F.length(text) - _without(text, r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        F.length(text).cast("long").alias("n_all"),
        F.array(*[(F.length(text) - _without(text, c)).cast("long") for c in CLASSES]).alias("classes"),
        of_words.alias("w"),
    )
    spaces = F.array(F.col("n_all") - F.col("w.word_chars"))
    return counted.select(*keep, "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "n_all", F.concat("classes", spaces).alias("class_hist"), "w.word_hist")


def with_rest(hist: Column, total: Column) -> Column:
    """A last bin for what no class counts."""
    return F.concat(hist, F.array(total - F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)))


class Fitted(NamedTuple):
    """What a corpus's texts are judged by: (language, class shares, word shares) and the largest step of each kind's distance; None without texts."""

    known: list[tuple[str, list[float], list[float]]]
    limits: tuple[int | None, int | None]


def references(counts: DataFrame) -> list[tuple[str, list[float], list[float]]]:
    """(language, class shares, word shares) summed over all rows with a language; one row per language reaches the driver."""
    n_class, n_word = len(CLASSES) + 2, len(COMMON) + 1
    sums = [F.sum(F.col("class_hist")[i]).alias(f"c{i}") for i in range(n_class - 1)] + [F.sum("n_all").alias("all")]
    sums += [F.sum(F.col("word_hist")[i]).alias(f"w{i}") for i in range(n_word)]
    out = []
    by = counts.where(F.col("lang").isNotNull()).groupBy("lang").agg(*sums)
    for r in sorted(by.collect(), key=lambda r: r["lang"]):
        c = [r[f"c{i}"] or 0 for i in range(n_class - 1)]
        c.append(max(0, (r["all"] or 0) - sum(c)))
        w = [r[f"w{i}"] or 0 for i in range(n_word)]
        if sum(c) and sum(w):
            out.append((r["lang"], [x / sum(c) for x in c], [x / sum(w) for x in w]))
    return out


def _negated_entropy(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _own(references: list[list[float]]) -> list[float]:
    return [sum(q * log2(q) for q in r if q > 0) for r in references]


def js_distances(hist: Column, references: list[list[float]] | Column) -> Column:
    """Per reference of shares (or of a column: array of structs own, the sum of share times log2 of it, and shares), the square root of its Jensen-Shannon divergence (base 2) from a histogram of counts.

    The divergence is the entropy of the mean less the mean of the entropies. Without counts the distances are null.
    """
    shares = let(F.aggregate(hist, F.lit(0.0), lambda a, n: a + n), lambda total: F.when(total > 0, F.transform(hist, lambda n: n / total)))

    def against(p: Column) -> Column:
        mean = lambda r: _negated_entropy(F.zip_with(p, r, lambda a, q: (a + q) / 2))
        one = lambda h, c, r: F.sqrt(F.greatest((h + c) / 2 - mean(r), F.lit(0.0)))
        if isinstance(references, Column):
            return let(_negated_entropy(p), lambda h: F.transform(references, lambda r: one(h, r["own"], r["shares"])))
        return let(_negated_entropy(p), lambda h: F.array(*[one(h, c, F.array(*map(F.lit, r))) for r, c in zip(references, _own(references), strict=True)]))

    return let(shares, against)


def distances(counts: DataFrame, known: list[tuple[str, list[float], list[float]]]) -> DataFrame:
    """``counts`` with class_distance and word_distance, each to the nearest of the ``known`` references."""
    if not known:
        return counts.withColumns({f"{k}_distance": F.lit(None).cast("double") for k in KINDS})
    against = [c for _, c, _ in known], [w for _, _, w in known]
    rest = []
    if len(known) > IN_PLAN:
        rest = ["_classes", "_words"]
        row = [list(zip(_own(x), x, strict=True)) for x in against]
        kind = "array<struct<own:double,shares:array<double>>>"
        counts = counts.crossJoin(F.broadcast(counts.sparkSession.createDataFrame([row], ", ".join(f"{c} {kind}" for c in rest))))
        against = tuple(F.col(c) for c in rest)
    of_classes = js_distances(with_rest(F.col("class_hist"), F.col("n_all")), against[0])
    nearest = {"class_distance": F.array_min(of_classes), "word_distance": F.array_min(js_distances(F.col("word_hist"), against[1]))}
    return counts.withColumns(nearest).drop(*rest)


def step(kind: str) -> Column:
    return F.floor(F.col(f"{kind}_distance") * STEPS)


def quartiles(judged: DataFrame, kind: str) -> tuple[int, int, int] | None:
    """Of the steps of a distance over all rows; a row per step reaches the driver."""
    by = sorted((r["step"], r["n"]) for r in judged.select(step(kind).alias("step")).where("step IS NOT NULL").groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect())
    total, out = sum(n for _, n in by), []
    for part in (1, 2, 3):
        below = 0
        for at, n in by:
            below += n
            if 4 * below >= part * total:
                out.append(at)
                break
    return tuple(out) if by else None


def fit(counts: DataFrame) -> Fitted:
    """References and limits from the texts that pass the base rules; limits from those of GUARD_WORDS words or more."""
    passed = counts.where(~base_failed())
    first = references(passed)
    judged = distances(passed.where(F.col("n_words") >= GUARD_WORDS), first)
    core = judged
    for kind in KINDS:
        if q := quartiles(judged, kind):
            core = core.where(step(kind) <= q[2] + FENCE * (q[2] - q[0]))
    near = {x[0]: x for x in references(core)}
    known = [near.get(x[0], x) for x in first]
    again = distances(passed.where(F.col("n_words") >= GUARD_WORDS), known)
    limits = []
    for kind, spread, least in zip(KINDS, SPREAD, LEAST_EXCESS, strict=True):
        q = quartiles(again, kind)
        limits.append(q and q[1] + max(spread * (q[2] - q[1]), least))
    return Fitted(known, tuple(limits))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(counts: DataFrame, fitted: Fitted) -> DataFrame:
    """``counts`` with base_failed, class_distance, word_distance and kept."""
    far = F.lit(False)
    for kind, limit in zip(KINDS, fitted.limits, strict=True):
        if limit is not None:
            far = far | F.coalesce(step(kind) > limit, F.lit(False))
    return distances(counts, fitted.known).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~((F.col("n_words") >= GUARD_WORDS) & far))


def apply_rules(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` (key, text, lang): counts, base_failed, class_distance, word_distance, kept.

    A null or empty text has no words and fails the base rules. A null language adds nothing to the references and is
    judged like any other. Without any labelled text there is no reference and the base rules decide. Repeated rows
    are judged alike; equal distances share a verdict; other columns are ignored; an empty table gives an empty result.
    """
    counts = materialize(text_counts(docs, key, "lang"), "quality")
    return judge(counts, fit(counts))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang and any others) that the rules keep, with their columns.

    Texts are counted once. A verdict is the text's alone, so the rejected texts' hashes (128 bits) are written to the shared folder and rows that
    have one go; no text is stored. Nulls, empty texts, repeated rows and an empty table are as in ``apply_rules``; names of columns are free.
    """
    hashes = (F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7919), "text").alias("h2"))
    counts = materialize(text_counts(docs.select(*hashes, "text", "lang"), "h1", "h2", "lang"), "quality")
    gone = materialize(judge(counts, fit(counts)).where("NOT kept").select("h1", "h2").distinct(), "rejected")
    drop_table(counts)
    return docs.select(*hashes, F.struct(*docs.columns).alias("row")).join(gone, ["h1", "h2"], "left_anti").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[F.round(f"{k}_distance", 6).alias(f"{k}_distance") for k in KINDS],
    )
