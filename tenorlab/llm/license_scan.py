"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined to the k-gram positions of the license templates. A hit at
document word d and template word t votes for the offset diagonal d - t; votes are summed per (document, template,
diagonal), diagonals that lie close together are merged (a few words inserted or dropped shift the offset), and a merged
span counts when it covers enough of the template within a span of about the template's length.

The templates are a fixed list, so the broadcast side never grows with the data. Each text is read once: its base places and those of
its grams that occur in any template are written to the shared folder under a number of the row, so rows of one doc_id, or of none, are
scanned each by itself. Votes are aggregated within a row's own hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenorlab.llm._common import let, materialize, read
from tenorlab.llm.license_texts import TEXTS as TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
K = 4
#: Diagonals this near belong to one span; a span must cover this share of its template, within so many template lengths.
MERGE, MIN_COVER, MAX_STRETCH = 3, 0.6, 1.6


def lowered(text: Column) -> Column:
    """A-Z to a-z as far as words are compared with ASCII ones: of all other letters only the Kelvin sign has an ASCII lower case, so it is put aside."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def gram_hashes(words: Column, k: int = K) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(k)))))


def _places(words: Column, parts: list[str], label: str) -> Column:
    n = len(parts)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    found = F.filter(starts, lambda i: F.slice(words, i, F.lit(n)) == F.array(*map(F.lit, parts)))
    return F.transform(found, lambda i: F.struct((i - 1).cast("long").alias("at"), F.lit(label).alias("label")))


def _base(words: Column) -> Column:
    """Struct of n_base, first_word, last_word, base_labels from one text's words."""
    places = [_places(words, phrase.split(), label) for phrase, label in PHRASES]
    return let(
        F.concat(*places),
        lambda p: F.struct(
            F.size(p).cast("long").alias("n_base"),
            F.array_min(p["at"]).alias("first_word"),
            F.array_max(p["at"]).alias("last_word"),
            F.array_sort(F.array_distinct(p["label"])).alias("base"),
        ),
    )


NO_BASE = "named_struct('n_base', 0L, 'first_word', cast(null as bigint), 'last_word', cast(null as bigint), 'base', cast(array() as array<string>))"


def template_grams(spark: SparkSession, templates: dict[str, str], k: int = K) -> DataFrame:
    """license, t_len, t, h: every gram of every template."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    w = rows.select("license", words_of(F.col("body")).alias("w"))
    return w.select("license", F.size("w").alias("t_len"), F.posexplode(gram_hashes(F.col("w"), k)).alias("t", "h"))


def scan_rows(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """rid, doc_id, n_words, base places and hits (d, h: the grams that occur in a template), one row per row of ``docs``, written out."""
    hashes = [r["h"] for r in template_grams(docs.sparkSession, templates, k).select("h").distinct().collect()]  # of a fixed list
    numbered = lambda h: F.transform(h, lambda x, i: F.struct(i.alias("d"), x.alias("h")))
    hits = lambda w: F.filter(numbered(gram_hashes(w, k)), lambda x: x["h"].isin(hashes))
    base = lambda w: F.when((F.size(w) > 1) & F.array_contains(w, "license"), _base(w))
    found = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.coalesce(base(w), F.expr(NO_BASE)).alias("b"), hits(w).alias("hits")))
    each = docs.select("doc_id", found.alias("f")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "f.n_words", "f.b.*", "f.hits")
    return materialize(each, "licenses")


def diagonal_spans(scanned: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans of ``scan_rows``: rid, license, start, end (words, end exclusive), votes, coverage."""
    grams = scanned.select("rid", F.explode("hits").alias("g")).select("rid", "g.d", "g.h")
    hits = grams.join(F.broadcast(template_grams(scanned.sparkSession, templates, k)), "h")
    votes = hits.groupBy("rid", "license", "t_len", (F.col("d") - F.col("t")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.collect_set("t").alias("ts")
    )
    order = Window.partitionBy("rid", "license").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(order)) > MERGE
    merged = (
        votes.withColumn("run", F.sum(F.when(far, 1).otherwise(0)).over(order))
        .groupBy("rid", "license", "t_len", "run")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("start"), (F.max("hi") + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (k - 1))))))
    return (
        merged.withColumn("coverage", covered / F.col("t_len"))
        .where((F.col("coverage") >= MIN_COVER) & (F.col("end") - F.col("start") <= MAX_STRETCH * F.col("t_len")))
        .select("rid", "license", "start", "end", "votes", "coverage")
    )


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no words, no labels and score 0. Rows that share a doc_id, and rows without one, are scanned each by its own
    text. A gram that several templates hold votes for each of them. An empty table gives an empty result.
    """
    scanned = scan_rows(docs, templates)
    found = diagonal_spans(scanned, templates).groupBy("rid").agg(F.collect_set("license").alias("more"), F.max("coverage").alias("coverage"), F.count(F.lit(1)).alias("n_spans"))
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    return scanned.join(found, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
