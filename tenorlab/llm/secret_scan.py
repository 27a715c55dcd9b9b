"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are cut from every whole text by built-in regular expressions: splitting at a pattern gives the text between its
matches, and the lengths of those pieces and of the matches give every match's code-point span. The hash of each candidate's
value is then counted over the corpus by distinct owners and repositories. A value that many owners or many repositories share is a widely
copied example; one that stays with few of both and looks random is a live-looking credential; what is left are weak values, such
as placeholders. Generic random-looking tokens are reported only where one owner alone has them, in few repositories; the base kinds
are always reported.

The counts are distinct (value, owner, repository) rows first, so a value held by a third of all rows shrinks to its owners
before it is counted, and the join that carries counts back is an equi-join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.llm._common import let, materialize, read

#: Kind, pattern, group of the value, least length of that group.
KINDS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The method's own candidates: long tokens that mix lower case, upper case and digits.
GENERIC = ("generic", r"[A-Za-z0-9_+/-]{24,}", 0, 24)
#: A value seen with at least so many owners, or in at least so many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 4
#: A value of fewer different characters, or without a digit, mixed case or so many different characters, is not random; nor is a placeholder.
LEAST_DISTINCT, DISTINCT_LETTERS = 6, 12
PLACEHOLDER = r"(?i)example|change_?me|placeholder|dummy|redacted|your[_-]|xxxx|password|secret"
SPAN = "array<struct<start:bigint,ord:int,kind:string,stop:bigint,value:string>>"


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """All matches of one kind with their spans, failing ones dropped."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("all"), F.regexp_extract_all(text, p, F.lit(group)).alias("value")
    )
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        one = F.struct(
            start.cast("bigint").alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.cast("bigint").alias("stop"), x["value"].alias("value")
        )
        more = F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.cast("bigint").alias("at"), more.alias("out"))

    found = F.aggregate(F.filter(zipped, lambda x: x["all"].isNotNull()), empty, step, lambda acc: acc["out"])
    # most texts hold none: one cheap search settles them
    screen = f"[0-9a-f]{{{least}}}" if kind == "hex" else pattern
    return F.when(text.rlike(screen), found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def candidates(docs: DataFrame, owner: Column, repository: Column, rid: Column | None = None) -> DataFrame:
    """rid, doc_id, owner, repository, spans (sorted by start, then kind as listed) for every row; rid: names a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[_spans(text, k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS)])
    live = F.filter(
        _spans(text, GENERIC[0], len(KINDS), *GENERIC[1:]),
        lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]"),
    )
    # a generic token inside a base span is that span
    own = let(base, lambda b: F.concat(b, F.filter(live, lambda g: ~F.exists(b, lambda s: (s["start"] < g["stop"]) & (g["start"] < s["stop"])))))
    return docs.select(
        (F.monotonically_increasing_id() if rid is None else rid).alias("rid"), F.col("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
        F.array_sort(own).alias("spans"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repositories over all candidates; a null owner or repository counts as one of its own."""
    each = found.select("owner", "repository", F.explode("spans").alias("s")).select(F.sha2("s.value", 256).alias("value_hash"), "owner", "repository")
    pairs = each.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.sum("one").alias("repos"))
    return owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repositories"))


def looks_random(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    mixed = value.rlike("[0-9]") | (value.rlike("[a-z]") & value.rlike("[A-Z]")) | (distinct >= DISTINCT_LETTERS)
    return (distinct >= LEAST_DISTINCT) & mixed & ~value.rlike(PLACEHOLDER)


def classify(found: DataFrame) -> DataFrame:
    """rid and its kept spans with n_owners, n_repositories, example and live; only rows of ``candidates`` that have any.

    A span of several kinds counts once for each. Values are compared by hash, so equal ones share a verdict wherever they stand.
    """
    each = found.select("rid", F.explode("spans").alias("s")).withColumn("value_hash", F.sha2("s.value", 256))
    counted = each.join(ownership(found), "value_hash")
    counted = counted.withColumn("example", (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES))
    live = ~F.col("example") & looks_random(F.col("s.value"))
    return (
        counted.where((F.col("s.ord") < len(KINDS)) | ((F.col("n_owners") == 1) & live))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("s.start", "s.ord", "s.kind", "s.stop", "n_owners", "n_repositories", "example", live.alias("live")))).alias("kept"))
    )


def scan_secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per row of ``docs``, with ``kept`` spans beside the digest columns.

    A null or empty text has no spans. Repeated rows each keep their own result; a null doc_id, owner or repository is a
    value like any other. Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    found = materialize(candidates(docs, owner, repository), "secrets")
    kinds = {k: i for i, (k, *_) in enumerate(KINDS)}
    base = F.filter("spans", lambda s: s["ord"] < len(KINDS))
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == kinds[k])).cast("long").alias(f"n_{k}")
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,kind:string,stop:bigint,n_owners:bigint,n_repositories:bigint,example:boolean,live:boolean>>)")
    kept = F.coalesce("kept", none)
    return found.join(classify(found), "rid", "left").select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(say(base), 256).alias("base_sha256"), say(kept).alias("spans"),
        F.size(F.filter(kept, lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter(kept, lambda s: s["example"])).cast("long").alias("n_example"),
        kept.alias("kept"),
    )


def redact(docs: DataFrame, owner: Column, repository: Column, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking span masked; overlapping spans are masked as one; other rows are untouched.

    A null or empty text stays as it is, repeated rows are masked alike, a null owner or repository is a value like any other, names of
    columns are free and an empty table stays empty.
    """
    kept = docs.select(F.struct(*docs.columns).alias("row"), owner.alias("owner"), repository.alias("repository"), F.monotonically_increasing_id().alias("rid"))
    kept = materialize(kept, "secret-docs")
    read_back = kept.select("rid", "owner", "repository", F.col("row.text").alias("text"), F.col("rid").alias("doc_id"))
    cand = materialize(candidates(read_back, F.col("owner"), F.col("repository"), F.col("rid")), "secrets")
    live = classify(cand).select("rid", F.filter("kept", lambda s: s["live"]).alias("live")).where(F.size("live") > 0)
    text = F.col("row.text")

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).cast("bigint").alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    end = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    masked = F.when(F.col("live").isNotNull(), F.aggregate("live", start, cut, end)).otherwise(text)
    return kept.join(live, "rid", "left").select(*[masked.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources; a repository is a source's part in one language."""
    docs = read(spark, sf_dir, "documents")
    return scan_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang")).drop("kept")
