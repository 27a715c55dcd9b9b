"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text with everything but letters turned to spaces; a feature's value
is its share of the text's n-grams times its inverse document frequency. Document frequencies cover every training row.
Weights are trained by follow-the-regularised-leader with elastic-net penalties, so most are exactly zero, on a bounded
sample: up to SAMPLE_PER_LANGUAGE different texts of each of the MOST_LANGUAGES languages with the most rows, those that hash lowest. A fifth
of the sample is held back from the training to fit the temperature that calibrates the probabilities.

A text's scores are sums over its n-grams of one table row each, so prediction is one pass without grouping, over whole texts,
in slices of bounded size, a long text in several. Only the frequency vector (N_FEATURES numbers), the sample's features and the model
reach the driver; how many there are is bounded whatever the rows, ids and languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenorlab.llm._common import materialize, read

N_FEATURES, ORDERS = 1 << 16, 3
#: Documented bounds of the training sample: texts of a language, languages.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 500, 64
SCALE, ALPHA, BETA, L1, L2, EPOCHS = 30.0, 0.3, 1.0, 0.002, 0.0005, 3
UNKNOWN = "und"
#: The pipeline keeps a document from this calibrated probability on.
MIN_SCORE = 0.5
#: Characters handled at once.
SLICE = 1 << 20

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Number of the first text and texts of SLICE characters or a little more; a longer text is by itself."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and (size >= SLICE or len(t) > SLICE):
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
        if len(t) > SLICE:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """``_grams`` of the texts; of a single long one, piece by piece."""
    if len(texts) > 1 or len(texts[0]) <= SLICE:
        yield _grams(texts)
        return
    low = texts[0].lower()
    for at in range(0, len(low), SLICE):  # a piece sees the characters that its last n-grams need
        first, end, _, features = _grams([low[at : at + SLICE + ORDERS - 1]])
        end = np.minimum(end, SLICE)
        letters = np.array([sum(map(str.isalpha, low[at : at + SLICE]))])
        yield first, end, letters, features


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First and end position and letter count of each text, and for every order the feature at every position."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(t + "  " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, low), np.int64, len(low))
    first = np.concatenate([[0], np.cumsum(length + 2)[:-1]]).astype(np.int64) if len(low) else np.empty(0, np.int64)
    letter = _is_letter()[code]
    c = np.where(letter, code, 32).astype(np.uint64)
    counts = np.concatenate([[0], np.cumsum(letter)])
    rolled, features = np.zeros(len(c), np.uint64), []
    for n in range(ORDERS):
        ahead = np.concatenate([c[n:], np.full(min(n, len(c)), 32, np.uint64)])
        rolled = (rolled + ahead + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        features.append(((rolled * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64) & (N_FEATURES - 1))
    return first, first + length, counts[first + length] - counts[first], features


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(N_FEATURES, np.int64), np.zeros(N_FEATURES, bool)
    for batch in batches:
        for _, texts in _slices(batch.column(0).to_pylist()):
            for first, end, _, features in _parts(texts):
                for a, b in zip(first, end, strict=True):
                    for f in features:
                        seen[f[a:b]] = True
                    if len(texts) > 1:
                        total += seen
                        seen[:] = False
            if len(texts) == 1:
                total += seen
                seen[:] = False
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "n"])


def _sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            n = np.zeros(N_FEATURES, np.int64)
            for first, end, _, features in _parts([text or ""]):
                for f in features:
                    n += np.bincount(f[first[0] : end[0]], minlength=N_FEATURES)
            at = np.flatnonzero(n)
            rows.append((lang, at.astype(np.int32), (n[at] / max(1, n.sum())).astype(np.float32)))
        yield pd.DataFrame(rows, columns=["lang", "at", "share"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, seed: int = 7) -> np.ndarray:
    """Weights (N_FEATURES x classes) of a multinomial logistic regression; rows: class, feature numbers, values."""
    z, n, w = (np.zeros((N_FEATURES, n_classes)) for _ in range(3))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            y, at, x = rows[k]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = softmax(x @ wi)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * wi
            n[at] = more
    shrunk = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[:] = np.where(np.abs(z) <= L1, 0.0, shrunk)
    return w


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, r = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, train_row: Column) -> dict:
    """A model (langs, table: idf times weights over temperature) learnt from the rows of ``docs`` (text, lang) where ``train_row`` holds.

    Rows without a language or a text teach nothing. Equal texts of one language count once in the sample, so that no text and no id can fill
    it. Of languages with equally many rows those first in order count. Without rows the model knows no language.
    """
    rows = docs.where(train_row & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_docs = sizes.agg(F.sum("n")).first()[0] or 0
    df = np.zeros(N_FEATURES)
    for r in rows.select("text").mapInArrow(_document_frequency, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    different = materialize(hashed.select("lang", "h").distinct(), "texts")
    # about twice the sample passes a threshold on the text's hash first, so that the ranking's input is bounded too
    most = sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang")
    numbers = different.join(F.broadcast(most), "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    part = {r["lang"]: min(1.0, 2 * SAMPLE_PER_LANGUAGE / r["n"]) for r in numbers.collect()}
    share = docs.sparkSession.createDataFrame(sorted(part.items()), "lang string, share double")  # MOST_LANGUAGES rows
    spread = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    few = different.join(F.broadcast(share), "lang").where(spread <= F.col("share"))
    low = Window.partitionBy("lang").orderBy(spread, "h")
    picked = few.withColumn("k", F.row_number().over(low)).where(F.col("k") <= SAMPLE_PER_LANGUAGE).select("lang", "h")
    # at most SAMPLE_PER_LANGUAGE hashes of each of MOST_LANGUAGES languages
    sample = hashed.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("text", "lang")
    got = sample.mapInPandas(_sparse, "lang string, at array<int>, share array<float>").collect()
    got = sorted(got, key=lambda r: (r["lang"], len(r["at"]), r["at"][:20], r["share"][:20]))
    langs = sorted({r["lang"] for r in got})
    number = {x: i for i, x in enumerate(langs)}
    data = [(number[r["lang"]], at := np.array(r["at"], np.int64), np.array(r["share"], float) * idf[at] * SCALE) for r in got]
    mixed = np.random.default_rng(11).permutation(len(data))
    held, used = [data[i] for i in mixed[::5]], [data[i] for j, i in enumerate(mixed) if j % 5]
    if not langs:
        return {"langs": [], "table": np.zeros((N_FEATURES, 0), np.float32)}
    w = train_ftrl(used or held, len(langs))
    t = fit_temperature(np.array([x @ w[at] for _, at, x in held]), np.array([y for y, _, _ in held]))
    return {"langs": langs, "table": (w * (idf * SCALE / t)[:, None]).astype(np.float32), "temperature": t, "n_weights": int(np.count_nonzero(w))}


def predict_texts(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    names, table = model["langs"], model["table"]
    for at, part in _slices(texts) if names else ():
        logits, letters, grams = np.zeros((len(part), len(names))), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for first, end, n, features in _parts(part):
            letters += n
            grams += (end - first) * ORDERS
            for f in features:
                sums = np.zeros((len(f) + 1, len(names)))
                np.cumsum(table[f], axis=0, dtype=np.float64, out=sums[1:])
                logits += sums[end] - sums[first]
        p = softmax(logits / np.maximum(1, grams)[:, None])
        for i in np.flatnonzero(letters):
            langs[at + i], score[at + i] = names[int(p[i].argmax())], p[i].max()
    return langs, np.clip(score, 0.0, 1.0)


def predict(docs: DataFrame, model: dict, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score in the columns ``out``, replacing columns of those names.

    A null text or one without a letter is ``und`` with score 0. Rows may repeat and ids may be null: each row is judged
    by its text alone. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in out]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES rows of one number per language
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", `{out[0]}` string, `{out[1]}` double"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = predict_texts(sent.value, batch.column(kept.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*kept, *out])

    return docs.select(*kept).mapInArrow(label, schema)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score: trained on the rows that are not held out."""
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
