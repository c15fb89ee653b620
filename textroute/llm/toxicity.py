"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what sets toxic text apart. Every
window of a document is compressed with the ordinary dictionary alone and with the toxic one behind it; the
saved bytes are the window's distance. Calibration turns the distances of all windows of a document
into a probability.

Windows are compressed as codes: each character becomes a 32-bit hash of it and the three before it. A passage
that recurs in a dictionary is still a recurring run of bytes, but runs of fewer than four characters, which
any two texts share and which make up most of the noise on short windows, no longer match.

Fitting uses a bounded sample of labelled rows (`SAMPLE` rows a class, near copies once, `FIT_CHARS`
characters together). A half of it calibrates what dictionaries of the other half measure. Scoring reads whole texts.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textroute.llm.decontamination import shingles, word_hashes, words
from textroute.llm.letters import folded, gram_hashes
from textroute.llm.registry import fresh, query, table
from textroute.llm.samples import bounded_sample, held_out

#: Labelled rows a class that are fitted on, and characters that all of them hold together at most.
SAMPLE = 2000
FIT_CHARS = 1 << 24
#: Ordinary windows, in bytes of codes, that the ordinary dictionary is trained on, and the sizes of both dictionaries.
TRAIN_BYTES = 1 << 22
ORDINARY_SIZE = 1 << 17
TOXIC_SIZE = 1 << 15
#: Share of ordinary windows whose distance is taken for noise.
NOISE = 0.999
GRAM = 4
#: Length of the runs by which words of the toxic dictionary are chosen.
MARK = 6
#: Times that one text counts for a run.
BURST = 3
#: Such runs and words are at least so many times as frequent in toxic texts.
LEAN = 10
WINDOW, STEP = 64, 48
LEVEL = 3
THRESHOLD = 0.7


def codes(chars: np.ndarray) -> bytes:
    return gram_hashes(chars, GRAM).astype("<u4").tobytes()


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows over the whole text, at least one."""
    data = codes(folded(text, digits=True))
    return [data[i:i + 4 * WINDOW] for i in range(0, max(1, len(data) - 4 * (WINDOW - STEP)), 4 * STEP)]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    noise: float
    weights: tuple[float, ...]


@lru_cache(maxsize=8)
def _compressors(ordinary: bytes, toxic: bytes):
    import zstandard

    out = []
    for content in (ordinary, ordinary + toxic):
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False,
                                            write_dict_id=False).compress)
    return out


def distances(text: str | None, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    plain, extended = _compressors(ordinary, toxic)
    return np.array([len(plain(w)) - len(extended(w)) for w in windows(text)], float)


def features(d: np.ndarray, noise: float) -> np.ndarray:
    """Of a document's distances: the largest, the sum beyond the noise, and that sum by the number of windows."""
    beyond = np.maximum(d - noise, 0)
    return np.array([1.0, np.log1p(max(0.0, d.max())), np.log1p(beyond.sum()), np.log1p(100 * beyond.sum() / (len(d) + 4))])


def score(text: str | None, model: Model) -> float:
    x = features(distances(text, model.ordinary, model.toxic), model.noise) @ np.array(model.weights)
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _words(text: str) -> list[str]:
    return folded(text, True).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; all samples in a row where there are too few to train on."""
    import zstandard

    whole = b"".join(samples)
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


def _frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct run of `MARK` characters, as a hash, and how often it stands in the texts, `BURST` times each at most."""
    empty, found, counts = np.zeros(0, np.uint32), [], []
    for text in texts:
        grams, n = np.unique(gram_hashes(folded(text, True), MARK), return_counts=True)
        found.append(grams)
        counts.append(np.minimum(n, BURST))
    grams, which = np.unique(np.concatenate([empty, *found]), return_inverse=True)
    return grams, np.bincount(which, np.concatenate([empty, *counts]), len(grams))


def marks(toxic: list[str], ordinary: list[str]) -> np.ndarray:
    """Runs that set toxic texts apart: their log-likelihood ratio is beyond what the best of so many reaches by chance."""
    grams, a = _frequencies(toxic)
    others, counts = _frequencies(ordinary)
    b = np.zeros(len(a))
    _, here, there = np.intersect1d(grams, others, return_indices=True)
    b[here] = counts[there]
    n, m = max(1.0, a.sum()), max(1.0, counts.sum())
    p = (a + b) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in ((a, n * p), (n - a, n * (1 - p)), (b, m * p), (m - b, m * (1 - p))))
    return grams[(a * m > LEAN * b * n) & (a > BURST) & (ratio > 2 * np.log(1 + len(grams)))]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the toxic one: words with a mark, the most frequent last and so nearest."""
    found = marks(toxic, ordinary)
    seen, known = (Counter(w for t in texts for w in _words(t)) for texts in (toxic, ordinary))
    n, m = max(1, seen.total()), max(1, known.total())
    names = sorted(seen)
    chars = np.frombuffer("".join(f" {w} " for w in names).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0, *(len(w) + 2 for w in names)])
    hits = np.flatnonzero(np.isin(gram_hashes(chars, MARK), found))
    chosen = [names[i] for i in np.unique(np.searchsorted(starts, hits, "right") - 1)]
    chosen = sorted((w for w in chosen if seen[w] * m > LEAN * known[w] * n), key=lambda w: (seen[w], w))
    plain = _limited([w for t in ordinary for w in windows(t)], TRAIN_BYTES)
    marked = [codes(folded(w, True)) for w in chosen]
    return _trained(ORDINARY_SIZE, plain) or bytes(8), _trained(TOXIC_SIZE, marked) or bytes(8)


def fit(toxic: list[str], ordinary: list[str], odds: float = 1.0) -> Model:
    """A model from texts of both classes, in an order that doesn't depend on content; `odds` of a toxic document.

    The distances that calibrate a half of the texts come from dictionaries of the other half. Without any toxic or any
    ordinary text, the score is constant: the odds, or 0 or 1 if just one class is there.
    """
    loud, quiet = [], []
    for part in (0, 1):
        base, extra = dictionaries(toxic[1 - part::2], ordinary[1 - part::2])
        loud += [distances(t, base, extra) for t in toxic[part::2]]
        quiet += [distances(t, base, extra) for t in ordinary[part::2]]
    if not loud or not quiet:
        return Model(bytes(8), bytes(8), 0.0, (30.0 if loud else -30.0, 0.0, 0.0, 0.0))
    noise = float(np.quantile(np.concatenate(quiet), NOISE))
    x = np.array([features(d, noise) for d in (*loud, *quiet)])
    y = np.array([1.0] * len(loud) + [0.0] * len(quiet))
    return Model(*dictionaries(toxic, ordinary), noise, tuple(map(float, _logistic(x, y, odds))))


def _limited(samples: list[bytes], size: int) -> list[bytes]:
    """Evenly spread samples of at most `size` bytes together."""
    step = max(1, -(-sum(map(len, samples)) // size))
    return samples[::step]


def _logistic(x: np.ndarray, y: np.ndarray, odds: float, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the classes weigh as `odds`."""
    share = np.where(y == 1, odds / (1 + odds) / y.sum(), 1 / (1 + odds) / (1 - y).sum()) * len(y)
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_texts(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, label: str) -> tuple[list[str], list[str], float]:
    """Toxic and ordinary texts to fit on, and the odds of toxic among all rows that may be learnt from."""
    spark = docs.sparkSession
    marked = (labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("kind"))
              .filter(F.col("id").isNotNull() & F.col("kind").isin(0, 1)).groupBy("id").agg(F.max("kind").alias("kind")).filter(learn))
    sizes = {r["kind"]: r["n"] for r in marked.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    ids = [tuple(r) for r in bounded_sample(marked, "kind", F.col("id"), SAMPLE).collect()]  # at most SAMPLE a class
    if not ids:
        return [], [], 0.0
    chosen = F.broadcast(spark.createDataFrame(ids, marked.schema))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(
        chosen, F.col("doc") == F.col("id")).select("kind", "text", F.xxhash64("doc", "text").alias("code"))
    # Copies share their smallest shingle hash. An id or a text that repeats can't take more than its class's rows.
    grams = rows.select("kind", "text", "code", word_hashes(words(F.col("text"))).alias("w"))
    grams = grams.select("kind", "text", "code", F.coalesce(F.array_min(shingles(F.col("w"), 5)), F.col("code")).alias("copy"))
    once = grams.groupBy("kind", "copy").agg(F.min_by(F.struct("text", "code"), "code").alias("row")).select("kind", "row.*")
    read = bounded_sample(once, "kind", F.col("code"), SAMPLE).orderBy("code").toLocalIterator()
    texts, room = ([], []), FIT_CHARS
    for r in read:
        if len(r["text"]) <= room:
            room -= len(r["text"])
            texts[1 - r["kind"]].append(r["text"])
    return *texts, sizes.get(1, 0) / max(1, sizes.get(0, 0))


def scorer(model: Model):
    """A column function from texts to scores."""
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score(t, model) for t in texts], dtype="float64")
    return scores


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the rows of `docs` that `labels` marks. `learn` is a condition on the column `id`."""
    toxic, ordinary, odds = training_texts(docs, labels, F.lit(True) if learn is None else learn, doc_id, text, label)
    return fit(toxic, ordinary, odds)


def judge(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, score, predicted)` for each row of `docs`.

    A null text counts as empty, and an empty one gets the score of a text with nothing in it. Repeated rows get equal
    scores, null ids are kept, an empty table gives an empty table. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), scorer(model)(F.col(f"`{text}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that a model of the labelled ones doesn't predict to be toxic, with all their columns."""
    model, name = train(docs, labels, doc_id=doc_id, text=text), fresh(docs, "toxicity")
    return docs.withColumn(name, scorer(model)(F.col(f"`{text}`"))).filter(F.col(name) < THRESHOLD).drop(name)


@query("op5_compression_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("id"), 3, 1))
    return judge(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
