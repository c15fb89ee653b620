"""Language identification in two steps: the family, then the language within it.

A document is a vector of its character runs (one to four letters, hashed). A softmax model tells the families
apart; within a family, every pair of languages has its own linear support vector machine, and the language that wins
most of its pairs is predicted. Models are fitted on a bounded sample of labelled rows; prediction reads whole texts.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textroute.llm.letters import folded, gram_hashes
from textroute.llm.registry import fresh, query, table
from textroute.llm.samples import bounded_sample, held_out

#: Rows of each language that are fitted on, and hashed values of each vector.
SAMPLE = 300
DIMS = 1 << 12
LONGEST_RUN = 4
UNKNOWN = "und"
#: Members of families that are well known; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi", "romance": "fr es it pt ro ca gl oc ast la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk", "uralic": "fi et hu", "turkic": "tr az kk ky uz tk tt",
    "indic": "hi ur bn mr ne gu pa sa", "semitic": "ar he mt am", "celtic": "ga gd cy br", "baltic": "lt lv",
}


def family(lang: str) -> str:
    """The family of a language code, told by its first part (`pt-BR` is `pt`)."""
    code = lang.replace("_", "-").split("-")[0].lower()
    return next((name for name, members in FAMILIES.items() if code in members.split()), lang)


def vector(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of runs, as a vector of length one; null if the text has no letter."""
    codes = folded(text)
    if len(codes) < 2:
        return None
    counts = np.zeros(DIMS)
    for n in range(1, LONGEST_RUN + 1):
        counts += np.bincount(gram_hashes(codes, n) % DIMS, minlength=DIMS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: tuple[tuple[str, ...], ...]        # of each family
    families: np.ndarray                          # a row of weights for each family, bias last
    pairs: dict[tuple[str, str], np.ndarray]      # weights for the first against the second, bias last


def _softmax(x: np.ndarray, kind: np.ndarray, n: int, rounds: int = 400) -> np.ndarray:
    """Weights of a softmax regression, each class weighing the same, by accelerated descent on weights of the rows."""
    k = x @ x.T
    w = v = np.zeros((len(x), n))
    want = np.eye(n)[kind]
    share = (1 / np.bincount(kind, minlength=n))[kind][:, None] / n
    for i in range(rounds):
        z = k @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = v - (share * (p - want) + 1e-5 * v)
        w, v = new, new + i / (i + 3) * (new - w)
    return w.T @ x


def _machine(x: np.ndarray, sign: np.ndarray, rounds: int = 300, c: float = 100.0) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, found likewise; both classes weigh the same."""
    k = x @ x.T
    share = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())
    w = v = np.zeros(len(x))
    rate = 1 / (1 + 4 * c)
    for i in range(rounds):
        slack = np.maximum(0, 1 - sign * (k @ v))
        new = v - rate * (v - 2 * c * share * sign * slack)
        w, v = new, new + i / (i + 3) * (new - w)
    return w @ x


def fit(vectors: np.ndarray, langs: list[str]) -> Model:
    """A model from vectors and their languages."""
    x = np.hstack([vectors, np.ones((len(vectors), 1))]).astype(float)
    lang = np.array(langs, dtype=object)
    groups: dict[str, list[str]] = {}
    for name in sorted(set(langs)):
        groups.setdefault(family(name), []).append(name)
    names = sorted(groups)
    kind = np.array([names.index(family(name)) for name in langs], int)
    pairs = {}
    for members in groups.values():
        for a, b in combinations(members, 2):
            rows = (lang == a) | (lang == b)
            pairs[a, b] = _machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0))
    weights = _softmax(x, kind, len(names)) if len(names) > 1 else np.zeros((len(names), DIMS + 1))
    return Model(tuple(tuple(groups[n]) for n in names), weights, pairs)


def predict(v: np.ndarray | None, model: Model) -> tuple[str, float]:
    """Language and score: the family's probability times the mean confidence in the winner's pairs. Ties go by
    margin, then by name."""
    if v is None or not model.languages:
        return UNKNOWN, 0.0
    x = np.append(v, 1.0)
    z = model.families @ x
    p = np.exp(z - z.max())
    best = int(p.argmax())
    members, sure = model.languages[best], p[best] / p.sum()
    if len(members) == 1:
        return members[0], float(sure)
    wins, margins, trust = (dict.fromkeys(members, 0.0) for _ in range(3))
    for (a, b), w in model.pairs.items():
        if a in wins and b in wins:
            m = float(w @ x)
            t = 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
            for name, margin, share in ((a, m, t), (b, -m, 1 - t)):
                wins[name] += margin > 0 or (margin == 0 and name == a)
                margins[name] += margin
                trust[name] += share / (len(members) - 1)
    first = min(members, key=lambda name: (-wins[name], -margins[name], name))
    return first, float(sure * trust[first])


def train(docs: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from rows whose language isn't null and whose text has a letter. `learn` is a condition on the column `id`."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if learn is None else learn))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, v.tobytes()) for name, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True)
                     if (v := vector(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.binary())],
                                             names=["lang", "vector"])
    sample = bounded_sample(rows, "lang", F.struct("id", F.xxhash64("text").alias("t")), SAMPLE).select("lang", "text")
    found = sample.mapInArrow(vectors, "lang string, vector binary").orderBy("lang", F.xxhash64("vector")).collect()
    x = np.array([np.frombuffer(r["vector"], np.float32) for r in found]).reshape(-1, DIMS)
    return fit(x, [r["lang"] for r in found])


def predictor(model: Model):
    """A column function from texts to `(lang_pred, score)`."""
    @F.pandas_udf("lang_pred string, score double")
    def languages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predict(vector(t), model) for t in texts], columns=["lang_pred", "score"])
    return languages


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, lang_pred, score)` for each row of `docs`.

    A null text, or one without a letter, is `und` with score 0; so is every text if there was nothing to learn from.
    Repeated rows are predicted alike, null ids are kept, other columns are not read.
    """
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), predictor(model)(F.col(f"`{text}`")).alias("p")).select("doc_id", "p.*")


def drop_unknown(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` whose language can be told, with all their columns; rows without any letter go."""
    model, name = train(docs, doc_id=doc_id, text=text, lang=lang), fresh(docs, "language")
    return docs.withColumn(name, predictor(model)(F.col(f"`{text}`"))).filter(F.col(f"{name}.lang_pred") != UNKNOWN).drop(name)


@query("op10_hierarchical_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("id"), 4, 2))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
