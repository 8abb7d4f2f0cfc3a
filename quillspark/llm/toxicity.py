"""Toxic passages by maximal-scoring segments.

Each token scores the log-odds of its word, or of a beginning of it, between toxic and clean labelled texts under a
Dirichlet prior, less its uncertainty; tokens without evidence cost a small drift. All maximal-scoring segments of a text are
found in one linear scan. Under extreme-value statistics a segment's score becomes a chance of arising in clean text
of that length; those for which it is small are the toxic passages. Segments are summed, several weak ones counting together, and a
logistic curve fitted on labelled texts kept apart turns the sum into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_arrow, table

PREFIXES = (4, 5, 6, 7, 8)
_PUNCTUATION = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”„‘’¡¿…–—"
_MOST_WORDS = 300_000


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def evidence(word: str) -> list[str]:
    """The word in lower case without punctuation around it, and its beginnings, marked by an asterisk."""
    word = word.lower().strip(_PUNCTUATION)
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)] if word else []


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    rate: float = 1.0  # lambda of the extreme-value law
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.0)  # intercept, per nat of evidence, per log of length

    def token(self, word: str) -> float:
        return max((self.weights.get(x, 0.0) for x in evidence(word)), default=0.0)


class Scorer(dict):
    """Word to score, for words seen before; it starts anew when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= _MOST_WORDS:
            self.clear()
        self[word] = s = self.model.token(word)
        return s

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and the maximal-scoring segments (first, end, score), in order."""
        words = (text or "").split()
        scores = np.fromiter(map(self.__getitem__, words), float, len(words))
        return len(words), maximal_segments(np.flatnonzero(scores > 0), scores, self.model.drift)

    def __call__(self, text: str | None) -> tuple[int, float, list[tuple[int, int, float]]]:
        """The number of tokens, the evidence in nats, and the significant segments."""
        n, found = self.segments(text)
        return n, sum_statistic([s for *_, s in found], n, self.model.rate), significant(found, n, self.model.rate)

    def probability(self, n: int, nats: float) -> float:
        a, b, c = self.model.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * math.log1p(nats) + c * (math.log1p(n) if nats > 0 else 0.0)))))


def maximal_segments(hits: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence in which all but the hits score -drift, in time linear in the hits.

    Candidates are kept on a list with the cumulative scores left of and up to them; one that adds to an earlier one is merged with it.
    Each keeps the place of the last candidate before it that began lower: none between the two begins lower than it does, so a search
    for a lower beginning goes from place to place, and no step of it is taken again once a candidate stands behind it.
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, 0
    for i, s in zip(hits.tolist(), scores[hits].tolist(), strict=True):
        left = total - drift * (i - last)
        total, last = left + s, i + 1
        start, low = i, left
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((start, i + 1, low, total, j))
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def significant(found: list[tuple[int, int, float]], n: int, rate: float, chance: float = 0.05) -> list[tuple[int, int, float]]:
    """The segments whose score the best segment of clean text of n tokens reaches with at most this chance, 1 - exp(-n exp(-rate * score))."""
    least = (math.log(n) - math.log(-math.log1p(-chance))) / rate if n else 0.0
    return [x for x in found if x[2] >= least]


def sum_statistic(scores: list[float], n: int, rate: float) -> float:
    """Minus the log of the chance that clean text of n tokens has segments so good, over the best r of them, at least 0."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += rate * s - math.log(n)
        if total <= 0:
            break
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return max(best, rate * max(scores, default=0.0) / (1 + math.log(n or 1)))


def _fit_rate(scores: list[tuple[float, float]], clean: float, drift: float) -> float:
    """lambda with mean(exp(lambda * score)) = 1 over clean tokens; scores: (score, clean count) of the words with evidence."""
    hits = [(s, n / clean) for s, n in scores if n > 0] or [(max((s for s, _ in scores), default=1.0), 0.5 / clean)]
    rest = 1 - sum(p for _, p in hits)
    low, high = 1e-6, 50.0
    for _ in range(80):
        x = (low + high) / 2
        if math.log(rest * math.exp(-x * drift) + sum(p * math.exp(min(600.0, x * s)) for s, p in hits)) > 0:
            high = x
        else:
            low = x
    return max(low, 0.05)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(labelled: DataFrame, each: int) -> DataFrame:
    """At most about `each` labelled rows of each class, chosen by a hash of doc_id, with the share of the class taken."""
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col("toxic") == c, F.lit(min(1.0, each / n))).otherwise(share)
    return labelled.withColumn("share", share).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)


def fit(docs: DataFrame, labels: DataFrame, each: int = 4000, prior: float = 1.0, sure: float = 3.0, features: int = 20_000) -> Model:
    """The model from labels (doc_id, toxic 0 or 1) of documents.

    At most about `each` labelled documents of each class are used, a fifth of them for the curve alone. A word counts
    once for each pair of neighbours it has, so copies of a text don't count again. `prior` is the least Dirichlet mass of a word, and only evidence
    `sure` standard deviations from none is kept, the surest `features` of it: a bound on the model that is sent to the tasks, which leaves out the
    weakest evidence only where the sample shows more. Rows that repeat a doc_id are each read; one that `labels` calls both toxic and clean is toxic.
    Rows without doc_id aren't learnt from. Without labels nothing scores.
    """
    chosen = _sample(labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), each)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).persist()

    def words(batch: pa.RecordBatch) -> dict:
        out: dict = {"toxic": [], "context": [], "word": []}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            x = [w.lower().strip(_PUNCTUATION) for w in (text or "").split()]
            for a, w, b in zip(["", *x], x, [*x[1:], ""], strict=False):
                if w:
                    out["toxic"].append(toxic)
                    out["context"].append(hash_of(f"{a} {w} {b}"))
                    out["word"].append(w)
        return out

    try:
        seen = map_arrow(rows.where("not apart").select("text", "toxic"), words, "toxic int, context long, word string", 256)
        counted = seen.groupBy("toxic", "context").agg(F.first("word").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).persist()
        sums = counted.agg(F.sum("t"), F.sum("c")).first()
        n_t, n_c = float(sums[0] or 0), float(sums[1] or 0)
        if not n_t or not n_c:
            return Model()
        parts = reduce(lambda a, n: F.when(F.length("word") > n, F.concat(a, F.array(F.concat(F.substring("word", 1, n), F.lit("*"))))).otherwise(a), PREFIXES, F.array("word"))
        of = counted.select(F.explode(parts).alias("x"), "t", "c").groupBy("x").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 2")
        a, a0 = F.greatest(F.lit(prior), 100 * (F.col("t") + F.col("c")) / (n_t + n_c)), 100 + prior
        t, c = F.col("t") + a, F.col("c") + a
        odds = F.log(t / (n_t + a0 - t)) - F.log(c / (n_c + a0 - c))
        error = F.sqrt(1 / t + 1 / c)
        kept = of.select("x", "c", odds.alias("odds"), error.alias("error")).where(F.col("odds") >= sure * F.col("error")).orderBy(F.desc(F.col("odds") / F.col("error")), "x").limit(features).collect()
        model = Model(weights={r["x"]: r["odds"] - 1.5 * r["error"] for r in kept})
        if not kept:
            return model
        model.rate = _fit_rate([(model.weights[r["x"]], r["c"]) for r in kept if not r["x"].endswith("*")], n_c, model.drift)

        def measure(batch: pa.RecordBatch) -> dict:
            scorer = Scorer(model)
            found = [scorer(x)[:2] for x in batch.column("text").to_pylist()]
            return {"n": [x[0] for x in found], "nats": [x[1] for x in found], "toxic": batch.column("toxic"), "share": batch.column("share")}

        apart = map_arrow(rows.where("apart").select("text", "toxic", "share"), measure, "n long, nats double, toxic int, share double", 256).toPandas()
    finally:
        rows.unpersist()
    y = apart["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return model
    nats = apart["nats"].to_numpy()
    x = np.stack([np.ones(len(y)), np.log1p(nats), np.where(nats > 0, np.log1p(apart["n"].to_numpy()), 0)], axis=1)
    model.curve = tuple(_fit_curve(x, y, 1 / apart["share"].to_numpy()).tolist())
    return model


def hash_of(x: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def score(docs: DataFrame, model: Model, toxicity: str = "toxicity", passages: str = "passages") -> DataFrame:
    """docs with toxicity (double, 0 to 1) and its significant passages (array of first, end, score; in tokens), under the names given.

    docs needs text and keeps its other columns; one that has a name given is replaced. A null or empty text has no passages and the score of no evidence.
    A row's score depends on its text and the model alone, so equal texts tie and repeated rows come out alike. Empty table: no rows.
    """
    kept = [f.name for f in docs.schema if f.name.lower() not in (toxicity.lower(), passages.lower())]
    docs = docs.drop(toxicity, passages)
    plain = docs.toDF(*(f"c{i}" for i in range(len(kept))))  # Arrow functions don't take all names
    spans = StructType.fromDDL("x array<struct<first:int,end:int,score:double>>")["x"].dataType
    schema = StructType([*plain.schema, StructField("toxicity", DoubleType()), StructField("passages", spans)])
    scorer = Scorer(model)
    place = kept.index("text")

    def run(batch: pa.RecordBatch) -> dict:
        found = [scorer(t) for t in batch.column(place).to_pylist()]
        return {f"c{i}": batch.column(i) for i in range(len(kept))} | {
            "toxicity": [scorer.probability(n, nats) for n, nats, _ in found],
            "passages": [[{"first": a, "end": b, "score": s} for a, b, s in x] for *_, x in found],
        }

    return map_arrow(plain, run, schema, 1024).toDF(*kept, toxicity, passages)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of each row of documents; a null doc_id is not held out, a null or empty text has the score of no evidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (F.coalesce(crc_mod("doc_id", 5), F.lit(-1)) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
