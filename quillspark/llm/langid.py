"""Language identification by interpolated Kneser-Ney character models.

One model a language, of all orders up to `order`, trained on a bounded sample of labelled texts. The n-grams of all languages lie in
one sorted array of hashes an order, beside a matrix of log-probabilities by language, so a text is scored for all languages at
once: its characters are looked up at the highest order, and those not found back off together. The language with the
lowest cross-entropy a character is chosen; one above what its own texts show is marked as rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table
from .toxicity import crc_mod
from .words import mix

BITS = 16  # of a character's number in an n-gram's key
OTHER, SPACE = 0, 1
_MASK = (1 << BITS) - 1
_PIECE = 1 << 17


@dataclass
class Alphabet:
    """Letters by number: 0 for letters not seen in training, 1 for runs of all else."""

    letters: list[str]
    table: np.ndarray | None = None

    def numbers(self, text: str) -> np.ndarray:
        if self.table is None:
            self.table = np.full(0x110000, SPACE, np.uint16)
            self.table[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
            for n, c in enumerate(self.letters, 2):
                for x in {c, c.upper()}:
                    if len(x) == 1:
                        self.table[ord(x)] = n
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def _sequence(numbers: np.ndarray, order: int, before: np.ndarray | None = None) -> np.ndarray:
    """Runs of spaces as one, after the order - 1 numbers before it; the text's beginning has spaces before it."""
    before = np.full(order - 1, SPACE, np.uint64) if before is None else before
    space = numbers == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(before) and before[-1] != SPACE:
        keep[:1] = True
    return np.concatenate([before, numbers[keep].astype(np.uint64)])


def _keys(seq: np.ndarray, n: int) -> np.ndarray:
    """Each run of n numbers as one, the last in the low bits; by start."""
    m = len(seq) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for j in range(n):
        out = (out << np.uint64(BITS)) | seq[j : j + m]
    return out


@dataclass
class Model:
    languages: list[str]
    alphabet: Alphabet
    order: int
    hashes: list[np.ndarray] = field(default_factory=list)  # by order - 1: sorted
    logs: list[np.ndarray] = field(default_factory=list)  # log-probabilities, by language
    context_hashes: list[np.ndarray] = field(default_factory=list)  # by length of the context
    backoffs: list[np.ndarray] = field(default_factory=list)  # log of the weight left to the shorter context
    sharpness: float = 1.0
    limits: np.ndarray | None = None  # of cross-entropy, by language

    def scored(self, seq: np.ndarray) -> np.ndarray:
        """Log-probabilities by language of each number after the first order - 1."""
        n = self.order
        out = np.zeros((len(seq) - n + 1, len(self.languages)), np.float32)
        left = np.arange(len(out))
        keys = _keys(seq, n)
        for k in range(n, 0, -1):
            own = keys[left] & np.uint64((1 << (BITS * k)) - 1)
            at, found = _lookup(self.hashes[k - 1], mix(own + np.uint64(k)))
            out[left[found]] += self.logs[k - 1][at[found]]
            left, own = left[~found], own[~found]
            if not len(left):
                break
            if k == 1:
                out[left] += math.log(1 / (len(self.alphabet.letters) + 2)) + (self.backoffs[0][0] if len(self.backoffs[0]) else 0)
                break
            at, seen = _lookup(self.context_hashes[k - 1], mix((own >> np.uint64(BITS)) + np.uint64(k)))
            out[left[seen]] += self.backoffs[k - 1][at[seen]]
        return out

    def pieces(self, text: str) -> Iterator[tuple[np.ndarray, bool]]:
        """The sequence of a text in pieces, each with the order - 1 numbers before it, and whether it has letters. Pieces bound the memory; the scores are those of the whole."""
        before = None
        for a in range(0, len(text), _PIECE):
            x = self.alphabet.numbers(text[a : a + _PIECE])
            seq = _sequence(x, self.order, before)
            before = seq[len(seq) - self.order + 1 :]
            yield seq, bool((x != SPACE).any())

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character in nats, by text and language, and whether a text has letters. Without: infinite."""
        total, count, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        parts: list[np.ndarray] = []
        of: list[int] = []
        held = 0

        def add() -> None:
            nonlocal held
            ends = np.cumsum([len(p) for p in parts])
            scores = self.scored(np.concatenate([*parts, np.full(self.order - 1, SPACE, np.uint64)]))
            for i, p, end in zip(of, parts, ends.tolist(), strict=True):
                begin = end - len(p)  # the n-gram of a number starts order - 1 before it
                total[i] -= scores[begin : end - self.order + 1].sum(axis=0, dtype=np.float64)
                count[i] += len(p) - self.order + 1
            parts.clear()
            of.clear()
            held = 0

        for i, t in enumerate(texts):
            for seq, letters in self.pieces(t or ""):
                has[i] |= letters
                parts.append(seq)
                of.append(i)
                held += len(seq)
                if held >= _PIECE:
                    add()
        if parts:
            add()
        return np.where(has[:, None], total / np.maximum(count, 1)[:, None], np.inf), has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (`und` without letters), confidence from 0 to 1, whether rejected, and cross-entropy."""
        h, has = self.entropies(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), has, np.full(len(texts), np.inf)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        with np.errstate(invalid="ignore"):
            score = np.where(has, 1 / np.exp(-self.sharpness * (h - low[:, None])).sum(axis=1), 0.0)
        rejected = ~has if self.limits is None else ~has | (low > self.limits[best])
        return [self.languages[i] if ok else "und" for i, ok in zip(best, has, strict=True)], score, rejected, low


def _lookup(table_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table_, x), len(table_) - 1)
    return at, table_[at] == x


def train(texts: dict[str, list[str]], order: int = 4, letters: int = _MASK - 2) -> Model:
    """The models of the given texts by language. Every letter has a number of its own: an n-gram's key has 16 bits a letter, more than there are letters in all scripts in use; were there more, the rarest would be one letter, as unseen ones are."""
    if not 1 <= order <= 4:
        raise ValueError("order: 1 to 4")
    found = Counter(c for x in texts.values() for t in x for c in t.lower() if c.isalpha())
    model = Model(sorted(texts), Alphabet(sorted(c for c, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[: min(letters, _MASK - 2)])), order)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language: of each order, keys and counts
    for language in model.languages:
        seqs = [_keys(_sequence(model.alphabet.numbers(t), order), order) for t in texts[language]]
        top = np.unique(np.concatenate(seqs or [np.zeros(0, np.uint64)]), return_counts=True)
        of = [top]
        for k in range(order - 1, 0, -1):  # below the top an n-gram counts once for each character that it is seen after
            of.insert(0, np.unique(of[0][0] & np.uint64((1 << (BITS * k)) - 1), return_counts=True))
        counts.append(of)
    shorter, previous = np.zeros((0, 0)), np.zeros(0, np.uint64)
    for k in range(1, order + 1):
        keys = np.unique(np.concatenate([of[k - 1][0] for of in counts])) if counts else np.zeros(0, np.uint64)
        contexts, context = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        p, weight = np.zeros((len(keys), len(counts))), np.zeros((len(contexts), len(counts)))
        below = np.full(p.shape, 1 / (len(model.alphabet.letters) + 2)) if k == 1 else shorter[np.searchsorted(previous, keys & np.uint64((1 << (BITS * (k - 1))) - 1))]
        for j, of in enumerate(counts):
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, of[k - 1][0])] = of[k - 1][1]
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            total = np.bincount(context, c, len(contexts))
            kinds = np.bincount(context, c > 0, len(contexts))
            weight[:, j] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            p[:, j] = np.maximum(c - d, 0) / np.maximum(total, 1)[context] + weight[context, j] * below[:, j]
        shorter, previous = p, keys
        for keys_, x, to, values in ((keys, p, model.hashes, model.logs), (contexts, weight, model.context_hashes, model.backoffs)):
            h = mix(keys_ + np.uint64(k))
            by = np.argsort(h)
            to.append(h[by])
            values.append(np.log(np.maximum(x[by], 1e-12)).astype(np.float32))
    return model


def calibrate(model: Model, texts: dict[str, list[str]]) -> Model:
    """Confidence and rejection from texts that weren't trained on: the sharpness of highest likelihood, and the 0.995 quantile of each language's cross-entropy and half as much again."""
    x = [(language, t) for language, own in texts.items() if language in model.languages for t in own]
    h, has = model.entropies([t for _, t in x])
    y = np.array([model.languages.index(language) for language, _ in x], int)[has]
    h = h[has]
    if not len(y):
        return model
    own = h[np.arange(len(y)), y]

    def loss(s: float) -> float:
        z = -s * (h - h.min(axis=1)[:, None])
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))

    model.sharpness = min((float(s) for s in np.geomspace(0.5, 30, 30)), key=loss)
    model.limits = np.array([np.quantile(own[y == j], 0.995) * 1.5 if (y == j).any() else np.inf for j in range(len(model.languages))])
    return model


def fit(docs: DataFrame, each: int = 250, order: int = 4, most_chars: int = 4_000_000) -> Model:
    """The model from docs (doc_id, text, lang) with a language.

    Of each language at most about `each` documents, chosen by a hash of doc_id, are trained on, whole, and a quarter
    as many serve for calibration; of either, `most_chars` characters are taken at most, the last text up to there, so that what is collected is bounded however long a text is. Copies count once.
    Rows with a null text or lang aren't learnt from. Empty table: a model without languages, for which every text is `und`.
    """
    labelled = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    number = F.element_at(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)), F.col("lang")) if counts else F.lit(0)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 * number
    chosen = labelled.where(share < each * 1.25).select("lang", "text", (share >= each).alias("apart")).distinct()
    before = F.sum(F.length("text")).over(Window.partitionBy("lang", "apart").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, -1))
    bounded = chosen.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most_chars)
    rows = bounded.select("lang", "apart", F.substring(F.col("text"), F.lit(1), (most_chars - F.col("before")).cast("int")).alias("text")).collect()
    texts: tuple[dict, dict] = {}, {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        texts[r["apart"]].setdefault(r["lang"], []).append(r["text"])
    return calibrate(train(texts[0], order), texts[1])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected, cross_entropy (nats a character; null without letters) of each whole text.

    A null text or one without letters is `und` with score 0, and rejected. Languages that tie: the first by name. docs needs doc_id and text; a null doc_id stays
    null, repeated rows come out alike, other columns aren't read. Empty table: no rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        language, score, rejected, h = model.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "lang_pred": language, "score": np.asarray(score, float), "rejected": rejected, "cross_entropy": [float(x) if np.isfinite(x) else None for x in h]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double", 128)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of documents; a null doc_id is neither held out nor learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs.where(crc_mod("doc_id", 4) != 2)))
    return out.select("doc_id", (F.coalesce(crc_mod("doc_id", 4), F.lit(-1)) == 2).alias("held_out"), "lang_pred", "score", "rejected")
