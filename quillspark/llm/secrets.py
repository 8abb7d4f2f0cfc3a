"""Secrets in texts: three patterns, and character Markov models of random strings and ordinary identifiers.

Everything is a DataFrame expression on one row at a time; nothing is shuffled. The models are two tables of transition
probabilities between characters, trained from labelled samples (random strings made by rule; words and identifiers of a bounded
sample of texts), of which one table of log-likelihood ratios remains.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

#: The base patterns, the group that has the secret, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
KINDS = ("assign", "access", "hex", "markov")
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]"
_N = len(SYMBOLS) + 1
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_NONE = "array<struct<start:int,kind:int,end:int,word:string>>"
_RUN, _BLOCK = 256, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """All that step(state, item) puts out, an array each, while the state goes from item to item.

    Items are taken in runs whose outputs are joined at the end: an array that grows by one is copied as a whole each time.
    """
    none = F.array().cast(out)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / _RUN).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * _RUN + 1, _RUN))

    def one(acc: Column, item: Column) -> Column:
        after, put = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], put).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(done, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    return F.flatten(F.aggregate(runs, F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out")), run, lambda acc: acc["out"]))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches of whose group at least so many characters are, as (start, kind, end, the match itself) in code points.

    The pieces between matches give their places: SQL has no function for these.
    """
    p = F.lit(pattern)

    def placed(found: Column, groups: Column, pieces: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column]:
            start = at + F.length(F.get(pieces, i))
            end = start + F.length(F.get(found, i))
            new = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(found, i).alias("word")))
            return end, F.when(F.length(F.get(groups, i)) >= least, new).otherwise(F.array().cast(_NONE))

        return _let(F.sequence(F.lit(0), F.size(found) - 1), lambda places: _scan(places, F.lit(0), step, _NONE))

    def bound(found: Column) -> Column:
        groups = F.regexp_extract_all(text, p, F.lit(group)) if group else found
        return _let(F.struct(found.alias("f"), groups.alias("g"), F.split(text, pattern, -1).alias("p")), lambda x: placed(x["f"], x["g"], x["p"]))

    return _let(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.when(F.size(x) > 0, bound(x)).otherwise(F.array().cast(_NONE)))


def _pattern(kind: str, pattern: str, least: int) -> str:
    """Runs shorter than the least can't hide a longer match where the pattern is one run; leaving them to the pattern saves the work."""
    return {"access": f"AKIA[A-Z0-9]{{{least - 4},}}", "hex": f"[0-9a-f]{{{least},}}"}.get(kind, pattern)


def samples(docs: DataFrame, texts: int = 2000, strings: int = 3000) -> DataFrame:
    """Labelled strings: word, random (1 or 0).

    Random: digests as hexadecimal, base 64, its letters and digits, capitals and digits. Ordinary: what about `texts` documents, chosen by a hash of doc_id, have of runs of
    the symbols, such as words, numbers, dates and addresses, alone and joined in pairs as identifiers; left out are base spans and what looks like a secret of another kind, runs of
    20 and more that mix letters and digits. docs needs doc_id and text. Empty table: random strings only.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    random = spark.range(strings).select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(b64, 1, 40), F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 32), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 20)))).alias("word"), F.lit(1).alias("random"))
    total = docs.count()
    share = min(1.0, texts / max(1, total))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select(F.coalesce("text", F.lit("")).alias("text"))
    plain = some.select(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), r"AKIA[A-Z0-9]{16,}", " "), "[0-9a-f]{24,}", " ").alias("text"))
    mixed = lambda w: (F.length(w) >= 20) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    words = plain.select(F.filter(F.regexp_extract_all("text", F.lit(f"{CANDIDATE}+"), F.lit(0)), lambda w: ~mixed(w)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), F.coalesce(b, a)))
    ordinary = words.select(F.explode(F.concat("w", pairs)).alias("word"), F.lit(0).alias("random"))
    return random.unionByName(ordinary)


def fit(labelled: DataFrame, pseudo: float = 0.5) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each transition, row by row of SYMBOLS after one for all else."""
    code = F.transform(F.split("word", ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    steps = labelled.where(F.length("word") > 1).select("random", code.alias("c")).select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * _N + b)).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}  # at most 2 * len(SYMBOLS + 1)^2
    out = []
    for a in range(_N):
        rows = [[counts.get((k, a * _N + b), 0) + pseudo for b in range(_N)] for k in (0, 1)]
        sums = [sum(x) for x in rows]
        out += [math.log(r / sums[1]) - math.log(o / sums[0]) for o, r in zip(*rows, strict=True)]
    return out


def ratio(word: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string of SYMBOLS, in time linear in its length."""
    scores = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    total = lambda c: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(scores, F.get(c, i - 1) * _N + F.get(c, i)), F.lit(0.0)))
    return _let(codes, total)


def _clear(base: Column, more: Column) -> Column:
    """base, and what of more overlaps none of it: once from left to right against ends, once from right to left against starts. Both are linear."""

    def after(end: Column, s: Column) -> tuple[Column, Column]:
        own = s["kind"] < len(BASE)
        return F.when(own, F.greatest(end, s["end"])).otherwise(end), F.when(own | (end <= s["start"]), F.array(s)).otherwise(F.array().cast(_NONE))

    def before(start: Column, s: Column) -> tuple[Column, Column]:
        own = s["kind"] < len(BASE)
        return F.when(own, s["start"]).otherwise(start), F.when(own | (start >= s["end"]), F.array(s)).otherwise(F.array().cast(_NONE))

    forth = _let(F.array_sort(F.concat(base, more)), lambda x: _scan(x, F.lit(0), after, _NONE))
    return _let(F.reverse(forth), lambda x: _scan(x, F.lit(2**31 - 1), before, _NONE))


def find(docs: DataFrame, model: list[float], nats: float = 12.0, name: str = "secrets") -> DataFrame:
    """docs with secrets (or the name given): array of (start, kind index in KINDS, end), by start and kind, in code points of text.

    The patterns' spans all stay; runs of the symbols whose log-likelihood ratio is at least `nats` are added where they overlap none of these. Runs so short that not even
    the likeliest transitions would do aren't weighed. docs needs text and keeps its other columns; one of the name given is replaced. Null and empty texts have no
    spans; repeated rows come out alike. Empty table: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*(_spans(text, _pattern(kind, pattern, least), i, group, least) for i, (kind, pattern, group, least) in enumerate(BASE)))
    shortest = 1 + math.ceil(nats / max(1e-3, *model))
    run = f"{CANDIDATE}{{{shortest},}}"
    random = lambda w: ratio(w, model) >= nats
    likely = F.exists(F.regexp_extract_all(text, F.lit(run), F.lit(0)), random)
    more = F.when(likely, F.filter(_spans(text, run, len(BASE)), lambda s: random(s["word"]))).otherwise(F.array().cast(_NONE))
    found = _let(F.struct(base.alias("base"), more.alias("more")), lambda x: F.when(F.size(x["more"]) > 0, _clear(x["base"], x["more"])).otherwise(x["base"]))
    return docs.withColumn(name, F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(_SPAN)))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], by: str = "[SECRET]") -> DataFrame:
    """docs whose texts have `by` for each secret; spans that overlap go as one. Null texts stay null; all other columns stay, whatever their names. Repeated rows come out alike. Empty table: no rows."""
    at = free(docs.columns, "secrets_")
    found = find(docs, model, name=at)

    def cut(blocks: Column, length: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            """The text from a up to b, out of its blocks."""
            i, j = F.floor(a / _BLOCK).cast("int"), F.floor((b - 1) / _BLOCK).cast("int")
            within = F.substring(F.get(blocks, i), a - i * _BLOCK + 1, b - a)
            over = F.concat(F.substring(F.get(blocks, i), a - i * _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(blocks, j), F.lit(1), b - j * _BLOCK))
            return F.when(b <= a, F.lit("")).when(i == j, within).otherwise(over)

        def step(done: Column, s: Column) -> tuple[Column, Column]:
            piece = F.when(s["kind"] < 0, F.array(between(done, s["start"]))).when(s["start"] >= done, F.array(between(done, s["start"]), F.lit(by))).otherwise(F.array().cast("array<string>"))
            return F.greatest(done, s["end"]), piece

        rest = F.array(F.struct(length.alias("start"), F.lit(-1).alias("kind"), length.alias("end")))
        return _let(F.concat(F.col(at), rest), lambda spans: F.array_join(_scan(spans, F.lit(0), step, "array<string>"), ""))

    whole = _let(F.struct(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("b"), F.length("text").alias("n")), lambda x: cut(x["b"], x["n"]))
    return found.withColumn("text", F.when(F.size(at) > 0, whole).otherwise(F.col("text"))).drop(at)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256 and spans of each row of documents; a null text is empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(samples(docs)))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), of(3).alias("n_markov"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
