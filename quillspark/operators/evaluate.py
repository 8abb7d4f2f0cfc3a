"""Evaluation measures, the lexical forms, and the paired comparison of two conditions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let
from ..functions.text import WORD, containment, content_tokens, jaccard, token_distance

SUPPORTED, CITED, APPLIED = 0.18, 0.15, 0.30
METRICS = ("edit_distance", "recall_at_5", "faithfulness", "answer_relevancy", "citation_accuracy", "rule_application")


def _dealt(df: DataFrame) -> DataFrame:
    """df for a join by document that deals both sides out: files of texts that are alike are small, so the optimizer would send to the driver, for a broadcast, what is many times their size in memory."""
    return df.hint("merge")


def words(text: Column) -> Column:
    """Lower-cased words of any script, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def edit_distance(produced: Column, gold: Column) -> Column:
    """Levenshtein distance between the words, over the number of the gold's, at most 1."""
    return F.least(F.lit(1.0), token_distance(words(produced), words(gold)) / F.greatest(F.size(words(gold)), F.lit(1)))


def section_text(sentences: Column, findings: Column, gaps: Column) -> Column:
    """What is compared of a section: its sentences, findings and gaps (arrays of text), joined."""
    return F.btrim(F.concat_ws(" ", *(F.nullif(F.array_join(x, " "), F.lit("")) for x in (sentences, findings, gaps))))


def field_edit_distance(produced: DataFrame, gold: DataFrame) -> DataFrame:
    """key, n_sections, distance: the mean over the sections (key, section, text) of which the gold has a text; 0 without any."""
    joined = gold.select("key", "section", F.col("text").alias("_gold")).join(_dealt(produced.select("key", "section", "text")), ["key", "section"], "left")
    scored = joined.select("key", F.when(F.col("_gold") != "", edit_distance(F.col("text"), F.col("_gold"))).alias("d"))
    return scored.groupBy("key").agg(F.count("d").alias("n_sections"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("distance"))


def hit_pages(text: Column, page: Column) -> Column:
    """A hit's own page and every page whose heading its text has."""
    return F.array_distinct(F.concat(F.array(page), F.transform(F.regexp_extract_all(text, F.lit(r"(?i)##\s*Page\s+(\d+)\b"), F.lit(1)), lambda x: x.cast("int"))))


def recall_at_k(gold: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall: the share of gold pages (query_id, doc_id, page; null for none) that the first k hits (query_id, rank, doc_id, page, text) cover; 1 without gold pages."""
    pages = hits.where(F.col("rank") <= k).select("query_id", "doc_id", F.explode(hit_pages(F.col("text"), F.col("page"))).alias("page")).distinct().withColumn("hit", F.lit(1.0))
    wanted = gold.where("doc_id is not null").select("query_id", "doc_id", "page").distinct().join(_dealt(pages), ["query_id", "doc_id", "page"], "left")
    share = wanted.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    return gold.select("query_id").distinct().join(share, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))


#: Characters of texts whose tokens a task holds of one key; a key that has more is dealt out in parts, each of which meets each part of the other side.
PART = 16_000_000
#: Places a task of a shuffle has, where the cells of keys meet.
PLACES = 8
#: Hits that claims meet at once.
AT_ONCE = 512


def _parts(df: DataFrame, name: str) -> DataFrame:
    """key and in how many parts its texts are dealt out."""
    return df.where("key is not null").groupBy("key").agg(F.ceil(F.coalesce(F.sum(F.length("text")), F.lit(0)) / PART).cast("int").alias(name))


def _needed(n: np.ndarray) -> np.ndarray:
    """How many of n tokens have to be there: the fewest whose share is enough."""
    at = np.maximum(np.ceil(SUPPORTED * n).astype(np.int64) - 1, 1)
    for _ in range(2):
        at += at / n < SUPPORTED
    return at


def _held(claims: pa.Table, hits: pa.Table) -> pa.Table:
    """key, claim_id, ok: whether one of the hits of the claim's cell has enough of its tokens. Tokens come joined by spaces, and none is empty.

    Hits are met widest first, AT_ONCE of each cell at a time, and only by the claims that none has supported yet: what claims and hits share is counted as a matrix of claims times these hits.
    """
    n_claims, n_hits = claims.num_rows, hits.num_rows
    ok = np.zeros(n_claims, dtype=bool)
    if n_claims and n_hits:
        both = lambda c: pa.chunked_array([*claims[c].chunks, *hits[c].chunks], pa.string())
        coded = lambda c: pc.dictionary_encode(c).combine_chunks().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cells = coded(both("cell"))
        split = pc.split_pattern(both("tokens"), " ").combine_chunks()
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = coded(pa.chunked_array([pc.list_flatten(split)]))
        of = np.repeat(np.arange(n_claims + n_hits), n)
        pair = cells[of] * (tokens.max() + 1) + tokens
        cut = int(n[:n_claims].sum())
        wide, cell = n[n_claims:], cells[n_claims:]
        order = np.lexsort((-wide, cell))
        first = np.r_[True, cell[order][1:] != cell[order][:-1]]
        rank = np.empty(n_hits, dtype=np.int64)
        rank[order] = np.arange(n_hits) - np.maximum.accumulate(np.where(first, np.arange(n_hits), 0))
        most = int(rank.max()) + 1
        # a claim's tokens are found in the sorted tokens of hits; those that no hit has are left out
        kinds, at = np.unique(pair[cut:], return_inverse=True)
        placed = np.searchsorted(kinds, pair[:cut])
        there = kinds[np.minimum(placed, len(kinds) - 1)] == pair[:cut]
        held = np.sort(at * most + rank[of[cut:] - n_claims])
        asked, kind = of[:cut][there], placed[there]
        need = _needed(n[:n_claims])
        ok[need == 1] = np.bincount(asked, minlength=n_claims)[need == 1] > 0
        open_ = ~ok & (np.bincount(asked, minlength=n_claims) >= need)
        for begin in range(0, most, AT_ONCE):
            stay = open_[asked]
            asked, kind = asked[stay], kind[stay]
            if not len(asked):
                break
            low, high = np.searchsorted(held, kind * most + begin), np.searchsorted(held, kind * most + min(begin + AT_ONCE, most))
            _count(asked, kind, low, high, held, most, begin, need, open_, ok)
    return claims.select(["key", "claim_id"]).append_column("ok", pa.array(ok))


def _count(asked: np.ndarray, kind: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray, most: int, begin: int, need: np.ndarray, open_: np.ndarray, ok: np.ndarray) -> None:
    """Marks the claims (asked, in order: one row a token) of whose tokens one of the hits from `begin` on has enough: `held` from low to high are a token's."""
    size, heads = high - low, np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
    ends = np.r_[heads[1:], len(asked)]
    width = min(AT_ONCE, most - begin)
    total = np.r_[0, np.cumsum(size)]
    a = 0
    while a < len(heads):
        # as many claims as take some millions of counts and of shared tokens, one at least
        b = min(a + max(1, 4_000_000 // width), int(np.searchsorted(total[ends], total[heads[a]] + 8_000_000, "right")))
        b = max(b, a + 1)
        rows = slice(heads[a], ends[b - 1])
        count = size[rows]
        took = int(count.sum())
        if took:
            place = np.repeat(low[rows] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(took)
            claim = np.repeat(np.repeat(np.arange(b - a), ends[a:b] - heads[a:b]), count)
            shared = np.bincount(claim * width + held[place] % most - begin, minlength=(b - a) * width).reshape(b - a, width).max(axis=1)
            ids = asked[heads[a:b]]
            good = shared >= need[ids]
            ok[ids[good]], open_[ids[good]] = True, False
        a = b


def faithfulness(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """key, n_claims, faithfulness: the share of claims (key, claim_id, text) of whose content tokens one hit (key, hit_id, text) has enough. Claims without tokens count as not supported.

    Claims and hits of a key meet in one place, where what they share is counted, so texts are shuffled and not the tokens they share. A key of many texts is dealt out in parts of a bounded size.
    """
    parts = _parts(claims, "n_c").join(_dealt(_parts(hits, "n_h")), "key")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1))
    c = claims.select("key", "claim_id", F.array_join(content_tokens(F.col("text")), " ").alias("tokens")).join(_dealt(parts), "key", "left")
    h = hits.select("key", "hit_id", F.array_join(content_tokens(F.col("text")), " ").alias("tokens")).where("key is not null and tokens <> ''").join(_dealt(parts), "key")
    cell = F.concat_ws("/", F.col("key").cast("string"), F.col("h").cast("string"), F.col("c").cast("string"))
    asked = c.withColumn("c", F.coalesce(part("claim_id", F.col("n_c")), F.lit(0))).withColumn("h", every(F.col("n_h"))).select("key", "claim_id", F.when(F.col("n_h").isNotNull(), F.nullif("tokens", F.lit(""))).alias("tokens"), cell.alias("cell"))
    found = h.withColumn("h", part("hit_id", F.col("n_h"))).withColumn("c", every(F.col("n_c"))).select("tokens", cell.alias("cell"))
    tasks = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.xxhash64("cell"), F.lit(tasks * PLACES)).cast("int").alias("place")
    may = asked.where("tokens is not null")
    kind = f"key {claims.schema['key'].dataType.simpleString()}, claim_id {claims.schema['claim_id'].dataType.simpleString()}, ok boolean"
    held = may.select("key", "claim_id", "tokens", "cell", place).groupBy("place").cogroup(found.select("tokens", "cell", place).groupBy("place")).applyInArrow(_held, kind)
    good = held.where("ok").select("key", "claim_id").distinct().withColumn("ok", F.lit(1.0))
    return claims.select("key", "claim_id").join(_dealt(good), ["key", "claim_id"], "left").groupBy("key").agg(F.count("*").alias("n_claims"), F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 6).alias("faithfulness"))


def supported(claim: Column, hits: Column) -> Column:
    """The same of one claim on its own row: whether one of the hits, an array of their content tokens, has enough of the claim's."""

    def of(tokens: Column) -> Column:
        return F.exists(hits, lambda h: F.coalesce(containment(tokens, h), F.lit(0.0)) >= SUPPORTED)

    return F.coalesce(let(content_tokens(claim), of), F.lit(False))


def citation_accuracy(sentences: DataFrame) -> DataFrame:
    """key, accuracy over sentences (key, text, snippets) that have tokens and snippets: whether any snippet is like the sentence."""
    tokens = content_tokens(F.col("text"))
    fits = F.exists("snippets", lambda s: jaccard(tokens, content_tokens(s)) >= CITED)
    scored = sentences.where((F.size(tokens) > 0) & (F.size("snippets") > 0)).select("key", F.when(fits, 1.0).otherwise(0.0).alias("ok"))
    return scored.groupBy("key").agg(F.bround(F.avg("ok"), 4).alias("accuracy"), F.count("*").alias("n"))


def answer_relevancy(reference: Column, answer: Column) -> Column:
    """The share of the reference's content tokens that the answer has; 0 for none."""
    return F.coalesce(containment(content_tokens(reference), content_tokens(answer)), F.lit(0.0))


def rule_application(rules: DataFrame, drafts: DataFrame) -> DataFrame:
    """key, n_rules, n_applicable, rate: of the rules (key, rule_id, text) that have content tokens the share of which the draft (key, text) has at least 30 % of them; 0 without any."""
    of_draft = F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) >= 4))
    joined = rules.select("key", "rule_id", content_tokens(F.col("text")).alias("r")).join(_dealt(drafts.select("key", of_draft.alias("d"))), "key")
    used = F.when(F.size("r") > 0, (containment(F.col("r"), F.col("d")) >= APPLIED).cast("double"))
    return joined.groupBy("key").agg(F.count("*").alias("n_rules"), F.count(used).alias("n_applicable"), F.round(F.coalesce(F.avg(used), F.lit(0.0)), 6).alias("rate"))


def aggregated(cases: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """condition and the mean of each measure, half-even to 4 digits; 0 for none."""
    return cases.groupBy("condition").agg(*(F.coalesce(F.bround(F.avg(m), 4), F.lit(0.0)).alias(m) for m in metrics))


def paired(means: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, pre, post, delta, pct_reduction from the two conditions' means."""
    long = means.select("condition", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("condition", "m.*")
    both = long.groupBy("metric").agg(F.max(F.when(F.col("condition") == "pre", F.col("value"))).alias("pre"), F.max(F.when(F.col("condition") == "post", F.col("value"))).alias("post"))
    delta = F.bround(F.col("post") - F.col("pre"), 4)
    base = F.when(F.col("pre") == 0, F.lit(1e-9)).otherwise(F.col("pre"))
    return both.select("metric", "pre", "post", delta.alias("delta"), F.bround((F.col("pre") - F.col("post")) / base, 4).alias("pct_reduction"))


def cases(ids: DataFrame, gold: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The evaluation set: of the ids those that have both a gold summary and a document."""
    return ids.select(key).distinct().join(gold, key).join(documents, key)


def spoken(drafted: DataFrame, overall: DataFrame) -> DataFrame:
    """doc_id, claim_id, text, snippet: every sentence of drafts: sections() rows with their findings, and the overall sentence (doc_id, overall_text, citation)."""
    own = drafted.select("doc_id", F.concat("section", F.lit("/0")).alias("claim_id"), "text", F.col("citation.snippet").alias("snippet"))
    more = drafted.select("doc_id", "section", F.posexplode("findings").alias("i", "f")).select("doc_id", F.concat_ws("/", "section", (F.col("i") + 1).cast("string")).alias("claim_id"), "f.text", F.col("f.citation.snippet").alias("snippet"))
    return own.unionByName(more).unionByName(overall.select("doc_id", F.lit("overall").alias("claim_id"), F.col("overall_text").alias("text"), F.col("citation.snippet").alias("snippet")))


def spoken_in(overall: DataFrame) -> DataFrame:
    """spoken() of rows a document as draft.summaries() gives them, out of their own sections: what was drafted is read once. Row-local."""
    said = lambda claim, text, citation: F.struct(claim.alias("claim_id"), text.alias("text"), citation["snippet"].alias("snippet"))
    found = lambda s: F.transform(s["findings"], lambda f, i: said(F.concat_ws("/", s["section"], (i + 1).cast("string")), f["text"], f["citation"]))
    own = F.flatten(F.transform("sections", lambda s: F.concat(F.array(said(F.concat(s["section"], F.lit("/0")), s["text"], s["citation"])), found(s))))
    return overall.select("doc_id", F.inline(F.concat(own, F.array(said(F.lit("overall"), F.col("overall_text"), F.col("citation"))))))


def compared(drafted: DataFrame) -> DataFrame:
    """key, section, text: what is compared of each section."""
    return drafted.select(F.col("doc_id").alias("key"), "section", section_text(F.array("text"), F.transform("findings", lambda f: f["text"]), F.col("gaps")).alias("text"))


def measured(drafted: DataFrame, overall: DataFrame, gold: DataFrame, gold_pages: DataFrame, hits: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """doc_id and METRICS of each draft that has a gold one.

    gold: key, section, text, in which a section `overall` may be. gold_pages: query_id, doc_id, page and hits: query_id, rank, doc_id, page, text, of the evaluation's own retrieval, by the draft's doc_id.
    rules: rule_id, text, held to all drafts.
    """
    claims = spoken(drafted, overall)
    produced = compared(drafted)
    sections = gold.where("section <> 'overall'")
    whole = lambda df: df.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), " ").alias("text"))
    answer = whole(produced.unionByName(overall.select(F.col("doc_id").alias("key"), F.lit("overall").alias("section"), F.col("overall_text").alias("text"))))
    ids = gold.select(F.col("key").alias("doc_id")).distinct()
    by = lambda df, column, name, key="key": df.select(F.col(key).alias("doc_id"), F.col(column).alias(name))
    keyed = claims.select(F.col("doc_id").alias("key"), "claim_id", "text")
    supported = faithfulness(keyed, hits.select(F.col("query_id").alias("key"), F.col("rank").alias("hit_id"), "text"))
    cited = citation_accuracy(claims.where("claim_id <> 'overall'").select(F.col("doc_id").alias("key"), "text", F.array_compact(F.array(F.nullif("snippet", F.lit("")))).alias("snippets")))
    near = answer.join(_dealt(whole(gold).select("key", F.col("text").alias("gold"))), "key").select("key", answer_relevancy(F.col("gold"), F.col("text")).alias("near"))
    parts = [by(field_edit_distance(produced, sections), "distance", "edit_distance"), by(recall_at_k(gold_pages, hits), "recall", "recall_at_5", "query_id"), by(supported, "faithfulness", "faithfulness"), by(near, "near", "answer_relevancy"), by(cited, "accuracy", "citation_accuracy")]
    if rules is not None:
        listed = rules.agg(F.collect_list(F.struct("rule_id", "text")).alias("all"))  # at most seven a section
        held = ids.select(F.col("doc_id").alias("key")).join(F.broadcast(listed)).select("key", F.inline("all"))
        parts.append(by(rule_application(held, answer), "rate", "rule_application"))
    out = ids
    for part in parts:
        out = out.join(_dealt(part), "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(F.col(m), F.lit(0.0)).alias(m) if m in out.columns else F.lit(0.0).alias(m) for m in METRICS))


def report_lines(pairs: DataFrame) -> DataFrame:
    """metric, line: the comparison's rows as lines of a Markdown table."""
    return pairs.select("metric", F.format_string("| %s | %.3f | %.3f | %+.3f |", "metric", "pre", "post", "delta").alias("line"))


def report(pairs: DataFrame) -> str:
    """The comparison as a Markdown table; one row a measure."""
    rows = pairs.orderBy("metric").collect()
    return "\n".join(["| metric | pre | post | delta |", "|---|---:|---:|---:|", *(f"| {r['metric']} | {r['pre']:.3f} | {r['post']:.3f} | {r['delta']:+.3f} |" for r in rows)])
