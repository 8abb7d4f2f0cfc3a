"""Page quality, routing between parsers, and the rescue of sparse pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import last_before, let
from ..functions.text import page_class, page_confidence
from ..sources.tables import written

SPARSE, RATIO, FEW = 60, 0.30, 3
#: Added before rounding, so that a value halfway between two rounds alike wherever its last bit is.
TIE = 1e-12


def scored(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) with confidence, classification and whether the page is sparse."""
    return pages.withColumn("confidence", F.round(page_confidence(F.col("text")) + TIE, 6)).withColumn("classification", page_class(F.col("confidence"))).withColumn("sparse", F.length(F.btrim(F.coalesce("text", F.lit("")))) < SPARSE)


def rescue_gate(pages: DataFrame, most: int = 500) -> DataFrame:
    """doc_id, n_pages, n_sparse, rescue: whether a document's pages go to the second parser; pages after the first `most` are left out."""
    kept = scored(pages.where(F.col("page") <= most))
    per = kept.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.col("sparse").cast("long")).alias("n_sparse"))
    return per.withColumn("rescue", (F.col("n_sparse") > 0) & ((F.col("n_sparse") / F.col("n_pages") >= RATIO) | (F.col("n_pages") <= FEW)))


def rescued(pages: DataFrame, other: DataFrame) -> DataFrame:
    """Each page's longer text of two parsers, where the second has the page."""
    joined = pages.join(other.select("doc_id", "page", F.col("text").alias("_text")), ["doc_id", "page"], "left")
    longer = F.length(F.coalesce("_text", F.lit(""))) > F.length(F.coalesce("text", F.lit("")))
    return joined.withColumn("rescued", longer).withColumn("text", F.when(longer, F.col("_text")).otherwise(F.col("text"))).drop("_text")


def handwritten(name: Column, text: Column) -> Column:
    """By the document's name, or a short text with two phrases of old deeds."""
    t = F.lower(text)
    return F.lower(name).rlike("handwritten|fromthepage") | (F.contains(t, F.lit("probate court")) & F.contains(t, F.lit("made this")) & (F.length(text) < 2500))


def content_length(text: Column, marks: tuple[str, ...] = ("<!-- image -->", "[illegible]", "[blank page]", "---")) -> Column:
    """Characters of a text without the marks that stand for missing content."""
    out = text
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit(""))
    return F.length(F.btrim(out))


def _ends(hand: Column, script: Column, text: Column, parser: Column, confidence: Column, classification: Column) -> dict[str, Column]:
    """What a page ends as: its transcript (script) if it's handwritten and has one."""
    found = hand & script.isNotNull()
    return {
        "text": F.when(found, script).otherwise(text),
        "parser": F.when(found, "transcript").otherwise(parser),
        "confidence": F.when(found, F.lit(0.95)).when(hand, F.least(F.lit(0.4), confidence)).otherwise(confidence),
        "classification": F.when(hand, "handwritten").otherwise(classification),
        "warnings": F.when(hand & ~found, F.array(F.lit("handwritten page without transcript"))).otherwise(F.array().cast("array<string>")),
    }


def routed(pages: DataFrame, fixture: DataFrame) -> DataFrame:
    """The parser that a page ends at and its confidence: handwritten pages take the transcript, or keep at most 0.4 with a warning."""
    hand = handwritten(F.col("name"), F.coalesce("text", F.lit("")))
    joined = scored(pages).join(fixture.select("doc_id", "page", F.col("text").alias("_text")), ["doc_id", "page"], "left").withColumn("hand", hand)
    parser = F.col("parser") if "parser" in pages.columns else F.lit("text_layer")
    ends = _ends(F.col("hand"), F.col("_text"), F.col("text"), parser, F.col("confidence"), F.col("classification"))
    return joined.select("doc_id", "page", *(c.alias(n) for n, c in ends.items()))


def _listed(pages: DataFrame, most: int | None, name: str) -> DataFrame:
    """doc_id, its pages (page, text, warnings, chars) in order, without the texts of those after the first `most`, and the warnings of page 0, which says that the parser failed."""
    kept = F.lit(True) if most is None else F.col("page") <= most
    shown = F.when(F.col("page") > 0, F.struct("page", F.when(kept, F.col("text")).alias("text"), "warnings", F.length(F.coalesce("text", F.lit(""))).alias("chars")))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(shown)).alias(name), F.flatten(F.collect_list(F.when(F.col("page") == 0, F.col("warnings")))).alias(f"{name}_failed"))


def _beside(own: Column, others: Column) -> Column:
    """For each page of an array, in order, the first of the others (by number) that has its number; null without one. Both are merged once."""
    at = last_before(F.transform(others, lambda q, i: F.struct(q["page"].alias("end"), (-i).alias("number"))), F.transform(own, lambda p: p["page"]))
    return F.zip_with(own, at, lambda p, n: let(F.get(others, -n), lambda q: F.when(q["page"] == p["page"], q)))


def intake(files: DataFrame, pages: DataFrame, again: Callable[[DataFrame], DataFrame], transcripts: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, pages (page, text, parser, confidence, classification, warnings; by number), parsers, warnings, markdown of each file (doc_id, name) out of the first parser's rows (doc_id, page, text, warnings; page 0: it failed).

    A document without text goes to the second parser as a whole, one with many sparse pages for these: again() gets doc_id and wanted, the pages' numbers or null for all, and returns rows like `pages`. Of a page read twice the
    longer text stays. Handwritten pages take the transcript (doc_id, page, text). All pages stay, but where `most` is given: those after the first `most` are left out, with a warning. A file that nothing reads has no pages. Nothing but one document's pages
    comes into one row: what a parser read is shuffled once as pages, and once more as documents to meet what the other one read.
    """
    none, texts = F.array().cast("array<string>"), lambda c: F.length(F.btrim(F.coalesce(c, F.lit(""))))
    kind = "array<struct<page:int,text:string,warnings:array<string>,chars:int>>"
    empty = F.array().cast(kind)
    read = files.select("doc_id", "name").join(_listed(pages, most, "first"), "doc_id", "left").withColumn("first", F.coalesce(F.col("first").cast(kind), empty))
    told = read.withColumn("n", F.size("first")).withColumn("chars", F.aggregate("first", F.lit(0).cast("long"), lambda s, p: s + p["chars"]))
    early = lambda c: F.col(c) if most is None else F.filter(c, lambda p: p["page"] <= most)
    per = told.withColumn("sparse", F.transform(F.filter(early("first"), lambda p: texts(p["text"]) < SPARSE), lambda p: p["page"])).withColumn("whole", F.col("chars") < SPARSE)
    kept, few = F.col("n") if most is None else F.least(F.col("n"), F.lit(most)), F.size("sparse")
    per = written(per.withColumn("rescue", ~F.col("whole") & (few > 0) & ((few / kept >= RATIO) | (kept <= FEW))).withColumn("passed", ~F.col("whole") & (few > 0) & ~F.col("rescue")), "intake")
    other = _listed(again(per.where("whole or rescue").select("doc_id", F.when(~F.col("whole"), F.col("sparse")).alias("wanted"))), most, "other")
    scripts = transcripts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("scripts"))
    both = per.join(other, "doc_id", "left").join(scripts, "doc_id", "left").withColumn("other", F.coalesce(F.col("other").cast(kind), empty))
    both = both.withColumn("second", F.size("other") > 0).withColumn("replaced", F.col("whole") & F.col("second"))

    page = lambda p, x, parser: F.struct(p["page"].alias("page"), x["text"].alias("text"), x["warnings"].alias("warnings"), F.lit(parser).alias("parser"))
    longer = lambda p, q: F.when(texts(q["text"]) > texts(p["text"]), page(p, q, "ocr")).otherwise(page(p, p, "text_layer"))
    joint = let(early("first"), lambda ps: F.zip_with(ps, _beside(ps, F.col("other")), longer))
    every = F.when(F.col("replaced"), F.transform(early("other"), lambda p: page(p, p, "ocr"))).when(F.col("second"), joint).otherwise(F.transform(early("first"), lambda p: page(p, p, "text_layer")))

    def ended(p: Column, own: Column) -> Column:
        confidence = F.round(page_confidence(p["text"]) + TIE, 6)
        seen = F.struct(confidence.alias("confidence"), handwritten(F.col("name"), F.coalesce(p["text"], F.lit(""))).alias("hand"), own["text"].alias("script"))

        def of(x: Column) -> Column:
            ends = _ends(x["hand"], x["script"], p["text"], p["parser"], x["confidence"], page_class(x["confidence"]))
            more = ends.pop("warnings")
            own = F.when(ends["parser"] == "transcript", F.array(F.lit("page taken from a transcript"))).otherwise(F.concat(F.coalesce(p["warnings"], none), more))
            return F.struct(p["page"].alias("page"), *(c.alias(n) for n, c in ends.items()), own.alias("warnings"), F.size(more).alias("lost"))

        return let(seen, of)

    joined = both.withColumn("n_read", F.when(F.col("replaced"), F.size("other")).otherwise(F.col("n"))).withColumn("every", every).withColumn("listed", F.zip_with("every", _beside(F.col("every"), F.coalesce("scripts", F.array().cast("array<struct<page:int,text:string>>"))), ended))
    failed = F.array_sort(F.concat(F.coalesce("first_failed", none), F.coalesce("other_failed", none)))
    lost = F.transform(F.filter("listed", lambda x: x["lost"] > 0), lambda x: F.concat(F.lit("page "), x["page"].cast("string"), F.lit(" is handwritten and has no transcript")))
    notes = F.array_compact(F.array(
        *([] if most is None else [F.when(F.col("n_read") > most, F.concat("n_read", F.lit(f" pages, of which the first {most} are kept")))]),
        F.when(F.col("passed"), F.concat(F.size("sparse"), F.lit(" sparse pages of "), kept, F.lit(" stay as they are"))),
    ))
    used = F.array_compact(F.array(F.when(~F.col("replaced"), "text_layer"), F.when(F.col("second"), "ocr"), F.when(F.exists("listed", lambda x: x["parser"] == "transcript"), "transcript")))
    return joined.select(
        "doc_id",
        F.transform("listed", lambda x: F.struct(*(x[c].alias(c) for c in ("page", "text", "parser", "confidence", "classification", "warnings")))).alias("pages"),
        used.alias("parsers"),
        F.concat(failed, notes, lost).alias("warnings"),
        F.array_join(F.transform("listed", lambda x: F.concat(F.lit("## Page "), x["page"].cast("string"), F.lit("\n\n"), F.btrim(F.coalesce(x["text"], F.lit(""))))), "\n\n").alias("markdown"),
    )
