"""Typed facts from title texts, each with the place it was found at.

Rules are data: ordered tables of patterns. Every fact is an array expression over its document's row, so nothing is shuffled; long rows
(doc_id, ordinal, ...) are made of them for queries, and one nested row a document for the sink.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.spans import MATCHES, around, blocks, first_by, first_span, let, match_spans
from ..functions.text import first_match, holds, may_hold, parsed_date

CAPS = {"parties": 12, "chain": 20, "liens": 30, "easements": 20, "restrictions": 15, "requirements": 12, "exceptions": 15}
BEFORE_CHAIN, BEFORE_LIEN, AFTER_LIEN, AFTER_EASEMENT = 220, 240, 120, 220
SNIPPET = 200
#: What recording references, mentions of easements, dates and amounts can begin with: a look at one character, or few, spares most places the rest.
_BEGIN = "(?=[bdflrvi0-9])(?=[bdflrv][eio]|ins|[0-9]{8})"
_BEGINS = {rules.EASEMENT_TRIGGER: "(?=[eri][ain][sg])", rules.EFFECTIVE_DATE[0]: "(?=[ec][fo])", rules.POLICY_AMOUNT: "(?=[aplo][mrow])", rules.PARTIES[1][1]: "(?=t)"}
#: What a parcel's number can't do without: the pattern has dots that may be absent.
_PARCEL_WORDS = ["apn", "a.pn", "ap.n", "a.p.n", "parcel", "pin", "tax"]
#: The same of the headings of Schedule B's sections: texts that name a schedule only aren't searched.
_HEADING_WORDS = {rules.SCHEDULE_ONE: ["requirement", "section"], rules.SCHEDULE_TWO: ["exception", "section"]}


def _any_case(pattern: str, flags: str = "") -> str:
    """The pattern in any case, with a look at its beginning before word bounds and alternatives, where that is told."""
    first = re.match(r"\\b([A-Za-z]{2,})(?![A-Za-z?*+{])", pattern) or re.match(r"\\b\(\?:([A-Za-z|]+)\)", pattern)
    if pattern in _BEGINS:
        return f"(?i{flags}){_BEGINS[pattern]}(?:{pattern})"
    if first is None or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return f"(?i{flags}){pattern}"
    heads = "".join(sorted({w[0].lower() for w in first[1].split("|")}))
    return f"(?i{flags})(?=[{heads}]){pattern}"


def _first(items: Column, cap: int | None) -> Column:
    """The first `cap` items of an array; None: all of them."""
    return items if cap is None else F.slice(items, 1, cap)


def _absent(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _gated(low: Column, pattern: str, found: Column, words: list[str] | None = None) -> Column:
    """What is found, null where the text (low: in lower case) lacks all the words that the pattern can't do without: it isn't searched then."""
    may = may_hold(low, pattern, words)
    return found if may is None else F.when(may, found)


def _with_low(text: Column, low: Column | None, body: Callable[[Column], Column]) -> Column:
    """body of the text in lower case, which is made once if it isn't given."""
    return let(F.lower(text), body) if low is None else body(low)


def _group(text: Column, pattern: str, group: int = 1, low: Column | None = None, words: list[str] | None = None) -> Column:
    """A group of the first match in any case; null if it isn't there. The text is searched only if it has a word that the pattern can't do without."""
    found = F.regexp_extract(text, _any_case(pattern), group)
    return let(_with_low(text, low, lambda x: _gated(x, pattern, found, words)), _absent)


def squeezed(text: Column) -> Column:
    """White space as one space each; single spaces are left as they are."""
    return F.btrim(F.regexp_replace(text, r"(?=\s)(?:\s{2,}|[^ ])", " "))


def clean_name(name: Column) -> Column:
    """White space squeezed, what follows the name of a county or state left out, and punctuation around it."""
    return F.btrim(F.regexp_replace(F.regexp_replace(name, r"\s+", " "), _any_case(rules.NO_PLACE), ""), F.lit(" ,.;:-"))


def is_name_like(name: Column) -> Column:
    return F.length(name).between(3, 100) & ~name.rlike(r"^\p{Ll}") & ~name.rlike(_any_case(rules.NO_NAME))


def looks_entity(name: Column) -> Column:
    return name.rlike(_any_case(rules.ENTITY))


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").cast("decimal(18,2)")


def page_at(text: Column, offset: Column) -> Column:
    """The page that a place is on, by the last heading before it; 1 without any."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.substring(text, F.lit(1), offset), F.lit("(?m)" + rules.PAGE_HEADING), F.lit(1)), F.lit(-1)).cast("int"), F.lit(1))


def source(page: Column, start: Column, end: Column, snippet: Column) -> Column:
    """Where a fact is from. Its document is the row's."""
    return F.struct(page.cast("int").alias("page"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(snippet, 1, SNIPPET).alias("snippet"))


def whole_source(text: Column) -> Column:
    """The head of a document: what stands for facts that are the document itself."""
    return source(F.lit(1), F.lit(0), F.least(F.length(text), F.lit(SNIPPET)), _absent(F.substring(squeezed(text), 1, SNIPPET)))


def _labelled(text: Column, patterns: list[str], value: Callable[[Column, str], Column], confidence: float, flags: str = "", low: Column | None = None, words: list[str] | None = None) -> Column:
    """(value, confidence, source) of the first pattern, in order, that is found; null if none is, or if it has no value."""

    def one(x: Column, pattern: str) -> Column:
        p = _any_case(pattern, flags)
        return let(_gated(x, pattern, first_span(text, p), words), lambda m: F.when(m.isNotNull(), F.struct(value(m["match"], p).alias("value"), F.lit(confidence).alias("confidence"), source(page_at(text, m["start"]), m["start"], m["end"], m["match"]).alias("source"))))

    return let(_with_low(text, low, lambda x: F.coalesce(*(one(x, p) for p in patterns))), lambda x: F.when(x["value"].isNotNull(), x))


def effective_date(text: Column, low: Column | None = None) -> Column:
    """(value, confidence, source): the commitment's date; null if what is there is none."""
    return _labelled(text, rules.EFFECTIVE_DATE, lambda m, p: parsed_date(F.regexp_extract(m, p, 1)), 0.85, low=low)


def proposed_insured(text: Column, low: Column | None = None) -> Column:
    def name(match: Column, pattern: str) -> Column:
        return let(clean_name(F.regexp_extract(match, pattern, 1)), lambda n: F.when(is_name_like(n), n))

    return _labelled(text, rules.INSURED, name, 0.8, low=low)


def estate(text: Column, low: Column | None = None) -> Column:
    """(value, confidence, source): the estate insured, next to its label only."""
    return _labelled(text, rules.ESTATE, lambda m, p: first_match(F.regexp_extract(m, p, 1), rules.ESTATES, "other"), 0.85, "m", low)


def money(text: Column, low: Column | None = None) -> Column:
    """(value, confidence, source): a labelled amount, with or without a dollar sign, at 0.85; else the first amount in dollars of a text of up to 6000 characters, at 0.45."""
    amount = lambda m, p: number(F.regexp_extract(m, p, 1))
    stray = lambda x: F.when((F.length(text) <= 6000) & F.contains(text, F.lit("$")), _labelled(text, [rules.AMOUNT], amount, 0.45, low=x))
    # a label without an amount doesn't match, so what is found has a value
    labelled = lambda x: _labelled(text, [rules.POLICY_AMOUNT], amount, 0.85, low=x, words=["amount"])
    return _with_low(text, low, lambda x: F.coalesce(labelled(x), stray(x)))


def parties(text: Column, cap: int | None = CAPS["parties"], low: Column | None = None) -> Column:
    """array of (name, role, is_entity): all matches in the order of rules, then of the text; the first of each name and role stays."""

    none = F.array().cast("array<string>")

    def rule(x: Column, role: str, pattern: str, groups: int) -> Column:
        p = _any_case(pattern)
        every = F.regexp_extract_all(text, F.lit(p), F.lit(1 if groups == 1 else 0))
        # a match holds its own groups, so the text is searched once for all of them
        names = every if groups == 1 else F.flatten(F.transform(every, lambda m: F.array(*(F.regexp_extract(m, p, g + 1) for g in range(groups)))))
        return F.transform(F.coalesce(_gated(x, pattern, names), none), lambda n: F.struct(clean_name(n).alias("name"), F.lit(role).alias("role")))

    every = _with_low(text, low, lambda x: F.concat(*(rule(x, role, p, 2 if "and wife" in p else 1) for role, p in rules.PARTIES)))
    first = first_by(F.filter(every, lambda x: is_name_like(x["name"])), lambda x: F.concat(F.lower(x["name"]), F.lit("|"), x["role"]))
    return F.transform(_first(first, cap), lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role"), looks_entity(x["name"]).alias("is_entity")))


def _names(people: Column, roles: tuple[str, ...]) -> Column:
    return F.transform(F.filter(people, lambda p: p["role"].isin(*roles)), lambda p: p["name"])


def _or_else(names: Column, unknown: str) -> Column:
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(unknown)))


def references(text: Column) -> Column:
    """array of (start, end, match, book, page, number, key): each recorded reference. Bare dated numbers have no group and so share the empty key."""
    p = _any_case(f"{_BEGIN}(?:{rules.RECORDING})")

    def whole(m: Column) -> Column:
        book, page, number_ = (_absent(F.regexp_extract(m["match"], p, g)) for g in (1, 2, 3))
        key = F.lower(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (book, page, number_))))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), book.alias("book"), page.alias("page"), number_.alias("number"), key.alias("key"))

    return F.transform(match_spans(text, p), whole)


def _with(item: Column, names: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*(item[n].alias(n) for n in names), *(v.alias(k) for k, v in more.items()))


_REF = ("start", "end", "match", "book", "page", "number", "key")


def chain(doc_type: Column, people: Column, text: Column, cap: int | None = CAPS["chain"], found: Column | None = None) -> Column:
    """array of (instrument, grantor, grantee, book, page, number, source): a deed or mortgage itself, then a link for each distinct reference with an
    instrument's name before it; a key is spent by its first reference, whether that has one or not. A link has the first three names of a side, or all with the cap None. found: references(text), if they're there."""
    recorded = references(text) if found is None else found
    grantors = _or_else(_names(people, ("grantor", "borrower")), "Unknown grantor")
    grantees = _or_else(_names(people, ("grantee", "lender", "trustee", "beneficiary", "owner")), "Unknown grantee")
    none = F.lit(None).cast("string")
    own = F.struct(doc_type.alias("instrument"), grantors.alias("grantor"), grantees.alias("grantee"), none.alias("book"), none.alias("page"), none.alias("number"), whole_source(text).alias("source"))

    def named(window: Column, group: int, unknown: str) -> Column:
        found = F.transform(F.regexp_extract_all(window, F.lit(rules.CONVEYED), F.lit(group)), clean_name)
        return _first(_or_else(F.filter(found, is_name_like), unknown), None if cap is None else 3)

    def link(r: Column) -> Column:
        return F.struct(
            r["instrument"].alias("instrument"),
            named(r["window"], 1, "Unknown grantor (per recording reference)").alias("grantor"),
            named(r["window"], 2, "Unknown grantee (per recording reference)").alias("grantee"),
            r["book"].alias("book"), r["page"].alias("page"), r["number"].alias("number"),
            source(F.lit(1), r["start"], r["end"], r["match"]).alias("source"),
        )

    links = F.transform(_linked(text, recorded, cap), link)
    itself = F.array_compact(F.array(F.when(doc_type.isin(*rules.SELF_LINKS) & (F.size(people) > 0), own)))
    return _first(F.concat(itself, links), cap)


def _linked(text: Column, recorded: Column, cap: int | None) -> Column:
    """The first `cap` of the distinct references that have an instrument's name before them, with it and what is before them."""

    def typed(pieces: Column, r: Column) -> Column:
        window = around(pieces, r["start"], r["end"], BEFORE_CHAIN, 0)
        return let(window, lambda w: _with(r, _REF, window=w, instrument=first_match(w, rules.INSTRUMENTS, None)))

    every = let(blocks(text), lambda pieces: F.transform(first_by(recorded, lambda r: r["key"]), lambda r: typed(pieces, r)))
    return _first(F.filter(every, lambda r: r["instrument"].isNotNull()), cap)


def instruments(doc_type: Column, text: Column, low: Column | None = None, cap: int | None = CAPS["chain"]) -> Column:
    """The instruments of the chain's links alone: names of parties aren't searched but where they tell whether a deed is a link itself."""
    itself = F.when(doc_type.isin(*rules.SELF_LINKS), F.when(F.size(parties(text, low=low)) > 0, F.array(doc_type)))
    links = F.transform(_linked(text, references(text), cap), lambda r: r["instrument"])
    return _first(F.concat(F.coalesce(itself, F.array().cast("array<string>")), links), cap)


def liens(doc_type: Column, people: Column, text: Column, cap: int | None = CAPS["liens"], found: Column | None = None) -> Column:
    """array of (lien_type, status, amount, creditor, debtor, book, page, number, source): a mortgage or deed of trust itself, then references with a lien around
    them; here a key is spent by a reference that has one. found: references(text), if they're there."""
    recorded = references(text) if found is None else found
    of = lambda roles, unknown: F.coalesce(F.get(_names(people, roles), F.lit(0)), F.lit(unknown))
    none = F.lit(None).cast("string")

    def lien(kind: Column, status: Column, amount: Column, creditor: Column, debtor: Column, book: Column, page: Column, number_: Column, where: Column) -> Column:
        return F.struct(kind.alias("lien_type"), status.alias("status"), amount.alias("amount"), creditor.alias("creditor"), debtor.alias("debtor"), book.alias("book"), page.alias("page"), number_.alias("number"), where.alias("source"))

    own = lien(doc_type, F.lit("open"), number(_group(text, rules.AMOUNT)), of(("lender", "beneficiary", "trustee"), "Unknown creditor"), of(("borrower", "grantor", "trustor"), "Unknown debtor"), none, none, none, whole_source(text))

    def typed(pieces: Column, r: Column) -> Column:
        return let(around(pieces, r["start"], r["end"], BEFORE_LIEN, AFTER_LIEN), lambda w: _with(r, _REF, window=w, lien_type=first_match(w, rules.LIENS, None)))

    def held(pieces: Column, r: Column) -> Column:
        w = r["window"]
        status = F.when(let(F.lower(w), lambda x: holds(x, rules.RELEASED)), "released").otherwise("open")
        creditor = F.coalesce(clean_name(_group(w, rules.IN_FAVOR_OF)), F.lit("Unknown creditor (per reference)"))
        debtor = F.coalesce(clean_name(_group(w, rules.EXECUTED_BY)), F.lit("Unknown debtor (per reference)"))
        where = source(F.lit(1), r["start"], r["end"], around(pieces, r["start"], r["end"], 60, 60))
        return lien(r["lien_type"], status, number(_group(w, rules.AMOUNT)), creditor, debtor, r["book"], r["page"], r["number"], where)

    def every(pieces: Column) -> Column:
        with_lien = F.filter(F.transform(recorded, lambda r: typed(pieces, r)), lambda r: r["lien_type"].isNotNull())
        return F.transform(_first(first_by(with_lien, lambda r: r["key"]), cap), lambda r: held(pieces, r))

    itself = F.array_compact(F.array(F.when(doc_type.isin(*rules.SELF_LIENS), own)))
    return _first(F.concat(itself, let(blocks(text), every)), cap)


def _mentioned(text: Column, trigger: str, after: int, cap: int | None, low: Column | None = None) -> Column:
    """array of (start, end, window): the text around each mention, the first of each beginning of 80 characters."""

    def mention(pieces: Column, m: Column) -> Column:
        return let(squeezed(around(pieces, m["start"], m["end"], 180, after)), lambda w: F.struct(m["start"].alias("start"), m["end"].alias("end"), w.alias("window")))

    spans = _with_low(text, low, lambda x: F.coalesce(_gated(x, trigger, match_spans(text, _any_case(trigger))), F.array().cast(MATCHES)))
    every = let(spans, lambda ms: let(F.when(F.size(ms) > 0, blocks(text)), lambda pieces: F.transform(ms, lambda m: mention(pieces, m))))
    return _first(first_by(every, lambda m: F.lower(F.substring(m["window"], 1, 80))), cap)


def _mentions(text: Column, trigger: str, types: list[tuple[str, str]], after: int, longest: int, cap: int | None, more: Callable[[Column], dict[str, Column]], low: Column | None = None) -> Column:
    """array of (type, description, instrument, source, ...) of the mentions."""

    def fact(m: Column) -> Column:
        w = m["window"]
        group = lambda x, g: _absent(F.regexp_extract(x, _any_case(rules.RECORDING), g))
        recorded = F.regexp_extract(w, _any_case(f"{_BEGIN}(?:{rules.RECORDING})"), 0)
        instrument = let(recorded, lambda x: F.coalesce(group(x, 3), F.concat(F.lit("Book "), group(x, 1), F.lit(" Page "), group(x, 2))))
        return F.struct(first_match(w, types, "other").alias("type"), F.substring(w, 1, longest).alias("description"), instrument.alias("instrument"), source(F.lit(1), m["start"], m["end"], w).alias("source"), *(v.alias(k) for k, v in more(w).items()))

    return F.transform(_mentioned(text, trigger, after, cap, low), fact)


def easements(text: Column, cap: int | None = CAPS["easements"], low: Column | None = None) -> Column:
    """array of (type, description, instrument, source, holder)."""

    def holder(w: Column) -> dict[str, Column]:
        return {"holder": let(clean_name(_group(w, rules.HELD_BY)), lambda n: F.when(is_name_like(n), n))}

    return _mentions(text, rules.EASEMENT_TRIGGER, rules.EASEMENTS, AFTER_EASEMENT, 280, cap, holder, low)


def easement_types(text: Column, cap: int | None = CAPS["easements"], low: Column | None = None) -> Column:
    """The types of the easements alone."""
    return F.transform(_mentioned(text, rules.EASEMENT_TRIGGER, AFTER_EASEMENT, cap, low), lambda m: first_match(m["window"], rules.EASEMENTS, "other"))


def restrictions(text: Column, cap: int | None = CAPS["restrictions"], low: Column | None = None) -> Column:
    """array of (type, description, instrument, source, discriminatory)."""
    return _mentions(text, rules.RESTRICTION_TRIGGER, rules.RESTRICTIONS, 240, 320, cap, lambda w: {"discriminatory": let(F.lower(w), lambda x: holds(x, rules.DISCRIMINATORY))}, low)


def bullets(section: Column, most: int | None = 20) -> Column:
    """array of (key, text): the enumerated items of a section, each up to the next bullet, squeezed; of 12 or more characters, cut at 600."""
    group = lambda g: F.regexp_extract_all(section, F.lit(f"(?ims){rules.BULLET}"), F.lit(g))
    items = F.zip_with(group(1), group(2), lambda k, t: F.struct(F.lower(k).alias("key"), F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" .;:-")).alias("text")))
    long = F.filter(items, lambda x: F.length(x["text"]) >= 12)
    return F.transform(_first(long, most), lambda x: F.struct(x["key"].alias("key"), F.substring(x["text"], 1, 600).alias("text")))


def _schedule(text: Column, pattern: str, fact: Callable[[Column, Column], Column], low: Column | None = None) -> Column:
    """fact(body, page and span) of the first section that the pattern finds; an empty array without any."""
    p = f"(?is){pattern}"

    def of(m: Column) -> Column:
        return let(F.struct(F.regexp_extract(m["match"], p, 1).alias("body"), page_at(text, m["start"]).alias("page"), m["start"].alias("start"), m["end"].alias("end")), lambda s: fact(s["body"], s))

    return let(_with_low(text, low, lambda x: _gated(x, pattern, first_span(text, p), _HEADING_WORDS[pattern])), lambda m: F.when(m.isNotNull(), of(m)))


def requirements(text: Column, cap: int | None = CAPS["requirements"], low: Column | None = None) -> Column:
    """array of (id, text, category, addressed_to, source): Schedule B, section I, under any of its headings."""

    def facts(body: Column, at: Column) -> Column:
        return F.transform(
            bullets(body, cap),
            lambda x: F.struct(F.concat(F.lit("B-I-"), x["key"]).alias("id"), x["text"].alias("text"), first_match(x["text"], rules.REQUIREMENTS, "other").alias("category"), first_match(x["text"], rules.ADDRESSEES, "other").alias("addressed_to"), source(at["page"], at["start"], at["end"], x["text"]).alias("source")),
        )

    return _some(_schedule(text, rules.SCHEDULE_ONE, facts, low), "array<struct<id:string,text:string,category:string,addressed_to:string,source:struct<page:int,start:int,end:int,snippet:string>>>")


def exceptions(text: Column, cap: int | None = CAPS["exceptions"], low: Column | None = None) -> Column:
    """array of (id, text, category, is_standard, source): Schedule B, section II. Standard are those with one of the printed phrases, or under such a heading."""

    def last(head: Column, word: str) -> Column:
        """How far from the end the last heading is; null without any."""
        return F.when(F.contains(head, F.lit(f"{word} exception")), F.length(F.substring_index(head, f"{word} exception", -1)))

    def facts(body: Column, at: Column) -> Column:
        def one(x: Column) -> Column:
            place = F.instr(F.lower(body), F.lower(F.substring(x["text"], 1, 40)))
            head = F.lower(F.substring(body, F.lit(1), F.greatest(place - 1, F.lit(0))))
            headed = let(head, lambda h: last(h, "standard").isNotNull() & (last(h, "specific").isNull() | (last(h, "standard") < last(h, "specific"))))
            standard = F.lower(x["text"]).rlike(rules.STANDARD_PHRASES) | headed
            return F.struct(F.concat(F.lit("B-II-"), x["key"]).alias("id"), x["text"].alias("text"), first_match(x["text"], rules.EXCEPTIONS, "other").alias("category"), standard.alias("is_standard"), source(at["page"], at["start"], at["end"], x["text"]).alias("source"))

        return F.transform(bullets(body, cap), one)

    return _some(_schedule(text, rules.SCHEDULE_TWO, facts, low), "array<struct<id:string,text:string,category:string,is_standard:boolean,source:struct<page:int,start:int,end:int,snippet:string>>>")


def _some(items: Column, kind: str) -> Column:
    return F.coalesce(items, F.array().cast(kind))


def legal_description(text: Column, low: Column | None = None) -> Column:
    """(type, text, lot, block, subdivision, apn) after the first anchor, in order, whose up to 3000 characters, up to the next heading, read like one; the first 2000 are kept. Null without any."""

    def candidate(x: Column, anchor: str) -> Column:
        # headings are told by white space of any length: the body is cut before it is squeezed
        body = F.get(F.split(F.regexp_extract(text, rf"(?is){anchor}(.{{40,3000}})", 1), _any_case(rules.LEGAL_END), 2), F.lit(0))
        found = let(F.btrim(squeezed(body), F.lit(" .,;:-")), lambda c: F.when(let(F.lower(c), _reads_like_one), F.substring(c, 1, 2000)))
        return _gated(x, anchor.replace("(?=", "(?:"), found)

    def described(x: Column, c: Column, t: Column) -> Column:
        surveyed = holds(t, r"\b(?:section|sec\.?)\s+\d+") & holds(t, r"\btownship|\btwp\b")
        kind = F.when(holds(t, r"condominium|\bunit\s+\d+\b"), "condominium").when(surveyed, "section_township_range").when(holds(t, r"\blot|block|plat|subdivision|tract\b"), "platted").otherwise("metes_and_bounds")
        pick = lambda p: F.btrim(_group(c, p, low=t), F.lit(" ,.;"))
        parcel = F.btrim(_group(text, rules.PARCEL, low=x, words=_PARCEL_WORDS), F.lit(" ,.;"))
        return F.struct(kind.alias("type"), c.alias("text"), pick(rules.LOT).alias("lot"), pick(rules.BLOCK).alias("block"), pick(rules.SUBDIVISION).alias("subdivision"), parcel.alias("apn"))

    def of(x: Column) -> Column:
        return let(F.coalesce(*(candidate(x, a) for a in rules.LEGAL_ANCHORS)), lambda c: F.when(c.isNotNull(), let(F.lower(c), lambda t: described(x, c, t))))

    return _with_low(text, low, of)


def _reads_like_one(t: Column) -> Column:
    boilerplate = t.startswith("of the property") | F.contains(t, F.lit("if the legal description is too lengthy")) | F.substring(t, 1, 60).rlike("see attached|see exhibit")
    return (F.length(t) >= 40) & ~boilerplate & t.rlike(rules.LEGAL_WORDS)


VESTED = ("owner", "grantee", "buyer")
SCALARS = ("effective_date", "proposed_insured", "estate_or_interest", "policy_amount", "legal_description")
LISTS = ("parties", "vesting", "chain_of_title", "open_liens", "schedule_b_requirements", "schedule_b_exceptions", "easements", "restrictions", "taxes", "survey_matters")


def title_documents(docs: DataFrame) -> DataFrame:
    """One nested row a document (doc_id, doc_type, text): all that rules find in it, of whatever number, with warnings. Row-local.

    Taxes and survey matters are for models and fixtures to fill; rules find none.
    """
    t, kind = F.col("text"), F.col("doc_type")
    low = F.col("low")
    texts = docs.select("doc_id", "doc_type", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    found = texts.withColumn("parties", parties(t, None, low)).withColumn("recorded", references(t))
    none = F.array().cast("array<struct<kind:string,parcel:string>>")
    out = found.select(
        "doc_id", "doc_type", F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"(?m)^## Page "))).alias("page_count"),
        effective_date(t, low).alias("effective_date"), proposed_insured(t, low).alias("proposed_insured"), estate(t, low).alias("estate_or_interest"), money(t, low).alias("policy_amount"), legal_description(t, low).alias("legal_description"),
        "parties", F.filter("parties", lambda p: p["role"].isin(*VESTED)).alias("vesting"),
        chain(kind, F.col("parties"), t, None, F.col("recorded")).alias("chain_of_title"), liens(kind, F.col("parties"), t, None, F.col("recorded")).alias("open_liens"),
        requirements(t, None, low).alias("schedule_b_requirements"), exceptions(t, None, low).alias("schedule_b_exceptions"), easements(t, None, low).alias("easements"), restrictions(t, None, low).alias("restrictions"),
        none.alias("taxes"), none.alias("survey_matters"),
        holds(low, rules.STAMPED).alias("has_recording_stamp"), F.when(holds(low, rules.NOTARIZED), True).alias("notarized"),
    )
    bare = (F.col("doc_type") == "title_commitment") & F.coalesce("effective_date.value", F.lit(None)).isNull() & F.col("proposed_insured").isNull() & F.col("estate_or_interest").isNull()
    warnings = F.array_compact(F.array(F.lit("Extracted by rules: neither a model's answer nor a labelled document was at hand."), F.when(bare, "Schedule A fields could not be extracted from this commitment.")))
    return out.withColumn("warnings", warnings)


def composable(docs: DataFrame) -> DataFrame:
    """doc_id, effective_date, proposed_insured, policy_amount, instruments, easements of each document (doc_id, doc_type, text): those of title_documents() as plain values, for which nothing else is searched. Row-local."""
    t, low = F.col("text"), F.col("low")
    texts = docs.select("doc_id", "doc_type", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    return texts.select(
        "doc_id", effective_date(t, low)["value"].cast("string").alias("effective_date"), proposed_insured(t, low)["value"].alias("proposed_insured"), money(t, low)["value"].cast("double").alias("policy_amount"),
        instruments(F.col("doc_type"), t, low, None).alias("instruments"), easement_types(t, None, low).alias("easements"),
    )


def listed(docs: DataFrame, facts: Column) -> DataFrame:
    """doc_id, ordinal and the fields of each of a document's facts: an array expression over its text."""
    return docs.select("doc_id", F.posexplode(facts).alias("ordinal", "f")).select("doc_id", "ordinal", "f.*")


def merged(first: DataFrame, second: DataFrame, scalars: list[str], lists: list[str], key: str = "doc_id") -> DataFrame:
    """Field by field the first table's value, where it is there or not empty, else the second's; a warning is always added."""
    other = second.select(key, *(F.col(c).alias(f"_{c}") for c in (*scalars, *lists)))
    joined = first.join(other, key, "left")
    values = [F.coalesce(c, f"_{c}").alias(c) for c in scalars] + [F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c)).otherwise(F.coalesce(f"_{c}", F.col(c))).alias(c) for c in lists]
    return joined.select(key, *values, F.lit("merged from two extractions").alias("warning"))


def composed(documents: DataFrame, fixture: DataFrame, ruled: DataFrame, model: DataFrame, scalars: list[str], lists: list[str], key: str = "doc_id") -> DataFrame:
    """A row a document of three extractions of it, field by field, with where each value is from: key, the fields, `chosen` (a map of field to `fixture`, `rules` or `model`), `sources` (those that the document has), `agreed`.

    A labelled document goes first, then rules, and a model fills what both leave; without a label the model goes before rules. Scalars that are null and lists that are empty give way. agreed: whether the first two of a
    document's sources that have scalars differ in one of them at most, a null beside a value being a difference; null of a document with one source. fixture, ruled and model each have key and all the fields.
    """
    sides = {"fixture": fixture, "rules": ruled, "model": model}
    rows = documents.select(key).distinct()
    for name, side in sides.items():
        rows = rows.join(side.select(key, F.struct(*scalars, *lists).alias(name)).dropDuplicates([key]), key, "left")
    labelled = F.col("fixture").isNotNull()
    order = {True: ("fixture", "rules", "model"), False: ("model", "rules")}

    def there(side: str, field: str) -> Column:
        c = F.col(side)[field]
        return c.isNotNull() if field in scalars else F.coalesce(F.size(c) > 0, F.lit(False))

    def first(field: str, what: Callable[[str], Column], names: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.when(there(n, field), what(n)) for n in names))

    def by_label(f: Callable[[tuple[str, ...]], Column]) -> Column:
        return F.when(labelled, f(order[True])).otherwise(f(order[False]))

    def value(field: str) -> Column:
        found = by_label(lambda names: first(field, lambda n: F.col(n)[field], names))
        return (found if field in scalars else F.coalesce(found, F.filter(F.coalesce(*(F.col(n)[field] for n in sides)), lambda x: F.lit(False)))).alias(field)

    origin = lambda field: by_label(lambda names: first(field, F.lit, names))
    chosen = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f).alias("field"), origin(f).alias("from")) for f in (*scalars, *lists))), lambda e: e["from"].isNotNull()))
    agree = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), reasonable({f: F.col(a)[f] for f in scalars}, {f: F.col(b)[f] for f in scalars}))
    agreed = F.when(labelled, F.coalesce(agree("fixture", "rules"), agree("fixture", "model"))).otherwise(agree("model", "rules"))
    had = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), n) for n in sides)))
    return rows.select(key, *map(value, (*scalars, *lists)), chosen.alias("chosen"), had.alias("sources"), agreed.alias("agreed"))


def reasonable(gold: dict[str, Column], produced: dict[str, Column]) -> Column:
    """At most one of the fields differs."""
    return reduce(lambda a, b: a + b, (F.when(gold[k].eqNullSafe(produced[k]), 0).otherwise(1) for k in gold)) <= 1
