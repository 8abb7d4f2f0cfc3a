"""Extraction queries on title texts composed of orders; what is in them follows from the orders' numbers, which is what the SQL tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import first_match, first_match_sql, parsed_date
from ..operators import extract
from ..sources.tables import page_blocks, spread, table, transcript_page

# Texts are SQL that either engine reads; k is the order's number, d its date.
_BUYER = "(CASE k % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Jane Roe' WHEN 2 THEN 'Omar Diaz' ELSE 'Ivy Stone' END)"
_SELLER = "(CASE k % 5 WHEN 0 THEN 'Carl Moss' WHEN 1 THEN 'Dora Finch' WHEN 2 THEN 'Evan Holt' WHEN 3 THEN 'Faye Marsh' ELSE 'Gus Lund' END)"
_LENDER = "(CASE k % 3 WHEN 0 THEN 'First Bank' WHEN 1 THEN 'Union Lending Company' ELSE 'Acme Capital' END)"
_NL = "chr(10)"


def _fill(n: int, times: int = 15) -> str:
    """Text that has nothing in it, different by its number, longer than any window."""
    return f"repeat('Nothing stands in part {n}. ', {times})"


_DMY = "concat(month(d), '{0}', day(d), '{0}', year(d))"
_MONTH = "(CASE month(d) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split(), 1)) + " END)"
_DATES = f"""concat('é head ', CASE WHEN k % 7 = 0 THEN 'Effective Date: 13/45/1999' WHEN k % 5 = 0 THEN concat('Effective Date: ', {_DMY.format("/")}) WHEN k % 5 = 1 THEN concat('EFFECTIVE DATE ', {_DMY.format("-")})
  WHEN k % 5 = 2 THEN concat('1. Commitment  Date: ', {_MONTH}, ' ', day(d), ', ', year(d)) WHEN k % 5 = 3 THEN concat('Date of Policy: ', substring({_MONTH}, 1, 3), '  ', day(d), ', ', year(d)) ELSE 'Dated some day' END, '. End.')"""
_INSURED = f"""concat(CASE k % 4 WHEN 0 THEN concat('Proposed Insured: ', {_BUYER}) WHEN 1 THEN concat('named  insured: ', {_BUYER}) WHEN 2 THEN concat('PROPOSED INSURED ', {_BUYER}, ' County of Wayne') ELSE 'Proposed Insured: closing policy' END, {_NL}, 'Named Insured: Nobody Else', {_NL})"""
_ESTATE = f"""CASE k % 6 WHEN 0 THEN concat('Head', {_NL}, '2. The estate or interest in the Land is: Fee  Simple') WHEN 1 THEN 'Estate or Interest in the Land described in this Commitment is a Leasehold' WHEN 2 THEN 'A Life Estate interest is held.'
  WHEN 3 THEN concat('Title is vested in ', {_BUYER}, ' as Fee Simple') WHEN 4 THEN 'A utility easement of an estate.' ELSE concat('3. Type of Estate: Easement', {_NL}) END"""
_MONEY = f"""CASE k % 5 WHEN 0 THEN concat('Policy Amount $', k, ',500.00 and a fee of $3.00') WHEN 1 THEN concat('AMOUNT OF INSURANCE: ', k, ',000') WHEN 2 THEN concat('A fee of $ ', k, '.25.') WHEN 3 THEN concat({_fill(1, 240)}, 'A fee of $', k)
  ELSE concat({_fill(1, 240)}, 'Owner''s Policy Amount: $', k, '.75 and $1.00') END"""
_WIFE = "(k % 2 = 0)"
_MANY = [f"{a}{b}" for a in ("Ab", "Bo", "Cy") for b in ("da", "el", "ir", "on", "us")]
_PARTIES = f"""concat('Deed by ', {_SELLER}, CASE WHEN {_WIFE} THEN ' and wife Ida Moss' ELSE '' END, '  of Wayne; to ', {_BUYER}, ', all, TO ', upper({_BUYER}), ', again. Borrower: Omar Diaz; Lender: ', {_LENDER}, '; Trustee: Gus Lund; vested in: ', {_BUYER}, '; vested in the facts;',
  CASE WHEN k % 50 = 0 THEN '{"".join(f" to {n}, one" for n in _MANY)}' ELSE '' END)"""
_REF = f"""CASE k % 6 WHEN 0 THEN concat('Deed Book ', k, ' of Official Records, at Page P-', k) WHEN 1 THEN concat('BOOK {{0}}', k, ', PAGE ', k + 1) WHEN 2 THEN concat('vol ', k, ' ; Folio ', k + 1) WHEN 3 THEN concat('Instrument No. ', year(d), '/', k) WHEN 4 THEN concat('Reception  #R-', k) ELSE concat('19960105-', 100000 + k) END""".replace("{0}", "")
_REFS = f"concat('é at ', {_REF}, ' it is. ', {_fill(1)}, 'File Number X', k)"
_TYPES = "(CASE k % 4 WHEN 0 THEN 'title_commitment' WHEN 1 THEN 'warranty_deed' WHEN 2 THEN 'mortgage' ELSE 'survey' END)"
_CHAIN = f"""concat('A Special Warranty Deed by ', {_SELLER}, {_NL}, ' to ', {_BUYER}, ', her heirs; recorded in Book ', k, ' of Plats, Page ', k + 1, '. ', {_fill(1)}, 'A Mortgage, Instrument No. ', year(d), '-', k, '; ', {_fill(2)}, 'a plat in Book Z', k, ', Page 5; ', {_fill(3)}, 'a Deed of Trust, BOOK ', k, ', PAGE ', k + 1, '.')"""
_LIENS = f"""concat(CASE WHEN k % 2 = 0 THEN concat('Lender: ', {_LENDER}, '; Borrower: Omar Diaz; ') ELSE '' END, {_fill(1)}, 'Mortgage executed by ', {_SELLER}, '; in favor of ', {_LENDER}, '; for $ ', k, ',100.50 in Book ', k, ', Page 7', CASE WHEN k % 3 = 0 THEN ', since SATISFIED' ELSE '' END, '; ', {_fill(2)},
  'a Federal Tax Lien, Instrument No. T', k, '; ', {_fill(3)}, 'a survey in Book ', k, ', Page 9; ', {_fill(4)}, 'UCC-1, File # ', k, '; ', {_fill(5)}, 'a survey in Book ', k, ', Page 7; ', {_fill(6)}, 'a HOA lien in Book ', k, ', Page 9')"""
_EASE1 = f"concat('a Utility  easement in favor of ', {_LENDER}, '; Instrument No. E', k, '; ')"
_EASE2 = f"concat('a RIGHT OF WAY granted to ', {_SELLER}, '; Book ', k, ', Page 7; ')"
_EASEMENTS = f"concat({_fill(1)}, {_EASE1}, {_fill(2)}, {_EASE2}, {_fill(3)}, 'an easement for the benefit of the facts; ', {_fill(4)})"
_RESTRICTED = ["Declaration of covenants of record in Colorado", "Deed restrictions by trace and race, part ", "zoning overlay of the terrace", "CC&Rs, deleted pursuant to an act, Instrument No. R", "a Historic  landmark"]
_RESTRICTIONS = f"concat({_fill(1)}, CASE k % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_RESTRICTED)) + f" END, k, '; ', {_fill(2)})"
_SCHEDULES = f"""concat('## Page 1', {_NL}, 'Head of it.', {_NL}, '## Page 2', {_NL}, CASE k % 3 WHEN 0 THEN 'I. Requirements' WHEN 1 THEN 'Schedule B - Section I of the commitment' ELSE 'REQUIREMENTS TO ISSUE POLICY' END, {_NL},
  'a. Pay the full premium', {_NL}, '   amount to the title agent.', {_NL}, 'B) Release of mortgage ', k, ' by the lender;', {_NL}, 'c. short', {_NL}, 'iv) Provide a survey of the land.', {_NL},
  CASE k % 3 WHEN 0 THEN 'II. Exceptions' WHEN 1 THEN 'Schedule B - Section II of the commitment' ELSE 'Exceptions from Coverage' END, {_NL}, 'Standard Exceptions', {_NL}, '1. Matters ', k, ' of the gap exception.', {_NL}, '2) Easement for utilities of lot ', k, '.', {_NL}, 'Specific Exceptions', {_NL},
  '3. Unrecorded lease of tenant ', k, '.', {_NL}, '4. Rights or claims of parties in possession.', {_NL}, CASE WHEN k % 2 = 0 THEN 'Schedule C of it' ELSE 'Countersigned' END)"""
_BODIES = [
    "concat('Lot No. ', k, ', Block B, Sunny Acres Subdivision of Mesa Verde; ', repeat('more of the plat ', 3), 'ends')",
    "concat('Beginning at a point ', k, ' feet north; thence east ', repeat('and on ', 600), 'back')",
    "concat('Section ', k % 36 + 1, ', Township 3 North, Range 2 West, the parcel of ', k, ' acres')",
    "concat('Unit ', k, ' of the condominium of the lake, with all parts held in common, block ', k)",
]
_HEADS = ["concat('The land referred to in this Commitment is described as follows: ', {0}, ' Schedule B next')", "concat('Exhibit A: see attached pages that go on for many more words than forty. Legal   Description: ', {0}, '. In witness whereof')", "concat('description of the land: ', {0}, ' Requirements to come')", "concat('Real property described below: ', {0})"]
_LEGAL = "concat('APN: 12-', k, '/9. ', CASE k % 4 " + " ".join(f"WHEN {i} THEN {h.format(b)}" for i, (h, b) in enumerate(zip(_HEADS, _BODIES, strict=True))) + " END)"
_DOCUMENTS = f"""concat('## Page 1', {_NL}, 'Commitment', {_NL}, '## Page 2', {_NL}, {_DATES}, {_NL}, {_INSURED}, {_MONEY.replace(", 240)", ", 12)")}, ' recorded. ', {_NL}, 'Legal Description: ', {_BODIES[0]}, {_NL}, 'Schedule B next. ', {_fill(1)}, {_EASE1}, {_fill(2)}, 'a Mortgage in Book ', k, ', Page 7; ', {_fill(3)})"""
ITEMS = """
SELECT p_partkey AS doc_id, concat(CASE p_partkey % 17 WHEN 0 THEN 'Pay the full amount of the premium' WHEN 1 THEN 'Record the deed' WHEN 2 THEN 'Release of the mortgage by the lender' WHEN 3 THEN 'Satisfaction of judgment'
  WHEN 4 THEN 'Proof of death of the owner' WHEN 5 THEN 'Evidence of authority of the purchaser' WHEN 6 THEN 'Provide a survey to the title agent' WHEN 7 THEN 'Taxes and assessments' WHEN 8 THEN 'Easement for utilities'
  WHEN 9 THEN 'Encroachment of a fence' WHEN 10 THEN 'Oil and gas reservation' WHEN 11 THEN 'Unrecorded lease of a tenant' WHEN 12 THEN 'Restrictive covenants' WHEN 13 THEN 'Mechanics lien' WHEN 14 THEN 'Any defects, liens, encumbrances, adverse claims'
  WHEN 15 THEN 'Notice to the seller' ELSE 'Other matters' END, ' ', p_name) AS text FROM part
"""




def _texts(spark: SparkSession, d: str, text: str, **more: str) -> DataFrame:
    """doc_id and the text of each order."""
    o = spread(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d")))
    return o.select(F.col("k").alias("doc_id"), F.expr(text).alias("text"), *(F.expr(v).alias(n) for n, v in more.items()))


def _view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    named = sql
    for name in ("orders", "customer", "supplier", "part"):
        if name in sql:
            table(spark, d, name).createOrReplaceTempView(f"quill_{name}")
            named = named.replace(f"FROM {name}", f"FROM quill_{name}").replace(f"JOIN {name}", f"JOIN quill_{name}")
    return spark.sql(named)


def _t() -> Column:
    return F.col("text")


def _whole(m: Column) -> list[Column]:
    """value, confidence and where it was found."""
    return [m["value"].alias("value"), m["confidence"].alias("confidence"), m["source"]["start"].alias("start"), m["source"]["snippet"].alias("snippet")]


def extract_recording_refs(spark: SparkSession, d: str) -> DataFrame:
    return extract.listed(_texts(spark, d, _REFS), extract.references(_t()))


def extract_money(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, _MONEY).select("doc_id", extract.money(_t()).alias("m")).select("doc_id", F.col("m.value").cast("double").alias("amount"), "m.confidence")


def extract_dates(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, _DATES).select("doc_id", extract.effective_date(_t()).alias("m")).select("doc_id", F.col("m.value").cast("string").alias("effective_date"), "m.source.start", "m.source.page")


def date_formats(spark: SparkSession, d: str) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", parsed_date(written).cast("string").alias("parsed"))


def extract_insured_and_estate(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d, _INSURED, land=_ESTATE)
    return docs.select("doc_id", extract.proposed_insured(_t()).alias("i"), extract.estate(F.col("land")).alias("e")).select("doc_id", F.col("i.value").alias("insured"), F.col("e.value").alias("estate"))


def extract_parties_dedup(spark: SparkSession, d: str) -> DataFrame:
    return extract.listed(_texts(spark, d, _PARTIES), extract.parties(_t()))


def classify_liens(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d, _LIENS, doc_type=_TYPES)
    found = extract.listed(docs.withColumn("people", extract.parties(_t())), extract.liens(F.col("doc_type"), F.col("people"), _t()))
    return found.withColumn("amount", F.col("amount").cast("double")).drop("source")


def chain_of_title(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d, _CHAIN, doc_type=_TYPES).withColumn("people", extract.parties(_t()))
    found = extract.listed(docs, extract.chain(F.col("doc_type"), F.col("people"), _t()))
    joined = lambda c: F.array_join(c, " & ").alias(c)
    return found.select("doc_id", "ordinal", "instrument", joined("grantor"), joined("grantee"), "book", "page", "number", F.col("source.snippet").alias("snippet"))


def extract_easements(spark: SparkSession, d: str) -> DataFrame:
    return extract.listed(_texts(spark, d, _EASEMENTS), extract.easements(_t())).drop("source")


def extract_restrictions(spark: SparkSession, d: str) -> DataFrame:
    return extract.listed(_texts(spark, d, _RESTRICTIONS), extract.restrictions(_t())).drop("source", "description")


def classify_requirements(spark: SparkSession, d: str) -> DataFrame:
    items = _view(spark, d, ITEMS)
    return items.select("doc_id", first_match(F.col("text"), rules.REQUIREMENTS, "other").alias("category"), first_match(F.col("text"), rules.ADDRESSEES, "other").alias("addressed_to"))


def classify_exceptions(spark: SparkSession, d: str) -> DataFrame:
    items = _view(spark, d, ITEMS)
    return items.select("doc_id", first_match(F.col("text"), rules.EXCEPTIONS, "other").alias("category"), F.lower("text").rlike(rules.STANDARD_PHRASES).alias("is_standard"))


def schedule_b_requirements(spark: SparkSession, d: str) -> DataFrame:
    return extract.listed(_texts(spark, d, _SCHEDULES), extract.requirements(_t())).withColumn("on_page", F.col("source.page")).drop("source")


def schedule_b_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return extract.listed(_texts(spark, d, _SCHEDULES), extract.exceptions(_t())).withColumn("on_page", F.col("source.page")).drop("source")


def split_bullets(spark: SparkSession, d: str) -> DataFrame:
    """Over whole texts, headings and all: a bullet reaches up to the next."""
    return extract.listed(_texts(spark, d, _SCHEDULES), extract.bullets(_t()))


def legal_description(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, _LEGAL).select("doc_id", extract.legal_description(_t()).alias("l")).select("doc_id", "l.*")


def title_documents(spark: SparkSession, d: str) -> DataFrame:
    """One row a document: all facts, with where the date was found."""
    out = extract.title_documents(_texts(spark, d, _DOCUMENTS, doc_type=_TYPES))
    value = lambda c: F.col(f"{c}.value")
    return out.select(
        "doc_id", "doc_type", "page_count", value("effective_date").cast("string").alias("effective_date"), F.col("effective_date.source.page").alias("date_page"), F.col("effective_date.source.snippet").alias("date_snippet"),
        value("proposed_insured").alias("insured"), value("policy_amount").cast("double").alias("amount"), F.col("legal_description.lot").alias("lot"), F.col("legal_description.type").alias("legal_type"),
        F.size("parties").alias("n_parties"), F.size("chain_of_title").alias("n_chain"), F.size("open_liens").alias("n_liens"), F.size("easements").alias("n_easements"), F.size("restrictions").alias("n_restrictions"), F.size("schedule_b_requirements").alias("n_requirements"),
        "has_recording_stamp", F.size("warnings").alias("n_warnings"),
    )


def transcript_pages(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("intro\n## Page 1\n\nfirst of "), F.col("c_name"), F.lit("\n## Page 2\n\nsecond"))
    rows = table(spark, d, "customer").select("c_custkey", text.alias("text"), (F.col("c_custkey") % 3 + 1).alias("page"))
    return rows.select("c_custkey", F.size(page_blocks(F.col("text"))).alias("n_blocks"), transcript_page(F.col("text"), F.col("page")).alias("block"))


def merge_priority_coalesce(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("estate_or_interest"), F.when(F.col("doc_id") % 3 == 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("parties"))
    b = docs.select("doc_id", F.lit("fallback").alias("estate_or_interest"), F.array(F.lit("other"), F.col("lang")).alias("parties"))
    out = extract.merged(a, b, ["estate_or_interest"], ["parties"])
    return out.select("doc_id", "estate_or_interest", F.array_join("parties", ",").alias("parties"), "warning")


QUERIES = {
    f.__name__: f
    for f in (
        extract_recording_refs, extract_money, extract_dates, date_formats, extract_insured_and_estate, extract_parties_dedup, classify_liens, chain_of_title, extract_easements, extract_restrictions,
        classify_requirements, classify_exceptions, schedule_b_requirements, schedule_b_exceptions, split_bullets, legal_description, title_documents, transcript_pages, merge_priority_coalesce,
    )
}

def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_O = "(SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)"
_VALID = "CASE WHEN k % 7 = 0 OR k % 5 = 4 THEN NULL ELSE d::VARCHAR END"


def _rows(*facts: str) -> str:
    """Facts in order, absent ones (a first field that is null) left out, numbered."""
    return f"(SELECT k, (generate_subscripts(fs, 1) - 1)::INT AS ordinal, unnest(fs) AS f FROM (SELECT k, d, list_filter([{', '.join(facts)}], lambda x: x.a IS NOT NULL) AS fs FROM {_O}))"


def _fact(when: str, a: str, **more: str) -> str:
    return "{'a': CASE WHEN " + when + f" THEN {a} END" + "".join(f", '{n}': {v}" for n, v in more.items()) + "}"


def _party(when: str, name: str, role: str, entity: str = "FALSE") -> str:
    return _fact(when, name, role=f"'{role}'", entity=entity)


_IS_ENTITY = "(k % 3 < 2)"
_PEOPLE = _rows(
    _party("TRUE", _SELLER, "grantor"), _party(_WIFE, "'Ida Moss'", "grantor"), _party("TRUE", _BUYER, "grantee"), *(_party("k % 50 = 0", f"'{n}'", "grantee") for n in _MANY), _party("TRUE", "'Omar Diaz'", "borrower"), _party("TRUE", _LENDER, "lender", _IS_ENTITY),
    _party("TRUE", "'Gus Lund'", "trustee"), _party("TRUE", _BUYER, "owner"),
)


def _link(when: str, instrument: str, grantor: str, grantee: str, book: str = "NULL::VARCHAR", page: str = "NULL::VARCHAR", number: str = "NULL::VARCHAR", snippet: str = "''") -> str:
    return _fact(when, instrument, grantor=grantor, grantee=grantee, book=book, page=page, number=number, snippet=snippet)


_HEAD = f"substr(trim(regexp_replace({_CHAIN}, '\\s+', ' ', 'g')), 1, 200)"
_LINKS = _rows(
    _link("k % 4 IN (1, 2)", _TYPES, _SELLER, _BUYER, snippet=_HEAD),
    _link("TRUE", "'warranty_deed'", _SELLER, f"{_BUYER} || ', her heirs'", "k::VARCHAR", "(k + 1)::VARCHAR", snippet="'Book ' || k || ' of Plats, Page ' || (k + 1)"),
    _link("TRUE", "'mortgage'", "'Unknown grantor (per recording reference)'", "'Unknown grantee (per recording reference)'", number="year(d) || '-' || k", snippet="'Instrument No. ' || year(d) || '-' || k"),
)
_NOBODY = ("'Unknown creditor (per reference)'", "'Unknown debtor (per reference)'")


def _lien(when: str, kind: str, status: str = "'open'", amount: str = "NULL::DOUBLE", creditor: str = _NOBODY[0], debtor: str = _NOBODY[1], book: str = "NULL::VARCHAR", page: str = "NULL::VARCHAR", number: str = "NULL::VARCHAR") -> str:
    return _fact(when, kind, status=status, amount=amount, creditor=creditor, debtor=debtor, book=book, page=page, number=number)


_OWED = "(k * 1000 + 100.5)::DOUBLE"
_HELD = _rows(
    _lien("k % 4 = 2", "'mortgage'", amount=_OWED, creditor=f"CASE WHEN k % 2 = 0 THEN {_LENDER} ELSE 'Unknown creditor' END", debtor="CASE WHEN k % 2 = 0 THEN 'Omar Diaz' ELSE 'Unknown debtor' END"),
    _lien("TRUE", "'mortgage'", "CASE WHEN k % 3 = 0 THEN 'released' ELSE 'open' END", _OWED, _LENDER, _SELLER, "k::VARCHAR", "'7'"),
    _lien("TRUE", "'irs_lien'", number="'T' || k"), _lien("TRUE", "'ucc_filing'", number="k::VARCHAR"), _lien("TRUE", "'hoa_lien'", book="k::VARCHAR", page="'9'"),
)


def _around(text: str, before: str, mark: str, after: int, longest: int) -> str:
    """The text around a mention that begins after `before` and is `mark`, squeezed and cut."""
    at = f"length(concat({before}))"
    return f"substr(trim(regexp_replace(substr({text}, ({at} - 180 + 1)::BIGINT, (180 + length({mark}) + {after})::BIGINT), '\\s+', ' ', 'g')), 1, {longest})"


_EASED = _rows(
    _fact("TRUE", "'utility'", description=_around(_EASEMENTS, f"{_fill(1)}, 'a Utility  '", "'easement'", 220, 280), instrument="'E' || k", holder=_LENDER),
    _fact("TRUE", "'right_of_way'", description=_around(_EASEMENTS, f"{_fill(1)}, {_EASE1}, {_fill(2)}, 'a '", "'RIGHT OF WAY'", 220, 280), instrument="'Book ' || k || ' Page 7'", holder=_SELLER),
    _fact("TRUE", "'other'", description=_around(_EASEMENTS, f"{_fill(1)}, {_EASE1}, {_fill(2)}, {_EASE2}, {_fill(3)}, 'an '", "'easement'", 220, 280), instrument="NULL::VARCHAR", holder="NULL::VARCHAR"),
)
_ITEM = {"id": "'B-I-{}'", "category": "'{}'"}


def _need(key: str, text: str, category: str, to: str) -> str:
    return _fact("TRUE", f"'B-I-{key}'", text=text, category=f"'{category}'", addressed_to=f"'{to}'")


_LAST = "'Provide a survey of the land' || CASE WHEN k % 3 = 2 THEN '. Exceptions from Coverage' ELSE '' END"
_NEEDS = _rows(_need("a", "'Pay the full premium amount to the title agent'", "payment", "title_co"), _need("b", "'Release of mortgage ' || k || ' by the lender'", "release_of_lien", "lender"), _need("iv", _LAST, "survey", "other"))


def _except(key: str, text: str, category: str, standard: str) -> str:
    return _fact("TRUE", f"'B-II-{key}'", text=text, category=f"'{category}'", is_standard=standard)


_EXCEPTED = _rows(
    _except("1", "'Matters ' || k || ' of the gap exception'", "standard", "TRUE"), _except("2", "'Easement for utilities of lot ' || k || '. Specific Exceptions'", "easement", "FALSE"),
    _except("3", "'Unrecorded lease of tenant ' || k", "lease", "FALSE"), _except("4", "'Rights or claims of parties in possession'", "other", "TRUE"),
)
_HEADINGS = "CASE k % 3 WHEN 0 THEN 'II. Exceptions' WHEN 1 THEN 'Schedule B - Section II of the commitment' ELSE 'Exceptions from Coverage' END"
_TAIL = "CASE WHEN k % 2 = 0 THEN ' Schedule C of it' ELSE ' Countersigned' END"
_SPLIT = _rows(
    _fact("k % 3 = 0", "'i'", text="'Requirements'"),
    _fact("TRUE", "'a'", text="'Pay the full premium amount to the title agent'"), _fact("TRUE", "'b'", text="'Release of mortgage ' || k || ' by the lender'"),
    _fact("TRUE", "'iv'", text="'Provide a survey of the land' || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '. Schedule B - Section II of the commitment Standard Exceptions' ELSE '. Exceptions from Coverage Standard Exceptions' END"),
    _fact("k % 3 = 0", "'ii'", text="'Exceptions Standard Exceptions'"),
    _fact("TRUE", "'1'", text="'Matters ' || k || ' of the gap exception'"), _fact("TRUE", "'2'", text="'Easement for utilities of lot ' || k || '. Specific Exceptions'"),
    _fact("TRUE", "'3'", text="'Unrecorded lease of tenant ' || k"), _fact("TRUE", "'4'", text=f"'Rights or claims of parties in possession.' || {_TAIL}"),
)
_DESCRIBED = f"CASE k % 4 WHEN 0 THEN 'as follows: ' || {_BODIES[0]} WHEN 1 THEN substr({_BODIES[1]}, 1, 2000) WHEN 2 THEN {_BODIES[2]} ELSE {_BODIES[3]} END"
_DATE_TEXT = f"rtrim(replace({_DATES}, 'é head ', ''), '. End')"

SQL = {
    "extract_recording_refs": f"""WITH o AS (SELECT k, d, {_REF} AS ref, 'File Number X' || k AS other FROM {_O}),
r AS (SELECT k, 0 AS ordinal, 5 AS start, ref AS match, CASE WHEN k % 6 < 3 THEN k::VARCHAR END AS book, CASE k % 6 WHEN 0 THEN 'P-' || k WHEN 1 THEN (k + 1)::VARCHAR WHEN 2 THEN (k + 1)::VARCHAR END AS page, CASE k % 6 WHEN 3 THEN year(d) || '/' || k WHEN 4 THEN 'R-' || k END AS number FROM o
  UNION ALL SELECT k, 1, 5 + length(ref) + length(' it is. ') + length({_fill(1)}), other, NULL, NULL, 'X' || k FROM o)
SELECT k AS doc_id, ordinal, start::INT AS start, (start + length(match))::INT AS "end", match, book, page, number, lower(concat(coalesce(book, ''), '|', coalesce(page, ''), '|', coalesce(number, ''))) AS key FROM r""",
    "extract_money": f"SELECT k AS doc_id, CASE k % 5 WHEN 0 THEN k * 1000 + 500 WHEN 1 THEN k * 1000 WHEN 2 THEN k + 0.25 WHEN 4 THEN k + 0.75 END::DOUBLE AS amount, CASE k % 5 WHEN 2 THEN 0.45 WHEN 3 THEN NULL ELSE 0.85 END::DOUBLE AS confidence FROM {_O}",
    "extract_dates": f"SELECT k AS doc_id, {_VALID} AS effective_date, CASE WHEN {_VALID} IS NOT NULL THEN CASE WHEN k % 5 = 2 THEN 10 ELSE 7 END END::INT AS start, CASE WHEN {_VALID} IS NOT NULL THEN 1 END::INT AS page FROM {_O}",
    "date_formats": "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS parsed FROM orders",
    "extract_insured_and_estate": f"SELECT k AS doc_id, CASE WHEN k % 4 < 3 THEN {_BUYER} END AS insured, CASE k % 6 WHEN 0 THEN 'fee_simple' WHEN 1 THEN 'leasehold' WHEN 2 THEN 'life_estate' WHEN 3 THEN 'fee_simple' WHEN 5 THEN 'easement' END AS estate FROM {_O}",
    "extract_parties_dedup": f"SELECT k AS doc_id, ordinal, f.a AS name, f.role AS role, f.entity AS is_entity FROM {_PEOPLE} WHERE ordinal < 12",
    "classify_liens": f"SELECT k AS doc_id, ordinal, f.a AS lien_type, f.status AS status, f.amount AS amount, f.creditor AS creditor, f.debtor AS debtor, f.book AS book, f.page AS page, f.number AS number FROM {_HELD}",
    "chain_of_title": f"SELECT k AS doc_id, ordinal, f.a AS instrument, f.grantor AS grantor, f.grantee AS grantee, f.book AS book, f.page AS page, f.number AS number, f.snippet AS snippet FROM {_LINKS}",
    "extract_easements": f"SELECT k AS doc_id, ordinal, f.a AS type, f.description AS description, f.instrument AS instrument, f.holder AS holder FROM {_EASED}",
    "extract_restrictions": f"SELECT k AS doc_id, 0 AS ordinal, CASE k % 5 WHEN 0 THEN 'hoa_declaration' WHEN 1 THEN 'deed_restriction' WHEN 2 THEN 'zoning_overlay' ELSE 'ccr' END AS type, CASE WHEN k % 5 = 3 THEN 'R' || k END AS instrument, k % 5 IN (1, 3) AS discriminatory FROM {_O} WHERE k % 5 < 4",
    "schedule_b_requirements": f"SELECT k AS doc_id, ordinal, f.a AS id, f.text AS text, f.category AS category, f.addressed_to AS addressed_to, 2 AS on_page FROM {_NEEDS}",
    "schedule_b_exceptions": f"SELECT k AS doc_id, ordinal, f.a AS id, f.text AS text, f.category AS category, f.is_standard AS is_standard, 2 AS on_page FROM {_EXCEPTED}",
    "split_bullets": f"SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY ordinal) - 1)::INT AS ordinal, f.a AS key, f.text AS text FROM {_SPLIT} WHERE length(f.text) >= 12",
    "legal_description": f"""SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'platted' WHEN 1 THEN 'metes_and_bounds' WHEN 2 THEN 'section_township_range' ELSE 'condominium' END AS type, {_DESCRIBED} AS text, CASE WHEN k % 4 = 0 THEN k::VARCHAR END AS lot,
  CASE k % 4 WHEN 0 THEN 'B' WHEN 3 THEN k::VARCHAR END AS block, CASE WHEN k % 4 = 0 THEN 'Mesa Verde' END AS subdivision, '12-' || k || '/9' AS apn FROM {_O}""",
    "title_documents": f"""SELECT k AS doc_id, {_TYPES} AS doc_type, 2 AS page_count, {_VALID} AS effective_date, CASE WHEN {_VALID} IS NOT NULL THEN 2 END::INT AS date_page, CASE WHEN {_VALID} IS NOT NULL THEN CASE WHEN k % 5 = 2 THEN substr({_DATE_TEXT}, 4) ELSE {_DATE_TEXT} END END AS date_snippet,
  CASE WHEN k % 4 < 3 THEN {_BUYER} END AS insured, CASE k % 5 WHEN 0 THEN k * 1000 + 500 WHEN 1 THEN k * 1000 WHEN 2 THEN k + 0.25 WHEN 3 THEN k WHEN 4 THEN k + 0.75 END::DOUBLE AS amount, k::VARCHAR AS lot, 'platted' AS legal_type,
  0 AS n_parties, 1 AS n_chain, (1 + (k % 4 = 2)::INT)::INT AS n_liens, 1 AS n_easements, 0 AS n_restrictions, 0 AS n_requirements, TRUE AS has_recording_stamp, 1 AS n_warnings FROM {_O}""",
    "classify_requirements": f"SELECT doc_id, {first_match_sql('text', rules.REQUIREMENTS, 'other')} AS category, {first_match_sql('text', rules.ADDRESSEES, 'other')} AS addressed_to FROM ({ITEMS})",
    "classify_exceptions": f"SELECT doc_id, {first_match_sql('text', rules.EXCEPTIONS, 'other')} AS category, regexp_matches(lower(text), {_lit(rules.STANDARD_PHRASES)}) AS is_standard FROM ({ITEMS})",
    "transcript_pages": "SELECT c_custkey, 3 AS n_blocks, CASE c_custkey % 3 WHEN 0 THEN '## Page 1' || chr(10) || chr(10) || 'first of ' || c_name WHEN 1 THEN '## Page 2' || chr(10) || chr(10) || 'second' ELSE 'intro' || chr(10) || '## Page 1' || chr(10) || chr(10) || 'first of ' || c_name || chr(10) || '## Page 2' || chr(10) || chr(10) || 'second' END AS block FROM customer",
    "merge_priority_coalesce": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, 'fallback') ELSE 'fallback' END AS estate_or_interest, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'other,' || lang END AS parties, 'merged from two extractions' AS warning FROM documents",
}
