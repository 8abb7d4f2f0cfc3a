"""Sliding token windows with character spans, context sentences and page markers.

Spans come from the running length of the pieces that make up a text, on its row: regular expressions tell no positions in SQL. The sentences are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import PAGE_HEADING
from ..functions.spans import last_before, let, numbered, scan
from ..functions.text import SPACE, filled

#: Fixed value: what tells the page of what follows.
PAGE_MARKS = r"(?im)(?:\bPage\s+|^##\s*Page\s+)(\d+)\b"
#: Headings of pages alone.
HEADINGS = "(?m)" + PAGE_HEADING
#: The same with a look at one character before word bounds and beginnings of lines.
_LOOK = {PAGE_MARKS: PAGE_MARKS.replace("(?im)", "(?im)(?=[p#])"), HEADINGS: HEADINGS.replace("(?m)", "(?m)(?=#)")}
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
LEADING = r"^[\x20\x09-\x0D]+"


def windows(n_tokens: Column, size: int = 600, overlap: int = 80, most: int | None = 400) -> Column:
    """array of (idx, first, end): frames of `size` tokens, each `overlap` after the one before; the last stops at the end."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n_tokens - size) / step)).cast("int"))
    framed = F.transform(starts, lambda i: F.struct(i.alias("idx"), (i * step).alias("first"), F.least(i * step + size, n_tokens).alias("end")))
    framed = F.when(n_tokens > 0, framed).otherwise(F.array().cast("array<struct<idx:int,first:int,end:int>>"))
    return framed if most is None else F.slice(framed, 1, most)


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def token_windows(docs: DataFrame, size: int = 600, overlap: int = 80, most: int | None = 400) -> DataFrame:
    """doc_id, idx, first, end (in tokens) of each window; no rows for a text without tokens. Row-local."""
    return docs.select("doc_id", F.inline(_windows_of(F.col("text"), size, overlap, most)))


def _windows_of(text: Column, size: int, overlap: int, most: int | None) -> Column:
    """The windows of a text, whose tokens are counted once, not for each window anew."""
    return let(n_tokens(text), lambda n: windows(n, size, overlap, most))


def token_ends(pieces: Column) -> Column:
    """Where each piece ends, in code points."""

    def step(at: Column, piece: Column) -> tuple[Column, Column]:
        end = at + F.length(piece)
        return end, F.array(end)

    return scan(pieces, F.lit(0), step, "array<int>")


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def _visible(piece: Column) -> Column:
    return F.length(F.regexp_replace(piece, LEADING, ""))


def token_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tok, start, end: the characters of each token, in code points. Row-local."""
    placed = let(_pieces(F.col("text")), lambda p: F.arrays_zip(p.alias("piece"), token_ends(p).alias("end")))
    rows = docs.select("doc_id", F.posexplode(placed).alias("tok", "t"))
    return rows.select("doc_id", "tok", (F.col("t.end") - _visible(F.col("t.piece"))).alias("start"), F.col("t.end").alias("end"))


_WINDOW = "array<struct<idx:int,start:int,end:int,text:string>>"


def window_spans(text: Column, size: int = 600, overlap: int = 80, most: int | None = 400) -> Column:
    """array of (idx, start, end, text): windows with the characters they reach over, joined from their tokens."""

    def of(pieces: Column) -> Column:
        joined = lambda first, n: F.array_join(F.slice(pieces, first + 1, n), "")

        def place(at: Column, w: Column) -> tuple[Column, Column]:
            first = F.get(pieces, w["first"])
            body = joined(w["first"], w["end"] - w["first"])
            shown = F.struct(w["idx"].alias("idx"), (at + F.length(first) - _visible(first)).alias("start"), (at + F.length(body)).alias("end"), F.regexp_replace(body, LEADING, "").alias("text"))
            return at + F.length(joined(w["first"], F.lit(max(1, size - overlap)))), F.array(shown)

        return let(windows(F.size(pieces), size, overlap, most), lambda framed: scan(framed, F.lit(0), place, _WINDOW))

    return let(_pieces(text), of)


def window_starts(text: Column, size: int = 600, overlap: int = 80, most: int | None = 400) -> Column:
    """array of (idx, start): where windows begin, of which no text is joined but what lies between two beginnings."""
    step = max(1, size - overlap)

    def of(pieces: Column) -> Column:
        def place(at: Column, w: Column) -> tuple[Column, Column]:
            first = F.get(pieces, w["first"])
            shown = F.struct(w["idx"].alias("idx"), (at + F.length(first) - _visible(first)).alias("start"))
            return at + F.length(F.array_join(F.slice(pieces, w["first"] + 1, F.lit(step)), "")), F.array(shown)

        return let(windows(F.size(pieces), size, overlap, most), lambda framed: scan(framed, F.lit(0), place, "array<struct<idx:int,start:int>>"))

    return let(_pieces(text), of)


def pages_of(text: Column, starts: Column, marks: str = PAGE_MARKS) -> Column:
    """The page of each of the places, in their order: that of the last mark that ends by it; 1 without any. Marks and places are merged once."""
    return last_before(numbered(text, _LOOK.get(marks, marks)), starts)


def _paged(size: int, overlap: int, most: int | None) -> Column:
    """array of (idx, start, end, text, page): the windows of the column text and the page each begins on."""
    return let(window_spans(F.col("text"), size, overlap, most), lambda ws: F.zip_with(ws, pages_of(F.col("text"), F.transform(ws, lambda w: w["start"])), lambda w, p: F.struct(w["idx"].alias("idx"), w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("text"), p.alias("page"))))


def chunks(docs: DataFrame, size: int = 600, overlap: int = 80, most: int | None = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, idx, start, end, text, chunk_id, page: windows with their span, the text under it and the page it begins on, and other columns of docs that `keep` names. Row-local, and linear in the text."""
    framed = docs.select("doc_id", *keep, F.inline(_paged(size, overlap, most)))
    return framed.select("doc_id", *keep, "idx", "start", "end", "text", chunk_id(F.col("doc_id"), F.col("idx"), F.col("text")).alias("chunk_id"), "page")


def _in_context(doc_id: Column, doc_type: Column, text: Column) -> Column:
    return F.concat(context_sentence(doc_id, doc_type, text), F.lit("\n\n"), text)


def listed_chunks(docs: DataFrame, size: int = 600, overlap: int = 80, most: int | None = None) -> DataFrame:
    """doc_id, chunks: the windows of each document (doc_id, doc_type, text) in order as one array of (chunk_id, page, start, end, text, contextual_text). Row-local."""
    of = lambda w: F.struct(chunk_id(F.col("doc_id"), w["idx"], w["text"]).alias("chunk_id"), *(w[c].alias(c) for c in ("page", "start", "end", "text")), _in_context(F.col("doc_id"), F.col("doc_type"), w["text"]).alias("contextual_text"))
    return docs.select("doc_id", F.transform(_paged(size, overlap, most), of).alias("chunks"))


def chunk_id(doc_id: Column, idx: Column, text: Column) -> Column:
    """Names a window: its document, its number of four digits at least, and a digest of its text."""
    n = idx.cast("string")
    return F.concat(doc_id.cast("string"), F.lit(":chunk:"), F.when(F.length(n) > 4, n).otherwise(F.lpad(n, 4, "0")), F.lit(":"), F.substring(F.sha1(text), 1, 10))


def context_sentence(doc_id: Column, doc_type: Column, text: Column) -> Column:
    """Where a chunk is from: the first schedule it names, else the first page, else its document alone."""
    schedule = F.replace(F.regexp_extract(text, r"(?i)\b(Schedule\s+[A-Z](?:[-\s]+Section\s+[IVX]+)?)\b", 1), F.lit("\n"), F.lit(" "))
    page = F.regexp_extract(text, r"(?i)\b(Page\s+[0-9]+)\b", 1)
    where = F.when(schedule != "", F.concat(schedule, F.lit(" of "))).when(page != "", F.concat(page, F.lit(" of "))).otherwise("")
    return F.concat(F.lit("This chunk comes from "), where, doc_id.cast("string"), F.lit(", a "), doc_type, F.lit("."))


def single_sentence(text: Column) -> Column:
    """The first sentence of an answer, white space squeezed; without an end its first 240 characters."""

    def of(t: Column) -> Column:
        first = F.regexp_extract(t, r"^(.+?[.!?])(?:\s|$)", 1)
        return F.when(first != "", first).otherwise(F.substring(t, 1, 240))

    return let(F.btrim(F.regexp_replace(text, f"{SPACE}+", " ")), of)


def neighbourhood(whole: Column, chunk: Column, reach: int = 4000) -> Column:
    """What surrounds a chunk in its document, by the first place of its beginning: half of `reach` on either side; the document's head if it isn't found."""

    def of(at: Column) -> Column:
        first = F.greatest(at - 1 - reach // 2, F.lit(0))
        return F.when(at > 0, F.substring(whole, first + 1, at - 1 + F.length(chunk) + reach // 2 - first)).otherwise(F.substring(whole, 1, reach))

    needle = F.btrim(F.substring(chunk, 1, 200))
    return let(F.when(needle == "", 0).otherwise(F.instr(whole, needle)), of)


def last_page_before(text: Column, offset: Column, marker: str = r"\b[Pp]age ([0-9]+)") -> Column:
    """The last page marker that ends by an offset; 1 without any."""
    found = F.regexp_extract_all(F.substring(text, F.lit(1), offset), F.lit(marker), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("int"), F.lit(1))


def vesting_chunks(parties: DataFrame) -> DataFrame:
    """One chunk for each vesting party (doc_id, ordinal, name, role)."""
    owner = filled("Schedule A vested owner: {name}. Role: owner.", name=F.col("name"))
    other = filled("Schedule A vesting party: {name}. Role: {role}.", name=F.col("name"), role=F.col("role"))
    return parties.select("doc_id", "ordinal", "role", F.when(F.col("role") == "owner", owner).otherwise(other).alias("text"))


def contextual_chunks(docs: DataFrame, vesting: DataFrame, size: int = 600, overlap: int = 80, most: int | None = None) -> DataFrame:
    """doc_id, idx, chunk_id, page, start, end, text, contextual_text: the windows of documents (doc_id, doc_type, text), and after them a chunk for each vesting party (doc_id, ordinal, name, role).

    Vesting chunks are of page 1 and have no span. Only documents with vesting parties meet their number of windows: one row a party.
    """
    own = chunks(docs, size, overlap, most, ("doc_type",))
    windowed = own.select("doc_id", "idx", "chunk_id", "page", "start", "end", "text", _in_context(F.col("doc_id"), F.col("doc_type"), F.col("text")).alias("contextual_text"))
    counted = docs.select("doc_id", F.size(_windows_of(F.col("text"), size, overlap, most)).alias("n"))
    placed = vesting_chunks(vesting).join(counted, "doc_id").withColumn("idx", (F.col("n") + F.col("ordinal")).cast("int"))
    context = F.when(F.col("role") == "owner", filled("This chunk summarizes Schedule A vesting for {doc_id}.", doc_id=F.col("doc_id"))).otherwise(filled("This chunk summarizes a Schedule A party for {doc_id}.", doc_id=F.col("doc_id")))
    none = F.lit(None).cast("int")
    listed = placed.select("doc_id", "idx", chunk_id(F.col("doc_id"), F.col("idx"), F.col("text")).alias("chunk_id"), F.lit(1).alias("page"), none.alias("start"), none.alias("end"), "text", F.concat(context, F.lit("\n\n"), "text").alias("contextual_text"))
    return windowed.unionByName(listed)
