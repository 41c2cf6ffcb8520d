"""Reference documents: page quality, and chunks along headings and clauses."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import share_of, squeezed, words

# Common words, weights and sizes.
COMMON = (
    "a", "about", "account", "all", "amount", "an", "and", "are", "as", "at", "be", "by", "date", "document", "for", "from", "has", "in", "invoice", "is", "it",
    "name", "no", "not", "of", "on", "or", "page", "payment", "section", "shall", "tax", "term", "that", "the", "this", "to", "total", "value", "with",
)
CHUNK, TINY = 1800, 120
# First lines of blocks that start a heading, a section or a clause.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
SECTION = re.compile(r"^(?:(section|sec\.?|chapter|part)\s+)([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)\b[:.)\-\s]*(.*)$", re.I)
CLAUSE = re.compile(r"^((?:\d+|[A-Z])(?:\.\d+){1,6})\b[.)\-\s]*(.*)$")


def ratios(text: Column) -> dict[str, Column]:
    """Shares of common words among the words of two letters and more, of letters and digits, and of characters beyond ASCII."""
    plain = tidy(text)
    w = F.regexp_extract_all(F.lower(plain), F.lit("([a-z]{2,})"), 1)
    common = F.size(F.filter(w, lambda x: x.isin(*COMMON)))
    return {
        "dictionary": F.when(F.size(w) > 0, common / F.size(w)).otherwise(F.lit(0.0)),
        "alphanumeric": share_of(plain, r"[\p{L}\p{N}]"),
        "non_ascii": share_of(plain, r"[^\x00-\x7F]"),
    }


def tidy(text: Column) -> Column:
    """A page without white space at its ends and before line ends, each run of blanks one blank; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " "), r"\s+\n", "\n"), r"^\s+|\s+$", "")


def unread_share(text: Column) -> Column:
    """Share of a page's characters that say that something couldn't be read; 1 for an empty page."""
    plain = tidy(text)
    marks = F.length(plain) - F.length(F.regexp_replace(plain, r"(?i)\[illegible\]", ""))
    return F.when(F.length(plain) > 0, marks / F.length(plain)).otherwise(F.lit(1.0))


def table_penalty(text: Column) -> Column:
    """Up to .15 for tables whose rows differ in their number of cells: .12 times the coefficient of variation over three rows and more."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x))
    rows = F.filter(lines, lambda x: F.contains(x, F.lit("|")) & x.rlike(r"[^|:\-\s]|:.*\s.*:"))
    cells = F.filter(F.transform(rows, lambda x: F.size(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))), lambda n: n > 1)
    n = F.size(cells)
    mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(cells, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.when(n >= 3, F.least(F.lit(0.15), spread / mean * 0.12)).otherwise(F.lit(0.0))


def quality(text: Column, confidence: Column, has_tables: Column | None = None) -> Column:
    """A page's score from the reader's own confidence, common words, letters, marks of what couldn't be read, and uneven tables."""
    r = ratios(text)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    score = 0.52 * sure + 0.20 * r["dictionary"] + 0.16 * r["alphanumeric"] + 0.12 * (1 - unread_share(text))
    if has_tables is not None:
        score = score - F.when(has_tables, table_penalty(text)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def quality_reasons(text: Column, confidence: Column, has_tables: Column, threshold: float) -> Column:
    """What speaks against a page: array<string>."""
    r = ratios(text)
    tests = {
        "low_dictionary_word_ratio": r["dictionary"] < 0.12,
        "high_illegible_density": unread_share(text) > 0.04,
        "low_alphanumeric_ratio": r["alphanumeric"] < 0.25,
        "high_non_ascii_ratio": r["non_ascii"] > 0.4,
        "unstable_table_columns": has_tables & (table_penalty(text) > 0),
        "below_quality_threshold": quality(text, confidence, has_tables) < threshold,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in tests.items()]))


def readable(text: Column) -> Column:
    """Whether a text layer is good enough to be used as it is."""
    r = ratios(text)
    return (F.length(squeezed(F.coalesce(text, F.lit("")))) >= 80) & (r["dictionary"] >= 0.18) & (r["non_ascii"] <= 0.35) & (r["alphanumeric"] >= 0.25)


@dataclass(frozen=True)
class Chunk:
    """A part of a page: where it lies, under which headings, and its text with that context."""

    page: int
    start: int
    end: int
    path: tuple[str, ...]
    section: str | None
    clause: str | None
    unsure: bool
    text: str


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks between empty lines, without white space at their ends."""
    edges = [0, *(e for m in re.finditer(r"\n\s*\n", text) for e in m.span()), len(text)]
    out = []
    for low, high in zip(edges[::2], edges[1::2]):
        body = text[low:high]
        if body.strip():
            out.append((low + len(body) - len(body.lstrip()), high - len(body) + len(body.rstrip())))
    return out


def cuts(text: str, low: int, high: int, size: int) -> Iterator[tuple[int, int]]:
    """A block too long for one chunk in parts of at most ``size``, cut at blanks where there are some."""
    while high - low > size:
        space = text.rfind(" ", low + 1, low + size)
        at = space if space > 0 else low + size
        yield low, at
        low = at + len(text[at:high]) - len(text[at:high].lstrip())
    if low < high:
        yield low, high


def chunk_pages(pages: Iterable[tuple[int, str | None, bool]], name: str = "", size: int = CHUNK, tiny: int = TINY) -> list[Chunk]:
    """Chunks of one document's (number, markdown, unsure) pages: along headings, sections and clauses, filled up to ``size``.

    Headings hold on over pages, chunks end with their page. One whose whole text is
    shorter than ``tiny`` is joined with the next one of the same page and sureness.
    """
    made: list[Chunk] = []
    titles: list[str] = []
    number = title = None
    for page, text, unsure in sorted(pages, key=lambda p: p[0]):
        text = text or ""
        held: list[tuple[int, int]] = []
        marks: tuple = ((), None, None)

        def close() -> None:
            if held:
                context = " > ".join(x for x in (name, *marks[0]) if x)
                body = "\n\n".join(text[a:b] for a, b in held)
                made.append(Chunk(page, held[0][0], held[-1][1], *marks, unsure, f"Context: {context}\n\n{body}" if context else body))
                held.clear()

        for low, high in blocks(text):
            first = text[low:high].split("\n", 1)[0].strip()
            heading, section, clause = HEADING.match(first), SECTION.match(first), CLAUSE.match(first)
            if heading:
                titles = [*titles[: len(heading[1]) - 1], " ".join(heading[2].strip(" #").split())]
                number = title = None
            if heading or section or clause:
                close()
            if section:
                rest = section[3].strip(" :-.)")
                number, title = section[2], f"{section[1].rstrip('.').title()} {section[2]}" + (f": {rest}" if rest else "")
            here = (tuple(x for x in (*titles, title) if x), number, clause[1] if clause and not section else None)
            if high - low > size:
                close()
                for part in cuts(text, low, high, size):
                    marks = here
                    held.append(part)
                    close()
                continue
            if held and sum(b - a for a, b in held) + high - low > size:
                close()
            if not held:
                marks = here
            held.append((low, high))
        close()
    joined: list[Chunk] = []
    for c in made:
        last = joined[-1] if joined else None
        if last and len(last.text) < tiny and (last.page, last.unsure) == (c.page, c.unsure):
            joined[-1] = Chunk(c.page, last.start, c.end, c.path or last.path, c.section or last.section, c.clause or last.clause, c.unsure, f"{last.text}\n\n{c.text}")
        else:
            joined.append(c)
    return joined


def page_chunks(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text", unsure_col: str | None = None, name_col: str | None = None) -> DataFrame:
    """(id_col, chunk int, heading_path array, section, clause, page, start_char, end_char int, low_confidence boolean, name, text) of documents in pages.

    The pages of a document meet as one row, its documents stay where they lie.
    """
    unsure = F.coalesce(F.col(unsure_col), F.lit(False)) if unsure_col else F.lit(False)
    name = F.coalesce(F.col(name_col).cast("string"), F.lit("")) if name_col else F.lit("")
    part = F.struct(F.col(page_col).cast("int").alias("number"), F.col(text_col).alias("text"), unsure.alias("unsure"))
    docs = pages.groupBy(F.col(id_col).alias("i")).agg(F.collect_list(part).alias("p"), F.max(name).alias("n"))
    return _chunked(docs, id_col, dict(pages.dtypes)[id_col])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """The same for documents of one page each, where they lie."""
    name = F.coalesce(F.col(name_col).cast("string"), F.lit("")) if name_col else F.lit("")
    part = F.struct(F.lit(1).alias("number"), F.col(text_col).alias("text"), F.lit(False).alias("unsure"))
    return _chunked(docs.select(F.col(id_col).alias("i"), F.array(part).alias("p"), name.alias("n")), id_col, dict(docs.dtypes)[id_col])


def _chunked(docs: DataFrame, id_col: str, kind: str) -> DataFrame:
    names = [id_col, "chunk", "heading_path", "section", "clause", "page", "start_char", "end_char", "low_confidence", "name", "text"]

    def run(batches):
        for batch in batches:
            rows = []
            for ident, pages, called in zip(batch["i"], batch["p"], batch["n"]):
                for k, c in enumerate(chunk_pages([(p["number"], p["text"], p["unsure"]) for p in pages], called)):
                    rows.append((ident, k, list(c.path), c.section, c.clause, c.page, c.start, c.end, c.unsure, called, c.text))
            yield pd.DataFrame(rows, columns=names)

    schema = f"`{id_col}` {kind}, chunk int, heading_path array<string>, section string, clause string, page int, start_char int, end_char int, low_confidence boolean, name string, text string"
    return docs.select("i", "p", "n").mapInPandas(run, schema)


def word_chunks(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id_col, keep, chunk int, text): each run of ``size`` blank-separated words of plain text that has no headings."""
    blank = F.coalesce(F.col(text_col), F.lit(""))
    for c in "\t\n\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    rows = docs.select(id_col, *keep, F.array_remove(F.split(blank, " "), "").alias("_w"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_w") - 1) / size).cast("int"))), lambda k: F.array_join(F.slice("_w", k * size + 1, size), " "))
    return rows.select(id_col, *keep, F.posexplode(F.filter(parts, lambda p: p != "")).alias("chunk", "text"))  # a text without words has one empty part
