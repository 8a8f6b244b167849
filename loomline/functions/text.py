"""Text transforms as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters with the White_Space property.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space (in the Unicode sense) at both ends."""
    return F.btrim(text, F.lit(WHITE))


def content_id(content: Column) -> Column:
    """A document's id from its bytes."""
    return F.concat(F.lit("doc_"), F.substring(F.sha1(content), 1, 16))


def event_id(doc_id: Column, seq: Column, name: Column) -> Column:
    """A repeatable id of an event."""
    return F.concat(F.lit("ev_"), F.substring(F.sha1(F.concat_ws("\x1f", doc_id, seq.cast("string"), name)), 1, 12))


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def title_of(path: Column) -> Column:
    """The file's name without folder and ending, underscores as spaces, each run of letters capitalised."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    runs = F.regexp_extract_all(F.replace(stem, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def bullet_pages(line: Column) -> Column:
    """The page numbers of the first ``[PAGE 8, 9]`` mark, sorted and distinct."""
    marked = F.regexp_extract(line, r"\[PAGE\s+([0-9,\s]+)\]", 1)
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(marked, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))))


def sanitize(text: Column, limit: int | None = 12000) -> Column:
    """Control characters as spaces, runs of blanks and of empty lines shortened, then cut (not if ``limit`` is None) and stripped."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", " ")
    clean = F.regexp_replace(clean, r"[ \t]{2,}", " ")
    clean = F.regexp_replace(clean, r"\n{3,}", "\n\n")
    return strip(clean if limit is None else F.substring(clean, 1, limit))


def embedding_input(text: Column) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, 8000)


def event_text(name: Column, core: Column, characters: Column, location: Column) -> Column:
    """What an event's embedding is made from."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(e(name), F.lit(". "), e(core), F.lit(" Characters: "), e(F.array_join(characters, ", ")), F.lit(". Location: "), e(location), F.lit("."))


def page_label(pages: Column) -> Column:
    first, last = F.try_element_at(pages, F.lit(1)).cast("string"), F.try_element_at(pages, F.lit(-1)).cast("string")
    n = F.coalesce(F.size(pages), F.lit(0))
    return F.when(n <= 0, "n/a").when(n == 1, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))


def page_list(start: Column, end: Column) -> Column:
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def event_block(rank: Column, event_id: Column, name: Column, anchor: Column, core: Column, pages: Column, slim: bool = False) -> Column:
    """One event as it stands in a question's context."""
    what = F.coalesce(core, F.lit(""))
    if slim:
        return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), name, F.lit(" | "), anchor, F.lit(" | "), page_label(pages), F.lit("\n"), F.substring(what, 1, 160))
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] id="), event_id, F.lit("\nEvent: "), name, F.lit("\nStage: "), anchor, F.lit("\nWhat: "), F.substring(what, 1, 240), F.lit("\nSource: "), page_label(pages)
    )


def passage_block(rank: Column, score: Column, content: Column, short: bool = False) -> Column:
    """One passage as it stands in a question's context; ``score`` counts only in the long form."""
    if short:
        return F.concat(F.lit("[Passage "), rank.cast("string"), F.lit("]\n"), F.substring(content, 1, 220))
    return F.concat(F.lit("[Passage "), rank.cast("string"), F.lit(" | similarity "), F.format_number(score, 3), F.lit("]\n"), F.substring(content, 1, 420))


# What a refusing answer says, before and after the one rewrite.
REFUSALS = ("insufficient", "cannot determine", "not enough information", "does not include", "do not include enough", "unable to determine", "additional context", "needed to answer")
REFUSALS_AGAIN = ("insufficient", "cannot determine", "not enough", "does not include", "unable to determine", "additional context")
# Signs that an event frames the story.
FRAME_HINTS = ("years later", "epilogue", "prologue frame", "frame narrative", "framing device", "looking back", "afterwards", "aftermath")


def says_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the phrases."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for p in phrases:
        found |= low.contains(p)
    return found


def tokens(text: Column, longer_than: int) -> Column:
    """Distinct lower-case tokens between white space, longer than a number of characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) > longer_than))


def ordered_text(order: list[str], text: Column, separator: str) -> Column:
    """An aggregate: the group's texts in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_text"))))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), separator)
