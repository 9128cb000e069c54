"""Titles, names, dates and queries as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell franchises apart.
FRANCHISE_STOPWORDS = ["the", "a", "an", "of", "and", "in", "on", "at", "to", "movie", "part", "chapter", "creation", "origins", "collection"]
# Fixed value: the marker of items without genres.
NO_GENRES = "(no genres listed)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters a-z and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def title_year(raw: Column) -> Column:
    """The year of a title that ends with one in parentheses."""
    return F.regexp_extract(raw, r"\((\d{4})\)$", 1).try_cast("int")


def bare_title(raw: Column) -> Column:
    """The title without that year, which blanks may follow here."""
    return F.trim(F.regexp_replace(raw, r"\s*\(\d{4}\)\s*$", ""))


def genre_list(raw: Column) -> Column:
    return F.filter(F.split(raw, r"\|"), lambda x: (x != "") & (x != NO_GENRES))


def imdb_id(raw: Column) -> Column:
    """tt and at least seven digits."""
    digits = raw.cast("string")
    return F.concat(F.lit("tt"), F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits))


def normalised_title(title: Column) -> Column:
    """Lower case without one leading and one trailing article and without anything but letters and digits."""
    t = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    t = F.trim(F.regexp_replace(t, r"^(the|an|a) ", ""))
    t = F.trim(F.regexp_replace(t, r"(, the|, an|, a| the| an| a)$", ""))
    return F.regexp_replace(t, "[^a-z0-9]", "")


def title_variants(title: Column) -> Column:
    """Normalised forms of the title, of what stands before its first parenthesis, and of what stands in it (behind a.k.a.)."""
    inside = F.trim(F.substring_index(F.element_at(F.split(title, r"\("), 2), ")", 1))
    aka = F.when(F.lower(inside).startswith("a.k.a."), F.trim(F.substr(inside, F.lit(7)))).otherwise(inside)
    has = title.contains("(")
    forms = F.array(normalised_title(title), F.when(has, normalised_title(F.trim(F.substring_index(title, "(", 1)))), F.when(has, normalised_title(aka)))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def search_title(title: Column) -> Column:
    """What to look a title up by: without also-known-as parts and year."""
    cut = F.substring_index(F.substring_index(title, "(a.k.a.", 1), "(aka", 1)
    return F.trim(F.regexp_replace(cut, r"\s*\(\d{4}\)", ""))


def without_year_suffix(title: Column, year: Column) -> Column:
    suffix = F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))
    return F.when(title.endswith(suffix), F.substr(title, F.lit(1), F.length(title) - F.length(suffix))).otherwise(title)


def quoted(needle: Column) -> Column:
    """The needle as a literal inside a Java pattern."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def has_word(text: Column, needle: Column) -> Column:
    """Whether the needle stands in the text between word boundaries."""
    return F.regexp_like(text, F.concat(F.lit(r"\b"), quoted(needle), F.lit(r"\b")))


def has_any(text: Column, needles: list[str]) -> Column:
    """Whether one of the needles is anywhere in the text."""
    out = F.lit(False)
    for x in needles:
        out = out | text.contains(x)
    return out


def negations(query: Column) -> Column:
    """What follows not, no, less, without, non and except."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"\b(not|no|less|without|non|except)\s+([a-zA-Z0-9\s-]+)"), 2)
    return F.transform(found, lambda x: F.trim(x))


def without_phrases(text: Column, phrases: Column) -> Column:
    """The text without each of the phrases as words, blanks collapsed."""
    cut = F.aggregate(phrases, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b"), quoted(p), F.lit(r"\b")), F.lit("")))
    return F.array_join(F.filter(F.split(cut, r"\s+"), lambda x: x != ""), " ")


def title_target(query: Column) -> Column:
    """The title that a query of the kind `movies like X but ...` names."""
    rest = F.regexp_replace(F.lower(query), r".*?(?:like|similar to|if i liked)\s+", "")
    return F.trim(F.split(rest, r"\b(?:but|with|and|not)\b")[0])


def without_stopwords(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda x: (x != "") & ~x.isin(FRANCHISE_STOPWORDS))
    return F.array_join(words, " ")


def title_stem(title: Column) -> Column:
    """What stands before a colon, a dash or a final number, without stop-words (with them if nothing else is left)."""
    whole = F.trim(F.lower(title))
    first = F.trim(F.lower(F.split(title, r"[:\-]|\b\d+$")[0]))
    base = F.when(first != "", first).otherwise(whole)
    short = without_stopwords(base)
    return F.when(short != "", short).otherwise(base)


def franchise_key(collection: Column, title: Column) -> Column:
    """The collection's name, else the title's stem, with its kind in front."""
    name = F.trim(F.regexp_replace(F.trim(F.lower(collection)), r"\bcollection\b", ""))
    short = without_stopwords(name)
    of_collection = F.concat(F.lit("coll:"), F.when(short != "", short).otherwise(name))
    return F.when(F.coalesce(collection, F.lit("")) != "", of_collection).otherwise(F.concat(F.lit("stem:"), title_stem(F.coalesce(title, F.lit("")))))


def first_sentences(text: Column, n: int = 3) -> Column:
    return F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, n)


def letter_words(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{3,}\b"), 0))


def dealbreakers(text: Column) -> Column:
    """Comma-separated terms, trimmed, without a leading `no`."""
    terms = F.transform(F.split(text, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)^no\s+", "")))
    return F.filter(terms, lambda x: x != "")


def valid_user_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_\-]{1,64}$"), F.lit(False))


def review_time(text: Column) -> Column:
    """Unix seconds (UTC) of a date in one of three forms; null otherwise."""
    t = F.trim(text)
    forms = [("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$")]
    parsed = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz")) for f, p in forms]
    return unix_seconds(F.coalesce(*parsed))


def unix_seconds(ntz: Column) -> Column:
    """Seconds since 1970 of a timestamp without a zone, taken as UTC."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, ntz).cast("long")


def year_in(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")


def review_text(summary: Column, body: Column) -> Column:
    """Summary, blank line and body, without white space around them; null if nothing is left."""
    both = F.regexp_replace(F.concat_ws("\n\n", summary, body), r"^\s+|\s+$", "")
    return F.when(both != "", both)


def passage(title, year, directors, actors, genres, themes, tags, overview) -> Column:
    """The text by which an item is reranked: its fields, cut to a few entries, between bars."""
    joined = lambda a, n: F.nullif(F.array_join(F.slice(a, 1, n), ", "), F.lit(""))
    head = F.when(year.isNotNull(), F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(title)
    return F.concat_ws(" | ", head, joined(directors, 2), joined(actors, 4), joined(genres, 3), joined(themes, 3), joined(tags, 8), F.nullif(F.substring(overview, 1, 150), F.lit("")))


def unescape_html(text: Column) -> Column:
    """HTML entities as characters. No Spark function knows them all, so whole Arrow batches go to the standard library."""

    def run(batches: Iterator) -> Iterator:
        import html

        import pyarrow as pa

        for some in batches:
            yield pa.array([None if x is None else html.unescape(x) for x in some.to_pylist()], pa.string())

    from pyspark.sql.functions import ArrowUDFType

    # texts without an ampersand never leave the JVM
    found = F.arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(F.when(text.contains("&"), text))
    return F.coalesce(found, text)


def bar(share: Column, width: int) -> Column:
    """A bar of blocks, as long as the share of width, rounded down."""
    return F.repeat(F.lit("█"), F.floor(F.round(share * width, 9)).cast("int"))
