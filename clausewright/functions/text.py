"""Text expressions: white space, words, truncation, HTML, hashes and match spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive, with Unicode classes for white space, digits and words.
IGNORE_CASE = "(?iU)"
UNICODE = "(?U)"


#: Stands around matches in ASCII texts, where it cannot occur.
_MARK = "\ufdd0"


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def plain(pattern: str) -> str:
    """The pattern without Unicode classes, which match the same in ASCII texts and are much slower."""
    return pattern.replace(IGNORE_CASE, "(?i)").replace("(?isU)", "(?is)").replace(UNICODE, "")


def extracted(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of every match, as ``regexp_extract_all`` has it; ASCII texts are searched with plain classes."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(group))
    return F.when(ascii_only(text), found(plain(pattern))).otherwise(found(pattern))


def group_of(raw: Column, pattern: str, group: int) -> Column:
    """A group of a match, of which nothing but the match is looked at."""
    return F.when(ascii_only(raw), F.regexp_extract(raw, plain(pattern), group)).otherwise(F.regexp_extract(raw, pattern, group))


#: All that Unicode has as white space.
_SPACES = " " + "".join(map(chr, [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def collapse(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.btrim(F.regexp_replace(text, UNICODE + r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(_SPACES))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, UNICODE + r"\s+"), lambda w: w != ""))


def truncate(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def window_around(text: Column, start: Column, end: Column, reach: int = 80) -> Column:
    """The span with ``reach`` characters on either side, white space collapsed."""
    begin = F.greatest(start - reach, F.lit(0))
    return collapse(F.substring(text, begin + 1, F.least(end + reach, F.length(text)) - begin))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, even inside lambdas,
    which otherwise compute again what they capture for every element."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, pattern: str, *groups: int) -> Column:
    """Every match in order: ``array<struct<start, end, raw, g0, g1, ...>>``, null or empty without one.

    Texts are cut at the matches and one pass over the stretches adds up their
    lengths, so no Python is needed. An optional group that took no part is the empty string.
    ASCII texts are searched once, with plain classes; others are searched and split.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start: int, end: int, raw: string>>").alias("found"))

    def placed(pieces: Column, p: str) -> Column:
        """``pieces``: stretches between matches and matches in turn."""
        def add(acc: Column, piece: Column) -> Column:
            end = acc["at"] + F.length(piece)
            one = F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("raw"))
            return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

        found = F.aggregate(pieces, start, add, lambda acc: acc["found"])
        # a match holds its groups wherever it stands, as long as the pattern looks at nothing outside
        return F.transform(found, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["raw"].alias("raw"), *[F.regexp_extract(h["raw"], p, g).alias(f"g{k}") for k, g in enumerate(groups)]))

    quick = plain(pattern)

    def search(t: Column) -> Column:
        marked = F.split(F.regexp_replace(t, quick, f"{_MARK}$0{_MARK}"), _MARK, -1)
        pieces = lambda raw: F.flatten(F.zip_with(F.split(t, pattern, -1), raw, lambda s, h: F.when(h.isNull(), F.array(s)).otherwise(F.array(s, h))))
        slow = let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda raw: F.when(F.size(raw) > 0, pieces(raw)))
        return F.when(ascii_only(t), placed(marked, quick)).otherwise(placed(slow, pattern))

    return let(text, search)  # the text may be an expression of its own: it appears once


def folded(text: Column) -> Column:
    """Lower case for plain searches that go before case-insensitive patterns."""
    return F.translate(F.lower(text), "ſ", "s")


def guarded(low: Column, needles: tuple[str, ...], found: Column) -> Column:
    """``found`` only where the folded text holds one of the needles, else null: a
    plain search costs a fraction of a pattern."""
    if not needles:
        return found
    may = low.contains(needles[0])
    for n in needles[1:]:
        may = may | low.contains(n)
    return F.when(may, found)


def splitlines(text: Column) -> Column:
    """Lines at every boundary that Python's splitlines knows; a final one adds no line."""
    unified = F.regexp_replace(text, "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\u0085  ]", "\n")
    return F.when(unified == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(unified, r"\n\z", ""), "\n", -1))


def in_definitions(path: Column, text: Column) -> Column:
    """Whether a clause sits in, or opens like, a definitions section."""
    title, opening = F.lower(F.array_join(path, " > ")), F.lower(F.substring(text, 1, 200))
    return F.coalesce(title.rlike("definition|glossary|interpretation"), F.lit(False)) | opening.rlike("definition|interpretation")


def joined(*arrays: Column) -> Column:
    """One array of all elements; null arrays add nothing."""
    return F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))
