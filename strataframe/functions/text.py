"""Name cleaning and text formatting as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The blank class spelled out, because Java's \s covers ASCII only.
BLANK = r"[\t\n\f\r\p{Z}]"
NON_BLANK = r"[^\t\n\f\r\p{Z}]"

# Identification qualifiers stripped from names, in matching order.
QUALIFIERS = (
    r"\?",
    r"sp\.",
    r"cf\.",
    r"n\.",
    "aff",
    r"gen\.",
    "informal",
    "J sensu Ristedt",
    "A sensu Ristedt",
    "B sensu Ristedt",
    "K sensu Ristedt",
    "H sensu Ristedt",
    r"ex gr\.",
    r"\.",
    r" sp\.",
    r"spp\.",
    '"',
    r"\p{Nd}",
    r" [\t\n\f\r\p{Z}]*\([^\)]+\)",
)
# How the qualifiers begin: looked at once before any of them is tried.
QUALIFIER_STARTS = r"[?scnagieJABKH.\" \p{Nd}]"


def alternation(patterns: Sequence[str]) -> str:
    return "|".join(patterns)


def qualifier_pattern(patterns: Sequence[str] = QUALIFIERS) -> str:
    """The alternation behind one lookahead, so that most positions try no branch.

    Of a run of spaces only the first may open a bracketed part: a match from a later one would have begun there,
    and without one every space would read the run to its end.
    """
    if patterns is not QUALIFIERS:
        return alternation(patterns)
    linear = alternation(patterns).replace(r" [\t\n\f\r\p{Z}]*\(", r"(?<! ) [\t\n\f\r\p{Z}]*+\(")
    return f"(?={QUALIFIER_STARTS})(?:{linear})"


def strip_qualifiers(name: Column, patterns: Sequence[str] = QUALIFIERS) -> Column:
    """Remove every match of any qualifier. Unanchored: ``aff`` also goes inside a word."""
    return F.regexp_replace(name, qualifier_pattern(patterns), "")


def squish(text: Column) -> Column:
    """Trim both ends and squeeze inner blanks to one space.

    A lone space is already right, so the pattern only matches other runs.
    """
    return F.trim(F.regexp_replace(text, rf"[\t\n\f\r\p{{Z}}&&[^ ]]{BLANK}*| {BLANK}+", " "))


def clean_name(name: Column, patterns: Sequence[str] = QUALIFIERS) -> Column:
    return squish(strip_qualifiers(name, patterns))


def cleaned_once(df: DataFrame, names: Mapping[str, str], *, n: str = "n", **tallies: Column) -> DataFrame:
    """One row per distinct spelling in ``names`` (column to cleaned column), with its number of rows ``n`` and further ``tallies``.

    The optimizer moves filters and join keys on grouping columns below an aggregate, and with them the regular
    expressions onto every row. The cleaned columns read the count, so they stay above it and run once a spelling.
    """
    spellings = df.groupBy(*names).agg(F.count(F.lit(1)).alias(n), *[c.alias(k) for k, c in tallies.items()])
    return spellings.withColumns({out: F.when(F.col(n) > 0, clean_name(F.col(raw))) for raw, out in names.items()})


def strip_open_suffix(name: Column, *, as_published: bool = False) -> Column:
    """Drop the `` sp.`` suffix of open nomenclature.

    ``as_published`` keeps the original pattern, whose dot matches any character
    anywhere in the name (``Foo spinosus`` becomes ``Foonosus``).
    """
    return F.regexp_replace(name, " sp." if as_published else r" sp\.$", "")


def first_word(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_BLANK + "+"))


def replace_first(text: Column, literal: str, by: str) -> Column:
    """Replace the first occurrence of a literal; null stays null."""
    at = F.instr(text, literal)
    return F.when(at == 0, text).otherwise(
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            F.lit(by),
            F.substring(text, at + len(literal), F.length(text)),
        )
    )


def title_case(text: Column) -> Column:
    return F.initcap(text)


def genus_and_species(taxa: Column) -> tuple[Column, Column]:
    """First and second space-separated piece; a missing piece is null, extras are dropped."""
    parts = F.split(taxa, " ")
    return F.get(parts, 0), F.get(parts, 1)


def number_text(value: Column, digits: int = 1) -> Column:
    """Round and print with the fewest digits (``5``, not ``5.0``); null prints ``NA``."""
    fixed = F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")
    shortest = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(shortest == "-0", "0").otherwise(shortest), F.lit("NA"))


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(number_text(value, digits), F.lit("%"))


def interval_text(low: Column, high: Column, digits: int = 1) -> Column:
    return F.concat(
        F.lit("["), percent_text(low, digits), F.lit(", "), percent_text(high, digits), F.lit("]")
    )
