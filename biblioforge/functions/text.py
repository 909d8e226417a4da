"""Scalar text functions: Column in, Column out, all on the JVM side.

NULL gives NULL unless a docstring says otherwise; blank text stays blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip_markup(text: Column) -> Column:
    """Heading tags glued between words become a blank, other simple tags vanish; tags with attributes stay."""
    glued = F.regexp_replace(text, r"(?U)(?<=[\w.?!])</?h\d>(?=\w)", " ")
    return F.regexp_replace(glued, r"(?U)<[\w/]+>", "")


def strip_newlines(text: Column) -> Column:
    """Line feeds deleted."""
    return F.regexp_replace(text, "\n", "")


def newlines_to_blanks(text: Column) -> Column:
    """Line feeds as blanks, for line-oriented output."""
    return F.regexp_replace(text, "\n", " ")


def add_period(text: Column) -> Column:
    """A full stop unless the text is blank or ends a sentence already."""
    return F.when(text == "", text).when(F.right(text, F.lit(1)).isin(".", "?", "!"), text).otherwise(F.concat(text, F.lit(".")))


def title_abstract(title: Column, abstract: Column) -> Column:
    """Both as one text; a missing part counts as blank."""
    return F.concat(add_period(F.coalesce(title, F.lit(""))), F.lit(" "), F.coalesce(abstract, F.lit("")))


def trim_punctuation(text: Column, keep: str = "") -> Column:
    """Without ASCII punctuation at both ends, but for the characters in ``keep``."""
    return F.btrim(text, F.lit("".join(c for c in PUNCTUATION if c not in keep)))


#: Fixed value: signs that an address may hold besides letters, digits and the underscore; neither # nor ~ is among them.
URL_SIGNS = "@.,:;!?&+*=$%/\\^'<>()[]-"


def url_list(text: Column) -> Column:
    """The different addresses in a text, in order, as an array."""
    signs = "".join("\\" + c for c in URL_SIGNS)
    found = F.regexp_extract_all(text, F.lit(rf"(?U)https?://[\w{signs}]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: trim_punctuation(u, keep="/")))


def join_list(values: Column, separator: str = ", ", drop_blank: bool = False) -> Column:
    """An array as a delimited cell; NULLs count as blank."""
    values = F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("")))
    return F.array_join(F.filter(values, lambda v: v != "") if drop_blank else values, separator)


def clean_url(cell: Column) -> Column:
    """Lower case up to the first single slash, no slash at the end, http for https."""
    head = F.regexp_extract(cell, "(?s)^(?:[^/]++|/{2,}+)*+", 0)
    lowered = F.concat(F.lower(head), F.substring(cell, F.length(head) + 1, F.length(cell)))
    return F.replace(F.rtrim(lowered, F.lit("/")), F.lit("https"), F.lit("http"))


def domain(url: Column) -> Column:
    """The host with its port."""
    return F.regexp_replace(F.regexp_replace(url, "https?://", ""), "(?s)/.*", "")


def registry_url(url: Column, first_only: bool = True) -> Column:
    """An address as registries are compared by it."""
    url = F.trim(F.substring_index(url, ",", 1) if first_only else url)
    return F.lower(F.regexp_replace(F.regexp_replace(url, "^https?://(?:www.)?", ""), "/$", ""))


def remove_decimals(cell: Column) -> Column:
    """Every ``.0`` deleted, as spreadsheets add them to ids (also inside other numbers)."""
    return F.replace(cell, F.lit(".0"), F.lit(""))


def count_listed(cell: Column) -> Column:
    """One more than the commas of a cell."""
    return F.size(F.split(cell, ","))


def us_date(text: Column) -> Column:
    """M/D/YYYY as YYYY-MM-DD; blank stays blank, anything else is an error. No calendar check."""
    pattern = "^(\\d{1,2})/(\\d{1,2})/(\\d{4})"
    part = lambda i, n: F.lpad(F.regexp_extract(text, pattern, i), n, "0")
    made = F.concat_ws("-", part(3, 4), part(1, 2), part(2, 2))
    bad = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("string")
    return F.when(text == "", text).when(text.rlike(pattern), made).otherwise(bad)


def significant(x: Column, digits: int = 3) -> Column:
    """A number to so many significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * scale) / scale)


def plain_words(text: Column) -> Column:
    """The words of a text, of letters, digits and underscores, as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")


def phrases(words: Column, longest: int) -> Column:
    """All runs of one to ``longest`` words in a row, as an array; each as often as it stands there."""
    def of(n: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: i <= F.size(words) - n + 1)
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), of))
