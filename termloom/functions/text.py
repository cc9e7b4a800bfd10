"""Text rules as Column expressions: recognition, cleaning, normalization, signatures.

White space is Unicode white space throughout, as in ``(?U)\\s``; Spark's ``trim`` strips spaces only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: years, month words, missing markers, stopwords, unit dimensions ---
YEAR = r"(?:19\d{2}|20\d{2}|2100)"
HEADER_MONTHS = (
    "janvier", "février", "fevrier", "mars", "avril", "mai", "juin", "juillet", "août", "aout",
    "septembre", "octobre", "novembre", "décembre", "decembre",
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
TITLE_MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
    "janvier", "février", "fevrier", "mars", "avril", "mai", "juin", "juillet", "août", "aout",
    "septembre", "octobre", "novembre", "décembre", "decembre",
)
MISSING = (":", "..", "...")
STOPWORDS = (
    "the", "of", "and", "or", "for", "in", "on", "to", "a", "an", "by", "from", "with", "at", "as",
    "is", "are", "was", "were", "be", "per",
    "de", "la", "le", "des", "du", "di", "del", "della", "dei", "degli",
)
UNIT_DIMENSIONS = ("unit", "unit of measure", "measurement unit", "time frequency", "frequency")
TITLE_CONTEXT = "TITLE"
NAME_CONTEXT = "DIMENSION_NAME"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Stripped, each run of white space one space."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def folded(x: Column) -> Column:
    """Stripped, lower case, white space squeezed: the key of names and geography."""
    return squeeze(F.lower(x))


def is_time_header(header: Column) -> Column:
    """Year, year-month, year-month-day, year-semester; or a year with a quarter or a month word."""
    h = strip(header)
    exact = h.rlike(rf"^{YEAR}(?:\.0|-\d{{2}}(?:-\d{{2}})?|-[Ss][12])?$")
    year = h.rlike(YEAR)
    return F.coalesce(exact | (year & (h.rlike("(?i)Q[1-4]") | F.lower(h).rlike("|".join(HEADER_MONTHS)))), F.lit(False))


def is_numeric_string(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^-?\d+(?:\.\d+)?$"), F.lit(False))


def clean_value(x: Column) -> Column:
    """The stripped value, null if it is blank, a missing marker or a plain number."""
    s = strip(x)
    return F.when((s == "") | s.isin(*MISSING) | is_numeric_string(s), F.lit(None)).otherwise(s)


def dimension_name(header: Column) -> Column:
    """What stands before the first backslash, as it is."""
    return F.regexp_extract(header, r"(?s)^([^\\]*)", 1)


def _variants_once(xs: Column) -> Column:
    """The values, and each with one innermost parenthesis removed."""

    def removed(x: Column) -> Column:
        pieces = F.regexp_extract_all(x, F.lit(r"(?U)(\s*\([^()]*\))"), 1)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda k: strip(_without(x, k)))
        return F.when(F.size(pieces) > 0, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(xs, F.filter(F.flatten(F.transform(xs, removed)), lambda v: v != "")))


def _without(x: Column, k: Column) -> Column:
    """``x`` without its k-th innermost parenthesis."""
    marked = F.regexp_replace(x, r"(?U)(\s*\([^()]*\))", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    cut = F.transform(parts, lambda p, i: F.when(i == k, F.regexp_replace(p, "(?s)^.*?\u0002", "")).otherwise(F.replace(p, F.lit("\u0002"), F.lit(""))))
    return F.array_join(cut, "")


def geo_variants(x: Column) -> Column:
    """The stripped value and all that is left by removing parentheses one after the other.

    Removals are tried as often as the value has opening parentheses, after which none is left.
    """
    n = F.char_length(x) - F.char_length(F.replace(x, F.lit("("), F.lit("")))
    turns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.aggregate(turns, F.array(strip(x)), lambda found, _: _variants_once(found)))


def remove_dates(title: Column) -> Column:
    """The title without dates; index bases such as ``(2015 = 100)`` stay."""
    months = "|".join(TITLE_MONTHS)
    y = r"(?:19|20|21)\d{2}"
    # a mark inside the year hides index bases from the rules
    out = F.regexp_replace(title, r"(?U)\((\s*)(\d)(\d{3}\s*=\s*100\s*)\)", "($1$2\u0001$3)")
    rules = [
        r"\b\d{4}\s*[-–]\s*\d{4}\b",
        r"\bbetween\s+\d{4}\s+and\s+\d{4}\b",
        r"\bfrom\s+\d{4}\s+onwards\b",
        r"\bfrom\s+\d{4}\s+to\s+\d{4}\b",
        r"\buntil\s+\d{4}\b",
        r"\bup\s+to\s+\d{4}\b",
        r"\bsince\s+\d{4}\b",
        rf"\b{y}-\d{{2}}-\d{{2}}\b",
        rf"\b{y}-\d{{2}}\b",
        rf"\b{y}-S[12]\b",
        rf"\b{y}-Q[1-4]\b",
        rf"\bQ[1-4]\s+{y}\b",
        rf"\b(?:{months})\s+{y}\b",
        rf"\b{y}\s+(?:{months})\b",
    ]
    for rule in rules:
        out = F.regexp_replace(out, f"(?iU){rule}", "")
    out = F.regexp_replace(out, r"(?iU)\b(survey)\s+\d{4}\b", "$1")
    out = F.regexp_replace(out, r"(?iU)\bin\s+\d{4}(?=,|\s|$)", "")
    out = F.regexp_replace(out, rf"(?U)\b{y}\b", "")
    return F.replace(out, F.lit("\u0001"), F.lit(""))


def tidy_title(title: Column) -> Column:
    """Punctuation and spaces as they should be after removals."""
    out = F.regexp_replace(title, r"(?U)\(\s*\)", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"(?U)\s+([,.;:])", "$1")
    out = F.regexp_replace(out, r"(?U)\s*-\s*-\s*", " - ")
    out = F.regexp_replace(out, r"(?U)\s*-\s*$", "")
    out = F.regexp_replace(out, r"(?U)\(\s*,", "(")
    return F.btrim(out, F.lit(" -,"))


def normalized_measure(x: Column) -> Column:
    """Lower case, ``&`` as a word, ASCII letters, digits and single spaces only."""
    out = F.replace(F.lower(x), F.lit("&"), F.lit(" and "))
    return strip(F.regexp_replace(F.regexp_replace(out, r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+", " "))


def stem(word: Column) -> Column:
    """A careful singular: -ies to -y, -s off, but not -ses and -ss."""
    n = F.length(word)
    return (
        F.when((n > 5) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when((n > 5) & word.endswith("ses"), word)
        .when((n > 4) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1))
        .otherwise(word)
    )


def measure_tokens(x: Column, stemmed: bool = True) -> Column:
    """Sorted distinct words without stopwords and single letters."""
    words = F.filter(F.split(normalized_measure(x), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(words, stem) if stemmed else words))


def has_breakdown(x: Column) -> Column:
    return normalized_measure(x).rlike(r"\sby\s")


def measure_core(x: Column) -> Column:
    """The phenomenon without frequency, breakdown and presentation suffixes."""
    out = strip(F.regexp_replace(normalized_measure(x), r"\s*(?:annual|monthly|quarterly|bi annual|biannual)\s+data.*$", ""))
    out = strip(F.split(out, r"\s+by\s+", 2)[0])
    out = strip(F.regexp_replace(out, r"\s+(?:in|as)\s+percent(?:age)?$", ""))
    return strip(F.regexp_replace(out, r"\s+index$", ""))


_RANGE = r"(?<![A-Za-z0-9])([A-Za-z0-9]{1,3})-([A-Za-z0-9]{1,3})(?![A-Za-z0-9])"
_SECTION = r"(?U)[:-]\s*([A-Z]{1,6})(?=\s|$|[,.])"


def signature(x: Column) -> Column:
    """All qualifiers of a text: numbers, short ranges, units in parentheses, section codes."""
    numbers = F.regexp_extract_all(x, F.lit(r"(?U)(?<![A-Za-z0-9])(\d+(?:[.,]\d+)?)(?![A-Za-z0-9])"), 1)
    ranges = F.zip_with(F.regexp_extract_all(x, F.lit(_RANGE), 1), F.regexp_extract_all(x, F.lit(_RANGE), 2), lambda a, b: F.concat_ws("-", a, b))
    units = F.regexp_extract_all(x, F.lit(r"\(([A-Za-z%]{1,6})\)"), 1)
    sections = F.regexp_extract_all(x, F.lit(_SECTION), 1)
    every = F.concat(F.transform(numbers, lambda n: F.replace(n, F.lit(","), F.lit("."))), ranges, units, sections)
    return F.array_sort(F.array_distinct(F.transform(every, F.lower)))


def qualifiers(x: Column) -> Column:
    """First qualifier of each kind; a kind that is absent is null."""

    def first(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.lower(F.regexp_extract(x, pattern, group)), F.lit(""))

    span = F.when(x.rlike(_RANGE), F.concat_ws("-", first(_RANGE, 1), first(_RANGE, 2)))
    return F.struct(
        first(r"(?iU)\bNUTS\s*([0-9])\b").alias("nuts"),
        first(r"(?iU)\bRev\.?\s*([0-9]+(?:\.[0-9]+)?)\b").alias("rev"),
        first(r"\(([A-Za-z%]{1,6})\)").alias("unit"),
        span.alias("span"),
        first(_SECTION).alias("section"),
    )


def qualifier_conflict(a: Column, b: Column, kinds: tuple[str, ...] = ("nuts", "rev", "unit", "span", "section")) -> Column:
    """Some kind of qualifier is in both structs and differs."""
    out = F.lit(False)
    for k in kinds:
        out = out | F.coalesce(a[k] != b[k], F.lit(False))
    return out


def same_concept_conflict(a: Column, b: Column) -> Column:
    return qualifier_conflict(a, b, ("unit", "span", "section"))


def keyword_pattern(word: Column) -> Column:
    """A pattern for the word between other than Latin letters; the text must be lower case."""
    return F.concat(F.lit("(?<![a-z])"), F.regexp_replace(F.lower(word), r"([\\^$.|?*+(){}\[\]])", r"\\$1"), F.lit("(?![a-z])"))


def shortened(x: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis if something is cut."""
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.left(x, F.lit(most - 1))), F.lit("…"))).otherwise(x)


def request_id(measure: Column) -> Column:
    return F.substring(F.sha2(strip(measure).cast("binary"), 256), 1, 16)


def pair_request_id(a: Column, b: Column, model: str, version: str = "semrel-v6c-hybrid") -> Column:
    """Id of an unordered pair."""
    x, y = strip(a), strip(b)
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), F.lit(model), F.lit("llm"), F.least(x, y), F.greatest(x, y)).cast("binary"), 256), 1, 20)


def json_payload(reply: Column) -> Column:
    """The JSON object of a model's reply, without fences and thoughts."""
    bare = strip(F.regexp_replace(F.regexp_replace(reply, r"(?is)<think>.*?</think>", ""), r"(?i)```(?:json)?", ""))
    return F.when(bare.startswith("{"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))
