"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens are runs of letters and decimal digits.
TOKEN = r"[\p{L}\p{N}]+"


def normalise_space(text: Column) -> Column:
    """Runs of separators and control characters become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[\p{Z}\p{C}]+", " "))


def mark_unknown(text: Column) -> Column:
    """Runs of characters that are neither ASCII, white space nor word characters become a bullet."""
    return F.regexp_replace(text, r"(?U)[^\s\w\p{ASCII}]+", "•")


def unknown_to_token(text: Column) -> Column:
    return F.replace(text, F.lit("•"), F.lit("<unk>"))


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "0")


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def has_specials(text: Column) -> Column:
    """Whether the text holds a character of the Specials block (U+FFF0 to U+FFFF)."""
    return text.rlike(r"[\x{FFF0}-\x{FFFF}]")


def host(uri: Column) -> Column:
    """The host of a URI, null where it has none."""
    return F.try_parse_url(uri, F.lit("HOST"))


def http_header(response: Column) -> Column:
    """What stands before the first blank line."""
    return F.split(response, "\r\n\r\n", 2).getItem(0)


def content_type(header: Column) -> Column:
    return F.regexp_extract(header, r"(?im)^Content-Type:[ \t]*([^\r\n]*)", 1)


def mime(kind: Column) -> Column:
    """The media type in lower case, null where there is none."""
    found = F.lower(F.trim(F.regexp_extract(kind, r"^\s*([^;\s]+)", 1)))
    return F.when(found != "", found)


def charset(kind: Column) -> Column:
    """The declared charset in lower case without stray characters, null where there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(kind, r"(?i)charset\s*=\s*([^;]*)", 1)), r"[^\w-]", "")
    return F.when(found != "", found)


def length_likelihood(src_len: Column, trg_len: Column, mean: float, std: float) -> Column:
    """exp(-((trg/src - mean)/std)**2 / 2); null for an empty source."""
    ratio = F.try_divide(trg_len.cast("double"), src_len.cast("double"))
    return F.exp(-F.pow((ratio - F.lit(mean)) / F.lit(std), F.lit(2.0)) / 2)


def length_confidence(src_len: Column) -> Column:
    return F.lit(1.0) - F.exp(F.lit(-0.01) * src_len)


def draw(*key: Column) -> Column:
    """A number in [0, 1) that a digest of the key decides, the same on every run and every layout."""
    return F.conv(F.substring(F.md5(F.concat_ws("\t", *[k.cast("string") for k in key])), 1, 6), 16, 10).cast("double") / float(16**6)


def end_marked(text: Column) -> Column:
    """A text whose line end survives an external tokeniser."""
    return F.concat(text, F.lit(" ‖"))


def at_end_marks(text: Column) -> Column:
    """The texts that their end marks part, as an array."""
    return F.filter(F.transform(F.split(text, "‖"), lambda x: F.trim(x)), lambda x: x != "")


def sigmoid(x: Column, bins: int = 1000, reach: float = 6.0) -> Column:
    """The logistic function at the lower end of the bin that holds ``x``; 0 and 1 beyond ``reach``."""
    at = F.floor((x + reach) * (bins / reach / 2)) / bins
    return F.when(x >= reach, 1.0).when(x <= -reach, 0.0).otherwise(1 / (1 + F.exp(-(at * 2 - 1) * reach)))
