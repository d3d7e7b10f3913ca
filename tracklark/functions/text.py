"""Text columns: paths, names, numbers as text, and repairs of damaged input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AUDIO_EXTENSIONS

#: Characters that no XML text may hold, and numbers that are written too long.
#: The characters stand one by one, as Java then looks each up in one table instead of trying range after range.
CONTROL = "[" + "".join(rf"\x{c:02X}" for c in (*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F)) + "]"
LONG_DECIMAL = r"\d+\.\d{10,}"


def is_audio_path(path: Column) -> Column:
    """Whether the path ends, in any case, with an audio extension."""
    return F.lower(path).rlike(rf"\.({'|'.join(AUDIO_EXTENSIONS)})$")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def size_mb(length: Column) -> Column:
    return length / 1048576


@F.pandas_udf(T.StringType())
def _nfc(path: pd.Series) -> pd.Series:
    if path.dropna().map(str.isascii).all():
        return path
    return path.str.normalize("NFC")


def nfc_path(path: Column) -> Column:
    """The path in Unicode normal form C; Spark has no function for it. ASCII paths are passed by, as nulls to Python."""
    ascii_only = path.rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(ascii_only, path), _nfc(F.when(~ascii_only, path)))


def sanitize_xml_text(text: Column) -> Column:
    """Text for an XML attribute: control characters dropped, & < > escaped, outer white space cut; null gives ""."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for char, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(char), F.lit(escaped))
    return F.regexp_replace(clean, r"(?U)^\s+|\s+$", "")


def repair_long_decimals(text: Column) -> Column:
    """Numbers of ten decimals or more, wherever they stand, cut to two."""
    short = F.transform(F.regexp_extract_all(text, F.lit(LONG_DECIMAL), F.lit(0)), lambda x: F.format_string("%.2f", x.cast("double")))
    cut = F.array_join(F.zip_with(F.split(text, LONG_DECIMAL, -1), F.concat(short, F.array(F.lit(""))), lambda gap, x: F.concat(gap, x)), "")
    return F.when(text.rlike(LONG_DECIMAL), cut).otherwise(text)


@F.pandas_udf(T.DoubleType())
def _round_exact(x: pd.Series) -> pd.Series:
    return x.map(lambda v: round(v, 2), na_action="ignore")


def round_time(seconds: Column, exact: bool = False) -> Column:
    """Two decimals; `exact` rounds the binary value instead of its shortest decimal text (they differ on ties)."""
    return _round_exact(seconds) if exact else F.round(seconds, 2)


def format_position(seconds: Column) -> Column:
    return F.format_string("%.6f", seconds)


def one_decimal(x: Column) -> Column:
    """Text with one decimal, the binary value rounded exactly and ties to even (`format_string` rounds decimal text up)."""
    a = F.abs(x)
    n = F.floor(a * 10)
    half = 2 * n + 1
    over = 4 * a - (half - 16 * a)  # the sign of 20 a - half, without rounding
    up = F.when(over > 0, 1).when((over == 0) & (n % 2 == 1), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.format_string("%.1f", (n + up) / 10))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def repair_library_text(text: Column, root_tag: str) -> Column:
    """Damaged library text made parsable: control characters dropped, closing tags that follow themselves collapsed
    (each pair once), and everything after the first end of the root cut off."""
    close = f"</{root_tag}>"
    t = F.regexp_replace(text, CONTROL, "")
    t = F.regexp_replace(t, r"(</[^>]+>)\s*\1+", "$1")
    t = F.regexp_replace(t, rf"{close}\s*{close}", close)
    return F.when(F.instr(t, close) > 0, F.concat(F.substring_index(t, close, 1), F.lit(close))).otherwise(t)
