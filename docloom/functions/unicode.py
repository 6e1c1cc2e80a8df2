"""Texts from bytes, and their composed form; built-in expressions decide which few rows need Python at all."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import col, normalize_text

# Bytes 80 to 9F of cp1252 in order; what is a space there has no character.
CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
MAY_COMPOSE = r"[^\x{0000}-\x{02FF}]"  # characters below are composed already and never join one before them


# Texts are long: these go to Python by the hundred, as rows, so what a worker holds does not grow with its partition.
@F.udf(StringType(), useArrow=False)
def _composed(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", text)


@F.udf(StringType(), useArrow=False)
def _utf16(data: bytes | None) -> str | None:
    try:
        return None if data is None else data.decode("utf-16")
    except UnicodeDecodeError:
        return None


def nfc(c: Column | str) -> Column:
    """The composed form (NFC) of a text. Texts of Latin letters alone are it already and stay in the JVM."""
    text = col(c)
    return F.coalesce(_composed(F.when(text.rlike(MAY_COMPOSE), text)), text)


def normalize_composed(c: Column | str) -> Column:
    """``normalize_text`` of any text, composed or not."""
    return normalize_text(nfc(c))


def decoded_text(content: Column | str) -> Column:
    """(text, encoding) of a file's bytes: by a byte order mark, as UTF-8 if they are, else as cp1252; nulls if nothing fits.

    A mark whose encoding the rest isn't in counts as bytes like any other. Null bytes give nulls, no bytes an empty text.
    """
    data = col(content)
    marked8 = F.substring(data, 1, 3) == F.lit(b"\xef\xbb\xbf")
    marked16 = F.substring(data, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff"))
    wide = _utf16(F.when(marked16, data))
    plain = data.cast("string")
    valid = F.is_valid_utf8(plain)
    latin = F.decode(data, "ISO-8859-1")
    held = [k for k, c in enumerate(CP1252) if c != " "]
    windows = F.translate(latin, "".join(chr(0x80 + k) for k in held), "".join(CP1252[k] for k in held))
    told = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("encoding"))
    return (
        F.when(marked8 & valid, told(F.substring(plain, 2, 1 << 30), "utf-8-sig"))
        .when(wide.isNotNull(), told(wide, "utf-16"))
        .when(valid, told(plain, "utf-8"))
        .when(~latin.rlike("[\\x81\\x8D\\x8F\\x90\\x9D]"), told(windows, "cp1252"))
        .otherwise(F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("encoding")))
    )
