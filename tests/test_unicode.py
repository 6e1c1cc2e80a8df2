"""Encodings and composed forms against Python's own codecs and unicodedata."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import unicode
from docloom.sources import readers

TEXTS = ["plain", "gr\u00f6\u00dfe", "gro\u0308\u00dfe", "e\u0323\u0301", "\u212b \u2126", "\u1112\u1161\u11ab", "a\u0301\u0300", "\u0958", "\u65e5\u672c\u8a9e", "", "x\u0308y\u0307", "\u1e9b\u0323", "\uf900"]


def test_composed_forms(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    got = [r[0] for r in rows.select(unicode.nfc("t")).collect()]
    assert got == [unicodedata.normalize("NFC", t) for t in TEXTS] + [None]
    assert spark.range(1).select(unicode.normalize_composed(F.lit(" größe \t x"))).first()[0] == "größe x"


def test_latin_letters_are_composed_whatever_stands_before():
    assert all(unicodedata.is_normalized("NFC", chr(k)) and not unicodedata.combining(chr(k)) for k in range(0x300))
    assert all(unicodedata.is_normalized("NFC", a + chr(k)) for a in "aeiouAz" for k in range(0x300))


def as_python(data):
    marks = [("utf-8-sig", b"\xef\xbb\xbf"), ("utf-16", b"\xff\xfe"), ("utf-16", b"\xfe\xff")]
    for codec in [c for c, m in marks if data.startswith(m)] + ["utf-8", "cp1252"]:
        try:
            return data.decode(codec), codec
        except UnicodeDecodeError:
            pass
    return None, None


@pytest.mark.parametrize(
    "data",
    [
        b"", b"abc", "größe €".encode(), "größe €".encode("cp1252"), "größe".encode("utf-16"), "größe".encode("utf-16-be"), b"\xfe\xff" + "größe 😀".encode("utf-16-be"), b"\xef\xbb\xbfabc", b"\xef\xbb\xbf\xff",
        b"\xff\xfea", b"\xff\xfe\x00\xd8", b"\x81abc", bytes(range(0x82, 0x8D)), bytes(range(0x91, 0x9D)), b"\x9e\x9f\xa0\xff", b"\xef\xbb\xbf", b"\xed\xa0\x80",
    ],
)
def test_bytes_are_read_as_python_reads_them(spark, data):
    got = spark.createDataFrame([(data,)], "content binary").select(unicode.decoded_text("content").alias("x")).first()["x"]
    assert (got["text"], got["encoding"]) == as_python(data)


def test_files_of_four_encodings(spark, tmp_path):
    for name, codec in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "utf-16"), ("d", "cp1252")):
        (tmp_path / f"{name}.txt").write_bytes("größe €\nzwei".encode(codec))
    got = readers.whole_texts(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {r["text"] for r in got} == {"größe €\nzwei"}
