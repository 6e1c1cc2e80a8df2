"""Sources: file routing, text and table elements, HTML pages; everything is read by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.unicode import decoded_text

# Parsers by media type, then by extension.
BY_MEDIA = {"application/pdf": "pdf", "text/plain": "text", "text/markdown": "text", "text/csv": "table", "text/html": "html", "image/png": "image", "image/jpeg": "image", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "office"}
BY_EXTENSION = {"pdf": "pdf", "txt": "text", "md": "text", "csv": "table", "html": "html", "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "docx": "office", "xlsx": "office", "pptx": "office"}
GENERIC_MEDIA = ["application/octet-stream", "application/zip", "application/x-ole-storage", ""]


def route(name: Column, media: Column) -> Column:
    """The parser for a file: by media type without its parameters; by extension where that is generic; sound and film are unsupported."""
    kind, ext = F.lower(F.trim(F.regexp_extract(F.coalesce(media, F.lit("")), "^([^;]*)", 1))), F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    pick = lambda by: F.create_map(*(F.lit(x) for pair in by.items() for x in pair))
    return (
        F.when(kind.startswith("audio/") | kind.startswith("video/"), "unsupported")
        .when((kind == "text/plain") & (ext == "csv"), "table")
        .when(kind.isin(GENERIC_MEDIA), F.coalesce(F.try_element_at(pick(BY_EXTENSION), ext), F.lit("unsupported")))
        .otherwise(F.coalesce(F.try_element_at(pick(BY_MEDIA), kind), F.lit("unsupported")))
    )


def text_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, text, line_start, line_end): paragraphs between blank lines, lines counted from 1."""
    split = docs.select(id_col, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("_lines"))
    split = split.withColumn("_full", F.transform("_lines", lambda x: F.trim(x) != ""))  # columns, so that no line is looked at twice
    every = F.sequence(F.lit(0), F.size("_full") - 1)
    full = lambda i: F.coalesce(F.get("_full", i), F.lit(False))
    begins = F.filter(every, lambda i: full(i) & ((i == 0) | ~full(i - 1)))
    ends = F.filter(every, lambda i: full(i) & ~full(i + 1))
    shown = split.select(id_col, "_lines", F.posexplode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("ordinal", "_p"))
    text = F.array_join(F.slice("_lines", F.col("_p.a") + 1, F.col("_p.b") - F.col("_p.a") + 1), "\n")
    return shown.select(id_col, "ordinal", text.alias("text"), (F.col("_p.a") + 1).alias("line_start"), (F.col("_p.b") + 1).alias("line_end"))


LAYOUT = "doc_id long, ordinal int, kind string, level int, text string, page int, section string"


def layout_elements(pages: DataFrame, id_col: str = "doc_id", json_col: str = "layout") -> DataFrame:
    """(doc_id, ordinal, kind, level, text, page, section) of layout trees given as JSON, in reading order.

    A node has a type, its content, kids, a page number and, as a heading, a level. Headings open sections and close those
    at their level or below. A table's rows have cells with a column number and span; each row below the first becomes one
    element, `Header: value | ...`. What is no object, and JSON that can't be read, gives no elements.
    """

    def positive(value: object) -> int | None:
        """A whole number of 1 or more, also if given as text; else None."""
        try:
            n = int(value)  # type: ignore[call-overload]
        except (TypeError, ValueError, OverflowError):
            return None
        return n if n >= 1 else None

    def text_of(node: object) -> str:
        if isinstance(node, dict):
            own = node.get("content")
            kids = " ".join(filter(None, (text_of(k) for k in node.get("kids") or [])))
            return " ".join(filter(None, (own.strip() if isinstance(own, str) else "", kids)))
        return ""

    def row_cells(row: dict) -> list[str]:
        out: list[str] = []
        for cell in (x for x in row.get("cells") or [] if isinstance(x, dict)):
            column, span = positive(cell.get("column number")) or len(out) + 1, positive(cell.get("column span")) or 1
            out += [""] * (column - 1 - len(out)) + [text_of(cell)] * span
        return out

    def walk(node: object, path: list[str], page: int | None) -> Iterator[tuple]:
        if not isinstance(node, dict):
            return
        page = positive(node.get("page number")) or page
        kind = node.get("type")
        if kind == "table":
            rows = [row_cells(r) for r in node.get("rows") or [] if isinstance(r, dict)]
            for row in rows[1:]:
                named = [f"{h}: {v}" if h else v for h, v in zip(rows[0] + [""] * len(row), row, strict=False) if v]
                yield ("table_row", 0, " | ".join(named), page, " > ".join(path))
            return
        if kind == "heading":
            level, text = positive(node.get("heading level")) or 1, text_of(node)
            path[level - 1 :] = [text]
            yield ("heading", level, text, page, " > ".join(path))
            return
        if isinstance(node.get("content"), str) and node["content"].strip():
            yield (str(kind or "paragraph"), 0, node["content"].strip(), page, " > ".join(path))
        for kid in node.get("kids") or []:
            yield from walk(kid, path, page)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, raw in zip(pdf["id"], pdf["raw"], strict=True):
                try:
                    tree = json.loads(raw or "null")
                except ValueError:
                    continue
                out += [(doc, k, *e) for k, e in enumerate(walk(tree, [], None))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LAYOUT.split(", ")]).astype({"page": "Int64"})

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("raw")).mapInPandas(run, LAYOUT)


def grid_text(cells: DataFrame, table: list[str], row: str = "row", column: str = "column", text: str = "text") -> DataFrame:
    """(table keys, text) of tables given as cells: rows in order, their cells joined by bars with gaps as empty ones.

    A row's cells are few, so they are gathered a row at a time; rows of a table then as texts.
    """
    tidy = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    rows = cells.groupBy(*table, row).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(column).cast("int"), tidy)))).alias("_m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_m"))), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(""))), " | ")
    lines = rows.select(*table, F.struct(F.col(row), line.alias("line")).alias("_l"))
    return lines.groupBy(*table).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "\n").alias("text"))


def page_text(html: Column) -> Column:
    """Readable text of a page: no scripts, styles, navigation, footers or comments; tags become spaces."""
    gone = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|head|aside)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(gone, r"(?s)<[^>]*>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def table_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV file under a declared schema, one `Header: value | ...` text for each row."""
    rows = spark.read.schema(schema).csv(path, header=header)
    return rows.withColumn("row_text", F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in rows.columns)))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of text files, read by byte order mark, as UTF-8 or as cp1252; null where none of them fits."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decoded_text("content").alias("_found")).select("path", "_found.text", "_found.encoding")
