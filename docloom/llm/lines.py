"""Line dedup by winnowing: window minima of line hashes as fingerprints, joined and extended to the runs around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import private, settled, spread_join

RUN = 2  # lines that a repeated run must have; also the winnowing window, so each such run holds a fingerprint
LONG_WORDS = 50  # words from which one line is a run by itself


def line_count_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def winnowed(lines: DataFrame, run: int, long_words: int, extended: bool) -> DataFrame:
    """(id, tag, h) of each fingerprint, a line of ``lines`` (id, tag, lines) that has the least hash of some window of ``run`` lines.

    Of equal hashes in a window the first counts, so equal windows choose the same line. A line that several windows choose
    is one fingerprint; one that only windows of blank lines choose is none; a long line is one by itself. ``extended`` adds
    ``runs``: begin, size and SHA-256 of the windows that chose the line, which extend it to both sides.
    """
    facts = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.trim(x) == "").alias("blank"), (line_count_words(x) >= long_words).alias("long")))
    starts = F.when(F.size("l") >= run, F.sequence(F.lit(0), F.size("l") - run)).otherwise(F.array().cast("array<int>"))

    def chosen(i: Column) -> Column:
        part = F.slice("l", i + 1, run)
        h = F.transform(part, lambda x: x["h"])
        return F.when(~F.forall(part, lambda x: x["blank"]), i + F.array_position(h, F.array_min(h)).cast("int") - 1)

    def digest(i: Column, size: int) -> Column:
        return F.struct(i.alias("pos"), F.lit(size).alias("size"), F.unhex(F.sha2(F.array_join(F.slice("lines", i + 1, size), "\n"), 256)).alias("run"))

    def fingerprint(x: Column, p: Column) -> Column:
        alone = x["long"] & ~x["blank"]
        windows = F.filter(F.sequence(F.greatest(p - (run - 1), F.lit(0)), p), lambda i: F.get("c", i) == p)
        runs = [F.concat(F.transform(windows, lambda i: digest(i, run)), F.when(alone, F.array(digest(p, 1))).otherwise(F.array().cast("array<struct<pos:int,size:int,run:binary>>"))).alias("runs")] if extended else []
        return F.when(alone | (F.size(windows) > 0), F.struct(x["h"].alias("h"), *runs))

    shown = lines.withColumn("l", facts).withColumn("c", F.transform(starts, chosen))
    found = F.filter(F.transform("l", fingerprint), lambda x: x.isNotNull())
    return shown.select("id", "tag", F.inline(found))


def repeated_lines(lines: DataFrame, run: int, long_words: int) -> DataFrame:
    """(id, tag, gone): the positions to delete in each document of ``lines`` that has any.

    Fingerprints are joined with the hashes that occur again; only what is left is extended. Runs are equal by SHA-256. A
    run meets the first place of its text alone, never all others. Hashes and runs that many rows share are salted.
    """
    again = settled(winnowed(lines, run, long_words, False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    near = spread_join(winnowed(lines, run, long_words, True), again.select("h"), "h", ["id", "tag"], "inner", again)
    near = settled(near.select("id", "tag", F.inline("runs")))
    place = F.struct("id", "tag", "pos")
    first = settled(near.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = spread_join(near, first.drop("n"), "run", ["id", "tag", "pos"], "inner", first).where(place > F.col("first"))
    gone = later.select("id", "tag", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("pos"))
    return gone.groupBy("id", "tag").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents with ``text_col`` shortened, plus n_lines, n_removed and n_runs (maximal stretches removed).

    A run is ``run`` lines in a row, or one line of ``long_words`` words. The first place of a run, by (id, text hash,
    line), stays; the lines of each later one go, and with them all that overlapping later runs cover, so a match
    reaches as far both ways as it holds. Every run holds a fingerprint, so none is missed; a single line of fewer words
    that repeats without its neighbours stays. Lines end at a line feed and may be of any number and length. Null texts count as empty
    and stay null; blank lines alone are no run; null ids come last; rows that repeat an id and text are one
    document and are treated alike. Other columns are kept, whatever their names; those named n_lines, n_removed or n_runs
    are replaced. No rows give no rows.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    key, tag, gone, split = private(docs, "key", "tag", "gone", "split")
    body = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(body, "\n")
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), tag: F.xxhash64(body)})
    found = repeated_lines(keyed.select(F.col(key).alias("id"), F.col(tag).alias("tag"), lines.alias("lines")), run, long_words)
    found = found.select(F.col("id").alias(key), F.col("tag").alias(tag), F.col("gone").alias(gone))
    joined = keyed.join(found, [key, tag], "left").withColumns({gone: F.coalesce(gone, F.array().cast("array<int>")), split: lines})  # a column, so that a text is split once
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.size(gone) == 0, F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    runs = F.size(F.filter(F.col(gone), lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1)))
    counts = {"n_lines": F.size(split), "n_removed": F.size(gone), "n_runs": runs}
    return joined.withColumns({k: v.cast("long") for k, v in counts.items()}).withColumn(text_col, text).drop(key, tag, gone, split)


def oracle_sql(run: int = RUN, long_words: int = LONG_WORDS) -> str:
    """Per document, over DuckDB's documents: doc_id, n_lines, n_removed, n_runs, kept_sha256."""
    lead = ", ".join(f"lead(line, {k}) OVER w AS l{k}" for k in range(1, run))
    parts = [f"l{k}" for k in range(1, run)]
    blank = " AND ".join(f"trim({x}, ' ') = ''" for x in ["line", *parts])
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM d),
r AS (SELECT *, {lead} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
u AS (SELECT doc_id, pos, {run} AS size, [line, {', '.join(parts)}] AS run FROM r WHERE {parts[-1]} IS NOT NULL AND NOT ({blank})
      UNION ALL SELECT doc_id, pos, 1, [line] FROM l WHERE length(line) - length(replace(line, ' ', '')) + 1 >= {long_words} AND trim(line, ' ') <> ''),
f AS (SELECT *, min((doc_id, pos)) OVER (PARTITION BY size, run) AS first FROM u),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM f WHERE (doc_id, pos) > first),
k AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone,
      g.pos IS NOT NULL AND NOT coalesce(lag(g.pos IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.pos), false) AS starts
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed, (count(*) FILTER (starts))::BIGINT AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id"""
