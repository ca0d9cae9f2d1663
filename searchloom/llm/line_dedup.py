"""Line dedup by content-defined chunks, in built-in SQL functions only.

Every line gets a hash; a polynomial hash rolls over the last ``WINDOW`` line
hashes, and a chunk ends where it falls in one residue class.  Boundaries depend
on the lines near them alone, so an insertion shifts no other chunk.  A chunk of
at least two lines that occurs more than once in the table is kept where it
comes first (by doc_id, then the row's place in the input, then place in the text)
and removed elsewhere.  Equal hashes only nominate chunks: the grouping that
decides compares their bytes.

Shuffles: one of 8-byte chunk hashes (summed before it is sent), one of the
multi-line chunks to the hashes that repeat, one of the nominated chunks, and one
of the texts, to cut them.  Hot chunks meet in sorted joins, which adaptive
execution splits; no group is collected.

A chunk meets its copy only if both begin and end at the same lines, so most
repeated passages of few lines stay (figures in the README).  op8's SQL and the
pipeline's test fix this rule.  ``remove_repeated_passages`` isn't bound to it: it
nominates every pair of neighbouring lines, so that no repeated run of two lines
or more is missed, wherever it begins (query ``line_passages``).

Defined cases: a null text stays null and has no lines; an empty text is one
empty line; lines end at line feeds only and carriage returns belong to them;
identical documents keep their repeated chunks once in the table, so a copy may
become the text of its unrepeated lines, or ''.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import read_table, save, unused

#: Lines that decide on a boundary, chunks' mean length in lines, base and modulus of the rolling hash.
WINDOW, MEAN_LINES, BASE, MODULUS = 2, 3, 257, 16_777_213


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, not at each use in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_hash(line: Column) -> Column:
    """The first 24 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 6), 16, 10).cast("long")


def _ends(lines: Column) -> Column:
    """The 1-based numbers of the lines that end a chunk; the last line does."""

    def of(h: Column) -> Column:
        n = F.size(h)
        rolled = lambda i: sum(F.when(i > k, F.element_at(h, (i - k).cast("int"))).otherwise(F.lit(0)) * BASE**k for k in range(WINDOW))
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (rolled(i) % MODULUS % MEAN_LINES == 0))

    return let(F.transform(lines, line_hash), of)


def chunks(text: Column) -> Column:
    """array<struct<n_lines int, body string>> of a text that isn't null."""

    def cut(lines: Column) -> Column:
        def at(ends: Column) -> Column:
            return F.transform(
                ends,
                lambda e, j: let(
                    F.when(j == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(j, F.lit(1)))),
                    lambda before: F.struct((e - before).alias("n_lines"), F.array_join(F.slice(lines, before + 1, e - before), "\n").alias("body")),
                ),
            )

        return let(_ends(lines), at)

    return let(F.split(text, "\n", -1), cut)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number ``row``, the same whenever the plan runs again.

    Over a bare scan it is the place in the input's files.  Rows that come from a
    shuffle or from Python may come in another order next time, so they are
    written first.
    """
    todo, steps = [docs._jdf.queryExecution().optimizedPlan()], set()
    while todo:
        node = todo.pop()
        steps.add(node.nodeName())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    bare = steps <= {"Project", "Filter", "LogicalRelation"}
    return (docs if bare else save(docs, "numbered")).select("*", F.monotonically_increasing_id().alias(row))


def _later(parts: DataFrame) -> DataFrame:
    """The rows of ``parts`` (d, r, p, body, h) whose body comes before, by (d, r, p)."""
    repeated = parts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    nominated = save(parts.join(repeated, "h"), "repeated-chunks")
    place_of = F.struct(F.col("d"), F.col("r"), F.col("p"))
    firsts = nominated.groupBy("h", "body").agg(F.min(place_of).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return nominated.join(firsts, ["h", "body"]).where(~place_of.eqNullSafe(F.col("first")))


def remove_repeated_chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", removed: str | None = None) -> DataFrame:
    """``docs`` with repeated multi-line chunks cut out of ``text``.

    ``removed``: the name of a further column with how many lines went.
    """
    row, found, cut = (unused(docs, f"_{x}") for x in ("row", "chunk", "cut"))
    base = numbered(docs, row)
    parts = (
        base.where(F.col(text).isNotNull())
        .select(F.col(doc_id).alias("d"), F.col(row).alias("r"), F.posexplode(chunks(F.col(text))).alias("p", "c"))
        .where("c.n_lines >= 2")
        .select("d", "r", "p", F.col("c.body").alias("body"), F.xxhash64("c.body").alias("h"))
    )
    cuts = _later(parts).groupBy(F.col("r").alias(row)).agg(F.collect_set("p").alias(cut))  # a row's own chunks only
    marked = base.join(cuts, row, "left")

    def kept(parts: Column) -> Column:
        left = F.filter(parts, lambda c, i: ~F.array_contains(F.col(cut), i))
        lines = lambda some: F.aggregate(some, F.lit(0), lambda n, c: n + c["n_lines"])
        return F.struct(F.array_join(F.transform(left, lambda c: c["body"]), "\n").alias("text"), (lines(parts) - lines(left)).alias("n"))

    result = marked.withColumn(found, F.when(F.col(cut).isNotNull(), let(chunks(F.col(text)), kept)))
    columns = [F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.col(found)["text"]).alias(text) if c == text else F.col(c) for c in docs.columns]
    return result.select(*columns, *([F.coalesce(F.col(found)["n"], F.lit(0)).alias(removed)] if removed else []))


def line_pairs(text: Column) -> Column:
    """array<string> of each line with the next, of a text that isn't null; lines hold no line feed, so a pair is read in one way."""

    def cut(lines: Column) -> Column:
        return F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda line, i: F.concat(line, F.lit("\n"), F.element_at(lines, i + 2)))

    return let(F.split(text, "\n", -1), cut)


def remove_repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", removed: str | None = None) -> DataFrame:
    """``docs`` without any run of at least two lines that comes before in the table.

    A run comes before if each pair of its neighbouring lines does, so the lines
    that go are all those of all maximal shared runs but their first
    occurrences.  A line that goes is left at an earlier place.

    ``removed``: the name of a further column with how many lines went.
    """
    row, found, cut = (unused(docs, f"_{x}") for x in ("row", "passage", "cut"))
    base = numbered(docs, row)
    parts = (
        base.where(F.col(text).isNotNull())
        .select(F.col(doc_id).alias("d"), F.col(row).alias("r"), F.posexplode(line_pairs(F.col(text))).alias("p", "body"))
        .select("d", "r", "p", "body", F.xxhash64("body").alias("h"))
    )
    cuts = _later(parts).groupBy(F.col("r").alias(row)).agg(F.collect_set("p").alias(cut))  # a row's own pairs only
    marked = base.join(cuts, row, "left")

    def kept(lines: Column) -> Column:
        gone = F.concat(F.col(cut), F.transform(F.col(cut), lambda p: p + 1))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return let(left, lambda i: F.struct(F.array_join(F.transform(i, lambda k: F.element_at(lines, k + 1)), "\n").alias("text"), (F.size(lines) - F.size(i)).alias("n")))

    result = marked.withColumn(found, F.when(F.col(cut).isNotNull(), let(F.split(F.col(text), "\n", -1), kept)))
    columns = [F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.col(found)["text"]).alias(text) if c == text else F.col(c) for c in docs.columns]
    return result.select(*columns, *([F.coalesce(F.col(found)["n"], F.lit(0)).alias(removed)] if removed else []))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_chunks(docs, removed="lines_removed")


def line_passages(spark, sf_dir: str) -> DataFrame:
    """Every repeated run of two lines or more goes, wherever it begins."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs, removed="lines_removed")


PASSAGES_SQL = """
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), pairs AS (
  SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM lines
), later AS (
  SELECT doc_id, i FROM pairs WHERE body IS NOT NULL QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1
), gone AS (
  SELECT doc_id, i FROM later UNION SELECT doc_id, i + 1 FROM later
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text, CAST(count(g.i) AS INT) AS lines_removed
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN k.text END AS text, coalesce(k.lines_removed, 0) AS lines_removed FROM documents d LEFT JOIN kept k USING (doc_id)
"""


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 6) AS BIGINT) AS h FROM lines
), rolled AS (
  SELECT *, (h + {BASE} * coalesce(lag(h) OVER w, 0)) % {MODULUS} % {MEAN_LINES} = 0 AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rolled
), chunk AS (
  SELECT doc_id, c, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, c
), ranked AS (
  SELECT *, n_lines >= 2 AND row_number() OVER (PARTITION BY body, n_lines >= 2 ORDER BY doc_id, c) > 1 AS gone FROM chunk
), kept AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (NOT gone), '') AS text, CAST(coalesce(sum(n_lines) FILTER (gone), 0) AS INT) AS lines_removed FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, coalesce(k.lines_removed, 0) AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated multi-line chunks leave the texts; every document stays."""
    return remove_repeated_chunks(docs)
