"""A Merkle manifest of a dataset: a hash tree a group, one over the groups, and every row's proof.

A row's leaf hashes its columns; a group's leaves lie in order of a key (doc_id);
every ``FANOUT`` consecutive nodes become the hash of their hashes, until one is
left, the group's subroot; the subroots, in order of the groups' names, become the
root likewise.  Hashes are SHA-256 in lower-case hex, hashed again as text.

Ranks come without a sort of a group.  The key's digits make a radix trie: rows are
counted by (group, key >> 8), these counts by (group, key >> 22), and so on up,
each summed before it is sent.  From the top down, a digit's start is its parent's
start and what its lesser siblings count, at most 2**14 of them; the 256 keys of a
lowest prefix number themselves.  A rank's digits in base ``FANOUT`` then are a
node's path: a level groups by the longest prefix, all digits but the last, so
that no group has over ``FANOUT`` rows.  Proofs come from the root down: a row a
node, with the siblings on its path, at most 64 x (FANOUT - 1) bytes a level, is
joined to the row of its children.

A lowest prefix of over ``DEEP`` rows has repeated keys or none; its rows are told
apart further by their leaves' first digits.

Defined cases: a null column counts as ``-``; rows without a key come first in
their group, equal keys by their leaves; rows without a group form one that comes
first.  Rows equal in every column have equal leaves, and one place each.  An empty
table has no rows and no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import batched, read_table, save, unused

#: Children of a node: a power of two.
FANOUT, BITS = 16, 4
#: Bits of the lowest prefix's keys and of the digits above, and rows from which a prefix is told apart by leaves too.
LOW, DIGIT, LEVELS, DEEP = 8, 14, 4, 4096
#: Fixed value: a missing value.
MISSING = "-"


def leaf(*values: Column) -> Column:
    """The hash of some values: ``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit(MISSING)) for t in text)).cast("binary"), 256)


def fold(start: Column, path: Column) -> Column:
    """The root from a leaf and the siblings (l, r) on its path."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings on a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "").cast("binary"), 256)


def _starts(counts: DataFrame) -> DataFrame:
    """(g, b, start, n) of counts (g, b, n) by lowest prefix: how many rows of the group come before, and how many it has."""
    up = lambda b: F.shiftright(b, DIGIT)
    levels = [counts]
    for _ in range(LEVELS - 1):
        levels.append(levels[-1].groupBy("g", up(F.col("b")).alias("b")).agg(F.sum("n").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "up").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At the top at most 2**14 digits are left of 64 bits.
    start = levels[-1].withColumn("up", F.lit(0)).select("g", "b", before.alias("start"), F.sum("n").over(Window.partitionBy("g")).alias("n"))
    for level in reversed(levels[:-1]):
        own = level.withColumn("up", up(F.col("b"))).select("g", "b", "up", before.alias("own"))
        start = own.join(start.select("g", F.col("b").alias("up"), "start", "n"), ["g", "up"]).select("g", "b", (F.col("own") + F.col("start")).alias("start"), "n")
    return start


def ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (g string, k long, leaf string, ...) with their rank ``i`` from 0 among the group's ``n`` rows, by (k, leaf)."""
    lowest = F.coalesce(F.shiftright("k", LOW), F.lit(-(1 << (63 - LOW)) - 1))
    rows = rows.withColumn("b", lowest)
    counts = save(rows.groupBy("g", "b").agg(F.count("*").alias("n")), "prefix-counts")
    starts = save(_starts(counts), "prefix-starts")
    names = [c for c in rows.columns if c != "b"]
    place = lambda *by: F.row_number().over(Window.partitionBy("g", "b", *by).orderBy(F.col("k").asc_nulls_first(), "leaf")) - 1

    deep = counts.where(F.col("n") > DEEP).select("g", "b")
    if deep.isEmpty():
        return rows.join(starts, ["g", "b"]).select(*names, (F.col("start") + place()).alias("i"), "n")
    shallow = rows.join(deep, ["g", "b"], "left_anti").join(starts, ["g", "b"]).select(*names, (F.col("start") + place()).alias("i"), "n")
    # Of a deep prefix: its 257 keys times 4096 digits of leaves, counted; a window over these counts, then one over each.
    digits = rows.join(deep, ["g", "b"]).withColumn("x", F.struct(F.col("k").isNotNull().alias("a"), F.coalesce("k", F.lit(0)).alias("k"), F.substring("leaf", 1, 3).alias("d")))
    sums = digits.groupBy("g", "b", "x").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = save(sums.select("g", "b", "x", before.alias("before")).join(starts, ["g", "b"]).select("g", "b", "x", (F.col("before") + F.col("start")).alias("start"), "n"), "deep-starts")
    return shallow.unionByName(digits.join(offsets, ["g", "b", "x"]).select(*names, (F.col("start") + place("x")).alias("i"), "n"))


def _name_ranks(names: DataFrame) -> DataFrame:
    """(g, i): the names' places in byte order.  Ranges of names are numbered, and a row a range is summed."""
    ranged = save(names.repartitionByRange("g").select("g", F.spark_partition_id().alias("part")), "names")
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1
    return ranged.select("g", "part", place.alias("p")).join(before, "part", "left").select("g", (F.col("p") + F.coalesce("before", F.lit(0))).cast("long").alias("i"))


def _reduced(nodes: DataFrame, largest: int, extra: tuple[str, ...] = ()) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of nodes (g, i, h, n; n: nodes of the group, at most ``largest``) a table of runs a level, and the nodes of each level that are their group's last.

    A run (g, i, h, n, kids): a node of the next level and its children, in order;
    at the lowest level these keep the ``extra`` columns.
    """
    runs, done = [], [nodes.where("n = 1")]
    while largest > 1:
        kid = F.struct("i", "h", *(extra if not runs else ()))
        level = nodes.where("n > 1").groupBy("g", F.shiftright("i", BITS).alias("i"), "n").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        node = F.sha2(F.array_join(F.col("kids.h"), "").cast("binary"), 256).alias("h")
        runs.append(save(level.select("g", "i", node, F.floor((F.col("n") + FANOUT - 1) / FANOUT).cast("long").alias("n"), "kids"), "runs"))
        nodes = runs[-1].select("g", "i", "h", "n")
        done.append(nodes.where("n = 1"))
        largest = -(-largest // FANOUT)
    return runs, done


_PATH = "array<struct<l:string,r:string>>"


def _paths(runs: list[DataFrame], done: list[DataFrame], tops: DataFrame | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(g, i, h, top, path, extra...) of the lowest nodes; ``tops`` (g, path) has what comes above a group's last node, ``top`` is that node's hash."""

    def begun(level: int) -> DataFrame:
        last = done[level].withColumn("top", F.col("h"))
        if tops is None:
            return last.withColumn("path", F.expr(f"cast(array() as {_PATH})"))
        return last.join(tops, "g")

    def kept(level: int) -> list[str]:
        return ["g", "i", "h", "top", "path", *(extra if level == 0 else ())]

    above = begun(len(runs)).select(*kept(len(runs)))
    for level in range(len(runs) - 1, -1, -1):
        joined = runs[level].select("g", "i", "kids").join(above.select("g", "i", "top", "path"), ["g", "i"])
        each = joined.select("g", "top", "path", F.col("kids.h").alias("hs"), F.posexplode("kids").alias("p", "kid"))
        size = F.size("hs")
        own = F.struct(F.array_join(F.slice("hs", F.lit(1), F.col("p")), "").alias("l"), F.array_join(F.slice("hs", F.col("p") + 2, F.greatest(size - F.col("p") - 1, F.lit(0))), "").alias("r"))
        path = F.concat(F.array(own), F.col("path"))
        below = each.select("g", F.col("kid.i").alias("i"), F.col("kid.h").alias("h"), "top", path.alias("path"), *(F.col(f"kid.{c}").alias(c) for c in (extra if level == 0 else ())))
        above = below.unionByName(begun(level).select(*kept(level)))
        if level:
            above = save(above, "paths")
    return above


def manifest(docs: DataFrame, leaves: dict[str, Column], key: str = "doc_id", group: str = "source") -> DataFrame:
    """One row a row of ``docs``: key, group, i (its rank in the group), subroot, root, path (the siblings l and r on its way up), and the hashes of ``leaves``.

    The first of ``leaves`` builds the tree; further ones, such as a changed
    row's, come along.
    """
    first, *others = leaves
    extra = ("k", *(f"x{i}" for i in range(len(others))))
    # The group's name as bytes in order, a missing one before all.
    name = F.coalesce(F.concat(F.lit("."), F.col(group).cast("string")), F.lit(""))
    rows = save(docs.select(name.alias("g"), F.col(key).cast("long").alias("k"), leaves[first].alias("leaf"), *(leaves[o].alias(x) for o, x in zip(others, extra[1:], strict=True))), "leaves")
    sizes = save(rows.groupBy("g").agg(F.count("*").alias("n")), "group-sizes")
    ranked = ranks(rows).select("g", "i", F.col("leaf").alias("h"), "n", *extra)
    groups, largest = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    runs, done = _reduced(save(ranked, "ranked"), largest, extra)

    subroots = reduce(DataFrame.unionByName, (d.select("g", "h") for d in done))
    placed = subroots.join(_name_ranks(sizes.select("g")), "g")
    every = save(placed.select(F.lit("").alias("g"), "i", "h", F.lit(groups).cast("long").alias("n"), F.col("g").alias("name")), "subroots")
    tops = save(_paths(*_reduced(every, groups, ("name",)), None, ("name",)).select(F.col("name").alias("g"), F.col("top").alias("root"), "path"), "tops")

    found = _paths(runs, done, tops.select("g", "path"), extra)
    root = tops.select("root").first()
    named = F.when(F.col("g") == "", None).otherwise(F.substring("g", F.lit(2), F.length("g")))
    return found.select(
        F.col("k").alias(key), named.alias(group), "i", F.col("top").alias("subroot"), F.lit(root.root if root else None).cast("string").alias("root"), "path",
        F.col("h").alias(first), *(F.col(x).alias(o) for o, x in zip(others, extra[1:], strict=True)),
    )


def verified(proofs: DataFrame, found: Column, root: Column | None = None) -> DataFrame:
    """``proofs`` of a manifest with folded_root, from the leaf ``found``, and whether that is the root."""
    folded = proofs.withColumn("folded_root", fold(found, F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == (root if root is not None else F.col("root")))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@batched
def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    whole, changed = leaf(*map(F.col, COLUMNS)), leaf(*map(F.col, COLUMNS[:-1]), lower)
    proofs = manifest(docs, {"leaf": whole, "changed": F.when(tampered, changed)})
    checked = verified(proofs, F.coalesce("changed", "leaf"))
    return checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _op13_sql(levels: int = 6, tops: int = 4) -> str:
    """The same for DuckDB, level by level: enough levels for 16**6 rows a group and 16**4 groups."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, CAST(b AS BIGINT))], range(8)), lambda c, x: {bit})"
    crc = f"xor(list_reduce(list_concat([4294967295], [ord(d) for d in split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {byte}), 4294967295)"
    ctes = [
        f"leaves AS (SELECT doc_id, coalesce('.' || source, '') AS g, sha256({' || '.join(map(value, COLUMNS))}) AS leaf, "
        f"CASE WHEN {crc} % 5 = 0 THEN sha256({' || '.join([*map(value, COLUMNS[:-1]), value(lower)])}) END AS changed FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
    ]

    def tree(name: str, count: int) -> None:
        for k in range(count):
            run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            sides = f"CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r"
            ctes.append(f"{name}x{k} AS (SELECT DISTINCT g, i, n, {sides} FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (n + 15) // 16 AS n FROM {name}{k} GROUP BY g, i // 16, n)")

    tree("s", levels)
    ctes.append(f"t0 AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM s{levels})")
    tree("t", tops)
    ctes.append(f"w0 AS (SELECT s0.doc_id, s0.g, s0.i, leaf, t0.h AS subroot, t0.i AS j, (SELECT any_value(h) FROM t{tops}) AS root, '' AS proof, coalesce(changed, leaf) AS f FROM s0 JOIN t0 ON t0.name = s0.g)")
    for k in range(levels + tops):
        name, at, div = ("s", "w.i", 16**k) if k < levels else ("t", "w.j", 16 ** (k - levels))
        level = k if k < levels else k - levels
        on = f"x.i = {at} // {div}" + (" AND x.g = w.g" if name == "s" else "")
        ctes.append(f"w{k + 1} AS (SELECT w.* EXCLUDE (proof, f), proof || l || r AS proof, CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f FROM w{k} w JOIN {name}x{level} x ON {on})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM w{levels + tops}"


OP13_SQL = _op13_sql()
