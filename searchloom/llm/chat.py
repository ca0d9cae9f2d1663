"""Chat formatting in budgeted windows, in built-in SQL functions only.

A turn is rendered as ``### Role: text </turn>``; backslashes, ``#``, ``<`` and,
in roles, ``:`` are escaped inside, so no control string can occur in a text and
every rendering can be read back.

A conversation's turns lie in chunks of ``CHUNK`` turn numbers, and where turn
numbers are null or repeat, in parts of at most ``CHUNK`` rows of a chunk.  In each
part the prefix sums of the turns' sizes choose spans aligned to turns: a span is all
turns that lie wholly in one stretch of ``NEW`` bytes of the running sum; a turn
across the border of two stretches is a span alone.  A window is the
conversation's leading system turn, up to ``HISTORY_TURNS`` turns of at most
``HISTORY`` bytes before the span, and the span.  The loss mask covers the
assistants' texts of the span alone: what is repeated as system turn or history
is masked, so each assistant text is learned from once.  Only a single turn
larger than its part of the budget makes a window exceed it: a long new turn, or
a system turn of more than ``SYSTEM`` bytes, which leads all the same.  No text
is cut.

Budgets are in bytes of the rendered turn: a byte-level tokeniser makes no more
tokens than bytes (of code points it may make three or four each).  The mask and
a window's ``size`` count code points.  Groups are parts of a chunk of a
conversation, so that one conversation that holds a third of all rows is spread;
only a part's last turns go to the next one.

Defined cases: a null text is empty; a null role is an empty role; turns order
by turn number (null first), then role, then text, and repeated rows are all
kept; a null conv_id is a conversation of its own; an empty table gives no
windows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read_table, save

CHUNK = 64
#: Bytes a window may have: the system turn's, the history's and the span's.
SYSTEM, HISTORY, NEW = 2048, 2048, 4096
HISTORY_TURNS = 2
END = " </turn>\n"


def escape(text: Column) -> Column:
    """Reversible: afterwards no ``#`` and no ``<`` is left, and each backslash begins an escape."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def _role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def _role_out(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), _role_in(role), F.lit(": "), escape(text), F.lit(END))


def windows(turns: DataFrame) -> DataFrame:
    """One row a window: conv_id, chunk, part, span, first_turn, n_context, n_new, formatted, loss, size.

    ``formatted`` is the whole text, ``loss`` the spans of code points under the
    loss mask (start, length), ``n_context`` how many of the leading turns are
    repeated or the system's.
    """
    typed = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**60))).cast("long")
    rows = typed.select("conv_id", chunk.alias("chunk"), F.struct("turn", "role", "text", render(F.col("role"), F.col("text")).alias("shown")).alias("t"))
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("t"))
    rows = rows.withColumn("part", F.floor((place - 1) / CHUNK).cast("long"))
    chunks = save(rows.groupBy("conv_id", "chunk", "part").agg(F.array_sort(F.collect_list("t")).alias("turns")), "chat-chunks")
    # What a chunk needs from others: the turns just before it, and the conversation's system turn.
    order = Window.partitionBy("conv_id").orderBy("chunk", "part")
    edges = chunks.select("conv_id", "chunk", "part", F.slice("turns", F.greatest(F.size("turns") - HISTORY_TURNS + 1, F.lit(1)), HISTORY_TURNS).alias("tail"), F.element_at("turns", 1).alias("head"))
    edges = edges.select("conv_id", "chunk", "part", F.lag("tail").over(order).alias("before"), F.first("head").over(order).alias("head"))
    edges = edges.select("conv_id", "chunk", "part", F.coalesce("before", F.expr("slice(array(head), 1, 0)")).alias("before"), F.when((F.col("head.role") == "system"), F.col("head")).alias("system"))
    named = chunks.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.col("part").alias("i"), "turns")
    joined = named.join(edges, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("k") == F.col("chunk")) & (F.col("i") == F.col("part"))).drop("c", "k", "i")

    # Every turn with its place and the sum of the sizes before it, in the chunk.
    # The chunk's turns, and before them, with negative places, those that are history only.
    every = joined.select("conv_id", "chunk", "part", "system", F.size("before").alias("skip"), F.posexplode(F.concat("before", "turns")).alias("p", "t"))
    every = every.select("conv_id", "chunk", "part", "system", (F.col("p") - F.col("skip")).alias("pos"), "t", F.octet_length("t.shown").cast("long").alias("size"))
    by_place = Window.partitionBy("conv_id", "chunk", "part").orderBy("pos")
    new_size = F.when(F.col("pos") >= 0, F.col("size")).otherwise(F.lit(0))
    every = every.withColumn("at", F.sum(new_size).over(by_place) - new_size).withColumn("total", F.sum("size").over(by_place))
    stretch, last = F.floor(F.col("at") / NEW), F.floor((F.col("at") + F.col("size") - 1) / NEW)
    every = every.withColumn("span", F.when(F.col("pos") >= 0, 2 * stretch + F.when(stretch == last, 0).otherwise(1)))

    # A turn is a target in its own span and history of the spans that begin within the next turns.
    uses = [F.struct(F.col("span").alias("span"), F.lit(True).alias("new"))]
    for i in range(1, HISTORY_TURNS + 1):
        begins = F.lead("span", i).over(by_place)
        before = F.lead("span", i - 1).over(by_place) if i > 1 else F.col("span")
        near = F.lead("total", i - 1).over(by_place) if i > 1 else F.col("total")
        fits = near - F.col("total") + F.col("size") <= HISTORY
        uses.append(F.struct(F.when(begins.isNotNull() & (before.isNull() | (before != begins)) & fits, begins).alias("span"), F.lit(False).alias("new")))
    used = every.withColumn("uses", F.array(*uses)).withColumn("use", F.explode("uses")).where("use.span is not null")
    item = F.struct("pos", F.col("use.new").alias("new"), "t")
    grouped = used.groupBy("conv_id", "chunk", "part", F.col("use.span").alias("span")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("system").alias("system"))

    # The system turn leads, unless it is in the window already.
    has = F.exists("items", lambda i: (i["t"] == F.col("system")))
    lead = F.when(F.col("system").isNull() | has, F.expr("slice(items, 1, 0)")).otherwise(F.array(F.struct(F.lit(-HISTORY_TURNS - 1).alias("pos"), F.lit(False).alias("new"), F.col("system").alias("t"))))
    full = grouped.withColumn("all", F.concat(lead, "items"))
    # The mask: where the assistants' new texts lie in the formatted text.
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        head = F.char_length(_role_in(i["t"]["role"])) + 6  # "### ", ": "
        own = F.struct((acc["at"] + head).alias("start"), F.char_length(escape(i["t"]["text"])).alias("length"))
        return F.struct(
            (acc["at"] + F.char_length(i["t"]["shown"])).alias("at"),
            F.when(i["new"] & (i["t"]["role"] == "assistant"), F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"),
        )

    return full.select(
        "conv_id", "chunk", "part", "span",
        F.element_at(F.filter("all", lambda i: i["new"]), 1)["t"]["turn"].alias("first_turn"),
        F.size(F.filter("all", lambda i: ~i["new"])).alias("n_context"),
        F.size(F.filter("all", lambda i: i["new"])).alias("n_new"),
        F.array_join(F.transform("all", lambda i: i["t"]["shown"]), "").alias("formatted"),
        F.aggregate("all", start, step, lambda acc: acc["spans"]).alias("loss"),
        F.aggregate("all", F.lit(0), lambda n, i: n + F.char_length(i["t"]["shown"])).alias("size"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a window's turns, in order."""
    shown = F.filter(F.split(formatted, "(?<= </turn>\n)"), lambda s: s != "")
    inside = lambda s: F.substring(s, F.lit(5), F.char_length(s) - 4 - len(END))

    def turn(s: Column) -> Column:
        body = inside(s)
        at = F.instr(body, ": ")
        return F.struct(_role_out(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + 2, F.char_length(body))).alias("text"))

    return F.transform(shown, turn)


def digests(found: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: what op6's contract asks for."""
    turns = parse(F.col("formatted"))
    new = F.slice(turns, F.col("n_context") + 1, F.col("n_new"))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    windows_ = found.select(
        "conv_id", "chunk", "part", "span", "n_new", F.char_length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(learned, "").alias("learned"),
    )
    # Two steps, so that a conversation's windows meet as one string a chunk.
    by_chunk = windows_.groupBy("conv_id", "chunk", "part").agg(
        F.sum("n_new").alias("n"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("span", "said", "learned"))).alias("w")
    )
    joined = by_chunk.select("conv_id", "chunk", "part", "n", "chars", *(F.array_join(F.col(f"w.{c}"), "").alias(c) for c in ("said", "learned")))
    whole = joined.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("chunk", "part", "said", "learned"))).alias("w"))
    said, learned_all = (F.array_join(F.col(f"w.{c}"), "") for c in ("said", "learned"))
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned_all).cast("long").alias("loss_chars"), F.sha2(learned_all.cast("binary"), 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("t.*")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(save(windows(turns), "chat-windows"))


def _escaped(x: str) -> str:
    return rf"replace(replace(replace({x}, '\', '\b'), '#', '\h'), '<', '\l')"


#: Written apart from the plan: a window is a (conversation, part, span), and every use of a turn in one a row.
OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), said AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM t GROUP BY conv_id
), shown AS (
  SELECT *, '### ' || replace({_escaped("role")}, ':', '\c') || ': ' || {_escaped("text")} || ' </turn>' || chr(10) AS shown, coalesce(floor(turn / {CHUNK}.0), -1e18) AS chunk FROM t
), dealt AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn NULLS FIRST, role, text) - 1) // {CHUNK} AS part FROM shown
), own AS (
  SELECT conv_id, shown, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY chunk, part) AS k,
         row_number() OVER (PARTITION BY conv_id, chunk, part ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         count(*) OVER (PARTITION BY conv_id, chunk, part) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM dealt
), every AS (
  SELECT conv_id, k, pos, shown, place FROM own
  UNION ALL SELECT conv_id, k + 1, pos - n, shown, place FROM own WHERE pos >= n - {HISTORY_TURNS} AND (conv_id, k + 1) IN (SELECT conv_id, k FROM own)
), summed AS (
  SELECT *, strlen(shown) AS size, sum(strlen(shown)) OVER w AS total, sum(CASE WHEN pos >= 0 THEN strlen(shown) ELSE 0 END) OVER w AS upto
  FROM every WINDOW w AS (PARTITION BY conv_id, k ORDER BY pos)
), spanned AS (
  SELECT *, CASE WHEN pos >= 0 THEN 2 * floor((upto - size) / {NEW}.0) + CASE WHEN floor((upto - size) / {NEW}.0) = floor((upto - 1) / {NEW}.0) THEN 0 ELSE 1 END END AS span FROM summed
), later AS (
  SELECT *, lead(span, 1) OVER w AS span1, lead(span, 2) OVER w AS span2, lead(total, 1) OVER w AS total1 FROM spanned WINDOW w AS (PARTITION BY conv_id, k ORDER BY pos)
), uses AS (
  SELECT conv_id, k, span, shown, place FROM later WHERE span IS NOT NULL
  UNION ALL SELECT conv_id, k, span1, shown, place FROM later WHERE span1 IS NOT NULL AND span IS DISTINCT FROM span1 AND size <= {HISTORY}
  UNION ALL SELECT conv_id, k, span2, shown, place FROM later WHERE span2 IS NOT NULL AND span1 IS DISTINCT FROM span2 AND total1 - total + size <= {HISTORY}
), lead AS (
  SELECT conv_id, shown AS system FROM own WHERE place = 1 AND role = 'system'
), window_chars AS (
  SELECT u.conv_id, sum(length(u.shown)) + CASE WHEN any_value(l.system) IS NULL OR bool_or(u.place = 1) THEN 0 ELSE length(any_value(l.system)) END AS chars
  FROM uses u LEFT JOIN lead l ON l.conv_id = u.conv_id GROUP BY u.conv_id, u.k, u.span
)
SELECT said.*, CAST(c.chars AS BIGINT) AS formatted_chars FROM said JOIN (SELECT conv_id, sum(chars) AS chars FROM window_chars GROUP BY conv_id) c ON c.conv_id = said.conv_id
"""
