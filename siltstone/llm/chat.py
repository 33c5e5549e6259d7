"""Chat formatting after cumulative-snapshot collapse, with DataFrame functions only.

Chat logs often hold a conversation once for every turn that it grew by. Each
conversation gets a rolling hash for each of its turns, in which every turn's role and
text are folded into the hash of the turns before. A conversation whose last hash is
the hash of a shorter prefix of another one is a snapshot of it: an anti-join drops it.
Of conversations that are equal from first turn to last, the one with the smallest id
stays. What is left is maximal and is rendered by a template.

The rolling hash is the running exclusive-or of two 64-bit hashes of each turn with its
position, so it needs no array that grows with the conversation. Prefix hashes are
distinct before the join: a first turn that a third of all conversations share is one
row of it.

Roles and texts may hold what looks like the template's marks. In them, and only in them,
a `<` before `|` is parted from it by a backslash, after those that stand there already:
`<|` is always a mark, and unescape() gives each text back.

Edge cases: turns are ordered by number, then role and text; exact copies of a turn (same
number, role and text) count once; a null turn number sorts first; null roles render as
UNKNOWN and null texts as empty, and neither equals the other; each row with a null conv_id
is a conversation of its own, of one turn (it collapses into equal ones and into those that
begin with it; kept, its conv_id is null); an empty table gives an empty result; extra
columns stay out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

UNKNOWN = "unknown"


def _marks() -> list[Column]:
    return [F.col("i"), F.coalesce(F.length("role"), F.lit(-1)), F.col("role"), F.coalesce(F.length("text"), F.lit(-1)), F.col("text")]


def _hashes() -> dict[str, Column]:
    return {"h1": F.xxhash64(*_marks()), "h2": F.xxhash64(F.lit("second"), *reversed(_marks()))}


def prefixes_of(turns: DataFrame) -> DataFrame:
    """One row for each distinct turn: conv_id, i (from 1), n (turns of the conversation),
    role, text, and h1, h2: the rolling hash of the turns up to this one. Running sums in
    one order, and the number of turns, over one shuffle by conversation. A row without a
    conv_id needs none."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    columns = ("conv_id", "i", "n", "role", "text", "h1", "h2")
    alone = t.filter(F.col("conv_id").isNull()).withColumns({"i": F.lit(1).cast("long"), "n": F.lit(1).cast("long")}).withColumns(_hashes())
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same = F.row_number().over(w) > 1
    for c in ("turn", "role", "text"):
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    t = t.filter(F.col("conv_id").isNotNull()).withColumn("new", ~same).withColumn("i", F.sum(F.col("new").cast("long")).over(upto))
    for name, hashed in _hashes().items():
        t = t.withColumn(name, F.bit_xor(F.when(F.col("new"), hashed)).over(upto))
    t = t.withColumn("n", F.max("i").over(Window.partitionBy("conv_id")))
    return t.filter("new").select(*columns).unionByName(alone.select(*columns))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, h1, h2, n_equal) of the conversations that no other one continues, the
    smallest id of equal ones; h1, h2 stand for the whole conversation."""
    whole = prefixes.filter(F.col("i") == F.col("n")).groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    inner = prefixes.filter(F.col("i") < F.col("n")).select("h1", "h2").distinct()
    return whole.join(inner, ["h1", "h2"], "left_anti").select("conv_id", "h1", "h2", "n_equal")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    """What a text between two marks was before."""
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: Column) -> Column:
    """<|role|> and the text of each turn, one block a turn, then an end mark."""
    block = lambda x: F.concat(F.lit("<|"), escape(F.coalesce(x["role"], F.lit(UNKNOWN))), F.lit("|>\n"), escape(F.coalesce(x["text"], F.lit(""))), F.lit("\n"))
    return F.concat(F.array_join(F.transform(turns, block), ""), F.lit("<|end|>"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (equal conversations, itself included) and chat of the
    maximal conversations."""
    with Tables(turns.sparkSession) as tables:
        prefixes = tables.table(prefixes_of(turns))
        kept = tables.table(maximal(prefixes))
        named = kept.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("_id"), "n_equal")
        rows = prefixes.join(named, F.col("conv_id") == F.col("_id")).select("conv_id", "n_equal", "n", F.struct("i", "role", "text").alias("t"))
        whole = rows.groupBy("conv_id", "n_equal", "n").agg(F.array_sort(F.collect_list("t")).alias("turns"))
        # equal rows without an id have one hash: any one of them shows the turn
        alone = prefixes.filter(F.col("conv_id").isNull()).groupBy("h1", "h2").agg(F.min(F.struct("i", "role", "text")).alias("t"))
        alone = kept.filter(F.col("conv_id").isNull()).join(alone, ["h1", "h2"]).select("conv_id", "n_equal", F.lit(1).cast("long").alias("n"), F.array("t").alias("turns"))
        return tables.keep(whole.unionByName(alone).select("conv_id", F.col("n").alias("n_turns"), "n_equal", render(F.col("turns")).alias("chat")))


#: The same in DuckDB: turns as lists, prefixes compared as lists of rendered turns. Rows
#: without a conv_id are numbered: k is a conversation.
FORMAT_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, NULL::BIGINT AS lone, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT NULL, row_number() OVER (), turn, role, text FROM conversations WHERE conv_id IS NULL
), marked AS (
  SELECT conv_id, struct_pack(c := conv_id, l := lone) AS k, turn, role, text,
    coalesce(length(role)::VARCHAR, '-') || ':' || coalesce(role, '') || coalesce(length(text)::VARCHAR, '-') || ':' || coalesce(text, '') AS part,
    '<|' || regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\1\\|', 'g') || '|>' || chr(10) || regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') || chr(10) AS block
  FROM turns
), grown AS (
  SELECT conv_id, k,
    row_number() OVER w AS n,
    string_agg(part, '') OVER w AS prefix,
    count(*) OVER (PARTITION BY k) AS n_turns
  FROM marked WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
), chats AS (
  SELECT k, string_agg(block, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) || '<|end|>' AS chat FROM marked GROUP BY k
), whole AS (
  SELECT conv_id, k, n_turns, md5(prefix) AS h FROM grown WHERE n = n_turns
), inner_ AS (
  SELECT DISTINCT md5(prefix) AS h FROM grown WHERE n < n_turns
), kept AS (
  SELECT min(conv_id) AS conv_id, any_value(k ORDER BY conv_id NULLS LAST) AS k, any_value(n_turns) AS n_turns, count(*) AS n_equal FROM whole
  WHERE h NOT IN (SELECT h FROM inner_) GROUP BY h
)
SELECT kept.conv_id, kept.n_turns, kept.n_equal, chats.chat
FROM kept JOIN chats ON kept.k IS NOT DISTINCT FROM chats.k
"""
