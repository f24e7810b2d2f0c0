"""Multi-party chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once, with that speaker as
the assistant and all others as named users; roles of context (system) keep their role.
The loss mask is the list of character spans of the assistant's own turns.

A conversation is rendered in parts of PART_TURNS turn numbers, so that no task ever holds
an unbounded conversation; the parts of a perspective, in order, are the whole dialogue.
Turns are ordered by number, then role, then text.

Defined results: a null text is empty, a null role speaks as "unknown", null turn numbers
come first (part -1), null conversation ids form one conversation; repeated turns are all
rendered; a conversation of context only has no participant and gives no rows; other
columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PART_TURNS = 256
CONTEXT_ROLES = ("system",)
#: Fixed marks of the format.
OPEN, CLOSE, STOP = "<|", "|>\n", "<|end|>\n"


def rotate(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    context_roles: tuple[str, ...] = CONTEXT_ROLES,
) -> DataFrame:
    """(conv, perspective, part, n_turns, text, spans array<struct<start,end>>).

    ``spans`` are zero-based character positions in ``text``, ends excluded; they cover
    the assistant's words and the stop mark that ends its turn.
    """
    turns = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    speakers = (
        turns.where(~F.col("role").isin(*context_roles))
        .groupBy("conv")
        .agg(F.sort_array(F.collect_set("role")).alias("speakers"))
        .withColumnRenamed("conv", "c")
    )
    parts = turns.groupBy("conv", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-1)).cast("long").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    d = parts.join(speakers, F.col("conv").eqNullSafe(F.col("c"))).select(
        "conv", "part", "turns", F.explode("speakers").alias("perspective")
    )

    def header(t: Column) -> Column:
        named = F.when(t.role == F.col("perspective"), F.lit("assistant")).when(t.role.isin(*context_roles), t.role)
        return F.concat(F.lit(OPEN), F.coalesce(named, F.concat(F.lit("user name="), t.role)), F.lit(CLOSE))

    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.length(header(t)).cast("long").alias("skip"),
            (F.length(header(t)) + F.length(t.text) + len(STOP)).cast("long").alias("size"),
            (t.role == F.col("perspective")).alias("own"),
            F.concat(header(t), t.text, F.lit(STOP)).alias("piece"),
        ),
    )
    d = d.select("conv", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), piece.alias("pieces"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    fold = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda a, p: F.struct(
            (a.at + p["size"]).alias("at"),
            F.when(p.own, F.concat(a.spans, F.array(F.struct((a.at + p.skip).alias("start"), (a.at + p["size"]).alias("end")))))
            .otherwise(a.spans)
            .alias("spans"),
        ),
        lambda a: a.spans,
    )
    return d.select(
        F.col("conv").alias(conv_col),
        "perspective",
        "part",
        "n_turns",
        F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("text"),
        fold.alias("spans"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rotate(table(spark, sf_dir, "conversations"))
    shown = F.transform("spans", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string")))
    return d.select("conv_id", "perspective", "part", "n_turns", "text", F.array_join(shown, ",").alias("spans"))


OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, coalesce(turn // 256, -1)::BIGINT AS part
  FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
p AS (
  SELECT conv_id, perspective, part, turn, role, text,
         '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || '|>' || chr(10) AS head
  FROM t JOIN s ON conv_id IS NOT DISTINCT FROM c),
q AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS piece,
         row_number() OVER w AS k,
         sum(length(head || text) + 8) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM p WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(piece, '' ORDER BY k) AS text,
       coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k) FILTER (WHERE role = perspective), '') AS spans
FROM q GROUP BY conv_id, perspective, part
"""
