"""Conversations as text segments with loss flags, by a finite-state machine over roles and a declarative template.

A template names states, the transitions that a role may make between them, where a conversation may end, and what stands
before and after a turn of each role. A conversation that the machine accepts gives two segments a turn: the opening, without
loss, and the text with its closing, with the role's loss flag. Any other gives one row, which says why it isn't accepted:
the first turn that is wrong, and in it the first of: null turn, repeated turn, unknown role, null text, out of order;
or unfinished, if the machine stops in a state that isn't an end.

Turns go in order of turn; what stands between their numbers doesn't matter. Empty texts are texts. Two rows of one turn,
also equal ones, are a repeated turn. Rows without a conv_id are of no conversation. Columns other than conv_id, turn, role
and text aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm import common

TEMPLATE: dict[str, Any] = {
    "start": "start",
    "ends": ["assistant"],
    "moves": {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    "roles": {
        "system": {"open": "<|system|>\n", "close": "<|end|>\n", "loss": False},
        "user": {"open": "<|user|>\n", "close": "<|end|>\n", "loss": False},
        "assistant": {"open": "<|assistant|>\n", "close": "<|end|>\n", "loss": True},
    },
}


def validated(template: dict[str, Any]) -> dict[str, Any]:
    """The template, if its moves and ends make sense."""
    moves, roles = template["moves"], template["roles"]
    states = {template["start"], *moves, *(s for m in moves.values() for s in m.values())}
    for role in {r for m in moves.values() for r in m} - set(roles):
        raise ValueError(f"the template moves on {role!r}, which isn't among its roles")
    for end in set(template["ends"]) - states:
        raise ValueError(f"the template ends in {end!r}, which isn't a state")
    return template


def _lookup(pairs: dict[str, Any], key: Column) -> Column:
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def segments(conversations: DataFrame, template: dict[str, Any] = TEMPLATE) -> DataFrame:
    """(conv_id, segment, role, text, loss, error): the segments of accepted conversations, from 0, or the error of others."""
    t = validated(template)
    roles = t["roles"]
    moves = {f"{s}\n{r}": to for s, m in t["moves"].items() for r, to in m.items()}
    d = common.narrow(conversations, conv_id="conv_id", turn="turn", role="role", text="text").filter("conv_id IS NOT NULL")
    c = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"))).alias("turns"))
    none = F.lit(None).cast("string")

    def step(acc: Column, x: Column) -> Column:
        to = _lookup(moves, F.concat(acc["state"], F.lit("\n"), x["role"]))
        wrong = (
            F.when(x["turn"].isNull(), "null turn")
            .when(x["turn"] == acc["turn"], "repeated turn")
            .when(F.coalesce(~x["role"].isin(*roles), F.lit(True)), "unknown role")
            .when(x["text"].isNull(), "null text")
            .when(to.isNull(), "out of order")
        )
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), x["turn"].alias("turn"), F.coalesce(acc["error"], wrong).alias("error"))

    begin = F.struct(F.lit(t["start"]).alias("state"), F.lit(None).cast("long").alias("turn"), none.alias("error"))
    c = c.withColumn("end", F.aggregate("turns", begin, step))
    c = c.withColumn("error", F.coalesce("end.error", F.when(~F.col("end.state").isin(*t["ends"]), "unfinished")))

    def turn(x: Column, i: Column) -> Column:
        loss = F.coalesce(_lookup({r: bool(v["loss"]) for r, v in roles.items()}, x["role"]), F.lit(False))
        opening = F.struct((2 * i).cast("long").alias("segment"), x["role"].alias("role"), _lookup({r: v["open"] for r, v in roles.items()}, x["role"]).alias("text"), F.lit(False).alias("loss"))
        body = F.struct((2 * i + 1).cast("long").alias("segment"), x["role"].alias("role"), F.concat(x["text"], _lookup({r: v["close"] for r, v in roles.items()}, x["role"])).alias("text"), loss.alias("loss"))
        return F.array(opening, body)

    failed = F.array(F.struct(F.lit(0).cast("long").alias("segment"), none.alias("role"), none.alias("text"), F.lit(None).cast("boolean").alias("loss")))
    c = c.select("conv_id", "error", F.explode(F.when(F.col("error").isNull(), F.flatten(F.transform("turns", turn))).otherwise(failed)).alias("s"))
    return c.select("conv_id", "s.segment", "s.role", "s.text", "s.loss", "error")


SEGMENTS_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS n, lag(role) OVER w AS before, lag(turn) OVER w AS last, count(*) OVER (PARTITION BY conv_id) AS size
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
e AS (
  SELECT *, CASE WHEN turn IS NULL THEN 'null turn' WHEN turn = last THEN 'repeated turn'
    WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 'unknown role' WHEN text IS NULL THEN 'null text'
    WHEN (CASE WHEN n = 1 THEN 'start' ELSE before END || ' ' || role) NOT IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user') THEN 'out of order'
    WHEN n = size AND role <> 'assistant' THEN 'unfinished' END AS error FROM t),
c AS (SELECT conv_id, arg_min(error, n) FILTER (WHERE error IS NOT NULL) AS error FROM e GROUP BY conv_id)
SELECT conv_id, CAST(0 AS BIGINT) AS segment, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BOOLEAN) AS loss, error FROM c WHERE error IS NOT NULL
UNION ALL SELECT conv_id, 2 * n - 2, role, '<|' || role || '|>' || chr(10), FALSE, NULL FROM t JOIN c USING (conv_id) WHERE error IS NULL
UNION ALL SELECT conv_id, 2 * n - 1, role, text || '<|end|>' || chr(10), role = 'assistant', NULL FROM t JOIN c USING (conv_id) WHERE error IS NULL
"""
