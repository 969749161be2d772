"""Chat formatting in budgeted windows.

Native: DataFrame operations only.

A conversation is cut into windows that fit a token budget. Prefix sums of the
turns' tokens (words, plus a fixed cost for the markers) choose spans that
begin and end at turns: what the system turn leaves of the budget is cut into
strides of three quarters, a turn belongs to the stride in which it ends, and a
turn that reaches back over the stride's edge by more than the last quarter is a
span of its own. So a span is within the budget unless one turn alone is above
it. Every window holds the system turn the conversation begins with, then up to
``history`` earlier turns repeated for context, as many as the budget has room
for, then the turns that are new in it. Only new assistant texts are targets:
the loss mask of a window lists their character spans, so a repeated target is
masked.

Template of a turn: ``### ``, the role, a line end, the text, ``</turn>``, a
line end. Inside roles and texts a backslash is doubled, every ``#`` that
follows another is led by one, and ``</turn>`` becomes ``<\\/turn>``; a line end
in a role becomes ``\\n``. So no control string stands inside a text, and
dropping the escape character gives back the original.

Places of turns, prefix sums and spans come from windows over each
conversation's sorted rows, which hold one row at a time; a window's turns are
gathered, and so is a conversation where its digest is made, as that needs all of
it in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WORD, table

BUDGET, HISTORY, MARKS = 1024, 2, 4
END = "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for _ in range(2):  # pairs that don't overlap, then those between them
        text = F.replace(text, F.lit("##"), F.lit("#\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``: only there does an escaped ``n`` stand for a line end."""
    return unescape(F.regexp_replace(role, r"\G((?:[^\\]|\\[^n])*+)\\n", "$1\\\\\n"))


def spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each turn in each window that shows it: conv_id, window, place, context, role, head, body."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.regexp_count(text, F.lit(WORD)) + F.lit(MARKS)).cast("long").alias("tokens"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sofar = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("place", F.row_number().over(order) - 1)
    system = (F.col("place") == 0) & (F.col("role") == "system")
    t = t.withColumns({"system": system, "own": F.when(system, 0).otherwise(F.col("tokens"))})
    t = t.withColumns({"lead": F.first(F.col("tokens") - F.col("own")).over(sofar), "upto": F.sum("own").over(sofar)})
    t = t.withColumns({"since": F.col("upto") - F.col("own"), "room": F.greatest(F.lit(budget) - F.col("lead"), F.lit(0))})
    t = t.withColumn("stride", F.greatest(F.expr("room * 3 div 4"), F.lit(1)))
    t = t.withColumn("at", F.expr("(upto - 1) div stride"))
    over = F.greatest(F.col("at") * F.col("stride") - F.col("since"), F.lit(0))
    t = t.withColumn("span", F.when(~F.col("system"), 2 * F.col("at") + F.when(over > F.col("room") - F.col("stride"), 0).otherwise(1)))
    new = ~F.col("system") & ~F.col("span").eqNullSafe(F.lag("span").over(order))
    t = t.withColumn("first", new)
    t = t.withColumn("window", F.when(~F.col("system"), F.sum(F.col("first").cast("int")).over(sofar) - 1))
    t = t.withColumn("left", F.col("room") - F.sum("own").over(W.partitionBy("conv_id", "window")))
    seen = [F.struct(F.col("window").alias("window"), F.lit(False).alias("context"))]
    for h in range(1, history + 1):
        ahead = lambda c: F.lead(c, h).over(order)  # noqa: B023, E731
        fits = ahead("first") & ~F.col("system") & (ahead("since") - F.col("since") <= ahead("left"))
        seen.append(F.when(fits, F.struct(ahead("window").alias("window"), F.lit(True).alias("context"))))
    last = F.coalesce(F.max("window").over(W.partitionBy("conv_id")), F.lit(0))
    t = t.withColumns({"seen": F.filter(F.array(*seen), lambda x: x.isNotNull()), "last": last})
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long")), lambda w: F.struct(w.alias("window"), (w > 0).alias("context")))
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit("\n"))
    t = t.withColumn("seen", F.when(F.col("system"), every).otherwise(F.col("seen").cast("array<struct<window:bigint,context:boolean>>")))
    return t.select("conv_id", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"), F.inline("seen"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, first_turn, n_context, text, loss (spans of start and length, from 0).

    ``turns`` has conv_id, turn, role, text; other columns are not read. A null
    text is empty, a null role an empty role, null turns come first, turns of
    one number go by role and text, and rows of a null conv_id are one
    conversation. Repeated rows are turns of their own. History goes before a
    budget is exceeded; only a turn that is longer than what the system turn
    leaves of the budget makes a longer window, in which it is the only new one
    and has no history. No text is cut, however long. An empty table gives no
    windows.
    """
    shown = spans(turns, budget, history).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("place", "context", "role", "head", "body"))).alias("shown"))
    new = F.filter("shown", lambda t: ~t["context"])
    c = shown.select("conv_id", F.col("window").cast("int").alias("window"), F.element_at(new, 1)["place"].alias("first_turn"), (F.size("shown") - F.size(new)).alias("n_context"), "shown")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(a, t):
        start, length = a["at"] + F.length(t["head"]), F.length(t["body"])
        target = ~t["context"] & (t["role"] == "assistant")
        spans = F.when(target, F.concat(a["loss"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(a["loss"])
        return F.struct((start + length + F.lit(len(END))).alias("at"), spans.alias("loss"))

    text = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return c.select("conv_id", "window", "first_turn", "n_context", text.alias("text"), F.aggregate("shown", begin, step, lambda a: a["loss"]).alias("loss"))


def parse(text: Column) -> Column:
    """Turns (role, text) of a formatted window."""
    marked = F.filter(F.split(text, "</turn>\n", -1), lambda x: x.startswith("### "))
    cut = lambda x: F.locate("\n", x)
    return F.transform(marked, lambda x: F.struct(unescape_role(F.substring(x, F.lit(5), cut(x) - 5)).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x))).alias("text")))


def targets_of(text: Column, loss: Column) -> Column:
    """All text under the loss mask of a window, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and digests of what the windows of each conversation hold."""
    shown = formatted.select("conv_id", "window", "n_context", parse(F.col("text")).alias("shown"), targets_of(F.col("text"), F.col("loss")).alias("targets"), F.length("text").cast("long").alias("chars"))
    new = F.slice("shown", F.col("n_context") + 1, F.greatest(F.size("shown") - F.col("n_context"), F.lit(0)))
    told = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = shown.select("conv_id", F.struct("window", F.size(new).alias("n"), told.alias("told"), "targets").alias("w"), "chars")
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("w", lambda w: w[name]), "")
    return whole.select(
        "conv_id", F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["n"]).alias("n_turns"), sha256(joined("told")).alias("turns_sha256"),
        F.length(joined("targets")).cast("long").alias("loss_chars"), sha256(joined("targets")).alias("loss_sha256"), "formatted_chars",
    )


#: The conversation that the query adds.
EXTRA = r"\### Assistant: </turn> ok"


def query(spark, sf_dir):
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(windows(turns.unionByName(extra)))


_ESCAPED = r"replace(replace(replace(replace({x}, '\', '\\'), '##', '#\#'), '##', '#\#'), '</turn>', '<\/turn>')"
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS targets
  FROM t GROUP BY conv_id
), n AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, role, len(regexp_extract_all(text, '{WORD}')) + {MARKS} AS tokens,
    4 + length(replace({_ESCAPED.format(x="role")}, chr(10), '\n')) + 1 + length({_ESCAPED.format(x="text")}) + {len(END)} AS chars
  FROM t
), o AS (
  SELECT *, place = 0 AND role = 'system' AS is_system, CASE WHEN place = 0 AND role = 'system' THEN 0 ELSE tokens END AS own FROM n
), p AS (
  SELECT *, sum(own) OVER w AS upto, sum(own) OVER w - own AS since, greatest({BUDGET} - first_value(tokens - own) OVER w, 0) AS room FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), q AS (
  SELECT *, greatest(room * 3 // 4, 1) AS stride FROM p
), r AS (
  SELECT *, 2 * ((upto - 1) // stride) + CASE WHEN greatest((upto - 1) // stride * stride - since, 0) > room - stride THEN 0 ELSE 1 END AS span FROM q
), f AS (
  SELECT *, NOT is_system AND (lag(span) OVER w IS NULL OR lag(is_system) OVER w OR lag(span) OVER w <> span) AS is_first FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), v AS (
  SELECT *, sum(CAST(is_first AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS win FROM f
), s AS (
  SELECT conv_id, win, min(place) AS begins, min(since) AS since, min(room) - sum(own) AS free FROM v WHERE NOT is_system GROUP BY conv_id, win
), c AS (
  SELECT conv_id, chars * CASE WHEN is_system THEN greatest((SELECT count(*) FROM s WHERE s.conv_id IS NOT DISTINCT FROM v.conv_id), 1) ELSE 1 END AS chars FROM v
  UNION ALL SELECT v.conv_id, chars FROM v JOIN s ON v.conv_id IS NOT DISTINCT FROM s.conv_id AND NOT is_system AND place < begins AND place >= begins - {HISTORY} AND s.since - v.since <= free
), k AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id
)
SELECT g.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(targets) AS BIGINT) AS loss_chars, sha256(targets) AS loss_sha256, formatted_chars FROM g JOIN k ON g.conv_id IS NOT DISTINCT FROM k.conv_id
"""
