"""Chat formatting by prefix-target expansion.

A conversation becomes one formatted string; every assistant turn becomes an example that ends with
that turn, takes all turns before it as context and trains on that reply alone. Examples are stored
as offsets into the conversation's string (an example's text is a prefix of it), so a conversation of
n turns costs n offsets and not n copies. ``examples`` explodes them into rows of their own, each with the text
under its loss mask, and ``example_texts`` writes their whole texts out.

A turn is ``<s><|role|>`` body ``</s>``; a user's body is ``[INST]`` text ``[/INST]``. Control strings
inside a text get one backslash after their first character, whatever backslashes stand there already,
so that taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

TAIL = r"(/?s>|/?INST\]|\|)"
ESCAPE, UNESCAPE = rf"([<\[])(\\*){TAIL}", rf"([<\[])\\(\\*){TAIL}"
OPEN, CLOSE = "<s><|", "</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p")), F.lit("<"), F.lit("\\l"))


def _role_in(role: Column) -> Column:
    """Every escape read once, from the left."""
    parts = F.regexp_extract_all(role, F.lit(r"\\[\\pl]|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p == "\\\\", "\\").when(p == "\\p", "|").when(p == "\\l", "<").otherwise(p)), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, examples) of rows (conv_id, turn, role, text).

    ``examples``: array of (turn_no, context_end, loss_start, loss_end, end), code points into
    ``formatted``, ends exclusive. Turns are ordered by turn, then role, then text (null turns first),
    so ties and repeated rows have one order; all repeated rows stay. Null texts and roles are empty.
    Null conv_ids form one conversation. A conversation without an assistant has no examples; an
    empty table gives no rows. Other columns are ignored.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("|>"), F.when(F.col("role") == "user", "[INST]").otherwise(""))
    tail = F.concat(F.when(F.col("role") == "user", "[/INST]").otherwise(""), F.lit(CLOSE))
    parts = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"), tail.alias("tail"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = parts.withColumn("turn_no", F.row_number().over(order) - 1).withColumn(
        "end", F.sum(F.length("head") + F.length("body") + F.length("tail")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    )
    context_end = F.col("end") - F.length("head") - F.length("body") - F.length("tail")
    turn = F.struct("turn_no", F.concat("head", "body", "tail").alias("part"))
    loss_start = (context_end + F.length("head")).alias("loss_start")
    example = F.when(F.col("role") == "assistant", F.struct("turn_no", context_end.alias("context_end"), loss_start, (F.col("end") - F.length("tail")).alias("loss_end"), "end"))
    return (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("ts"), F.sort_array(F.collect_list(example)).alias("examples"))
        .select("conv_id", F.array_join(F.transform("ts", lambda t: t["part"]), "").alias("formatted"), "examples")
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per example: conv_id, turn_no, context_end, loss_start, loss_end, end, and the text under the loss mask, unescaped.

    The string is cut into its turns once, and each example reads its own turn, so a conversation of n turns costs n
    turns and not n strings.
    """
    loss = "substring(element_at(parts, e.turn_no + 1), e.loss_start - e.context_end + 1, e.loss_end - e.loss_start)"
    each = f"transform(examples, e -> named_struct('e', e, 'loss', {loss}))"
    rows = formatted.select("conv_id", F.expr(f"explode(element_at(transform(array(split(formatted, '{CLOSE}')), parts -> {each}), 1)) as x"))
    return rows.select("conv_id", "x.e.*", unescaped(F.col("x.loss")).alias("loss"))


def example_texts(formatted: DataFrame) -> DataFrame:
    """One row per example: conv_id, turn_no, text (context and target), loss_start, loss_end."""
    return formatted.select("conv_id", "formatted", F.explode("examples").alias("e")).select(
        "conv_id", "e.turn_no", F.expr("substring(formatted, 1, e.end)").alias("text"), "e.loss_start", "e.loss_end"
    )


def parsed_turns(formatted: Column) -> Column:
    """Array of (role, text), read from the formatted string alone."""
    turns = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(x):
        role = _role_in(F.regexp_extract(x, r"(?s)^<s><\|(.*?)\|>", 1))
        body = F.regexp_replace(x, r"(?s)^<s><\|.*?\|>", "")
        body = F.when(role == "user", F.regexp_replace(body, r"(?s)^\[INST\](.*)\[/INST\]$", "$1")).otherwise(body)
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(turns, turn)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all conversations and of conversation -1, read back from the formatted output."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    made = materialize(format_conversations(turns.unionByName(extra)), "formatted")
    replies = examples(made).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_no", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    back = made.select("conv_id", "formatted", parsed_turns(F.col("formatted")).alias("turns")).alias("a")
    both = back.join(replies.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select("a.*", F.coalesce("b.loss", F.lit("")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return both.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|)', '\1\\\2\3', 'g'))
    + length(replace(replace(replace(role, '\', '\\'), '|', '\p'), '<', '\l'))
    + 11 + CASE WHEN role = 'user' THEN 13 ELSE 0 END AS n
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
    sum(n)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""
