"""Operator 2. Chat formatting in budgeted windows, in DataFrame functions only.

A turn becomes <s>ROLE\\nTEXT</s>. Prefix sums of turn tokens cut a conversation into spans at multiples of a stride; a turn
belongs to the span where it ends, so spans are turn-aligned. A window is a span, before it the system turn (if the
conversation opens with one) and the last turns within a history allowance. Only assistant texts of the span itself are
targets: what a window repeats is masked, so each assistant text is a target once.

A window has at most system + history + 2 * stride tokens unless one of its own turns exceeds the stride. Tokens of a turn
are estimated as TURN_TOKENS and one for four characters.

Prefix sums run in chunks of turn numbers, then over a row per chunk, so one huge conversation is not one task; history is
an equi-join on stride-sized buckets of the prefix sum.

Nulls: null text or role is the empty string; rows with a null conv_id form one conversation; null turns come first; equal
turns are ordered by role, then text; repeated rows stay. An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

STRIDE = 1024
HISTORY = 256
TURN_TOKENS = 4
CHUNK_TURNS = 1024
#: Control strings of the template and of other chat templates, without their first character.
CONTROL_TAILS = r"/?s>|/?INST\]|/?<SYS>>|</SYS>>|\|[A-Za-z_]+\|>"


def escaped(text):
    """One backslash more after the first character of each control string, escaped ones included."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL_TAILS})", r"$1\\$2$3")


def unescaped(text):
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL_TAILS})", "$1$2$3")


def _escaped_role(role):
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role):
    # an escaped role holds no line end, so marks that begin with one stand for what is put back
    out = unescaped(role)
    for old, new in (("\\\\", "\nB"), ("\\n", "\nN"), ("\nB", "\\"), ("\nN", "\n")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def placed_turns(chats: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The turns with their place, tokens before, and span in their conversation."""
    rows = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(2**62))))
    rows = rows.withColumn("tokens", TURN_TOKENS + F.ceil(F.length("text") / 4))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("rn", F.row_number().over(inside)).withColumn("cum", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col("conv_id").alias("of_conv"), F.col("chunk").alias("of_chunk"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    placed = rows.join(chunks, F.expr("conv_id <=> of_conv AND chunk = of_chunk")).select("conv_id", (F.col("n0") + F.col("rn") - 1).alias("pos"), (F.col("t0") + F.col("cum") - F.col("tokens")).alias("start"), (F.col("t0") + F.col("cum")).alias("stop"), "role", "text")
    return placed.withColumn("span", F.floor((F.col("stop") - 1) / stride))


def format_chats(chats: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """conv_id, span, n_turns, n_repeated (its first turns, which other windows hold as their own), text, loss (ranges of code points in text)."""
    if not 0 <= history <= stride:
        raise ValueError("history must lie between 0 and stride")
    turns = placed_turns(chats, stride)
    turns = turns.select("conv_id", "pos", "start", "span", F.lower("role").alias("kind"), F.concat(F.lit("<s>"), _escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    opens = (F.col("pos") == 0) & (F.col("kind") == "system")
    spans = turns.groupBy(F.col("conv_id").alias("of_conv"), F.col("span").alias("of_span")).agg(F.min("start").alias("origin")).filter("origin > 0")
    own = turns.select("conv_id", "span", F.lit(2).alias("part"), "pos", "head", "body", (F.col("kind") == "assistant").alias("target"))
    system = turns.filter(opens)
    kept = spans.join(system, F.expr("conv_id <=> of_conv")).select("conv_id", F.col("of_span").alias("span"), F.lit(0).alias("part"), "pos", "head", "body", F.lit(False).alias("target"))
    bucket = F.floor(F.col("start") / stride)
    past = turns.filter(~opens).withColumn("bucket", bucket)
    wants = spans.withColumn("of_bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("origin") - history) / stride), F.floor(F.col("origin") / stride)))))
    near = F.expr(f"conv_id <=> of_conv AND bucket = of_bucket AND start >= origin - {history} AND start < origin")
    told = wants.join(past, near).select("conv_id", F.col("of_span").alias("span"), F.lit(1).alias("part"), "pos", "head", "body", F.lit(False).alias("target"))
    windows = own.unionByName(kept).unionByName(told).groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "head", "body", "target"))).alias("turns"))
    loss = """aggregate(turns, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,stop:bigint>>)),
      (a, t) -> named_struct('at', a.at + length(t.head) + length(t.body) + 4L,
        'spans', if(t.target, concat(a.spans, array(named_struct('start', a.at + length(t.head), 'stop', a.at + length(t.head) + length(t.body)))), a.spans)),
      a -> a.spans)"""
    return windows.select(
        "conv_id",
        "span",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("size(filter(turns, t -> t.part < 2))").cast("long").alias("n_repeated"),
        F.expr("array_join(transform(turns, t -> concat(t.head, t.body, '</s>')), '')").alias("text"),
        F.expr(loss).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Of each window: its own turns as an array of (role, text), and the texts under the loss mask."""
    turns = F.filter(F.split("text", "</s>", -1), lambda x: x != "")
    own = F.slice(turns, F.col("n_repeated").cast("int") + 1, F.greatest(F.lit(0), F.size(turns)))
    return windows.select(
        "conv_id",
        "span",
        F.length("text").cast("long").alias("chars"),
        F.transform(own, lambda x: F.struct(_plain_role(F.substring_index(F.substr(x, F.lit(4)), "\n", 1)).alias("role"), unescaped(F.substr(x, F.instr(x, "\n") + 1)).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr("text", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))).alias("targets"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation: what the contract of the query asks for. The digest needs a conversation's text in one row; lists are built per task first."""
    back = read_back(windows).select(
        "conv_id",
        "chars",
        F.size("turns").cast("long").alias("n"),
        F.struct("span", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("told"), F.array_join("targets", "").alias("learnt")).alias("part"),
    )
    joined = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    learnt = F.array_join(F.transform("parts", lambda p: p["learnt"]), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("parts", lambda p: p["told"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"))
    return digests(written(format_chats(chats.unionByName(added)), "chat-windows"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 4 + CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
    8 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(TAILS)', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)(TAILS)', '\1\\\2\3', 'g')) AS chars FROM c),
placed AS (
  SELECT *, row_number() OVER w AS pos, CAST(sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
spanned AS (SELECT *, stop - tokens AS start, (stop - 1) // STRIDE AS span, pos = 1 AND lower(role) = 'system' AS opens FROM placed),
spans AS (SELECT conv_id, span, min(start) AS origin FROM spanned GROUP BY ALL HAVING min(start) > 0),
again AS (
  SELECT s.conv_id, sum(t.chars) AS chars FROM spans s JOIN spanned t
  ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND (t.opens OR t.start >= s.origin - HISTORY AND t.start < s.origin) GROUP BY ALL),
told AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS told,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE lower(role) = 'assistant'), '') AS learnt
  FROM spanned GROUP BY conv_id)
SELECT t.conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
  CAST(t.chars + coalesce(a.chars, 0) AS BIGINT) AS formatted_chars
FROM told t LEFT JOIN again a ON t.conv_id IS NOT DISTINCT FROM a.conv_id
""".replace("TAILS", CONTROL_TAILS).replace("STRIDE", str(STRIDE)).replace("HISTORY", str(HISTORY))
