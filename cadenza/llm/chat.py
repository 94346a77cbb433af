"""Chat formatting: multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and all others as named users; the mask lists
the stretches that the assistant says. System turns stay system turns, and
the system is no participant.

A dialogue is rendered in segments of ``per_segment`` messages, so that no task
or row holds a long conversation: ``start`` is the segment's place in the whole
rendering. Messages are numbered by a sort over all tasks and prefix counts;
lengths are summed in rows without texts, and the texts of a segment meet its
speakers last.

Marks within what people say are told from those of the format: ``<|`` in a
text becomes ``<||``, and of a name ``% | < >`` and line breaks become
``%25 %7C %3C %3E %0A``.

Defined cases: a null role is the participant ``unknown``; a null text is empty; a
null conversation is one of its own; messages come in the order of their turns,
null first, and ties in the order of the MD5 of role and text; equal rows are
messages of their own; texts of any length stay whole; conversations of the
system alone have no rendering; an empty table gives no rows; only the named
columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import range_sorted

PER_SEGMENT = 512
END = "<|end|>\n"
#: Characters of names that are written as a percent sign and two digits, the percent sign first.
ESCAPES = {"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "\n": "%0A"}


def _escaped_name(role: Column) -> Column:
    for sign, code in ESCAPES.items():
        role = F.replace(role, F.lit(sign), F.lit(code))
    return role


def rotate_perspectives(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", per_segment: int = PER_SEGMENT) -> DataFrame:
    """``conv_id, speaker, segment, start, n_messages, n_target, text, mask``;
    the mask is ``start:end`` of each target stretch in code points of the
    whole rendering, end exclusive, comma-joined."""
    name, said = F.coalesce(F.col(role), F.lit("unknown")), F.coalesce(F.col(text), F.lit(""))
    messages = conversations.select(
        F.struct(F.col(conv_id).isNull().alias("none"), F.coalesce(F.col(conv_id).cast("string"), F.lit("")).alias("name")).alias("conv"),
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        name.alias("role"),
        F.md5(F.concat(F.length(name).cast("string"), F.lit(":"), name, said).cast("binary")).alias("tie"),
        F.when(name == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _escaped_name(name), F.lit("|>\n"))).alias("head"),
        F.concat(F.replace(said, F.lit("<|"), F.lit("<||")), F.lit(END)).alias("body"),
    )
    # equal rows may be many: the last key deals them to several tasks
    placed = range_sorted(messages.withColumn("_row", F.monotonically_increasing_id()), F.col("conv"), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("_row"))
    # a conversation stands in few tasks, in each in one stretch: a message's number is its place there and the counts before
    stretches = placed.groupBy("conv", "_task").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).drop("first", "n")
    numbered = placed.join(stretches, ["conv", "_task"]).withColumn("number", F.col("_at") + F.col("before"))
    numbered = numbered.withColumn("segment", F.floor(F.col("number") / per_segment).cast("long"))
    segments = numbered.groupBy("conv", "segment").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("number", "role", "head", "body"))).alias("said"))
    # lengths without texts: of segments with everyone as a user, and what each speaker's own turns there differ by
    slim = numbered.select("conv", "segment", "role", F.length("head").alias("head"), (F.length("head") + F.length("body")).cast("long").alias("length"))
    lengths = slim.groupBy("conv", "segment").agg(F.sum("length").alias("length"))
    own = slim.where("role <> 'system'").groupBy("conv", "role", "segment").agg(F.sum(F.lit(len("<|assistant|>\n")) - F.col("head")).alias("differs"))
    speakers = own.select("conv", F.col("role").alias("speaker")).distinct()
    pairs = lengths.join(speakers, "conv").join(own.withColumnRenamed("role", "speaker"), ["conv", "speaker", "segment"], "left")
    whole = Window.partitionBy("conv", "speaker").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = pairs.select("conv", "speaker", "segment", F.coalesce(F.sum(F.col("length") + F.coalesce("differs", F.lit(0))).over(whole), F.lit(0)).cast("long").alias("start"))
    rows = starts.join(segments.hint("merge"), ["conv", "segment"])
    is_own = lambda m: m["role"] == F.col("speaker")
    head = lambda m: F.when(is_own(m), F.lit("<|assistant|>\n")).otherwise(m["head"])
    rows = rows.withColumn("parts", F.transform("said", lambda m: F.struct(is_own(m).alias("own"), F.length(head(m)).cast("long").alias("h"), F.length(m["body"]).cast("long").alias("b"))))
    # the place where each message ends, from the segment's start on
    ends = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["h"] + x["b"])))
    rows = rows.withColumn("ends", ends)
    targets = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at(F.col("parts"), i)["own"])
    stretch = lambda i: F.concat_ws(":", F.col("start") + F.element_at("ends", i) + F.element_at(F.col("parts"), i)["h"], F.col("start") + F.element_at("ends", i + 1))
    return rows.select(
        "conv_id",
        "speaker",
        "segment",
        "start",
        F.size("said").cast("long").alias("n_messages"),
        F.size(targets).cast("long").alias("n_target"),
        F.array_join(F.transform("said", lambda m: F.concat(head(m), m["body"])), "").alias("text"),
        F.array_join(F.transform(targets, stretch), ",").alias("mask"),
    )


def _sql_name(name: str) -> str:
    for sign, code in ESCAPES.items():
        name = f"replace({name}, {'chr(10)' if sign == chr(10) else repr(sign)}, {code!r})"
    return name


ORACLE = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said FROM conversations
), k AS (
  SELECT conv_id, role, said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || said)) - 1 AS number FROM m
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'
), p AS (
  SELECT k.conv_id, speaker, number, number // {PER_SEGMENT} AS segment, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || {_sql_name("role")} || '|>' END || chr(10) AS head,
         replace(said, '<|', '<||') || '{END.strip()}' || chr(10) AS body
  FROM k JOIN s ON k.conv_id IS NOT DISTINCT FROM s.conv_id
), q AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY number) AS stop FROM p
)
SELECT conv_id, speaker, segment, CAST(min(stop - length(head) - length(body)) AS BIGINT) AS start,
       count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_target,
       string_agg(head || body, '' ORDER BY number) AS text,
       coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY number) FILTER (WHERE own), '') AS mask
FROM q GROUP BY conv_id, speaker, segment
"""
