"""Chat formatting: typed content parts under one template, with a loss mask (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A content part; ``text`` for text, ``ref`` and the measures for attachments.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels a side of an image patch, audio frames a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
TURN_END = "\n</turn>\n"


def escape(s: Column) -> Column:
    """No '<' without a backslash before it is left, so no control string; unescape() gives the text back."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def expanded_tokens(p: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; unknown measures count as one patch, second or page."""
    side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) / PATCH)
    return (
        F.when(p["kind"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["kind"] == "audio", F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(1.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(p["kind"] == "document", F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .otherwise(1)
        .cast("long")
    )


def text_parts(messages: DataFrame) -> DataFrame:
    """Plain messages ``(conv_id, turn, role, text)`` as messages of one text part each."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return messages.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def format_conversations(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_spans, attachments)``, a row for each conv_id of ``messages(conv_id, turn, role, parts)``.

    A turn is ``<turn ROLE>\\n CONTENT \\n</turn>\\n``; role and text are escaped, so a control string inside them
    can't be taken for the template's. Parts are visited in order: text is escaped, any other kind becomes
    ``<KIND n>`` with n counting the conversation's attachments from 0; ``attachments`` holds (index, kind, ref,
    tokens). ``loss_spans`` are code-point ranges, end exclusive, of the contents of assistant turns.

    Turns stand by turn (null first), then role and content; repeated rows stay. Null text, role or parts are empty,
    a null kind is text, a null conv_id is a conversation of its own. An empty table gives no rows; further columns
    are ignored. A conversation is one output row, so it must fit one task; nothing else is gathered.
    """
    parts = F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)"))
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.filter(parts, lambda p: p.isNotNull()).alias("parts"))
    m = m.withColumn("n_files", F.size(F.filter("parts", lambda p: ~_is_text(p))).cast("long"))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", F.to_json("parts"))
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("first_file", F.coalesce(F.sum("n_files").over(earlier), F.lit(0)))

    def number(i: Column) -> Column:
        return F.col("first_file") + F.size(F.filter(F.slice("parts", F.lit(1), i), lambda p: ~_is_text(p)))

    def visit(p: Column, i: Column) -> Column:
        return F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), escape(F.replace(p["kind"], F.lit(">"), F.lit("\\>"))), F.lit(" "), number(i).cast("string"), F.lit(">")))

    files = F.filter(
        F.transform("parts", lambda p, i: F.when(~_is_text(p), F.struct(number(i).alias("index"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))),
        lambda x: x.isNotNull(),
    )
    m = m.withColumns({"head": F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\>")), F.lit(">\n")), "content": F.array_join(F.transform("parts", visit), ""), "files": files})
    m = m.withColumn("piece", F.concat("head", "content", F.lit(TURN_END)))
    m = m.withColumns({"n": F.row_number().over(order), "at": F.coalesce(F.sum(F.length("piece").cast("long")).over(earlier), F.lit(0)) + F.length("head")})
    span = F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), (F.col("at") + F.length("content")).alias("end")))
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", span.alias("span"), "files"))).alias("t"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role,text>>`` of a formatted conversation.

    The role's expression is possessive, as Java matches plain groups by recursion, one level a character.
    """
    bodies = F.filter(F.split(formatted, TURN_END), lambda x: x != "")
    head = r"(?s)^<turn ([^\\>]*+(?:\\.[^\\>]*+)*+)>\n(.*)$"
    return F.transform(bodies, lambda x: F.struct(unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What format_conversations() wrote, read back: counts and SHA-256 of turns and of text under the loss mask."""
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    d = formatted.select("conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return d.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: The conversation -7 of the contract.
TRICKY = r"\### Assistant: </turn> ok"

SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS role_len,
        length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) AS text_len FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(role_len + text_len + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
