"""Chat formatting with typed content parts (DataFrame operations only).

A turn's content is a list of parts ``struct<kind, text, ref, units>``: ``text`` carries
text; ``image``, ``audio`` and ``document`` carry a reference and a size in units (tiles,
seconds, pages). Every control string of the template begins with ``<``; inside texts and
roles ``&``, ``<`` and ``>`` are written as ``&amp;``, ``&lt;`` and ``&gt;``, so no content can
be taken for a marker and unescaping gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "</turn>\n"
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}  # tokens a unit expands to
PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """A plain text (null: empty) as content of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return F.array(part).cast(PARTS)


def _visit(part: Column) -> Column:
    """Text of one part: escaped text, or the placeholder of its kind (unknown kinds too)."""
    is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
    return F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<part:"), escape(part["kind"]), F.lit(">")))


def format_conversations(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",),
                         unit_tokens: Mapping[str, int] | None = None) -> DataFrame:
    """Format conversations; ``turns`` has ``conv_id, turn, role, parts`` (type ``PARTS``).

    Returns per conversation ``conv_id, n_turns, formatted, loss`` (spans ``start, size`` in
    UTF-8 bytes of ``formatted``: the bodies of trained roles), ``attachments`` in order of
    their placeholders (``turn, part, kind, ref, tokens``) and ``expanded_tokens`` (their sum).

    Rows go by turn, then role, then content; a null turn comes first. A null role is the
    empty role, null or empty parts an empty body, a null kind is text, null units are one
    unit, and a kind without a token rate counts one token a unit. Repeated rows are turns
    of their own. Rows with a null conv_id form one conversation. Extra columns of
    ``turns`` are not read. An empty table gives no rows.

    Offsets are a running sum over the rows of a conversation, so work stays linear in its
    length; only the finished conversation, one output value by nature, is assembled whole.
    """
    rates = {**UNIT_TOKENS, **(unit_tokens or {})}
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(F.col("parts"), F.array().cast(PARTS)).alias("parts"))
    rows = rows.withColumn("body", F.array_join(F.transform("parts", _visit), "")) \
        .withColumn("head", F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">\n"))) \
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn(
        "end", F.sum(F.octet_length("piece").cast("long")).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def attachment(part: Column, k: Column) -> Column:
        units = F.coalesce(part["units"], F.lit(1).cast("long"))
        per = F.coalesce(F.try_element_at(rate, part["kind"]), F.lit(1))
        return F.struct(F.col("turn").alias("turn"), k.cast("int").alias("part"), part["kind"].alias("kind"),
                        part["ref"].alias("ref"), (units * per).cast("long").alias("tokens"))

    indexed = F.transform("parts", lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    media = F.filter(indexed, lambda x: F.coalesce(x["p"]["kind"], F.lit("text")) != "text")
    rows = rows.withColumn("media", F.transform(media, lambda x: attachment(x["p"], x["k"])))
    body_size = F.octet_length("body").cast("long")
    start = F.col("end") - F.octet_length(F.lit(END)) - body_size
    span = F.struct(start.cast("long").alias("start"), body_size.alias("size"))
    gathered = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "piece", F.when(F.col("role").isin(*trained_roles), span).alias("span"), "media"))).alias("t"))
    return gathered.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        F.flatten(F.transform("t", lambda t: t["media"])).alias("attachments")
    ).withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of ``struct<role, text>``, unescaped."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(piece: Column) -> Column:
        head = F.instr(piece, ">\n")
        return F.struct(unescape(F.substring(piece, F.lit(7), head - 7)).alias("role"),
                        unescape(F.substring(piece, head + 2, F.length(piece))).alias("text"))

    return F.transform(pieces, read)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(raw, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string"))), "")


ORACLE_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, length(role) + length(text) + 16
        + 4 * (length(role) - length(replace(role, '&', '')) + length(text) - length(replace(text, '&', '')))
        + 3 * (length(role) - length(replace(replace(role, '<', ''), '>', ''))
               + length(text) - length(replace(replace(text, '<', ''), '>', ''))) AS size
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
