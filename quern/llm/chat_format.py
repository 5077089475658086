r"""Chat formatting, in DataFrame operations only.

A turn's content is a list of typed parts. :func:`flatten` visits them in
order: text is escaped and kept, an image, audio clip or document becomes a
numbered placeholder, with the attachment's reference and the number of model
tokens that the placeholder expands to recorded beside it.

A turn is written as ``<s>[INST]role[/INST]content</s>``. Inside roles and
texts a control string gets a backslash after its first character, one more
for those it already has, so escaping is reversible for any text and no text
can end or start a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.columns import let

#: A control string, or one that escaping made of it: first character, backslashes, rest.
CONTROL = r"([<\[])(\\*)(/?s>|\||/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|\||/?INST\])"
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
PLACEHOLDER = r"<\|(?:image|audio|document):[0-9]+\|>"

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Side of the square image patch that is one token, tokens a second of audio, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25.0, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """The parts of a message that is nothing but text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), *[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _tokens(part: Column) -> Column:
    ceil = lambda c: F.ceil(F.coalesce(c.cast("double"), F.lit(0.0)))
    return (
        F.when(part["kind"] == "image", ceil(part["width"] / PATCH) * ceil(part["height"] / PATCH))
        .when(part["kind"] == "audio", ceil(part["seconds"] * AUDIO_RATE))
        .when(part["kind"] == "document", ceil(part["pages"] * PAGE_TOKENS))
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_media(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def segments(parts: Column) -> Column:
    """``struct<texts, media>``: the escaped text before, between and after the attachments, and these.

    Text parts that follow each other are one text before they are escaped, so no
    control string can be put together from parts. A part of an unknown or null
    kind counts as text; null parts and null texts are empty.
    """

    def run(own: Column) -> Column:
        return escape(F.array_join(F.transform(own, lambda p: F.coalesce(p["text"], F.lit(""))), ""))

    def cut(parts: Column, edges: Column) -> Column:
        edge = lambda k: F.element_at(edges, k.cast("int"))
        texts = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: run(F.slice(parts, edge(k) + 1, edge(k + 1) - edge(k) - 1)))
        media = F.transform(F.filter(parts, _is_media), lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), _tokens(p).alias("tokens")))
        return F.struct(texts.alias("texts"), media.alias("media"))

    def visit(parts: Column) -> Column:
        at = F.filter(F.transform(parts, lambda p, i: F.when(_is_media(p), i + 1)), lambda i: i.isNotNull())
        return let(F.concat(F.array(F.lit(0)), at, F.array(F.size(parts) + 1)), lambda edges: cut(parts, edges))

    return let(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), visit)


def numbered(seen: Column, first: Column) -> tuple[Column, Column]:
    """The content string of segments, and their attachments, numbered from ``first``."""
    mark = lambda k: F.element_at(seen["media"], (k + 1).cast("int"))["kind"]
    pieces = F.transform(seen["texts"], lambda t, k: F.when(k < F.size(seen["media"]), F.concat(t, F.lit("<|"), mark(k), F.lit(":"), (first + k).cast("string"), F.lit("|>"))).otherwise(t))
    attachments = F.transform(seen["media"], lambda m, k: F.struct((first + k).cast("int").alias("idx"), m["kind"].alias("kind"), m["uri"].alias("uri"), m["tokens"].alias("tokens")))
    return F.array_join(pieces, ""), attachments


def flatten(parts: Column) -> tuple[Column, Column]:
    """The content string of a list of parts, and its attachments in order.

    Attachments are ``array<struct<idx, kind, uri, tokens>>``; placeholder
    ``<|kind:idx|>`` stands where the part stood.
    """
    both = let(segments(parts), lambda seen: F.struct(*[c.alias(n) for n, c in zip(("content", "attachments"), numbered(seen, F.lit(0)), strict=True)]))
    return both["content"], both["attachments"]


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    train_on: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_mask, attachments, expanded_tokens``.

    * Rows are ordered by turn, null turns first; equal turns by role, then text.
      Repeated rows are turns of their own.
    * Null roles and texts are empty. A null conversation id is a conversation.
    * ``loss_mask`` has, for each turn, its length in ``formatted`` and the part
      of it, counted from its start, that training predicts: the content of the
      turns whose role is ``train_on``. Offsets are in code points.
    * ``parts_col`` names a column of typed parts (:data:`PART`); without it the
      text column is the only part. Attachments are numbered in the conversation.
    * A conversation is one string, so its turns meet in one task; they are
      formatted before the shuffle.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), raw.alias("text"), segments(F.col(parts_col) if parts_col else text_part(raw)).alias("seen"))
    before = F.lit(0).cast("long")
    if parts_col:
        earlier = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "seen").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.size("seen.media")).over(earlier), F.lit(0)).cast("long")
    content, attachments = numbered(F.col("seen"), F.col("before"))
    rows = plain.withColumn("before", before).select(
        "conv_id",
        F.struct("turn", "role", "text", "before", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)).alias("head"), content.alias("content"), attachments.alias("attachments")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    mask = F.transform(
        "ts",
        lambda t: F.struct(
            (F.char_length(t["head"]) + F.char_length(t["content"]) + len(CLOSE)).cast("long").alias("chars"),
            F.when(t["role"] == train_on, F.char_length(t["head"])).otherwise(0).cast("long").alias("start"),
            F.when(t["role"] == train_on, F.char_length(t["head"]) + F.char_length(t["content"])).otherwise(0).cast("long").alias("end"),
        ),
    )
    joined = F.flatten(F.transform("ts", lambda t: t["attachments"]))
    return grouped.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["content"], F.lit(CLOSE))), "").alias("formatted"),
        mask.alias("loss_mask"),
        joined.alias("attachments"),
        F.aggregate(joined, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as ``array<struct<role, content>>``; content is still escaped."""
    pieces = F.filter(F.split(formatted, f"(?<={CLOSE})"), lambda p: p != "")
    body = lambda p: F.substring(p, len(OPEN) + 1, F.char_length(p) - len(OPEN) - len(CLOSE))
    return F.transform(
        F.transform(pieces, body),
        lambda b: F.struct(
            unescape(F.substring_index(b, MIDDLE, 1)).alias("role"),
            F.substring(b, F.char_length(F.substring_index(b, MIDDLE, 1)) + len(MIDDLE) + 1, F.char_length(b)).alias("content"),
        ),
    )


def visible(content: Column) -> Column:
    """The text of a turn's content, unescaped, without its placeholders."""
    return F.array_join(F.transform(F.split(content, PLACEHOLDER, -1), unescape), "")


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """The text that the loss mask covers, unescaped, in order."""
    pieces = F.filter(F.split(formatted, f"(?<={CLOSE})"), lambda p: p != "")
    return F.array_join(
        F.zip_with(pieces, loss_mask, lambda p, m: visible(F.substring(p, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), ""
    )
