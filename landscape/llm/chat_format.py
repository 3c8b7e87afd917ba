"""Chat formatting with typed content parts, in DataFrame operations only.

A message's content is a list of typed parts (text, image, audio, document).
A visitor turns each part into template text: text parts are escaped, the
others become ordered placeholders whose references and expanded token counts
are recorded apart. Turns are framed by control strings; every control string
that occurs inside a text is escaped reversibly, so the formatted string can
be split and read back without loss. The loss mask lists, per assistant text,
its place in the formatted string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, END, PART = "<|turn|>", "<|end|>\n", "<|part|>"
#: what must not occur inside a text: after its first character, any number of
#: backslashes may stand; escaping adds one, unescaping takes one away
CONTROL = r"([<\[])(\\*)(?=\|[a-z_0-9:]*\|>|/?s>|/?INST\]|/?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(?=\|[a-z_0-9:]*\|>|/?s>|/?INST\]|/?SYS>>)"
PLACEHOLDER = r"^<\|(?:image|audio|document):\d+\|>$"

PART_TYPE = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder expands to."""

    patch: int = 14              # image: one token for each patch x patch pixels, two at least
    audio_per_second: float = 25.0
    document_per_page: int = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("width"),
                            F.lit(None).cast("long").alias("height"), F.lit(None).cast("double").alias("seconds"),
                            F.lit(None).cast("long").alias("pages")))


def _tokens(p: Column, e: Expansion) -> Column:
    """Tokens of one non-text part."""
    image = F.greatest(F.lit(2), F.ceil(F.coalesce(p["width"], F.lit(0)) / e.patch)
                       * F.ceil(F.coalesce(p["height"], F.lit(0)) / e.patch))
    audio = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * e.audio_per_second)
    pages = F.coalesce(p["pages"], F.lit(1)) * e.document_per_page
    return (F.when(p["type"] == "image", image).when(p["type"] == "audio", audio)
            .when(p["type"] == "document", pages).otherwise(0).cast("long"))


def _visit(p: Column, i: Column) -> Column:
    """Template text of part i."""
    mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), i.cast("string"), F.lit("|>"))
    return F.when(p["type"].isin("image", "audio", "document"), mark).otherwise(
        escape(F.coalesce(p["text"], F.lit(""))))


def _role(role: Column) -> Column:
    """A role on one line: newline and percent sign are written as %0A, %25."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")),
                            F.lit("\n"), F.lit("%0A")))


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts", loss_role: str = "assistant",
                         expansion: Expansion = Expansion()) -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``formatted``, ``loss``
    (array of (start, length), code points from 0 in ``formatted``, one per
    text part of a ``loss_role`` turn), ``attachments`` (array of (turn index,
    part index, type, ref, tokens) in order) and ``attachment_tokens``.

    ``parts`` is an array of ``PART_TYPE`` structs; a null list is an empty
    message; an unknown type is read as text. Turns are ordered by ``turn``
    (nulls first), ties by role, then by content; repeated rows stay as turns of
    their own. A null conversation id forms one conversation; null roles count as
    empty. An empty table gives no rows; other columns are ignored. A
    conversation's formatted text is one value and so is put together in one task.
    """
    c = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                     F.col(f"`{role}`").alias("role"),
                     F.coalesce(F.col(f"`{parts}`"), F.array().cast(f"array<{PART_TYPE}>")).alias("parts"))
    c = c.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts",
                 F.transform("parts", _visit).alias("shown"))
    head = F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n"))
    c = c.select("conv", "turn", "role", "parts", "shown", head.alias("head"),
                 F.concat(head, F.array_join("shown", PART), F.lit(END)).alias("line"))
    # places of the text parts inside their own turn
    sizes = F.transform("shown", lambda s: F.length(s))
    c = c.withColumn("sizes", sizes)
    at = F.transform("sizes", lambda n, i: F.length("head") + i * len(PART) + F.aggregate(
        F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b))
    masked = F.filter(F.arrays_zip(at.alias("at"), F.col("sizes").alias("n"),
                                   F.transform("parts", lambda p: p["type"]).alias("kind")),
                      lambda z: ~z["kind"].isin("image", "audio", "document"))
    c = c.withColumn("mask", F.when(F.col("role") == loss_role, masked))
    files = F.filter(F.transform("parts", lambda p, i: F.struct(
        i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p, expansion).alias("tokens"))),
        lambda f: f["type"].isin("image", "audio", "document"))
    c = c.withColumn("files", files)
    order = W.partitionBy("conv").orderBy("turn", "role", "line")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    c = c.select("conv", "line", "mask", "files", (F.row_number().over(order) - 1).alias("i"),
                 F.coalesce(F.sum(F.length("line").cast("long")).over(before), F.lit(0)).alias("start"))
    whole = c.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(
        F.struct("i", "start", "line", "mask", "files"))).alias("t"))
    spans = F.flatten(F.transform("t", lambda t: F.transform(
        F.coalesce(t["mask"], F.array().cast("array<struct<at:int,n:int,kind:string>>")),
        lambda m: F.struct((t["start"] + m["at"]).alias("start"), m["n"].cast("long").alias("length")))))
    attached = F.flatten(F.transform("t", lambda t: F.transform(
        t["files"], lambda f: F.struct(t["i"].alias("turn"), f["part"].alias("part"), f["type"].alias("type"),
                                       f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return (whole.select("conv", "n_turns", F.array_join(F.transform("t", lambda t: t["line"]), "").alias("formatted"),
                         spans.alias("loss"), attached.alias("attachments"))
            .select(F.col("conv").alias(conv), "n_turns", "formatted", "loss", "attachments",
                    F.aggregate("attachments", F.lit(0).cast("long"),
                                lambda a, f: a + f["tokens"]).alias("attachment_tokens")))


def read_turns(formatted: Column) -> Column:
    """array of (role, text) read back from a formatted string; placeholders
    are left out and the text parts of a turn are joined."""
    body = F.slice(F.split(formatted, r"<\|turn\|>"), 2, F.greatest(F.length(formatted), F.lit(1)))

    def parse(line: Column) -> Column:
        cut = F.instr(line, "\n")
        content = F.substring(line, cut + 1, F.length(line) - cut - F.lit(len(END)))
        texts = F.transform(F.split(content, r"<\|part\|>"),
                            lambda p: F.when(p.rlike(PLACEHOLDER), F.lit("")).otherwise(unescape(p)))
        return F.struct(_plain_role(F.substring(line, F.lit(1), cut - 1)).alias("role"),
                        F.array_join(texts, "").alias("text"))

    return F.transform(body, parse)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda m: unescape(F.substring(
        formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
