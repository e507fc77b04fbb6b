"""Chat formatting: typed content parts become one marked, reversible string per conversation.

A turn holds ordered parts (type, text, ref, size). A visitor expression per type flattens them:
text is escaped, image, audio and document parts become numbered placeholders, and each of these
is recorded with its turn, place, reference and the tokens that it expands to.

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Inside texts a backslash is doubled and `<|` becomes `<\\|`, so no control string can come out of a
text and `unescaped` restores it exactly. Neighbouring text parts are joined before they are escaped, so
none can come out of several parts either. Roles escape `%`, `<` and line breaks as `%25 %3C %0A`.
The loss mask is a list of spans (turn, start, length) inside the turn's block of the string.

Cases: null text or parts are empty content, a null role is the empty role, an unknown part type
raises. Equal turn numbers are ordered by role, then content; a null turn number comes first. Null
conversation ids form one conversation. An empty table gives an empty table. Other columns are
ignored. A formatted conversation is one value, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART_TYPE = "array<struct<type:string,text:string,ref:string,size:bigint>>"
# Units of `size` per token: pixels of an image, milliseconds of sound, pages of a document.
PIXELS_PER_TOKEN, MS_PER_TOKEN, TOKENS_PER_PAGE = 28 * 28, 40, 1500


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _swap(value: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


_ROLE = [("%", "%25"), ("<", "%3C"), ("\n", "%0A")]


def escaped_role(role: Column) -> Column:
    return _swap(F.coalesce(role, F.lit("")), _ROLE)


def unescaped_role(role: Column) -> Column:
    return _swap(role, [(b, a) for a, b in reversed(_ROLE)])


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes in place of its placeholder."""
    size = F.greatest(F.coalesce(part["size"], F.lit(0)), F.lit(0))
    return (
        F.when(part["type"] == "image", F.ceil(size / PIXELS_PER_TOKEN))
        .when(part["type"] == "audio", F.ceil(size / MS_PER_TOKEN))
        .when(part["type"] == "document", size * TOKENS_PER_PAGE)
        .otherwise(F.lit(0)).cast("bigint")
    )


def _placeholder(part: Column, place: Column) -> Column:
    """What an attachment leaves in the content."""
    mark = F.concat(F.lit("<|"), part["type"], F.lit("_"), place.cast("string"), F.lit("|>"))
    return F.when(part["type"].isin("image", "audio", "document"), mark).otherwise(
        F.raise_error(F.concat(F.lit("unknown content part: "), F.coalesce(part["type"], F.lit("null")))))


def _content(parts: Column) -> Column:
    """All parts in order: each run of text parts escaped as one text, attachments as placeholders."""
    placed = F.transform(parts, lambda p, i: F.struct(p.alias("part"), i.alias("place")))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))

    def visit(now: Column, x: Column) -> Column:
        part = x["part"]
        text = F.struct(now["done"].alias("done"), F.concat(now["run"], F.coalesce(part["text"], F.lit(""))).alias("run"))
        other = F.struct(F.concat(now["done"], escaped(now["run"]), _placeholder(part, x["place"])).alias("done"), F.lit("").alias("run"))
        return F.when(part["type"] == "text", text).otherwise(other)

    return F.aggregate(placed, start, visit, lambda last: F.concat(last["done"], escaped(last["run"])))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    empty = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                    empty.cast("string").alias("ref"), empty.cast("bigint").alias("size"))
    return F.array(part).cast(PART_TYPE)


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, parts) -> conv_id, n_turns, formatted, loss, attachments, expanded_tokens.

    loss: array of (turn, start, length), code points inside a turn's block, for turns of
    `loss_roles`. attachments: array of (turn, place, type, ref, tokens).
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PART_TYPE))
    flat = turns.select(
        "conv_id", "turn", "role",
        _content(parts).alias("content"),
        F.filter(
            F.transform(parts, lambda p, i: F.struct(
                i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))),
            lambda a: a["type"] != "text",
        ).alias("attached"),
    )
    told = flat.select(
        "conv_id",
        F.struct(
            "turn", "role", "content", escaped_role(F.col("role")).alias("head"),
            F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("learn"), "attached",
        ).alias("t"),
    )
    listed = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    block = lambda t: F.concat(F.lit(START), t["head"], F.lit("\n"), t["content"], F.lit(END + "\n"))
    span = lambda t, i: F.struct(
        i.alias("turn"), (F.length(t["head"]) + len(START) + 1).alias("start"),
        F.length(t["content"]).alias("length"), t["learn"].alias("learn"))
    attach = lambda t, i: F.transform(t["attached"], lambda a: F.struct(
        i.alias("turn"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    return listed.select(
        "conv_id",
        F.size("ts").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("ts", block), "").alias("formatted"),
        F.filter(F.transform("ts", span), lambda s: s["learn"]).alias("loss"),
        F.flatten(F.transform("ts", attach)).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def turns_of(formatted: Column) -> Column:
    """Read a formatted string back: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    body = lambda b: F.substring_index(b, END, 1)  # noqa: E731  content has no control string but placeholders
    head = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(blocks, lambda b: F.struct(
        unescaped_role(head(b)).alias("role"),
        unescaped(F.substr(body(b), F.length(head(b)) + 2)).alias("text")))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    blocks = F.split(formatted, r"<\|im_start\|>")  # the first is empty: block i + 1 is turn i
    return F.transform(loss, lambda s: unescaped(F.substr(
        F.get(blocks, s["turn"] + 1), s["start"] - len(START) + 1, s["length"])))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets from the formatted strings, as counts and digests."""
    read = formatted.select(
        "conv_id", "formatted", turns_of(F.col("formatted")).alias("ts"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("learned"),
        F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens",
    )
    told = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("ts").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "n_attachments", "expanded_tokens",
    )
