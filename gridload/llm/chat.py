"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context,
its text alone is trainable. A conversation whose last turn is not an assistant's gets a
closing example without target, so that no turn is lost.

Template: ``### role: text</turn>`` and a line feed per turn. Inside roles and texts the
first characters of the control strings are escaped (``#`` as ``\\h``, ``<`` as ``\\l``,
in roles ``:`` as ``\\c``, and the backslash itself as ``\\b``), so text can never pass
for a control string and the escape is undone exactly. ``read_back`` parses examples.

A conversation is one training sequence: its turns meet in one task. Examples are
streamed; their total size is what the method asks for, the sum of all prefixes.

Defined results: null texts and roles are empty; turns are ordered by turn (nulls
first), role, text; repeated rows are repeated turns; a null conversation id is a
conversation of its own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "### ", ": ", "</turn>\n"
TARGET_ROLE = "assistant"
#: control character -> code letter; the backslash comes first
ESCAPES = (("\\", "b"), ("#", "h"), ("<", "l"), (":", "c"))


def escape(text: Column, role: bool = False) -> Column:
    for char, code in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(char), F.lit("\\" + code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit("\\" + code), F.lit(char))
    return text


def format_examples(
    turns: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target_role: str = TARGET_ROLE,
) -> DataFrame:
    """(conv_id, example, last, formatted, loss_start, loss_end) per example.

    ``example`` numbers the target turn from 1; ``formatted[loss_start:loss_end]`` is
    trainable (code points); ``last`` marks the example that holds the whole conversation.
    """
    clean = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    one = F.struct(F.col(turn).alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    whole = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"], role=True), F.lit(SEPARATOR))
    rendered = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == target_role).alias("target"),
            head(t).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    whole = whole.select("conv_id", rendered.alias("turns"))
    places = F.filter(
        F.sequence(F.lit(1), F.size("turns") + 1),
        lambda i: F.when(i <= F.size("turns"), F.get("turns", i - 1)["target"]).otherwise(
            ~F.get("turns", F.size("turns") - 1)["target"]
        ),
    )
    each = whole.select("conv_id", "turns", F.explode(places).alias("example"))
    before = F.array_join(
        F.transform(
            F.slice("turns", 1, F.col("example") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))
        ),
        "",
    )
    each = each.select(
        "conv_id",
        "example",
        (F.col("example") >= F.size("turns")).alias("last"),
        before.alias("before"),
        F.get("turns", F.col("example") - 1).alias("reply"),
    )
    prompt = F.when(F.col("reply").isNull(), F.col("before")).otherwise(F.concat("before", F.col("reply")["head"]))
    body = F.coalesce(F.col("reply")["body"], F.lit(""))
    each = each.select("conv_id", "example", "last", prompt.alias("prompt"), body.alias("body"), "reply")
    return each.select(
        "conv_id",
        "example",
        "last",
        F.when(F.col("reply").isNull(), F.col("prompt")).otherwise(F.concat("prompt", "body", F.lit(END))).alias("formatted"),
        F.length("prompt").cast("bigint").alias("loss_start"),
        (F.length("prompt") + F.length("body")).cast("bigint").alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")

    def one(piece: Column) -> Column:
        colon = F.locate(SEPARATOR, piece)  # roles hold no colon
        name = piece.substr(F.lit(len(START) + 1), colon - len(START) - 1)
        body = piece.substr(colon + len(SEPARATOR), F.length(piece))
        return F.struct(unescape(name).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: (conv_id, turns, losses,
    formatted_chars): its turns, the trainable texts in order, and all characters."""
    loss = unescape(F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    each = examples.select(
        "conv_id",
        F.when(F.col("last"), parse_turns(F.col("formatted"))).alias("turns"),
        F.struct("example", loss.alias("text")).alias("loss"),
        F.length("formatted").cast("bigint").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.array_sort(F.collect_list("loss")).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select("conv_id", "turns", F.transform("losses", lambda x: x["text"]).alias("losses"), "formatted_chars")
