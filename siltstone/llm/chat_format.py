r"""Chat formatting with a grammar round trip (native: built-in functions only).

Grammar of the output, one block a turn::

    conversation := block*
    block        := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

``role`` has no line feed and neither part has the control opener ``<|``.
A turn is rendered, parsed again by :func:`parse_blocks`, and compared with
its source; a turn that does not come back identical is rendered again with
its conflicting content escaped:

* in a text, ``<``, any number of backslashes, ``|`` gets one backslash more,
  so no ``<|`` is left; reading takes one away;
* in a role, ``%``, line feed and ``<`` become ``%25``, ``%0A`` and ``%3C``.

Reading always undoes the escapes, so a text that holds an escape sequence of
its own does not come back identical either and is escaped as well. The
second rendering comes back identical for every string: the two rules are
injective and leave no control opener. The whole conversation is parsed once
more and compared turn by turn with the source; reports end where it differs.

Defined results: null text or role is empty; turns are ordered by turn, role,
text (null turn first), repeated rows each stay a turn; rows whose conv_id is
null form one conversation; an empty table gives an empty result; extra
columns are ignored. A conversation is one row by definition, so its turns
meet in one task; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1\|")


def escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def blocks_of(formatted: Column) -> Column:
    """The blocks without their terminator; what follows the last terminator is dropped by the caller's check."""
    cut = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def parse_blocks(formatted: Column) -> Column:
    """array<struct<role, text, raw, start, ok>>: the deterministic parser.

    ``raw`` is the escaped text, which begins ``start`` code points into the
    block; ``ok`` is false where the block breaks the grammar.
    """

    def one(block: Column) -> Column:
        body = F.substr(block, F.lit(len(START) + 1))
        head = F.substring_index(body, "\n", 1)
        raw = F.substr(body, F.length(head) + 2)
        ok = block.startswith(START) & body.contains("\n") & ~body.contains("<|")
        return F.struct(
            unescape_role(head).alias("role"),
            unescape_text(raw).alias("text"),
            raw.alias("raw"),
            (F.length(head) + len(START) + 1).alias("start"),
            ok.alias("ok"),
        )

    return F.transform(blocks_of(formatted), one)


def _spoken(turn: Column) -> Column:
    return F.struct(turn["role"].alias("role"), turn["text"].alias("text"))


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, role, text to one row a conversation.

    Returns conv_id, formatted, n_turns, turns (recovered role and text),
    loss_mask (block index, code-point offset in the block, length) and
    round_trip (the recovered turns equal the source's).
    """
    source = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    plain = source.withColumn("block", render(F.col("role"), F.col("text")))
    back = parse_blocks(F.col("block"))
    same = (
        (F.size(back) == 1)
        & F.element_at(back, 1)["ok"]
        & (F.element_at(back, 1)["role"] == F.col("role"))
        & (F.element_at(back, 1)["text"] == F.col("text"))
        & F.col("block").endswith(f"{END}\n")
    )
    escaped = plain.withColumn(
        "block",
        F.when(F.coalesce(same, F.lit(False)), F.col("block")).otherwise(
            render(escape_role(F.col("role")), escape_text(F.col("text")))
        ),
    )
    # Turns that tie on turn are ordered by role and text, as the source has them.
    one = F.struct("turn", "role", "text", "block")
    grouped = escaped.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    formatted = grouped.select(
        "conv_id", F.concat_ws("", F.col("t.block")).alias("formatted"), F.transform("t", _spoken).alias("source")
    )
    parsed = formatted.withColumn("p", parse_blocks(F.col("formatted")))
    recovered = F.transform("p", _spoken)
    mask = F.filter(
        F.transform(
            "p",
            lambda x, i: F.struct(
                i.alias("block"),
                x["start"].alias("start"),
                F.length(x["raw"]).alias("length"),
                x["role"].alias("role"),
            ),
        ),
        lambda x: x["role"].isin(*loss_roles),
    )
    return parsed.select(
        "conv_id",
        "formatted",
        F.size("p").cast("long").alias("n_turns"),
        recovered.alias("turns"),
        mask.alias("loss_mask"),
        ((recovered == F.col("source")) & F.forall("p", lambda x: x["ok"])).alias("round_trip"),
    )


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order, joined with nothing between."""
    blocks = blocks_of(formatted)
    return F.concat_ws(
        "",
        F.transform(
            loss_mask,
            lambda m: unescape_text(F.substr(F.get(blocks, m["block"]), m["start"] + 1, m["length"])),
        ),
    )


def digest_columns(formatted: DataFrame) -> DataFrame:
    """The digests of what is read back from :func:`format_conversations`' output; one that differs from its source ends the job."""
    whole = F.when(F.col("round_trip"), F.col("formatted")).otherwise(F.raise_error("a conversation does not come back identical").cast("string"))
    formatted = formatted.withColumn("formatted", whole)
    loss = formatted.withColumn("loss", read_loss(F.col("formatted"), F.col("loss_mask")))
    spoken = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return loss.select(
        "conv_id",
        "n_turns",
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
