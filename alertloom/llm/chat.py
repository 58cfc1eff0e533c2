"""Chat formatting with Spark expressions only: one text per conversation, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The template's marks. Every one begins with the first control string below.
TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>"
#: Strings that may not appear in a formatted text but as marks: ours and those of common chat templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLES = ("assistant",)
#: Turns that one task sorts and merges at a time.
SPAN = 256


def escape(text):
    """Write control strings so that they lose their first character; ``unescape`` is the inverse."""
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(f"&#{ord(control[0])};{control[1:]}"))
    return text


def unescape(text):
    for first in sorted({c[0] for c in CONTROL}):
        text = F.replace(text, F.lit(f"&#{ord(first)};"), F.lit(first))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _merge(turns):
    """Blocks (role, parts) of sorted turns: adjacent turns of one role share a block."""
    none = F.array().cast("array<struct<role:string,parts:array<string>>>")

    def step(blocks, turn):
        last = F.element_at(blocks, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["parts"], F.array(turn["text"])).alias("parts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("parts"))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(new)))

    return F.aggregate(turns, none, step)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_runs.

    Turns are sorted by number; adjacent turns of one role become one block whose parts
    keep the borders between turns. A block is written as its role and its parts between
    marks, and texts and roles are escaped. ``loss_runs`` divides the formatted text into
    runs (chars, loss): a run under the loss mask is the text of one assistant turn.

    Rows of a conversation are first sorted and merged in spans of 256 turn numbers, then
    the spans are put in a row, so a long conversation is spread until its one output
    text is made. A null text or role counts as empty; a null turn number comes first;
    rows with one turn number follow by role and text, repeated rows are kept; a null
    conv_id is a conversation of its own. Other columns are not read. An empty table gives
    an empty result.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    spans = rows.groupBy("conv_id", F.floor(F.col("turn") / SPAN).alias("span")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    merged = spans.select("conv_id", "span", _merge(F.col("turns")).alias("blocks"))
    whole = merged.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", "blocks"))).alias("spans"))
    blocks = whole.select("conv_id", F.flatten(F.transform("spans", lambda s: s["blocks"])).alias("blocks"))

    def run(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(block, k):
        # Two spans may meet inside a block.
        goes_on = (k > 0) & (F.get("blocks", k - 1)["role"] == block["role"])
        head = F.when(goes_on, F.lit(PART)).otherwise(F.concat(F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(block["role"]), F.lit(BODY)))
        loss = block["role"].isin(*LOSS_ROLES)
        return F.flatten(
            F.transform(
                block["parts"],
                lambda part, n: F.array(run(F.when(n == 0, head).otherwise(F.lit(PART)), F.lit(False)), run(escape(part), loss)),
            )
        )

    runs = blocks.select("conv_id", F.concat(F.flatten(F.transform("blocks", pieces)), F.array(run(F.lit(END), F.lit(False)))).alias("runs"))
    return runs.select(
        "conv_id", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("formatted"),
        F.transform("runs", lambda r: F.struct(F.length(r["text"]).alias("chars"), r["loss"].alias("loss"))).alias("loss_runs"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns of formatted texts: conv_id, formatted, turns as an array of (role, text, loss)."""

    def quoted(mark):
        return r"\Q" + mark + r"\E"

    blocks = F.slice(F.split("formatted", quoted(TURN)), 2, 1 << 30)

    def parts(block):
        role = unescape(F.substring_index(block, BODY, 1))
        body = F.substring_index(F.substring_index(block, BODY, -1), END, 1)
        return F.transform(F.split(body, quoted(PART)), lambda p: F.struct(role.alias("role"), unescape(p).alias("text"), role.isin(*LOSS_ROLES).alias("loss")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, parts)).alias("turns"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests of conversations read back: counts, hashes of turns and of the text under the loss mask."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return chats.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), learnt.alias("learnt")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
