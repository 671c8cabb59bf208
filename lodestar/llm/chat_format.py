"""Chat formatting: a finite-state machine over roles and a declarative template. DataFrame functions only.

A template names the strings around roles and texts, the escape scheme, the roles under the loss mask and the turn
order. Formatting gives, for each conversation, one text, its segments with a loss flag each, the loss spans and
whether the machine accepts the order of turns; `read_back` parses turns and masked text from the formatted text alone.

Escapes: `&` becomes `&amp;`, control string i becomes `&ci;` and, in roles, a line feed becomes `&n;`. No escaped text
holds a control string, and every `&` in it begins an escape, so unescaping is exact.

Null role or text counts as empty. Rows are ordered by turn (null first), then role and text, so ties and repeated rows
have a defined order. Conversations whose turns break the order are formatted too and have valid = false. A conversation
is one row of the result, so its turns meet in one task, as a document's text does; conversations are never split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if any("&" in c for c in self.controls) or any(m.strip("\n") not in self.controls for m in (self.open, self.close)):
            raise ValueError("markers must be control strings, and control strings may not hold &")


def escape(text: Column, t: Template, role: bool = False) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for i, c in enumerate(t.controls):
        out = F.replace(out, F.lit(c), F.lit(f"&c{i};"))
    return F.replace(out, F.lit("\n"), F.lit("&n;")) if role else out


def unescape(text: Column, t: Template, role: bool = False) -> Column:
    out = F.replace(text, F.lit("&n;"), F.lit("\n")) if role else text
    for i, c in enumerate(t.controls):
        out = F.replace(out, F.lit(f"&c{i};"), F.lit(c))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def accepts(roles: Column, t: Template) -> Column:
    """Whether the machine ends in an accepting state; a missing transition leads to a state that nothing leaves."""
    arcs = F.create_map(*(F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}\n{role}", to)))
    step = lambda state, role: F.coalesce(F.try_element_at(arcs, F.concat(state, F.lit("\n"), role)), F.lit("\n"))
    return F.aggregate(roles, F.lit(t.start), step).isin(list(t.accepting))


def format_chats(turns: DataFrame, t: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv id, formatted, segments array<struct<text, loss>>, loss_spans array<struct<start, len>> in code points, valid. An empty table gives no rows; other columns are not read."""
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    grouped = (
        turns.select(F.col(quoted(conv_col)).alias("conv"), F.struct(F.col(quoted(turn_col)).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("row"))
        .groupBy("conv")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
    )
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "rows",
            lambda r: F.array(
                part(F.concat(F.lit(t.open), escape(r["role"], t, True), F.lit(t.after_role)), F.lit(False)),
                part(escape(r["text"], t), r["role"].isin(list(t.loss_roles))),
                part(F.lit(t.close), F.lit(False)),
            ),
        )
    )
    out = grouped.select(F.col("conv"), segments.alias("segments"), accepts(F.transform("rows", lambda r: r["role"]), t).alias("valid"))
    lengths = F.transform("segments", lambda s: F.length(s["text"]).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,len:bigint>>)").alias("spans"))
    spans = F.aggregate(
        F.arrays_zip(lengths.alias("n"), F.transform("segments", lambda s: s["loss"]).alias("loss")),
        zero,
        lambda a, s: F.struct((a["at"] + s["n"]).alias("at"), F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), s["n"].alias("len"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return out.select(F.col("conv").alias(conv_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", spans.alias("loss_spans"), "valid")


def read_back(formatted: DataFrame, t: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """conv id, turns array<struct<role, text>> parsed from the formatted text, loss_texts array<string> read under the mask."""
    pieces = F.split("formatted", F.lit(r"\Q" + t.close + r"\E"), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    head = len(t.open)
    turn = lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, t.after_role, 1), head + 1, 2**31 - 1), t, True).alias("role"),
        unescape(p.substr(F.length(F.substring_index(p, t.after_role, 1)) + F.lit(len(t.after_role) + 1), F.length(p)), t).alias("text"),
    )
    masked = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["len"].cast("int")), t))
    return formatted.select(F.col(quoted(conv_col)), F.transform(pieces, turn).alias("turns"), masked.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
