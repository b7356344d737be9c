"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A conversation becomes one string, turn by turn ``<s>[INST]role[/INST]text</s>``. A parser written for that
grammar alone reads the string back. Where what it reads differs from the source, the turns that differ are
escaped (a backslash goes into every control string and before every backslash); if the whole still differs,
all turns are. Escaped turns hold no control string, so the last form always reads back as the source.

Cases: a null text or role counts as empty; turns with equal numbers are ordered by role and text; a null turn
number comes first; rows without a conversation id form one conversation with a null id; repeated rows are turns
of their own; an empty table gives an empty table; further columns are ignored. A conversation is one output
row by definition, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, and how each looks when escaped.
TURN, ROLE_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
ESCAPED = [c[0] + "\\" + c[1:] for c in CONTROL]


def escape(text: Column) -> Column:
    """``text`` without any control string; ``unescape`` gives it back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, safe in zip(CONTROL, ESCAPED):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(ROLE_END), text, F.lit(TURN_END))


def _parse_turn(piece: Column) -> Column:
    """(role, text) of one turn without its end mark; nulls when it does not follow the grammar."""
    end = F.locate(ROLE_END, piece, len(TURN) + 1)
    good = F.startswith(piece, F.lit(TURN)) & (end > 0)
    role = F.substring(piece, F.lit(len(TURN) + 1), end - F.lit(len(TURN) + 1))
    text = F.substring(piece, end + F.lit(len(ROLE_END)), F.length(piece))
    return F.struct(F.when(good, unescape(role)).alias("role"), F.when(good, unescape(text)).alias("text"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, as an array of (role, text)."""
    cut = F.split(formatted, F.lit(TURN_END), -1)
    return F.transform(F.slice(cut, 1, F.size(cut) - 1), _parse_turn)


def render(turns: Column, escaped: Column | None = None) -> Column:
    """All turns as one string; ``escaped`` says of every turn, by place, whether it is escaped."""
    if escaped is None:
        return F.array_join(F.transform(turns, lambda t: render_turn(t["role"], t["text"])), "")
    both = F.zip_with(turns, escaped, lambda t, e: F.when(
        e, render_turn(escape(t["role"]), escape(t["text"]))).otherwise(render_turn(t["role"], t["text"])))
    return F.array_join(both, "")


def format_conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation: key, turns (source), formatted, loss_mask.

    ``loss_mask`` lists (start, length) in code points, 0-based, of the assistant texts in ``formatted``.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(said)).alias("_t"))
    turns = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = grouped.select(key, turns.alias("turns"))
    # a turn that does not read back by itself is in conflict with the grammar
    clash = F.transform("turns", lambda t: ~F.coalesce(parse(render_turn(t["role"], t["text"])) == F.array(t), F.lit(False)))
    out = out.withColumn("_plain", render(F.col("turns"))).withColumn("_clash", clash)
    out = out.withColumn("_some", render(F.col("turns"), F.col("_clash")))
    every = render(F.col("turns"), F.transform("turns", lambda t: F.lit(True)))
    same = lambda c: parse(F.col(c)) == F.col("turns")
    formatted = F.when(same("_plain"), F.col("_plain")).when(same("_some"), F.col("_some")).otherwise(every)
    out = out.withColumn("formatted", formatted).drop("_plain", "_some", "_clash")
    return out.withColumn("loss_mask", loss_mask(F.col("formatted")))


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """(start, length) of every text of ``role``, found in the string itself."""
    cut = F.split(formatted, F.lit(TURN_END), -1)
    head = TURN + role + ROLE_END
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, length: BIGINT>>)").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        span = F.struct((state["at"] + len(head)).alias("start"), (F.length(piece) - len(head)).cast("long").alias("length"))
        more = F.when(F.startswith(piece, F.lit(head)), F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(piece) + len(TURN_END)).cast("long").alias("at"), more.alias("spans"))

    return F.aggregate(F.slice(cut, 1, F.size(cut) - 1), start, step, lambda s: s["spans"])


def under_mask(formatted: Column, mask: Column) -> Column:
    """The masked texts, unescaped, in order."""
    return F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and digests of what is read back from ``formatted`` and ``loss_mask``."""
    read = formatted.select(key, "formatted", parse(F.col("formatted")).alias("t"),
                            F.array_join(under_mask(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        key, F.size("t").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
