"""Prefix-target expansion of conversations, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context, and
only its own text trainable (``loss_start`` to ``loss_end``, code points). What
follows the last assistant turn is kept in a closing example without a
trainable part, so every turn can be read back.

Template: a user turn is ``[INST]role\\ntext[/INST]``, any other
``<s>role\\ntext</s>``. Control strings inside roles and texts are escaped by
one backslash after their first character (and one more for each that is
already there); line ends in roles as ``\\n``. Unescaping is exact.

Defined cases: null roles and texts count as empty; rows of one turn are ordered
by turn, role and text, nulls first; repeated rows stay repeated; a null
conversation id is one conversation of its own; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is escaped, as one pattern for Java and RE2.
CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Escaped backslashes are cut out first, from the left; what stands between them holds escaped line ends only.
    between = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(between, "\\")


def opened(role: Column, text: Column) -> Column:
    """A formatted turn up to the end of its text."""
    return F.concat(F.when(role == "user", "[INST]").otherwise("<s>"), escape_role(role), F.lit("\n"), escape(text))


def closed(role: Column) -> Column:
    return F.when(role == "user", "[/INST]").otherwise("</s>")


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, closing): one row per example."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"), opened(role, text).alias("body"), closed(role).alias("end"), F.length(escape(text)).alias("n"))
    whole = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    last = F.size("ts")
    # A conversation's last turn always ends an example, its last assistant turn or the closing one.
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("ts", i)["role"] == "assistant") | (i == last))
    rows = whole.select("conv_id", "ts", F.posexplode(ends).alias("example", "i"))
    own = F.element_at("ts", F.col("i"))
    rows = rows.select("conv_id", "example", F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("i")), lambda t: F.concat(t["body"], t["end"])), "").alias("formatted"), own.alias("own"), (F.col("i") == last).alias("closing"))
    end = F.length("formatted") - F.length(F.col("own")["end"])
    trained = F.col("own")["role"] == "assistant"
    return rows.select("conv_id", "example", "formatted", F.when(trained, end - F.col("own")["n"]).otherwise(end).alias("loss_start"), end.alias("loss_end"), "closing")


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted conversation."""
    parts = F.split(formatted, r"\[/INST\]|</s>", -1)
    inner = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.regexp_replace(p, r"^(?:\[INST\]|<s>)", ""))
    return F.transform(inner, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")))


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return unescape(F.substr(formatted, start + 1, end - start))
