"""Chat formatting from an event log (all native).

The log has one row per event: `message` starts a message, `delta` appends to the last message of its turn, `edit`
replaces its text, `regenerate` throws its text away. Events are partitioned by conversation and by blocks of turns
(a conversation of any length is spread over tasks), sorted, folded into final messages and rendered with the ChatML
marks. Control strings inside texts get a backslash after their first character, which `unescaped` takes away again.

Defined cases: null text is empty; a null role is empty; a null turn or sequence sorts first; events tied in turn and
sequence sort by kind, role and text; a repeated `message` row is a message of its own; an empty log gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of common chat templates, and the marks of the template used here.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK = 64
PIECES = 8              # deltas a streamed message has at most
_TAILS = "(?:/?s>|/?INST\\]|</?SYS>>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)"
ESCAPE = ("([<\\[])(\\\\*)(" + _TAILS + ")", "$1\\\\$2$3")
UNESCAPE = ("([<\\[])\\\\(\\\\*)(" + _TAILS + ")", "$1$2$3")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, *ESCAPE)


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, *UNESCAPE)


def _role_out(c: Column) -> Column:
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(c: Column) -> Column:
    # Between pairs of backslashes, which stand for one, only a line end is left to be read.
    parts = F.split(unescaped(c), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def messages_as_events(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """A table of finished messages, one row per turn, as an event log."""
    return messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                           F.col(turn).cast("long").alias("seq"), F.lit("message").alias("kind"),
                           F.col(role).alias("role"), F.col(text).alias("text"))


def as_log(messages: DataFrame, learn: str = "assistant", pieces: int = PIECES) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as the log of a client that recorded them as they came.

    A message of the `learn` role is begun, half of a first draft is streamed, thrown away by a regeneration, and the text
    streamed in up to `pieces` deltas; one of another role is written down to its half and then edited to its end.
    Messages of one turn are logged one after the other, by role and text.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("nth", F.expr("row_number() over (partition by conv_id, turn order by role, text)"))
    rows = rows.withColumn("size", F.greatest(F.ceil(F.length("text") / pieces).cast("int"), F.lit(1)))
    event = "struct({} as step, '{}' as kind, {} as said)"
    half = "substring(text, 1, length(text) div 2)"
    deltas = (f"filter(transform(sequence(0, {pieces - 1}), i -> struct(3 + i as step, 'delta' as kind, substring(text, i * size + 1, size) as said)), "
              "e -> e.said != '')")
    streamed = f"concat(array({event.format(0, 'message', repr(''))}, {event.format(1, 'delta', half)}, {event.format(2, 'regenerate', repr(''))}), {deltas})"
    edited = f"array({event.format(0, 'message', half)}, {event.format(1, 'edit', 'text')})"
    rows = rows.withColumn("event", F.explode(F.when(F.col("role") == learn, F.expr(streamed)).otherwise(F.expr(edited))))
    return rows.select("conv_id", "turn", (F.col("nth") * (pieces + 3) + F.col("event.step")).cast("long").alias("seq"), "event.kind",
                       F.when(F.col("event.kind") == "message", F.col("role")).alias("role"), F.col("event.said").alias("text"))


def fold(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, messages array<struct<turn, role, text>>: the final messages of each block of turns."""
    event = F.struct("turn", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (events.select("conv_id", F.floor(F.col("turn") / block).alias("block"), event.alias("event"))
            .groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("event")).alias("e")))
    rows = rows.withColumn("starts", F.expr(
        "filter(sequence(1, size(e)), i -> i = 1 or e[i - 1].kind = 'message' or not e[i - 1].turn <=> e[i - 2].turn)"))
    rows = rows.withColumn("groups", F.expr(
        "transform(starts, (i, k) -> slice(e, i, coalesce(get(starts, k + 1), size(e) + 1) - i))"))
    last = "coalesce(array_max(filter(sequence(1, size(m)), j -> m[j - 1].kind != 'delta')), 1)"
    return rows.select("conv_id", "block", F.expr(
        f"transform(groups, m -> struct(m[0].turn as turn, m[0].role as role, "
        f"array_join(transform(slice(m, {last}, size(m)), x -> x.text), '') as text))").alias("messages"))


def render(folded: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, block, formatted, spans: the rendered text of a block, and where the loss counts in it.

    A span is (start, length) in code points of `formatted`. The blocks of a conversation in order are its text.
    """
    rows = folded.withColumn("parts", F.transform("messages", lambda m: F.struct(
        F.concat(F.lit(OPEN), _role_out(m.role), F.lit("\n")).alias("head"), escaped(m.text).alias("body"),
        (m.role == learn).alias("learn"))))
    rows = rows.withColumn("at", F.expr(
        "aggregate(parts, cast(array(0) as array<int>), (a, p) -> array_append(a, element_at(a, -1) + length(p.head) + "
        f"length(p.body) + {len(CLOSE)}))"))
    return rows.select("conv_id", "block", F.array_join(F.transform("parts", lambda p: F.concat(
        p.head, p.body, F.lit(CLOSE))), "").alias("formatted"), F.expr(
        "transform(filter(transform(parts, (p, i) -> struct(p.learn as learn, at[i] + length(p.head) as start, "
        "length(p.body) as length)), s -> s.learn), s -> struct(s.start as start, s.length as length))").alias("spans"))


def parse(rendered: DataFrame) -> DataFrame:
    """The way back: conv_id, block, messages array<struct<role, text>>, learned array<string>, formatted."""
    turns = F.expr("filter(split(formatted, '<\\\\|im_end\\\\|>\\n', -1), t -> t != '')")
    heads = F.transform("turns", lambda t: F.struct(F.substring_index(t, "\n", 1).alias("head"), t.alias("all")))
    return rendered.withColumn("turns", turns).select(
        "conv_id", "block", "formatted",
        F.transform(heads, lambda t: F.struct(
            _role_in(F.substr(t.head, F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(t["all"], F.length(t.head) + 2)).alias("text"))).alias("messages"),
        F.transform("spans", lambda s: unescaped(F.substr(F.col("formatted"), s.start + 1, s.length))).alias("learned"))


def conversations(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted: one text per conversation, for those that fit into one value."""
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("block", "formatted"))), lambda b: b.formatted), "").alias("formatted"))


def digests(parsed: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    whole = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n"))), "")
    blocks = parsed.select("conv_id", "block", F.size("messages").cast("long").alias("n"), whole.alias("turns"),
                           F.array_join("learned", "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    both = blocks.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("block", "turns", "loss"))).alias("b"))
    joined = both.withColumns({"turns": F.array_join(F.transform("b", lambda x: x.turns), ""),
                               "loss": F.array_join(F.transform("b", lambda x: x.loss), "")})
    return joined.select("conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
                         F.length("loss").cast("long").alias("loss_chars"),
                         F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
