"""Chat formatting into budgeted windows, in DataFrame functions.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose the spans:
a window's new turns go on as long as their sum stays within the budget that the system turn and
the repeated history leave; a turn larger than that is a window of its own, never cut. Every
window begins with the conversation's first system turn and repeats the last turns before it, at
most ``HISTORY_TOKENS`` of them, so that a reply has its context. Assistant turns are targets where
they are new; repeated ones are masked, so each counts in the loss once.

Template: ``<turn>role, line feed, text</turn>`` and a line feed per turn. Inside texts and roles a
backslash is doubled and ``<turn>`` and ``</turn>`` get one after their ``<``; a role also escapes
its line feeds. So neither marker ever occurs in escaped text, and unescaping gives back every text.

Turns are gathered in segments of ``SEGMENT`` consecutive turn numbers, together with the turns
just before as possible history. A segment's size is bounded, so a conversation of any length is
never one group; a segment begins a window.

Defined results: null texts and roles are empty, a null turn counts as -1; turns of one
conversation with the same number stand in the order of role and text, repeated rows stay. A null
``conv_id`` is a conversation of its own. Only the four columns are read. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm.common import read_table, scratch, store

BUDGET = 512
HISTORY_TOKENS = 128
#: Turn numbers per segment, and how many before it are offered as history.
SEGMENT, HISTORY_TURNS = 256, 8

OPEN, CLOSE = "<turn>", "</turn>"

#: Stand-in for a tokenizer's count: short pieces of words, groups of digits, single characters.
TOKEN = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^A-Za-z0-9\x20\x09-\x0D]"

_TURN = "struct<turn:bigint,role:string,text:string,tokens:bigint,fresh:boolean>"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escape(text: Column) -> Column:
    for plain, marked in (("\\", "\\\\"), (OPEN, "<\\turn>"), (CLOSE, "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(CLOSE + "\n"))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _windows(budget: int, history_tokens: int) -> Column:
    """Spans ``(first, after)`` of the new turns of a segment; ``own`` are its turns in order.

    ``sums`` are the prefix sums of the tokens, so a span from i to j holds
    ``sums[j] - sums[i]`` tokens.
    """
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history_tokens) - F.coalesce(F.col("system.tokens"), F.lit(0)))

    def extend(spans: Column, at: Column) -> Column:
        last = F.element_at(spans, -1)
        fits = F.col("sums")[at + 1] - F.col("sums")[last["first"]] <= room
        grown = F.concat(
            F.slice(spans, F.lit(1), F.size(spans) - 1),
            F.array(F.struct(last["first"].alias("first"), (at + 1).alias("after"))),
        )
        added = F.concat(spans, F.array(F.struct(at.alias("first"), (at + 1).alias("after"))))
        return F.when((F.size(spans) > 0) & fits, grown).otherwise(added)

    places = F.when(F.size("own") > 0, F.sequence(F.lit(0), F.size("own") - 1)).otherwise(_empty("int"))
    return F.aggregate(places, _empty("struct<first:int,after:int>"), extend)


def format_conversations(
    turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """``conv_id, segment, window, n_tokens, n_repeated, text, loss``: one row per window.

    ``n_repeated`` counts the leading turns that repeat earlier ones; ``loss`` holds the spans
    (start, end) of the targets in ``text``, in code points.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", count_tokens(F.col("text")))
    segment = F.floor(F.col("turn") / SEGMENT)
    following = F.floor((F.col("turn") + HISTORY_TURNS) / SEGMENT)
    placed = rows.select(
        "conv_id", "turn", "role", "text", "tokens", segment.alias("home"),
        F.explode(F.array_distinct(F.array(segment, following))).alias("segment"),
    )
    grouped = placed.groupBy("conv_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tokens", (F.col("home") == F.col("segment")).alias("fresh")))).alias("all")
    ).filter(F.exists("all", lambda t: t["fresh"]))
    first_system = (
        rows.filter("role = 'system'").groupBy(F.col("conv_id").alias("system_of"))
        .agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("system"))
    )
    joined = grouped.join(first_system, F.col("conv_id").eqNullSafe(F.col("system_of")), "left").select(
        "conv_id", "segment", "system",
        F.filter("all", lambda t: t["fresh"]).alias("own"), F.filter("all", lambda t: ~t["fresh"]).alias("earlier"),
    )
    joined = joined.withColumn(
        "sums",
        F.aggregate(
            "own", F.array(F.lit(0).cast("long")),
            lambda sums, t: F.concat(sums, F.array(F.element_at(sums, -1) + t["tokens"])),
        ),
    )
    spans = joined.select("*", F.posexplode(_windows(budget, history_tokens)).alias("window", "span"))

    before = F.concat("earlier", F.slice("own", F.lit(1), F.col("span.first")))
    recent = F.slice(before, F.greatest(F.lit(1), F.size(before) - HISTORY_TURNS + 1), F.lit(HISTORY_TURNS))
    is_system = lambda t: F.coalesce(
        (t["turn"] == F.col("system.turn")) & (t["role"] == "system") & (t["text"] == F.col("system.text")), F.lit(False)
    )
    # History from the last turn backwards, until the tokens are used up.
    kept = F.aggregate(
        F.reverse(F.filter(recent, lambda t: ~is_system(t))),
        F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("going"), _empty(_TURN).alias("turns")),
        lambda s, t: F.when(
            s["going"] & (s["used"] + t["tokens"] <= history_tokens),
            F.struct((s["used"] + t["tokens"]).alias("used"), F.lit(True).alias("going"), F.concat(F.array(t), s["turns"]).alias("turns")),
        ).otherwise(F.struct(s["used"].alias("used"), F.lit(False).alias("going"), s["turns"].alias("turns"))),
        lambda s: s["turns"],
    )
    new = F.slice("own", F.col("span.first") + 1, F.col("span.after") - F.col("span.first"))
    header = F.when(
        F.col("system").isNotNull() & ~F.exists("new", is_system),
        F.array(F.struct("system.turn", "system.role", "system.text", "system.tokens", F.lit(False).alias("fresh"))),
    ).otherwise(_empty(_TURN))
    windows = (
        spans.withColumn("new", new).withColumn("repeated", F.concat(header, kept))
        .withColumn("turns", F.concat("repeated", "new"))
        .select("conv_id", "segment", "window", "turns", F.size("repeated").alias("n_repeated"))
        .withColumn("rendered", F.transform("turns", _rendered))
    )
    # A target's text stands behind its marker, role and line feed.
    step = F.aggregate(
        F.arrays_zip("turns", "rendered", F.sequence(F.lit(0), F.size("turns") - 1).alias("place")),
        F.struct(F.lit(0).alias("at"), _empty("struct<start:int,end:int>").alias("loss")),
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["rendered"])).alias("at"),
            F.when(
                (x["turns"]["role"] == "assistant") & (x["place"] >= F.col("n_repeated")),
                F.concat(s["loss"], F.array(F.struct(
                    (s["at"] + len(OPEN) + F.char_length(_escape_role(x["turns"]["role"])) + 1).alias("start"),
                    (s["at"] + F.char_length(x["rendered"]) - len(CLOSE) - 1).alias("end"),
                ))),
            ).otherwise(s["loss"]).alias("loss"),
        ),
        lambda s: s["loss"],
    )
    return windows.select(
        "conv_id", "segment", "window",
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
        "n_repeated", F.array_join("rendered", "").alias("text"), step.alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """``conv_id, segment, window, turns, loss_text, chars``: the new turns of each window, parsed
    from its text, and the unescaped text under the loss."""
    parts = F.filter(F.split("text", f"{CLOSE}\n", -1), lambda p: p != "")
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n"
    parsed = F.transform(parts, lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1))
    roles = lambda p: F.regexp_extract(p, head, 1)
    turns = F.transform(parsed, lambda p: F.struct(
        unescape(roles(p)).alias("role"),
        unescape(F.substr(p, F.char_length(roles(p)) + 2)).alias("text"),
    ))
    under = F.transform(
        "loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    )
    return windows.select(
        "conv_id", "segment", "window",
        F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(parts) - F.col("n_repeated"))).alias("turns"),
        F.array_join(under, "").alias("loss_text"), F.char_length("text").cast("long").alias("chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    read = read_windows(windows).select(
        "conv_id", "segment", "window", "loss_text", "chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    # A digest needs its conversation in one row.
    ordered = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("segment", "window", "said", "loss_text"))).alias("parts"),
    )
    loss = F.array_join("parts.loss_text", "")
    return ordered.select(
        "conv_id", "n_turns", F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


#: The conversation that the query adds: its texts hold control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema
    )
    windows = store(format_conversations(turns.unionByName(control)), f"{scratch(spark, 'chat')}/windows")
    return digests(windows)
