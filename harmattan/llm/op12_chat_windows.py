"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes one or more windows of at most ``budget`` tokens, cut between turns:

* Prefix sums of the tokens of the formatted turns give every turn its span. They are taken in two
  levels (within runs of turn numbers, then over the totals of the runs), so that one very
  long conversation is spread over many tasks.
* The spans are dealt to segments of a fixed number of tokens. Within a segment, a fold over the spans starts
  a new window where the next turn would not fit.
* A first turn with the role ``system`` opens every window of its conversation. The turns that end
  before a window and lie within ``history`` tokens of its start are repeated in it.
* Turns with the target role are under the loss mask where they stand first; where they are repeated as
  history they are masked. So each target is learnt once.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line feed. Inside roles and texts, a backslash is put between
``<`` and ``|`` (and one more wherever backslashes stand there), so that no text can hold a mark; taking
one away gives the text back.

Defined cases: null roles and texts count as empty; turns with a null number come first; equal turn numbers are
ordered by role and MD5 of the text; repeated rows are turns of their own; rows with a null
conversation are one conversation; a turn that is too long for any window has one to itself, whole, marked
``over_budget``; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.operators.keyed import null_safe_join

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Turn numbers that share a run of the first level of the prefix sums.
RUN = 512
#: Tokens of a segment, in windows.
SEGMENT_WINDOWS = 16


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", "<$1|")


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def count_tokens(x: Column) -> Column:
    """Words and single other characters: a stand-in for a tokenizer that runs in the JVM."""
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long")


def _spans(turns: DataFrame, tokens) -> DataFrame:
    """conv, number, role, text, begin, end, system: the span of every turn in tokens of its conversation."""
    rows = turns.withColumn("n", tokens(formatted(F.col("role"), F.col("text"))))
    runs = rows.groupBy("conv", "run").agg(F.sum("n").alias("n"))
    before = W.partitionBy("conv").orderBy("run")
    bases = runs.select("conv", "run", F.coalesce(F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), (F.row_number().over(before) == 1).alias("leads"))
    inside = W.partitionBy("conv", "run").orderBy("number", "role", "tie")
    placed = null_safe_join(rows, bases, ["conv", "run"]).withColumns(
        {"end": F.col("base") + F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)), "system": F.col("leads") & (F.row_number().over(inside) == 1) & (F.col("role") == "system")}
    )
    return placed.select("conv", "role", "text", (F.col("end") - F.col("n")).alias("begin"), "end", "system")


def _opening(turns: DataFrame, tokens) -> DataFrame:
    """conv, opening, reserve: the system turn of the conversations that begin with one, and its tokens."""
    first = F.min_by(F.struct("role", "text"), F.struct("number", "role", "tie"))
    found = turns.groupBy("conv").agg(first.alias("opening")).filter(F.col("opening.role") == "system")
    return found.withColumn("reserve", tokens(formatted(F.col("opening.role"), F.col("opening.text"))))


def windows(
    conversations: DataFrame,
    budget: int = 1024,
    history: int = 256,
    target: str = "assistant",
    tokens=count_tokens,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row a window: id, window_start, text, turns, n_tokens, over_budget.

    ``window_start`` is the token of the conversation at which the new turns of the window begin. ``turns`` has for
    each turn of the window, in order: start and length of its escaped text in characters of
    ``text``, ``repeated`` (stood in a window before) and ``target`` (under the loss mask).
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    number = F.col(turn_col)
    turns = conversations.select(
        F.col(id_col).alias("conv"),
        number.alias("number"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tie"),
        F.floor(number / RUN).alias("run"),
    )
    size = SEGMENT_WINDOWS * budget
    segment = F.floor(F.col("begin") / size)
    # Turns near the end of a segment may be history of the windows in the next one.
    near = F.col("begin") >= (segment + 1) * size - history
    dealt = _spans(turns, tokens).withColumn("at", F.explode(F.when(near, F.array(segment, segment + 1)).otherwise(F.array(segment)))).withColumn("own", F.col("at") == segment)
    # A segment holds a bounded number of tokens besides its last turn, and every turn has some.
    groups = dealt.groupBy("conv", "at").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "role", "text", "own", "system"))).alias("turns"))
    groups = null_safe_join(groups.filter(F.exists("turns", lambda t: t["own"])), _opening(turns, tokens), ["conv"], "left")

    reserve = F.coalesce(F.col("reserve"), F.lit(0))
    capacity = F.greatest(F.lit(budget - history) - reserve, F.lit(1))

    def fold(starts: Column, t: Column) -> Column:
        full = (F.size(starts) == 0) | (t["end"] - F.try_element_at(starts, F.lit(-1)) > capacity)
        return F.when(full, F.concat(starts, F.array(t["begin"]))).otherwise(starts)

    new = F.filter("turns", lambda t: t["own"] & ~t["system"])
    found = F.aggregate(new, F.array().cast("array<long>"), fold)
    groups = groups.withColumn("leads", F.exists("turns", lambda t: t["system"] & t["own"])).withColumn("starts", found)
    # A segment with nothing but the system turn still makes a window, which starts with it.
    groups = groups.withColumn("starts", F.when(F.size("starts") == 0, F.array(F.element_at("turns", -1)["begin"])).otherwise(F.col("starts")))

    def window(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("starts", i + 1), F.lit((1 << 63) - 1))
        old = F.filter("turns", lambda t: ~t["system"] & (t["begin"] >= start - history) & (t["end"] <= start))
        own = F.filter("turns", lambda t: t["own"] & ~t["system"] & (t["begin"] >= start) & (t["begin"] < stop))
        total = F.aggregate(F.concat(old, own), reserve, lambda n, t: n + t["end"] - t["begin"])
        opening = F.when(F.col("opening").isNotNull(), F.array(_entry(F.col("opening"), ~(F.col("leads") & (i == 0))))).otherwise(F.array())
        said = F.concat(opening, F.transform(old, lambda t: _entry(t, F.lit(True))), F.transform(own, lambda t: _entry(t, F.lit(False))))
        return F.struct(start.alias("start"), total.alias("n_tokens"), said.alias("said"))

    each = groups.select("conv", F.explode(F.transform("starts", window)).alias("w"))

    def lay(done: Column, t: Column) -> Column:
        begin = done["at"] + F.length(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)))
        length = F.length(escape(t["text"]))
        span = F.struct(begin.alias("start"), length.alias("length"), t["repeated"].alias("repeated"), (~t["repeated"] & (t["role"] == target)).alias("target"))
        return F.struct((begin + length + len(END)).alias("at"), F.concat(done["turns"], F.array(span)).alias("turns"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,repeated:boolean,target:boolean>>").alias("turns"))
    text = F.array_join(F.transform("w.said", lambda t: formatted(t["role"], t["text"])), "")
    return each.select(
        F.col("conv").alias(id_col),
        F.col("w.start").alias("window_start"),
        text.alias("text"),
        F.aggregate("w.said", begin, lay, lambda done: done["turns"]).alias("turns"),
        F.col("w.n_tokens").alias("n_tokens"),
        (F.col("w.n_tokens") > budget).alias("over_budget"),
    )


def _entry(t: Column, repeated: Column) -> Column:
    return F.struct(t["role"].alias("role"), t["text"].alias("text"), repeated.alias("repeated"))


def read_back(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, window_start, n_chars, said, learnt: what the windows hold, parsed from their texts.

    ``n_chars`` is the length of the window's text. ``said`` has role, text and ``repeated`` of every turn, ``learnt`` the texts under the loss mask, both unescaped.
    """
    pieces = F.split("text", r"<\|end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column, i: Column) -> Column:
        role = F.substring_index(p.substr(F.lit(len(TURN) + 1), F.length(p)), TEXT, 1)
        text = F.substring_index(p, TEXT, -1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), F.get("turns", i)["repeated"].alias("repeated"))

    learnt = F.transform(F.filter("turns", lambda t: t["target"]), lambda t: unescape(F.col("text").substr(t["start"] + 1, t["length"])))
    return made.select(id_col, "window_start", F.length("text").cast("long").alias("n_chars"), F.transform(pieces, turn).alias("said"), learnt.alias("learnt"))


def digests(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation, from the windows alone: turns and loss texts as digests.

    A digest of a whole conversation needs the conversation in one row; :func:`windows` and
    :func:`read_back` never do.
    """
    back = read_back(made, id_col)
    first = F.filter("said", lambda t: ~t["repeated"])
    parts = back.select(
        id_col,
        "window_start",
        "n_chars",
        F.size(first).cast("long").alias("n"),
        F.array_join(F.transform(first, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learnt", "").alias("learnt"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("window_start", "said", "learnt")))
    whole = parts.groupBy(id_col).agg(F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), ordered.alias("parts"))
    learnt = F.array_join(F.transform("parts", lambda p: p["learnt"]), "")
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    return whole.select(
        id_col,
        "n_turns",
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
