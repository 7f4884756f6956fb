"""Chat formatting by quotation linking, with DataFrame functions only.

A line that starts with `>` marks (spaces between them allowed) is quoted; the number of marks is its nesting
level. Consecutive lines of one level are a passage: its words, lower-cased, with line breaks and white space as
single spaces. A passage is hashed as its overlapping runs of RUN words, so that it is found again however a
mail program wrapped it or wherever the quote begins; a passage or line of fewer words is hashed whole. A quoted
passage of level L says that the message answers, L steps up, the message that wrote it. Quotes are linked to the
latest earlier message of the conversation that has the words unquoted.

A message answers the linked message of the lowest level; among those the one with most different runs quoted,
then the latest. A message without such a link answers the message before it, if any. Messages that a quote
attaches elsewhere open a branch; those after it continue it. The result is in reply order: branches lie under
the message thread they belong to, in the order of their turns, and quoted lines are gone from the texts.

No task holds a conversation. Messages are numbered by ranges of (conversation, turn); what a message takes from
those before it is carried within its range, and over the ranges of a long conversation by one row for each range
(`shared.carried`). Quoted and written runs meet the same way, numbered by (run, turn): no pair of a frequent
run's quotes and writers is ever formed. Branches are resolved to their threads by pointer jumping over the
messages with a quote, a number of rounds that grows with the logarithm of the nesting.

Defined cases: a null text is empty; a null role stays null. Rows with a null conversation or turn form
conversations as null values compare equal, null turns first. Rows that repeat conversation and turn are
ordered by the md5 of their text, then role, and keep one row each; a message never answers its own turn. A text
of any length is read whole. A line of white space only is not linked. Runs are compared by 64-bit hashes. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import carried, cut_lineage, numbered

RUN = 5
_MARKS = r"^\s*((?:>[ \t]*)+)"


def _line_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))


def without_quotes(text: Column) -> Column:
    """The text's unquoted lines, trimmed at both ends."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: _line_level(x) == 0)
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def pieces(messages: DataFrame) -> DataFrame:
    """(n, turn, level, run) of messages (n, conv_id, turn, text): the hashes of their passages' runs of words."""
    split = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n"), lambda x: F.struct(_line_level(x).alias("level"), _normal(x).alias("key")))
    rows = messages.select("n", "conv_id", "turn", split.alias("lines"))
    level = lambda i: F.get(F.col("lines"), i)["level"]
    heads = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    rows = rows.withColumn("heads", heads)
    to = lambda j: F.coalesce(F.get(F.col("heads"), j + 1), F.size("lines"))
    passages = F.transform("heads", lambda i, j: F.struct(level(i).alias("level"), F.filter(F.flatten(F.transform(F.slice("lines", i + 1, to(j) - i), lambda x: F.split(x["key"], " "))), lambda w: w != "").alias("words")))
    short = F.transform(F.filter("lines", lambda x: (x["key"] != "") & (F.size(F.split(x["key"], " ")) < RUN)), lambda x: F.struct(x["level"].alias("level"), F.split(x["key"], " ").alias("words")))
    units = rows.select("n", "conv_id", "turn", F.explode(F.concat(passages, short)).alias("u")).select("n", "conv_id", "turn", "u.level", "u.words").where(F.size("words") > 0)
    run = lambda words: F.xxhash64("conv_id", F.array_join(words, " "))
    runs = F.when(F.size("words") < RUN, F.array(run(F.col("words")))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - RUN + 1)), lambda i: run(F.slice("words", i, RUN))))
    return units.select("n", "turn", "level", F.explode(runs).alias("run"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(n, quoted_turn, level, quoted_runs) of messages (n, conv_id, turn, text) with a linked quote: the best link."""
    found = pieces(messages)
    asked = cut_lineage(found.where("level > 0 AND turn IS NOT NULL").distinct())
    written = found.where("level = 0 AND turn IS NOT NULL").join(asked.select("run").distinct(), "run", "left_semi")
    turns = written.select("run", "turn", F.col("turn").alias("w")).union(asked.select("run", "turn", F.lit(None).cast("long")))
    turns = turns.groupBy("run", "turn").agg(F.max("w").alias("w"))
    before = carried(numbered(turns, "run", "turn", part="part"), "run", {"quoted_turn": F.col("w")}).where("quoted_turn IS NOT NULL")
    linked = asked.join(before.select("run", "turn", "quoted_turn"), ["run", "turn"])
    votes = linked.groupBy("n", "level", "quoted_turn").agg(F.count("*").alias("quoted_runs"))
    best = votes.groupBy("n").agg(F.max(F.struct((-F.col("level")).alias("up"), "quoted_runs", "quoted_turn")).alias("b"))
    return best.select("n", "b.quoted_turn", (-F.col("b.up")).alias("level"), "b.quoted_runs")


def conversations(messages: DataFrame) -> DataFrame:
    """Per message conv_id, position, thread_turn, turn, role, text, parent_turn, linked_by, n_quoted_lines.

    position counts from 1 in reply order within the conversation; thread_turn is the turn that opened the
    message's thread.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumns({"mark": F.md5(F.col("text").cast("binary")), "salt": F.rand(5)})
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "mark", "role", "salt")]
    laid = numbered(rows, *order, name="n", part="part")
    links = quote_links(laid).select("n", "quoted_turn")
    narrow = cut_lineage(laid.select("part", "n", "conv_id", "turn").join(links, "n", "left"))
    # a message without a quote continues the branch of the last one with a quote, or else the first
    first = F.col("first_number") == F.col("n")
    opened = F.when(F.col("quoted_turn").isNotNull(), F.col("turn"))
    placed = carried(narrow, "conv_id", {"previous_turn": F.col("turn"), "opener": opened}, number="n")
    placed = placed.withColumns({"opener": F.coalesce(opened, "opener"), "begin": F.when(first, F.struct("turn"))}).drop("first_number")
    begun = carried(placed, "conv_id", {"start": F.col("begin")}, number="n").withColumn("start", F.coalesce("begin", "start")["turn"]).drop("begin", "first_number")
    begun = cut_lineage(begun.withColumn("branch", F.coalesce("opener", "start")))
    branches = cut_lineage(begun.groupBy("conv_id", "turn").agg(F.max("branch").alias("branch"), F.max("quoted_turn").alias("quoted_turn")))
    threads = _threads(branches).select(F.col("conv_id").alias("t_conv"), F.col("branch").alias("t_branch"), "thread")
    at = F.col("conv_id").eqNullSafe(F.col("t_conv")) & F.when(F.col("quoted_turn").isNotNull(), F.col("turn")).eqNullSafe(F.col("t_branch"))
    known = begun.join(threads, at & F.col("t_branch").isNotNull(), "left").withColumn("thread", F.when(F.col("quoted_turn").isNotNull(), F.coalesce("thread", "turn"))).drop("t_conv", "t_branch")
    known = carried(known, "conv_id", {"thread_turn": F.col("thread")}, number="n").drop("first_number")
    known = known.withColumn("thread_turn", F.coalesce("thread", "thread_turn", "start")).select("conv_id", "n", "thread_turn", "previous_turn", "quoted_turn")
    reply = numbered(known, F.col("conv_id").asc_nulls_first(), F.col("thread_turn").asc_nulls_first(), "n", name="place", part="part")
    reply = carried(reply, "conv_id", {}, number="place").withColumn("position", F.col("place") - F.col("first_number") + 1)
    joined = laid.drop("part").join(reply.select("n", "position", "thread_turn", "previous_turn", "quoted_turn"), "n")
    text = F.coalesce(F.col("text"), F.lit(""))
    n_quoted = F.size(F.filter(F.split(text, "\r?\n"), lambda x: _line_level(x) > 0)).cast("long")
    parent = F.coalesce("quoted_turn", F.when(F.col("previous_turn") < F.col("turn"), F.col("previous_turn")))
    how = F.when(F.col("quoted_turn").isNotNull(), "quote").when(parent.isNotNull(), "previous")
    return joined.select(
        "conv_id", "position", "thread_turn", "turn", "role", without_quotes(F.col("text")).alias("text"), parent.alias("parent_turn"), how.alias("linked_by"), n_quoted.alias("n_quoted_lines")
    )


def _threads(branches: DataFrame) -> DataFrame:
    """(conv_id, branch, thread) of branches that a quote attaches to another one."""
    home = branches.select(F.col("conv_id").alias("h_conv"), F.col("turn").alias("h_turn"), F.col("branch").alias("up"))
    opened = branches.where("quoted_turn IS NOT NULL AND branch <=> turn")
    at = F.col("conv_id").eqNullSafe(F.col("h_conv")) & F.col("quoted_turn").eqNullSafe(F.col("h_turn"))
    links = cut_lineage(opened.join(home, at).select("conv_id", "branch", F.col("up").alias("thread")))
    while True:
        up = links.select(F.col("conv_id").alias("u_conv"), F.col("branch").alias("u_branch"), F.col("thread").alias("higher"))
        at = F.col("conv_id").eqNullSafe(F.col("u_conv")) & F.col("thread").eqNullSafe(F.col("u_branch"))
        new = cut_lineage(links.join(up, at, "left").select("conv_id", "branch", F.coalesce("higher", "thread").alias("thread"), (F.col("higher").isNotNull() & (F.col("higher") != F.col("thread"))).alias("moved")))
        links = new.select("conv_id", "branch", "thread")
        if new.where("moved").limit(1).count() == 0:
            return links
