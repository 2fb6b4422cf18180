"""Conversations: windows of the latest messages, and a roster of the names in them; batch and Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAP = 200_000


def rolling_window(messages: DataFrame, cap: int = CAP) -> DataFrame:
    """(conv_id, turn, first_turn, n_messages, n_chars): what a window of cap characters holds after each message, that message at least."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length(F.coalesce("text", F.lit(""))) + 1
    rows = messages.select("conv_id", "turn", size.alias("size")).withColumn("until", F.sum("size").over(w)).withColumn("k", F.count("*").over(w))
    rows = rows.withColumn("since", F.col("until") - F.col("size"))
    # a message's window begins with the first one that has at most cap characters from its start on: a search in a running sum, as one sort
    starts = rows.select("conv_id", F.col("since").alias("at"), F.lit(1).alias("kind"), F.struct("turn", "k", "since").alias("begin"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("until"))
    ends = rows.select("conv_id", F.least(F.col("until") - cap, "since").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(starts.schema["begin"].dataType).alias("begin"), "turn", "k", "until")
    latest = Window.partitionBy("conv_id").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(ends).withColumn("begin", F.last("begin", ignorenulls=True).over(latest)).where("kind = 0")
    return found.select("conv_id", "turn", F.col("begin.turn").alias("first_turn"), (F.col("k") - F.col("begin.k") + 1).alias("n_messages"), (F.col("until") - F.col("begin.since")).alias("n_chars"))


def roster(mentions: DataFrame) -> DataFrame:
    """mentions: (conv_id, turn, name, decision). (conv_id, name, first_turn, last_turn, n_seen, accepted): once accepted, always."""
    return mentions.groupBy("conv_id", "name").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_seen"), F.bool_or(F.col("decision") == "accepted").alias("accepted"))


def newly_accepted(mentions: DataFrame) -> DataFrame:
    """(conv_id, turn, name): the message with which each name of a conversation was first accepted."""
    return mentions.where("decision = 'accepted'").groupBy("conv_id", "name").agg(F.min("turn").alias("turn")).select("conv_id", "turn", "name")


def stream_windows(messages: DataFrame, cap: int = CAP, idle_minutes: int | None = None) -> DataFrame:
    """rolling_window() over a stream of (conv_id, turn, text) in which each conversation's turns come in order; state is the sizes held.

    The state of a conversation without a message for idle_minutes goes (None: never); one that goes on later begins anew.
    """

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        turns, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values("turn")
        out, first, held = [], 0, sum(sizes)
        for turn, text in zip(rows["turn"], rows["text"]):
            turns.append(int(turn))
            sizes.append(len(text or "") + 1)
            held += sizes[-1]
            while first < len(sizes) - 1 and held > cap:
                held -= sizes[first]
                first += 1
            out.append((key[0], int(turn), turns[first], len(turns) - first, held))
        state.update((turns[first:], sizes[first:]))
        if idle_minutes is not None:
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "first_turn", "n_messages", "n_chars"])

    return messages.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, turn long, first_turn long, n_messages long, n_chars long", "turns array<long>, sizes array<long>", "append",
        GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def vouched(mentions: DataFrame) -> DataFrame:
    """mentions: (conv_id, turn, name, decision), names in lower case. Lone names under review after an accepted full name with that first word."""
    known = mentions.where("decision = 'accepted' and instr(name, ' ') > 0").groupBy("conv_id", F.substring_index("name", " ", 1).alias("name")).agg(F.min("turn").alias("since"))
    lone = mentions.where("decision = 'review' and instr(name, ' ') = 0")
    return lone.join(known, ["conv_id", "name"]).where("since < turn").select("conv_id", "turn", "name", "since").distinct()


def window_texts(messages: DataFrame, cap: int = CAP) -> DataFrame:
    """(conv_id, turn, text): the messages of each window of rolling_window(), joined by line ends; a window holds cap characters or one message."""
    w = rolling_window(messages, cap).select("conv_id", "turn", "first_turn").alias("w")
    m = messages.select("conv_id", F.col("turn").alias("at"), F.coalesce("text", F.lit("")).alias("text")).alias("m")
    held = w.join(m, (F.col("w.conv_id") == F.col("m.conv_id")) & F.col("at").between(F.col("first_turn"), F.col("turn")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return held.groupBy("w.conv_id", "turn").agg(F.array_join(texts, "\n").alias("text"))
