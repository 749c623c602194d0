"""Conversations to training windows: a chat template, token budgets, repeated history and a loss mask.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash escapes a backslash and
the ``|`` of every ``<|`` (and, in roles, a line break), so no text can look like a mark; read_back() undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlore.llm._common import read, stored, text_or_empty

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns that are formatted together: no window crosses a multiple of so many, by place in the conversation.
STRETCH = 4096


def escaped(text: str | Column) -> Column:
    return F.replace(F.replace(text_or_empty(text), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(role: Column, text: Column) -> Column:
    """A turn's tokens as the budget counts them: a quarter of its bytes as they are written, and the template's own."""
    return F.ceil((F.octet_length(escaped(role)) + F.octet_length(escaped(text))) / 4).cast("long") + 4


#: Cuts of a stretch, whose first turns may be carried over from the one before. cum is the prefix sum of the
#: conversation's tokens up to a turn. Each cut has the first new turn s and the first repeated turn h; a window holds
#: the system turn, turns h to s as history, and new turns while the budget lasts.
_CUTS = """
aggregate(slice(turns, carried + 1, size(turns)), struct(cast(array() as array<struct<s:int,h:int>>) AS cuts, cast(-1 as bigint) AS most), (a, t) ->
  CASE WHEN size(a.cuts) > 0 AND t.cum <= a.most THEN a
       WHEN t.pos = 1 THEN struct(array(struct(0 AS s, 0 AS h)) AS cuts, {budget}L - if(has_system, 0L, system_cost) AS most)
       ELSE transform(array(coalesce(try_element_at(filter(
              sequence(greatest(cast(t.pos - first AS int) - {history}, if(has_system, 1, 0)), cast(t.pos - first AS int)),
              h -> t.cum - t.cost - turns[h].cum + turns[h].cost <= {history_budget}
               AND system_cost + t.cum - turns[h].cum + turns[h].cost <= {budget}), 1), cast(t.pos - first AS int))),
            h -> struct(concat(a.cuts, array(struct(cast(t.pos - first AS int) AS s, h AS h))) AS cuts,
                        {budget}L - system_cost + turns[h].cum - turns[h].cost AS most))[0]
  END).cuts
"""

#: Where the loss lies in a window's text: (start, length) in characters, of each new assistant turn's escaped text.
_SPANS = """
aggregate(written, struct(0 AS at, cast(array() as array<struct<start:int,length:int>>) AS spans), (a, w) -> struct(
  a.at + length(w.line) AS at,
  CASE WHEN w.loss THEN concat(a.spans, array(struct(a.at + w.head AS start, w.body AS length))) ELSE a.spans END AS spans)).spans
"""


def format_chats(
    turns: DataFrame, budget: int = 1024, history: int = 2, history_budget: int = 256,
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Windows of whole turns, one row each: conv_id, stretch, window, text, spans, repeated, tokens.

    Prefix sums of the turns' tokens choose the cuts: a window takes new turns while the system turn, the repeated
    history (at most ``history`` turns of at most ``history_budget`` tokens before the first new one) and they stay
    within ``budget``. A turn that alone exceeds it has a window of its own, whole. ``repeated`` counts the turns at
    the window's head that an earlier window had; they carry no loss. spans is the loss mask: each assistant turn
    bears loss once, in the window where it is new.

    Turns are ordered by number (null first), then role, then text; repeated rows are turns like others. Null role or
    text is empty. A null conversation id is a conversation of its own. Only a first turn of role ``system`` is
    retained. Windows end at every STRETCH-th turn, by place and whatever the turns' numbers are; the next one begins
    with history like any other. An empty table gives no rows; other columns aren't read.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), text_or_empty(F.col(f"`{role}`")).alias("role"), text_or_empty(F.col(f"`{text}`")).alias("text")
    ).withColumn("part", F.floor(F.col("turn") / STRETCH))
    # places and prefix sums: within ranges of turn numbers, so that a long conversation is dealt to several tasks, and
    # then over the ranges; a fold over the collected turns would work them out anew for each turn
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    costed = rows.withColumn("cost", turn_tokens(F.col("role"), F.col("text")))
    rows = costed.withColumns(
        {"pos": F.row_number().over(order), "cum": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))}
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = costed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("costs")).select(
        F.col("conv_id").alias("id"), F.col("part").alias("own"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("places"), F.coalesce(F.sum("costs").over(before), F.lit(0)).alias("sums")
    )
    later = ranges.where("places > 0")  # the first range of a conversation needs nothing added
    placed = rows.join(later, F.col("conv_id").eqNullSafe(F.col("id")) & F.col("part").eqNullSafe(F.col("own")), "left").select(
        "conv_id", (F.col("pos") + F.coalesce("places", F.lit(0))).alias("pos"), (F.col("cum") + F.coalesce("sums", F.lit(0))).alias("cum"), "cost", "role", "text"
    )
    # the last turns of a stretch are also history for the next
    at = F.floor((F.col("pos") - 1) / STRETCH)
    stretches = F.when(F.pmod(F.col("pos") - 1, F.lit(STRETCH)) >= STRETCH - history, F.array(at, at + 1)).otherwise(F.array(at))
    grouped = (
        placed.withColumn("stretch", F.explode(stretches))
        .groupBy("conv_id", "stretch")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "cum", "cost", "role", "text"))).alias("turns"))
        .select("conv_id", "stretch", "turns", F.col("turns")[0]["pos"].alias("first"), ((F.col("turns")[0]["role"] == "system") & (F.col("turns")[0]["pos"] == 1)).alias("opens"))
        .withColumn("carried", F.when(F.col("stretch") > 0, F.col("stretch") * STRETCH + 1 - F.col("first")).otherwise(0).cast("int"))
        .where(F.size("turns") > F.col("carried"))
    )
    begin = grouped.where("stretch = 0").withColumn("has_system", F.col("opens")).withColumn("system", F.when(F.col("opens"), F.col("turns")[0]))
    systems = grouped.where("stretch = 0 and opens").select("conv_id", F.col("turns")[0].alias("system"))
    later = grouped.where("stretch > 0").join(systems.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id").withColumn("has_system", F.lit(False))
    whole = begin.unionByName(later).withColumn("system_cost", F.coalesce(F.col("system.cost"), F.lit(0).cast("long")))

    cuts = F.expr(_CUTS.format(budget=budget, history=history, history_budget=history_budget))
    windows = (
        whole.withColumn("cuts", cuts)
        .select("*", F.posexplode("cuts").alias("window", "cut"))
        .withColumn("ends", F.expr("coalesce(try_element_at(cuts, window + 2).s, size(turns))"))
        .withColumn("head", F.expr("CASE WHEN system IS NOT NULL AND (cut.s > 0 OR NOT has_system) THEN array(system) ELSE slice(turns, 1, 0) END"))
        .withColumn("repeated", F.expr("size(head) + cut.s - cut.h"))
        .withColumn("shown", F.expr("concat(head, slice(turns, cut.h + 1, ends - cut.h))"))
    )

    def written(t: Column, i: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
        body = escaped(t["text"])
        return F.struct(
            F.concat(head, body, F.lit(END)).alias("line"), F.length(head).alias("head"), F.length(body).alias("body"),
            ((i >= F.col("repeated")) & (t["role"] == "assistant")).alias("loss"),
        )

    return windows.withColumn("written", F.transform("shown", written)).select(
        "conv_id", "stretch", "window",
        F.array_join(F.transform("written", lambda w: w["line"]), "").alias("text"),
        F.expr(_SPANS).alias("spans"), "repeated",
        F.expr("aggregate(shown, 0L, (a, t) -> a + t.cost)").alias("tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations as the formatted windows tell them: conv_id, turns (role, text), losses (texts under the mask), chars."""
    def turn(line: Column) -> Column:
        own = F.substring(line, len(START) + 1, 2**31 - 1)
        head = F.regexp_extract(own, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        return F.struct(unescaped(head).alias("role"), unescaped(own.substr(F.length(head) + 2, F.length(own))).alias("text"))

    told = windows.withColumn("lines", F.split("text", r"\Q" + END + r"\E")).select(
        "conv_id", "stretch", "window",
        F.transform(F.expr("slice(lines, repeated + 1, size(lines) - 1 - repeated)"), turn).alias("turns"),
        F.transform("spans", lambda s: unescaped(F.col("text").substr(s["start"] + 1, s["length"]))).alias("losses"),
        F.length("text").cast("long").alias("chars"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("stretch", "window", "turns", "losses", "chars")))
    return told.groupBy("conv_id").agg(ordered.alias("w")).select(
        "conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.flatten(F.col("w.losses")).alias("losses"), F.expr("aggregate(w.chars, 0L, (a, c) -> a + c)").alias("chars")
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, written, and read back."""
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{control}'), (-1L, 1L, 'assistant', '{control}') AS t(conv_id, turn, role, text)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    told = read_back(stored(format_chats(turns), "op8-windows"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )
