"""Conversations without quotations, in the order of replies.

Lines that begin with ``>`` are quotations; their level is the number of marks. Consecutive lines of one level
are a passage: marks off, white space and line breaks as one space, lower case. Every run of WINDOW words
of a passage is hashed, so it doesn't matter where lines were broken, and joined within its conversation to the first
message that has the run in its own passages. Passages and lines of fewer words are hashed whole, and found as a passage, line or sentence. The
message that most quoted characters of the outermost level come from, by runs first, is the parent (if levels further in only are found, theirs). Threads follow one another by
their first turn; in each, replies by turn directly follow what they reply to.

Positions are counted over ranges of the order, so no task holds a conversation, however long.

Cases: a null text counts as empty; a null conversation or turn has no parent and isn't one; rows that share conversation
and turn share a parent and follow one another; a line is never linked to its own or a later turn;
a quoted line of white space divides no passage; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.session import materialize, parallelism, temporary

QUOTED = r"^[ \t]*>"
MARKS = r"^([ \t]*>)+[ \t]?"
#: A line before a quotation that says who wrote it.
INTRODUCTION = r"(?i)^[ \t]*(on|am|le|el)\b.*\b(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$"


#: Words hashed together.
WINDOW = 5
#: Parts that a conversation's messages are dealt to at most, where its quoted ones are looked for.
PARTS = 16
#: Hashes returned at once.
ROWS = 20_000

_MARKS, _SENTENCE = re.compile(MARKS), re.compile(r"(?<=[.!?…。！？])\s+")


def own_text(text: Column) -> Column:
    """The lines without quotations and their introductions."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    following = F.transform(lines, lambda x, k: F.struct(x.alias("line"), F.coalesce(F.get(lines, k + 1), F.lit("")).alias("next")))
    own = F.filter(following, lambda p: ~p["line"].rlike(QUOTED) & ~(p["line"].rlike(INTRODUCTION) & p["next"].rlike(QUOTED)))
    return F.regexp_replace(F.array_join(F.transform(own, lambda p: p["line"]), "\n"), r"^\s+|\s+$", "")


def units(text: str) -> Iterator[tuple[int, bool, str]]:
    """Level, whether it is a run of WINDOW words, and the words, of all that is hashed of a message."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks[0].count(">") if marks else 0
        plain = " ".join(line[marks.end() if marks else 0 :].lower().split())
        if not runs or runs[-1][0] != level:
            if not plain:
                continue
            runs.append((level, []))
        if plain:
            runs[-1][1].append(plain)
    for level, lines in runs:
        words = " ".join(lines).split()
        for k in range(len(words) - WINDOW + 1):
            yield level, True, " ".join(words[k : k + WINDOW])
        short = {*lines, " ".join(words)} if level else {*lines, " ".join(words), *(x for y in lines for x in _SENTENCE.split(y)), *_SENTENCE.split(" ".join(words))}
        yield from ((level, False, x) for x in short if x.count(" ") < WINDOW - 1)


def passages(messages: DataFrame, quoted: bool) -> DataFrame:
    """``conv_id``, ``turn``, ``level``, ``run``, ``hash`` and ``chars`` of what is hashed, of quotations or of own text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "level", "run", "hash", "chars"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64()]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows: list[tuple] = []
        for batch in batches:
            for conversation, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for level, run, words in units(text):
                    if (level > 0) == quoted:
                        rows.append((conversation, turn, level, run, hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(words)))
                        if len(rows) >= ROWS:
                            yield out()
                            rows.clear()
        if rows:
            yield out()

    return messages.select("conv_id", "turn", "text").mapInArrow(hashed, "conv_id long, turn long, level int, run boolean, hash binary, chars long")


def quotation_links(messages: DataFrame) -> DataFrame:
    """Quotations by origin: ``conv_id``, ``turn``, ``level``, ``source`` (the first turn whose own text it is), ``chars`` of runs and ``short_chars``."""
    told = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    quoting = told.where(F.col("text").rlike("(?m)" + QUOTED))
    quoted = materialize(passages(quoting, True).groupBy("conv_id", "turn", "level", "run", "hash").agg(F.sum("chars").alias("chars")), "quotes")
    part = F.pmod(F.xxhash64("turn"), F.lit(PARTS))
    where = quoted.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("_part"))
    near = told.withColumn("_part", part).join(where, ["conv_id", "_part"], "left_semi")
    origins = passages(near, False).join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    origins = materialize(origins, "quote-origins")
    chars, short = F.sum(F.when(F.col("run"), F.col("chars")).otherwise(0)), F.sum(F.when(F.col("run"), 0).otherwise(F.col("chars")))
    return quoted.join(origins, ["conv_id", "hash"]).where("source < turn").groupBy("conv_id", "turn", "level", "source").agg(chars.alias("chars"), short.alias("short_chars"))


def parents(links: DataFrame) -> DataFrame:
    """``conv_id``, ``turn`` and ``parent``: by the outermost level, then characters of runs, of shorter ones, then the latest turn."""
    return links.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "chars", "short_chars", "source"))["source"].alias("parent"))


def next_siblings(nodes: DataFrame) -> DataFrame:
    """``conv_id``, ``turn`` and ``sibling``: the next turn with the same parent. Siblings are taken by ranges, so none of a parent's replies need meet in one task."""
    ranged = nodes.where("parent IS NOT NULL").select("conv_id", "parent", "turn").repartitionByRange(parallelism(nodes.sparkSession), "conv_id", "parent", "turn")
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), "reply-siblings")
    group = ["conv_id", "parent", "_range"]
    firsts = ranged.groupBy(*group).agg(F.min("turn").alias("_first"))
    beyond = firsts.select(*group, F.lead("_first").over(Window.partitionBy("conv_id", "parent").orderBy("_range")).alias("_beyond"))
    inside = ranged.withColumn("_inside", F.lead("turn").over(Window.partitionBy(*group).orderBy("turn")))
    return inside.join(beyond, group).select("conv_id", "turn", F.coalesce("_inside", "_beyond").alias("sibling"))


def reply_threads(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``conv_id``, ``turn``, ``parent``, distinct) as ``conv_id``, ``turn``, ``root``, ``depth`` and ``following``.

    A walk around each thread enters a message, then its replies by turn, and leaves it. Every step knows the
    next; steps ahead double in each round, and a row stays one row of fixed size however long the thread. ``following`` counts the messages
    entered from this one to the thread's end, so the larger come first; what is left before that end gives the depth.
    """
    child = nodes.where("parent IS NOT NULL").groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    tree = nodes.join(child, ["conv_id", "turn"], "left").join(next_siblings(nodes), ["conv_id", "turn"], "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    enter = tree.select("conv_id", "turn", F.lit(False).alias("leaves"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().alias("to_leaves"), one.alias("entered"), one.alias("level"))
    leave = tree.select("conv_id", "turn", F.lit(True).alias("leaves"), F.coalesce("sibling", "parent").alias("to"), F.col("sibling").isNull().alias("to_leaves"), none.alias("entered"), (-one).alias("level"))
    steps = materialize(enter.unionByName(leave).withColumn("root", F.when(F.col("to").isNull(), F.col("turn"))), "reply-steps")
    while steps.where("to IS NOT NULL").limit(1).count():
        ahead = steps.select("conv_id", F.col("turn").alias("to"), F.col("leaves").alias("to_leaves"), *[F.col(c).alias(f"_{c}") for c in ("to", "to_leaves", "entered", "level", "root")])
        further = steps.where("to IS NOT NULL").join(ahead, ["conv_id", "to", "to_leaves"])
        further = further.select("conv_id", "turn", "leaves", F.col("_to").alias("to"), F.col("_to_leaves").alias("to_leaves"), (F.col("entered") + F.col("_entered")).alias("entered"), (F.col("level") + F.col("_level")).alias("level"), F.col("_root").alias("root"))
        steps = materialize(further.unionByName(steps.where("to IS NULL")), "reply-steps")
    return steps.where("NOT leaves").select("conv_id", "turn", "root", (-F.col("level")).alias("depth"), F.col("entered").alias("following"))


def reply_order(messages: DataFrame, *, conversation_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: ``conv_id``, ``turn``, ``role``, ``text`` without quotations, ``n_quoted`` (quoted lines), ``parent_turn``, ``depth`` and ``position`` (from 0) in its conversation."""
    chosen = messages.select(F.col(conversation_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    quoted = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(QUOTED)))
    order = [F.col("conv_id").asc_nulls_last(), F.col("_root"), F.col("_following").desc(), F.col("role"), F.xxhash64("text")]
    with temporary() as scope:
        parent = materialize(parents(quotation_links(chosen)), "quote-parents")
        threaded = parent.select("conv_id", "turn", "parent").unionByName(parent.select("conv_id", F.col("parent").alias("turn"), F.lit(None).cast("long").alias("parent")).distinct().join(parent.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti"))
        threads = reply_threads(materialize(threaded, "reply-threads"))
        rows = chosen.join(parent, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
        rows = rows.select(
            "conv_id", "turn", "role", own_text(F.col("text")).alias("text"), quoted.alias("n_quoted"), F.col("parent").alias("parent_turn"),
            F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("root", "turn").alias("_root"), F.coalesce("following", F.lit(1)).alias("_following"),
        )
        ranged = materialize(rows.repartitionByRange(parallelism(messages.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "reply-ranges")
        scope.keep(ranged)
    counts = ranged.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(*order[1:])) - 1)
    joined = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_at")))
    return joined.select("conv_id", "turn", "role", "text", "n_quoted", "parent_turn", "depth", (F.col("_before") + F.col("_place")).cast("long").alias("position"))


def conversations(ordered: DataFrame, most: int = 256) -> DataFrame:
    """Formatted text of each conversation, in parts of at most ``most`` messages: ``conv_id``, ``part``, ``messages`` and ``text``."""
    part = F.floor(F.col("position") / most).cast("long").alias("part")
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return ordered.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("position", turn.alias("said")))).alias("_said")).select("conv_id", "part", F.size("_said").alias("messages"), F.array_join("_said.said", "").alias("text"))
