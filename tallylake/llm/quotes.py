"""Conversations from messages that quote each other, mail style: native DataFrame operations only.

Each line's quote level is its number of leading ``>`` marks. Consecutive lines of one level form a passage; its text is normalised (marks
dropped, A-Z lower-cased, white space collapsed, across line breaks too) and hashed. Passages of level 0 are a message's own text. A quoted passage is linked
to the latest earlier message of its conversation that wrote it, however its lines were wrapped. A passage that no message wrote as a whole, as one quoted in part,
is linked by its lines: each to the latest earlier message that wrote it, and the message that accounts for the most characters is taken (of equals the latest).
A message replies to the latest message linked at its lowest linked level. Following these links up gives the thread; messages sorted by
(thread, turn) come after what they reply to, and their text is formatted without the quotes.

The search for the latest earlier writer goes in blocks of ``BLOCK`` turns: within a block a window over its few rows, and from block to block the last
writer of each. So a line that a million messages write and quote is spread over a thousand blocks, and no pairs are made. Each message is parsed once; what is
kept of it is its own text and hashes.

Cases: a null or empty text has no lines to quote and formats to an empty turn; a quotation of nothing earlier in its conversation stays unlinked
(and is still dropped from the text); a message without links starts its own thread; every row has its own result: several texts of a (conv_id, turn) are a message each and all count as writers (where
more of them wrote a passage, the one with the greatest digest is the origin), and equal rows have equal results; rows without conv_id or turn are neither linked nor origins; an empty table gives an
empty table; extra columns are dropped.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, join_skewed

MARKS = "^[ \\t]*(>[ \\t]*)+"
#: Turns of a conversation that are searched together: 2 ** BLOCK_BITS.
BLOCK_BITS = 10


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    bare = F.translate(F.regexp_replace(line, MARKS, ""), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(bare, "[ \\t\\r]+", " "))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs in it."""
    return F.transform(F.array(value), use)[0]


def passages(text: Column) -> Column:
    """``array<struct<level, lines>>``: runs of lines of one level, with their normalised lines that are not empty; runs without any are left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(level(x).alias("level"), normalised(x).alias("line")))

    def cut(of: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | (F.get(of, i)["level"] != F.get(of, i - 1)["level"]))

        def run(starts: Column):
            def one(at: Column, place: Column) -> Column:
                size = F.coalesce(F.get(starts, place + 1), F.size(of)) - at
                kept = F.filter(F.transform(F.slice(of, at + 1, size), lambda x: x["line"]), lambda x: x != "")
                return F.struct(F.get(of, at)["level"].alias("level"), kept.alias("lines"))

            return F.transform(starts, one)

        return bound(starts, run)

    return F.filter(bound(lines, cut), lambda p: F.size(p["lines"]) > 0)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def hashed(passage: Column) -> Column:
    """A passage as its level, its hash, and the hash and size of its lines."""
    lines = F.transform(passage["lines"], lambda x: F.struct(digest(x).alias("hash"), F.length(x).alias("size")))
    return F.struct(passage["level"].alias("level"), digest(F.array_join(passage["lines"], " ")).alias("hash"), lines.alias("lines"))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: messages that differ, and how many rows each has."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *empty).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))


def parsed(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, msg, n, role, body, quoted, own``: ``msg`` tells messages of a turn apart; the own text without quotes, and the hashed passages of either kind."""
    own = F.filter(F.split("text", "\n"), lambda x: level(x) == 0)
    body = F.regexp_replace(F.array_join(own, "\n"), "^\\n+|\\n+\\z", "")
    msg = digest(F.concat("role", F.lit(":"), "text")).alias("msg")
    row = messages.select("conv_id", "turn", msg, "n", "role", body.alias("body"), F.transform(passages(F.col("text")), hashed).alias("p"))
    return row.select("conv_id", "turn", "msg", "n", "role", "body", F.filter("p", lambda x: x["level"] > 0).alias("quoted"), F.filter("p", lambda x: x["level"] == 0).alias("own"))


def latest_before(asked: DataFrame, written: DataFrame) -> DataFrame:
    """``asked`` (``conv_id, hash, turn``, distinct) with ``origin``: turn and ``msg`` of the latest earlier message of the conversation in ``written`` (the same columns and ``msg``), else null."""
    events = asked.select("conv_id", "hash", "turn", F.lit(None).cast("struct<turn:bigint,msg:binary>").alias("writer")).unionByName(written.select("conv_id", "hash", "turn", F.struct("turn", "msg").alias("writer")))
    events = events.withColumn("block", F.shiftright("turn", BLOCK_BITS))
    earlier = W.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    inside = events.withColumn("inside", F.max("writer").over(earlier)).where("writer IS NULL")
    blocks = events.groupBy("conv_id", "hash", "block").agg(F.max("writer").alias("last"))
    before = W.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "hash", "block", F.max("last").over(before).alias("carried"))
    return inside.join(carried, ["conv_id", "hash", "block"]).select("conv_id", "hash", "turn", F.coalesce("inside", "carried").alias("origin"))


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, msg, parent, quoted`` of ``parsed`` messages: turn and ``msg`` of the message each one replies to, and how many of its passages are linked to any."""
    each = lambda name: F.explode(F.array_distinct(F.transform(name, lambda p: p["hash"]))).alias("hash")
    own = ("conv_id", "turn", "msg")
    whole = latest_before(messages.select("conv_id", "turn", each("quoted")).distinct(), messages.select(*own, each("own")))
    quoted = messages.select(*own, F.posexplode("quoted").alias("place", "p")).select(*own, "place", "p.*")
    found = checkpointed(quoted.join(whole, ["conv_id", "turn", "hash"]).select(*own, "place", "level", "origin", F.when(F.col("origin").isNull(), F.col("lines")).alias("lines")))
    part = found.where("origin IS NULL").select(*own, "place", "level", F.explode("lines").alias("line")).select(*own, "place", "level", "line.*")
    own_lines = messages.select(*own, F.explode(F.array_distinct(F.flatten(F.transform("own", lambda p: F.transform(p["lines"], lambda x: x["hash"]))))).alias("hash"))
    by_line = latest_before(part.select("conv_id", "hash", "turn").distinct(), own_lines).where("origin IS NOT NULL")
    sizes = part.join(by_line, ["conv_id", "turn", "hash"]).groupBy(*own, "place", "level", "origin").agg(F.sum("size").alias("size"))
    best = sizes.groupBy(*own, "place", "level").agg(F.max(F.struct("size", "origin"))["origin"].alias("origin"))
    linked = found.where("origin IS NOT NULL").select(*own, "level", "origin").unionByName(best.select(*own, "level", "origin"))
    parent = F.max(F.struct((-F.col("level")).alias("shallow"), "origin"))["origin"]
    return linked.groupBy(*own).agg(parent.alias("parent"), F.count("*").alias("quoted"))


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, msg, top, depth``: the message at the end of each linked message's chain of replies.

    Pointer doubling: as many rounds as the logarithm of the longest chain. Messages whose chain has ended take no part in later rounds. A message with very many replies
    is a hot key, which the join splits.
    """
    active = checkpointed(links.select("conv_id", "turn", "msg", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth")))
    settled = active.limit(0)
    while True:
        up = settled.unionByName(active).select("conv_id", F.struct("turn", "msg").alias("top"), F.col("top").alias("above"), F.col("depth").alias("more"))
        met = active.select("conv_id", "top").distinct().join(up, ["conv_id", "top"], "left")
        jumped = join_skewed(active, met, ["conv_id", "top"])
        after = checkpointed(jumped.select("conv_id", "turn", "msg", F.coalesce("above", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        settled = settled.unionByName(after.where("NOT moved").drop("moved"))
        active = after.where("moved").drop("moved")
        if active.isEmpty():
            return settled


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row per message row: ``conv_id, thread_turn, turn, parent_turn, depth, quoted, role, formatted``.

    Sorted by (conv_id, thread_turn, turn) the rows are the conversations in reply order. ``formatted`` is the chat turn without quotes.
    """
    one = checkpointed(parsed(distinct_messages(messages)))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    links = checkpointed(quote_links(one.where(placed)))
    key = ["conv_id", "turn", "msg"]
    linked = one.where(placed).drop("quoted", "own").join(links, key, "left").join(threads(links), key, "left")
    every = linked.unionByName(one.where(~placed).drop("quoted", "own"), allowMissingColumns=True)
    formatted = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("\n<|end|>"))
    out = every.select("n", "conv_id", F.coalesce("top.turn", "turn").alias("thread_turn"), "turn", F.col("parent.turn").alias("parent_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("quoted", F.lit(0)).alias("quoted"), "role", formatted.alias("formatted"))
    return out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("n", "_")


def as_mail(conversations: DataFrame, levels: int = 2) -> DataFrame:
    """A mail view of plain conversations: every message quotes the two before it, each a level deeper, above its own text.

    Chat tables hold no quotations of their own; this derives the form in which mailing lists and forums hold them.
    """
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *empty)
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    firsts = checkpointed(rows.where(placed).groupBy("conv_id", "turn").agg(F.min("text").alias("earlier")))  # of several texts of a turn the one that sorts first is quoted
    marked = lambda text, n: F.concat(F.lit("> " * n), F.replace(text, F.lit("\n"), F.lit("\n" + "> " * n)))
    out = rows.where(placed).withColumn("quoted", F.lit(""))
    for n in range(levels, 0, -1):
        above = F.when(F.col("earlier").isNotNull(), F.concat(marked(F.col("earlier"), n), F.lit("\n"))).otherwise("")
        out = out.join(firsts.withColumn("turn", F.col("turn") + n), ["conv_id", "turn"], "left").withColumn("quoted", F.concat("quoted", above)).drop("earlier")
    every = out.unionByName(rows.where(~placed).withColumn("quoted", F.lit("")))
    return every.select("conv_id", "turn", "role", F.concat("quoted", "text").alias("text"))
