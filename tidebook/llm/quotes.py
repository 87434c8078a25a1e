"""Chat formatting: quotations linked to their originals, and conversations in reply order.

Lines that start with `>` marks quote; the number of marks is the level. An
attribution line (`... wrote:`) right before a deeper level goes with its quotation. What is
left of a message at level 0 is its own text. Quoted and own lines are normalised
(marks off, case folded, punctuation and white space reduced to single spaces) and
hashed. Line breaks do not count: consecutive quoted lines of a level are joined to a passage,
and a passage of at least LEAST words links to the latest earlier message of the
conversation whose own words hold it in one piece, however either is wrapped. Where the
passage as a whole is not found, its paragraphs are tried, then each line: a whole own
line of the same words first, else words inside an own text. A line of fewer words
links with its passage or to the same whole line. The message that most of the level-1 lines
link to is the parent, the latest of them on ties; other messages answer the one before them.

A message whose parent is not the one before it starts a branch. Reply order puts a
branch right after its parent: the sort key of a message is the path of the parents of
its branches, then its turn.

Scale: links are found by windows over (conversation, line hash) or (conversation,
passage), which see them in turn order and keep a single value; no pairs of equal lines
are made. A line that a conversation repeats endlessly is spread over lanes of LANE turns: the
latest earlier original is in the lane of the quotation or the last one of the lanes before,
from a table of lane ends. Distinct passages meet distinct own texts of their conversation by the rarest of
their windows of LEAST words, and are then compared word by word. The
message before, and the branch that a message belongs to, are carried over the same lanes,
so that a conversation that holds a large share of all messages is spread over tasks. Paths of
branches double their reach in every round, by joining them to those of the branch where
they begin, so rounds grow as the logarithm of the nesting.

Messages are parsed twice: once into a table in the shared folder, which goes when the links
are found, and once for the result. Columns of messages other than conv_id, turn and text pass through. Texts are handled whole in
their row however long they are: memory is a few times the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import durable, let, read_table, shared_dir
from tidebook.runtime import discard

LANE, LEAST = 256, 4
ADDED = ("parent_turn", "quoted_lines", "linked_lines", "depth", "reply_path")
_MARKS = r"^[ \t]*>[> \t]*"


def normalised(line: Column) -> Column:
    """Words of a line without marks, case and punctuation, joined by single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _runs(lines: Column) -> Column:
    """Arrays of the lines that follow each other at one level."""
    starts = F.filter(
        F.transform(
            lines,
            lambda x, i: let(
                F.get(lines, i - 1),
                lambda b: F.when((i == 0) | (b["line"] + 1 != x["line"]) | (b["level"] != x["level"]), i),
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return let(
        starts,
        lambda s: F.transform(s, lambda a, k: F.slice(lines, a + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - a)),
    )


def _units(more: Column) -> Column:
    """Passages, paragraphs and lines of at least LEAST words: rank (3, 2, 1), level, first and last line, text."""

    def of(texts: Column) -> Column:
        worded = F.filter(texts, lambda x: x["text"] != "")
        unit = lambda rank: lambda r: F.struct(
            F.lit(rank).alias("rank"),
            F.get(r, F.lit(0))["level"].alias("level"),
            F.get(r, F.lit(0))["line"].alias("first"),
            F.element_at(r, -1)["line"].alias("last"),
            F.array_join(F.transform(F.filter(r, lambda x: x["text"] != ""), lambda x: x["text"]), " ").alias("text"),
        )
        every = F.concat(
            F.transform(_runs(texts), unit(3)), F.transform(let(worded, _runs), unit(2)), F.transform(worded, lambda x: unit(1)(F.array(x)))
        )
        return F.filter(every, lambda u: F.size(F.split(u["text"], " ")) >= LEAST)

    texts = F.transform(more, lambda x: F.struct(x["level"].alias("level"), x["line"].alias("line"), normalised(x["raw"]).alias("text")))
    return F.when(F.size(more) > 0, let(texts, of))


def split_message(text: Column) -> Column:
    """Struct of own text, quoted lines (level, line, hash), hashes of own lines and quoted units.

    A text without quotes keeps its every character; null stays null. Lines without a
    word are never hashed.
    """

    def parse(lines: Column) -> Column:
        leveled = F.transform(
            lines,
            lambda x, i: F.struct(
                i.alias("line"),
                F.char_length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"),
                x.alias("raw"),
            ),
        )

        def tagged(all_lines: Column) -> Column:
            kept = F.filter(
                all_lines,
                lambda x, i: ~(
                    x["raw"].rlike(r"(?i)\bwrote:[ \t]*$")
                    & F.coalesce(F.get(all_lines, i + 1)["level"] == x["level"] + 1, F.lit(False))
                ),
            )
            return let(
                kept,
                lambda k: F.struct(
                    F.filter(k, lambda x: x["level"] == 0).alias("zero"), F.filter(k, lambda x: x["level"] > 0).alias("more")
                ),
            )

        def hashes(part: Column) -> Column:
            return F.filter(
                F.transform(
                    part,
                    lambda x: let(
                        normalised(x["raw"]),
                        lambda n: F.struct(
                            x["level"].alias("level"), x["line"].alias("line"), F.when(n != "", F.xxhash64(n)).alias("hash")
                        ),
                    ),
                ),
                lambda x: x["hash"].isNotNull(),
            )

        return let(
            let(leveled, tagged),
            lambda t: F.struct(
                F.when(F.size(t["more"]) == 0, F.array_join(lines, "\n"))
                .otherwise(F.btrim(F.array_join(F.transform(t["zero"], lambda x: x["raw"]), "\n"), F.lit("\n\r\t ")))
                .alias("own"),
                hashes(t["more"]).alias("quoted"),
                F.array_distinct(F.transform(hashes(t["zero"]), lambda x: x["hash"])).alias("mine"),
                _units(t["more"]).alias("units"),
            ),
        )

    return F.when(text.isNotNull(), let(F.split(text, "\n"), parse))


def _windows(text: Column) -> Column:
    """Distinct hashes of all runs of LEAST words of a normalised text."""
    return let(
        F.split(text, " "),
        lambda w: F.when(
            F.size(w) >= LEAST,
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.size(w) - LEAST + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, LEAST), " ")))
            ),
        ),
    )


def _latest(origins: DataFrame, quoted: DataFrame, key: str) -> DataFrame:
    """`quoted` with origin: the latest earlier turn of `origins` (conv_id, turn, key) with the same key."""
    lane = F.floor(F.col("turn") / LANE).alias("_tq_lane")
    held = origins.select("conv_id", key, "turn", lane)
    ends = held.groupBy("conv_id", key, "_tq_lane").agg(F.max("turn").alias("_tq_end"))
    # a lane that only asks has no end of its own
    asked = quoted.select("conv_id", key, lane).distinct()
    lanes = Window.partitionBy("conv_id", key).orderBy("_tq_lane").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.join(asked.withColumn("_tq_asked", F.lit(True)), ["conv_id", key, "_tq_lane"], "full")
        .withColumn("_tq_carry", F.last("_tq_end", ignorenulls=True).over(lanes))
        .where("_tq_asked")
        .select("conv_id", key, "_tq_lane", "_tq_carry")
    )
    earlier = Window.partitionBy("conv_id", key, "_tq_lane").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = held.withColumn("_tq_own", F.lit(True)).unionByName(quoted.select("*", lane), allowMissingColumns=True)
    found = both.withColumn("_tq_near", F.max(F.when(F.col("_tq_own"), F.col("turn"))).over(earlier)).where("_tq_own IS NULL")
    return (
        found.join(carried, ["conv_id", key, "_tq_lane"], "left")
        .withColumn("origin", F.coalesce("_tq_near", "_tq_carry"))
        .drop("_tq_own", "_tq_lane", "_tq_near", "_tq_carry")
    )


def _unit_links(keyed: DataFrame) -> DataFrame:
    """(conv_id, turn, message, level, line, wide, near): origins of a line by its passage or paragraph, and by its own words."""
    units = durable(
        keyed.where("size(s.units) > 0")
        .select("conv_id", "turn", F.xxhash64("s.units").alias("message"), F.explode("s.units").alias("u"))
        .select("conv_id", "turn", "message", "u.*")
        .withColumn("unit", F.xxhash64("text"))
    )
    texts = units.select("conv_id", "unit", F.col("text").alias("quote")).distinct()
    own = durable(
        keyed.where("s.own <> ''")
        .join(units.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", normalised(F.col("s.own")).alias("body"))
        .withColumn("body_id", F.xxhash64("body"))
    )
    bodies = own.select("conv_id", "body_id", "body").distinct()
    asked = texts.select("conv_id", "unit", F.explode(_windows(F.col("quote"))).alias("window"))
    held = durable(
        bodies.select("conv_id", "body_id", F.explode(_windows(F.col("body"))).alias("window")).join(
            asked.select("conv_id", "window").distinct(), ["conv_id", "window"], "left_semi"
        )
    )
    spread = held.groupBy("conv_id", "window").agg(F.count(F.lit(1)).alias("n"))
    # a unit with a window that no own text has is nowhere
    rarest = (
        asked.join(spread, ["conv_id", "window"], "left")
        .groupBy("conv_id", "unit")
        .agg(F.min_by("window", F.coalesce("n", F.lit(0))).alias("window"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
        .where("n > 0")
    )
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    holds = (
        rarest.join(held, ["conv_id", "window"])
        .join(texts, ["conv_id", "unit"])
        .join(bodies, ["conv_id", "body_id"])
        .where(F.contains(spaced("body"), spaced("quote")))
        .select("conv_id", "body_id", "unit")
    )
    origins = holds.join(own, ["conv_id", "body_id"]).select("conv_id", "turn", "unit").distinct()
    linked = _latest(origins, units.drop("text"), "unit").where("origin IS NOT NULL")
    lines = linked.withColumn("line", F.explode(F.sequence("first", "last")))
    wider = F.when(F.col("rank") > 1, F.col("rank"))
    return lines.groupBy("conv_id", "turn", "message", "level", "line").agg(
        F.max_by("origin", wider).alias("wide"), F.max(F.when(F.col("rank") == 1, F.col("origin"))).alias("near")
    )


def quotation_links(parsed: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, level, line, origin) of quoted lines; origin is null where none is found.

    `parsed` has conv_id, turn and the struct of split_message as s.
    """
    keyed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = keyed.select("conv_id", "turn", F.xxhash64("s.units").alias("message"), F.explode("s.quoted").alias("q")).select(
        "conv_id", "turn", "message", F.col("q.level").alias("level"), F.col("q.line").alias("line"), F.col("q.hash").alias("hash")
    )
    # only lines that someone quotes can be originals
    wanted = quoted.select("conv_id", "hash").distinct()
    origins = (
        keyed.select("conv_id", "turn", F.explode("s.mine").alias("hash")).distinct().join(wanted, ["conv_id", "hash"], "left_semi")
    )
    return (
        _latest(origins, quoted, "hash")
        .join(_unit_links(keyed), ["conv_id", "turn", "message", "level", "line"], "left")
        .select("conv_id", "turn", "level", "line", F.coalesce("wide", "origin", "near").alias("origin"))
    )


def _parents(links: DataFrame) -> DataFrame:
    """(conv_id, turn, quoted_turn): the message that most level-1 lines link to, the latest on ties."""
    votes = links.where("level = 1 AND origin IS NOT NULL").groupBy("conv_id", "turn", "origin").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct("n", "origin")).alias("quoted_turn"))


def _carried(turns: DataFrame, value: Column, name: str) -> DataFrame:
    """`turns` with the latest non-null `value` of earlier turns of the conversation as `name`."""
    laned = turns.withColumn("_tq_lane", F.floor(F.col("turn") / LANE)).withColumn("_tq_value", value)
    ends = laned.groupBy("conv_id", "_tq_lane").agg(
        F.max_by("_tq_value", F.when(F.col("_tq_value").isNotNull(), F.col("turn"))).alias("_tq_end")
    )
    lanes = Window.partitionBy("conv_id").orderBy("_tq_lane").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "_tq_lane", F.last("_tq_end", ignorenulls=True).over(lanes).alias("_tq_carry"))
    within = Window.partitionBy("conv_id", "_tq_lane").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return (
        laned.withColumn("_tq_near", F.last("_tq_value", ignorenulls=True).over(within))
        .join(carried, ["conv_id", "_tq_lane"])
        .withColumn(name, F.coalesce("_tq_near", "_tq_carry"))
        .drop("_tq_lane", "_tq_value", "_tq_near", "_tq_carry")
    )


def _branch_paths(branches: DataFrame) -> DataFrame:
    """(conv_id, branch, path) from branches with parent_turn and parent_branch (null: the main line).

    Each round puts the path of the branch where one begins before its own, so that what a
    path covers doubles. Parents are earlier turns, so every path ends at the main line.
    """
    now = durable(branches.select("conv_id", "branch", F.array("parent_turn").alias("path"), F.col("parent_branch").alias("up")))
    while now.where("up IS NOT NULL").limit(1).count():
        above = now.select("conv_id", F.col("branch").alias("up"), F.col("path").alias("above"), F.col("up").alias("further"))
        open_ones, done = now.where("up IS NOT NULL"), now.where("up IS NULL")
        longer = open_ones.join(above, ["conv_id", "up"]).select(
            "conv_id", "branch", F.concat("above", "path").alias("path"), F.col("further").alias("up")
        )
        now = durable(done.unionByName(longer))
    return now.drop("up")


def reply_order(messages: DataFrame) -> DataFrame:
    """Rows of `messages` (conv_id, turn, text and any others) with parent_turn, quoted_lines,
    linked_lines, depth and reply_path, sorted by conversation and reply path.

    text is without quotations. parent_turn is null for the first message of a conversation, and
    for rows whose conv_id or turn is null, which link to nothing. Rows that repeat a
    (conv_id, turn) share their links. depth counts the branches above a message. Input
    columns of the added names are replaced, the others keep their names and values;
    no rows give no rows, and texts of any length are parsed whole.
    """
    own = [c for c in messages.columns if c not in ADDED]
    packed = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_tq_row")
    parsed = messages.select("conv_id", "turn", packed, split_message(F.col("text")).alias("s"))
    # links read the parts of a message again and again, each by its columns
    spark, parts = messages.sparkSession, parsed.select("conv_id", "turn", "s")
    path = f"{shared_dir(spark)}/quotes-{uuid.uuid4().hex}"
    parts.write.parquet(path)
    links = durable(quotation_links(spark.read.schema(parts.schema).parquet(path)))
    discard(spark, path)
    turns = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    counts = links.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("quoted_lines"), F.count("origin").alias("linked_lines")
    )
    before = _carried(turns, F.col("turn"), "previous")
    placed = (
        before.join(_parents(links), ["conv_id", "turn"], "left")
        .join(counts, ["conv_id", "turn"], "left")
        .withColumn("parent_turn", F.coalesce("quoted_turn", "previous"))
        .withColumn("starts", F.when(F.col("parent_turn") != F.col("previous"), F.col("turn")))
    )
    placed = _carried(placed, F.col("starts"), "open")
    placed = durable(placed.withColumn("branch", F.coalesce("starts", "open")).drop("open", "previous", "quoted_turn"))
    parents = placed.select("conv_id", F.col("turn").alias("parent_turn"), F.col("branch").alias("parent_branch"))
    branches = (
        placed.where("starts IS NOT NULL")
        .select("conv_id", F.col("starts").alias("branch"), "parent_turn")
        .join(parents, ["conv_id", "parent_turn"], "left")
    )
    paths = _branch_paths(branches)
    # messages of the main line have no branch; only the others look for a path
    astray = placed.where("branch IS NOT NULL").join(paths, ["conv_id", "branch"], "left")
    straight = placed.where("branch IS NULL").withColumn("path", F.lit(None).cast("array<bigint>"))
    ordered = astray.unionByName(straight).select(
        "conv_id",
        "turn",
        "parent_turn",
        F.coalesce("quoted_lines", F.lit(0)).alias("quoted_lines"),
        F.coalesce("linked_lines", F.lit(0)).alias("linked_lines"),
        F.coalesce(F.size("path"), F.lit(0)).alias("depth"),
        F.concat(F.coalesce("path", F.array().cast("array<bigint>")), F.array("turn")).alias("reply_path"),
    )
    return (
        parsed.select("conv_id", "turn", "_tq_row", F.col("s.own").alias("_tq_text"))
        .join(ordered, ["conv_id", "turn"], "left")
        .select(
            *[F.col("_tq_text").alias("text") if c == "text" else F.col(f"_tq_row.`{c}`").alias(c) for c in own],
            "parent_turn",
            F.coalesce("quoted_lines", F.lit(0)).cast("long").alias("quoted_lines"),
            F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            F.coalesce("reply_path", F.array(F.col("turn"))).alias("reply_path"),
        )
        .orderBy("conv_id", "reply_path")
    )


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of all conversations, without quotations, in reply order."""
    return reply_order(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
