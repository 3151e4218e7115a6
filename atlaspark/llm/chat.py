"""Chat formatting from reply trees, in DataFrame functions only.

Messages form trees by (id, parent). Iterative self-joins double the distance
each message looks up, which gives every message its root, depth and path
score in log2(depth) rounds; leaves are ranked by score within their root, and
the same jump tables, read from the longest to the shortest, list the messages
of the chosen root-to-leaf paths. Each path becomes one conversation.

Template: one `### role: text </turn>` and a line feed per turn. Inside roles
and texts a backslash becomes \\b, # becomes \\h, < becomes \\l, and in roles
: becomes \\c, so no marker can occur in them and the way back is exact.

Null roles and texts are empty. A parent that is null or not a message makes a
root; messages on a cycle have no root and are left out. Of repeated ids the
smallest row stays. In conversations read by turn, rows of one turn are ordered
by role and text, and rows without conv_id form one conversation of their own.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlaspark.llm.common import materialise, table

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def escape(c: Column, marks=ESCAPES) -> Column:
    for raw, safe in marks:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, marks=ESCAPES) -> Column:
    for raw, safe in reversed(marks):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(id, parent, score) to (leaf, root, id, depth): the `branches` best root-to-leaf paths of each root, score ties by leaf id.

    A round joins only the messages that have not met their root yet, so short
    trees leave early and rounds grow with the logarithm of the deepest.
    """
    nodes = messages.groupBy("id").agg(F.min(F.struct("parent", "score")).alias("m")).select("id", "m.parent", F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("id").alias("up"))
    replies = nodes.where("parent is not null").join(known, F.col("parent") == F.col("up"), "left")
    nodes = replies.select("id", "up", "score").unionByName(nodes.where("parent is null").select("id", F.lit(None).cast("string").alias("up"), "score"))
    step = materialise(nodes.select("id", "up", F.lit(0).cast("long").alias("depth"), "score", F.col("id").alias("root")), "tree")
    rounds = max(1, step.count()).bit_length()
    ended, jumps = step.where("up is null"), []
    for k in range(rounds):
        open_ = step.where("up is not null")
        if open_.isEmpty():
            break
        jumps.append(open_.select("id", "up"))
        every = ended.unionByName(open_).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("above"), F.col("score").alias("more"), F.col("root").alias("top"))
        step = materialise(
            open_.join(every, "up").select(
                "id",
                F.col("next").alias("up"),
                F.when(F.col("next").isNull(), F.col("above") + 2**k).otherwise(0).alias("depth"),
                (F.col("score") + F.col("more")).alias("score"),
                F.col("top").alias("root"),
            ),
            "tree",
        )
        ended = ended.unionByName(step.where("up is null"))
    leaves = ended.join(jumps[0].select(F.col("up").alias("id")).distinct(), "id", "left_anti") if jumps else ended
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "id"))
    chosen = materialise(leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select(F.col("id").alias("leaf"), "root", "id", "depth"), "leaves")
    paths = chosen.limit(0)
    for k in reversed(range(len(jumps))):  # a path enters at its own length; the plan names paths once a round
        paths = paths.unionByName(chosen.where((F.col("depth") >= 2**k) & (F.col("depth") < 2 ** (k + 1))))
        here = F.struct("id", "depth")
        above = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("id"), (F.col("depth") - 2**k).alias("depth")))
        paths = paths.join(jumps[k], "id", "left").select("leaf", "root", F.inline(F.array_compact(F.array(here, above))))
    return paths.unionByName(chosen.where("depth = 0").select("leaf", "root", "id", "depth"))


def format_paths(paths: DataFrame, texts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per path: keep columns of its messages, formatted, and mask (start, length of each assistant text in formatted)."""
    turns = paths.join(texts, "id").select("leaf", "depth", *keep, F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(COLON))
    turns = turns.withColumn("head", head).withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    before = Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    row = F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), "role", F.col("at").alias("start"), F.length("body").alias("length"))
    found = turns.groupBy("leaf", *keep).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["role"] == "assistant"), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    return found.select(*keep, "leaf", F.concat_ws("", F.col("rows.turn")).alias("formatted"), spans.alias("mask"))


def read_back(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, r"(?s)^### ([^:]*): (.*)$", 1), ROLE_ESCAPES).alias("role"),
            unescape(F.regexp_extract(x, r"(?s)^### ([^:]*): (.*)$", 2)).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))))


def as_trees(conversations: DataFrame) -> DataFrame:
    """Each conversation as a chain: the parent of a turn is the turn before it; longer texts score higher."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("at", at)
    return rows.select(
        F.concat_ws(":", key, F.col("at")).alias("id"),
        F.when(F.col("at") > 1, F.concat_ws(":", key, F.col("at") - 1)).alias("parent"),
        F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"),
        "conv_id",
        "role",
        "text",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, leaf, formatted, mask."""
    messages = as_trees(conversations)
    paths = best_paths(messages.select("id", "parent", "score"))
    return format_paths(paths.select("leaf", "id", "depth"), messages.select("id", "conv_id", "role", "text"), ["conv_id"])


CONTROL = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_conversations(rows).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("mask")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
