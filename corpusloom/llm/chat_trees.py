"""Conversations out of reply trees: paths by iterative self-joins, ranked by score.

Every message points at the one it answers.  Each round of a self-join doubles
the stretch that a pointer jumps, so that a tree of depth d takes log2(d)
rounds.  A round keeps the messages that have an ancestor as far up, one row
each, and no path: leaves climb to their roots along the jumps to get depth and
score, and paths are spelled out for the chosen leaves alone, by the same jumps
from the longest to the shortest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def reply_tree(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) from (conv_id, turn, role, text).

    A node is (turn, alt): different (role, text) of one turn are alternatives,
    numbered from 0 in that order, and repeated rows are one message.  A turn
    answers the last earlier turn that has a message of another role, of its
    messages of another role the first; turns in a row by one role are thus
    alternative branches, and a turn without such a predecessor is a root.  The
    score of an assistant's text is its number of characters, that of others 0.
    Rows with a null conv_id or turn are left out.  A null role is a role of its
    own, named ``none``; a null text is an empty one.  An empty table has no
    messages; other columns are not read.

    Turns are parted by ``ranges`` of (conv_id, turn), and a range is told what
    stands before it, so that a conversation of any length is shared by tasks.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "replies")
    m = turns.select("conv_id", "turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    m = m.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    m = scratch.save(m.withColumn("range", F.spark_partition_id()), "ranges")
    m = m.withColumn("alt", F.row_number().over(Window.partitionBy("range", "conv_id", "turn").orderBy("role", "text")) - 1)
    # rows in order, the first alternative of a turn last; an edge is to the row before, if it is of another role
    w = Window.partitionBy("range", "conv_id").orderBy("turn", F.desc("alt"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_was", F.lag(F.struct("turn", "alt", "role")).over(w))
    m = m.withColumn("_edge", F.last(F.when(F.col("_was.role") != F.col("role"), F.struct("_was.turn", "_was.alt")), ignorenulls=True).over(so_far))
    end = m.groupBy("range", "conv_id").agg(
        F.min_by("role", F.struct("turn", -F.col("alt"))).alias("_first"),
        F.max_by(F.struct("turn", "alt", "role", "_edge"), F.struct("turn", -F.col("alt"))).alias("_end"),
    )
    by = Window.partitionBy("conv_id").orderBy("range")
    end = end.withColumn("_before", F.lag("_end").over(by))
    end = end.withColumn("_in", F.when(F.col("_before.role") != F.col("_first"), F.struct("_before.turn", "_before.alt")))
    carried = F.last(F.coalesce("_end._edge", "_in"), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    end = end.select("range", "conv_id", F.struct("_before.turn", "_before.alt", "_before.role", carried.alias("_other")).alias("_before"), F.coalesce("_in", carried).alias("_carried"))
    m = m.join(scratch.save(end, "ends"), ["range", "conv_id"]).withColumn("_other", F.coalesce("_edge", "_carried"))
    # the last row of an earlier turn: it or the last of another role before it is answered
    m = m.withColumn("_lag", F.coalesce(F.lag(F.struct("turn", "alt", "role", "_other")).over(w), F.when(F.col("_before.turn").isNotNull(), F.col("_before"))))
    m = m.withColumn("_last", F.first("_lag").over(Window.partitionBy("range", "conv_id", "turn").orderBy(F.desc("alt"))))
    up = F.when(F.col("_last.role") != F.col("role"), F.struct("_last.turn", "_last.alt")).otherwise(F.col("_last._other"))
    score = F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double")
    return m.select(F.col("conv_id").alias("tree"), F.struct("turn", "alt").alias("node"), up.alias("parent"), "role", "text", score.alias("score"))


def _jumps(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (tree, node, up, gain): the ancestor 1, 2, 4, ... messages up, and the scores from ``node`` to below it."""
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    out = [scratch.save(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain")), "jump-0")]
    most = out[0].count()
    while 1 << len(out) <= most:
        a, b = out[-1], out[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("gain").alias("_gain"))
        far = scratch.save(a.join(b, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("gain") + F.col("_gain")).alias("gain")), f"jump-{len(out)}")
        if not far.take(1):
            break
        out.append(far)
    return out


def _climb(nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, root, depth, score) of every message that none answers and that has a root."""
    first = jumps[0]
    answered = first.select("tree", F.col("up").alias("node")).distinct()
    at = nodes.join(answered, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(1).alias("depth"), F.lit(0.0).alias("score"))
    for k, jump in reversed(list(enumerate(jumps))):
        j = jump.select("tree", F.col("node").alias("at"), F.col("up").alias("_up"), F.col("gain").alias("_gain"))
        at = at.join(j, ["tree", "at"], "left").select("tree", "leaf", F.coalesce("_up", "at").alias("at"), (F.col("depth") + F.when(F.col("_up").isNotNull(), 1 << k).otherwise(0)).alias("depth"), (F.col("score") + F.coalesce("_gain", F.lit(0.0))).alias("score"))
    roots = nodes.join(first.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("at"), F.col("score").alias("_own"))
    return at.join(roots, ["tree", "at"]).select("tree", "leaf", F.col("at").alias("root"), F.col("depth").cast("int").alias("depth"), (F.col("score") + F.col("_own")).alias("score"))


def _nodes(messages: DataFrame) -> DataFrame:
    return messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))


def branches(messages: DataFrame) -> DataFrame:
    """(tree, leaf, root, depth, score): every root-to-leaf path by its ends, scores added up.

    A parent that isn't in its tree counts as none; a null score counts as 0.
    Messages whose ancestors go in a circle have no root and are left out.
    """
    nodes = _nodes(messages)
    return _climb(nodes, _jumps(nodes, Scratch(messages.sparkSession, "branches")))


def format_branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, root, leaf, rank, depth, score, text) of every branch, or of the ``best`` of each root.

    Branches of a root rank by score, then by depth, the greater first, then by
    leaf.  ``text`` has every message of the path under its role, whole.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    messages = scratch.save(messages, "messages")
    nodes = _nodes(messages)
    jumps = _jumps(nodes, scratch)
    w = Window.partitionBy("tree", "root").orderBy(F.desc("score"), F.desc("depth"), "leaf")
    chosen = _climb(nodes, jumps).withColumn("rank", F.row_number().over(w))
    chosen = scratch.save(chosen if best is None else chosen.where(F.col("rank") <= best), "chosen")
    steps = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("above"))
    for k, jump in reversed(list(enumerate(jumps))):
        steps = scratch.save(steps, f"steps-{k + 1}")
        steps = steps.unionByName(steps.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above")))
    said = F.concat(F.lit(OPEN.split("{role}")[0]), F.col("role"), F.lit(OPEN.split("{role}")[1]), F.coalesce("text", F.lit("")), F.lit("\n" + CLOSE))
    told = steps.join(messages.select("tree", "node", said.alias("said")), ["tree", "node"])
    texts = told.groupBy("tree", "leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("pos"), "said"))), lambda x: x["said"]), "").alias("text"))
    return chosen.join(texts, ["tree", "leaf"]).select("tree", "root", "leaf", "rank", "depth", "score", "text")


def chat_trees(turns: DataFrame, best: int | None = None, ranges: int | None = None) -> DataFrame:
    """(conv_id, root, root_alt, leaf, leaf_alt, rank, depth, score, text) of a table of turns; see :func:`reply_tree`.

    ``root`` and ``leaf`` are turns, with the alternative that stands in the
    branch.  All branches are given unless ``best`` bounds those of each root.
    An empty table gives no rows.
    """
    out = format_branches(reply_tree(turns, ranges), best)
    return out.select(F.col("tree").alias("conv_id"), F.col("root.turn").alias("root"), F.col("root.alt").alias("root_alt"), F.col("leaf.turn").alias("leaf"), F.col("leaf.alt").alias("leaf_alt"), "rank", "depth", "score", "text")


ORACLE = """
WITH RECURSIVE d AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'none') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) - 1)::INT AS alt FROM d),
n AS (SELECT m.*, p.turn AS pturn, p.alt AS palt, CASE WHEN m.role = 'assistant' THEN length(m.text) ELSE 0 END::DOUBLE AS score
      FROM m LEFT JOIN LATERAL (SELECT turn, alt FROM m q WHERE q.conv_id = m.conv_id AND q.turn < m.turn AND q.role <> m.role ORDER BY turn DESC, alt LIMIT 1) p ON true),
walk AS (
  SELECT conv_id, turn AS root, alt AS root_alt, turn AS node, alt, 1 AS depth, score, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS text FROM n WHERE pturn IS NULL
  UNION ALL
  SELECT w.conv_id, w.root, w.root_alt, n.turn, n.alt, w.depth + 1, w.score + n.score, w.text || '<|' || n.role || '|>' || chr(10) || n.text || chr(10) || '<|end|>' || chr(10)
  FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.pturn = w.node AND n.palt = w.alt),
leaves AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = w.conv_id AND n.pturn = w.node AND n.palt = w.alt))
SELECT conv_id, root, root_alt, node AS leaf, alt AS leaf_alt, row_number() OVER (PARTITION BY conv_id, root, root_alt ORDER BY score DESC, depth DESC, node, alt)::INT AS rank, depth, score, text FROM leaves
"""
