"""Reply trees as chat conversations (operator 6), in DataFrame operations only.

Messages name their parent.  Self-joins that double their reach (2, 4, 8 ... ancestors at a time) enumerate the paths:
going up they sum scores and depth, so leaves can be ranked in their tree; going from the chosen leaves they list every
message of each chosen path.  A thread of n messages takes log2(n) joins, and only chosen paths are ever expanded.

A path becomes `<|role|>text</s>` for each turn.  Inside roles and texts `\\`, `<` and `|` are written `\\\\`, `\\l` and
`\\p`, so no control string can occur in them and the way back is exact.

Defined cases: null texts and roles are empty; a parent that isn't there makes its child a root; messages on a cycle
have no root and are on no path; equal scores rank the longer path first, then the smaller leaf; repeated rows of a
thread are turns of their own, in the order turn, role, text (nulls first); a null tree id is a tree of its own.
One formatted conversation is one value, so a path has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import real_id, sort_id, written

END = "</s>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("|"), F.lit("\\p"))


def unescaped(c: Column) -> Column:
    plain = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def thread_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (tree, id, parent, score, role, text) of linear conversations: each turn replies to the one before."""
    named = rows.select(sort_id(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    placed = named.withColumn("id", F.row_number().over(order).cast("long"))
    return placed.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, id, place) of the `top` best root-to-leaf paths of each tree; place counts from 0 at the root."""
    edges = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = edges.select("tree", F.col("id").alias("parent"))
    rooted = edges.join(known.withColumn("there", F.lit(True)), ["tree", "parent"], "left")
    reach = written(rooted.select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("steps")), "reply-jumps")
    at_root, jumps = reach.where("up is null"), []
    below, n_below = reach.where("up is not null"), reach.where("up is not null").count()
    while n_below:
        jumps.append(below)
        above = at_root.unionByName(below).select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("steps").alias("steps2"))
        reach = written(below.join(above, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("steps") + F.col("steps2")).alias("steps")), "reply-jumps")
        # one table again: a union that grew with every round would make each plan larger than the one before
        at_root, below = written(at_root.unionByName(reach.where("up is null")), "reply-roots"), reach.where("up is not null")
        still = below.count()
        if still == n_below:  # only messages on or below a cycle are left
            break
        n_below = still
    parents = rooted.where("there").select("tree", F.col("parent").alias("id")).distinct()
    leaves = at_root.join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("steps"), "id")
    paths = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("tree", F.col("id").alias("leaf"), "id", (F.col("steps") - 1).alias("place"))
    for level, jump in enumerate(jumps):
        paths = paths.union(paths.join(jump.select("tree", "id", "up"), ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), F.col("place") - 2**level))
        if level % 2:
            paths = written(paths, "reply-paths")
    return paths


def formatted(messages: DataFrame, top: int = 1, learn_role: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, mask): one conversation for each chosen path; mask lists start and length, in code points, of learn_role's texts."""
    turn = chosen_paths(messages, top).join(messages.select("tree", "id", "role", "text"), ["tree", "id"])
    head = F.concat(F.lit("<|"), escaped(F.coalesce("role", F.lit(""))), F.lit("|>"))
    cut = turn.select("tree", "leaf", "place", "role", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    piece = cut.withColumn("piece", F.concat("head", "body", F.lit(END)))
    so_far = Window.partitionBy("tree", "leaf").orderBy("place")
    start = F.sum(F.length("piece")).over(so_far) - F.length("piece") + F.length("head")
    spans = piece.withColumn("span", F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    return spans.groupBy("tree", "leaf").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == learn_role, F.col("span")))).alias("mask"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """(tree, leaf, turns, loss_text, formatted): roles and texts parsed from the formatted value, and the text under its mask."""
    pieces = F.split("formatted", END, -1)
    fields = lambda p: F.split(p, r"\|>", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(unescaped(F.substring(fields(p)[0], 3, 2**31 - 1)).alias("role"), unescaped(fields(p)[1]).alias("text")))
    under = F.transform("mask", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return conversations.select("tree", "leaf", turns.alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted")


def digests(conversations: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(conversations).select(
        real_id("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 8 + length(regexp_replace(role || text, '[^\\\\<|]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
