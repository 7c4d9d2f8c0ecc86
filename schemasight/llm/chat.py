"""Reply trees as conversations: root-to-leaf paths by self-joins, ranked by score and formatted with reversible escapes.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, numbered, salted_lookup, settle, table

#: What stands around an answer to learn from, and around every other turn.
LEARNT = ("<s>", "</s>")
GIVEN = ("[INST]", "[/INST]")
ASSISTANT = "assistant"
#: Turns that are joined to a text at a time.
BLOCK = 256


def escape(text: Column) -> Column:
    """``text`` without control strings: one more backslash stands behind the first character of what would be one but for
    the backslashes there. So no control string is left, and ``unescape`` gives back every text."""
    return F.regexp_replace(text, r"([<\[])(\\*(?:/?s>|/?INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*(?:/?s>|/?INST\]))", "$1$2")


def escape_role(role: Column) -> Column:
    """A role in one line: per cent signs and line ends are written as %25 and %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def place_in_group(df: DataFrame, group: list[str], order: list[Column], ranges: list[Column], name: str) -> DataFrame:
    """Add ``name``: how many rows of the same group (nulls are equal) come earlier in ``order``; equal rows get different places.

    The table is sorted over ranges (``ranges`` must follow ``order``), written, and each row's place read off the file it stands in and
    the counts of the files before; no group passes through one task.
    """
    row, file, start = (fresh([*df.columns, name], f"_{x}") for x in ("row", "file", "start"))
    by = [F.col(c) for c in group]
    rows = numbered(settle(df.repartitionByRange(*by, *ranges).sortWithinPartitions(*by, *order)), row)
    counts = rows.groupBy(*group, F.col(f"{row}.file").alias(file)).agg(F.count("*").alias("n"), F.min(f"{row}.row").alias("first"))
    earlier = Window.partitionBy(*group).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"{start}_{k}") for k, c in enumerate(group)], file, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias(start))
    same = [F.col(c).eqNullSafe(F.col(f"{start}_{k}")) for k, c in enumerate(group)]
    on = F.col(f"{row}.file") == F.col(file)
    for s in same:
        on = on & s
    return rows.join(starts, on).select(*df.columns, (F.col(start) + F.col(f"{row}.row")).cast("long").alias(name))


def _ancestors(up: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, sums) of ``up`` (uid, up, score, chars, depth: the reply above, null at a root, and what the reply itself adds).

    levels[k] has the ancestor 2 ** k steps up of each reply that has one; sums has the score, chars and depth of the path
    from the root to each reply. A round reads all rows and joins those alone whose path is still open.
    """
    names = ["score", "chars", "depth"]
    now, done, levels = settle(up), [], []
    rows = now.count()
    while not now.where("up is not null").isEmpty():
        if 1 << len(levels) > rows:
            raise ValueError("replies form a cycle")
        done.append(now.where("up is null"))
        levels.append(now.where("up is not null"))
        known = reduce(DataFrame.unionByName, done).unionByName(levels[-1])
        above = known.select(F.col("uid").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in names])
        added = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in names]
        now = settle(salted_lookup(levels[-1], above, "up", "inner").select("uid", F.col("_up").alias("up"), *added))
    return levels, settle(reduce(DataFrame.unionByName, [*done, now]).drop("up"))


def _joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per ``keys``: text and loss of the rows, in ``order``, one after the other."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text", "loss")))
    out = rows.groupBy(*keys).agg(parts.alias("parts"))
    return out.select(*keys, F.array_join(F.col("parts.text"), "").alias("text"), F.flatten("parts.loss").alias("loss"))


def format_branches(
    df: DataFrame,
    tree_col: str,
    node_col: str,
    parent_col: str,
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = None,
    branches: int | None = None,
) -> DataFrame:
    """One row per branch of the reply trees in ``df`` (a row a reply): tree, leaf, branch, score, n_turns, formatted and loss.

    A branch is a path from a root to a leaf, a reply that nothing answers. Branches of a tree are numbered from 1 by the sum of the scores of their
    replies, largest first, then by the leaf's id; of these the first ``branches`` are kept, or all. formatted holds the turns from the root on: those of the
    assistant as ``<s>role\\ntext</s>``, others as ``[INST]role\\ntext[/INST]``, with these strings escaped in roles and texts. loss lists the
    assistant's texts: the turn (from 0) and the code points of formatted, start to end, where it stands, escaped.

    Null texts and roles are empty, null scores 0; null trees are one tree. A reply whose parent is null, itself or not in its tree is a root; a reply
    without an id has no answers. Rows with the same id are replies of their own, and answers hang on the first of them by role and hash of the text;
    equal rows too. Replies that form a cycle are an error. An empty table gives an empty one; other columns are left out. Texts of
    any length are taken whole; a branch is one row, so it must be within what a row can hold.

    Paths come from self-joins with the ancestors 1, 2, 4, ... replies up, so a branch of d turns takes log d rounds; replies with a great many
    answers are dealt to several tasks, and long branches are put together from blocks of turns.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), escape(F.coalesce(F.col(text_col), F.lit("")))
    learns = role == ASSISTANT
    head = F.concat(F.when(learns, LEARNT[0]).otherwise(GIVEN[0]), escape_role(role), F.lit("\n"))
    score = F.lit(0.0) if score_col is None else F.coalesce(F.col(score_col).cast("double"), F.lit(0.0))
    nodes = df.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"), F.col(parent_col).alias("parent"), learns.alias("learns"), head.alias("head"), text.alias("text"), score.alias("score"))
    nodes = nodes.withColumn("said", F.concat("head", "text", F.when(F.col("learns"), LEARNT[1]).otherwise(GIVEN[1])))
    nodes = settle(nodes.withColumn("uid", F.monotonically_increasing_id()))
    ids = nodes.select("uid", "tree", "node", "parent", "score", F.char_length("said").cast("long").alias("chars"), F.struct("head", F.xxhash64("text"), "uid").alias("order"))
    heads = ids.where("node is not null").groupBy("tree", "node").agg(F.min("order").uid.alias("up"))
    heads = heads.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "up")
    placed = ids.join(heads, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_node")) & ~F.col("node").eqNullSafe(F.col("parent")), "left")
    levels, sums = _ancestors(placed.select("uid", "up", "score", "chars", F.lit(1).cast("long").alias("depth")))
    answered = [level.select(F.col("up").alias("uid")).distinct() for level in levels[:1]]
    leaves = reduce(lambda all_, some: all_.join(some, "uid", "left_anti"), answered, sums).join(ids.select("uid", "tree", "node"), "uid")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "score", F.col("depth").alias("n_turns"), F.col("uid").alias("path"))
    best = [F.desc("score"), F.asc("leaf"), F.asc("path")]
    leaves = place_in_group(leaves, ["tree"], best, best, "branch").withColumn("branch", F.col("branch") + 1)
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    leaves = settle(leaves)
    paths = leaves.select("path", F.col("path").alias("uid"))
    for level in reversed(levels):
        paths = settle(paths)
        further = salted_lookup(paths, level.select("uid", "up"), "uid", "inner").select("path", F.col("up").alias("uid"))
        paths = paths.unionByName(further)
    said = nodes.select("uid", "learns", "said", F.char_length("head").alias("before"), F.char_length("text").alias("width"))
    said = said.join(sums.select("uid", "depth", F.col("chars").alias("end")), "uid")
    turns = salted_lookup(settle(paths), said, "uid")
    turn, start = F.col("depth") - 1, F.col("end") - F.char_length("said") + F.col("before")
    span = F.array(F.struct(turn.alias("turn"), start.alias("start"), (start + F.col("width")).alias("end")))
    turns = turns.select("path", turn.alias("turn"), F.floor(turn / BLOCK).alias("block"), F.col("said").alias("text"), F.when(F.col("learns"), span).otherwise(F.slice(span, 1, 0)).alias("loss"))
    whole = _joined(_joined(turns, ["path", "block"], "turn"), ["path"], "block")
    return leaves.join(whole, "path").select("tree", "leaf", "branch", "score", "n_turns", F.col("text").alias("formatted"), "loss")


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation: struct(role, text, escaped)."""
    pieces = F.split(formatted, r"</s>|\[/INST\]", -1)
    body = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.regexp_replace(p, r"^(?:<s>|\[INST\])", ""))
    cut = F.transform(body, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), F.substr(b, F.instr(b, "\n") + 1).alias("escaped")))
    return F.transform(cut, lambda t: F.struct(unescape_role(t.role).alias("role"), unescape(t.escaped).alias("text"), t.escaped.alias("escaped")))


def learnt_texts(turns: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped: the last code points, as many as a span has, of the turn it lies in."""
    return F.transform(loss, lambda s: unescape(F.right(F.get(turns, s.turn.cast("int")).escaped, (s.end - s.start).cast("int"))))


def linear_trees(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Conversations as trees without forks: tree, node, parent, role, text. Turns go in order of their number (null first), then
    of role and text; each answers the one before."""
    turns = df.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col(c) for c in ("turn", "role", "text")]
    out = place_in_group(turns, ["tree"], order, [*order[:2], F.substring("text", 1, 64)], "node")
    return out.select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text")


def op13_chat_trees(spark, sf_dir):
    """All conversations, and one that holds control strings, as branches of reply trees, formatted and read back."""
    hostile = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    trees = linear_trees(given.unionByName(hostile), "conv_id", "turn", "role", "text")
    out = format_branches(trees, "tree", "node", "parent").withColumn("turns", turns_of(F.col("formatted")))
    digest = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    out = out.withColumn("learnt", F.array_join(learnt_texts(F.col("turns"), F.col("loss")), ""))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(lines, "")).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        digest(F.col("learnt")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A') || chr(10) || text, '([<\[]\\*(/?s>|/?INST\]))', '\1_', 'g'))
    + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS width
  FROM turns
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(width) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
