r"""Chat formatting: reply trees, their root-to-leaf paths, and one formatted conversation for each chosen path.

``reply_paths`` finds the paths by iterative self-joins that double the distance jumped in each round, so a thread of
d messages takes about log2(d) joins. Branches of a tree are ranked by mean message score. Only DataFrame functions.

The template is ``<|turn|>role<|text|>text<|end|>`` and a line feed per turn. In roles and texts a backslash is doubled,
and one is put after the first character of every control string (ours and those of common templates); dropping
each backslash that stands before a character gives the text back.

Defined cases: null text or role is empty; a null tree id is a tree of its own; a null or unknown parent, or one that
does not come before its reply, makes a root (so there are no cycles); repeated rows of one turn follow each other
in the order of role and text; a conversation becomes one row, so its turns are ordered in one task; ties between branches go to the smaller leaf; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.arrays import running_sums

from .common import materialise

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: The first characters of control strings, and what makes them one.
CONTROL = r"(<)(?=\||/?s>|/?unk>|/?pad>|<SYS>>|</SYS>>)|(\[)(?=/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$2\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, top: int | None = 1, max_rounds: int = 32) -> DataFrame:
    """Paths of ``messages(tree_id, msg_id long, parent_id long, score)`` as rows (path, tree_id, msg_id, depth, path_score, path_rank).

    ``path`` is the leaf's key; depth counts from 0 at the leaf. ``top`` keeps the best branches of each tree (None: all).
    """
    key = lambda c: F.concat_ws("/", F.coalesce(F.col("tree_id").cast("string"), F.lit("\\N")), F.col(c).cast("string"))
    m = messages.where("msg_id is not null").select("tree_id", "msg_id", key("msg_id").alias("node"), F.when(F.col("parent_id") < F.col("msg_id"), key("parent_id")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    m = materialise(m.join(known, "up", "left").withColumn("up", F.when(F.col("known"), F.col("up"))).drop("known"), "chat-nodes")
    jump = m.where("up is not null").select("node", "up")
    leaves = m.join(m.select(F.col("up").alias("node")), "node", "left_anti")
    paths = leaves.select(F.col("node").alias("path"), "node", F.lit(0).alias("depth"))
    for k in range(max_rounds):
        step = paths.join(jump, "node").select("path", F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        paths = materialise(paths.unionByName(step), "chat-paths")
        jump = materialise(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("over")), "up").select("node", F.col("over").alias("up")), "chat-jump")
        if not jump.limit(1).count():
            break
    full = paths.join(m.select("node", "tree_id", "msg_id", "score"), "node")
    ranked = full.groupBy("path").agg(F.first("tree_id").alias("tree_id"), F.avg("score").alias("path_score"), F.max(F.when(F.col("depth") == 0, F.col("msg_id"))).alias("leaf"))
    ranked = ranked.withColumn("path_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("path_score"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("path_rank") <= top)
    return full.select("path", "msg_id", "depth").join(ranked.select("path", "tree_id", "path_score", "path_rank"), "path")


def format_paths(turns: DataFrame) -> DataFrame:
    """One conversation per path of ``turns(path, tree_id, path_rank, depth, role, text)``: ``formatted`` and ``loss``, its code-point spans of assistant texts."""
    one = turns.select("path", "tree_id", "path_rank", F.struct((-F.col("depth")).alias("at"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text")).alias("turn"))
    rows = one.groupBy("path").agg(F.first("tree_id").alias("tree_id"), F.first("path_rank").alias("path_rank"), F.sort_array(F.collect_list("turn")).alias("turns"))
    around = len(TURN) + len(TEXT)
    starts = running_sums(f"transform(turns, x -> {around + len(END)} + length(x.role) + length(x.text))")
    loss = F.expr(f"""transform(array({starts}), p -> transform(filter(transform(turns, (x, i) -> named_struct('role', x.role, 'start', cast(p[i] as int) + {around} + length(x.role), 'size', length(x.text))),
        y -> y.role = 'assistant'), y -> named_struct('start', y.start, 'end', y.start + y.size)))[0]""")
    text = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(TURN), x["role"], F.lit(TEXT), x["text"], F.lit(END))), "")
    return rows.select("path", "tree_id", "path_rank", text.alias("formatted"), loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, both read from ``formatted`` and ``loss`` alone."""
    parts = F.filter(F.split("formatted", r"\Q<|end|>\E\n"), lambda x: x != "")
    role = lambda x: F.substring_index(F.substring_index(x, TEXT, 1), TURN, -1)
    turns = F.transform(parts, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text")))
    under = F.expr("array_join(transform(loss, s -> regexp_replace(substr(formatted, s.start + 1, s.end - s.start), '(?s)\\\\\\\\(.)', '$1')), '')")
    return chats.withColumn("turns", turns).withColumn("loss_text", under)


def thread_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each row answers the one before it in its conversation."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select(F.col("conv_id").alias("tree_id"), at.alias("msg_id"), (at - 1).alias("parent_id"), F.length(F.coalesce("text", F.lit(""))).alias("score"), "role", "text")


def chat_conversations(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """Format the best ``top`` paths of ``messages(tree_id, msg_id, parent_id, score, role, text)``."""
    m = messages.select("tree_id", "msg_id", "parent_id", "score", "role", "text")
    paths = reply_paths(m, top)
    texts = m.select(F.col("tree_id").alias("t_"), F.col("msg_id").alias("m_"), "role", "text")
    turns = paths.join(texts, F.col("tree_id").eqNullSafe(F.col("t_")) & (F.col("msg_id") == F.col("m_"))).drop("t_", "m_")
    return format_paths(turns)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = read_back(chat_conversations(materialise(thread_messages(rows), "chat-messages")))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = "replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
ORACLE_OP9 = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(TEXT) + len(END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id"""
