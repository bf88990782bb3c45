"""Chat formatting: root-to-leaf paths of reply trees, ranked, each formatted as one conversation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_stash, stash

#: Control strings of the template. A text holds none of them: escape() leaves no "<" in it.
OPEN, HEAD, CLOSE = "<|", "|>\n", "<|end|>\n"


def escape(text):
    """Reversible: "&" becomes "&amp;", then "<" becomes "&lt;"."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text):
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role):
    """As escape(), and "|" becomes "&bar;", so that the header's end can't stand in a role."""
    return F.replace(escape(role), F.lit("|"), F.lit("&bar;"))


def unescape_role(role):
    return unescape(F.replace(role, F.lit("&bar;"), F.lit("|")))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths: rows (leaf, node, up), up counting the steps from the leaf.

    nodes: (node, parent), node unique, both strings. A node whose parent is null or no node is a root. Nodes that never
    reach a root (cycles and what hangs on them) are in no path.

    Self-joins, doubled: round k joins each node's ancestor 2^k steps up with that ancestor's own, so a path of n nodes
    takes log2(n) rounds of joins. Every round's table is written to the shared folder, so no plan grows with the depth.
    """
    spark = nodes.sparkSession
    ids = nodes.select(F.col("node").alias("__id"))
    first = nodes.join(ids, F.col("parent") == F.col("__id"), "inner").select("node", F.col("parent").alias("anc"))
    (nodes, base), (jump, path) = stash(nodes.select("node", "parent"), "nodes"), stash(first, "jump")
    most = math.ceil(math.log2(max(2, nodes.count()))) + 1
    jumps, old = [(jump, path)], [base]
    while len(jumps) <= most:
        up = jump.select(F.col("node").alias("anc"), F.col("anc").alias("__far"))
        jump, path = stash(jump.join(up, "anc").select("node", F.col("__far").alias("anc")), "jump")
        if jump.isEmpty():
            old.append(path)
            break
        jumps.append((jump, path))
    inner = first.select(F.col("anc").alias("node")).distinct()
    leaves = nodes.join(inner, "node", "left_anti")
    if len(jumps) > most:  # an ancestor further up than there are nodes: a cycle
        leaves = leaves.join(jumps[-1][0].select("node"), "node", "left_anti")
    paths, path = stash(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    old.append(path)
    for k, (jump, _) in enumerate(jumps):
        further = paths.join(jump, "node").select("leaf", F.col("anc").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths, path = stash(paths.unionByName(further), "paths")
        old.append(path)
    for where in [*old[:-1], *(p for _, p in jumps)]:
        drop_stash(spark, where)
    return paths


def chat_format(messages: DataFrame, top_k: int = 1) -> DataFrame:
    r"""Format the best branches of every reply tree.

    messages: conv_id, node (string, unique), parent (string, null at the root), role, text, score (double, of a leaf's
    branch). Returns per chosen branch: conv_id, leaf, branch (1: best), formatted, spans: array of (start, length, loss)
    of every turn's escaped text in `formatted`, in order and 0-based, loss marking the assistant's.

    Each turn is "<|role|>\n" + text + "<|end|>\n", with texts and roles escaped reversibly. Branches of a conversation
    rank by their leaf's score, ties by leaf; the `top_k` best stay (top-k is the feature; None keeps all).

    Defined results: null text or role is the empty string; null scores rank last; null conv_ids form one conversation;
    of rows that repeat a node the one stays that is least by conv_id, parent, role, text and score, nulls first; rows
    without a node are left out; an empty table gives no row; columns besides those named are ignored.
    """
    messages = messages.select("conv_id", F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"))
    same = F.min(F.struct(*[x for c in ("conv_id", "parent", "role", "text", "score") for x in (F.col(c).isNotNull().alias(f"has_{c}"), F.col(c).alias(c))])).alias("m")
    messages = messages.where(F.col("node").isNotNull()).groupBy("node").agg(same).select("m.conv_id", "node", "m.parent", "m.role", "m.text", "m.score")
    paths = tree_paths(messages.select("node", "parent"))
    best = paths.where(F.col("up") == 0).select("leaf").join(messages.select(F.col("node").alias("leaf"), "conv_id", "score"), "leaf")
    order = Window.partitionBy("conv_id").orderBy(F.col("score").desc_nulls_last(), F.col("leaf"))
    best = best.withColumn("branch", F.row_number().over(order))
    if top_k is not None:
        best = best.where(F.col("branch") <= top_k)
    turns = paths.join(best.select("leaf", "branch"), "leaf").join(messages.select("node", "conv_id", "role", "text"), "node")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(HEAD))
    turns = turns.select("conv_id", "leaf", "branch", "up", (F.lower(F.btrim("role")) == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    upto = Window.partitionBy("leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(upto)
    turns = turns.withColumn("start", whole - len(CLOSE) - F.length("body"))
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("said"), F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"), "loss").alias("span"))
    done = turns.groupBy("leaf").agg(F.first("conv_id").alias("conv_id"), F.first("branch").alias("branch"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return done.select("conv_id", "leaf", "branch", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """Parse `formatted` and its loss mask: adds turns (role, text) and loss_text, the unescaped text under the mask."""
    said = F.split("formatted", r"<\|end\|>\n", -1)
    chats = chats.withColumn("__said", F.slice(said, 1, F.size(said) - 1))
    body = lambda s: F.substring(s, F.length(F.substring_index(s, HEAD, 1)) + 1 + len(HEAD), F.length(s))
    turns = F.transform("__said", lambda s: F.struct(unescape_role(F.substr(F.substring_index(s, HEAD, 1), F.lit(len(OPEN) + 1))).alias("role"), unescape(body(s)).alias("text")))
    # a span lies in its own turn; that turn begins where the one before and its end mark end
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["start"] + F.get("spans", i - 1)["length"] + len(CLOSE))
    masked = F.transform("spans", lambda p, i: F.when(p["loss"], F.substr(F.get("__said", i), (p["start"] - begin(i) + 1).cast("int"), p["length"].cast("int"))))
    return chats.withColumn("turns", turns).withColumn("loss_text", unescape(F.array_join(masked, ""))).drop("__said")


def op9_chat_format(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = given.unionByName(own)
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    rows = rows.withColumn("at", at).select("conv_id", F.concat_ws("#", name, "at").alias("node"), F.when(F.col("at") > 1, F.concat_ws("#", name, F.col("at") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    out = read_back(chat_format(rows))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
WITH m AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS body,
         replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;') AS head FROM m
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 5 + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
