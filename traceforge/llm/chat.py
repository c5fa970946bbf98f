"""Chat formatting from reply trees.

Messages name the message they reply to. Iterative self-joins double the known ancestors of every message
(1, 2, 4, ... steps up), so a path of n messages takes log2(n) joins; the same tables give each leaf the
score of its whole root-to-leaf path. Leaves are ranked by score within a conversation, and the messages of
the chosen paths are found by walking the doubled tables back down. Each chosen path is formatted as one
conversation, with a loss mask over the assistant's texts.

The template marks turns with ``<|im_start|>role`` and ``<|im_end|>``. Control strings inside a text (of
this and of other common templates) are broken up by a backslash, and backslashes are doubled, so that
formatting is reversible and no text can open or close a turn.

Cases: null text and null role are empty strings; a null conversation id is one conversation; rows with
equal turns are all kept, in the order of role and text; a reply to an unknown message begins a path; messages
whose replies run in a circle, or lead into one, are each a path of one message; control strings and backslashes come back as they
were; a conversation of any number of turns is formatted whole, as one row; an empty table gives an empty
result; columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.llm.shared import stored, worked

# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|end_of_text|>", "<bos>", "<eos>", "<pad>", "<unk>", "<start_of_turn>", "<end_of_turn>"]
START, END = CONTROL[:2]
ESCAPE = "(" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL) + r"|\\)"
UNESCAPE = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    """A backslash after the first character of each control string, and each backslash doubled."""
    return F.regexp_replace(text, ESCAPE, r"$1\\")


def unescaped(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[1], text)


def with_parents(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Linear conversations as trees: each row replies to the row before it by turn."""
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn"), F.col("role"), F.col("text")))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("node", rank.cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def chosen_paths(tree: DataFrame, top: int = 1) -> DataFrame:
    """Messages of the ``top`` best root-to-leaf paths of every conversation.

    ``tree`` has ``conv, node, parent, score``; the result has ``conv, branch, depth, node``, branch 1 the best.
    A path's score is the mean score of its messages; ties go to the longer path, then to the smaller leaf.
    """
    level = stored(tree.select("conv", "node", F.col("parent").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("n")), "paths")
    done, tables = level.where("up is null"), []
    active = level.where("up is not null")
    rounds = level.count().bit_length() + 1  # by then every path that ends has met its root
    while active.limit(1).count():
        if len(tables) == rounds:
            endless = active.select(F.col("conv").alias("c2"), F.col("node").alias("n2")).distinct()
            cut = tree.join(endless, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")), "left")
            return chosen_paths(stored(cut.withColumn("parent", F.when(F.col("n2").isNull(), F.col("parent"))).drop("c2", "n2"), "tree"), top)
        tables.append(active.select("conv", "node", "up"))
        # a message that has met its root is done; only the others look further up
        above = done.unionByName(active).select(F.col("conv").alias("c2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("n").alias("m2"))
        met = active.join(above, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("n2")), "left")
        level = stored(met.select("conv", "node", F.col("up2").alias("up"), (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum"), (F.col("n") + F.coalesce("m2", F.lit(0))).alias("n")), "paths")
        done, active = done.unionByName(level.where("up is null")), level.where("up is not null")
    level = done
    parents = tree.where("parent is not null").select(F.col("conv").alias("c2"), F.col("parent").alias("n2")).distinct()
    leaves = level.join(parents, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")), "left_anti")
    order = Window.partitionBy("conv").orderBy((F.col("sum") / F.col("n")).desc(), F.col("n").desc(), F.col("node"))
    best = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top)
    on = best.select("conv", "branch", F.col("n").alias("depth"), "node")
    for k in reversed(range(len(tables))):
        up = tables[k].where("up is not null").select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "up")
        more = on.join(up, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")))
        on = stored(on.unionByName(more.select("conv", "branch", (F.col("depth") - F.lit(2**k)).alias("depth"), F.col("up").alias("node"))), "paths")
    return on


def formatted(tree: DataFrame, top: int = 1) -> DataFrame:
    """``conv, branch, formatted, mask``: one conversation per chosen path, ``mask`` the trained spans as
    (start, end) code points, from running lengths along the path."""
    paths = chosen_paths(tree, top)
    words = tree.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "role", "text")
    rows = paths.join(words, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")))
    role = F.regexp_replace(escaped(F.col("role")), "\n", "\\\\\n")
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escaped(F.col("text"))
    turn = rows.select("conv", "branch", "depth", (F.col("role") == "assistant").alias("train"), F.concat(head, body, F.lit(f"{END}\n")).alias("s"), F.char_length(head).alias("from"), F.char_length(body).alias("long"))
    before = Window.partitionBy("conv", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.char_length("s")).over(before), F.lit(0)) + F.col("from")).cast("int")
    span = F.struct(F.col("start"), (F.col("start") + F.col("long")).alias("end"))
    placed = turn.withColumn("start", start).select("conv", "branch", F.struct("depth", "s", "train", span.alias("span")).alias("p"))
    turns = placed.groupBy("conv", "branch").agg(F.array_sort(F.collect_list("p")).alias("p"))
    mask = F.transform(F.filter("p", lambda x: x["train"]), lambda x: x["span"])
    return turns.select("conv", "branch", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), mask.alias("mask"))


TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("an unfinished turn")
    return turns


def read_back(done: DataFrame) -> DataFrame:
    """What the formatted conversations say, read from them alone."""

    def work(texts: list, masks: list) -> tuple[list, ...]:
        rows = []
        for text, mask in zip(texts, masks):
            turns = parse(text)
            seen = hashlib.sha256()
            for role, body in turns:
                seen.update(f"{role}\n{body}\n".encode())
            loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in mask)
            rows.append((len(turns), seen.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        return tuple(map(list, zip(*rows))) or ([],) * 5

    added = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}
    return worked(done.select("conv", "formatted", "mask"), ["formatted", "mask"], added, lambda: work)
