"""Conversations from reply trees: paths by self-joins, ranked, formatted and read back.

A message names the message it replies to. Iterative self-joins double, for every
message at once, how far up its line of replies it sees: after k joins it knows the
message 2^k above, what the scores between add up to and, near the top, its root. So a
line of n replies takes log2(n) joins of rows of a few numbers. Every message without a
reply ends one root-to-leaf path; the paths of a tree are ranked by their mean score, and
the chosen ones are spread out into their messages by the same tables of jumps, each
message of a path met once. Only then do the texts join.

A path is written as one conversation in parts of ``PART_TURNS`` turns, so no row holds a
path of unbounded length. A turn reads

    ### role:
    text
    </turn>

and a backslash is put before every ``###`` and ``</turn>`` of a text, with the
backslashes that stand before it. Taking one away again gives the text, whatever it
holds: a text ends at the first ``</turn>`` that follows a line break. In a role, which is
one line, line breaks and per cent signs are written as %0A and %25. ``loss`` lists the spans, in code
points of the part, of the texts that the model learns from.

Shuffled are numbers of messages, then every text of a chosen path, twice, to its part,
and every part to the task that reads it back. A message with a third of all replies is one key of
the joins that look upwards; it is one row on the one side, and Spark splits the other.
Ranks come from one sort of all paths, so a tree with a third of all paths is many tasks.
The digest of a conversation is read in order by one task that holds a batch of parts at a
time, since SHA-256 has no other way.

Defined cases: NULL text and NULL role count as empty, a NULL score as 0; a message whose
parent does not exist, or which replies to itself, is a root; replies in a circle begin at
the circle's smallest message; rows with one message number are one message, with the
least parent and score and the least tree, role and text, NULL first; rows without a
number belong to no path; a message of a path without a text is left out of its
conversation; paths of equal score rank by their last message; an empty table gives an
empty result. ``chained`` orders rows with one turn by role, then a hash of the text, NULL
turns last, and takes the rows without ``conv_id`` for a conversation of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import numbered, spread, stored, text_of

OPEN, CLOSE, LEARNT_ROLE = "###", "</turn>", "assistant"
PART_TURNS = 256
_CONTROL = rf"(\\*(?:{OPEN}|{CLOSE}))"
_TURN_END = f"\n{CLOSE}\n"

_DIGESTS = (
    "tree long, path long, n_turns long, turns_sha256 string, loss_chars long, "
    "loss_sha256 string, formatted_chars long"
)


def chained(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, turn, role, text) as messages that each reply to the one before.

    Returns replies (message, parent, score), the score being 0, and texts (tree, message,
    role, text).
    """
    rows = conversations.select(
        F.monotonically_increasing_id().alias("message"),
        F.col("conv_id").alias("tree"),
        "turn",
        text_of("role").alias("role"),
        text_of().alias("text"),
    )
    kept = stored(rows, "chat-rows")
    keys = kept.select("message", "tree", "turn", "role", F.xxhash64("text").alias("hash"))
    order = [F.col(c).asc_nulls_last() for c in ("tree", "turn", "role", "hash", "message")]
    placed = stored(numbered(keys, order, "place", "chat-order").select("message", "tree", "place"), "chat-places")
    before = placed.select(
        F.col("message").alias("parent"), F.col("tree").alias("above"), (F.col("place") + 1).alias("place")
    )
    same = F.col("above").eqNullSafe(F.col("tree"))
    replies = placed.join(before, "place", "left").select(
        "message", F.when(same, F.col("parent")).alias("parent"), F.lit(0.0).alias("score")
    )
    return replies, kept.select("tree", "message", "role", "text")


def _lifted(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of jumps (node, up) over 1, 2, 4 … messages, and every node's line upwards.

    ``nodes`` is (node, parent, score). The second frame is (node, up, steps, total,
    least, ended): from a node, ``steps`` replies up lies ``up``, a root once ``ended``;
    ``total`` and ``least`` cover the nodes passed, without ``up``.
    """
    now = stored(
        nodes.select(
            "node",
            F.coalesce("parent", "node").alias("up"),
            F.col("parent").isNotNull().cast("long").alias("steps"),
            F.when(F.col("parent").isNull(), 0.0).otherwise(F.col("score")).alias("total"),
            F.col("node").alias("least"),
            F.col("parent").isNull().alias("ended"),
        ),
        "chat-lines",
    )
    count, jumps, reach = now.count(), [], 1
    while reach <= max(count, 1) and not now.filter("not ended").isEmpty():
        jumps.append(now.filter(F.col("steps") == reach).select("node", "up"))
        above = now.select(*[F.col(c).alias(f"__{c}") for c in now.columns])
        open_ = now.filter("not ended").join(above, F.col("up") == F.col("__node"))
        moved = open_.select(
            "node",
            F.col("__up").alias("up"),
            (F.col("steps") + F.col("__steps")).alias("steps"),
            (F.col("total") + F.col("__total")).alias("total"),
            F.least("least", "__least").alias("least"),
            F.col("__ended").alias("ended"),
        )
        now = stored(now.filter("ended").unionByName(moved), "chat-lines")
        reach *= 2
    return jumps, now


def reply_paths(replies: DataFrame, best: int | None = None) -> DataFrame:
    """(root, path, rank, score, position, message): root-to-leaf paths of all trees.

    ``replies`` is (message, parent, score). ``path`` is the number of a path's last
    message, ``score`` the mean over its messages; ``best`` paths of a tree are kept,
    all without it. ``position`` counts from 0 at the root.
    """
    nodes = stored(
        replies.filter("message is not null")
        .groupBy(F.col("message").alias("node"))
        .agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m"))
        .select("node", "m.parent", "m.score"),
        "chat-nodes",
    )
    known = nodes.select(F.col("node").alias("parent"))
    found = nodes.filter("parent != node").join(known, "parent", "left_semi")
    rooted = nodes.drop("parent").join(found.select("node", "parent"), "node", "left")
    nodes = stored(rooted.select("node", "parent", "score"), "chat-replies")
    jumps, lines = _lifted(nodes)
    circles = lines.filter("not ended")
    if not circles.isEmpty():
        # After more steps than there are messages every line stands inside its circle,
        # and a line that starts there has passed all of it.
        inside = circles.select(F.col("up").alias("node")).distinct()
        begins = circles.join(inside, "node").select(F.col("least").alias("node")).distinct()
        cut = nodes.join(begins.withColumn("__cut", F.lit(True)), "node", "left")
        nodes = stored(
            cut.select("node", F.when(F.col("__cut").isNull(), F.col("parent")).alias("parent"), "score"),
            "chat-replies",
        )
        jumps, lines = _lifted(nodes)
    answered = nodes.select(F.col("parent").alias("node")).distinct()
    leaves = lines.join(answered, "node", "left_anti")
    top = nodes.select(F.col("node").alias("up"), F.col("score").alias("__score"))
    scored = leaves.join(top, "up").select(
        F.col("up").alias("root"),
        F.col("node").alias("path"),
        "steps",
        ((F.col("total") + F.col("__score")) / (F.col("steps") + 1)).alias("score"),
    )
    order = [F.col("root"), F.col("score").desc(), F.col("path")]
    placed = stored(numbered(scored, order, "__place", "chat-paths"), "chat-ranks")
    first = placed.groupBy("root").agg(F.min("__place").alias("__first"))
    ranked = placed.join(first, "root").withColumn(
        "rank", F.col("__place") - F.col("__first") + 1
    )
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    met = ranked.select(
        "root", "path", "rank", "score", F.col("steps").alias("position"), F.col("path").alias("node")
    )
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].select("node", F.col("up").alias("__up"))
        here = F.struct("position", "node")
        there = F.struct((F.col("position") - (1 << k)).alias("position"), F.col("__up").alias("node"))
        places = F.when(F.col("__up").isNull(), F.array(here)).otherwise(F.array(here, there))
        met = met.join(up, "node", "left").select(
            "root", "path", "rank", "score", F.inline(places)
        )
    return met.withColumnRenamed("node", "message")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\{_CONTROL}", "$1")


def _role_line(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_of(line: Column) -> Column:
    return F.replace(F.replace(line, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(paths: DataFrame, texts: DataFrame, learnt: str = LEARNT_ROLE) -> DataFrame:
    """Paths as conversations, one row a part.

    Columns tree, path, rank, score, part, n_turns, formatted, loss. ``texts`` is (tree,
    message, role, text), and a part's tree is that of its last message; ``loss`` is an
    array of (start, end) of the texts whose role is ``learnt``.
    """
    texts = texts.select("tree", "message", text_of("role").alias("role"), text_of().alias("text"))
    if not texts.groupBy("message").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        least = F.min(F.struct("tree", "role", "text")).alias("m")
        texts = texts.groupBy("message").agg(least).select("m.tree", "message", "m.role", "m.text")
    head = F.concat(F.lit(f"{OPEN} "), _role_line(F.col("role")), F.lit(":\n"))
    body = escaped(F.col("text"))
    turns = paths.join(texts, "message").select(
        "path",
        "rank",
        "score",
        F.floor(F.col("position") / PART_TURNS).alias("part"),
        F.struct(
            "position",
            "tree",
            F.length(head).alias("head"),
            F.length(body).alias("body"),
            (F.col("role") == learnt).alias("learnt"),
            F.concat(head, body, F.lit(_TURN_END)).alias("turn"),
        ).alias("turn"),
    )
    parts = turns.groupBy("path", "rank", "score", "part").agg(
        F.sort_array(F.collect_list("turn")).alias("turns")
    )
    no_spans = F.array().cast("array<struct<start:long,end:long>>")

    def step(seen: Column, turn: Column) -> Column:
        start = seen["at"] + turn["head"]
        end = start + turn["body"]
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(_TURN_END)).alias("at"),
            F.when(turn["learnt"], F.concat(seen["loss"], span)).otherwise(seen["loss"]).alias("loss"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), no_spans.alias("loss"))
    return parts.select(
        F.element_at("turns", -1)["tree"].alias("tree"),
        "path",
        "rank",
        "score",
        "part",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.aggregate("turns", begin, step)["loss"].alias("loss"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Turns and learnt texts of formatted parts, from ``formatted`` and ``loss`` alone.

    Adds ``turns``, an array of (role, text), and ``learnt``, the texts under the mask.
    """
    whole = F.split("formatted", f"\\n{CLOSE}\\n", -1)
    turns = F.transform(
        F.slice(whole, 1, F.size(whole) - 1),
        lambda turn: F.struct(
            _role_of(F.regexp_extract(turn, rf"\A{OPEN} ([^\n]*):\n", 1)).alias("role"),
            unescaped(F.regexp_replace(turn, r"\A[^\n]*\n", "")).alias("text"),
        ),
    )
    under = F.transform(
        "loss",
        lambda span: unescaped(
            F.substring("formatted", span["start"].cast("int") + 1, (span["end"] - span["start"]).cast("int"))
        ),
    )
    return conversations.withColumns({"turns": turns, "learnt": under})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose parts come in order, a part at a time."""
    names = [f.split()[0] for f in _DIGESTS.split(", ")]
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
    schema = pa.schema(list(zip(names, kinds)))
    current, done = None, []

    def close() -> None:
        tree, path, turns, chars, length, all_turns, all_learnt = current
        done.append((tree, path, turns, all_turns.hexdigest(), chars, all_learnt.hexdigest(), length))

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(c), k) for c, k in zip(zip(*done), kinds)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        columns = [batch.column(c) for c in ("tree", "path", "turns_text", "learnt_text", "n_turns", "chars")]
        for i in range(batch.num_rows):
            tree, path, turns, learnt, n, length = (c[i].as_py() for c in columns)
            if current is None or current[1] != path:
                if current is not None:
                    close()
                current = [tree, path, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
            current[2] += n
            current[3] += len(learnt)
            current[4] += length
            current[5].update(turns.encode())
            current[6].update(learnt.encode())
        if done:
            yield out()
    if current is not None:
        close()
        yield out()


def digests(conversations: DataFrame) -> DataFrame:
    """One row a conversation: its turns and its learnt text, read back, as digests.

    (tree, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    """
    session = conversations.sparkSession
    dealt = spread(conversations, session, F.col("path")).sortWithinPartitions("path", "part")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        read_back(dealt)
        .select(
            "tree",
            "path",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(line, "").alias("turns_text"),
            F.array_join("learnt", "").alias("learnt_text"),
            F.length("formatted").cast("long").alias("chars"),
        )
        .mapInArrow(_digest, _DIGESTS)
    )


def write_conversations(
    paths: DataFrame, texts: DataFrame, folder: str, learnt: str = LEARNT_ROLE
) -> DataFrame:
    """Formats the paths, writes them as Parquet and returns them as read again."""
    made = formatted(paths, texts, learnt)
    made.write.parquet(folder)
    return made.sparkSession.read.schema(made.schema).parquet(folder)
