"""Chat formatting with a prefix tree of turns.

A turn is written as [INST] text [/INST] for a user, <<SYS>> text <</SYS>> for a system message, text </s> for an assistant,
and <<ROLE name>> text <</ROLE>> for any other role. Control strings inside texts and role names are escaped reversibly: every
"<", "[" and "\\" of a text gets a backslash before it, so no marker can arise from a text.

Conversations that begin with the same turns share the nodes of these turns. A node is named by a chain of SHA-256 over its
turns, so equal beginnings meet on equal names without comparing conversations. Each node is written once, depth-first:
conversations are put in the order of their paths of names, and a node lies with the first that goes through it. A node has position ids that go on from
its parent's, and may attend to the intervals of its ancestors and its own. A token is one code point of the formatted text.

Rows of a conversation go by turn; ties and null turns by role and text, nulls first. Null texts and roles are empty. Repeated rows are turns of their own. Rows
without a conversation id are one conversation, whose id is null; an empty table gives no nodes. Columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import map_batches, stored

# The marks of the template, before and behind a text.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<<ROLE {}>> ", " <</ROLE>>")
#: Binary order of the paths that one window of a depth-first place is summed over.
STRETCH = 8


def escape(text: str) -> str:
    return re.sub(r"([\\<\[>])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and the range in it that a loss counts: an assistant's escaped text."""
    before, behind = MARKS.get(role) or (OTHER[0].format(escape(role)), OTHER[1])
    inner = escape(text)
    return before + inner + behind, len(before), len(before) + len(inner) if role == "assistant" else len(before)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text back from a formatted turn."""
    for role, (before, behind) in MARKS.items():
        if before and formatted.startswith(before):
            return role, unescape(formatted[len(before) : len(formatted) - len(behind)])
    if formatted.startswith("<<ROLE "):
        end = re.match(r"<<ROLE ((?:\\.|[^\\>])*)>> ", formatted, re.S)
        return unescape(end[1]), unescape(formatted[end.end() : len(formatted) - len(OTHER[1])])
    return "assistant", unescape(formatted[: len(formatted) - len(MARKS["assistant"][1])])


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # One task goes through a conversation turn by turn, in batches, holding its last name only.
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    conversation, step, name, before = None, 0, b"", 0
    for batch in batches:
        out = []
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv_id != conversation:
                conversation, step, name, before = conv_id, 0, b"", 0
            formatted, a, b = format_turn(role, text)
            parent, name = name, hashlib.sha256(name + hashlib.sha256(formatted.encode()).digest()).digest()
            out.append((conv_id, step, parent, name, formatted, a, b, before))
            step, before = step + 1, before + len(formatted)
        columns = list(zip(*out)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "step", "parent", "node", "formatted", "loss_from", "loss_to", "position"])


def build_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths), both stored.

    nodes: node, parent, depth, formatted, n_tokens, loss_from, loss_to, position (position id of its first token), place (offset
    of its first token in the depth-first sequence of all trees). paths: conv_id, step, node. The tokens of a node attend to
    [place, place + n_tokens) of its ancestors, and causally to its own: see attention().
    """
    schema = "conv_id long, step long, parent binary, node binary, formatted string, loss_from long, loss_to long, position long"
    rows = stored(map_batches(_turns(conversations), _named, schema), "turns")
    paths = rows.select("conv_id", "step", "node")
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "formatted", "loss_from", "loss_to", "position")], F.min("step").alias("depth"))
    # Depth-first: conversations in the order of their paths of names, each node with the first that goes through it.
    names = F.sort_array(F.collect_list(F.struct("step", F.hex(F.substring("node", 1, 8)).alias("h"))))
    ends = stored(paths.groupBy("conv_id").agg(F.max_by("node", "step").alias("end"), F.array_join(F.transform(names, lambda x: x["h"]), "").alias("key")), "chat-paths")
    # Conversations with one end have one path; a number is the range a path lies in, then its place there.
    ranks = stored(ends.groupBy("end").agg(F.first("key").alias("key")).orderBy("key").select("end", F.monotonically_increasing_id().alias("rank")), "chat-ranks")
    ranked = ends.select(F.col("conv_id").alias("of"), "end").join(ranks, "end")
    firsts = paths.join(ranked, F.col("conv_id").eqNullSafe(F.col("of"))).groupBy("node").agg(F.min("rank").alias("rank"))
    nodes = stored(nodes.withColumn("n_tokens", F.char_length("formatted").cast("long")).join(firsts, "node"), "tree-nodes")
    # The running sum of lengths in that order, in three levels: ranges of paths, stretches of at most 1 << STRETCH paths of a range, and
    # the nodes of each of those.
    before = Window.unboundedPreceding, -1
    sliced = nodes.withColumns({"wide": F.shiftright("rank", 33), "fine": F.shiftright("rank", STRETCH)})
    fine = sliced.groupBy("wide", "fine").agg(F.sum("n_tokens").alias("total"))
    wide = fine.groupBy("wide").agg(F.sum("total").alias("total"))
    wide = wide.select("wide", F.coalesce(F.sum("total").over(Window.orderBy("wide").rowsBetween(*before)), F.lit(0)).alias("wide_base"))
    fine = fine.select("wide", "fine", F.coalesce(F.sum("total").over(Window.partitionBy("wide").orderBy("fine").rowsBetween(*before)), F.lit(0)).alias("fine_base"))
    base = fine.join(wide, "wide").select("fine", (F.col("wide_base") + F.col("fine_base")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("fine").orderBy("rank", "depth").rowsBetween(*before))
    placed = sliced.join(base, "fine").withColumn("place", (F.col("base") + F.coalesce(inside, F.lit(0))).cast("long"))
    return stored(placed.drop("wide", "fine", "base", "rank"), "tree"), paths


def attention(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, step, node, intervals: the stretches of the depth-first sequence that the turn's tokens attend to, own stretch last."""
    spans = paths.join(nodes.select("node", "place", "n_tokens"), "node").select("conv_id", "step", "node", F.struct(F.col("place").alias("from"), (F.col("place") + F.col("n_tokens")).alias("to")).alias("span"))
    order = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return spans.select("conv_id", "step", "node", F.collect_list("span").over(order).alias("intervals"))


_SPAN = pa.struct([("from", pa.int64()), ("to", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "positions", "spans"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(_SPAN))

    def closed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds)], names)

    current, out = None, []
    for batch in batches:
        for conv_id, formatted, a, b, position, place in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to", "position", "place"))):
            if current is None or conv_id != current[0]:
                if current:
                    out.append((current[0], current[1], current[2].hexdigest(), current[3], current[4].hexdigest(), *current[5:]))
                current = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, [], []]
            role, text = parse_turn(formatted)
            loss = unescape(formatted[a:b])
            current[1] += 1
            current[2].update(f"{role}\n{text}\n".encode())
            current[3] += len(loss)
            current[4].update(loss.encode())
            current[5] += len(formatted)
            current[6].append(position)
            current[7].append({"from": place, "to": place + len(formatted)})
        yield closed(out)
        out = []
    if current:
        yield closed([(current[0], current[1], current[2].hexdigest(), current[3], current[4].hexdigest(), *current[5:])])


def read_turns(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Every conversation read from the tree: its path's nodes in order, parsed and unescaped, as digests.

    positions and spans go by turn: the position id of its first token, and where its tokens lie in the depth-first sequence. A turn
    attends to its own span, causally, and to those of the turns before it, as in attention().
    """
    parts = ["formatted", "loss_from", "loss_to", "position", "place"]
    rows = paths.join(nodes.select("node", *parts), "node").repartition("conv_id").sortWithinPartitions("conv_id", "step")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, positions array<long>, spans array<struct<from: long, to: long>>"
    return map_batches(rows.select("conv_id", *parts), _read_back, schema)


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The digests of every conversation read from the tree."""
    return read_turns(nodes, paths).drop("positions", "spans")
