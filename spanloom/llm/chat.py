"""Chat formatting as a prefix tree: turns that conversations share at their beginning are emitted once, depth first,
with position ids and the intervals of the stream that hold a turn's ancestors."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, row_id, stage

BEGIN, TURN, TEXT, END = "<s>", "<|turn|>", "<|text|>", "<|end|>"
#: Strings that mean something to this or to other templates; inside texts they are broken up by a backslash.
CONTROLS = (BEGIN, TURN, TEXT, END, "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(f"(?:{re.escape(BEGIN)})?{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*){re.escape(END)}", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    text = text.replace("\\", "\\\\")
    while _CONTROL.search(text):
        text = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str, first: bool) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends in it."""
    head = (BEGIN if first else "") + TURN + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(written: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(written)
    if m is None:
        raise ValueError("not a segment of this template")
    return unescape(m[1]), unescape(m[2])


def _batch(rows: list, schema: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows)) or [[]] * len(schema), schema)], [n for n, _ in schema])


_TURNS = [("_conv", pa.int64()), ("_k", pa.int32()), ("_node", pa.binary()), ("_parent", pa.binary()), ("_role", pa.string()), ("_text", pa.string()), ("_path", pa.binary())]


def _chain(batches):
    """Rows sorted by conversation and turn: each with its node, a hash of all turns so far; and at a conversation's
    end, with _k -1, the path that sorts conversations depth first."""
    conv, k, node, path = None, 0, b"", bytearray()
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("_conv", "_role", "_text"))):
            if c != conv:
                if conv is not None:
                    out.append((conv, -1, None, None, None, None, bytes(path)))
                conv, k, node, path = c, 0, b"", bytearray()
            parent = node
            node = hashlib.blake2b(b"%b%d:%b%b" % (parent, len(role.encode()), role.encode(), text.encode()), digest_size=16).digest()
            path += node[:8]
            out.append((c, k, node, parent or None, role, text, None))
            k += 1
        for a in range(0, len(out), 2000):
            yield _batch(out[a : a + 2000], _TURNS)
    if conv is not None:
        yield _batch([(conv, -1, None, None, None, None, bytes(path))], _TURNS)


_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTENDS = [("_node", pa.binary()), ("position", pa.int64()), ("attends", pa.list_(_INTERVAL))]


def _attend(batches):
    """Rows sorted by conversation and place: for the nodes that a conversation owns, the tokens before them on the
    path and the intervals that hold those, merged where they touch."""
    conv, position, held = None, 0, []
    for batch in batches:
        out = []
        for c, node, owned, start, length in zip(*(batch.column(x).to_pylist() for x in ("_order", "_node", "_owned", "start", "length"))):
            if c != conv:
                conv, position, held = c, 0, []
            if owned:
                out.append((node, position, [{"start": a, "end": b} for a, b in held]))
            position += length
            if held and held[-1][1] == start:
                held[-1] = (held[-1][0], start + length)
            else:
                held.append((start, start + length))
        yield _batch(out, _ATTENDS)


def _segments(batches):
    kinds = [("_node", pa.binary()), ("written", pa.string()), ("length", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
    for batch in batches:
        out = []
        for node, role, text, k in zip(*(batch.column(x).to_pylist() for x in ("_node", "_role", "_text", "_k"))):
            written, a, b = segment(role, text, k == 0)
            out.append((node, written, len(written), *((a, b) if role == "assistant" else (None, None))))
        yield _batch(out, kinds)


def prefix_tree(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, paths).

    nodes: node (a hash of the turn and all turns before it), parent, depth, written (the turn in the template),
    length, start (its place in the stream), position (position id of its first token: the tokens on the path before
    it), attends (intervals of the stream, [start, end), that hold its ancestors; inside itself a node is
    causal), loss_start and loss_end (the assistant's text within written, else null). Tokens are code points.
    paths: conv_id, k (from 0) and node, one row for each turn.

    Sorted by start, the stream is the forest depth first: conversations are ranked by the path of their nodes, a
    node belongs to the first conversation that has it, and lies there by depth. A turn that a third of all
    conversations begin with is one node, found by an aggregation with a partial step. Conversations stream
    through their tasks turn by turn, so that even one with a third of all rows needs no memory; offsets are sums
    over ranges that are added up by range.

    Turns go by turn (null first), then role and text, repeats included; null roles and texts are empty. A null
    conversation id is a conversation of its own. Other columns are ignored. No rows give two empty tables.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(row_id(id_col).alias("_conv"), F.col(f"`{turn_col}`").alias("_turn"), text(role_col).alias("_role"), text(text_col).alias("_text"))
    chained = stage(
        rows.repartition("_conv")
        .sortWithinPartitions("_conv", "_turn", "_role", "_text")
        .mapInArrow(_chain, "_conv long, _k int, _node binary, _parent binary, _role string, _text string, _path binary")
    )
    ranked = chained.filter("_k = -1").select("_conv", "_path").repartitionByRange("_path", "_conv").sortWithinPartitions("_path", "_conv")
    order = stage(ranked.select("_conv", F.monotonically_increasing_id().alias("_order")))
    turns = chained.filter("_k >= 0").join(order, "_conv")
    owners = stage(turns.groupBy("_node").agg(F.min("_order").alias("_order")))
    own = turns.join(owners, ["_node", "_order"]).select("_node", "_parent", "_order", "_k", "_role", "_text")
    texts = own.select("_node", "_role", "_text", "_k").mapInArrow(_segments, "_node binary, written string, length long, loss_start long, loss_end long")
    placed = own.select("_node", "_parent", "_order", "_k").join(texts, "_node")
    placed = stage(placed.repartitionByRange("_order", "_k").sortWithinPartitions("_order", "_k").withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum("length").alias("_sum"))
    before = totals.select("_part", F.expr("coalesce(sum(_sum) over (order by _part rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    within = F.expr("coalesce(sum(length) over (partition by _part order by _order, _k rows between unbounded preceding and 1 preceding), 0)")
    located = stage(placed.withColumn("_within", within).join(before, "_part").withColumn("start", F.col("_before") + F.col("_within")))
    spans = located.select("_node", F.col("_order").alias("_owner"), "start", "length")
    walked = (
        turns.select("_order", "_k", "_node")
        .join(spans, "_node")
        .withColumn("_owned", F.col("_owner") == F.col("_order"))
        .repartition("_order")
        .sortWithinPartitions("_order", "_k")
        .mapInArrow(_attend, "_node binary, position long, attends array<struct<start: long, end: long>>")
    )
    nodes = located.join(walked, "_node").select(
        F.col("_node").alias("node"), F.col("_parent").alias("parent"), F.col("_k").alias("depth"), "written", "length", "start", "position", "attends", "loss_start", "loss_end"
    )
    paths = chained.filter("_k >= 0").select(F.when(F.col("_conv") != NO_ID, F.col("_conv")).alias("conv_id"), F.col("_k").alias("k"), F.col("_node").alias("node"))
    return nodes, paths


_READ = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _read(batches):
    def told():
        return (None if conv == NO_ID else conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars)

    conv, n, lost, chars, turns, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        out = []
        for c, written, a, b in zip(*(batch.column(x).to_pylist() for x in ("_conv", "written", "loss_start", "loss_end"))):
            if c != conv:
                if conv is not None:
                    out.append(told())
                conv, n, lost, chars, turns, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, text = parse(written)
            turns.update(f"{role}\n{text}\n".encode())
            n, chars = n + 1, chars + len(written)
            if a is not None:
                masked = unescape(written[a:b])
                lost += len(masked)
                loss.update(masked.encode())
        yield _batch(out, _READ)
    if conv is not None:
        yield _batch([told()], _READ)


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Per conversation, from the stream alone: conv_id, n_turns, turns_sha256 (role, newline, text, newline for each
    turn), loss_chars and loss_sha256 (all unescaped text under the loss mask), formatted_chars."""
    rows = paths.select(row_id("conv_id").alias("_conv"), "k", "node").join(nodes.select("node", "written", "loss_start", "loss_end"), "node")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.repartition("_conv").sortWithinPartitions("_conv", "k").mapInArrow(_read, schema)


def _sql() -> str:
    grams = "|".join(re.sub(r"([\[\]|<>/])", r"\\\1", c).replace("'", "''") for c in sorted(CONTROLS, key=len, reverse=True))
    written = lambda c: f"length(replace({c}, '\\', '\\\\')) + len(regexp_extract_all({c}, '{grams}'))"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST({len(BEGIN)} + sum({len(TURN + TEXT + END)} + {written('role')} + {written('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


SQL = _sql()
