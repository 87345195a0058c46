"""Chat formatting as prefix trees: shared turns once, depth first, as tokens with position ids and attention intervals.

A turn is written as `<|ROLE|>TEXT<|end|>`, role and text with control strings escaped: a backslash before
every backslash and between `<` and `|`, so no text can look like a marker and the original is got back
exactly. The opening marker, the text and `<|end|>` are encoded each by itself, so the tokens of a text are known and the loss
covers those of assistant texts alone. Conversations that start alike share nodes (a node stands for all turns so
far); those that share a first turn make a tree, emitted as one sequence of token ids: each node's tokens
once, a parent before its children, with position ids as if each conversation stood alone. A node carries its span, that of its
loss, and the spans of its ancestors, merged, which are all it may attend to besides itself.

A tree of more than PART_CHARS characters or PART_LEAVES conversations is emitted as linked parts: part 0 holds the trunk,
the nodes that more than that go through; the subtrees that hang on it, and the conversations that end in it, are dealt by a hash
to the other parts. A subtree's top names the node of the trunk that it hangs on (`link`): it attends to that one and to
what that one attends to. So every shared turn is emitted once, whatever share of the conversations has it, and
no task holds a tree as a whole.

Turns are ordered by turn, role, text. Defined cases: null texts and roles are empty; repeated rows are
turns of their own; rows without conv_id make one conversation without an id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.shared import discard, give_back, salted_join, written
from stratalog.llm.tokens import encoder, token_bytes

PART_CHARS, PART_LEAVES = 250_000, 500
#: nodes of trunks, or roots of trees, that are broadcast (about 100 bytes each); more are joined by a salted shuffle
BROADCAST_NODES = 200_000
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
LOSS_ROLE = "assistant"
NODE = pa.struct([("node", pa.string()), ("parent", pa.int32()), ("link", pa.string()), ("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(pa.int64()))])
LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32()), ("link", pa.string())])
SEQUENCE = (
    "root string, part long, parts long, ids array<int>, positions array<int>, "
    "nodes array<struct<node:string, parent:int, link:string, role:string, start:bigint, stop:bigint, loss_start:bigint, loss_stop:bigint, position:bigint, attends:array<bigint>>>, "
    "leaves array<struct<conv_id:bigint, node:int, link:string>>"
)
_MARK = re.compile(r"<\|((?:[^\\|]|\\.|\|(?!>))*)\|>", re.S)
_CLOSING, _CLOSED = re.compile(r"(?<!<\\)\|>"), r"\\|>"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def opening(role: str) -> str:
    # a role also must not close its own marker; where it has `<|>`, its bar is escaped already
    return f"{OPEN}{_CLOSING.sub(_CLOSED, escape(role))}{CLOSE}"


def render(role: str, text: str) -> str:
    return f"{opening(role)}{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _MARK.match(formatted, at)
        end = formatted.index(END, m.end())
        out.append((unescape(m[1]), unescape(formatted[m.end() : end])))
        at = end + len(END)
    return out


def chained(rows: DataFrame, tokenizer: str, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Per turn: conv_id, depth, node (hash of all turns so far), parent, root, role, its token ids, how many of them open
    and close it, its position, and how many characters are left from it on; `last` marks the conversation's last turn.
    Streams over sorted rows: no conversation is held in memory."""
    own = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        code, end = encoder(tokenizer), encoder(tokenizer).values(END).astype("<i4").tobytes()
        heads: dict[str, bytes] = {}
        texts: dict[str, bytes] = {}  # shared turns come again
        state, held = None, None  # of the conversation: id, digest, depth, position, root, parent, characters; the row before
        names = ["conv_id", "depth", "node", "parent", "root", "role", "ids", "head", "tail", "position", "left", "last"]
        for b in batches:
            out = []
            for conv, role, text, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "chars"))):
                if state is None or state[0] != conv:
                    if held:
                        out.append((*held, True))
                    state, held = [conv, hashlib.blake2b(digest_size=16), 0, 0, "", "", chars], None
                if held:
                    out.append((*held, False))
                if role not in heads:
                    if len(heads) > 10_000:
                        heads.clear()
                    heads[role] = code.values(opening(role)).astype("<i4").tobytes()
                ids = texts.get(text)
                if ids is None:
                    ids = code.values(escape(text)).astype("<i4").tobytes()
                    if len(text) <= 2_000:
                        if len(texts) > 10_000:
                            texts.clear()
                        texts[text] = ids
                state[1].update(render(role, text).encode("utf-8", "surrogatepass"))
                node, whole = state[1].hexdigest(), heads[role] + ids + end
                state[4] = state[4] or node
                held = (conv, state[2], node, state[5], state[4], role, whole, len(heads[role]) // 4, len(end) // 4, state[3], state[6])
                state[2] += 1
                state[3] += len(whole) // 4
                state[5] = node
                state[6] -= len(role) + len(text) + 11
            yield _batch(names, out)
        if held:
            yield _batch(names, [(*held, True)])

    own = own.repartition("conv_id").withColumn("chars", F.sum(F.length("role") + F.length("text") + 11).over(Window.partitionBy("conv_id")))
    return own.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, depth int, node string, parent string, root string, role string, ids binary, head int, tail int, position long, left long, last boolean")


_TYPES = {"conv_id": pa.int64(), "depth": pa.int32(), "position": pa.int64(), "last": pa.bool_(), "ids": pa.binary(), "head": pa.int32(), "tail": pa.int32(), "left": pa.int64()}


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.string())) for n, c in zip(names, columns)], names)


def _with(turns: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """turns (written) left joined with few (written), whose keys may be in any share of turns."""
    if few.count() <= BROADCAST_NODES:
        return turns.join(F.broadcast(few), key, "left")
    return salted_join(turns, few, key, F.xxhash64("conv_id", "depth"), "left")


def trees(rows: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per tree or part of one, written: token ids, position ids, nodes depth first, the conversations' last nodes."""
    spark = rows.sparkSession
    turns = written(chained(rows, tokenizer, conv_col, turn_col, role_col, text_col), "turns")
    weighed = turns.groupBy("root", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("left").alias("chars"))
    trunk = written(weighed.filter((F.col("n") > PART_LEAVES) | (F.col("chars") > PART_CHARS)), "trunk")
    parts = F.greatest(F.ceil(F.col("chars") / PART_CHARS), F.ceil(F.col("n") / PART_LEAVES)).cast("long")
    roots = written(trunk.filter("root = node").select("root", parts.alias("parts")), "roots")
    known = _with(turns, trunk.select("node", F.lit(True).alias("trunk")), "node")
    if cut := roots.limit(1).count():
        marked = written(known, "known")
        known = _with(marked, roots, "root")
    else:
        known = known.withColumn("parts", F.lit(None).cast("long"))
    known = known.withColumn("trunk", F.coalesce("trunk", F.lit(False)))
    small = known.filter("parts is null").withColumn("part", F.lit(0).cast("long")).withColumn("parts", F.lit(0).cast("long"))
    dealt = [small]
    if cut:
        large = known.filter("parts is not null")
        # what is left of a conversation below the trunk is a bounded number of rows, all in the part of the first of them
        top = F.first("node").over(Window.partitionBy("conv_id").orderBy("depth"))
        below = large.filter("not trunk").withColumn("part", 1 + F.pmod(F.xxhash64(top), F.col("parts")))
        above = large.filter("trunk")
        dealt += [below, above.withColumn("part", F.lit(0).cast("long")).withColumn("last", F.lit(False))]
        ends = above.filter("last").withColumn("part", 1 + F.pmod(F.xxhash64("conv_id"), F.col("parts")))
    columns = ["root", "part", "parts", "node", "parent", "depth", "role", "ids", "head", "tail", "position"]
    leaf = [F.lit(None).cast("string").alias("parent"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("int").alias("head"), F.lit(None).cast("int").alias("tail"), F.col("conv_id").alias("position")]
    both = []
    for d in dealt:
        both.append(d.groupBy("root", "part", "parts", "node").agg(*(F.first(c).alias(c) for c in columns[4:])).select(columns))
        both.append(d.filter("last").select("root", "part", "parts", "node", *leaf))
    if cut:
        both.append(ends.select("root", "part", "parts", "node", *leaf))
    every = both[0]
    for other in both[1:]:
        every = every.unionByName(other)

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, parts = {}, [], 0
        for b in batches:
            for r in b.to_pylist():
                parts = r["parts"]
                if r["depth"] < 0:
                    last.append((r["node"], r["position"]))
                else:
                    own[r["node"]] = r
        children: dict[str, list[str]] = {}
        for r in own.values():
            children.setdefault(r["parent"] if r["parent"] in own else "", []).append(r["node"])
        ids, positions, nodes, index, length = [], [], [], {}, 0
        stack = sorted(children.get("", []), reverse=True)
        while stack:
            name = stack.pop()
            r = own[name]
            up = index.get(r["parent"], -1)
            attends = []
            if up >= 0:  # the parent's ancestors and the parent, merged where they touch
                p = nodes[up]
                attends = [*p["attends"]]
                if attends and attends[-1] == p["start"]:
                    attends[-1] = p["stop"]
                else:
                    attends += [p["start"], p["stop"]]
            n = len(r["ids"]) // 4
            loss = (length + r["head"], length + n - r["tail"]) if r["role"] == LOSS_ROLE else (length, length)
            index[name] = len(nodes)
            nodes.append({"node": name, "parent": up, "link": r["parent"] if up < 0 and r["parent"] else None, "role": r["role"], "start": length, "stop": length + n, "loss_start": loss[0], "loss_stop": loss[1], "position": r["position"], "attends": attends})
            ids.append(np.frombuffer(r["ids"], "<i4"))
            positions.append(np.arange(r["position"], r["position"] + n, dtype=np.int32))
            length += n
            stack += sorted(children.get(name, []), reverse=True)
        leaves = [{"conv_id": c, "node": index.get(n, -1), "link": None if n in index else n} for n, c in sorted(last, key=lambda x: (x[1] is None, x[1], x[0]))]
        flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (ids, positions)]
        yield pa.RecordBatch.from_pydict({"root": pa.array([key[0].as_py()]), "part": pa.array([key[1].as_py()], pa.int64()), "parts": pa.array([parts], pa.int64()), "ids": pa.array([flat[0]], pa.list_(pa.int32())), "positions": pa.array([flat[1]], pa.list_(pa.int32())), "nodes": pa.array([nodes], pa.list_(NODE)), "leaves": pa.array([leaves], pa.list_(LEAF))})

    out = written(every.groupBy("root", "part").applyInArrow(build, SEQUENCE), "sequences")
    discard(spark, turns, trunk, roots, *([marked] if cut else []))
    return out


class _Sequence:
    """A sequence's tokens as bytes, and what its nodes may see."""

    def __init__(self, ids: list[int], nodes: list[dict], table: list[bytes]):
        pieces = [table[i] for i in ids]
        self.raw, self.nodes = b"".join(pieces), nodes
        self.ends = np.append(0, np.cumsum([len(p) for p in pieces], dtype=np.int64))
        self.index = {n["node"]: k for k, n in enumerate(nodes)}

    def text(self, a: int, b: int) -> bytes:
        return self.raw[self.ends[a] : self.ends[b]]

    def seen(self, k: int) -> bytes:
        """What node k attends to in this sequence, and itself."""
        spans = [*self.nodes[k]["attends"], self.nodes[k]["start"], self.nodes[k]["stop"]]
        return b"".join(self.text(a, b) for a, b in zip(spans[::2], spans[1::2]))

    def loss(self, k: int) -> list[str]:
        """The texts under the loss mask, from the first to node k."""
        out = []
        while k >= 0:
            n = self.nodes[k]
            if n["loss_stop"] > n["loss_start"]:
                out.append(unescape(self.text(n["loss_start"], n["loss_stop"]).decode()))
            k = n["parent"]
        return out[::-1]

    def top(self, k: int) -> dict:
        while self.nodes[k]["parent"] >= 0:
            k = self.nodes[k]["parent"]
        return self.nodes[k]


def read_back(sequences: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from the (written) sequences alone: what its last node attends to, and the digests of that."""

    def run(batches):
        table = token_bytes(tokenizer)
        for b in batches:
            for i in range(b.num_rows):  # a row is a whole part, so one at a time as Python objects
                r = b.slice(i, 1).to_pylist()[0]
                own, trunk = _Sequence(r["ids"], r["nodes"], table), None
                if r["trunk_ids"] is not None:
                    trunk = _Sequence(r["trunk_ids"], r["trunk_nodes"], table)
                out, known = [], {}
                for leaf in r["leaves"]:
                    if (k := (leaf["node"], leaf["link"])) not in known:
                        known[k] = _digests(own, trunk, *k)
                    out.append((leaf["conv_id"], *known[k]))
                c = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array(c[0], pa.int64()), "n_turns": pa.array(c[1], pa.int64()), "turns_sha256": pa.array(c[2], pa.string()), "loss_chars": pa.array(c[3], pa.int64()), "loss_sha256": pa.array(c[4], pa.string()), "formatted_chars": pa.array(c[5], pa.int64())})
                del r, own, trunk, known
            give_back(False)

    columns = ["root", "part", "ids", "nodes", "leaves"]
    none = [F.lit(None).cast(dict(sequences.dtypes)[c]).alias(f"trunk_{c}") for c in ("ids", "nodes")]
    whole = sequences.filter("parts = 0").select(*columns, *none)
    trunks = sequences.filter("part = 0 and parts > 0").select("root", F.col("ids").alias("trunk_ids"), F.col("nodes").alias("trunk_nodes"))
    linked = salted_join(sequences.filter("part > 0").select(columns), trunks, "root", F.col("part"), least=16)
    return whole.unionByName(linked).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(own: _Sequence, trunk: _Sequence | None, k: int, link: str | None) -> tuple:
    if k >= 0:
        seen, loss, link = own.seen(k), own.loss(k), own.top(k)["link"]
    else:
        seen, loss = b"", []
    if link is not None:
        up = trunk.index[link]
        seen, loss = trunk.seen(up) + seen, trunk.loss(up) + loss
    formatted, loss = seen.decode(), "".join(loss)
    turns = parse(formatted)
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(formatted)
