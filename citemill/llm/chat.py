"""Chat formatting with a prefix tree.

A conversation's formatted text is its turns, each ``### Role: text </turn>\\n``,
with control strings inside role and text escaped by a backslash (and backslashes
too), so it reads back exactly.  Conversations are ordered by the chain of hashes of
their initial turns, which is depth-first order: those that share initial turns
lie together.  *Packs* walk them in that order, and each shared turn is written once
in all packs together; every node carries its span in its pack's text, the position of its first
character along its own conversation, the spans of its ancestors (what it may attend
to besides its own past), its loss span, and the conversations that end there.

Packs are bounded, and so are tasks.  A pack whose conversations go on with turns that an
earlier pack holds names them in its *context*: the path of nodes outside, with the
pack and span of each, and its nodes say how many of these they attend to.  Conversations are
dealt to ranges of chains; what the first of a range shares with the last of the range
before it is its first pack's context, so a turn that a third of all conversations share is
written once and never gathered, however many tasks read it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from citemill.llm.common import arrow_schema, bounded_batches, record_batch, stored

OPEN, CLOSE = "### ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|: ")
_READ = re.compile(r"\\(\\|###|</turn>|:)|(### )|(: )|( </turn>\n)")

NODE = "struct<node: bigint, start: bigint, stop: bigint, position: bigint, loss_start: bigint, loss_stop: bigint, outside: int, attends: array<struct<start: bigint, stop: bigint>>, conversations: array<bigint>>"
OUTSIDE = "struct<node: bigint, pack: bigint, start: bigint, stop: bigint, loss_start: bigint, loss_stop: bigint>"
WRITTEN = f"pack bigint, outside array<bigint>, text string, nodes array<{NODE}>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn, and where its text starts and stops in it."""
    head, body = f"{OPEN}{escape(role)}: ", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text: (role, text), unescaped."""
    turns, role, buf, at = [], None, [], 0
    for m in _READ.finditer(formatted):
        buf.append(formatted[at : m.start()])
        at = m.end()
        if m.group(1):
            buf.append(m.group(1))
        elif m.group(2):
            role, buf = None, []
        elif m.group(3) and role is None:
            role, buf = "".join(buf), []
        elif m.group(4):
            turns.append((role, "".join(buf)))
            buf = []
        else:
            buf.append(m.group())
    return turns


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text)


def trees(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_role: str = "assistant", most_conversations: int = 512, most_chars: int = 1 << 20, ranges: int | None = None, most_broadcast: int = 100_000) -> DataFrame:
    """Packs of all conversations: pack, context, text, nodes.

    Null role or text counts as empty, a null turn comes first, rows of one turn number
    follow each other by role and text, repeated rows are turns of their own; rows without a
    conversation id form one conversation of that null id; an empty table gives
    no pack; a very long turn is one node, alone in its pack if it is longer than
    ``most_chars``; other columns are ignored.  A conversation is one record: its turns are
    gathered in one row, as its formatted text is one string.  The driver holds the first and
    last chain of each of ``ranges`` ranges (the number of shuffle partitions).
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).cast("long").alias("i"), s(role).alias("role"), s(text).alias("text"))))
    turns = F.concat(F.filter(turns, lambda x: x.i.isNull()), F.filter(turns, lambda x: x.i.isNotNull()))
    whole = conversations.groupBy(F.col(conv).cast("long").alias("c")).agg(turns.alias("turns"))
    # the chain of hashes of all prefixes, one long each; equal prefixes, equal longs
    links = F.aggregate(
        "turns",
        F.array().cast("array<bigint>"),
        lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x.role, x.text))),
    )
    whole = stored(whole.withColumn("chain", links))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges of chains and ids: where each begins, and then what is least and greatest in it
    place = whole.select("chain", F.coalesce("c", F.lit(-(2**63))).alias("c"))
    firsts = place.repartitionByRange(n, "chain", "c").withColumn("r", F.spark_partition_id()).groupBy("r").agg(F.min(F.struct("chain", "c")).alias("x")).select("x.*").collect()
    starts = spark.sparkContext.broadcast(sorted((tuple(x["chain"]), x["c"]) for x in firsts))

    @F.pandas_udf("int")
    def range_of(chains: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([max(0, bisect_right(starts.value, (tuple(x), c)) - 1) for x, c in zip(chains, ids.tolist())], dtype="int32")

    placed = whole.withColumn("r", range_of("chain", F.coalesce("c", F.lit(-(2**63)))))
    edges = {e["r"]: (e["low"], e["high"]) for e in placed.groupBy("r").agg(F.min("chain").alias("low"), F.max("chain").alias("high")).collect()}
    shared, before = {}, []
    for r in sorted(edges):
        low, high = edges[r]
        shared[r] = next((k for k, (x, y) in enumerate(zip(low, before)) if x != y), min(len(low), len(before)))
        before = high
    held = spark.sparkContext.broadcast(shared)
    out = arrow_schema(WRITTEN)

    def run(batches):
        writer, last = None, None
        for batch in batches:
            for r, c, ts, chain in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r != last:
                    if writer:
                        yield from writer.close()
                    writer, last = _Writer(out, r, held.value[r], learn_role, most_conversations, most_chars), r
                yield from writer.add(c, [(t["role"], t["text"]) for t in ts], chain)
        if writer:
            yield from writer.close()

    dealt = placed.repartition(n, "r").sortWithinPartitions("r", "chain", "c").select("r", "c", "turns", "chain")
    written = stored(dealt.mapInArrow(run, WRITTEN))
    # where the nodes stand that packs name as outside: a row for each, as each is written once
    wanted = written.select(F.explode("outside").alias("node")).distinct()
    spot = F.struct("n.node", "pack", "n.start", "n.stop", "n.loss_start", "n.loss_stop")
    at = written.select("pack", F.explode("nodes").alias("n")).select(F.col("n.node").alias("node"), spot.alias("place")).join(wanted, "node", "left_semi")
    at = F.broadcast(at) if wanted.count() <= most_broadcast else at
    context = written.select("pack", F.posexplode("outside").alias("k", "node")).join(at, "node").groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "place"))), lambda x: x.place).alias("context"))
    none = F.array().cast(f"array<{OUTSIDE}>")
    return written.join(context, "pack", "left").select("pack", F.coalesce("context", none).alias("context"), "text", "nodes")


class _Writer:
    """Packs of one range, written depth-first.  The path holds the nodes of the last conversation: their
    hash, span in the pack (None outside it) and position."""

    def __init__(self, schema, r: int, shared: int, learn_role: str, most_conversations: int, most_chars: int):
        self.schema, self.r, self.shared, self.learn_role = schema, r, shared, learn_role
        self.most_conversations, self.most_chars = most_conversations, most_chars
        self.packs, self.path = 0, None
        self._open()

    def _open(self) -> None:
        self.parts, self.nodes, self.outside = [], [], []
        self.length = self.count = 0

    def _end_pack(self):
        if self.count:
            yield record_batch(self.schema, [[self.r << 32 | self.packs], [self.outside], ["".join(self.parts)], [self.nodes]])
            self.packs += 1
            for node in self.path:
                node["here"] = False
        self._open()

    def close(self):
        yield from self._end_pack()

    def add(self, conv, turns, chain):
        if self.path is None:  # what the range before has written
            self.path = []
            for t, h in list(zip(turns, chain))[: self.shared]:
                self._step(h, len(format_turn(*t)[0]), here=False)
        if self.count >= self.most_conversations or self.length >= self.most_chars:
            yield from self._end_pack()
        known = 0
        while known < min(len(chain), len(self.path)) and self.path[known]["node"] == chain[known]:
            known += 1
        del self.path[known:]
        fresh = not self.count
        if fresh:
            self.outside = [x["node"] for x in self.path]
        for t, h in zip(turns[known:], chain[known:]):
            self._write(h, *t)
        if self.path and self.path[-1].get("row") is not None and self.path[-1]["here"]:
            self.path[-1]["row"]["conversations"].append(conv)
        else:  # it ends at a node of another pack, or has no turn
            self._end_outside(conv)
        self.count += 1

    def _step(self, node: int, size: int, here: bool, **more) -> dict:
        above = self.path[-1] if self.path else None
        entry = {"node": node, "size": size, "here": here, "position": above["position"] + above["size"] if above else 0, **more}
        self.path.append(entry)
        return entry

    def _attends(self) -> tuple[int, list[dict]]:
        """How many of the context, and spans of this pack, the path holds; spans that touch are one."""
        spans: list[dict] = []
        inside = [x["row"] for x in self.path if x["here"]]
        for row in inside:
            if spans and spans[-1]["stop"] == row["start"]:
                spans[-1]["stop"] = row["stop"]
            else:
                spans.append({"start": row["start"], "stop": row["stop"]})
        return len(self.path) - len(inside), spans

    def _write(self, node: int, role: str, text: str) -> None:
        formatted, lo, hi = format_turn(role, text)
        outside, attends = self._attends()
        start, learn = self.length, role == self.learn_role
        entry = self._step(node, len(formatted), here=True)
        row = {"node": node, "start": start, "stop": start + len(formatted), "position": entry["position"], "loss_start": start + lo if learn else None, "loss_stop": start + hi if learn else None}
        entry["row"] = row | {"outside": outside, "attends": attends, "conversations": []}
        self.nodes.append(entry["row"])
        self.parts.append(formatted)
        self.length += len(formatted)

    def _end_outside(self, conv) -> None:
        """A row without text for conversations that end at the path's last node, which another pack holds."""
        last = self.nodes[-1] if self.nodes else None
        if last is None or last["node"] is not None or last["outside"] != len(self.path):
            position = self.path[-1]["position"] + self.path[-1]["size"] if self.path else 0
            last = {"node": None, "start": self.length, "stop": self.length, "position": position, "loss_start": None, "loss_stop": None, "outside": len(self.path), "attends": [], "conversations": []}
            self.nodes.append(last)
        last["conversations"].append(conv)


def read_back(packs: DataFrame, conv: str = "conv_id", most_chars: int = 8 << 20) -> DataFrame:
    """One row per conversation, read from packs alone: the context and spans that a conversation's last
    node attends to, and its own, are its formatted text."""
    ddl = f"`{conv}` bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    out = arrow_schema(ddl)
    # texts of the nodes outside, each read once
    lent = packs.select(F.explode("context").alias("o")).select("o.*").distinct()
    small = (lent.agg(F.sum(F.col("stop") - F.col("start") + 64)).first()[0] or 0) <= most_chars
    cut = F.expr("substring(text, start + 1, stop - start)")
    learnt = F.when(F.col("loss_start").isNotNull(), F.expr("substring(text, loss_start + 1, loss_stop - loss_start)"))
    lent = lent.join(packs.select("pack", "text"), "pack").select("node", F.struct(cut.alias("text"), learnt.alias("loss")).alias("said"))
    lent = F.broadcast(lent) if small else lent
    given = packs.select("pack", F.posexplode("context.node").alias("k", "node")).join(lent, "node").groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda x: x.said).alias("given"))

    def run(batches):
        for batch in batches:
            for text, nodes, given in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = []
                starts = [n["start"] for n in nodes]  # ascending, as nodes are written in order
                for node in nodes:
                    if not node["conversations"]:
                        continue
                    above = (given or [])[: node["outside"]]
                    spans = [*((a["start"], a["stop"]) for a in node["attends"]), (node["start"], node["stop"])]
                    formatted = "".join([x["text"] for x in above] + [text[a:b] for a, b in spans])
                    turns = parse(formatted)
                    said, learnt, chars = hashlib.sha256(), hashlib.sha256(), 0
                    for r, t in turns:
                        said.update(f"{r}\n{t}\n".encode("utf-8"))
                    inside = (n for a, b in spans for n in nodes[bisect_left(starts, a) : bisect_left(starts, b)])
                    for t in [x["loss"] for x in above if x["loss"] is not None] + [text[n["loss_start"] : n["loss_stop"]] for n in inside if n["loss_start"] is not None]:
                        t = unescape(t)
                        learnt.update(t.encode("utf-8"))
                        chars += len(t)
                    rows += [(c, len(turns), said.hexdigest(), chars, learnt.hexdigest(), len(formatted)) for c in node["conversations"]]
                if rows:
                    yield record_batch(out, zip(*rows))

    bounded_batches(packs.sparkSession)
    return packs.join(given, "pack", "left").select("text", "nodes", "given").mapInArrow(run, ddl)
