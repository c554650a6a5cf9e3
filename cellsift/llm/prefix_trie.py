"""The trie of conversation prefixes, built as a burst trie.

A turn is the digest of its role and text, a conversation a row of turns. Every distinct prefix is a node.

1. Equal conversations are one class, known by their smallest id and their number. The digest of its ids is taken from chunks of
   sorted ids that many tasks write.
2. Conversations are cut into segments of ``SEGMENT`` turns, so that no row holds more, however long one is. A segment hangs under
   the trie head that its path up to there names; heads that one class alone reaches need no trie below.
3. Under each head the rest of the segments lies in containers, one for each next turn. A container of more than ``BURST`` turns
   bursts: the turns all its members share become a chain of nodes, whose last one is a head again, and each member moves on to the
   container of its next turn. This repeats until no container is too large.
4. Containers are dealt to tasks, their members sorted and swept once: what a member does not share with the one before opens
   nodes, and closing a node adds it to its parent. A task holds the nodes of one container.
5. Sums of containers go up to the heads, round by round and then segment level by level, where several classes share a head
   deeper than one segment.

``turns`` need ``conv``, ``place`` (from 1, without gaps), ``mark`` (digest) and ``length``. Conversations without turns are members of the
root alone. Repeated turns count as they stand. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellsift.llm.common import ship, staged
from cellsift.llm.shards import ordered_sums

ship(__name__)

#: Turns of a conversation in one row, and of a container that is swept in one go.
SEGMENT = 1024
BURST = 1024
#: Ids in one chunk of a class.
CHUNK = 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
_NOBODY = hashlib.sha256(b"").digest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, n, place, mark, length`` of each row of ``conv_id, turn, role, text``: turns by number (null first), then by digest.

    Rows without an id belong to no conversation and take no part. Null roles and texts are empty. Numbering runs over
    ranges of rows, so one conversation may hold any share of them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("mark"),
        F.char_length(text).cast("long").alias("length"),
    )
    placed = staged(ordered_sums(rows, ["conv", "turn", "mark"], "length"), "trie-turns")
    firsts = placed.groupBy("conv").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    return placed.join(firsts, "conv").select("conv", "n", (F.col("position") - F.col("first") + 1).alias("place"), "mark", "length")


def classes(conversations: DataFrame) -> DataFrame:
    """``one, two, n, conv, c, ends`` of each class of ``conv, one, two, n``: smallest id, number of ids, digest of the sorted ids.

    Ids are sorted in ranges; a class that fills many ranges is one row of text a chunk when its digest is taken.
    """
    key = ["one", "two", "n"]
    dealt = conversations.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def row() -> pa.RecordBatch:
            text = ",".join(map(str, ids)).encode()
            return pa.RecordBatch.from_pylist([{**dict(zip(key, held, strict=True)), "first": ids[0], "c": len(ids), "text": text}], schema)

        schema = pa.schema([*((k, pa.int64()) for k in key), ("first", pa.int64()), ("c", pa.int64()), ("text", pa.binary())])
        for batch in batches:
            for *mine, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ids and (mine != held or len(ids) == CHUNK):
                    yield row()
                    ids = []
                held = mine
                ids.append(conv)
        if ids:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, c, sha, out = None, 0, 0, None, []
        for batch in batches:
            for *mine, start, n, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if mine != held:
                    if held is not None:
                        out.append((*held, first, c, sha.digest()))
                    held, first, c, sha = mine, start, 0, hashlib.sha256()
                sha.update(b"," + text if c else text)
                c += n
            yield _classes(out)
            out = []
        yield _classes([(*held, first, c, sha.digest())] if held is not None else [])

    texts = dealt.select(*key, "conv").mapInArrow(chunks, "one long, two long, n long, first long, c long, text binary")
    return texts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digests, "one long, two long, n long, conv long, c long, ends binary")


def _classes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["one", "two", "n", "conv", "c", "ends"])


def _hashes(*columns: Column | str) -> list[Column]:
    """128 bits of what the columns hold."""
    return [F.xxhash64(F.lit(salt), *columns) for salt in (0x51AC, 0x7E3D)]


def segments(turns: DataFrame, size: int) -> DataFrame:
    """``conv, level, marks, lengths, one, two``: a conversation's turns in rows of up to ``size``, and a digest of each."""
    cut = turns.withColumn("level", F.expr(f"(place - 1) div {size}"))
    rows = cut.groupBy("conv", "level").agg(F.sort_array(F.collect_list(F.struct("place", "mark", "length"))).alias("t"))
    rows = rows.select("conv", "level", F.col("t.mark").alias("marks"), F.col("t.length").alias("lengths"))
    one, two = _hashes("level", "marks")
    return rows.select("*", one.alias("one"), two.alias("two"))


def build(turns: DataFrame, conversations: DataFrame, size: int = SEGMENT, burst: int = BURST) -> DataFrame:
    """All nodes of the trie of ``turns``; ``conversations`` names every ``conv``, with or without turns."""
    cut = staged(segments(turns, size), "trie-segments")
    long = F.coalesce(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("long")
    thin = cut.select("conv", "level", "one", "two", F.size("marks").cast("long").alias("n"), long)
    whole = thin.groupBy("conv").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"), F.sum("n").alias("n"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("one", "two", "n")]
    known = staged(classes(conversations.select("conv").distinct().join(whole, "conv", "left").select("conv", *zero)), "trie-classes")
    all_ = known.agg(F.min("conv").alias("conv"), F.sum("c").alias("c")).first()
    if all_.conv is None:
        return _named(conversations.sparkSession.createDataFrame([], NODE))
    # Paths of the segments of each class's smallest conversation.
    path = W.partitionBy("conv").orderBy("level")
    upto, before = path.rowsBetween(W.unboundedPreceding, 0), path.rowsBetween(W.unboundedPreceding, -1)
    rest = path.rowsBetween(0, W.unboundedFollowing)
    heads = thin.join(known.select("conv", "c", "ends", F.col("n").alias("all")), "conv").select(
        "conv", "level", "c",
        *[F.coalesce(F.bit_xor(d).over(before), F.lit(0).cast("long")).alias(f"head_{d}") for d in ("one", "two")],
        *[F.bit_xor(d).over(upto).alias(f"next_{d}") for d in ("one", "two")],
        F.sum("long").over(rest).alias("rest"),
        F.when((F.col("level") + 1) * size < F.col("all"), None).otherwise(F.col("ends")).alias("ends"),
        ((F.col("level") + 1) * size < F.col("all")).alias("more"),
    )
    rows = staged(cut.select("conv", "level", "marks", "lengths").join(heads, ["conv", "level"]), "trie-paths")
    trie = _Levels(rows, all_.conv, size, burst)
    nodes, totals = trie.all_nodes()
    top = totals.first() if totals is not None else None
    without = known.where("n = 0").select("ends").first()
    root = (all_.conv, 0, None, all_.c, top.children if top else 0, top.leaves if top else 1, top.saved if top else 0,
            without.ends if without else bytearray(_NOBODY))
    return _named(reduce(DataFrame.union, [rows.sparkSession.createDataFrame([root], NODE), *nodes]))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select(*nodes.columns[:-1], F.lower(F.hex("ends")).alias("ends_sha256"))


class _Levels:
    """The levels of segments, from the deepest that several classes share up to the root."""

    def __init__(self, rows: DataFrame, root_conv: int, size: int, burst: int):
        self.rows, self.root_conv, self.size, self.burst = rows, root_conv, size, burst

    def all_nodes(self) -> tuple[list[DataFrame], DataFrame | None]:
        """Parts of the nodes below the root, and the sums below the root (one row, if there is a node)."""
        if not self.rows.limit(1).count():
            return [], None
        nodes, deeper, last = [], None, 0
        rows = self.rows.withColumn("base", F.col("level") * self.size).withColumn("top", F.lit(self.root_conv).cast("long"))
        if self.rows.where("level > 0").limit(1).count():
            # A head's members are all that reach it, also those that end there; only those that go on count as paths below.
            reach = self.rows.where(F.size("marks") == self.size).select(
                (F.col("level") + 1).alias("level"), F.col("next_one").alias("head_one"), F.col("next_two").alias("head_two"), "conv", F.lit(0).alias("on")
            )
            go_on = self.rows.where("level > 0").select("level", "head_one", "head_two", "conv", F.lit(1).alias("on"))
            counted = reach.union(go_on).groupBy("level", "head_one", "head_two").agg(F.sum("on").alias("_n"), F.min("conv").alias("_top"))
            counted = staged(counted, "trie-heads")
            keys = ["level", "head_one", "head_two"]
            rows = rows.join(counted, keys, "left").withColumn("top", F.coalesce("_top", "top"))
            rows = staged(rows.withColumn("lone", F.coalesce(F.col("_n") == 1, F.lit(False))).drop("_n", "_top"), "trie-levels")
            lone = rows.where("lone")
            # Below a head of one class there is one path, whose sums are known without a trie.
            after = F.col("rest") - F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
            below = F.when(F.col("more"), F.struct(F.lit(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
                                                   ((F.col("c") - 1) * after).alias("saved")))
            swept = self._swept(self._boxed(lone.withColumn("below", below)), "trie-lone")
            nodes.append(_nodes(swept))
            deeper = lone.select("head_one", "head_two", F.col("level").alias("at"), F.lit(1).cast("long").alias("children"),
                                 F.lit(1).cast("long").alias("leaves"), ((F.col("c") - 1) * F.col("rest")).alias("saved"))
            last = rows.where("level > 0 and not lone").agg(F.max("level")).first()[0] or 0
            rows = rows.where("not lone").drop("lone")
        totals = None
        for level in range(last, -1, -1):
            mine = rows.where(F.col("level") == level)
            if deeper is not None:
                mine = self._merged(mine, deeper)
            else:
                mine = mine.withColumn("below", F.lit(None).cast("struct<children:long,leaves:long,saved:long>"))
            parts, totals = self._level(self._boxed(mine))
            nodes += parts
            if level:
                known = staged(totals, "trie-totals").select(
                    F.col("up_one").alias("head_one"), F.col("up_two").alias("head_two"), F.lit(level).cast("long").alias("at"), "children", "leaves", "saved"
                )
                deeper = known if deeper is None else deeper.union(known)
        return nodes, totals

    def _merged(self, rows: DataFrame, deeper: DataFrame) -> DataFrame:
        """Classes that fill the segment alike are one member; it knows the sums of the head they reach."""
        short = rows.where(F.size("marks") < self.size).withColumn("below", F.lit(None).cast("struct<children:long,leaves:long,saved:long>"))
        keys = ["level", "head_one", "head_two", "next_one", "next_two", "base", "top"]
        full = rows.where(F.size("marks") == self.size).groupBy(*keys).agg(
            F.min("conv").alias("conv"), F.sum("c").alias("c"), F.max("ends").alias("ends"), F.any_value("marks").alias("marks"),
            F.any_value("lengths").alias("lengths"), F.bool_or("more").alias("more"),
        )
        sums = deeper.select(F.col("head_one").alias("next_one"), F.col("head_two").alias("next_two"), (F.col("at") - 1).alias("level"),
                             F.struct("children", "leaves", "saved").alias("below"))
        full = full.join(sums, ["next_one", "next_two", "level"], "left")
        columns = ["level", "head_one", "head_two", "base", "top", "conv", "c", "ends", "marks", "lengths", "below"]
        return short.select(*columns).unionByName(full.select(*columns))

    def _boxed(self, rows: DataFrame) -> DataFrame:
        """The first containers: one for each next turn under each head."""
        one, two = _hashes("level", "head_one", "head_two", F.get("marks", F.lit(0)))
        return rows.select(
            F.lit(0).alias("round"), one.alias("box_one"), two.alias("box_two"), F.col("head_one").alias("up_one"), F.col("head_two").alias("up_two"),
            "base", "top", "conv", "c", "ends", "marks", "lengths", "below",
        )

    def _level(self, rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """Nodes of one level of segments, and the sums under each of its heads."""
        rows = staged(rows, "trie-boxes")
        settled, bursts, box = [], [], ["box_one", "box_two"]
        while True:
            over = staged(self._oversized(rows), "trie-burst")
            if not over.limit(1).count():
                settled.append(rows)
                break
            settled.append(rows.join(over.select(*box), box, "left_anti"))
            bursts.append(over)
            rows = staged(self._moved(rows, over), "trie-boxes")
        swept = self._swept(reduce(DataFrame.unionByName, settled), "trie-swept")
        nodes, totals = [_nodes(swept)], swept.where("depth is null").select(*_TOTALS)
        for over in reversed(bursts):
            chains = staged(self._chains(over, totals), "trie-chains")
            nodes.append(_nodes(chains))
            totals = totals.union(chains.where("depth is null").select(*_TOTALS))
        return nodes, _under_heads(totals.where("round = 0"))

    def _oversized(self, rows: DataFrame) -> DataFrame:
        """Containers that must burst, with the turns that all members share (at least the first)."""
        stats = rows.groupBy("round", "box_one", "box_two", "up_one", "up_two", "base", "top").agg(
            F.count("*").alias("n"), F.sum(F.size("marks")).alias("turns"), F.sum("c").alias("c"), F.min("conv").alias("conv"),
            F.min(F.struct("marks", "lengths", "ends")).alias("low"), F.max("marks").alias("high"),
        ).where((F.col("n") > 1) & (F.col("turns") > self.burst))
        differs = F.array_position(F.transform(F.arrays_zip(F.col("low.marks").alias("a"), F.col("high").alias("b")),
                                               lambda p: p["a"].eqNullSafe(p["b"])), False)
        shared = stats.withColumn("shared", (differs - 1).cast("int"))
        return shared.select(
            "round", "box_one", "box_two", "up_one", "up_two", "base", "top", "c", "conv", "shared",
            F.slice("low.lengths", F.lit(1), F.col("shared")).alias("lengths"),
            F.when(F.size("low.marks") == F.col("shared"), F.col("low.ends")).alias("ends"),
        )

    def _moved(self, rows: DataFrame, over: DataFrame) -> DataFrame:
        """Members of burst containers that go on behind the shared turns, in the container of their next turn."""
        heads = over.select("box_one", "box_two", "shared", F.col("conv").alias("_top"))
        moved = rows.join(heads, ["box_one", "box_two"]).where(F.size("marks") > F.col("shared"))
        one, two = _hashes("box_one", "box_two", F.get("marks", F.col("shared")))
        rest = [F.slice(c, F.col("shared") + 1, F.size(c) - F.col("shared")).alias(c) for c in ("marks", "lengths")]
        return moved.select(
            (F.col("round") + 1).alias("round"), one.alias("box_one"), two.alias("box_two"), F.col("box_one").alias("up_one"),
            F.col("box_two").alias("up_two"), (F.col("base") + F.col("shared")).alias("base"), F.col("_top").alias("top"),
            "conv", "c", "ends", *rest, "below",
        )

    def _swept(self, boxes: DataFrame, label: str) -> DataFrame:
        order = ["round", "box_one", "box_two"]
        columns = [*order, "up_one", "up_two", "base", "top", "conv", "c", "ends", "marks", "lengths", "below"]
        dealt = boxes.select(*columns).repartition(*order).sortWithinPartitions(*order, "marks")
        return staged(dealt.mapInArrow(sweep, _SWEPT), label)

    def _chains(self, over: DataFrame, totals: DataFrame) -> DataFrame:
        """The chain of nodes of each burst container, from the sums of the containers it burst into; and its own sums."""
        sums = _under_heads(totals).withColumnsRenamed({"up_one": "box_one", "up_two": "box_two"})
        below = sums.select("box_one", "box_two", (F.col("round") - 1).alias("round"), F.struct("children", "leaves", "saved").alias("below"))
        joined = over.join(below, ["round", "box_one", "box_two"], "left")
        marks = F.transform("lengths", lambda n: F.lit(b""))
        members = joined.select("round", "box_one", "box_two", "up_one", "up_two", "base", "top", "conv", "c", "ends", marks.alias("marks"), "lengths", "below")
        return members.mapInArrow(sweep, _SWEPT)


_TOTALS = ["round", "box_one", "box_two", "up_one", "up_two", "n_children", "n_leaves", "saved_tokens"]
_SWEPT = f"round int, box_one long, box_two long, up_one long, up_two long, {NODE}"


def _nodes(swept: DataFrame) -> DataFrame:
    return swept.where("depth is not null").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def _under_heads(totals: DataFrame) -> DataFrame:
    """Sums of the containers under each head; each container begins with one child of it."""
    return totals.groupBy("round", "up_one", "up_two").agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose members come sorted, and after them one row (without a depth) with the container's sums."""
    out, key, box = [], None, None
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
            if row[:7] != key:
                out += box.closed() if box else []
                key, box = row[:7], _Box(row[:7])
            box.add(*row[7:])
        if len(out) > 4096:
            yield _swept_batch(out)
            out = []
    out += box.closed() if box else []
    yield _swept_batch(out)


class _Box:
    """The nodes of one container; the open ones, from the top down, are the path of the last member."""

    def __init__(self, key: tuple):
        self.key, (self.base, self.top) = key[:5], key[5:]
        self.nodes: list[_Node] = []
        self.path: list[_Node] = []
        self.totals = [0, 0, 0]

    def add(self, conv: int, c: int, ends: bytes | None, marks: list[bytes], lengths: list[int], below: dict | None) -> None:
        same = 0
        while same < len(self.path) and same < len(marks) and self.path[same].mark == marks[same]:
            same += 1
        self._close(same)
        for mark, length in zip(marks[same:], lengths[same:], strict=True):
            node = _Node(mark, length, self.path[-1] if self.path else None)
            self.nodes.append(node)
            self.path.append(node)
        last = self.path[-1]
        last.convs += c
        last.conv = conv if last.conv is None else min(conv, last.conv)
        last.ends = ends or last.ends
        if below:
            last.children += below["children"]
            last.leaves += below["leaves"]
            last.saved += below["saved"]

    def _close(self, upto: int) -> None:
        while len(self.path) > upto:
            node = self.path.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.convs - 1) * node.length
            up = node.parent
            if up is None:
                self.totals = [self.totals[0] + 1, self.totals[1] + node.leaves, self.totals[2] + node.saved]
                continue
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.convs += node.convs
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)

    def closed(self) -> Iterator[tuple]:
        self._close(0)
        none = (None,) * 5
        for node in self.nodes:
            up = node.parent
            node.depth = self.base + 1 if up is None else up.depth + 1
            yield (*none, node.conv, node.depth, self.top if up is None else up.conv, node.convs, node.children, node.leaves, node.saved, node.ends or _NOBODY)
        yield (*self.key, None, None, None, None, *self.totals, None)


class _Node:
    __slots__ = ("children", "conv", "convs", "depth", "ends", "leaves", "length", "mark", "parent", "saved")

    def __init__(self, mark: bytes, length: int, parent: _Node | None):
        self.mark, self.length, self.parent = mark, length, parent
        self.conv, self.ends, self.depth = None, None, 0
        self.convs = self.children = self.leaves = self.saved = 0


def _swept_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["round", "box_one", "box_two", "up_one", "up_two", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    kinds = [pa.int32(), *[pa.int64()] * 11, pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


# --- conversations that begin with turns of another one


def rebuilt(numbered: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that begin like the first of their group: conversation c takes the first
    ``h = crc32(c) % most`` turns of ``c - c % group`` (as far as there are) in the place of its own first h."""
    numbered = staged(numbered, "trie-numbered")
    each = numbered.groupBy("conv").agg(F.any_value("n").alias("n"))
    each = each.select(
        "conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")
    )
    bases = each.select(F.col("conv").alias("base"), F.col("n").alias("_n"))
    taken = F.least("h", F.coalesce("_n", F.lit(0).cast("long")))
    each = staged(each.join(bases, "base", "left").select("conv", "h", "base", taken.alias("taken")), "trie-conversations")
    own = numbered.join(each, "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "mark", "length")
    heads = numbered.where((F.col("place") < most) & (F.col("conv") % group == 0)).select(F.col("conv").alias("base"), "place", "mark", "length")
    given = each.where("taken > 0").join(heads, "base").where("place <= taken").select("conv", "place", "mark", "length")
    return own.union(given), each.select("conv")


def shared_prefixes(conversations: DataFrame, group: int = 100, size: int = SEGMENT, burst: int = BURST) -> DataFrame:
    """The trie of the rebuilt conversations of ``conv_id, turn, role, text``."""
    turns, ids = rebuilt(numbered_turns(conversations), group)
    return build(turns, ids, size, burst)
