"""The prefix trie of conversations, from an LCP-aware merge sort of their turns.

A turn becomes a digest of 16 bytes and a number, so texts are read once and
never move. Conversations are cut into slabs of so many turns; a slab is named
by a digest of all turns before it, so a conversation of any length is rows of
bounded size. Equal slabs become one row. All slabs are then dealt out by
ranges of their order. A task sorts the rows as they come into runs that carry
the length of the prefix shared with the row before (LCP) and only what follows it,
merges the runs with a loser tree that compares from the known LCP on, and
keeps the path of open nodes on a stack: a row whose LCP is shorter closes the
nodes below. What a range's ends, or a slab's, leave open is put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, text_of, tidy_map, written

#: Bytes of a turn's or a node's digest, turns of a slab, bytes of slabs that one task merges at a time, ids hashed as one piece (a power of two).
WIDTH, SLAB, RANGE_BYTES, PIECE_BITS = 16, 256, 32 << 20, 12
ROOT = bytes(WIDTH)
OUT_ROWS = 20_000

NODE = pa.schema([("id", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("chars", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("whole", pa.bool_())])
NODE_SQL = "id binary, parent binary, depth long, n long, least long, chars long, kids long, leaves long, saved long, whole boolean"

Run = list[tuple[int, bytes, list[int], tuple[int, int, int, bool]]]


def _short(digest: Column) -> Column:
    return F.substring(F.unhex(digest), 1, WIDTH)


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, sym, chars): a conversation's turns from 0 in order of turn, null first, ties by digest.

    sym is the digest of role and text, null as empty; chars counts code points
    of the text. Rows without a conversation are left out, repeated rows are
    turns of their own. A conversation may be spread over tasks: rows are dealt
    out by ranges, numbered in each, and what earlier ranges hold is added.
    """
    who, what = text_of(role), text_of(text)
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        _short(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256)).alias("sym"), F.length(what).cast("long").alias("chars"),
    )
    laid = written(rows.repartitionByRange("conv", "turn", "sym").withColumn("part", F.spark_partition_id()), "turns")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier))
    before = sizes.filter("before > 0").select(F.col("conv").alias("c"), F.col("part").alias("p"), "before")
    ranked = laid.withColumn("n", F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "sym")))
    placed = ranked.join(before, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return placed.select("conv", (F.col("n") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "sym", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv, pos, sym, chars, total): every conversation begins with the first h turns of the first of its group, then has its own after its first h.

    h is the unsigned CRC-32 of the decimal id, modulo most; a group's first has
    the id conv - conv % group. A conversation without any turn is one row of pos -1.
    """
    turns = written(turns, "turns")
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    level = own.select("conv", "own", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string")) % most).alias("h"))
    heads = turns.filter((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv").alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "sym", "chars"))).alias("head"))
    taken = F.filter(F.coalesce("head", F.array().cast("array<struct<pos:bigint,sym:binary,chars:bigint>>")), lambda x: x["pos"] < F.col("h"))
    level = level.join(heads, F.col("base") == F.col("b"), "left").withColumn("head", taken)
    level = level.withColumn("total", F.size("head") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    level = written(level.select(F.col("conv").alias("c"), "h", "head", "total"), "rebuilt")
    first = level.select(F.col("c").alias("conv"), F.explode("head").alias("t"), "total").select("conv", "t.pos", "t.sym", "t.chars", "total")
    rest = turns.join(level.select("c", "h", F.size("head").alias("got"), "total"), F.col("conv") == F.col("c")).filter("pos >= h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "sym", "chars", "total")
    none = level.filter("total = 0").select(F.col("c").alias("conv"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("sym"), F.lit(0).cast("long").alias("chars"), "total")
    return first.unionByName(rest).unionByName(none)


def slabs_of(turns: DataFrame, slab: int = SLAB) -> DataFrame:
    """(conv, k, head, syms, chars, more): the turns of each slab; head is the digest of all before, more tells that the conversation goes on."""
    t = F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "sym", "chars"))))
    cut = turns.groupBy("conv", F.floor(F.greatest("pos", F.lit(0)) / slab).alias("k")).agg(t.alias("t"), F.max("total").alias("total"))
    cut = written(cut.select("conv", "k", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["sym"])), "")).alias("syms"), F.col("t.chars").alias("chars"), ((F.col("k") + 1) * slab < F.col("total")).alias("more")), "slabs")
    marks = cut.filter("more").groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.unhex(F.sha2("syms", 256)).alias("d")))), lambda x: x["d"]).alias("ds"))
    chain = F.aggregate("ds", F.array(F.lit(bytearray(ROOT))), lambda acc, d: F.concat(acc, F.array(_short(F.sha2(F.concat(F.element_at(acc, -1), d), 256)))))
    heads = marks.select(F.col("conv").alias("c"), F.posexplode(chain).alias("j", "mark"))
    return cut.join(heads.filter("j > 0"), (F.col("conv") == F.col("c")) & (F.col("k") == F.col("j")), "left").select("conv", "k", F.coalesce("mark", F.lit(bytearray(ROOT))).alias("head"), "syms", "chars", "more")


def shared(x: bytes, y: bytes, start: int) -> int:
    """Symbols that two keys share, of which start are known to be equal."""
    i, end = start * WIDTH, min(len(x), len(y))
    while i < end and x[i : i + WIDTH] == y[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


def run_of(rows: list[tuple[bytes, list[int], tuple[int, int, int, bool]]]) -> Run:
    """Rows in order; each keeps the symbols it shares with the row before as a number and only those that follow."""
    rows.sort(key=lambda r: r[0])
    out: Run = []
    last = b""
    for key, chars, told in rows:
        n = shared(last, key, 0)
        out.append((n, key[n * WIDTH :], chars[n:], told))
        last = key
    return out


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, list[int], tuple[int, int, int, bool]]]:
    """The rows of all runs in order: (symbols shared with the row before, key, chars, what a row tells).

    A loser tree: an inner node holds the run that lost there and how much its
    row shares with the one that beat it. Of two rows the one that shares more with
    the last winner comes first; only where both share as much are symbols compared, from there on.
    """
    live = [r for r in runs if r]
    if not live:
        return
    places, keys, chars, lcps = [0] * len(live), [r[0][1] for r in live], [list(r[0][2]) for r in live], [0] * len(live)
    size = 1
    while size < len(live):
        size *= 2

    def better(a: int, b: int) -> tuple[int, int]:
        if b < 0 or a < 0:
            return (a, b) if b < 0 else (b, a)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        at = shared(keys[a], keys[b], lcps[a])
        won, lost = (a, b) if keys[a][at * WIDTH : (at + 1) * WIDTH] <= keys[b][at * WIDTH : (at + 1) * WIDTH] else (b, a)
        lcps[lost] = at
        return won, lost

    lost, won = [-1] * size, [-1] * size + [i if i < len(live) else -1 for i in range(size)]
    for node in range(size - 1, 0, -1):
        won[node], lost[node] = better(won[2 * node], won[2 * node + 1])
    top = won[1]
    while top >= 0:
        run, at = live[top], places[top]
        yield lcps[top], keys[top], chars[top], run[at][3]
        places[top] = at = at + 1
        now = top
        if at < len(run):
            n, rest, more, _ = run[at]
            keys[top], chars[top], lcps[top] = keys[top][: n * WIDTH] + rest, chars[top][:n] + more, n
        else:
            now = -1
        node = (size + top) // 2
        while node:
            now, lost[node] = better(now, lost[node])
            node //= 2
        top = now


class _Open:
    """A node whose rows still come."""

    __slots__ = ("chars", "depth", "edge", "goes_on", "hash", "id", "kept", "kids", "least", "leaves", "n", "parent", "saved")

    def __init__(self, node: bytes, parent: bytes | None, depth: int, chars: int, edge: bool, hashed: object) -> None:
        self.id, self.parent, self.depth, self.chars, self.edge, self.hash = node, parent, depth, chars, edge, hashed
        self.n = self.kids = self.leaves = self.saved = 0
        self.least: int | None = None
        self.kept = self.goes_on = False

    def row(self, whole: bool) -> tuple:
        here = self.hash is not None or self.id == ROOT  # the top of a later slab counts its members in the slab before
        return self.id, self.parent, self.depth, self.n if here else 0, self.least if here else None, self.chars, self.kids, self.leaves, self.saved, whole


def finished(rows: Iterator[tuple[int, bytes, list[int], tuple[int, int, int, bool]]], slab: int = SLAB) -> Iterator[tuple]:
    """The nodes of ordered rows, each when the last row below it is past, children before parents.

    whole: the node has nothing elsewhere. Those on the path of the first and
    the last row may go on in other ranges, those above the end of a slab that
    several conversations share in other slabs; for these kids, leaves and saved hold their whole children only.
    """
    path: list[_Open] = []

    def close(node: _Open) -> tuple:
        up = path[-1] if path else None
        if node.goes_on and node.n == 1 and not node.edge:
            node.kids, node.leaves = 1, 1
        elif node.goes_on:
            node.kept = True
        part = node.edge or node.kept or up is None
        if not part:
            if not node.kids:
                node.leaves = 1
            node.saved += (node.n - 1) * node.chars
        if up is not None:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
            if part:
                up.kept = True
            else:
                up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + node.leaves, up.saved + node.saved
        return node.row(not part)

    first = True
    for lcp, key, chars, (k, n, least, more) in rows:
        while len(path) > lcp:
            yield close(path.pop())
        size = len(key) // WIDTH
        for at in range(len(path), size):
            if not at:
                path.append(_Open(key[:WIDTH], None, k * slab, 0, first, None))
                continue
            hashed = path[-1].hash.copy() if path[-1].hash is not None else hashlib.sha256()
            hashed.update(key[at * WIDTH : (at + 1) * WIDTH])
            node = hashlib.sha256(key[:WIDTH] + hashed.digest()).digest()[:WIDTH]
            path.append(_Open(node, path[-1].id, k * slab + at, chars[at], first, hashed))
        end = path[-1]
        end.n += n
        end.least = least if end.least is None else min(end.least, least)
        end.goes_on |= more
        first = False
    for node in path:
        node.edge = True
    while path:
        yield close(path.pop())


def _merge(slab: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for batch in batches:
            keys, k, n, least, more, chars = (batch.column(i).to_pylist() for i in range(6))
            runs.append(run_of([(key, [0, *c], told) for key, c, *told in zip(keys, chars, k, n, least, more)]))
        out: list[tuple] = []
        for node in finished(merged(runs), slab):
            out.append(node)
            if len(out) == OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), NODE.types)], schema=NODE)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), NODE.types)], schema=NODE)

    return tidy_map(run)


def _put_together(parts: DataFrame) -> DataFrame:
    """The nodes that ranges and slabs have parts of, with sums over all below them.

    Each node reaches twice as far down in every round, so rounds grow with the
    logarithm of the deepest path of such nodes; each is written, so that lost executors cost one round.
    """
    nodes = parts.groupBy("id").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("chars").alias("chars"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    nodes = written(nodes.filter("n > 0"), "parts")  # the top of a slab of one conversation alone is whole in the slab before
    below = nodes.groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("more"))
    known = nodes.select(F.col("id").alias("up"))
    nodes = nodes.join(below, F.col("id") == F.col("p"), "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).join(known, F.col("parent") == F.col("up"), "left")
    nodes = nodes.withColumn("leaves", F.col("leaves") + (F.col("kids") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("chars"))
    nodes = written(nodes.select("id", "parent", "depth", "n", "least", "kids", "up", "leaves", "saved"), "parts")
    now = nodes.select("id", "up", "leaves", "saved")
    while not now.filter("up IS NOT NULL").isEmpty():
        sums = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("u")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        ahead = now.select(F.col("id").alias("a"), F.col("up").alias("next"))
        then = now.join(sums, F.col("id") == F.col("u"), "left").join(ahead, F.col("up") == F.col("a"), "left")
        now = written(then.select("id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "parts")
    return nodes.drop("leaves", "saved", "up").join(now.drop("up"), "id").select("id", "parent", "depth", "n", "least", "kids", "leaves", "saved")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ordered pieces as they stream by; no list of ids is ever held whole."""
    last, hashed = None, hashlib.sha256()
    for batch in batches:
        ids, out = [], []
        for node, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == last:
                hashed.update(b",")
            else:
                if last is not None:
                    ids.append(last)
                    out.append(hashed.hexdigest())
                last, hashed = node, hashlib.sha256()
            hashed.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], names=["e", "sha"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([hashed.hexdigest()], pa.string())], names=["e", "sha"])


def ends_of(slabs: DataFrame) -> DataFrame:
    """(e, sha): of each node at which conversations end, the SHA-256 of their ids, ascending and comma-joined. Ids come in pieces of a range each, so that a large group of copies is few rows."""
    node = F.when(F.length("syms") == 0, F.col("head")).otherwise(_short(F.sha2(F.concat("head", F.unhex(F.sha2("syms", 256))), 256)))
    pieces = slabs.filter("NOT more").groupBy(node.alias("e"), F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition("e").sortWithinPartitions("e", "piece").select("e", "ids").mapInArrow(tidy_map(_hash_ends), "e binary, sha string")


def prefix_trie(turns: DataFrame, slab: int = SLAB, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per node of the trie of all conversations, all numbers long.

    turns: what rebuilt returns, or ordered_turns with total (turns of the
    conversation). conv_id is a node's smallest member, depth its turns,
    parent_conv_id its parent's conv_id (root: null), n_convs its members,
    n_children its children, n_leaves the childless nodes of its subtree,
    saved_tokens the sum over the subtree of (members - 1) times the code points of
    a node's last text, ends_sha256 the digest of the ids that end at it. No conversations: no rows.
    """
    slabs = written(slabs_of(turns, slab), "slabs")
    rows = slabs.groupBy(F.concat("head", "syms").alias("key"), "k").agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.max("more").alias("more"), F.first("chars").alias("chars"))
    rows = written(rows, "rows")
    size = rows.agg(F.sum(F.length("key") + 8 * F.size("chars"))).first()[0]
    ranges = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks_for(size, range_bytes))
    nodes = written(rows.repartitionByRange(ranges, "key").mapInArrow(_merge(slab), NODE_SQL), "nodes")
    whole = nodes.filter("whole").select("id", "parent", "depth", "n", "least", "kids", "leaves", "saved")
    nodes = written(whole.unionByName(_put_together(nodes.filter("NOT whole"))), "nodes")
    parents = nodes.select(F.col("id").alias("p"), F.col("least").alias("parent_conv_id"))
    out = nodes.join(parents, F.col("parent") == F.col("p"), "left").join(written(ends_of(slabs), "ends"), F.col("id") == F.col("e"), "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
