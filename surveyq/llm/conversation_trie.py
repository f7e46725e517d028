"""Prefix trie of conversations: equal beginnings are one node.

Turns are dealt by ranges of (conversation, order) and scanned with numpy: a
turn's place and the polynomial fingerprint of the turns up to it, each first
within its range and then with what earlier ranges of the conversation carry
over. A fingerprint is the sum of turn value times BASE^place modulo 2^64,
so the fingerprint of a spliced conversation follows from those of its parts.

Prefixes of one depth and fingerprint are candidates for one node. Every
member's last turn (its SHA-256) and its own prefix's group are compared with the
representative's; where all agree at all depths the prefixes are equal, and
members that differ are split off with a fingerprint of their own.

Nodes whose smallest member is one conversation form a chain, and chains form a
tree. Sums over subtrees are sums over chains by doubling pointers, then a
running sum along each chain, so neither a deep nor a wide trie is one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyq.llm.common import Shelf, join_hot, stored
from surveyq.operators.scans import running

BASE = 0x9E3779B97F4A7C15
#: Most turns that a conversation takes over from another one.
MOST_SHARED = 5
#: Characters of a piece of a list of ids.
PIECE = 1 << 16

_STEP = 1 << 12
_TURN = ("s0", "s1", "s2", "s3", "n")


def _table(base: int) -> np.ndarray:
    out = np.full(_STEP, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = tuple(_table(pow(BASE, _STEP**k, 1 << 64)) for k in range(3))
_BACK = _table(pow(BASE, -1, 1 << 64))


def power(places: np.ndarray) -> np.ndarray:
    """BASE to the places, modulo 2^64; places under 2^36, and from -_STEP."""
    p = np.abs(places).astype(np.int64)
    up = _POWERS[0][p % _STEP] * _POWERS[1][p // _STEP % _STEP] * _POWERS[2][p // _STEP**2 % _STEP]
    return np.where(places < 0, _BACK[p % _STEP], up)


@dataclass
class Carry:
    """What a conversation has had before a row: its number of turns and their fingerprint."""

    conv: int | None = None
    turns: int = 0
    sum: int = 0

    def scan(self, conv: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of consecutive rows sorted by conversation; self becomes what the last row leaves."""
        first = np.ones(len(conv), bool)
        first[1:] = conv[1:] != conv[:-1]
        start = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        before = np.zeros(len(start), np.int64)
        ahead = np.zeros(len(start), np.uint64)
        if conv[0] == self.conv:
            before[0], ahead[0] = self.turns, self.sum
        place = np.arange(len(conv)) - start[of] + 1 + before[of]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power(place))])
        prints = sums[1:] - sums[start][of] + ahead[of]
        self.conv, self.turns, self.sum = int(conv[-1]), int(place[-1]), int(prints[-1])
        return place, prints


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def scan_turns(shelf: Shelf, turns: DataFrame) -> DataFrame:
    """(c, place, print, s0-s3, n) of turns (c, turn, digest, n), ordered by turn with null first and then by digest."""
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "c", "digest", "n")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = Carry()
        for batch in batches:
            if not batch.num_rows:
                continue
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64).reshape(-1, 4)
            place, prints = carry.scan(batch.column("c").to_numpy(), np.ascontiguousarray(digest[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("c"), pa.array(place), _signed(prints), *(_signed(digest[:, k]) for k in range(4)), batch.column("n")],
                ["part", "c", "place", "print", *_TURN],
            )

    here = shelf.stored(dealt.mapInArrow(local, "part int, c long, place long, print long, s0 long, s1 long, s2 long, s3 long, n long"), "turns")
    # a row for each range: its last conversation and what the range has of it, and whether its first one is the same
    ranges = here.groupBy("part").agg(F.min("c").alias("lo"), F.max(F.struct("c", "place", "print")).alias("hi")).orderBy("part").collect()
    carried, now = {}, Carry()
    for r in ranges:
        carried[r.part] = (now.conv, now.turns, now.sum)
        if r.lo == r.hi.c == now.conv:
            shift = int(power(np.array([now.turns]))[0])
            now = Carry(now.conv, now.turns + r.hi.place, (now.sum + shift * r.hi.print) % (1 << 64))
        else:
            now = Carry(r.hi.c, r.hi.place, r.hi.print % (1 << 64))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, prints = batch.column("place").to_numpy().copy(), _unsigned(batch, "print").copy()
            conv, part = batch.column("c").to_numpy(), batch.column("part").to_numpy()
            for p in np.unique(part):
                before, count, total = carried[int(p)]
                mine = np.flatnonzero((part == p) & (conv == before)) if before is not None else []
                if len(mine):
                    place[mine] += count
                    prints[mine] = prints[mine] * power(np.array([count])) + np.uint64(total)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(place), _signed(prints), *(batch.column(x) for x in _TURN)], ["c", "place", "print", *_TURN])

    return here.mapInArrow(whole, "c long, place long, print long, s0 long, s1 long, s2 long, s3 long, n long")


def _spliced(shelf: Shelf, scanned: DataFrame, base: Column, shared: Column, bits: int) -> tuple[DataFrame, DataFrame]:
    """Members (c, d, h, up, s0-s3, n, last) of all prefixes but the empty one, and (c, size) of all conversations, as rebuilt.

    h is the prefix's fingerprint, up that of the prefix one shorter.
    """
    head = F.array(*(F.max(F.when(F.col("place") == k, F.struct("print", *_TURN))) for k in range(1, MOST_SHARED + 1)))
    convs = shelf.stored(scanned.groupBy("c").agg(F.count(F.lit(1)).alias("total"), head.alias("head")), "conversations")
    taken = F.least(F.col("h"), F.coalesce("b_total", F.lit(0)))
    info = convs.select("*", base.alias("b"), shared.cast("int").alias("h")).join(
        convs.select(F.col("c").alias("b"), F.col("total").alias("b_total"), F.col("head").alias("b_head")), "b", "left"
    ).select("c", "total", "head", "h", "b_head", taken.cast("int").alias("taken"))
    at = lambda heads, k: F.when(k > 0, F.get(heads, k - 1)["print"]).otherwise(0)
    info = shelf.stored(info.withColumns({"ahead": at(F.col("b_head"), F.col("taken")), "gone": F.when(F.col("total") > F.col("h"), at(F.col("head"), F.col("h")))}), "spliced")
    mine = join_hot(scanned.where(F.col("place") > shared), info.where("total > h").select("c", "total", "h", "taken", "ahead", "gone"), ["c"], "total", scanned.count())
    mine = mine.select("c", "place", "print", *_TURN, "h", "taken", "ahead", "gone", (F.col("place") == F.col("total")).alias("last"))
    zero = F.lit(0)
    theirs = info.where("taken > 0").select("c", "total", "h", "taken", F.posexplode(F.slice("b_head", 1, F.col("taken"))).alias("k", "t")).select(
        "c", (F.col("k") + 1).cast("long").alias("place"), "t.*", zero.alias("h"), zero.alias("taken"), zero.cast("long").alias("ahead"), zero.cast("long").alias("gone"),
        ((F.col("total") <= F.col("h")) & (F.col("k") + 1 == F.col("taken"))).alias("last"),
    )
    mask = np.uint64((1 << bits) - 1)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shift = batch.column("taken").to_numpy().astype(np.int64) - batch.column("h").to_numpy()
            depth = batch.column("place").to_numpy() + shift
            h = _unsigned(batch, "ahead") + (_unsigned(batch, "print") - _unsigned(batch, "gone")) * power(shift)
            up = h - _unsigned(batch, "s0") * power(depth)
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), pa.array(depth), _signed(h & mask), _signed(up & mask), *(batch.column(x) for x in _TURN), batch.column("last")],
                ["c", "d", "h", "up", *_TURN, "last"],
            )

    rows = mine.unionByName(theirs).mapInArrow(prints, "c long, d long, h long, up long, s0 long, s1 long, s2 long, s3 long, n long, last boolean")
    size = F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))
    return shelf.stored(rows, "members"), info.select("c", size.alias("size"))


_PROOF = ("s0", "s1", "s2", "s3", "up")


def _groups(shelf: Shelf, members: DataFrame) -> DataFrame:
    """(d, h, conv_id, n_convs, up, n, proven) of each depth and fingerprint: proven if all last turns and shorter prefixes agree."""
    ends = [f(x).alias(f"{name}_{x}") for x in _PROOF for name, f in (("lo", F.min), ("hi", F.max))]
    found = members.groupBy("d", "h").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("n"), *ends)
    agree = F.lit(True)
    for x in _PROOF:
        agree &= F.col(f"lo_{x}") == F.col(f"hi_{x}")
    return shelf.stored(found.select("d", "h", "conv_id", "n_convs", "n", F.col("lo_up").alias("up"), agree.alias("proven")), "groups")


def verified(shelf: Shelf, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members and their groups, with fingerprints changed until each group is one prefix.

    A member that differs from its group's representative, the one of smallest
    id, goes on with fingerprints of its own from that depth, which are the same
    for members that differ alike. A round settles the first depth at which a conversation differs.
    """
    while True:
        groups = _groups(shelf, members)
        bad = groups.where("NOT proven").select("d", "h", "n_convs")
        if bad.isEmpty():
            return members, groups
        total = members.count()
        some = shelf.stored(join_hot(members, bad, ["d", "h"], "n_convs", total), "candidates")
        proof = F.struct(*_PROOF)
        chosen = some.groupBy("d", "h").agg(F.min_by(proof, "c").alias("right"), F.count(F.lit(1)).alias("size"))
        wrong = join_hot(some.drop("n_convs"), chosen, ["d", "h"], "size", total).where(proof != F.col("right"))
        split = wrong.groupBy("c").agg(F.min(F.struct("d", F.xxhash64("d", "h", *_PROOF).alias("salt"))).alias("f")).select("c", F.col("f.d").alias("from"), "f.salt")
        lengths = members.groupBy("c").agg(F.count(F.lit(1)).alias("length"))
        split = shelf.stored(split.join(lengths, "c"), "splits")
        changed = join_hot(members, split, ["c"], "length", total)
        own = lambda x, deep: F.when(deep, F.xxhash64(x, "salt")).otherwise(F.col(x)).alias(x)
        moved = changed.select(
            "c", "d", own("h", F.col("d") >= F.col("from")), own("up", F.col("d") > F.col("from")), *_TURN, "last"
        )
        members = shelf.stored(members.join(split.select("c"), "c", "left_anti").unionByName(moved), "members")


def _chain_sums(shelf: Shelf, chains: DataFrame) -> DataFrame:
    """(chain, w, l): sums of w and l over each chain and all chains below it, of chains (chain, above, w, l); above is null at the root.

    Each round adds up the sums of those that point at a chain and doubles the
    pointers, so the rounds are the logarithm of the height.
    """
    state = shelf.stored(chains, "chains")
    while not state.where("above IS NOT NULL").isEmpty():
        adds = state.where("above IS NOT NULL").groupBy(F.col("above").alias("chain")).agg(F.sum("w").alias("aw"), F.sum("l").alias("al"), F.count(F.lit(1)).alias("k"))
        summed = shelf.stored(
            state.join(adds, "chain", "left").select(
                "chain", "above", (F.col("w") + F.coalesce("aw", F.lit(0))).alias("w"), (F.col("l") + F.coalesce("al", F.lit(0))).alias("l"), "k"
            ), "sums",
        )
        pointed = summed.where("k IS NOT NULL").select(F.col("chain").alias("above"), F.col("above").alias("next"), "k")
        hops = join_hot(summed.where("above IS NOT NULL").drop("k"), pointed, ["above"], "k", summed.count())
        state = shelf.stored(hops.select("chain", F.col("next").alias("above"), "w", "l").unionByName(summed.where("above IS NULL").select("chain", "above", "w", "l")), "chains")
    return state.select("chain", "w", "l")


def _digests(shelf: Shelf, ends: DataFrame) -> DataFrame:
    """(d, h, ends_sha256): SHA-256 of each node's decimal ids c, ascending, comma-joined.

    Ranges of (node, id) write their ids as pieces of text, and one task hashes
    a node's pieces in order, as SHA-256 has to be, without holding them.
    """
    order = ["d", "h", "c"]

    def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size, done, held = None, 0, [], 0, [], 0
        for batch in batches:
            for d, h, c in zip(*(batch.column(x).to_pylist() for x in order)):
                if (d, h) != key or size > PIECE:
                    if ids:
                        done.append((*key, first, ",".join(ids)))
                        held += size
                    key, first, ids, size = (d, h), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if done and (held > 16 * PIECE or len(done) > PIECE):
                yield batch_of(done, [*order, "ids"])
                done, held = [], 0
        if ids:
            yield batch_of([*done, (*key, first, ",".join(ids))], [*order, "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, names = None, None, ["d", "h", "ends_sha256"]
        for batch in batches:
            done = []
            for d, h, ids in zip(*(batch.column(x).to_pylist() for x in ("d", "h", "ids"))):
                if (d, h) == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (d, h), hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield batch_of(done, names)
        if key is not None:
            yield batch_of([(*key, sha.hexdigest())], names)

    pieces = shelf.stored(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "d long, h long, c long, ids string"), "pieces")
    return pieces.repartition("d", "h").sortWithinPartitions(*order).mapInArrow(digest, "d long, h long, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame, base: Column | None = None, shared: Column | None = None, bits: int = 64,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the nodes of the trie, the root included.

    Conversations are ordered by turn, null first; turns of one number by the SHA-256 of role and text. A null role or text is empty. Rows
    without an id belong to no conversation and count nowhere; repeated rows are turns of their own. With base and shared (expressions over
    c, the id) a conversation is rebuilt first: the first `shared` turns (MOST_SHARED at most) of conversation `base`, then its
    own after its first `shared`. An empty table has no node. conv_id is a node's smallest member;
    saved_tokens counts, over a subtree, code points of last texts that members beyond the first repeat. Other columns are not read.
    bits is the width of a fingerprint; whatever it is, groups are verified.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    content = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), F.char_length(text).cast("long").alias("n")
    )
    with Shelf(conversations.sparkSession) as shelf:
        scanned = scan_turns(shelf, turns)
        members, convs = _spliced(shelf, scanned, F.col("c") if base is None else base, F.lit(0) if shared is None else shared, bits)
        members, groups = verified(shelf, members)
        root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
        root = root.select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("h"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("up"))
        every = groups.drop("proven").unionByName(root)
        kids = every.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("up").alias("h")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = shelf.stored(every.join(kids, ["d", "h"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
        tops = nodes.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("h").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("k"))
        below = join_hot(nodes.where("d > 0"), tops, ["d", "up"], "k", nodes.count()).drop("k")
        weight, leaf = ((F.col("n_convs") - 1) * F.col("n")).alias("w"), (F.col("n_children") == 0).cast("long").alias("l")
        linked = shelf.stored(below.unionByName(nodes.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).select("*", weight, leaf), "linked")
        top = F.min(F.struct("d", "parent_conv_id"))
        chains = shelf.stored(
            linked.groupBy(F.col("conv_id").alias("chain")).agg(top.alias("top"), F.sum("w").alias("w"), F.sum("l").alias("l"))
            .select("chain", F.col("top.parent_conv_id").alias("above"), (F.col("top.d") - 1).alias("from"), "w", "l"), "tops",
        )
        sums = _chain_sums(shelf, chains.select("chain", "above", "w", "l"))
        hung = chains.where("above IS NOT NULL").drop("w", "l").join(sums, "chain").groupBy(F.col("above").alias("conv_id"), F.col("from").alias("d")).agg(F.sum("w").alias("hw"), F.sum("l").alias("hl"))
        loaded = linked.join(hung, ["conv_id", "d"], "left").withColumns({x: F.col(x) + F.coalesce(f"h{x}", F.lit(0)) for x in ("w", "l")}).drop("hw", "hl")
        rolled = running(loaded, ["conv_id"], [F.desc("d")], {"saved_tokens": ("sum", "w"), "n_leaves": ("sum", "l")})
        ended = members.where("last").select("d", "h", "c").unionByName(convs.where("size = 0").select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("h"), "c"))
        out = rolled.join(_digests(shelf, ended), ["d", "h"], "left").select(
            "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
        return stored(out, "trie")


def shared_turns(c: Column) -> Column:
    """How many turns conversation c takes over: crc32 of its decimal id modulo 6."""
    return F.crc32(c.cast("string").cast("binary")) % 6


def prefix_trie_of(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt on the first turns of conversation c - c % 100."""
    c = F.col("c")
    return conversation_trie(conversations, c - c % 100, shared_turns(c))
