"""Near-duplicates by an LSH forest over MinHash signatures.

1. Every text becomes its set of word shingles (64-bit hashes), a 128-bit hash
   of that set, and a MinHash signature. Equal sets are one node from here on.
2. Each of `TREES` trees has its own sequence of signature values and sorts the
   nodes by it: a range partition, sorted. Nodes that follow each other with a
   common prefix of DEPTH values are a region, over borders of partitions too.
   A region of more than `BUCKET` nodes is dense: there the prefix grows, up to
   DEEPEST values, in more trees over further values that only nodes of dense
   regions get; no two trees of a depth share a value.
3. Two nodes of a region are candidates if their whole signatures can belong to
   similar sets. Each pair is taken up by one tree of a depth, the first that
   brings it together. The candidates of a region fall into parties, the
   components of its candidate pairs; only a party's members are written.
4. A party's members meet with their whole sets. Its candidate pairs, the most
   alike first, are compared unless links found before join them already.
5. Components of the confirmed links; each document gets the smallest id.

Regions above a fixed size are split into blocks that meet in pairs, so no task
holds a whole hot group and no pair of it is left out; no pair is ever written
but confirmed links, fewer than a party has members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyq.llm.common import SOLID, Shelf, Texts, fresh, give_back, join_hot, mix, split_by_keys, stored, with_text_batches, without, words_of
from surveyq.llm.graph import components

WIDTH = 5
TREES, DEPTH, DEEPEST = 21, 3, 8
VALUES = TREES * DEPTH
#: Nodes that make a bucket dense, so that its prefix grows.
BUCKET = 4096
#: Nodes whose signatures one comparison holds: regions up to the first number stay whole, and no comparison has many more than the second.
SIGNATURES = (256, 4096)
#: Nodes, and shingles in all, that one comparison of whole sets holds; single larger sets meet in pairs.
SETS = (512, 2 << 20)
#: Share of the pairs at the threshold whose signatures may agree in fewer values than asked.
UNLIKE = 3e-6
#: The trees of a deeper depth miss a link this many times more rarely than those of the first, so that all depths together add a sixth.
RARER = 30
_FIRST_OF_ALL = -(1 << 63)

_RANDOM = np.random.default_rng(20240607)
_A = (_RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_DEEP_SEED = 20240608
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: Texts, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than `width` are one shingle, none is none."""
    words = words_of(texts, SOLID)
    h, n = words.hash, len(words.hash)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += h[k : k + len(rolled)] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            # the length is part of the hash: "a b" is not the start of a longer shingle
            short = np.sum(h[a:b] * _PLACE[: b - a], dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def signature(shingles: np.ndarray, times: np.ndarray = _A, plus: np.ndarray = _B) -> np.ndarray:
    """MinHash values of 16 bits, VALUES of them: the low bits of the least 32-bit hash of each function."""
    least = np.full(len(times), (1 << 32) - 1, np.uint64)
    step = max(1, 4096 * VALUES // len(times))
    for a in range(0, len(shingles), step):
        part = shingles[a : a + step, None] * times + plus
        np.minimum(least, (part >> np.uint64(32)).min(axis=0), out=least)
    return least.astype(np.uint16)


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """(ord, mark, n, node, sig) of every row; node: hash of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in with_text_batches(batches, "body"):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["ord", "mark", "n", "node", "sig"],
            )

    return docs.select("ord", "mark", "body").mapInArrow(run, "ord long, mark long, n long, node binary, sig binary")


def _further(shelf: Shelf, docs: DataFrame, members: DataFrame, width: int, values: int) -> DataFrame:
    """(node, sig) of members (node, ord, mark): `values` MinHash values from the texts, by functions of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(_DEEP_SEED)
        # one draw for each function, so that more values begin with the same ones
        drawn = random.integers(0, 1 << 63, (values, 2), dtype=np.uint64)
        times, plus = (drawn[:, 0] << np.uint64(1)) | np.uint64(1), drawn[:, 1]
        for batch, texts in with_text_batches(batches, "body"):
            found = [signature(s, times, plus).tobytes() for s in shingle_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "sig"])

    members = shelf.stored(members, "dense-members")
    possible, _ = split_by_keys(shelf, docs, members, ["ord", "mark"])
    texts = possible.join(members.hint("shuffle_hash"), ["ord", "mark"]).select("node", "body")
    # rows can share both id and text
    return texts.mapInArrow(run, "node binary, sig binary").dropDuplicates(["node"])


def _trees(depth: int, similarity: float) -> int:
    """Trees that miss a link of this similarity RARER times less often than TREES trees of the first depth do, and no fewer."""
    if depth == DEPTH or similarity >= 1:
        return TREES
    missed = TREES * math.log1p(-(similarity**DEPTH)) - math.log(RARER)
    return max(TREES, math.ceil(missed / math.log1p(-(similarity**depth))))


def _agreeing(similarity: float) -> int:
    """The most signature values to ask of a pair so that at most UNLIKE of those at this similarity have fewer, by the binomial tail."""
    below, k = 0.0, 0
    while k < VALUES:
        below += math.comb(VALUES, k) * similarity**k * (1 - similarity) ** (VALUES - k)
        if below > UNLIKE:
            break
        k += 1
    return k


def _label(tree: int, depth: int):
    """The values of a tree, as bytes that sort."""
    return F.substring("sig", 2 * depth * tree + 1, 2 * depth)


def _regions(rows: DataFrame, depth: int, trees: int, shelf: Shelf) -> DataFrame:
    """(tree, g, node, n) of the nodes (node, sig) in regions of two or more; g names the region and n is its size.

    Each tree's order is a range of one range partition. A region inside a
    partition is counted where it lies. One that touches a border, or is too
    long to be held, is counted over all partitions: there are at most two a
    partition, and one for each BUCKET rows.
    """
    placed = rows.select("node", F.posexplode(F.array(*(_label(t, depth) for t in range(trees)))).alias("tree", "label"))
    ordered = placed.select("tree", "label", "node").repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        rows_in = ((b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) for b in batches)
        held: list[bytes] = []
        last, open_ = None, True  # the region at hand; whether it may go on in another partition or was given out in part
        out: list[tuple[int, bytes, bytes, int | None]] = []

        def give(whole: bool) -> None:
            n = len(held) if whole else None
            if n != 1:
                out.extend((*last, node, n) for node in held)
            held.clear()

        for trees_in, labels, nodes in rows_in:
            for key in zip(trees_in, labels, nodes):
                if key[:2] != last:
                    if last is not None:
                        give(not open_)
                        open_ = False
                    last = key[:2]
                elif len(held) > BUCKET:
                    open_ = True
                    give(False)
                held.append(key[2])
            if out:
                yield _batch(out, "tree label node n")
                out.clear()
        if last is not None:
            give(False)
            yield _batch(out, "tree label node n")

    found = shelf.stored(ordered.mapInArrow(run, "tree int, label binary, node binary, n long"), f"order-{depth}")
    open_ = found.where("n IS NULL").drop("n")
    sizes = shelf.stored(open_.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n")), "open-regions")
    counted = open_.join(F.broadcast(sizes), ["tree", "label"]).where("n > 1")
    return found.where("n IS NOT NULL").unionByName(counted).select("tree", F.xxhash64(F.lit(depth), "tree", "label").alias("g"), "node", "n")


_KINDS = {"tree": pa.int32(), "n": pa.int64(), "g": pa.int64(), "party": pa.int64(), "size": pa.int64()}


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS.get(n, pa.binary())) for c, n in zip(columns, names.split())], names.split())


def _tree_keys(sigs: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """32-bit hashes, not 0, of each tree's values; a row a node."""
    parts = sigs[:, : depth * trees].reshape(len(sigs), trees, depth).astype(np.uint64)
    hashed = np.zeros(parts.shape[:2], np.uint64)
    for k in range(depth):
        hashed = mix(hashed ^ (parts[:, :, k] + np.uint64((k + 1) << 20)))
    return (hashed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


_PLACED = "g long, tree int, n long, node binary, sig binary, keys binary"


def _members(kept: DataFrame, rows: DataFrame, reps: DataFrame, depth: int, trees: int) -> DataFrame:
    """_PLACED of the regions kept (tree, g, node, n): keys are those of the node's trees whose regions are kept, else 0.

    rows have the values that the trees sort by; reps have the signature.
    """
    lists = kept.groupBy("node").agg(F.collect_list(F.struct("g", "tree", "n")).alias("regions"))
    joined = lists.join(rows.select("node", F.col("sig").alias("values")), "node").join(reps.select("node", "sig"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            if not len(batch):
                continue
            regions = batch.column("regions")
            flat = regions.flatten()
            of = np.repeat(np.arange(len(batch)), np.diff(regions.offsets.to_numpy()))
            tree = flat.field(1).to_numpy()
            values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint16).reshape(len(batch), -1)
            every, keys = _tree_keys(values, depth, trees), np.zeros((len(batch), trees), np.uint32)
            keys[of, tree] = every[of, tree]
            take = pa.array(of)
            packed = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [flat.field(0), flat.field(1), flat.field(2), batch.column("node").take(take), batch.column("sig").take(take), packed.take(take)],
                ["g", "tree", "n", "node", "sig", "keys"],
            )

    return joined.mapInArrow(run, _PLACED)


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (_PLACED) with g replaced, and block and own: large regions are split so that any two rows of one still meet.

    A split region is dealt by a hash of its nodes into blocks, and every two
    blocks form a group. There are enough blocks to give each shuffle
    partition some pairs, as far as a pair keeps SIGNATURES[0] rows, and always
    so many that a pair has about SIGNATURES[1] rows at most. Two rows of one
    block meet in many groups and are compared in the one where own holds.
    """
    few, most = SIGNATURES
    spread = math.ceil(math.sqrt(8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    n = F.col("n")
    parts = F.least(F.ceil(n * 2 / few), F.greatest(F.ceil(n * 2 / most), F.lit(spread))).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    others = F.transform(
        F.filter(F.sequence(F.lit(0), parts - 1), lambda o: o != mine),
        lambda o: F.struct(F.xxhash64("g", F.least(mine, o), F.greatest(mine, o)).alias("g"), mine.alias("block"), (o == F.pmod(mine + 1, parts)).alias("own")),
    )
    whole = F.array(F.struct(F.xxhash64("g").alias("g"), F.lit(0).alias("block"), F.lit(True).alias("own")))
    return rows.withColumn("at", F.explode(F.when(n <= few, whole).otherwise(others))).select("at.*", "tree", "node", "sig", "keys")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of equal first column, over batch borders."""
    give_back()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        if held and held[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _parties(group: pa.Table, need: int) -> list[tuple[int, bytes, int]]:
    """(party, node, size) of the nodes of a region that have a candidate which no earlier tree brings them to."""
    n = len(group)
    if n < 2:
        return []
    sigs, keys = _matrix(group["sig"], np.uint16), _matrix(group["keys"], np.uint32)
    tree = group["tree"][0].as_py()
    block, own = group["block"].to_numpy(), group["own"].to_numpy()
    root = list(range(n))
    for i in range(n - 1):
        like = i + 1 + np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(axis=1) >= need)
        if not own[i]:
            like = like[block[like] != block[i]]
        if tree and len(like):
            met = (keys[like, :tree] == keys[i, :tree]) & (keys[i, :tree] != 0)
            like = like[~met.any(axis=1)]
        for j in like.tolist():
            a, b = _find(root, i), _find(root, j)
            if a != b:
                root[max(a, b)] = min(a, b)
    members: dict[int, list[int]] = {}
    for i in range(n):
        members.setdefault(_find(root, i), []).append(i)
    g, nodes = group["g"][0].as_py(), group["node"].to_pylist()
    out = []
    for first, found in members.items():
        if len(found) > 1:
            name = hashlib.blake2b(g.to_bytes(8, "little", signed=True) + nodes[first], digest_size=8).digest()
            out.extend((int.from_bytes(name, "little", signed=True), nodes[i], len(found)) for i in found)
    return out


def _split_parties(members: DataFrame, shelf: Shelf) -> DataFrame:
    """(g, node, ord, mark, sig) of members (party, node, size, ord, mark, sig, n); parties of more than SETS are split into blocks that meet in pairs."""
    most, shingles = SETS
    # a party has at most SIGNATURES[1] members or so; its shingles are counted where their number may be too large
    total = members.groupBy("party").agg(F.sum("n").alias("total"), F.max("size").alias("size")).where((F.col("total") > shingles) | (F.col("size") > most))
    large = shelf.stored(total.select("party", "total"), "large-parties")
    sized = members.join(large, "party", "left")
    parts = F.least(F.greatest(F.ceil(F.col("size") * 2 / most), F.ceil(F.col("total") * 2 / shingles)), F.col("size")).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(3), "node"), parts).cast("int")
    others = F.transform(
        F.filter(F.sequence(F.lit(0), parts - 1), lambda o: o != mine),
        lambda o: F.xxhash64("party", F.least(mine, o), F.greatest(mine, o)),
    )
    groups = F.when(F.col("total").isNull() | (parts < 2), F.array("party")).otherwise(others)
    return sized.select(F.explode(groups).alias("g"), "node", "ord", "mark", "sig")


def _confirmed(group: pa.Table, need: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a party (g, node, sig, shingles): candidate pairs whose sets are similar."""
    n = len(group)
    if n < 2:
        return []
    sigs = _matrix(group["sig"], np.uint16)
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["shingles"]]
    size = np.array([len(s) for s in sets], np.int64)
    ones, others, alike = [], [], []
    for i in range(n - 1):
        same = (sigs[i + 1 :] == sigs[i]).sum(axis=1)
        # the smaller set has to hold the share of the larger alone
        j = np.flatnonzero((same >= need) & (den * np.minimum(size[i + 1 :], size[i]) >= num * np.maximum(size[i + 1 :], size[i])))
        ones.append(np.full(len(j), i))
        others.append(i + 1 + j)
        alike.append(same[j])
    ones, others, alike = np.concatenate(ones), np.concatenate(others), np.concatenate(alike)
    order = np.argsort(-alike.astype(np.int64), kind="stable")
    root, out = list(range(n)), []
    for i, j in zip(ones[order].tolist(), others[order].tolist()):
        a, b = _find(root, i), _find(root, j)
        if a == b:
            continue
        small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[at] == small).sum())
        if den * both >= num * (int(size[i]) + int(size[j]) - both):
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _edges(rows: DataFrame, need: int, num: int, den: int) -> DataFrame:
    """Links (a, b) inside each group of rows (g, node, sig, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            if found := _confirmed(group, need, num, den):
                nodes = group["node"]
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(x)).combine_chunks() for x in zip(*found)], ["a", "b"])

    return rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "a binary, b binary")


def _forest(reps: DataFrame, similarity: float, further: Callable[[DataFrame, int], DataFrame], shelf: Shelf) -> DataFrame:
    """_PLACED rows of all regions of two or more nodes.

    Nodes of a region of more than BUCKET nodes go on at the next depth, in as
    many more trees as keep the recall, up to DEEPEST values. They get as many
    signature values as the trees of any deeper depth take (further), once.
    """
    rows, depth, out = reps.select("node", "sig"), DEPTH, []
    while True:
        trees = _trees(depth, similarity)
        regions = _regions(rows, depth, trees, shelf)
        kept = regions if depth == DEEPEST else regions.where(F.col("n") <= BUCKET)
        out.append(_members(kept, rows, reps, depth, trees))
        dense = regions.where(F.col("n") > BUCKET).select("node").distinct()
        if depth == DEEPEST or dense.isEmpty():
            break
        if depth == DEPTH:
            values = max(d * _trees(d, similarity) for d in range(DEPTH + 1, DEEPEST + 1))
            more = further(dense.join(reps.select("node", "ord", "mark"), "node"), values)
        else:
            more = dense.join(rows, "node")
        depth += 1
        rows = shelf.stored(more, f"dense-{depth}")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def _rows(docs: DataFrame, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """docs with an id that is never null, a text that is never null and the text's hash, under these names."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(dict(zip(names, (F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_OF_ALL).cast("long")), body, F.xxhash64(body)))))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", ["ord", "body", "mark"]).select("ord", "mark", "body")


def _links(narrow: DataFrame, reps: DataFrame, num: int, den: int, width: int, shelf: Shelf) -> DataFrame:
    """Confirmed links (a, b) that join all similar nodes of reps (node, ord, mark, sig, n)."""
    need = _agreeing(num / den)
    further = lambda members, values: _further(shelf, narrow, members, width, values)
    placed = _blocks(_forest(reps, num / den, further, shelf)).repartition("g").sortWithinPartitions("g", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            if found := _parties(group, need):
                yield _batch(found, "party node size")

    parties = shelf.stored(placed.mapInArrow(run, "party long, node binary, size long"), "parties")
    members = _split_parties(parties.join(reps.select("node", "ord", "mark", "sig", "n"), "node"), shelf)
    wanted = shelf.stored(members.groupBy("node").agg(F.first("ord").alias("ord"), F.first("mark").alias("mark"), F.first("sig").alias("sig"), F.collect_list("g").alias("gs")), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in with_text_batches(batches, "body"):
            found = pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())
            times = np.diff(batch.column("gs").offsets.to_numpy())
            of = np.repeat(np.arange(len(batch)), times)
            # a set goes to all its groups; few rows at a time, as they may be long
            for a in range(0, len(of), 64):
                take = pa.array(of[a : a + 64])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("gs").flatten()[a : a + 64], batch.column("node").take(take), batch.column("sig").take(take), found.take(take)],
                    ["g", "node", "sig", "shingles"],
                )

    # only texts that may be members are shuffled; the few members are the build side, so that texts aren't sorted
    texts, _ = split_by_keys(shelf, narrow, wanted, ["ord", "mark"])
    joined = texts.join(wanted.hint("shuffle_hash"), ["ord", "mark"]).select("node", "sig", "gs", "body")
    return shelf.stored(
        _edges(joined.mapInArrow(sets, "g long, node binary, sig binary, shingles binary"), need, num, den), "links"
    )


def _labels(narrow: DataFrame, num: int, den: int, width: int, shelf: Shelf) -> DataFrame:
    """(ord, mark, n, component, kept) of every row of (ord, mark, body)."""
    nodes = shelf.stored(_nodes(narrow, width), "nodes")
    reps = shelf.stored(
        nodes.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("ord", "mark", "sig", "n")).alias("r"), F.count(F.lit(1)).alias("copies"))
        .select("node", "r.ord", "r.mark", "r.sig", "r.n", "copies"),
        "reps",
    )
    n_nodes, n_reps = reps.agg(F.sum("copies"), F.count(F.lit(1))).head()
    roots = shelf.stored(components(_links(narrow, reps, num, den, width, shelf), shelf), "roots")
    named = roots.join(reps.select("node", "ord"), "node")
    sizes = named.groupBy("root").agg(F.min("ord").alias("least"), F.count(F.lit(1)).alias("size"))
    sized = join_hot(roots, shelf.stored(sizes, "components"), ["root"], "size", n_reps)
    found = shelf.stored(
        reps.join(sized.select("node", "least"), "node", "left").select("node", F.coalesce("least", "ord").alias("component"), "copies"), "found"
    )
    component = F.coalesce(F.col("component"), F.col("ord"))
    narrow_nodes = nodes.select("ord", "mark", "n", "node")
    labelled = join_hot(narrow_nodes, found, ["node"], "copies", n_nodes or 0).select("ord", "mark", "n", "component")
    wordless = narrow_nodes.where("node IS NULL").select("ord", "mark", "n", F.lit(None).cast("long").alias("component"))
    return labelled.unionByName(wordless).select(
        "ord", "mark", "n", F.when(component != _FIRST_OF_ALL, component).alias("component"), (component == F.col("ord")).alias("kept")
    )


def near_duplicate_ids(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = WIDTH
) -> DataFrame:
    """As near_duplicates, but only id, n_shingles, component_id and kept: a table in the shared folder."""
    with Shelf(docs.sparkSession) as shelf:
        labels = stored(_labels(_narrow(docs, id_col, text_col), num, den, width, shelf), "near-duplicates")
    return labels.select(
        F.when(F.col("ord") != _FIRST_OF_ALL, F.col("ord")).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = WIDTH
) -> DataFrame:
    """Components of documents whose shingle sets have den * |A & B| >= num * |A | B|.

    Returns docs with n_shingles, component_id (smallest id reachable, itself
    included) and kept (id = component_id).

    Null and empty texts, and texts of white space, have an empty set: they are
    linked with nothing and kept. Ids are integers; a null id counts as smaller
    than every other and its component_id is null, kept true. Of rows that
    share their id and are each other's copies, all are kept. Extra columns of
    any name pass through; columns with the names added are replaced. An empty
    table gives none. Two different sets of one 128-bit hash, or shingles of
    one 64-bit hash, would count as equal.
    """
    docs = docs.drop("n_shingles", "component_id", "kept")
    order, body, mark = names = fresh([*docs.columns, "n_shingles", "component_id", "kept"], "order", "body", "mark")
    with Shelf(docs.sparkSession) as shelf:
        # equal rows have equal labels; one of each joins back to all
        labels = stored(_labels(_narrow(docs, id_col, text_col), num, den, width, shelf).dropDuplicates(["ord", "mark"]), "near-duplicates")
    renamed = labels.select(F.col("ord").alias(order), F.col("mark").alias(mark), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")
    return _rows(docs, id_col, text_col, names).join(renamed, [order, mark]).select(*docs.columns, "n_shingles", "component_id", "kept")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, width: int = WIDTH
) -> DataFrame:
    """docs without the rows that near_duplicates would not keep; columns as they are, and texts that surely stay aren't shuffled."""
    order, body, mark = names = fresh(docs.columns, "order", "body", "mark")
    with Shelf(docs.sparkSession) as shelf:
        labels = _labels(_narrow(docs, id_col, text_col), num, den, width, shelf).where("NOT kept")
        gone = stored(labels.select(F.col("ord").alias(order), F.col("mark").alias(mark)).distinct(), "near-duplicates")
    return without(Shelf(docs.sparkSession), _rows(docs, id_col, text_col, names), gone, [order, mark]).select(*docs.columns)
