import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyq.llm import conversation_trie as C
from surveyq.llm import snapshots as S
from surveyq.llm import toxicity as X
from surveyq.llm.common import Shelf
from tests.llm.cases import as_dict, documents, empty

# --- toxicity ------------------------------------------------------------------


def test_cells_are_those_of_the_bytes():
    text = np.frombuffer("Ab é".encode(), np.uint8)
    got = [list(c) for c in X.cells(text)]
    whole = b" ab \xc3\xa9 "
    assert [len(c) for c in got] == [len(whole) - n + 1 for n in X.LENGTHS]
    assert got[0][:2] == list(next(X.cells(np.frombuffer(b"AB ", np.uint8))))[:2]  # A-Z are lowered
    assert not list(X.cells(np.zeros(0, np.uint8)))  # two spaces hold no n-gram


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = np.frombuffer(bytes(range(97, 120)) * 40, np.uint8)
    one = [sorted(np.concatenate([c for c in X.cells(text)]))]
    monkeypatch.setattr(X, "BLOCK", 64)
    assert [sorted(np.concatenate(list(X.cells(text))))] == one


def test_ratios_follow_the_formula():
    counts = np.zeros((2, 1 << X.BITS))
    counts[0, 7], counts[1, 7], counts[0, 9], counts[1, 9] = 3, 30, 50, 1
    found = X.ratios(counts, np.array([100.0, 40.0]), kept=2)
    assert found.place[7] == 0 and found.place[9] == 1
    np.testing.assert_allclose(found.ratio, [np.log(31 / 42) - np.log(4 / 102), np.log(2 / 42) - np.log(51 / 102)])


def test_counts_are_documents_of_each_class(spark):
    rows = [(1, "bad bad words"), (1, "bad"), (0, "good words"), (0, None), (0, "")]
    got = {(r.y, r.cell): r.n for r in X._cell_counts(spark.createDataFrame(rows, "y long, text string").repartition(3)).collect()}
    want = collections.Counter()
    for y, t in rows:
        want.update({(y, c) for found in X.cells(np.frombuffer((t or "").encode(), np.uint8)) for c in found})
    assert got == want


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.classify_toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    out = rows[rows.held_out]
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert out[out.toxic == 1].predicted.mean() > 0.75 and out[out.toxic == 0].predicted.mean() < 0.02
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()


def test_held_out_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"text {'idiot' if i % 3 == 0 else 'fine'} {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (as_dict(X.classify_toxicity(docs, x)) for x in (labels, flipped))
    assert a == b and {r["predicted"] for r in a.values()} == {0, 1}


def test_awkward_documents(spark):
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(1, 11)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    rows = X.classify_toxicity(documents(spark), labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    scored = X.score(documents(spark), X.fit(documents(spark), labels))
    assert scored.columns == [c for c in documents(spark).columns if c != "score"] + ["score"]
    by = as_dict(scored)
    assert by[4]["score"] == by[5]["score"] and by[1]["score"] == by[2]["score"]
    assert X.classify_toxicity(empty(spark), labels).count() == 0
    none = X.classify_toxicity(documents(spark), labels.where("false")).collect()
    assert len(none) == 13 and {r.score for r in none} == {0.0}
    assert X.drop_toxic(documents(spark), labels.where("false")).columns == documents(spark).columns


# --- snapshots -----------------------------------------------------------------


def difference(old, new):
    """Plain pairing by key, then by content in order of keys; rows are (key, text, lang)."""
    # of equal keys the i-th by columns pairs with the i-th
    form = lambda v: (v is not None, v)
    def placed(rows):
        by = collections.defaultdict(list)
        for r in sorted(rows, key=lambda r: [form(v) for v in r]):
            by[r[0]].append(r)
        return {(k, i): r for k, v in by.items() for i, r in enumerate(v)}
    a, b = placed(old), placed(new)
    out = [(b[k][0], a[k][0], "same" if a[k] == b[k] else "update", ",".join(n for n, x, y in zip(("text", "lang"), a[k][1:], b[k][1:]) if x != y)) for k in a.keys() & b.keys()]
    left, right = collections.defaultdict(list), collections.defaultdict(list)
    for mine, rows, other in ((left, a, b), (right, b, a)):
        for k in sorted(rows.keys() - other.keys(), key=lambda k: (form(k[0]), k[1])):
            mine[rows[k][1]].append(rows[k])
    for t in left.keys() | right.keys():
        n = min(len(left[t]), len(right[t]))
        out += [(y[0], x[0], "rekey", "lang" if x[2] != y[2] else "") for x, y in zip(left[t], right[t])]
        out += [(x[0], x[0], "delete", "") for x in left[t][n:]] + [(y[0], None, "insert", "") for y in right[t][n:]]
    return sorted(out, key=str)


SNAP = "k long, text string, lang string"


def diff(spark, old, new, parts=5):
    frames = (spark.createDataFrame(x, SNAP).repartition(parts) for x in (old, new))
    return sorted((tuple(r) for r in S.snapshot_difference(*frames, "k", ["text"], ["text", "lang"]).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_difference_equals_plain_pairing(spark, seed):
    r = random.Random(seed)
    texts = [None, "", "a", "b", "x" * 500, "x" * 501]
    make = lambda lo: [(k, r.choice(texts), r.choice(["en", "de", None])) for k in r.sample(range(lo, lo + 60), 40)]
    old, new = make(0), make(20)
    assert diff(spark, old, new) == difference(old, new)


def test_nulls_repeats_ties_and_empty_snapshots(spark):
    old = [(None, "t", "en"), (1, None, None), (2, "copy", "en"), (3, "copy", "en"), (4, "gone", "en"), (5, "same key", "a"), (5, "same key", "b"), (5, "third", "c")]
    new = [(None, "t", "en"), (1, "", None), (9, "copy", "de"), (8, "copy", "en"), (7, "copy", "en"), (5, "same key", "a"), (5, "same key", "b"), (11, "third", "c")]
    got = diff(spark, old, new)
    assert got == difference(old, new)
    assert (11, 5, "rekey", "") in got and (None, None, "same", "") in got and (7, 2, "rekey", "") in got and (8, 3, "rekey", "lang") not in got
    assert {r[2] for r in diff(spark, old, [])} == {"delete"} and {r[2] for r in diff(spark, [], new)} == {"insert"} and diff(spark, [], []) == []


def test_a_hot_key_and_a_hot_content(spark):
    old = [(1, f"t{i}", None) for i in range(300)] + [(i, "hot", "en") for i in range(1000, 1400)]
    new = [(1, f"t{i}", None) for i in range(0, 300, 2)] + [(-i, "hot", "en") for i in range(1000, 1300)]
    assert diff(spark, old, new, 7) == difference(old, new)


def test_a_filter_never_loses_a_key_and_drops_most_others(spark):
    keys = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("place"))
    words = 4000 * S.BITS_A_KEY // 64
    tested = S.with_filter(spark.range(8000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("place")), S.key_filter(keys, "k", "place", words), "k", "place", words, "maybe")
    there = {r.k for r in tested.where("maybe").select("k").collect()}
    assert there >= set(range(4000)) and len(there) - 4000 < 0.03 * 4000


def test_the_key_join_takes_candidates_only(spark):
    old, new = (spark.createDataFrame([(k, "t", "en")], SNAP) for k in (1, 2))
    out = S.snapshot_difference(old, new, "k", ["text"])
    assert [tuple(r) for r in out.collect()] == [(2, 1, "rekey", "")]
    assert S.snapshot_difference(old.withColumn("n_k", F.lit(1)).withColumn("word", F.lit(2)), new, "k", ["text"]).count() == 1  # names of its own don't clash


# --- conversations -------------------------------------------------------------


def trie(rows, splice=True):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if splice else 0
        built[c] = own.get(int(np.fix(c / 100)) * 100, [])[:h] + turns[h:]
    nodes = collections.defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        ends = sorted(c for c in members if len(built[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in under), len(leaves),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


CONV = T.StructType([*(T.StructField(n, T.LongType()) for n in ("conv_id", "turn")), *(T.StructField(n, T.StringType()) for n in ("role", "text", "c", "d", "h", "part"))])


def conversations(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONV).repartition(parts)


def some_conversations(seed, convs=40, most=7):
    r = random.Random(seed)
    ids = [*range(-30, -30 + convs // 4), *range(0, convs // 4), *range(200, 200 + convs // 2)]
    return [(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bé", None, "long " * 40])) for c in ids for t in range(r.randint(1, most))]


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_plain_sets(spark, seed):
    rows = some_conversations(seed)
    got = sorted((tuple(r) for r in C.prefix_trie_of(conversations(spark, rows)).collect()), key=str)
    assert got == trie(rows)


def test_collisions_are_split(spark):
    rows = some_conversations(5, 24, 5)
    c = F.col("c")
    got = sorted((tuple(r) for r in C.conversation_trie(conversations(spark, rows), c - c % 100, C.shared_turns(c), bits=2).collect()), key=str)
    assert got == trie(rows)


def test_deep_and_wide_tries(spark):
    # snapshots of one growing conversation: a chain of chains; and one long conversation over several ranges
    rows = [(k, t, "user", f"turn {t}") for k in range(1, 20) for t in range(2 * k)] + [(500, t, "user", f"other {t % 3}") for t in range(300)]
    got = sorted((tuple(r) for r in C.conversation_trie(conversations(spark, rows, 6)).collect()), key=str)
    assert got == trie(rows, splice=False)


def test_turnless_null_and_empty_conversations(spark):
    h1 = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(h1, 0, "user", "lost: its base is absent"), (None, 0, "user", "no id"), (7, None, None, None), (7, 0, "", ""), (7, 0, "", "")]
    got = sorted((tuple(r) for r in C.prefix_trie_of(conversations(spark, rows)).collect()), key=str)
    assert got == trie(rows)
    assert C.prefix_trie_of(conversations(spark, [(None, 1, "a", "b")])).count() == 0
    assert C.prefix_trie_of(conversations(spark, [])).count() == 0


def test_scans_carry_over_ranges_and_batches(spark):
    rows = [(c, t, hashlib.sha256(f"{c}.{t}".encode()).digest(), 1) for c, n in ((1, 3), (2, 500), (3, 1), (4, 200)) for t in range(n)]
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        with Shelf(spark) as shelf:
            got = {(r.c, r.place): r.print for r in C.scan_turns(shelf, spark.createDataFrame(rows, "c long, turn long, digest binary, n long")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    want, sums = {}, collections.Counter()
    for c, t, digest, _ in rows:
        sums[c] = (sums[c] + int.from_bytes(digest[:8], "little") * pow(C.BASE, t + 1, 1 << 64)) % (1 << 64)
        want[c, t + 1] = sums[c] - (1 << 64) * (sums[c] >> 63)
    assert got == want


def test_powers():
    places = np.array([0, 1, 5, C._STEP, 3 * C._STEP**2 + 17, -1, -5])
    assert [int(x) for x in C.power(places)] == [pow(C.BASE, int(p), 1 << 64) for p in places]
