import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveyq.llm import decontaminate as D
from surveyq.llm import line_dedup as LD
from surveyq.llm import near_dup as N
from surveyq.llm.graph import components
from surveyq.llm.packing import SIZE, cut, pack, plan, slots
from surveyq.llm.quality import classify, estimate_prior, fit, keep_good, label_share, risk, score, train
from surveyq.llm.sharding import assign_shards, jump_hash
from tests.llm.cases import BODY, LONG, ROWS, as_dict, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM_RE, SOLID_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# --- sharding ------------------------------------------------------------------


def jump(key, shards):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 100])
def test_jump_hash_equals_the_published_loop(spark, shards):
    keys = [0, 1, 2, 3, -1, -(1 << 63), (1 << 63) - 1, *(i * 0x9E3779B97F4A7C15 % (1 << 63) for i in range(200))]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash(F.col("k"), shards).alias("s")).collect()
    assert [r.s for r in rows] == [jump(k, shards) for k in keys]


def check_shards(rows, source):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in source)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_shards(spark, corpus):
    check_shards(assign_shards(documents(spark)).collect(), ROWS)
    check_shards(assign_shards(corpus, slot_parts=3).collect(), [(r.doc_id, r.text) for r in corpus.collect()])
    assert assign_shards(empty(spark)).count() == 0


# --- line dedup ------------------------------------------------------------------


def deduped(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := x.translate(LOWER).strip(" \t\n\x0b\f\r")) < 10 or first.setdefault(k, i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(spark, corpus, batches, fanout):
    extra = [(30, "x" * 9), (31, "x" * 9), (32, "y" * 10 + "\n"), (33, "\n\n Y" + "y" * 9 + "\t"), (34, "É" * 10), (35, "é" * 10), (36, LONG[:3000] + "\n" + BODY)]
    rows = [*ROWS, *extra]
    got = LD.dedup_lines(documents(spark, rows), batches=batches, fanout=fanout)
    assert "g" in got.columns and "line" in got.columns
    assert collections.Counter((r.doc_id, r.line_count, r.lines_dropped, r.text) for r in got.collect()) == deduped(rows)
    if batches == 4:
        got = LD.dedup_lines(corpus, batches=4).collect()
        assert collections.Counter((r.doc_id, r.line_count, r.lines_dropped, r.text) for r in got) == deduped([(r.doc_id, r.text) for r in corpus.collect()])
        assert LD.dedup_lines(empty(spark)).count() == 0


def test_runs_are_levelled(spark):
    runs = LD.LineRuns(spark, fanout=2)
    for k in range(5):
        rows = spark.range(k * 10, k * 10 + 15).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(k).cast("long").alias("first"), F.lit(k).cast("long").alias("last"))
        fresh = runs.add(runs.unseen(rows))
        assert fresh.count() == (15 if k == 0 else 10)
        runs.compact()
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.h1 for t in runs.tables() for r in t.collect()) == list(range(55))
    runs.close()


def _keyed(spark, begin, end):
    return spark.range(begin, end).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(7), "id").alias("h2"), F.col("id").alias("ord"))


def test_runs_are_merged_in_written_order(spark):
    """Neither meeting the runs nor merging them sorts or shuffles a run again."""
    with LD.LineRuns(spark, fanout=4) as runs, LD.in_written_order(spark):
        for k in range(3):
            firsts = _keyed(spark, k * 1000, k * 1000 + 1500).groupBy("h1", "h2").agg(F.min("ord").alias("first"))
            marked = runs.marked(firsts)
            plan = marked._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Sort [") == (k > 0) and plan.count("Exchange hashpartitioning") == 1
            table = LD.write_buckets(marked, runs.buckets, f"keys_{k}", f"{runs.root}-keys-{k}")
            runs.add(table.where(~F.col("seen")))
            spark.sql(f"DROP TABLE keys_{k}")
        a, b, _ = runs.tables()
        merged = a.join(b.withColumnRenamed("first", "other").hint("merge"), ["h1", "h2"], "full")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Sort [" not in plan and "Exchange" not in plan


def test_runs_stay_in_their_folder(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    days = [[(5, "a line that two days share\nonly here, and once"), (6, "a line that two days share")], [(1, "a line that two days share\nnew on the second day"), (2, "new on the second day")]]
    got = [
        {r.doc_id: (r.text, r.lines_dropped) for r in LD.dedup_lines(spark.createDataFrame(day, "doc_id long, text string"), batches=2, runs=path).collect()}
        for day in [*days, days[0]]
    ]
    assert got[0] == {5: ("a line that two days share\nonly here, and once", 0), 6: ("", 1)}
    assert got[1] == {1: ("new on the second day", 1), 2: ("", 1)}
    assert got[2] == {5: ("", 2), 6: ("", 1)}
    with LD.LineRuns(spark, path=path) as runs:
        assert sum(t.count() for t in runs.tables()) == 3
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("surveyq_batch")]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("surveyq_")]


def test_extra_columns_of_any_name(spark):
    names = ["order", "body", "mark", "gone", "__o", "__ord", "__m", "__body", "__n", "lines", "bit", "word", "bits"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in ((1, BODY), (2, BODY + " more"), (3, "line one of three\nshort"), (4, "line one of three\nother"))], ", ".join(["doc_id long, text string", *(f"`{n}` string" for n in names)]))
    lines = LD.dedup_lines(docs)
    near = N.near_duplicates(docs)
    kept = N.drop_near_duplicates(docs)
    for got, more in ((lines, ["line_count", "lines_dropped"]), (near, ["n_shingles", "component_id", "kept"]), (kept, [])):
        assert got.columns == [*docs.columns, *more]
        assert all(r[n] == n for r in got.collect() for n in names)
    assert {r.doc_id: r.text for r in lines.collect()}[4] == "other" and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


# --- near duplicates ---------------------------------------------------------------


def near_brute(rows, num=80, den=100):
    sets, label = [], list(range(len(rows)))
    for _, t in rows:
        w = SOLID_RE.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset()))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    order = lambda i: -(1 << 63) if rows[i][0] is None else rows[i][0]
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 63), order(i))
    out = []
    for i in range(len(rows)):
        c = least[find(i)]
        out.append((rows[i][0], len(sets[i]), None if c == -(1 << 63) else c, c == order(i)))
    return collections.Counter(out)


def variants():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(60):
        words = list(base)
        for p in rng.integers(0, 120, int(rng.integers(0, 5))):
            words[p] = f"v{k}_{p}"
        out.append((100 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("num", [80, 85])
def test_near_duplicates(spark, num):
    rows = [*ROWS, *variants(), (300, "three words only"), (301, "Three  WORDS only"), (302, "three words")]
    docs = documents(spark, rows)
    want = near_brute(rows, num)
    got = N.near_duplicate_ids(docs, num=num).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    if num == 80:
        got = N.near_duplicates(docs).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
        assert "node" in N.near_duplicates(docs).columns
        assert N.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("dense,deepest", [(16, 8), (4, 5), (1000, 8)])
def test_large_groups_are_split(spark, monkeypatch, dense, deepest):
    monkeypatch.setattr(N, "BUCKET", dense)
    monkeypatch.setattr(N, "DEEPEST", deepest)
    monkeypatch.setattr(N, "SIGNATURES", (8, 16))
    monkeypatch.setattr(N, "SETS", (6, 8))
    rows = variants()
    got = N.near_duplicate_ids(documents(spark, rows), num=85).collect()
    assert collections.Counter(tuple(r) for r in got) == near_brute(rows, 85)


def test_isolated_pairs_at_the_threshold_survive_dense_buckets(spark, monkeypatch):
    """Every bucket counts as dense, so that each pair has to meet at every depth up to the last."""
    monkeypatch.setattr(N, "BUCKET", 1)
    own = lambda i, side: " ".join([*(f"p{i}w{k}" for k in range(32)), *(f"p{i}{side}{k}" for k in range(4))])
    rows = [(2 * i + j, own(i, side)) for i in range(3000) for j, side in enumerate("ab")]
    got = N.near_duplicate_ids(documents(spark, rows), num=80, width=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, 36, i - i % 2) for i in range(6000)]


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_signatures_and_trees_keep_the_stated_rates(similarity):
    below = sum(math.comb(N.VALUES, k) * similarity**k * (1 - similarity) ** (N.VALUES - k) for k in range(N._agreeing(similarity)))
    assert below <= 3e-6
    missed = [(1 - similarity**d) ** N._trees(d, similarity) for d in range(N.DEPTH, N.DEEPEST + 1)]
    assert sum(missed) <= {0.8: 1 / 2.9e6, 0.85: 1 / 400e6}[similarity]


def test_near_duplicates_of_the_corpus(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = N.near_duplicate_ids(corpus, num=85).collect()
    assert collections.Counter(tuple(r) for r in got) == near_brute(rows, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 104)}) == 1 and got[0] != got[100]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination ---------------------------------------------------------------


def hits(rows, items, window=10):
    found = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM_RE.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            found[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, ids = ALNUM_RE.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                if who := found.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= who
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_contamination(spark, block):
    items = [(1, "alpha3 BETA3 gamma alpha4 beta4 gamma alpha5 beta5 gamma alpha6 beta6 gamma"), (2, "that stands twice"), (10, ""), (3, None), (None, "another line of"), (2, "漢字"), (4, "!!!")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    docs = documents(spark)
    got = D.find_contamination(docs, bench, block_bytes=block).select(*COLUMNS).collect()
    assert collections.Counter(map(tuple, got)) == hits(ROWS, items)
    kept = D.remove_contaminated(docs, bench)
    clean = sum(n for k, n in hits(ROWS, items).items() if not k[5])
    assert kept.columns == docs.columns and kept.count() == clean < len(ROWS)
    assert D.find_contamination(empty(spark), bench).count() == 0
    assert D.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_contamination_of_the_corpus(spark, corpus):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = D.find_contamination(corpus, bench).select(*COLUMNS).collect()
    want = hits([(r.doc_id, r.text) for r in corpus.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert collections.Counter(map(tuple, got)) == want and any(k[5] for k in want)


def test_proximity():
    import pyarrow as pa

    from surveyq.llm.common import texts_of

    segment = D.Segment.of(texts_of(pa.array(["a x b c", "a b x x x c", "a", "b c"], pa.string())))
    phrase = D.Phrases.windows(texts_of(pa.array(["a b c"], pa.string())), 10)
    where = lambda slop: sorted((int(x), int(y)) for _, lo, hi in D.search(segment, phrase, slop) for x, y in zip(lo, hi))
    assert where(0) == [] and where(1) == [(0, 4)] and (4, 10) in where(3)


def near_hits(texts, items, width, slop):
    """(words, first, after the last) of all proximity matches, by trying every place."""
    out, base = set(), 0
    for t in texts:
        w = t.split()
        for item in items:
            words = item.split()
            n = min(width, len(words))
            for b in range(len(words) - n + 1) if n else ():
                phrase = words[b : b + n]
                for a in range(len(w)):
                    reach = [[q for q in range(max(0, a + k - slop), min(len(w), a + k + slop + 1)) if w[q] == x] for k, x in enumerate(phrase)]
                    if w[a] == phrase[0] and all(reach):
                        near = [min(r, key=lambda q, k=k: (abs(q - a - k), q)) for k, r in enumerate(reach)]
                        near[0] = a
                        out.add((tuple(phrase), base + min(near), base + max(near) + 1))
        base += len(w)
    return out


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_search_against_brute_force(slop):
    import pyarrow as pa

    from surveyq.llm.common import ALNUM, texts_of, words_of

    rng = np.random.default_rng(slop)
    for _ in range(25):
        vocabulary = [f"w{i}" for i in range(int(rng.choice([2, 5, 12])))]
        some = lambda n, most: [" ".join(rng.choice(vocabulary, int(rng.integers(0, most)))) for _ in range(n)]
        texts, items, width = some(6, 25), some(5, 8), int(rng.choice([1, 2, 4, 10]))
        segment = D.Segment.of(texts_of(pa.array(texts, pa.string())))
        phrases = D.Phrases.windows(texts_of(pa.array(items, pa.string())), width)
        name = dict(zip(words_of(texts_of(pa.array(vocabulary)), ALNUM).hash.tolist(), vocabulary))
        got = [
            (tuple(name[int(phrases.terms[x])] for x in phrases.word[phrases.begin[p] :][: phrases.length[p]]), int(lo), int(hi))
            for found in D.search(segment, phrases, slop) for p, lo, hi in zip(*found)
        ]
        assert set(got) == near_hits(texts, items, width, slop) and len(got) >= len(set(got))


def test_search_holds_few_candidates(monkeypatch):
    import pyarrow as pa

    from surveyq.llm.common import texts_of

    monkeypatch.setattr(D, "CANDIDATES", 3)
    segment = D.Segment.of(texts_of(pa.array(["a b a b a b a b", "b a b"], pa.string())))
    phrases = D.Phrases.windows(texts_of(pa.array(["a b a", "b", "b a b"], pa.string())), 2)
    got = sorted((int(p), int(lo), int(hi)) for found in D.search(segment, phrases) for p, lo, hi in zip(*found))
    assert len(got) == len(set(got)) == 5 + 4 + 6


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_proximity_of_documents(spark, block):
    docs = spark.createDataFrame([(1, "one two x three four"), (2, "one two three four"), (3, "one four"), (4, None), (None, "three two one four")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "two three"), (8, "one two three four five"), (9, "")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.items, r.ranges) for r in D.find_contamination(docs, items, window=2, slop=1, block_bytes=block).collect()}
    assert got[1] == (5, ["7", "8"], [0, 5])
    assert got[2] == (4, ["7", "8"], [0, 4])
    assert got[3][0] == 0 and got[4][0] == 0
    exact = {r.doc_id: r.items for r in D.find_contamination(docs, items, window=None, slop=0, block_bytes=block).collect()}
    assert exact == {1: [], 2: ["7"], 3: [], 4: [], None: []}


def test_removal_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "k", "x"), (1, "other", "k", "y"), (2, "b c", None, "z")], "doc_id long, text string, key string, bad string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    got = D.remove_contaminated(docs, items).collect()
    assert [tuple(r) for r in got] == [(1, "other", "k", "y")]


# --- packing -----------------------------------------------------------------------


def test_cut_and_plan():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(3, 4) == [(0, 3)]
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 65, int(rng.integers(1, 400))).tolist()
        counts = collections.Counter(lengths)
        made = plan(counts, 64)
        used = collections.Counter()
        for n, items in made:
            assert sum(k * c for k, c in items) <= 64
            for k, c in items:
                used[k] += n * c
        assert used == counts
        bins = []  # best fit decreasing, a piece at a time
        for x in sorted(lengths, reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= x]
            if fit:
                bins[min(fit, key=lambda b: bins[b])] -= x
            else:
                bins.append(64 - x)
        assert sum(n for n, _ in made) == len(bins)
        assert sum(r[2] - r[1] for r in slots(made)) == len(lengths)
    assert plan({}) == []


def check_packing(rows, source):
    lib = Tokenizer.from_file(BYTE_BPE)
    want = collections.Counter()
    for i, t in source:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(cut(len(ids), SIZE)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= SIZE
    return len(by), sum(r.length for r in rows)


def test_packing(spark, corpus):
    check_packing(pack(documents(spark), BYTE_BPE).collect(), ROWS)
    n, total = check_packing(pack(corpus, BYTE_BPE, rank_parts=4).collect(), [(r.doc_id, r.text) for r in corpus.collect()])
    assert n <= -(-total // SIZE) * 1.02 + 1
    assert pack(empty(spark), BYTE_BPE).count() == 0


# --- quality -----------------------------------------------------------------------


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) > 50 and auc > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.98 and np.mean([s < 0.3 for s in bad]) > 0.9


def test_quality_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 0), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # equal texts score alike
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(empty(spark), labels).count() == 0
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert fit(docs, labels.where("quality = 0")) is None
    assert score(docs, None).select("score").distinct().count() == 1


def test_prior_is_estimated_without_negatives(spark):
    """Positives alone: labels other than 1 change nothing, the estimate is near the share, and bad documents don't pass."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where("quality = 1"))
    assert abs(model.prior - label_share(labels)) < 0.05
    got = score(docs, model).join(labels, "doc_id").select("quality", "score").collect()
    assert np.mean([r.score >= 0.3 for r in got if r.quality == 0]) < 0.05
    assert np.mean([r.score >= 0.3 for r in got if r.quality == 1]) > 0.98
    assert fit(docs.limit(50), labels, prior=0.4).prior == 0.4


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_estimated_prior_follows_the_share(share):
    from surveyq.llm.quality import HASHED, NAMES

    rng = np.random.default_rng(7)
    wide = len(NAMES) + HASHED
    n = 3000
    k = int(n * share)
    mixed = np.concatenate([rng.normal(0.3, 1, (k, wide)), rng.normal(-0.3, 1, (n - k, wide))])
    rng.shuffle(mixed)
    assert abs(estimate_prior(rng.normal(0.3, 1, (2000, wide)), mixed) - share) < 0.08


def test_gradient_of_the_risk():
    rng = np.random.default_rng(1)
    p, u = rng.normal(0.5, 1, (40, 6)), rng.normal(0, 1, (60, 6))
    for w in (rng.normal(0, 0.3, 7), np.zeros(7)):
        value, grad, rest = risk(w, p, u, 0.4, 0.01)
        brute = 0.4 * np.mean([np.log1p(np.exp(-(x @ w[:-1] + w[-1]))) for x in p])
        brute += np.mean([np.log1p(np.exp(x @ w[:-1] + w[-1])) for x in u]) - 0.4 * np.mean([np.log1p(np.exp(x @ w[:-1] + w[-1])) for x in p])
        assert rest >= 0 and abs(value - brute - 0.005 * w[:-1] @ w[:-1]) < 1e-9
        for k in range(7):
            step = np.zeros(7)
            step[k] = 1e-6
            slope = (risk(w + step, p, u, 0.4, 0.01)[0] - risk(w - step, p, u, 0.4, 0.01)[0]) / 2e-6
            assert abs(slope - grad[k]) < 1e-6
    # unlabelled rows that score far below all positives: their share of the risk is negative, and the step climbs it
    w = np.append(np.full(6, 2.0), 0.0)
    _, grad, rest = risk(w, np.abs(p), -np.abs(u), 0.9, 0.0)
    part = lambda v: np.mean(np.log1p(np.exp(-np.abs(u) @ v[:-1] + v[-1]))) - 0.9 * np.mean(np.log1p(np.exp(np.abs(p) @ v[:-1] + v[-1])))
    assert rest < 0 and abs(part(w) - rest) < 1e-9
    step = np.eye(7)[2] * 1e-6
    assert abs(-(part(w + step) - part(w - step)) / 2e-6 - grad[2]) < 1e-6


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    from surveyq.llm.quality import HASHED, NAMES

    wide = len(NAMES) + HASHED
    pos, neg = rng.normal(1, 1, (300, wide)), rng.normal(-1, 1, (300, wide))
    model = train(pos[:150], np.concatenate([pos[150:], neg[:100]]), 0.6)
    assert (model.score(pos) > 0.5).mean() > 0.95 and (model.score(neg[100:]) < 0.5).mean() > 0.95


def test_hot_and_cold_keys_join_alike(spark, monkeypatch):
    from surveyq.llm import common

    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "i long, k long")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"))
    want = collections.Counter(tuple(r) for r in rows.join(keyed, "k").collect())
    for keys in (1, 3, 1000):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert collections.Counter(tuple(r) for r in common.join_hot(rows, keyed, ["k"], "n", 300).collect()) == want
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rows = [*ROWS, *variants()]
    got = N.near_duplicate_ids(documents(spark, rows), num=80).collect()
    assert collections.Counter(tuple(r) for r in got) == near_brute(rows, 80)
    got = LD.dedup_lines(documents(spark, rows), batches=3).collect()
    assert collections.Counter((r.doc_id, r.line_count, r.lines_dropped, r.text) for r in got) == deduped(rows)
