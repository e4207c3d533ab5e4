"""Recall by measure, skewed and repetitive inputs, odd rows in every stage, and the SQL of the operators."""

import time
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from graupel.llm import bpe, compact_windows, decontaminate, line_dedup, quality, queries, topk

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def letters(rng, n):
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))


def windows(line):
    n = line_dedup.GRAM
    return {line[i : i + n] for i in range(max(len(line) - n + 1, 1))}


def test_line_recall_by_length(spark):
    """Pairs with a similarity just above the threshold, 100 of each length in windows."""
    rng = np.random.default_rng(21)
    made = []
    for n in (10, 20, 40, 80, 200, 600):
        for _ in range(100):
            a = letters(rng, n + 7)
            b = list(a)
            cut = max(1, n // 9)  # windows that are lost: eight for a change inside, fewer at the end
            for k in range(cut // 8):
                b[8 + 16 * k] = "#"
            if cut % 8:
                b[len(b) - cut % 8] = "#"
            b = "".join(b)
            x, y = windows(a), windows(b)
            assert 0.8 <= len(x & y) / len(x | y) < 0.9
            made.append((n, a, b))
    lines = spark.createDataFrame([(t,) for _, a, b in made for t in (a, b)], "line string").select(F.xxhash64("line").alias("h"), "line")
    h = {r["line"]: r["h"] for r in lines.collect()}
    comps = {r["node"]: r["component"] for r in line_dedup.line_components(lines, line_dedup.Scratch(spark, "recall")).collect()}
    found = Counter(n for n, a, b in made if comps.get(h[a], 0) == comps.get(h[b], 1))
    assert all(found[n] >= 94 for n in (10, 20, 40, 80, 200, 600)), found


def test_lines_equal_brute_force(spark):
    """Lines are copies, differ little (0.9 and more) or a lot; ties, repeated rows, nulls, very long lines."""
    rng = np.random.default_rng(22)
    base = [letters(rng, int(n)) for n in rng.integers(100, 300, 25)] + ["-" * 400, letters(rng, 30_000), "one", "", "   "]
    rows = []
    for k in range(60):
        own = []
        for j in rng.integers(0, len(base), 6):
            line = base[j]
            if len(line) > 90 and rng.random() < 0.5:
                at = int(rng.integers(0, len(line)))
                line = line[:at] + "#" + line[at + 1 :]
            own.append(line)
        rows.append((k if k % 9 else None, "\n".join(own)))
    rows += [(70, None), (71, ""), rows[3], rows[3]]
    seen: list[tuple] = []
    parent: list[int] = []

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    names = {}
    for line in {x for _, t in rows if t for x in t.split("\n") if x.strip()}:
        w = windows(line)
        names[line] = len(seen)
        parent.append(len(seen))
        for k, (_, v) in enumerate(seen):
            if 100 * len(w & v) >= 80 * len(w | v):
                parent[find(k)] = find(len(seen))
        seen.append((line, w))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    kept = Counter()
    left = Counter((r["doc_id"], r["n_lines"], r["n_removed"]) for r in got)
    for r in {(r["doc_id"], r["text"]) for r in got}:
        for x in (r[1] or "").split("\n"):
            if x.strip():
                kept[find(names[x])] += 1
    assert set(kept) == {find(k) for k in range(len(seen))} and set(kept.values()) == {1}
    total = sum(n for (_, _, n), c in left.items() for _ in range(c))
    copies = rows.count(rows[3]) - 1
    lines_of = [x for _, t in rows if t for x in t.split("\n") if x.strip()]
    assert left[(70, 0, 0)] == 1 and left[(71, 1, 0)] == 1
    assert len(lines_of) - total - sum(1 for r in got for x in (r["text"] or "").split("\n") if x.strip()) == 0 and copies == 2


def test_topk_prunes_and_defines_repeats(spark):
    rng = np.random.default_rng(23)
    centers = rng.normal(size=(40, 64))
    x = np.floor(256 * np.repeat(centers, 50, 0) + rng.normal(0, 8, (2000, 64))).astype(np.int64)
    alive = ~np.eye(2000, dtype=bool)[:40]
    exact = x[:40] @ x.T
    floor = np.sort(np.where(alive, exact, -(2**62)), 1)[:, -5] - 1000
    i, j = topk.survivors(x[:40], x, floor, alive.copy(), 5)
    assert len(i) < 0.2 * alive.sum()
    best = {(q, c) for q in range(40) for c in np.argsort(-np.where(alive[q], exact[q], -(2**62)), kind="stable")[:5].tolist()}
    assert best <= set(zip(i.tolist(), j.tolist(), strict=True))
    rows = [(50, [1.0, 2.0], "a"), (50, [1.0, 2.0], "a"), (52, [3.0, 1.0], "b"), (52, [3.0, 1.0], "b"), (51, [0.5, 0.5], "c"), (None, [9.0, 9.0], "d"), (53, None, "e"), (54, [float("nan"), 1.0], "f"), (55, [1.0], "g"), (56, [0.5, 0.5], "tie")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == [(50, 1, 52, 327680), (50, 2, 52, 327680), (50, 3, 51, 98304), (50, 4, 56, 98304)]


def test_repetitive_texts_are_tiled_from_few_runs():
    a, b = np.full(80, 7, np.uint64), np.full(20_000, 7, np.uint64)
    assert sum(n for *_, n in decontaminate.greedy_tiles(a, b, 5)) == 80 and len(decontaminate.common_runs(a, b, 5)[0]) == 76 + 19_996 - 1
    a, b = np.tile(np.arange(3, dtype=np.uint64), 60), np.tile(np.arange(3, dtype=np.uint64), 5000)
    assert sum(n for *_, n in decontaminate.greedy_tiles(a, b, 5)) == 180 and len(decontaminate.common_runs(a, b, 5)[0]) < 6000


def test_large_benchmark_by_shuffle_equals_the_small_way(spark, monkeypatch):
    rng = np.random.default_rng(24)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 300, n)]
    items = [words(int(n)) for n in rng.integers(3, 60, 30)]
    docs = [(k, " ".join(words(50) + (items[k % 30] if k % 3 == 0 else items[k % 30][: len(items[k % 30]) // 3]) + words(20)), "x") for k in range(90)] + [(200, None, "x"), (201, "", "x"), (None, " ".join(items[4]), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(77, None), (78, "")], "item_id long, text string")
    both = lambda: (sorted(map(str, decontaminate.contamination(df, bench).collect())), sorted(map(str, decontaminate.decontaminate(df, bench).collect())))
    small = both()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    assert both() == small and len(small[0]) >= 30
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_passages_around_a_frequent_phrase(spark):
    """Copies of a 60-word passage that holds a 40-word phrase of 300 other texts."""
    rng = np.random.default_rng(25)
    fresh = lambda n: [f"u{k}" for k in rng.integers(0, 10**9, n)]
    phrase = fresh(40)
    texts = [fresh(40) + phrase + fresh(40) for _ in range(300)]
    pairs = []
    for k in range(60):
        passage = fresh(k % 21) + phrase + fresh(20 - k % 21)
        pairs.append((len(texts), len(texts) + 1))
        texts += [fresh(45) + passage + fresh(45) for _ in range(2)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    met = {frozenset((r["doc_id"], r["other_id"])) for r in compact_windows.near_passages(df).collect()}
    assert sum(frozenset(p) in met for p in pairs) >= 54


def test_round_trip_in_one_pass(spark):
    rows = [(1, "a" * 3000 + " it's\n日本 x"), (2, None), (3, ""), (4, "same"), (4, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["round_trip"]) for r in bpe.bpe_round_trip(df, PATH, public_tokenizers.PATTERN).collect())
    want = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), True) for r in bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN).collect())
    assert got == want and "text" not in bpe.bpe_round_trip(df, PATH, public_tokenizers.PATTERN).columns


#: Names that operators or stages use for columns of their own.
CLASHES = ["label", "quality", "score", "_score", "gone", "doc", "row", "n_lines", "n_removed", "key", "name", "item_id", "_text", "n_tokens", "ids", "round_trip"]


def test_near_copies_without_an_id(spark):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    one, two = (" ".join(f"w{i}" for i in rng.integers(0, 99, 60)) for _ in range(2))
    rows = [(2, one, "a"), (None, one, "b"), (1, one, "c"), (None, two, "d"), (None, two, "d"), (3, "alone here", "e"), (None, None, "f"), (4, None, "g"), (4, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(r["key"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == ["c", "d", "d", "e", "f", "g", "h"]


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_take_odd_rows(spark, kind):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [f.name for f in docs.schema.fields]
    own = docs.limit(40)
    if kind == "odd":
        odd = [(None, "a text without id"), (900001, None), (900002, ""), (900003, "word " * 30_000), (900003, "word " * 30_000), (900004, "\n\n \t\n")]
        more = spark.createDataFrame(odd, "doc_id long, text string")
        for f in docs.schema.fields:
            if f.name not in ("doc_id", "text"):
                more = more.withColumn(f.name, F.lit(None).cast(f.dataType))
        own = own.union(more.select(names)).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
        names = names + CLASHES
    else:
        own = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, own, SF)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == names
        rows = out.collect()
        assert kind == "odd" or not rows
        assert kind == "none" or name == corpus_pipeline.STAGES[-1][0] or all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert kind == "none" or len(rows) > 0


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = tables.execute(queries.SQL[name]).df()
    assert sorted(want.columns) == cols
    assert Counter(tuple(map(str, r)) for r in got.select(cols).collect()) == Counter(tuple(map(str, r)) for r in want[cols].itertuples(index=False))


def test_quality_takes_any_id_and_clashing_names(spark):
    rng = np.random.default_rng(26)
    text = lambda bad: " ".join(f"w{k}" + "###" * bad for k in rng.integers(0, 200, 40))
    rows = [(f"d{k}", text(k % 4 == 0), "x", 1.0) for k in range(160)] + [("long", "w1 " * 100_000, "x", 1.0), ("none", None, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, label string, key double")
    labels = spark.createDataFrame([(f"d{k}", int(k % 4 > 0)) for k in range(160)], "doc_id string, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == 162 and got["d1"]["label"] == "x" and got["d1"]["key"] == 1.0
    assert np.mean([(got[f"d{k}"]["score"] >= 0.5) == (k % 4 > 0) for k in range(160)]) > 0.95
