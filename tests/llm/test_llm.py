"""The pipeline operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
import tiktoken
from graupel.llm import bpe, compact_windows, decontaminate, jaccard_join, katz, line_dedup, quality, sharding, substring_dedup, topk

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, extra string"


def words(rng, n, size=400):
    return " ".join(f"w{i}" for i in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, short and long texts, repeated rows."""
    rng = np.random.default_rng(11)
    out = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (4, "One  TWO", None), (None, "no id at all here", "x"), (5, " \n\t ", "x"), (6, "éa ßü 日本語 " * 40, "x")]
    base = words(rng, 120)
    for k in range(7, 40):
        w = base.split()
        if k % 3:
            w[rng.integers(0, 120)] = f"new{k}"
        out.append((k, " ".join(w), "near"))
    out += [(k, words(rng, int(rng.integers(5, 200))), "other") for k in range(40, 90)]
    passage = words(rng, 70)
    out += [(k, words(rng, 60) + "\n" + passage + "\n" + words(rng, 60), "passage") for k in range(90, 100)]
    out += [(100, words(rng, 20_000), "long"), (101, "same text again\n" * 50, "lines"), (100, out[-1][1], "repeat"), out[8], out[8]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split()


def test_bpe_equals_tiktoken_and_decodes(spark, docs, rows, empty):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH).rank, special_tokens={})
    more = spark.createDataFrame([(1, "a" * 5000, "n_tokens"), (2, "<|endoftext|> it's I'LL 12345  x", "y")], "doc_id long, text string, ids string")
    for df in (docs, more):
        got = bpe.bpe_decode(bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
        for r in got:
            want = enc.encode_ordinary(r["text"] or "")
            assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
            assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.bpe_encode(empty, PATH, public_tokenizers.PATTERN).count() == 0
    assert Counter(map(str, bpe.bpe_encode(docs, PATH, public_tokenizers.PATTERN).select("doc_id").collect())) == Counter(map(str, docs.select("doc_id").collect()))


def test_shards_are_exact_gapless_and_random(spark, docs, empty):
    got = sharding.shard_uniform(docs.withColumn("shard", F.lit("clash")), 7).collect()
    assert len(got) == docs.count() and Counter(str(r["doc_id"]) for r in got) == Counter(str(r["doc_id"]) for r in docs.collect())
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert sharding.shard_uniform(empty, 3).count() == 0
    many = sharding.shard_uniform(spark.range(6000), 4)
    table = many.groupBy((F.col("id") < 3000).alias("low"), "shard").count().collect()
    assert sum((r["count"] - 750) ** 2 / 750 for r in table) < 30


def test_hypergeometric_draws(spark):
    u = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(2**53)
    lit = lambda n: F.lit(n).cast("long")
    got = {r["x"]: r["count"] for r in spark.range(20000).select(sharding.hypergeometric(lit(30), lit(12), lit(9), u).alias("x")).groupBy("x").count().collect()}
    chi = sum((got.get(k, 0) - e) ** 2 / e for k in range(10) if (e := 20000 * math.comb(12, k) * math.comb(18, 9 - k) / math.comb(30, 9)) > 5)
    assert chi < 35
    for total, marked, draws, want in ((5, 5, 3, 3), (5, 0, 3, 0), (0, 0, 0, 0), (6, 4, 6, 4)):
        assert spark.range(1).select(sharding.hypergeometric(lit(total), lit(marked), lit(draws), F.lit(0.999))).first()[0] == want


def test_topk_equals_all_products(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, rng.normal(size=16).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 16) for i in range(40)]
    vecs += [(2000, None), (2050, [1.0] * 15 + [float("nan")]), (2100, [1.0] * 15 + [None]), (2150, [1.0] * 3), (2200, [2.0] * 3), (None, [1.0] * 16), (2250, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(4)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()}
    ok = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in vecs if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for q in ok:
        if q % 50 == 0:
            scored = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q])))[:5]
            want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(scored)}
    assert got == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def grams(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_jaccard_join_equals_all_pairs(docs, rows, empty):
    sets = [(i, grams(t)) for i, t, _ in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None and (least[find(k)] is None or i < least[find(k)]):
            least[find(k)] = i
    want = Counter((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets))
    assert Counter(map(tuple, jaccard_join.ngram_jaccard_join(docs).collect())) == want
    assert jaccard_join.ngram_jaccard_join(empty).count() == 0


def test_jaccard_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 3)
    rng = np.random.default_rng(5)
    shared = words(rng, 12).split()
    texts = [" ".join(shared + words(rng, 12, 5000).split()) for _ in range(40)]
    texts += [t.rsplit(" ", 1)[0] + " tail" for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.ngram_jaccard_join(df).collect()}
    for a in range(len(texts)):
        for b in range(a):
            x, y = grams(texts[a]), grams(texts[b])
            if 100 * len(x & y) >= 75 * len(x | y):
                assert got[a] == got[b]
    assert sum(k == v for k, v in got.items()) == 40


def test_jaccard_join_through_a_row_without_id(spark):
    w = [f"v{k}" for k in range(60)]
    chain = [" ".join(w), " ".join([*w[:54], *[f"x{k}" for k in range(6)]]), " ".join([*[f"y{k}" for k in range(6)], *w[6:54], *[f"x{k}" for k in range(6)]])]
    assert 100 * len(grams(chain[0]) & grams(chain[2])) < 75 * len(grams(chain[0]) | grams(chain[2]))
    df = spark.createDataFrame([(1, chain[0]), (None, chain[1]), (2, chain[2]), (3, "some other text of its own")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.ngram_jaccard_join(df).collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}


def test_katz_equals_plain_model(docs, rows, empty):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6), round(r["score"], 6), r["train_tokens"]) for r in katz.katz_score(docs).collect())
    data = [(i, [*tokens(t), 0], zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1) for i, t, _ in rows]
    c1, c2 = Counter(), Counter()
    for _, t, held in data:
        if not held:
            c1.update(t)
            c2.update(zip([1, *t[:-1]], t, strict=True))
    total = sum(c1.values())
    d1, d2 = (katz.discounts([Counter(c.values())[r] for r in range(1, katz.K + 2)]) for c in (c1, c2))
    cut = lambda c, d: c - katz.TAIL if c > katz.K else d[c] * c
    p1 = {w: cut(c, d1) / total for w, c in c1.items()}
    rest = 1 - sum(p1.values())
    hist = Counter(c1)
    hist[1] = c1[0]
    mass, low = Counter(), Counter()
    for (h, w), c in c2.items():
        mass[h] += cut(c, d2) / hist[h]
        low[h] += p1[w]
    alpha = {h: (1 - mass[h]) / (1 - low[h]) for h in mass}
    for h in list(alpha)[:20]:  # each history's probabilities sum to 1 over all words and the unknown one
        seen = sum(cut(c2[h, w], d2) / hist[h] for w in c1 if (h, w) in c2)
        assert seen + alpha[h] * (rest + sum(p for w, p in p1.items() if (h, w) not in c2)) == pytest.approx(1)
    want = []
    for i, t, held in data:
        score = sum(math.log10(cut(c2[h, w], d2) / hist[h] if c2[h, w] else alpha.get(h, 1.0) * p1.get(w, rest)) for h, w in zip([1, *t[:-1]], t, strict=True))
        base = sum(math.log10((c1[w] + 0.5) / (total + 0.5 * (len(c1) + 1))) for w in t)
        want.append((str(i), len(t), sum(w in c1 for w in t), held, round(base, 6), round(score, 6), total))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-4) and g[5] == pytest.approx(w[5], abs=1e-4)
    assert katz.katz_score(empty).count() == 0


def test_katz_of_many_partitions(spark):
    docs = spark.createDataFrame([(k, f"a b c{k % 7} a d{k % 3} b") for k in range(400)], "doc_id long, text string")
    few, many = ({r["doc_id"]: (r["n_known"], round(r["score"], 9)) for r in katz.katz_score(docs.repartition(n)).collect()} for n in (3, 200))
    assert len(many) == 400 and few == many


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_bytes_equal_brute_force(spark, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    own = [r for r in dict.fromkeys(rows) if r[0] is not None and r[2] != "repeat"] + [(500, "ab" * 300, "z"), (501, "x" + "ab" * 300, "z"), (502, "q" * 99, "z"), (503, "q" * 99, "z"), (504, "q" * 100, "z")]
    df = spark.createDataFrame(own, SCHEMA).repartition(6)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(df).collect()}
    seen, want = set(), {}
    for i, t, _ in sorted(own, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = True
            seen.add(b[j : j + 100])
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        want[i] = (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    assert got == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_prefix_intervals_and_extension():
    assert sorted(substring_dedup.prefix_intervals([0, 3, 3, 1, 4], 2)) == [(3, 0, 2), (4, 3, 4)]
    assert substring_dedup.earlier_extension([2, 0, 1], [0, 5, 3]) == [5, 0, 3]


def test_lines_keep_the_first_of_each_component(spark, empty):
    rng = np.random.default_rng(9)
    long = words(rng, 40)
    near = long.replace(long.split()[20], "changed")
    data = [(3, f"{near}\nunique three\n\n  ", "x"), (1, f"{long}\nshort", "x"), (2, "short\nother line of its own", "x"), (4, None, "x"), (5, "", "x"), (None, "short", "x"), (1, f"{long}\nshort", "x")]
    got = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"], r["extra"]) for r in line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA).withColumn("n_lines", F.lit("clash"))).collect())
    want = [("1", f"{long}", 2, 1, "x")] * 2 + [("2", "other line of its own", 2, 1, "x"), ("3", "unique three\n\n  ", 4, 1, "x"), ("4", None, 0, 0, "x"), ("5", "", 1, 0, "x"), ("None", "short", 1, 0, "x")]
    assert got == sorted(want, key=lambda r: r[0])
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("asks", [4, 10_000])
def test_similar_lines_of_a_large_band_meet(spark, monkeypatch, asks):
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    monkeypatch.setattr(line_dedup, "ASKS", asks)
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    form = [letters(40) for _ in range(4)]
    texts = []
    for _ in range(150):
        own = [letters(9) for _ in range(3)]
        line = "".join(f + o for f, o in zip(form, [*own, ""], strict=True))
        texts += [line, line[:60] + "#" + line[61:]]
    lines = spark.createDataFrame([(t,) for t in texts], "line string").select(F.xxhash64("line").alias("h"), "line")
    hashes = [r["h"] for r in lines.collect()]
    sets = [{t[i : i + line_dedup.GRAM] for i in range(len(t) - line_dedup.GRAM + 1)} for t in texts]
    bands = defaultdict(set)
    for r in line_dedup._bands(lines).collect():
        bands[r["h"]].add(r["band"])
    comps = {r["node"]: r["component"] for r in line_dedup.line_components(lines, line_dedup.Scratch(spark, "lines")).collect()}
    met = [(a, b) for a in range(len(texts)) for b in range(a) if bands[hashes[a]] & bands[hashes[b]]]
    near = [(a, b) for a, b in met if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(near) > 100 and len(met) > 10 * len(near)
    assert [p for p in near if comps.get(hashes[p[0]], p[0]) != comps.get(hashes[p[1]], p[1])] == []
    assert len({comps[h] for h in comps}) > 100


def test_long_lines_of_few_windows_are_found(spark):
    units = ["-", "=", "*", "_", "#", "~", ".", "+", "- ", "abc", "=-=*  "]
    data = [(k, (u * 300)[:n]) for u in units for k, n in enumerate((160, 171, 205))]
    got = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == {(0, 0): len(units), (1, 1): len(units), (2, 1): len(units)}


def brute_tiles(pattern, text, minimum):
    used_p, used_t, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and p + n not in used_p and t + n not in used_t:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < minimum:
            return out
        used_p.update(range(p, p + n))
        used_t.update(range(t, t + n))
        out += n


def test_tiles_cover_what_the_greedy_search_covers():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 50)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 50)).astype(np.uint64)
        tiles = decontaminate.greedy_tiles(a, b, 3)
        assert all((a[p : p + n] == b[t : t + n]).all() and n >= 3 for p, t, n in tiles)
        assert len({x for p, _, n in tiles for x in range(p, p + n)}) == sum(n for *_, n in tiles)
        assert sum(n for *_, n in tiles) == brute_tiles(a.tolist(), b.tolist(), 3)


def test_reordered_passages_are_found_and_clean_ones_stay(spark, empty):
    rng = np.random.default_rng(8)
    item = words(rng, 40).split()
    cut = item[20:] + ["between"] * 3 + item[:20]
    data = [(1, words(rng, 50) + " " + " ".join(item), "x"), (2, " ".join(cut), "x"), (3, words(rng, 300), "x"), (4, None, "x"), (5, "", "x"), (6, " ".join(item[:12]), "x"), (7, "A Tiny Item", "x"), (1, " ".join(item), "x")]
    bench = spark.createDataFrame([(10, " ".join(item).upper()), (11, None), (12, ""), (13, "tiny item"), (14, "never seen words in any text")], "item_id long, text string")
    df = spark.createDataFrame(data, SCHEMA).withColumn("item_id", F.lit("clash"))
    got = sorted((r["doc_id"], r["item_id"], r["covered"]) for r in decontaminate.contamination(df, bench).collect())
    assert got == [(1, 10, 40), (1, 10, 40), (2, 10, 40), (7, 13, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(df, bench.limit(0)).count() == 0


def test_quality_learns_and_handles_odd_rows(spark, empty):
    rng = np.random.default_rng(4)
    good = [(i, words(rng, 60), 1) for i in range(300)]
    bad = [(i, " ".join(f"{w}###" for w in words(rng, 60).split()), 0) for i in range(300, 400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(5, 1), (900, None), (77777, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.withColumn("score", F.lit("clash")), quality.train(docs, labels)).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert np.mean([(got[i] >= 0.5) == (i < 300) for i in range(400)]) > 0.98
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, quality.train(docs, labels)).count() == 0


def test_windows_equal_the_tree_by_recursion():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 60, 400).astype(np.uint64)  # with ties
    offs = np.array([0, 150, 150, 170, 400])
    c, l, r, v = compact_windows.compact_windows(h, offs, 1, least=12)
    key = compact_windows.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * 2 % 2**64)) >> np.uint64(9)
    want = set()

    def cut(a, b):
        if b - a + 1 >= 12:
            m = a + int(np.argmin(key[a : b + 1]))
            want.add((m, a, b))
            cut(a, m - 1)
            cut(m + 1, b)

    for a, b in zip(offs[:-1], offs[1:], strict=True):
        cut(int(a), int(b) - 1)
    assert set(zip(c.tolist(), l.tolist(), r.tolist(), strict=True)) == want and (v == h[c]).all()


def test_a_stray_token_does_not_cut_a_passage_at_its_changed_words():
    fresh = iter(range(1000, 10_000))
    other = lambda n: [next(fresh) for _ in range(n)]
    runs = [list(range(k, k + 35)) for k in (0, 100, 200)]
    a, b = (np.array(runs[0] + other(5) + runs[1] + other(5) + runs[2] + other(8) + [500], np.uint32) for _ in range(2))
    assert list(compact_windows.similar_parts(a, b)) == [(0, 115, 0, 115, pytest.approx(0.84))]


def test_parts_equal_the_split_at_the_widest_gap():
    rng = np.random.default_rng(6)

    def plain(a, b, least):
        at = {t: k for k, t in reversed(list(enumerate(b.tolist())))}
        shared = [(k, at[t]) for k, t in enumerate(a.tolist()) if t in at]
        gap = [q - p + abs(y - x - (q - p)) for (p, x), (q, y) in zip(shared, shared[1:])]
        todo = [(0, len(shared))]
        while todo:
            i, j = todo.pop()
            if j - i < 1 or shared[j - 1][0] - shared[i][0] + 1 < least:
                continue
            spots = [y for _, y in shared[i:j]]
            box = (shared[i][0], shared[j - 1][0] + 1, min(spots), max(spots) + 1)
            x, y = set(a[box[0] : box[1]].tolist()), set(b[box[2] : box[3]].tolist())
            if box[3] - box[2] >= least and 100 * len(x & y) >= 75 * len(x | y):
                yield (*box, len(x & y) / len(x | y))
            elif j - i > 1:
                wide = [k for k in range(i, j - 1) if gap[k] == max(gap[i : j - 1])]
                first, last = wide[0] + 1, wide[-1] + 1
                cut = first if first - i <= j - last else last
                todo += [(i, cut), (cut, j)]

    found = 0
    for _ in range(200):
        a = rng.integers(0, 300, 120)
        b = np.concatenate([rng.integers(0, 300, 20), a[10:110], rng.integers(0, 300, 20)])
        for x in (a, b):
            x[rng.integers(0, len(x), 12)] = rng.integers(0, 600, 12)
        got = sorted(compact_windows.similar_parts(a.astype(np.uint32), b.astype(np.uint32), 12))
        assert got == sorted(plain(a, b, 12))
        found += len(got)
    assert found > 200


def test_passages_are_found(docs, rows, empty):
    got = compact_windows.near_passages(docs).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    found = {a for a, _ in pairs}
    assert set(range(91, 100)) <= found and set(range(8, 40)) <= found and not found & set(range(40, 91))
    text = {i: tokens(t) for i, t, _ in rows}
    for r in got:
        assert r["similarity"] >= 0.75 and r["end"] - r["start"] >= 50 and r["end"] <= len(text[r["doc_id"]]) and r["other_end"] <= len(text[r["other_id"]])
    assert compact_windows.near_passages(empty).count() == 0


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        nxt = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert nxt.join(left, "doc_id", "left_anti").isEmpty()
        left = nxt
    end = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, left, sf).collect()}
    assert set(end) == {r["doc_id"] for r in left.collect()} and all(r["round_trip"] for r in end.values())
    assert {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()} == {(i, r["ids_sha256"]) for i, r in end.items()}


def test_parts_have_the_similarity_of_their_token_sets():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3000, 6000).astype(np.uint32)
    b = a.copy()
    b[::2] = rng.integers(0, 3000, 3000)
    for s, e, t, u, same in compact_windows.similar_parts(a, b):
        x, y = set(a[s:e].tolist()), set(b[t:u].tolist())
        assert same == len(x & y) / len(x | y) >= 0.75
