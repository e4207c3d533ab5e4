"""Language ID, fill-in-middle and cross-tokenizer alignment: brute force, odd rows, empty tables."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from graupel.llm import alignment, infill, language

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "one\ntwo\n\nthree", "\n", "\n\n\n", "no end\n", "a<P>b\nc", "x <M>", "<S", "<S\nS>\n<\n", "é日本語\n😀 ok\r\n", "<|endoftext|> it's I'LL 12345  x", "▁under ▁", "tab\tand   spaces \n  ", "\u0000​zero", "ÀÖ ǅ ȿ ɀ ﷺ", "same line\n" * 60, "same line\n" * 60, "w " * 9000 + "\n" + "long word" * 500]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"s{i}") for i, t in enumerate(TEXTS)] + [(None, "null id\nhere", "x"), (3, "a", "repeat"), (3, "a", "repeat")]
    return spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def cut_by_hand(text):
    lines = (text or "").split("\n")
    return [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def test_infill_cuts_whole_lines_and_restores(spark, odd):
    clash = odd.withColumns({"form": F.lit("clash"), "n": F.lit(-1)})
    got = infill.restore(infill.fill_in_middle(clash)).collect()
    assert Counter((r["doc_id"], r["restored"], r["extra"]) for r in got) == Counter((r["doc_id"], r["text"] or "", r["extra"]) for r in odd.collect())
    text = {r["extra"]: r["text"] or "" for r in odd.collect()}
    for r in got:
        t, lines = text[r["extra"]], cut_by_hand(text[r["extra"]])
        h = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
        low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        pre, mid, suf = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
        if not t or any(s in t for s in ("<P>", "<S>", "<M>")):
            want = ("plain", None, None, t)
        elif h[3] % 100 < 50:
            want = ("spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
        else:
            want = ("psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (len(lines), *want)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(odd.limit(0)).count() == 0
    none = infill.fill_in_middle(odd, rate=0).collect()
    assert {r["form"] for r in none} == {"plain"}


def test_infill_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(infill.INFILL_SQL).fetchall())
    assert sorted(map(tuple, infill.infill_query(spark, "/root/testdata/sf0.001").collect())) == want


def by_hand(texts):
    """Alignment of texts token by token: figures and groups."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    alphabet = alignment.byte_alphabet()
    made = []
    for t in texts:
        if not t:
            made.append(([], [], [], []))
            continue
        goal = (" " + t).encode()
        e = a.encode(" " + t, add_special_tokens=False)
        one = [(i, bytes(alphabet[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>") for i in e.ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        if any(b"".join(x for _, x in side) != goal for side in (one, two)):
            made.append(([], [], [], []))
            continue
        spans = []
        for side in (one, two):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, s2, e2 in spans[1] if s < e2 and s2 < e] if len(spans[0]) < 3000 else None
        if links is None:
            links, k = [], 0
            for i, s, e in spans[0]:
                while spans[1][k][2] <= s:
                    k += 1
                m = k
                while m < len(spans[1]) and spans[1][m][1] < e:
                    links.append((i, spans[1][m][0]))
                    m += 1
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, last = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, s, x in spans[0] if last < x <= e) + "|" + ",".join(str(i) for i, s, x in spans[1] if last < x <= e))
            last = e
            if len(both) > 3000:
                break
        made.append((spans[0], spans[1], links, groups if len(both) <= 3000 else None))
    held = Counter(p for _, _, links, _ in made for p in set(links))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(len(x), len(y), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), None if g is None else ";".join(g).encode()) for x, y, links, g in made]


@pytest.mark.parametrize("common", [alignment.COMMON, 40, 0])
def test_alignment_equals_tokens_by_hand(spark, odd, common, tmp_path):
    rows = [tuple(r) for r in odd.collect()]
    want = by_hand([t for _, t, _ in rows])
    path = str(tmp_path / "aligned")
    alignment.align(odd.withColumn("n_a", F.lit("clash")), A_PATH, B_PATH).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    done = spark.read.parquet(path)
    counts_path = str(tmp_path / "counts")
    alignment.link_counts(done, len(alignment.sides(A_PATH, B_PATH)[1].length)).write.parquet(counts_path)
    got = alignment.weigh_links(done, spark.read.parquet(counts_path), "_row", common).collect()
    key = lambda r: (r["extra"], r["n_a"], r["n_b"], r["n_links"], r["n_best"], r["count_sum"])
    assert Counter(map(key, got)) == Counter((e, *w[:5]) for (_, _, e), w in zip(rows, want))
    groups = {e: w[5] for (_, _, e), w in zip(rows, want)}
    for r in got:
        if groups[r["extra"]] is not None:
            assert bytes(r["groups"]) == groups[r["extra"]] and r["n_groups"] == (groups[r["extra"]].count(b"|"))
    assert sum(r["n_a"] == 0 for r in got) >= 3 and alignment.align(odd.limit(0), A_PATH, B_PATH).count() == 0


def test_alignment_of_nothing(spark, odd, tmp_path):
    alignment.align(odd.where("text is null"), A_PATH, B_PATH).withColumn("_row", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "none"))
    done = spark.read.parquet(str(tmp_path / "none"))
    counts = alignment.link_counts(done, 32000)
    got = alignment.weigh_links(done, counts, "_row").collect()
    assert [(r["n_a"], r["n_links"], r["n_best"], r["count_sum"]) for r in got] == [(0, 0, 0, 0)]


def test_both_encoders_of_side_a_agree():
    a, _ = alignment.sides(A_PATH, B_PATH)
    rng = np.random.default_rng(5)
    marks = "aZ09 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0'!~sßÿĀſǅȿ¼²¹ªº·'llve\x00\x7f\xad"
    texts = ["".join(rng.choice(list(marks), rng.integers(1, 60))) for _ in range(3000)] + ["a" * 30_000, "'" * 3000, " " * 5000 + "x"]
    assert [a.fast.encode_ordinary(t) for t in texts] == [e.ids for e in a.slow.encode_batch_fast(texts, add_special_tokens=False)]


def test_gradients_through_time():
    rng = np.random.default_rng(1)
    layer = lambda: language.Layer(rng.normal(0, 0.5, (9, 256)), rng.normal(0, 0.5, (9, 3)))
    net = language.Network(["x", "y"], layer(), layer(), rng.normal(0, 1, (2, 6)), rng.normal(0, 1, 2))
    raw = rng.integers(97, 100, 40).astype(np.uint8)
    codes, live, order = language.arranged(raw, np.array([0, 5, 14]), np.array([5, 9, 7]))
    label = np.array([1, 0, 1])[order]

    def loss():
        p = net.positions(codes, live)
        return -sum(np.log(p[t, label[w], w]) for t in range(len(live)) for w in range(live[t])) / live.sum()

    for weight, grad in zip(net.weights(), net.gradients(codes, live, label)):
        flat, g = weight.ravel(), grad.ravel()
        used = np.flatnonzero(np.abs(g) > 1e-3)[:6]
        assert len(used)
        for i in used:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 2e-2 * max(1, abs(g[i]))


def test_every_byte_has_one_window():
    offs = np.array([0, 0, 1, 129, 257, 700])
    start, size, row = language._windows(offs)
    assert sorted(b for s, n in zip(start, size) for b in range(s, s + n)) == list(range(700))
    assert all(offs[r] <= s and s + n <= offs[r + 1] for s, n, r in zip(start, size, row))


def test_language_of_held_out_texts(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    net = language.train(docs.where("doc_id % 2 = 0"), per_language=40)
    more = language.identify(odd.withColumn("score", F.lit("clash")), net, spans="spans").collect()
    assert len(more) == odd.count()
    for r in more:
        t = r["text"] or ""
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, t))) and 0 <= r["score"] <= 1
        if r["lang_pred"] == "und":
            assert r["score"] == 0 and r["spans"] == []
        else:
            assert [s["start"] for s in r["spans"]] == [0, *[s["end"] for s in r["spans"][:-1]]] and r["spans"][-1]["end"] == len(t.encode())
    assert {r["lang_pred"] for r in language.identify(odd, language.train(docs.limit(0))).collect()} == {"und"}
    same = spark.createDataFrame([(1, "der und die", "de")] * 500 + [(i, "the and of", "en") for i in range(2, 9)] + [(9, "null lang", None)], "doc_id long, text string, lang string")
    assert language.train(same, per_language=5).names == ["de", "en"]


def test_line_dedup_with_clashing_names_and_many_repeated_lines(spark):
    from graupel.llm import line_dedup

    rows = [(1, "keep\nkeep\nother line here", "g", "p"), (2, "\n".join(["same old line"] * 60_000) + "\nend of it", "g", "p"), (3, "other line here", None, "p"), (4, None, "g", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, row string").withColumns({"doc": F.lit(1), "parts": F.lit(2), "n_removed": F.lit("x")})
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {k: (r["text"], r["n_lines"], r["n_removed"], r["gone"], r["row"]) for k, r in got.items()} == {
        1: ("keep\nother line here", 3, 1, "g", "p"), 2: ("same old line\nend of it", 60_001, 59_999, "g", "p"), 3: ("", 1, 1, None, "p"), 4: (None, 0, 0, "g", None)}


def tiles_by_hand(pattern, text, minimum):
    """Covered words: again and again the longest free common run, of equals the first in pattern, then text."""
    used_p, used_t, covered = [False] * len(pattern), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < minimum:
            return covered
        used_p[p : p + n], used_t[t : t + n] = [True] * n, [True] * n
        covered += n


@pytest.mark.parametrize("small", [True, False])
def test_contaminated_pairs_equal_brute_force(spark, monkeypatch, small):
    from graupel.llm import decontaminate

    if not small:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    rng = np.random.default_rng(9)
    word = lambda k: [f"w{i}" for i in rng.integers(0, k, int(rng.integers(1, 26)))]
    items = [(i, " ".join(word(3) if i % 2 else word(60))) for i in range(14)] + [(20, None), (21, ""), (22, "solo"), (23, "x " * 30), (None, "no id of this one item here"), (5, "same id other text of item five")]
    items += [items[3], items[4], items[4]]
    docs = [(k, " ".join(word(3)), "t") for k in range(12)] + [(40, None, "t"), (41, "", "t"), (42, "SOLO", "t"), (43, "x " * 25, "t"), (None, "well no id of this one item here ok", "t")]
    for k in range(50, 62):  # reordered pieces of items
        w = (items[k % 14][1] or "").split()
        cut = len(w) // 2
        docs.append((k, " ".join([*word(50), *w[cut:], *word(50), *w[:cut]]), "t"))
    docs += [docs[-1], docs[-1], docs[13]]
    df = spark.createDataFrame(docs, "doc_id long, text string, _text string").withColumns({c: F.lit(c) for c in ("name", "doc", "item")}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    want = Counter()
    for i, t in items:
        p = (t or "").lower().split()
        for d, x, _ in docs:
            if p and (c := tiles_by_hand(p, (x or "").lower().split(), min(5, len(p)))) >= 0.5 * len(p):
                want[d, i, len(p), c] += 1
    assert len(want) > 12 and max(want.values()) >= 3
    got = decontaminate.contamination(df, bench).collect()
    assert Counter((r["doc_id"], r["item_id"], r["item_words"], r["covered"]) for r in got) == want
    bad = {d for d, *_ in want}
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _, _ in docs if d not in bad)
    with pytest.raises(TypeError):
        decontaminate.contamination(df, bench.withColumn("item_id", F.lit("x")))


def test_repeated_words_cost_one_entry_a_diagonal():
    import tracemalloc

    from graupel.llm import decontaminate
    from graupel.llm.text import Words

    one = lambda n: np.full(n, 12345, np.uint64)
    p, t, n = decontaminate.common_runs(one(2000), one(20_000), 5)
    assert len(p) == 2000 - 4 + 20_000 - 4 - 1 and n.max() == 2000
    raw = np.frombuffer(b"so " * 20_000, np.uint8)
    items = decontaminate.Items.of(__import__("pyarrow").table({"item_id": [1], "text": ["so " * 2000]}), 5)
    tracemalloc.start()
    found = list(decontaminate._matches(Words(raw, np.array([0, len(raw)])), items, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r, i, t) for r, i, t in found] == [(0, 0, [(0, 0, 2000)])] and peak < 300 << 20


def test_template_lines_make_no_pairs(spark):
    """Lines with 150 of 190 characters in common, none of them similar: what they are compared with doesn't grow with their number."""
    from graupel.llm import line_dedup

    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    form = letters(150)
    met = []
    for n in (500, 2000):
        lines = spark.createDataFrame([(form[:75] + letters(40) + form[75:],) for _ in range(n)], "line string").select(F.xxhash64("line").alias("h"), "line")
        scratch = line_dedup.Scratch(spark, "template")
        members = line_dedup._members(scratch.save(line_dedup._bands(lines), "bands"), scratch)
        assert members.groupBy("band").count().agg(F.max("count")).first()[0] > line_dedup.BLOCK / 4
        posts = scratch.save(line_dedup._posts(lines.select("h", F.col("h").alias("comp")), lines), "posts")
        met.append(sum(r["count"] * (r["count"] - 1) // 2 for r in posts.groupBy("band").count().collect()) / n)
    assert met[1] < 2 and met[0] < 2, met
    assert line_dedup.line_components(lines, scratch).count() == 0


def test_bounds_prune_from_coarse_to_fine():
    """Vectors along few directions; and the share that is left of the given ones, which have none."""
    from graupel.llm import topk

    def left(x, q):
        exact = (q @ x.T).astype(np.float64)
        floor = np.sort(exact, 1)[:, -5]
        fq, fc = topk._turned(q.astype(float), x.astype(float))
        shares = []
        for borders in topk._levels(x.shape[1]):
            a, b = topk._segments(fq, borders), topk._segments(fc, borders)
            bound = ((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - (a**2).sum(1)[:, None] - (b**2).sum(1)[None] + 2 * a @ b.T) / 2 + 1e-3
            assert (bound >= exact - 1e-3).all()
            shares.append(float((bound >= floor[:, None]).mean()))
        assert all(x >= y - 1e-9 for x, y in zip(shares, shares[1:])) and len(topk._levels(x.shape[1])[-1]) <= x.shape[1] // 2 + 3
        return shares

    rng = np.random.default_rng(12)
    low = np.floor(256 * (rng.normal(size=(3000, 12)) * 0.8 ** np.arange(12) @ rng.normal(size=(12, 64)))).astype(np.int64)
    shares = left(low, low[:60])
    assert shares[1] < 0.2 and shares[-1] < 0.02, shares
    rows = duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()
    given = np.floor(256 * np.array([r[0] for r in rows])).astype(np.int64)
    assert left(given, given[:40])[-1] < 0.9


def test_ids_of_top_k_are_integers(spark):
    from graupel.llm import topk

    df = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>")
    with pytest.raises(TypeError):
        topk.top_k(df, df)


def test_training_rows_of_one_id_stay_within_the_bound(spark):
    from graupel.llm import quality
    from graupel.session import Scratch

    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    seen = []

    class Kept(Scratch):
        def save(self, df, name="t", partition_by=None):
            out = super().save(df, name, partition_by)
            seen.append((name, out.count()))
            return out

    quality.train(docs, labels, bound=40, scratch=Kept(spark, "bound"))
    assert dict(seen)["sample"] == 40


def test_passages_need_integer_ids(spark):
    from graupel.llm import compact_windows

    with pytest.raises(TypeError):
        compact_windows.near_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_passages_near_the_similarity_are_found(spark):
    """Recall of changed copies of passages, against the Jaccard similarity of their five-word tokens; and no passage without such a pair."""
    from graupel.llm import compact_windows

    rng = np.random.default_rng(21)
    text = lambda n: [f"v{i}" for i in rng.integers(0, 50_000, n)]
    docs, planted = [], []
    for k in range(100):
        n, changes = ((60, 1), (120, 3), (240, 6), (52, 0))[k % 4]
        p = text(n)
        q = list(p)
        for at in np.linspace(0, n, changes + 2)[1:-1].astype(int):
            q[at] = f"changed{at}"
        docs += [(2 * k, " ".join(text(40) + p + text(30)), "x"), (2 * k + 1, " ".join(text(25) + q + text(45)), "x")]
        planted.append((2 * k + 1, 2 * k))
    docs += [(1000 + k, " ".join(text(200)), "clean") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = compact_windows.near_passages(df).collect()
    found = {(r["doc_id"], r["other_id"]) for r in got} | {(r["other_id"], r["doc_id"]) for r in got}
    assert sum(p in found for p in planted) >= 96
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    words = {d: t.split() for d, t, _ in docs}
    for r in got:  # every passage is as similar as it says
        a, b = grams(words[r["doc_id"]][r["start"] : r["end"]]), grams(words[r["other_id"]][r["other_start"] : r["other_end"]])
        assert 100 * len(a & b) >= 75 * len(a | b) and r["similarity"] == pytest.approx(len(a & b) / len(a | b))
        assert r["doc_id"] < 1000


def test_lines_that_hubs_have_met_are_not_compared_again(spark):
    """Pairs of unlike lines with a common band are decided by the band's hubs, so nothing is left of these bands."""
    from graupel.llm import line_dedup

    rng = np.random.default_rng(8)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    pairs = [(letters(150), letters(40), letters(40)) for _ in range(40)]
    lines = spark.createDataFrame([(form + end,) for form, *ends in pairs for end in ends], "line string").select(F.xxhash64("line").alias("h"), "line")
    scratch = line_dedup.Scratch(spark, "decided")
    members = line_dedup._members(scratch.save(line_dedup._bands(lines), "bands"), scratch)
    assert members.select("band").distinct().count() > 20
    assert line_dedup._open_bands(members, None, scratch).count() == 0
    assert line_dedup.line_components(lines, scratch).count() == 0


def test_hub_of_a_band_is_the_line_of_most_bands(spark):
    """Copies of a line, each with its own changes, have the line itself as a hub wherever it is, and the stars join nearly all of them."""
    from graupel.llm import line_dedup

    rng = np.random.default_rng(9)
    base = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 300)
    texts = ["".join(base)]
    for _ in range(120):
        own = base.copy()
        own[rng.choice(300, 3, replace=False)] = "#"
        texts.append("".join(own))
    lines = spark.createDataFrame([(x,) for x in texts], "line string").select(F.xxhash64("line").alias("h"), "line")
    scratch = line_dedup.Scratch(spark, "hubs")
    members = line_dedup._members(scratch.save(line_dedup._bands(lines), "bands"), scratch)
    first = lines.where(F.col("line") == texts[0]).first()["h"]
    own = members.where(F.col("h") == first).agg(F.count("*"), F.sum((F.col("high") == first).cast("int"))).first()
    assert own[0] >= 5 and own[1] == own[0]


def test_sketches_and_exact_test_count_repeated_windows_once(spark):
    """Number and parity of distinct windows, and the similarity of pairs, against sets by hand: repetitive, short and mixed lines."""
    from itertools import combinations

    from graupel.llm import line_dedup

    texts = ["x", "-" * 60, "-" * 20 + "abc" * 30, "abc" * 31, "0123456789 abcdefgh " * 4, "0123456789 abcdefgh " * 4 + "0123", "one line without any repeated part", "one line without any repeated parts"]
    lines = spark.createDataFrame(list(enumerate(texts)), "h long, line string")
    hashed = {r["w"]: r["x"] for r in spark.createDataFrame([(w,) for t in texts for w in {t[i : i + 8] for i in range(max(len(t) - 7, 1))}], "w string").select("w", F.xxhash64(F.encode("w", "UTF-16BE")).alias("x")).collect()}
    sets = [{hashed[t[i : i + 8]] for i in range(max(len(t) - 7, 1))} for t in texts]
    got = {r["h"]: r for r in line_dedup._sketches(lines).collect()}
    for h, xs in enumerate(sets):
        words = [0] * line_dedup.SKETCH
        for x in xs:
            words[x >> 6 & line_dedup.SKETCH - 1] ^= 1 << (x & 63)
        assert got[h]["n"] == len(xs)
        assert [got[h][f"s{k}"] % 2**64 for k in range(line_dedup.SKETCH)] == words
    pairs = [(a, b, texts[a], texts[b], len(sets[a]) + len(sets[b])) for a, b in combinations(range(len(texts)), 2)]
    near = spark.createDataFrame(pairs, "a long, b long, ta string, tb string, total int").where(line_dedup._exactly(F.col("ta"), F.col("tb"), F.col("total")))
    want = {(a, b) for a, b, *_ in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in near.collect()} == want and len(want) >= 2
