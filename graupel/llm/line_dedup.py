"""Fuzzy line deduplication by MinHash, with DataFrame expressions only.

Lines are the parts of a text between newlines; blank ones (white space only) are never removed.  Lines are made distinct
first (one node for each text, named by its 64-bit hash), so that a line is hashed once however often it occurs.
A line is the set of its windows of ``GRAM`` UTF-16 units (a shorter line is one).  One hash deals the windows to
``GROUPS`` groups of ``ROWS`` bins; the least hash of a bin is one MinHash value (one-permutation hashing), an empty bin borrows from the
next full one of its group, and a group is a band of ``ROWS`` values.  A pair with a Jaccard similarity of 0.8
shares a band with odds of about 0.98 at every length (tested); shorter lines, whose groups hold few windows, more likely.

Equal bands make candidates, which pass a parity sketch (its distance never exceeds the symmetric difference) before
the exact Jaccard test: each line with two hubs of each of its bands; then, where a band's other lines still make more than one
component, the lines outside the largest one with all others.  Where more than ``ASKS`` lines are outside, the band's lines can meet by their rarest windows instead
(prefix filter: similar lines have one of these in common; taken where that makes fewer comparisons).  So every pair with a common band is decided, and a template that many unlike lines share
makes no pairs.  Links become components; the first line of each component, by (id, text, place), stays.
Null texts have no lines; rows with equal id and text count as one row (both keep the same lines).
Empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from graupel.operators.graph import connected_components
from graupel.session import Scratch

GRAM = 8
GROUPS = 10
ROWS = 5
NUM, DEN = 80, 100
#: Shared bands and lines to be looked up are broadcast up to so many rows of 24 bytes (checked), else joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Lines of a block.
BLOCK = 256
#: Lines outside its largest component up to which a band is compared as it is.
ASKS = 48
#: 64-bit words of the parity sketch.
SKETCH = 8
#: ASCII white space within a line.
BLANKS = " \t\x0b\x0c\r"


def _windows(wide: Column) -> Column:
    """Number of windows of a line in UTF-16."""
    return F.greatest(F.octet_length(wide) / 2 - (GRAM - 1), F.lit(1)).cast("int")


def _hashes(line: Column) -> Column:
    """Hashes of the windows of a line, repeated ones too."""
    windows = lambda wide: F.transform(F.sequence(F.lit(1), _windows(wide) * 2 - 1, F.lit(2)), lambda i: F.xxhash64(F.substring(wide, i, F.lit(2 * GRAM))))
    return F.element_at(F.transform(F.array(F.encode(line, "UTF-16BE")), windows), 1)


def _grams(line: Column) -> Column:
    """Distinct hashes of the windows of a line."""
    return F.array_distinct(_hashes(line))


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row for each line that isn't blank: id, row (hash of id and text), pos, line, h."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.xxhash64(id, text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(F.octet_length(F.ltrim("line", F.lit(BLANKS))) > 0).withColumn("h", F.xxhash64("line"))


def _texts(lines: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """h and line of the wanted lines, each once."""
    some = lines.select("h", "line").join(F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted, "h", "left_semi")
    return some.groupBy("h").agg(F.any_value("line").alias("line"))


def _bands(lines: DataFrame) -> DataFrame:
    """h and each of its bands."""
    texts = lines.groupBy("h").agg(F.any_value("line").alias("line"))
    wide = texts.select("h", F.encode("line", "UTF-16BE").alias("wide"))
    places = wide.select("h", "wide", F.explode(F.sequence(F.lit(0), _windows(F.col("wide")) - 1)).alias("i"))
    hashed = places.select("h", F.xxhash64(F.substring("wide", F.col("i") * 2 + 1, F.lit(2 * GRAM))).alias("x"))
    part = lambda shift, count: (F.shiftrightunsigned("x", shift).bitwiseAND(F.lit(0xFFFF)) % count).cast("int")
    dealt = hashed.select("h", part(48, GROUPS).alias("g"), part(32, ROWS).alias("bin"), F.col("x").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("v"))
    # grouped by h before, so this needs no further shuffle
    minima = dealt.groupBy("h", "g").agg(*[F.expr(f"min(v) filter (where bin = {k})").alias(f"m{k}") for k in range(ROWS)])
    return minima.select("h", F.xxhash64("g", *[F.coalesce(*[F.col(f"m{(k + p) % ROWS}") for p in range(ROWS)]) for k in range(ROWS)]).alias("band"))


def _members(bands: DataFrame, scratch: Scratch) -> DataFrame:
    """Lines of shared bands, each with two hubs of the band: the line of the fewest (low) and that of the most lines in all of its bands (high)."""
    shared = scratch.save(bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    found = scratch.save(bands.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "band"), "found")
    weight = found.groupBy("h").agg(F.sum("m").alias("w"))
    rank = F.struct("w", "h")
    hubs = found.join(weight, "h").groupBy("band").agg(F.min(rank)["h"].alias("low"), F.max(rank)["h"].alias("high"))
    members = scratch.save(found.join(hubs, "band").select("band", "h", "low", "high"), "members")
    scratch.free(shared, found)
    return members


def _sketches(texts: DataFrame) -> DataFrame:
    """h, number of its distinct windows and their parity sketch."""
    # windows in order, so repeated ones stand side by side
    ordered = texts.select("h", F.sort_array(_hashes(F.col("line"))).alias("g"))
    places = ordered.select("h", "g", F.explode(F.sequence(F.lit(0), F.size("g") - 1)).alias("i"))
    grams = places.select("h", F.get("g", F.col("i")).alias("x"), F.get("g", F.col("i") - 1).alias("before")).where("before is null or x <> before")
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
    flips = grams.select("h", F.shiftright("x", 6).bitwiseAND(F.lit(SKETCH - 1)).cast("int").alias("word"), flip.alias("flip"))
    words = [F.expr(f"coalesce(bit_xor(flip) filter (where word = {k}), 0L)").alias(f"s{k}") for k in range(SKETCH)]
    return flips.groupBy("h").agg(F.count("*").cast("int").alias("n"), *words)


def _exactly(a: Column, b: Column, total: Column) -> Column:
    """Whether two lines, whose distinct windows are ``total`` in all, have the similarity."""
    # an intersection holds each window once, so its sides need not
    return F.size(F.array_intersect(_hashes(a), _hashes(b))) * (DEN + NUM) >= total * NUM


def _near(x: str, y: str) -> Column:
    """Whether sizes and sketches of two lines allow the similarity."""
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (F.least(f"{x}.n", f"{y}.n") * DEN >= F.greatest(f"{x}.n", f"{y}.n") * NUM) & (_apart(x, y) * (DEN + NUM) <= total * (DEN - NUM))


def _apart(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))


def _stars(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Each line with the hubs of its bands (a, b) and the number of both's distinct windows (total), where their sketches are near."""
    pairs = members.select(F.col("h").alias("b"), F.explode(F.array("low", "high")).alias("a")).where("a <> b").distinct()
    one = pairs.join(sketches.withColumnRenamed("h", "a"), "a").select("b", F.struct("a", "n", *[f"s{k}" for k in range(SKETCH)]).alias("x"))
    both = one.join(sketches.select(F.col("h").alias("b"), F.struct("n", *[f"s{k}" for k in range(SKETCH)]).alias("y")), "b")
    return both.where(_near("x", "y")).select("x.a", "b", (F.col("x.n") + F.col("y.n")).alias("total"))


def _open_bands(members: DataFrame, comps: DataFrame | None, scratch: Scratch) -> DataFrame:
    """band, h, comp, major (the band's largest component), m (its lines) and out (those outside major) for bands that hold several components; bands of the same lines count once.

    A band's hubs have met all of its lines, so they are left out.
    """
    if "low" in members.columns:
        members = members.where("h <> low and h <> high")
    known = members.select("band", "h", F.col("h").alias("comp")) if comps is None else members.join(comps, members["h"] == comps["node"], "left").select("band", "h", F.coalesce("component", "h").alias("comp"))
    placed = scratch.save(known, "placed")
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("m"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("sign"))
    several = sizes.groupBy("band").agg(F.max(F.struct("m", "comp"))["comp"].alias("major"), (F.sum("m") - F.max("m")).alias("out"), F.sum("m").alias("m"), F.count("*").alias("comps"), F.sum("sign").alias("sign")).where("comps > 1")
    once = several.groupBy("sign", "m", "major", "out").agg(F.min("band").alias("band")).drop("sign")
    found = scratch.save(placed.join(once, "band"), "open")
    scratch.free(placed)
    return found


def _posts(lines: DataFrame, texts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """h, comp and each of the line's rarest windows (band), so many that two similar lines have one of these in common.

    Windows of one line only lead the order and join nothing, so they are counted and don't travel.
    """
    scratch = scratch or Scratch(lines.sparkSession, "posts")
    grams = lines.join(texts, "h").select("h", "comp", _grams(F.col("line")).alias("g")).select("h", "comp", F.size("g").alias("n"), F.explode("g").alias("x"))
    often = scratch.save(grams.groupBy("x").agg(F.count("*").alias("often")).where("often > 1"), "often")
    own = Window.partitionBy("h")
    shared = grams.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, "x")
    rank = F.row_number().over(own.orderBy("often", "x")) + F.col("n") - F.count("*").over(own)
    rare = shared.withColumn("rank", rank).where(F.col("rank") <= F.floor(F.col("n") * (DEN - NUM) / DEN) + 1)
    return rare.select(F.xxhash64("x").alias("band"), "h", "comp")


def _comparisons(rows: DataFrame) -> int:
    """Comparisons that bands take: each line outside the largest component with all of its band."""
    bands = rows.groupBy("band").agg(F.max(F.col("m") * F.col("out")).alias("pairs"))
    return bands.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def _links_apart(members: DataFrame, comps: DataFrame | None, sketches: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Two components (a, b) for every two that a pair of similar lines with a common band joins.

    In a band, the lines outside its largest component are compared with all others.  Where more than ``ASKS`` lines are outside, the band's lines can meet by
    their rarest windows instead, of which similar lines have one in common, so lines that share a template only don't meet; the way of fewer comparisons is taken.  Large bands are compared in blocks; a block gives a component once for each line, however many of its lines are similar.
    """
    rows = _open_bands(members, comps, scratch)
    large = rows.where(F.col("out") > ASKS).select("h", "comp").distinct()
    if not large.isEmpty():
        posts = scratch.save(_posts(large, texts, scratch), "posts")
        own = posts.select("h", F.col("comp").alias("component")).distinct().withColumnRenamed("h", "node")
        by_posts = _open_bands(posts.select("band", "h"), own, scratch)
        # both ways decide all pairs of these bands
        if _comparisons(by_posts) < _comparisons(rows.where(F.col("out") > ASKS)):
            rows = rows.where(F.col("out") <= ASKS).unionByName(by_posts)
        scratch.free(posts)
    words = [f"s{k}" for k in range(SKETCH)]
    rows = scratch.save(rows.join(sketches, "h").select("band", "h", "comp", (F.col("comp") == F.col("major")).alias("inner"), "m", "out", "n", *words), "entries")
    # first by size and sketch: the places of lines that have a line of another component near them
    maybe = scratch.save(_near_places(rows, words), "maybe")
    # then these lines by their windows
    texts = texts.join(maybe.select("h").distinct(), "h", "left_semi").select("h", _grams(F.col("line")).alias("g"))
    return _joined(rows.join(maybe, ["band", "h"], "left_semi").join(texts, "h"), words)


def _could(x: Column, y: Column, words: list[str]) -> Column:
    """Whether components, sizes and sketches of two entries allow a link."""
    total = x["n"] + y["n"]
    apart = sum((F.bit_count(x[w].bitwiseXOR(y[w])) for w in words[1:]), F.bit_count(x[words[0]].bitwiseXOR(y[words[0]])))
    return (x["comp"] != y["comp"]) & (F.least(x["n"], y["n"]) * DEN >= F.greatest(x["n"], y["n"]) * NUM) & (apart * (DEN + NUM) <= total * (DEN - NUM))


def _blocked(rows: DataFrame, fields: list[str]) -> DataFrame:
    """xs (entries outside the largest component) and ys (entries) that meet: one row for a band of up to ``BLOCK`` lines, else one for each two blocks."""
    entry = F.struct(*fields)
    small = rows.where(F.col("m") <= BLOCK).groupBy("band").agg(F.collect_list(entry).alias("ys")).select("band", F.filter("ys", lambda y: ~y["inner"]).alias("xs"), "ys")
    block = lambda count: F.pmod(F.xxhash64("h"), F.ceil(F.col(count) / BLOCK))
    large = rows.where(F.col("m") > BLOCK)
    held = large.groupBy("band", block("m").alias("block")).agg(F.collect_list(entry).alias("ys"))
    asks = large.where(~F.col("inner")).groupBy("band", block("out").alias("block")).agg(F.collect_list(entry).alias("xs"))
    return small.union(asks.drop("block").join(held.drop("block"), "band").select("band", "xs", "ys"))


def _near_places(rows: DataFrame, words: list[str]) -> DataFrame:
    """band and h of the entries that could be similar to one of another component."""
    fits = lambda x, y: _could(x, y, words)
    asked = F.filter("xs", lambda x: F.exists("ys", lambda y: fits(x, y)))
    # whom nobody outside finds isn't looked at again
    met = _blocked(rows, ["h", "comp", "inner", "n", *words]).select("band", asked.alias("xs"), "ys").where(F.size("xs") > 0)
    found = F.concat(F.transform("xs", lambda x: x["h"]), F.transform(F.filter("ys", lambda y: F.exists("xs", lambda x: fits(x, y))), lambda y: y["h"]))
    return met.select("band", F.explode(found).alias("h")).distinct()


def _joined(rows: DataFrame, words: list[str]) -> DataFrame:
    """Components (a, b) of similar entries with g, their windows; each entry gives a component once a block."""
    enough = lambda x, y: F.size(F.array_intersect(x["g"], y["g"])) * (DEN + NUM) >= (x["n"] + y["n"]) * NUM
    others = lambda x: F.array_distinct(F.transform(F.filter("ys", lambda y: _could(x, y, words) & enough(x, y)), lambda y: y["comp"]))
    pairs = F.transform("xs", lambda x: F.struct(x["comp"].alias("a"), others(x).alias("bs")))
    return _blocked(rows, ["comp", "inner", "n", *words, "g"]).select(F.explode(pairs).alias("p")).select("p.a", F.explode("p.bs").alias("b")).distinct()


def line_components(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component for the lines (h, line; rows may repeat) that are similar to another one."""
    bands = scratch.save(_bands(lines), "bands")
    members = _members(bands, scratch)
    scratch.free(bands)
    wanted = scratch.save(members.select("h").distinct(), "wanted")
    texts = scratch.save(_texts(lines, wanted, wanted.count()), "texts")
    sketches = scratch.save(_sketches(texts), "sketches")
    side = lambda p: texts.select(F.col("h").alias(p), F.col("line").alias(f"t{p}"))
    # most links by the two hubs of each band
    stars = _stars(members, sketches).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total").distinct()
    near = stars.join(side("a"), "a").join(side("b"), "b").where(_exactly(F.col("ta"), F.col("tb"), F.col("total"))).select("a", "b")
    comps = scratch.save(connected_components(scratch.save(near, "links"), scratch=scratch), "stars")
    # then whatever joins two components: each such pair of components is found, so once is enough
    more = scratch.save(_links_apart(members, comps, sketches, texts, scratch), "more")
    if more.isEmpty():
        return comps
    edges = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    return scratch.save(connected_components(edges, scratch=scratch), "all")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed"), scratch: Scratch | None = None) -> DataFrame:
    """All columns; ``text`` without repeated lines, and the numbers of lines and of removed ones, named by ``counts`` (int; null text: 0)."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    docs = docs.drop(*counts)
    lines = scratch.save(_lines(docs, id, text), "lines")
    comps = scratch.save(line_components(lines, scratch), "components")
    place = F.struct("id", "row", "pos")
    # lines that come once and are like no other stay
    again = scratch.save(lines.groupBy("h").count().where("count > 1").select("h").union(comps.select("node")).distinct(), "again")
    several = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    places = scratch.save(lines.select("id", "row", "pos", "h").join(several, "h", "left_semi").distinct(), "places")
    firsts = scratch.save(places.groupBy("h").agg(F.min(place).alias("first")), "firsts")
    named = firsts.join(comps, firsts["h"] == comps["node"], "left").select("first", F.coalesce("component", "h").alias("component"))
    kept = scratch.save(named.groupBy("component").agg(F.min("first").alias("first")).select("first.row", "first.pos"), "kept")
    gone = places.join(kept, ["row", "pos"], "left_anti").groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = scratch.save(gone, "gone")
    rows, places_gone = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS and places_gone <= 4 * BROADCAST_ROWS
    # the documents' columns travel as one, so none of their names can clash
    own = docs.select(F.xxhash64(id, text).alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    both = own.join(F.broadcast(gone) if few else gone, "row", "left")
    parts = F.split(F.col("doc")[text], "\n")
    # places that stay by a hashed difference, so steps follow the lines; the array of one binds what is computed once
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["parts"]) - 1), x["gone"]), lambda i: F.element_at(x["parts"], i + 1))
    left = F.element_at(F.transform(F.array(F.struct(parts.alias("parts"), "gone")), stay), 1)
    names = [F.when(F.col("gone").isNull(), F.col("doc")[text]).otherwise(F.array_join(left, "\n")).alias(text) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
    return both.select(*names, F.coalesce(F.size(parts), F.lit(0)).alias(counts[0]), F.coalesce(F.size("gone"), F.lit(0)).alias(counts[1]))


def line_query(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
