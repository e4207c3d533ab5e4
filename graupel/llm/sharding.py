"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Law ``rows``: shard counts differ by one at most.  Rows lie in logical source partitions; how
many rows each partition sends to each shard is drawn exactly (a matrix with fixed margins, drawn
by bisecting the partitions, each split by multivariate hypergeometric draws).  Rows are permuted
within their partition, dealt out by the matrix, exchanged, and permuted again within the shard,
which makes every arrangement equally likely (Sanders 1998; Gustedt 2008).

DataFrame expressions only.  The matrix has partitions x shards entries and is a table, never a
driver object.  Any column may be null, rows may repeat (each written row has an id of its own),
an empty table gives no rows; columns named as the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from graupel.session import Scratch

ROWS_PER_PARTITION = 200_000
LEAST_PARTITIONS = 256
#: Tails beyond so many deviations weigh less than a double's last bit.
DEVIATIONS = 9


def _let(value: Column, body) -> Column:
    """Binds a value once for use in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Marked items among ``draws`` from ``total`` of which ``marked`` are marked, by inversion of u.

    Weights start at 1 in the mode and follow the ratios of neighbouring probabilities, so no
    factorial is needed; the inverse runs over the mode, what lies above it, then below.
    """
    d = lambda c: c.cast("double")

    def with_bounds(x):
        low, high, mode, width, rest = (x[n] for n in ("low", "high", "mode", "width", "rest"))
        up = lambda k: (d(marked) - k) * (d(draws) - k) / ((k + 1.0) * (d(rest) + k + 1.0))
        down = lambda k: k * (d(rest) + k) / ((d(marked) - k + 1.0) * (d(draws) - k + 1.0))

        def steps(n):
            return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))

        def walk(n, ratio, sign, target):
            zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("below"))

            def add(a, i):
                return _let(a["w"] * ratio(d(mode) + d(i) * sign), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"), (a["below"] + F.when(a["s"] + w <= target, 1).otherwise(0).cast("long")).alias("below")))

            return F.aggregate(steps(n), zero, add)

        n_up, n_down = F.least(high - mode, width), F.least(mode - low, width)

        def choose(s):
            t = u * (s["up"] + s["down"] + 1.0)
            return _let(t, lambda t: F.when(t < 1.0, mode)
                        .when(t < s["up"] + 1.0, F.least(mode + n_up, mode + 1 + walk(n_up, up, 1.0, t - 1.0)["below"]))
                        .otherwise(F.greatest(mode - n_down, mode - 1 - walk(n_down, down, -1.0, t - 1.0 - s["up"])["below"])))

        none = F.lit(-1.0)
        return _let(F.struct(walk(n_up, up, 1.0, none)["s"].alias("up"), walk(n_down, down, -1.0, none)["s"].alias("down")), choose)

    low, high = F.greatest(F.lit(0).cast("long"), draws + marked - total), F.least(draws, marked)
    mode = F.floor((d(draws) + 1) * (d(marked) + 1) / (d(total) + 2)).cast("long")
    spread = F.sqrt(d(draws) * d(marked) * d(total - marked) * d(total - draws) / (d(total) * d(total) * F.greatest(d(total) - 1, F.lit(1.0))))
    bounds = F.struct(low.alias("low"), high.alias("high"), F.greatest(low, F.least(high, mode)).alias("mode"), (F.ceil(spread * DEVIATIONS) + 20).cast("long").alias("width"), (total - marked - draws).alias("rest"))
    return F.when(total <= 0, F.lit(0).cast("long")).otherwise(_let(bounds, with_bounds))


def _drawer(seed: int, width: int):
    """Draws for one shard after another: the left half's part of its capacity."""

    def draw(a, s):
        cap = F.element_at("caps", s)
        drawn = hypergeometric(a["total"], cap, a["need"], _uniform(F.lit(seed), F.lit(width), F.col("lo"), s))
        return _let(drawn, lambda x: F.struct((a["need"] - x).alias("need"), (a["total"] - cap).alias("total"), F.concat(a["out"], F.array(x)).alias("out")))

    return draw


def communication_matrix(counts: DataFrame, partitions: int, shards: int, seed: int) -> DataFrame:
    """``part, ends`` (running totals of its row): exact draws for ``counts`` (part, n)."""
    spark = counts.sparkSession
    dense = spark.range(partitions).select(F.col("id").alias("part")).join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    listed = dense.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("c")).select(F.transform("c", lambda x: x["n"]).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    node = listed.withColumn("total", total).select(
        "c", F.lit(0).cast("long").alias("lo"), F.lit(partitions).cast("long").alias("width"),
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards).cast("long") + F.when(s < F.col("total") % shards, 1).otherwise(0).cast("long")).alias("caps"),
    )
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    width = partitions
    while width > 1:
        half = width // 2
        state = F.struct(F.aggregate(F.slice("c", 1, half), zero, add).alias("need"), F.aggregate("caps", zero, add).alias("total"), F.array().cast("array<bigint>").alias("out"))

        node = node.withColumn("left", F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, _drawer(seed, width))["out"])
        both = F.array(
            F.struct(F.slice("c", 1, half).alias("c"), F.col("lo").alias("lo"), F.col("left").alias("caps")),
            F.struct(F.slice("c", half + 1, half).alias("c"), (F.col("lo") + half).alias("lo"), F.zip_with("caps", "left", lambda x, y: x - y).alias("caps")),
        )
        node = node.select(F.explode(both).alias("x")).select("x.*")
        width = half
        if partitions // width == 16:
            node = node.repartition(16, "lo")
    running = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("caps", 1, s), zero, add))
    return node.select(F.col("lo").alias("part"), running.alias("ends"))


def shard_uniform(df: DataFrame, shards: int, seed: int = 17, scratch: Scratch | None = None) -> DataFrame:
    """Adds ``shard`` (int, 0 to shards-1) and ``slot`` (long, gapless from 0 in its shard)."""
    scratch = scratch or Scratch(df.sparkSession, "sharding")
    df = df.drop("shard", "slot")
    keep = df.columns
    rows = scratch.save(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    power = lambda least, n: 1 << max(least.bit_length() - 1, max(0, int(n) - 1).bit_length())
    partitions = power(LEAST_PARTITIONS, total / ROWS_PER_PARTITION)
    buckets = power(16, total / shards / ROWS_PER_PARTITION)
    rows = rows.withColumns({"_part": F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(partitions)), "_first": F.xxhash64(F.lit(seed + 1), "_row"), "_second": F.xxhash64(F.lit(seed + 2), "_row")})
    matrix = scratch.save(communication_matrix(rows.groupBy("_part").agg(F.count("*").alias("n")).withColumnRenamed("_part", "part"), partitions, shards, seed), "matrix")
    local = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_first", "_row")))
    dealt = local.join(matrix.withColumnRenamed("part", "_part"), "_part").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("_rank"))))
    dealt = dealt.withColumn("_bucket", F.shiftrightunsigned("_second", 64 - (buckets.bit_length() - 1)))
    dealt = scratch.save(dealt.select(*keep, "shard", "_bucket", "_second", "_row"), "dealt")
    sizes = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"))
    inner = Window.partitionBy("shard", "_bucket").orderBy("_second", "_row")
    return dealt.withColumn("_slot", F.row_number().over(inner)).join(starts, ["shard", "_bucket"]).select(*keep, "shard", (F.col("_start") + F.col("_slot") - 1).cast("long").alias("slot"))


def sharding_query(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents into shards 0 to 23: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shard_uniform(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
