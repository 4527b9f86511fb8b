"""Connected components of an edge table, and results kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A session of one machine (``local``) that names none gets a temporary folder; on a
    cluster that is an error, as executors could not read each other's files there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="geoloom-"))
        named = sc.getCheckpointDir()
    return named if "://" in named or named.startswith("file:") else f"file://{named}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: lost executors cost a reread only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_join(big: DataFrame, small: DataFrame, key: list[str], how: str = "inner", most: int = 200_000) -> DataFrame:
    """``big`` joined with an aggregate that has few rows a key: computed once, counted, and broadcast if it has at most ``most`` rows, so that ``big`` need not move.

    More rows are joined by sorting, as Spark would still broadcast them where its size
    estimate, kept over the checkpoint, doesn't hold exploded rows.
    """
    small = checkpointed(small)
    return big.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small.hint("merge"), key, how)


def skew_join(big: DataFrame, small: DataFrame, key: list[str], how: str = "inner", share: int = 1000, most_bytes: int = 64 << 20, salts: int = 64) -> DataFrame:
    """``big`` joined with ``small``, which has one row a key, without a task that holds a crowded key.

    Keys with over a thousandth of the rows of ``big``, of which there are under a
    thousand, are counted first and joined by a broadcast of their rows of ``small``,
    if those have at most ``most_bytes`` as text; larger ones are copied ``salts``
    times and the rows of ``big`` dealt to the copies.  All other keys are shuffled.
    ``big`` is read twice, so it should be stored.
    """
    total = big.count()
    if total < 10 * share:
        return big.join(small, key, how)
    hot = checkpointed(big.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > total / share).select(*key))
    if not hot.limit(1).count():
        return big.join(small, key, how)
    few = checkpointed(small.join(F.broadcast(hot), key, "left_semi"))
    crowded, calm = big.join(F.broadcast(hot), key, "left_semi"), big.join(F.broadcast(hot), key, "left_anti").join(small, key, how)
    if (few.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most_bytes:
        return crowded.join(F.broadcast(few), key, how).unionByName(calm)
    dealt = crowded.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*key, "_salt"], how).drop("_salt").unionByName(calm)


def alike(features: DataFrame, fid: str, shape: str = "geom", least: float = 2.0, stored: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(``(fid, shape)`` with one row of each shape, ``(fid, _alike)`` of all rows): work on a shape need be done once, and the second table gives it to the rows like it.

    ``_alike`` is the least ``fid`` of the shape.  If shapes are on average met fewer than
    ``least`` times, all rows and None are returned.  Null shapes are left out.  Features
    that aren't ``stored`` are kept in the shared folder first.
    """
    own = features.where(F.col(shape).isNotNull()).select(fid, shape)
    own = own if stored else checkpointed(own)
    lone = checkpointed(own.groupBy(shape).agg(F.min(fid).alias(fid)).select(fid, shape))
    if lone.count() * least > own.count():
        return own, None
    return lone, skew_join(own, lone.select(shape, F.col(fid).alias("_alike")).hint("merge"), [shape]).select(fid, "_alike")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with a link; component is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): a long
    chain shrinks by a factor each round.  A node's least neighbour is a
    pre-aggregated minimum.  Nodes with over a thousandth of all rows, of which there
    are under a thousand, get theirs by a broadcast of those few rows, so no task
    holds all neighbours of a hub.  Each round is kept in the shared folder.  Null
    ends and loops are ignored; an empty table gives no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = checkpointed(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    seen = _signature(links)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        links = checkpointed(_small_star(_large_star(links, 2 * seen[0]), seen[0]))
        now = _signature(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_least(links: DataFrame, least: DataFrame, rows: int, share: int = 1000) -> DataFrame:
    """Links with ``m`` of their ``u``; least: ``(u, m, n)``, n being the rows of that u, of at most ``rows`` in all."""
    if rows < 10 * share:
        return links.join(least.drop("n"), "u")
    hubs = F.broadcast(least.where(F.col("n") > rows / share).select("u", F.col("m").alias("_m")))  # under ``share`` rows
    told = links.join(hubs, "u", "left")
    return told.where("_m is not null").select("u", "v", F.col("_m").alias("m")).unionByName(told.where("_m is null").drop("_m").join(least.drop("n"), "u").select("u", "v", "m"))


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    down = _with_least(links, least, rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
