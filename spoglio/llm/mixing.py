"""Drawing records so that every source reaches its share of the total: a multivariate-hypergeometric
splitting tree deals exact block quotas to output shards.

The records of a source are permuted by a seeded hash and cut into blocks of a set share of a shard, so that blocks keep
their size and their number grows with the source. A source that must appear r.f times is drawn as r whole passes over its blocks and a
part of one more pass, which ends inside one block, at the record where the quota is met. The drawn blocks of all sources are dealt to
the output shards from the root of a binary tree: at every node the left half of the shards receives a number of each source's blocks
drawn from the multivariate hypergeometric distribution, the right half the rest, so the quotas are met exactly at every level. Each node's
draw is seeded by its place alone, so tasks expand ranges of shards of their own and follow only the nodes above them. A shard takes the
next disjoint blocks of each source's own permutation and shuffles locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoglio.llm.tokens import VOCABULARY, count_tokens
from spoglio.session import materialize


def split_range(quotas: np.ndarray, n_shards: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks of each source dealt to the shards before it, blocks of each source it draws) of the shards first..last-1."""
    todo = [(0, n_shards, np.zeros(len(quotas), dtype=np.int64), np.asarray(quotas, dtype=np.int64))]
    while todo:
        at, n, before, have = todo.pop()
        if at >= last or at + n <= first:
            continue
        if n == 1:
            yield at, before, have
            continue
        left = n // 2
        take = int(have.sum()) * left // n
        if have.sum() < 1_000_000_000:
            part = np.random.default_rng([seed, at, n]).multivariate_hypergeometric(have, take, method="marginals")
        else:  # the generator's own bound: round the expected values, exact in sum
            part = np.floor(have * (take / have.sum())).astype(np.int64)
            part[np.argsort(part - have * (take / have.sum()))[: take - part.sum()]] += 1
        todo += [(at + left, n - left, before + part, have - part), (at, left, before, part)]


def split_tree(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """(n_shards, n_sources) blocks: row i holds what shard i draws; columns add up to `quotas`, rows are even."""
    return np.array([have for _, _, have in split_range(quotas, n_shards, seed, 0, n_shards)])


def deal(spark, sources: list[str], quotas: np.ndarray, n_shards: int, seed: int) -> DataFrame:
    """source, shard, place: which place in the permutation of each source's drawn blocks goes to which shard."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rows = [(s, shard, int(b), int(b + h)) for shard, before, have in split_range(quotas, n_shards, seed, int(batch["id"].min()), int(batch["id"].max()) + 1) for s, b, h in zip(sources, before, have) if h]
            yield pd.DataFrame(rows, columns=["source", "shard", "from", "to"])

    ranges = spark.range(n_shards, numPartitions=max(1, min(200, n_shards // 64))).mapInPandas(expand, "source string, shard long, from long, to long")
    return ranges.select("source", "shard", F.explode(F.sequence("from", F.col("to") - 1)).alias("place"))


def stride(n: int, seed: int) -> tuple[int, int]:
    """(a, c) of the permutation i -> (a i + c) mod n of 0..n-1."""
    rng = np.random.default_rng([seed, n])
    a = int(n * 0.6180339887) + int(rng.integers(max(1, n // 8)))
    while math.gcd(a := max(a, 1), n) != 1:
        a += 1
    return a % n or 1, int(rng.integers(n))


def plan_quotas(sizes: pd.DataFrame, total_tokens: int | None = None) -> pd.DataFrame:
    """sizes: source, target_share, max_repeats, n_docs, size. Adds quota (tokens to draw).

    Without `total_tokens` the total is the largest at which every source that has text reaches its share; a
    source without documents reaches nothing and the others share its part in proportion, which the report
    shows. With `total_tokens`, a source too small for its share gives max_repeats times its size.
    """
    out = sizes.copy()
    there = (out["size"] > 0) & (out["target_share"] > 0) & (out["max_repeats"] > 0)
    share = out["target_share"].where(there, 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    most = (out["size"] * out["max_repeats"]).where(there, 0)
    total = float(total_tokens) if total_tokens is not None else float((most[there] / share[there]).min()) if there.any() else 0.0
    out["quota"] = [int(min(m, math.floor(s * total + 1e-6))) for s, m in zip(share, most)]
    return out


DRAWN = "source, doc_id, repeat_no, n_tokens, shard, position"


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, shard_tokens: int = 250_000,
                shard_blocks: int = 16, seed: int = 11, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(drawn, report) from docs (doc_id, text, source) and targets (source, target_share, max_repeats).

    drawn: source, doc_id, repeat_no (from 1), n_tokens, shard, position (from 1 in the shard). A document is drawn
    max_repeats times at most, whole each time; a source passes its quota by less than one document. Documents
    with a null or unlisted source, null texts and texts of no token are never drawn; targets with null fields are
    left out; rows delivered twice under one doc_id count once (any of them if they differ); ties in the permutation are settled by doc_id.
    report: source, target_share, max_repeats, n_docs, available_tokens, quota_tokens, drawn_tokens, actual_share,
    repeats (drawn/available). Empty inputs give no rows drawn.

    A shard holds about `shard_tokens`, a block a `shard_blocks`th of that, whatever the size of its source. `targets` is small
    by nature (a line for each source) and is read by the driver, as are three figures for each listed source; blocks, units
    and shards are rows of tables.
    """
    spark = docs.sparkSession
    wanted = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna().dropDuplicates(["source"]).toPandas()
    listed = docs.where(F.col("source").isin(wanted["source"].tolist())).where(F.col("text").isNotNull())
    sized = count_tokens(listed.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), ["doc_id", "source"], vocabulary=vocabulary)
    sized = sized.where("n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("x")).select("doc_id", "x.source", "x.n_tokens")
    sized = materialize(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), "mix-sizes")

    totals = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("size")).toPandas()
    sizes = wanted.merge(totals, on="source", how="left").fillna({"n_docs": 0, "size": 0}).sort_values("source").reset_index(drop=True)
    sizes = plan_quotas(sizes, total_tokens)
    sizes["blocks"] = np.ceil(sizes["size"] * shard_blocks / shard_tokens).clip(1).astype("int64")
    used = sizes[sizes["quota"] > 0]
    passes = [(r.source, int(r.blocks), *divmod(int(r.quota), int(r.size))) for r in used.itertuples()]
    passes = F.broadcast(spark.createDataFrame(passes, "source string, blocks long, whole long, rest long"))  # a line for each source

    # the top bits of the hash name the block, the whole hash the order within it
    blocked = sized.join(passes, "source").withColumn("block", F.pmod(F.shiftrightunsigned("h", 20), F.col("blocks"))).select("source", "doc_id", "n_tokens", "h", "block")
    per_block = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("size")).withColumn("run", F.floor(F.col("block") / 4096))
    # running totals in two steps, so that no task holds all blocks of a source
    runs = per_block.groupBy("source", "run").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_run, in_run = Window.partitionBy("source").orderBy("run"), Window.partitionBy("source", "run").orderBy("block")
    runs = runs.select("source", "run", ahead("size", by_run).alias("size_ahead"), ahead("n", by_run).alias("n_ahead"))
    placed = per_block.join(runs, ["source", "run"]).join(passes, "source").select(
        "source", "block", "size", "whole", (F.col("rest") - F.col("size_ahead") - ahead("size", in_run)).alias("upto"), (F.col("n_ahead") + F.row_number().over(in_run) - 1).alias("rank"))
    placed = materialize(placed, "mix-blocks")

    # blocks are drawn in every whole pass, and in one more up to the place where the quota is met
    counted = {r.source: (r.n, r.whole * r.n + r.k) for r in placed.groupBy("source").agg(F.count("*").alias("n"), F.first("whole").alias("whole"), F.count_if(F.col("upto") > 0).alias("k")).collect()}
    names = sorted(counted)
    steps = spark.createDataFrame([(s, counted[s][0], counted[s][1], *stride(counted[s][1], seed + k)) for k, s in enumerate(names)], "source string, n long, n_units long, a long, c long")
    units = placed.join(F.broadcast(steps), "source").withColumn("times", F.col("whole") + (F.col("upto") > 0).cast("long")).where("times > 0")
    units = units.withColumn("repeat_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    place = F.pmod(F.col("a") * ((F.col("repeat_no") - 1) * F.col("n") + F.col("rank")) + F.col("c"), F.col("n_units"))
    ends = (F.col("repeat_no") > F.col("whole")) & (F.col("upto") < F.col("size"))
    units = units.select("source", "block", F.col("repeat_no").cast("int").alias("repeat_no"), F.when(ends, F.col("upto")).alias("upto"), place.alias("place"))
    n_shards = max(1, math.ceil(sizes["quota"].sum() / shard_tokens))
    units = units.join(deal(spark, names, np.array([counted[s][1] for s in names], dtype=np.int64), n_shards, seed), ["source", "place"]).drop("place")

    full = blocked.join(units.where("upto is null").drop("upto"), ["source", "block"])
    # the part of the cut blocks that is drawn: one window over one block of each source
    before = ahead("n_tokens", Window.partitionBy("source", "block").orderBy("h", "doc_id"))
    part = blocked.join(F.broadcast(units.where("upto is not null")), ["source", "block"]).withColumn("before", before).where("before < upto")
    drawn = full.unionByName(part.drop("upto", "before")).select("source", "doc_id", "repeat_no", "n_tokens", F.col("shard").cast("int").alias("shard"))
    shuffle = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "repeat_no"), "doc_id", "repeat_no")
    drawn = drawn.withColumn("position", F.row_number().over(shuffle))

    target = spark.createDataFrame(sizes[["source", "target_share", "max_repeats", "n_docs", "size", "quota"]].astype({"n_docs": "int64", "size": "int64", "quota": "int64"}),
                                   "source string, target_share double, max_repeats int, n_docs long, available_tokens long, quota_tokens long")
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"))
    report = target.join(got, "source", "left").na.fill(0, ["drawn_tokens"])
    everything = F.sum("drawn_tokens").over(Window.partitionBy())
    report = report.withColumn("actual_share", F.when(everything > 0, F.col("drawn_tokens") / everything).otherwise(0.0))
    report = report.withColumn("repeats", F.when(F.col("available_tokens") > 0, F.col("drawn_tokens") / F.col("available_tokens")).otherwise(0.0))
    return drawn, report
