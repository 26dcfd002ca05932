"""Shards by a weighted hash tree: shares, confined movement, slots, odd rows."""

import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basewright.llm import hash_tree as H
from basewright.llm import queries as q

TREE = q.SHARD_TREE


def shards(spark, n, tree, *columns):
    rows = spark.range(n).withColumn("text", F.lit("x"))
    return {r["id"]: tuple(r[c] for c in columns) for r in H.placed(rows, tree, "id").collect()}


def test_the_tree_has_its_levels():
    assert [(s.shard, s.rack, s.region) for s in TREE] == [(i, i // 4, i // 8) for i in range(24)]
    assert H.grown(TREE)[-1] == H.Shard(24, 6, 3, 1.0)
    for bad in ([], [*TREE, TREE[0]], [replace(TREE[0], weight=0.0)], [replace(TREE[0], weight=float("nan"))], [*TREE, H.Shard(24, 0, 1)]):
        with pytest.raises(ValueError):
            H.checked_tree(bad)


def test_shares_follow_the_weights(spark):
    tree = [H.Shard(0, 0, 0, 1.0), H.Shard(1, 0, 0, 3.0), H.Shard(2, 1, 0, 2.0), H.Shard(3, 2, 1, 6.0)]
    counts = Counter(s for (s,) in shards(spark, 24_000, tree, "shard").values())
    for leaf in tree:
        assert abs(counts[leaf.shard] - 2000 * leaf.weight) < 5 * (2000 * leaf.weight) ** 0.5


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before, after = shards(spark, 20_000, TREE, "shard"), shards(spark, 20_000, H.grown(TREE), "shard")
    moved = {i for i in before if before[i] != after[i]}
    assert {after[i] for i in moved} == {(24,)} and 600 < len(moved) < 1000
    more = shards(spark, 20_000, H.grown(H.grown(TREE)), "shard")
    assert {more[i] for i in after if more[i] != after[i]} == {(25,)}


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    """A heavier shard in rack 1 of region 0: nothing moves between or inside other subtrees."""
    heavier = [replace(s, weight=5.0) if s.shard == 5 else s for s in TREE]
    before = shards(spark, 20_000, TREE, "region", "rack", "shard")
    after = shards(spark, 20_000, heavier, "region", "rack", "shard")
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved
    for (region, rack, _), (to_region, to_rack, to_shard) in moved:
        assert to_region == 0  # only into the region that became heavier
        if region == 0:
            assert to_rack == 1  # inside it only into the heavier rack
            if rack == 1:
                assert to_shard == 5  # inside that only into the heavier shard


def slots_are_gapless(rows):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in by_shard.values())


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_slots_follow_the_ids_at_any_number_of_partitions(spark, conf, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    rows = spark.range(3000).select((F.col("id") * 7 % 3001).alias("doc_id"), F.lit("t").alias("text"))
    got = H.sharded(rows, TREE, H.grown(TREE)).collect()
    assert len(got) == 3000 and slots_are_gapless(got)
    by_shard = defaultdict(list)
    for r in sorted(got, key=lambda r: r["slot"]):
        by_shard[r["shard"]].append(r["id"])
    assert all(ids == sorted(ids) for ids in by_shard.values())


def test_rows_without_an_id_are_split_over_tasks(spark, conf):
    """A third of all rows share one id: one shard, but several ranges."""
    conf("spark.sql.shuffle.partitions", "12")
    rows = spark.range(0, 9000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    placed = H.placed(rows, TREE)
    got = H.with_slots(placed, ["id", "size", "text_crc32"])
    assert slots_are_gapless(got.collect())
    [shard] = {r["shard"] for r in got.where("id IS NULL").collect()}
    ranges = placed.withColumn("_s", F.monotonically_increasing_id()).repartitionByRange(12, "shard", "id", "_s")
    at_most = max(r["count"] for r in ranges.where("shard = %d" % shard).groupBy(F.spark_partition_id()).count().collect())
    assert at_most < 3000 / 2


ODD = [(None, None, 1), (None, "", 2), (3, "é\U0001f600\x00", 3), (3, "é\U0001f600\x00", 3), (-5, "x" * 2_000_000, 4), (2**62 + 5, " ", 5)]


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(ODD, "doc_id long, text string, slot long").withColumn("shard", F.lit("s")).withColumn("_row", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = q.op11_hash_tree_shards(spark, str(tmp_path)).collect()
    assert slots_are_gapless(got)
    whole = lambda t: (t or "").encode()
    wanted = Counter((i, len(whole(t)) + 8, zlib.crc32(whole(t))) for i, t, _ in ODD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == wanted
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1 and len({r["shard"] for r in got if r["doc_id"] == 3}) == 1


def test_no_python_and_no_text_in_a_shuffle(spark):
    placed = H.placed(spark.range(5).withColumn("text", F.lit("x")), TREE, "id")
    assert placed.columns == ["id", "size", "text_crc32", "region", "rack", "shard"]
    plan = H.with_slots(placed, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert q.op11_hash_tree_shards(spark, str(tmp_path)).count() == 0
