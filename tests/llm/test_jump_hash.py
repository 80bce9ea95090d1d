import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenewright.llm import jump_hash


def plain(key: int, shards: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_loop(spark):
    draw = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [draw.randrange(-(2**63), 2**63) for _ in range(500)] + list(range(500))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 16, 17, 48, 49, 1000):
        got = [r[0] for r in df.select(jump_hash.jump_hash(F.col("k"), shards)).collect()]
        assert got == [plain(k, shards) for k in keys]


def test_growth_moves_rows_into_the_new_shard_only(spark):
    df = spark.range(3000).select(
        jump_hash.jump_hash(F.col("id"), 16).alias("a"), jump_hash.jump_hash(F.col("id"), 17).alias("b")
    )
    rows = df.collect()
    assert all(r.a == r.b or r.b == 16 for r in rows)
    assert 0.03 < sum(r.a != r.b for r in rows) / len(rows) < 0.09


def test_slots_have_no_gaps_with_nulls_ties_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("_n", T.StringType())])
    df = spark.createDataFrame([(None, "x", None), (None, None, "y"), (7, None, None), (7, None, None)] + [(i, "s", None) for i in range(200)], schema)
    rows = jump_hash.shard(df, "doc_id", 4).collect()
    assert len(rows) == 204
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert jump_hash.shard(df.limit(0), "doc_id", 4).count() == 0
    words = spark.createDataFrame([("a",), (None,)], "w string")
    assert jump_hash.shard(words, "w", 3).count() == 2
