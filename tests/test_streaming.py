import numpy as np

from tessera.operators.pixels import reduce_level
from tessera.streaming.pyramid import accumulate, members


def test_members_at_the_edge():
    assert [members(x, y, 3, 5) for x, y in ((0, 0), (1, 0), (0, 2), (1, 2))] == [4, 2, 2, 1]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    tiles = [(x, y, bytearray(rng.integers(0, 256, 64).astype(np.uint8).tobytes())) for x in range(3) for y in range(5)]
    rng.shuffle(tiles)
    schema = "tile_x long, tile_y long, data binary"
    for n in range(0, len(tiles), 4):  # the files arrive one after the other
        spark.createDataFrame(tiles[n : n + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = accumulate(stream, 8, 3, 5).writeStream.format("memory").queryName("blocks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    query.stop()
    got = {(r.tile_x, r.tile_y): bytes(r.data) for r in spark.sql("select * from blocks").collect()}
    expected = {(r.tile_x, r.tile_y): bytes(r.data) for r in reduce_level(spark.createDataFrame(tiles, schema), 8).collect()}
    assert got == expected and len(got) == 6


def test_blocks_of_a_level_with_gaps(spark, tmp_path):
    """str01: a block goes out when the tiles that exist have come, wherever others are missing."""
    from tessera.streaming.pyramid import with_members

    tiles = [(x, y, bytearray([9 * x + y]) * 64) for x, y in ((0, 0), (1, 0), (2, 0), (3, 0), (0, 1), (1, 1), (5, 4))]
    with_members(spark.createDataFrame(tiles, "tile_x long, tile_y long, data binary")).write.parquet(str(tmp_path / "in"))
    schema = "tile_x long, tile_y long, data binary, members int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = accumulate(stream, 8, 6, 5).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    query.stop()
    got = {(r.tile_x, r.tile_y): sum(r.data) for r in spark.sql("select * from gaps").collect()}
    assert got == {(0, 0): 16 * (0 + 9 + 1 + 10), (1, 0): 16 * (18 + 27), (2, 2): 16 * 49}
