from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberlog.model import LOG, Bound, Entry
from emberlog.operators import blocks, kernel, reads, statistics, writes
from emberlog.sources.derived import in_segments
from emberlog.sources.wal import import_log, line_of


def log_of(spark, *versions):
    """Versions as (key, seqno, value), value None for a tombstone."""
    return spark.createDataFrame([(Entry.tombstone(k, s) if v is None else Entry(k, v, s)).row() for k, s, v in versions], LOG)


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def value(df):
    got = pairs(df)
    return got[0][1] if got else None


def test_point_reads(spark):
    log = log_of(spark, *[("abc", i, f"{i}") for i in range(5)], ("abc0", 9, "other"))
    assert value(reads.get(log, "abc")) == b"4" and value(reads.get(log, "abc0")) == b"other" and value(reads.get(log, "ab")) is None
    log = log_of(spark, ("abc", 0, "a"), ("abc", 99, "b"), ("abc", 255, "c"))
    assert [value(reads.get(log, "abc", s)) for s in (None, 100, 99, 50, 0)] == [b"c", b"b", b"a", b"a", None]


@pytest.mark.parametrize("rows, at, want", [
    ([("k", 1, "v"), ("k", 2, None)], None, None), ([("k", 1, "v"), ("k", 2, None)], 2, b"v"), ([("k", 1, "v"), ("k", 2, None)], 1, None),
    ([("k", 1, None), ("k", 2, "v")], None, b"v"), ([("k", 1, "")], None, b""), ([("k", 5, "v"), ("k", 5, None)], None, None), ([], None, None),
])
def test_edges(spark, rows, at, want):
    log = log_of(spark, *rows)
    assert value(reads.get(log, "k", at)) == want
    assert pairs(reads.scan(log, at)) == ([] if want is None else [(b"k", want)])
    assert reads.length(log, at).first()["n"] == (want is not None) and reads.is_empty(log, at).first()["empty"] == (want is None)
    assert reads.contains(log, "k", at).first()["found"] == (want is not None)
    assert (reads.first(log, at).count(), reads.last(log, at).count()) == (int(want is not None),) * 2


def test_ranges_and_prefixes(spark):
    keys = ["a", "ab", "abc", "ac", "b"]
    log = log_of(spark, *[(k, i, k) for i, k in enumerate(keys)])
    names = lambda df: [k.decode() for k, _ in pairs(df)]
    assert names(reads.prefix(log, "ab")) == ["ab", "abc"] and names(reads.prefix(log, "")) == keys
    assert names(reads.key_range(log, "ab", "ac")) == ["ab", "abc", "ac"] and names(reads.between(log, Bound.excluded("ab"), Bound.excluded("ac"))) == ["abc"]
    assert names(reads.key_range(log, "b", "a")) == [] and names(reads.scan(log, reverse=True)) == keys[::-1]
    raw = [b"\xfe", b"\xff", b"\xff\x00", b"\xff\xff"]
    log = log_of(spark, *[(k, i, "") for i, k in enumerate(reversed(raw))])
    assert [k for k, _ in pairs(reads.prefix(log, b"\xff"))] == raw[1:]
    order = [b"\x00", b"\x00\x01", b"\x7f", b"\x80"]
    assert [k for k, _ in pairs(reads.scan(log_of(spark, *[(k, 0, "") for k in reversed(order)])))] == order


def test_masked_versions(spark):
    log = log_of(spark, ("a", 5, "r"), ("a", 4, None), ("a", 3, "r"), ("b", 2, None), ("b", 1, "r"), ("c", 9, "r"), ("c", 8, "r"))
    got = [(bytes(r["key"]).decode(), r["seqno"]) for r in kernel.in_order(kernel.masked(log)).collect()]
    assert got == [("a", 5), ("a", 4), ("b", 2), ("c", 9), ("c", 8)]


def test_random_logs(spark):
    """Any split of a log gives a dictionary's answers; so does what a compaction keeps, from its snapshot on."""
    rng = random.Random(5)
    for _ in range(4):
        versions = [(rng.choice("abcdef") * rng.randint(1, 2), s, rng.choice([None, "", "x", "y"])) for s in range(40)]
        parts = [[v for k, v in enumerate(versions) if k % 3 == p] for p in range(3)]
        rng.shuffle(parts)
        log = kernel.merged(*(log_of(spark, *p) for p in parts))
        floor = rng.randint(0, 40)
        kept = kernel.evicted_versions(log, floor, drop_tombstones=True)
        for at in (0, floor, rng.randint(floor, 40), None):
            model = {}
            for k, s, v in versions:
                if at is None or s < at:
                    model[k.encode()] = v
            want = sorted((k, v.encode()) for k, v in model.items() if v is not None)
            assert pairs(reads.scan(log, at)) == want
            assert sorted((bytes(r["key"]), bytes(r["value"])) for r in kernel.without_tombstones(kernel.newest_by_aggregate(kernel.visible(log, at))).collect()) == want
            if at is None or at >= floor:
                assert pairs(reads.scan(kept, at)) == want


def test_filters_reach_the_files(spark, tmp_path):
    log_of(spark, *[(f"k{i}", i, "v") for i in range(50)]).write.parquet(f"{tmp_path}/log")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = reads.prefix(spark.read.parquet(f"{tmp_path}/log"), "k1", 30)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and "LessThan(seqno,30)" in plan
    plan = reads.length(spark.read.parquet(f"{tmp_path}/log"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:binary,seqno:bigint,value_type:tinyint>" in plan


def test_numbers(spark):
    rows = spark.createDataFrame([(o, x) for x, o in enumerate([5, 900, 7, 7, 100000, -3])], "o long, x int")
    got = {(r["o"], r["seqno"]) for r in writes.numbered(rows, "o", 10, width=64).collect()}
    assert got == {(-3, 10), (5, 11), (7, 12), (900, 13), (100000, 14)}


@pytest.mark.parametrize("ranges", [{"width": 64}, {"width": 1}, {"rows": 2}, {"rows": 1}, {}])
def test_numbers_with_nulls(spark, ranges):
    """Whatever the ranges: no row is lost, nulls are numbered last, equal ordinals together or each on its own."""
    rows = spark.createDataFrame([(o, x) for x, o in enumerate([5, None, 900, 7, 7, 1 << 40, -3, None])], "o long, x int")
    together = sorted(((r["x"], r["seqno"]) for r in writes.numbered(rows, "o", 10, **ranges).collect()))
    assert together == [(0, 11), (1, 15), (2, 13), (3, 12), (4, 12), (5, 14), (6, 10), (7, 15)]
    alone = writes.numbered(rows, "o", 10, shared=False, **ranges).orderBy("seqno").collect()
    assert [r["seqno"] for r in alone] == list(range(10, 18)) and [r["o"] for r in alone] == [-3, 5, 7, 7, 900, 1 << 40, None, None]
    nulls = writes.numbered(rows.where("o is null"), "o", 10, **ranges).collect()
    assert [r["seqno"] for r in nulls] == [10, 10] and writes.numbered(rows.where("x < 0"), "o", 10, **ranges).count() == 0


def test_validation(spark):
    rows = spark.createDataFrame([(b"", b"v", 0, 0), (b"k", None, 0, 0), (b"k", None, 0, 1), (b"k" * 65536, b"", 0, 0), (b"k", b"", 0, 0)], LOG)
    assert writes.invalid(rows).count() == 3 and writes.validated(rows.where("key = X'6b' and (value_type = 1 or value is not null)")).count() == 2
    for k in range(2):
        with pytest.raises(Exception, match="key has|no value"):
            writes.validated(rows).where(F.col("value_type") == 0).collect()


def test_blocks(spark):
    log = in_segments(log_of(spark, *[(f"k{i:03d}", i, "v" * (i % 7)) for i in range(60)]), 25)
    rows = [r.asDict() for r in blocks.layout(log, 32).orderBy("segment_id", "key").collect()]
    now, block, filled = None, 0, 0
    for r in rows:
        if r["segment_id"] != now:
            now, block, filled = r["segment_id"], 0, 0
        assert r["block_no"] == block
        filled += len(r["key"]) + len(r["value"])
        if filled >= 32:
            block, filled = block + 1, 0
    sums = {(r["segment_id"], r["block_no"]): r["crc"] for r in blocks.checksums(blocks.layout(log, 32)).collect()}
    for (segment, block), crc in sums.items():
        own = [r for r in rows if (r["segment_id"], r["block_no"]) == (segment, block)]
        raw = len(own).to_bytes(4, "big") + b"".join(
            len(r["key"]).to_bytes(4, "big") + r["key"] + len(r["value"]).to_bytes(4, "big") + r["value"] + r["seqno"].to_bytes(8, "big") + bytes([r["value_type"]]) for r in own
        )
        assert crc == zlib.crc32(raw)
    got = blocks.checksums(blocks.layout(log, 32))
    other = got.withColumn("crc", F.when((F.col("segment_id") == "seg-000001") & (F.col("block_no") == 0), 12345).otherwise(F.col("crc")))
    assert blocks.mismatches(got, got).count() == 0 and blocks.mismatches(got, other).count() == 1


def test_bounds_of_binary_keys(spark):
    rows = blocks.index(blocks.layout(in_segments(log_of(spark, *[(f"k{i // 3:03d}", i, "v" * (i % 7)) for i in range(60)]), 25), 16))
    keys = spark.createDataFrame([(bytes(k),) for k in (b"", b"k", b"k003", b"k003\x00", b"k011", b"k019", b"\xff")], "key binary")
    asked = keys.crossJoin(rows.select("segment_id").distinct())
    for pairs, everywhere in ((blocks.lower_bound, blocks.lower_bound_everywhere), (blocks.upper_bound, blocks.upper_bound_everywhere)):
        got, want = everywhere(rows, keys), pairs(rows, asked)
        assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_statistics(spark):
    log = in_segments(log_of(spark, ("a", 1, "xx"), ("a", 2, None), ("b", 3, "y")), 100)
    r = statistics.segment_metadata(log).first()
    assert (r["item_count"], r["key_count"], r["tombstone_count"], r["uncompressed_size"], r["seqno_min"], r["seqno_max"]) == (3, 2, 1, 6, 1, 3)
    assert statistics.approximate_length(statistics.segment_metadata(log), 4).first()["n"] == 7


def test_import_cuts_at_the_first_bad_line(spark, tmp_path):
    lines = [line_of(Entry(f"k{i}", "v", i)) for i in range(5)]
    (tmp_path / "a").write_text("\n".join([lines[0], lines[1], "torn", lines[2]]) + "\n")
    (tmp_path / "b").write_text(lines[3] + "\n")
    assert sorted(r["seqno"] for r in import_log(spark, f"{tmp_path}/a").collect()) == [0, 1]
    assert sorted(r["seqno"] for r in import_log(spark, str(tmp_path)).collect()) == [0, 1]
    assert sorted(r["seqno"] for r in import_log(spark, f"{tmp_path}/b").collect()) == [3]


def test_long_numbers_keep_their_keys(spark, tmp_path):
    from emberlog.sources.derived import conversations_log, events_log

    spark.createDataFrame([(1, 123456, "x", "a"), (2, 1234567, "x", "b"), (3, 7, "x", "c")], "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 1000, "u"), (1, 10001, "v")], "conv_id long, turn long, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(bytes(r["key"]) for r in events_log(spark, str(tmp_path)).collect()) == [b"user/000007", b"user/123456", b"user/1234567"]
    assert sorted(bytes(r["key"]) for r in conversations_log(spark, str(tmp_path)).collect()) == [b"00000001/1000", b"00000001/10001"]
