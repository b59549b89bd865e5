from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from emberlog.model import Bound, Corrupt, Entry, InvalidRecord, after_prefix, prefix_bounds
from emberlog.plans.levels import Levels
from emberlog.plans.pruning import SegmentInfo, chosen
from emberlog.sources.files import Config, header, parsed_header, rewrite_atomic, segment_id
from emberlog.sources.wal import Wal, entry_of, line_of


def info(name: str, lo: bytes, hi: bytes, seqnos=(0, 9), size: int = 10) -> SegmentInfo:
    return SegmentInfo(name, f"/nowhere/{name}", 1, 1, lo, hi, *seqnos, 0, size, size)


@pytest.mark.parametrize("size, fits", [(0, False), (1, True), (65535, True), (65536, False)])
def test_key_limits(size, fits):
    if fits:
        assert Entry(b"k" * size, b"", 0).size == size
    else:
        with pytest.raises(InvalidRecord):
            Entry(b"k" * size, b"", 0)


def test_records():
    assert Entry("k", "", 3).value == b"" and not Entry("k", "", 3).is_tombstone
    assert Entry.tombstone("k", 3).size == 1 and Entry("k", None, 1, 7).is_tombstone
    for bad in (dict(value=None, seqno=0), dict(value="v", seqno=-1), dict(value="v", seqno=2**63)):
        with pytest.raises(InvalidRecord):
            Entry("k", **bad)


@given(st.binary(max_size=4), st.binary(max_size=6))
def test_prefix_is_a_range(prefix, key):
    low, high = prefix_bounds(prefix)
    inside = (low.key is None or key >= low.key) and (high.key is None or key < high.key)
    assert inside == key.startswith(prefix)


def test_prefix_without_end():
    assert after_prefix(b"\xff\xff") is None and after_prefix(b"") is None and after_prefix(b"a\xff") == b"b"


def test_pruning():
    segments = [info("1", b"c", b"k"), info("2", b"l", b"z", (5, 9))]
    names = lambda lo, hi, s=None: [x.segment_id for x in chosen(segments, lo, hi, s)]
    inc, exc, no = Bound.included, Bound.excluded, Bound.unbounded()
    assert names(inc("a"), inc("b")) == [] and names(inc("d"), inc("k")) == ["1"] and names(inc("f"), inc("x")) == ["1", "2"]
    assert names(no, no) == ["1", "2"] and names(exc("k"), no) == ["2"] and names(no, exc("c")) == [] and names(no, inc("c")) == ["1"]
    assert names(no, no, 5) == ["1"] and names(no, no, 6) == ["1", "2"]
    assert segments[0].holds(b"c") and not segments[0].holds(b"l")


def test_levels(tmp_path):
    own = Levels.create(3, f"{tmp_path}/levels.json")
    for k, s in enumerate([info("a", b"c", b"k", (0, 1)), info("b", b"l", b"z", (2, 7)), info("c", b"a", b"b", (3, 4))]):
        own.add(s, [0, 0, 99][k])
    assert own.levels == [["b", "a"], [], ["c"]] and len(own) == 3 and own.depth == 3 and own.first_level_count == 2 and own.size == 30
    assert own.overlapping(0, "d", "k") == ["a"] and own.overlapping(0, "a", "b") == [] and sorted(own.overlapping(0, "f", "x")) == ["a", "b"]
    own.hide(["c"])
    assert own.is_compacting and own.busy_levels == {2} and own.resolved()[2] == [] and len(own.all_segments()) == 3 and "c" not in own.visible_segments()
    own.show(["c"])
    own.persist()
    again = Levels.recover(own.path, dict(own.segments))
    assert again.levels == own.levels
    with pytest.raises(Corrupt):
        Levels.recover(own.path, {"a": own.segments["a"]})
    own.remove("a")
    assert own.levels[0] == ["b"] and not own.is_empty


def test_files(tmp_path):
    path = tmp_path / "x"
    path.write_text("asdasdasdasdasd")
    rewrite_atomic(str(path), b"newcontent")
    assert path.read_bytes() == b"newcontent" and len(list(tmp_path.iterdir())) == 1
    assert parsed_header(header()) == 0
    for bad in (b"", b"LSM", b"XXX\0\0", b"LSM\0\1"):
        with pytest.raises(Corrupt):
            parsed_header(bad)
    Config("p", 2048, 3, 4).save(str(path))
    assert Config.load(str(path)) == Config("p", 2048, 3, 4)
    for bad in (dict(level_count=0), dict(level_ratio=1), dict(block_size=512)):
        with pytest.raises(ValueError):
            Config("p", **bad)


def test_ids_sort_as_made():
    for _ in range(10):
        ids = [segment_id() for _ in range(1000)]
        assert ids == sorted(set(ids))


@given(st.binary(min_size=1, max_size=8), st.none() | st.binary(max_size=8), st.integers(0, 2**63 - 1))
def test_log_line_round_trip(key, value, seqno):
    entry = Entry.tombstone(key, seqno) if value is None else Entry(key, value, seqno)
    assert entry_of(line_of(entry)) == entry


@pytest.mark.parametrize("bad, kept", [(b'{"k": "torn\n', 2), (b"\n", 2), (b'{"k": "", "v": "x", "s": 1, "t": 0}\n', 2), (b"\xff\xfe\n", 2)])
def test_wal_cut(tmp_path, bad, kept):
    path = tmp_path / "wal"
    good = [(line_of(Entry(f"k{i}", "v", i)) + "\n").encode() for i in range(4)]
    path.write_bytes(good[0] + good[1] + bad + good[2])
    wal = Wal(str(path))
    assert [e.seqno for e in wal.recovered] == [0, 1] and len(wal.recovered) == kept
    wal.append([Entry("k9", "v", 9)])
    wal.sync()
    assert [e.seqno for e in Wal.replay(str(path))[0]] == [0, 1, 9]
    wal.truncate()
    assert path.read_bytes() == b""
    wal.close()
    path.write_bytes(good[0] + good[1][:-1])  # a line that was being written
    assert [e.seqno for e in Wal(str(path)).recovered] == [0]
