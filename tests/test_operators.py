"""Window formulas against small sequential models, and scalar rules."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import values as V
from spanforge.operators import compare, frames, hotspots, interning, memory, rawbytes, slices, tracks


def events(seed, n=400, n_tracks=5):
    r = random.Random(seed)
    return [(i, f"t{r.randrange(n_tracks)}", r.randrange(n) * 10, r.choice([1, 1, 2]), f"f{r.randrange(4)}") for i in range(n)]


def fold(rows):
    """What a stack does: depth and level of each event; end, parent and path of each begin."""
    state, seen, begins = {}, {}, {}
    for i, t, ts, kind, name in sorted(rows, key=lambda x: (x[2], x[1], x[3], x[0])):
        stack = state.setdefault(t, [])
        if kind == 1:
            stack.append(i)
            begins[i] = [None, stack[-2] if len(stack) > 1 else None, [next(x[4] for x in rows if x[0] == j) for j in stack]]
            seen[i] = (len(stack), len(stack), True)
        else:
            level = len(stack)
            if stack:
                begins[stack.pop()][0] = i
            seen[i] = (len(stack), level, level > 0)
    return seen, begins


@pytest.mark.parametrize(("seed", "chunk"), [(1, 100), (2, 1000), (3, 10**9), (4, 10)])
def test_slices(spark, seed, chunk):
    rows = events(seed)
    df = spark.createDataFrame(rows, "packet_idx bigint, track string, ts bigint, type int, name string")
    deep = slices.depths(df, chunk_ns=chunk)
    seen, begins = fold(rows)
    assert {r.packet_idx: (r.depth, r.level, r.effective) for r in deep.collect()} == seen
    b = slices.with_path(slices.with_parent(slices.matched(deep)), F.col("name"))
    assert {r.packet_idx: [r.end_idx, r.parent_idx, r.path] for r in b.collect()} == begins
    folded = slices.folded_path(slices.matched(deep), F.col("name"))
    assert {r.packet_idx: r.path for r in folded.collect()} == {k: v[2] for k, v in begins.items()}


def test_deep_nesting(spark):
    n = 150
    rows = [(i, "t", i, 1, f"f{i}") for i in range(n)] + [(n + i, "t", n + i, 2, "") for i in range(n + 3)]
    df = spark.createDataFrame(rows, "packet_idx bigint, track string, ts bigint, type int, name string")
    b = slices.with_path(slices.matched(slices.depths(df, chunk_ns=7)), F.col("name")).orderBy("packet_idx").collect()
    assert [len(r.path) for r in b] == list(range(1, n + 1))
    assert b[0].end_idx == 2 * n - 1


def test_resolution(spark):
    r = random.Random(5)
    rows, state, want = [], {}, {}
    entries, lookups = [], []
    for i in range(600):
        seq, cleared, dropped, needs = r.randrange(3), r.random() < 0.04, r.random() < 0.04, r.random() < 0.7
        rows.append((seq, i, dropped, cleared, needs))
        valid, names = state.get(seq, (False, {}))
        if dropped or cleared:
            valid, names = cleared, {}
        for pos in range(r.randrange(3)):
            e = (r.randrange(4), f"v{i}.{pos}")
            entries.append((seq, i, pos, "event_names", *e))
            names[e[0]] = e[1]
        state[seq] = (valid, names)
        iid = r.choice([None, 0, 1, 2, 3, 9])
        lookups.append((seq, i, "event_names", iid, "inline" if iid is None else None))
        want[i] = "inline" if iid is None else None if needs and not valid else names.get(iid, f"<missing EventName iid={iid}>")
    p = spark.createDataFrame(rows, "seq bigint, packet_idx bigint, dropped boolean, cleared boolean, needs boolean")
    e = spark.createDataFrame(entries, "seq bigint, packet_idx bigint, pos int, table string, iid bigint, value string")
    q = spark.createDataFrame(lookups, "seq bigint, packet_idx bigint, table string, iid bigint, inline string")
    assert {x.packet_idx: x.text for x in interning.resolved(q, e, p).collect()} == want
    strict = {x.packet_idx: x.text for x in interning.resolved(q, e, p, strict=True).collect()}
    assert all(strict[i] == (("inline" if lookups[i][3] is None else None) if rows[i][0] == 0 else want[i]) for i in range(600))


def test_flags_and_ids(spark):
    p = spark.createDataFrame([(1, i, i in (2, 4)) for i in range(6)], "seq bigint, packet_idx bigint, interns boolean")
    assert [r.sequence_flags for r in interning.flags(p).orderBy("packet_idx").collect()] == [0, 0, 3, 0, 2, 0]
    assert [r.sequence_flags for r in interning.flags(p, clear_on="first_packet").orderBy("packet_idx").collect()] == [1, 0, 2, 0, 2, 0]


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, V.hex_upper(lit(v).cast("bigint"), d)) for v, d in ((-5, 0), (255, 6), (0, 0))] == ["0x-5", "0x0000FF", "0x0"]
    assert [one(spark, V.parse_int(lit(t))) for t in ("0x1F", "12", "-3", "x", "0x", "0xZZ")] == [31, 12, -3, None, None, None]
    assert [one(spark, V.floor_us(lit(v).cast("bigint"))) for v in (-1500, -1, 0, 1999, 2**62)] == [-2, -1, 0, 1, 2**62 // 1000]
    doubles = [0.1, 1.0, 1e16, 123456789.5, 1e-5, 1.5e300, 1e15, 0.0001, -2.5e-7, 100000000.0]
    assert [one(spark, V.double_text(lit(v))) for v in doubles] == [str(v) for v in doubles]
    assert [one(spark, V.stripped_hex(lit(t))) for t in ("0x00ff", "0x0", "abc", "0x0010")] == ["FF", "0", "abc", "10"]
    assert one(spark, V.utf8(F.unhex(lit("41FF42")))) == "A�B"
    assert one(spark, V.time_or_index(lit(0).cast("bigint"), lit(7).cast("bigint"))) == 7
    assert [one(spark, V.yaml_key(lit(t))) for t in ("a:b", "1a", "it's", "", "ok")] == ["'a:b'", "'1a'", "it's", "''", "ok"]
    assert [one(spark, V.yaml_value(lit(t))) for t in ("TRUE", "1a", "x-y")] == ["'TRUE'", "1a", "'x-y'"]
    assert one(spark, V.first_address(lit("f@0x1aF z 0x2"))) == 0x1AF
    with pytest.raises(ValueError, match="dialect"):
        V.is_pointer_name(lit("a"), "java")


def test_raw_bytes(spark):
    data = [b"", b"\x80", b"aaaa\x00Rpc", b"\x00ababab\xffcafe", bytes(range(256)), b"\x38\x34\x12\x3cR\x02pc\x38\x01\x02\x3cR\x02pcR\x02pc", b"\x08\x96\x01\xd8\x05\x02"]
    files = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "id int, content binary")
    got = {}
    for r in rawbytes.strings(files).collect():
        got.setdefault(r.id, {})[r.nr] = r.value
    import re

    assert {k: list(dict(sorted(v.items())).values()) for k, v in got.items()} == {i: s for i, d in enumerate(data) if (s := [x.decode() for x in re.findall(rb"[\x20-\x7e]{4,}", d)])}
    found = sorted((r.id, r.position, bytes.fromhex(r.before), bytes.fromhex(r.after)) for r in rawbytes.occurrences(files, b"ab", around=3).collect())
    assert found == sorted((i, p, d[max(0, p - 3) : p], d[p + 2 : p + 5]) for i, d in enumerate(data) for p in range(len(d)) if d[p : p + 2] == b"ab")
    for size, endian, order in ((2, "<", "little"), (4, ">", "big"), (8, "<", "little"), (3, "<", "little")):
        nums = sorted((r.id, r.position, int(r.number)) for r in rawbytes.numbers(files, b"a", size, endian=endian).collect())
        assert nums == sorted((i, p, int.from_bytes(d[p + 1 : p + 1 + size], order)) for i, d in enumerate(data) for p in range(len(d)) if d[p : p + 1] == b"a" and p + 1 + size <= len(d))
    assert rawbytes.varints(data[6])[1] == [8, 150, 728, 2]
    assert rawbytes.varints(b"\x80")[1] == [0]
    assert {(r.id, r.field, r.wire, r.n) for r in rawbytes.fields(files).collect() if r.id == 6} == {(6, 1, 0, 1), (6, 18, 6, 1), (6, 91, 0, 1)}
    dump = {r.line: r.text for r in rawbytes.hexdump(files.where("id = 4"), offset=16, length=40).collect()}
    assert sorted(dump) == [16, 32, 48]
    assert dump[32] == "00000020  " + " ".join(f"{b:02x}" for b in range(32, 48)) + "   " + "".join(map(chr, range(32, 48)))
    assert sorted(r.pc for r in hotspots.counters_in(files).collect()) == [0x0201, 0x1234]


def test_regions(spark):
    raw = spark.createDataFrame([(p, 1, p) for p in (0, 0x1FFFF, 0x20000, 0x80000, 0x80001)], "pc bigint, count bigint, first_pos bigint")
    assert {r.addr for r in hotspots.by_region(raw).collect()} == {0xE0000, 0xFFFFF, 0x80001}
    same = spark.createDataFrame([(1, 5, 9), (2, 5, 3), (3, 7, 8)], "addr bigint, count bigint, first_pos bigint")
    top = hotspots.hottest(same, 2).orderBy("rank").collect()
    assert [(r.addr, round(r.cumulative, 3)) for r in top] == [(3, 41.176), (2, 70.588)]


def test_memory(spark):
    cols = "packet_idx bigint, offset string, address string, addr string, value string, pc string, size string"
    w = spark.createDataFrame([(1, "0x10", None, None, "0x01020304", "0x1", "4"), (2, None, "20", None, "513", None, "2"), (3, None, None, "0x5", "7", "0x2", None), (4, None, None, None, None, None, "2")], cols)
    got = [(r.packet_idx, r.key, r.addr_text, r.value_text) for r in memory.single_bytes(w).orderBy("packet_idx", "byte_no").collect()]
    assert got[:4] == [(1, "offset", f"0x{0x10 + i:02X}", f"0x{4 - i:02X}") for i in range(4)]
    assert got[4:] == [(2, "addr", "0x000014", "0x01"), (2, "addr", "0x000015", "0x02"), (3, "addr", "0x5", "7"), (4, "addr", "0x000000", "0x00"), (4, "addr", "0x000001", "0x00")]
    values = ["0xFFFFFFFFFFFFFFFF", "0x8000000000000001", "0x0102030405060708090A", "18446744073709551615", "-2", "0xABC"]
    w = spark.createDataFrame([(i, None, "0xFFFFFFFFFFFFFFFE", None, v, None, "10") for i, v in enumerate(values)], cols)
    got = [(r.packet_idx, r.addr_text, r.value_text) for r in memory.single_bytes(w).orderBy("packet_idx", "byte_no").collect()]
    assert got == [(i, f"0x{2**64 - 2 + k:06X}", f"0x{int(v, 0) >> 8 * k & 255:02X}") for i, v in enumerate(values) for k in range(10)]
    for bad in (("0x10", "12x", "2"), ("zz", "1", "2"), ("0x10", "1", "two")):
        with pytest.raises(Exception, match="no number"):
            memory.single_bytes(spark.createDataFrame([(1, None, bad[0], None, bad[1], None, bad[2])], cols)).collect()


def test_missing_names(spark):
    """An event without a name differs from one with a name."""
    side = "struct<name:string,text:string>"
    rows = [((None, "t"), ("x", "t")), ((None, "t"), (None, "t")), (("x", None), ("x", None)), ((None, "t"), None)]
    df = spark.createDataFrame(rows, f"a {side}, b {side}")
    errors = [r.e for r in df.select(compare.execution_error().alias("e")).collect()]
    assert errors == ["Event name mismatch: '' vs 'x'", None, None, "Trace 2 ended but Trace 1 has more events"]
    assert [r.same for r in (compare.equal(df.limit(1), compare.execution_error()).first(), compare.equal(df.where("b is not null and a.name is not null"), compare.execution_error()).first())] == [False, True]


def test_one_hot_track(spark):
    """A track that holds nearly all events of a short trace is cut into chunks by count."""
    r = random.Random(6)
    rows = [(i, "hot" if r.random() < 0.9 else "b", i // 3, r.choice([1, 1, 2, 2, 2]), "n") for i in range(2000)]
    df = spark.createDataFrame(rows, "packet_idx bigint, track string, ts bigint, type int, name string")
    seen, _ = fold(rows)
    assert {x.packet_idx: (x.depth, x.level, x.effective) for x in slices.depths(df, chunk_rows=100).collect()} == seen


@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_numbered(spark, size):
    r = random.Random(size)
    rows = sorted({(r.randrange(100), r.randrange(1000)) for _ in range(500)})
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    got = sorted((x.pos, x.a, x.b) for x in compare.numbered(df, "a", "b", range_rows=size).collect())
    assert got == [(i, *x) for i, x in enumerate(rows)]
    assert compare.numbered(df.limit(0), "a", "b").count() == 0


def test_discovery(spark):
    d = spark.createDataFrame([(0, 1, "Execution"), (7, 2, "x"), (8, 3, "Execution")], "track bigint, packet_idx bigint, name string")
    e = spark.createDataFrame([(7, 10, "Exec@1", 3), (9, 5, "Exec@2", 3), (5, 11, "w", 3)], "track bigint, packet_idx bigint, name string, type int")
    assert tracks.execution_track(e, d).first().track == 8
    assert tracks.execution_track(e, d.where("track <> 8")).first().track == 9
    assert tracks.execution_track(e.where("track = 5"), d.where("track = 7")).isEmpty()
    assert tracks.memory_track(e, d, "Memory_Internal", 5).isEmpty()
    more = d.union(spark.createDataFrame([(5, 4, None)], d.schema))
    assert tracks.memory_track(e, more, "Memory_Internal", 5).first().track == 5


def test_frames_and_flows(spark):
    s = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "cookie bigint, ts bigint")
    e = spark.createDataFrame([(1, 20), (1, 15), (2, 4)], "cookie bigint, ts bigint")
    assert sorted((r.cookie, r.ts, r.end_ts) for r in frames.ended(s, e).collect()) == [(1, 10, 15), (1, 20, 20), (2, 5, None)]
    f = spark.createDataFrame([(1, 10, 0, False), (1, 20, 1, True), (1, 30, 2, False), (2, 1, 3, False)], "flow_id bigint, ts bigint, packet_idx bigint, terminating boolean")
    assert [r.role for r in frames.flow_steps(f).orderBy("packet_idx").collect()] == ["source", "sink", "sink", "source"]
    assert one(spark, frames.jank_labels(F.lit(1 | 64 | 4096))) == ["NONE", "APP_DEADLINE_MISSED", "APP_RESYNCED_JITTER"]
