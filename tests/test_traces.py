"""The binary form, the builder, the data source, summaries, comparisons, streams."""

import collections
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spanforge import reports
from spanforge.operators import callgraph
from spanforge.operators import packets as P
from spanforge.sources import schema as S
from spanforge.sources import trace as TR
from spanforge.sources import wire
from spanforge.sources.builder import TraceBuilder
from spanforge.sources.names import name_map
from spanforge.streaming import state

ROUTINES = {0x4200: "boot", 0x4310: "scan_keys", 0x4480: "draw_row", 0x4A00: None}


def program(encoding="interned"):
    """A seeded program with nested calls and port writes: its trace, and its tree of calls as a test counts them, {name: [count, arguments, children]}."""
    r, b, tree, now = random.Random(17), TraceBuilder("Arcade", encoding), {}, [100]
    calls_, ports = b.add_thread("Functions"), b.add_thread("Ports")

    def tick():
        now[0] += r.randrange(1, 9)
        return now[0]

    def call(addr, depth, siblings, caller):
        fast, why = r.random() < 0.5, r.choice(["key: held", "timer"])
        b.begin_slice(calls_, f"sub@0x{addr:X}", tick()).add_annotations({"caller": caller, "fast": fast, "depth": depth, "ticks": now[0], "why": why})
        shown = f"Functions::{ROUTINES[addr]}@0x{addr:06X}" if ROUTINES[addr] else f"Functions::sub@0x{addr:X}"
        node = siblings.setdefault(shown, [0, collections.Counter(), {}])
        node[0] += 1
        node[1][f"0x{caller:X}", fast, why] += 1
        for _ in range(r.randrange(3) if depth < 4 else 0):
            call(r.choice(list(ROUTINES)), depth + 1, node[2], addr)
        writes = r.random() < 0.4
        if writes:
            b.begin_slice(ports, "OUT", tick())
            tree.setdefault("Ports::OUT", [0, collections.Counter(), {}])[0] += 1
        b.end_slice(calls_, tick())
        if writes:
            b.end_slice(ports, now[0])

    for addr in (0x4200, 0x4310, 0x4310, 0x4480, 0x4310, 0x4A00):
        call(addr, 1, tree, 0)
    return b, tree


def outline(tree, pad="  "):
    lines = []
    for name, (count, args, children) in sorted(tree.items(), key=lambda x: (-x[1][0], x[0])):
        lines += [f"{pad}'{name}':", f"{pad}  count: {count}"]
        if args:
            lines.append(f"{pad}  args:")
            for (caller, fast, why), n in sorted(args.items(), key=lambda x: (-x[1], x[0][0], str(x[0][1]), x[0][2])):
                lines += [f"{pad}    - count: {n}", f"{pad}      caller: {caller}", f"{pad}      fast: {str(fast).lower()}", f"{pad}      why: " + (f"'{why}'" if ":" in why else why)]
        if children:
            lines += [f"{pad}  children:", *outline(children, pad + "    ")]
    return lines


def calls(encoding="interned"):
    return program(encoding)[0]


@pytest.mark.parametrize("encoding", ["interned", "inline"])
def test_call_summary(spark, tmp_path, encoding):
    """The report of the whole trace against the counts of the program that wrote it. Slices of one track are no children of another's."""
    names = tmp_path / "names.json"
    known = {(str(a) if a % 3 else hex(a)): n for a, n in ROUTINES.items() if n}
    names.write_text(json.dumps({"names": known | {"nowhere": "x", "12": 5}}))
    b, tree = program(encoding)
    options = {"ignore": ["ticks"], "name_map": name_map(spark, str(names))}
    assert P.call_summary_yaml(b.frame(spark), **options).splitlines() == ["functions:", *outline(tree)]
    del tree["Ports::OUT"]
    assert P.call_summary_yaml(b.frame(spark), include=["Functions"], **options).splitlines() == ["functions:", *outline(tree)]


def test_name_maps(spark, tmp_path):
    for i, (text, want) in enumerate([('{"16": "a", "0x20": "b", "30": null}', {(16, "a"), (32, "b")}), ("[1, 2]", set()), ('{"names": [1]}', set())]):
        (tmp_path / f"{i}.json").write_text(text)
        assert {(r.addr, r.mapped) for r in name_map(spark, str(tmp_path / f"{i}.json")).collect()} == want


def test_last_name_of_an_address(spark):
    e = spark.createDataFrame([("Functions", "f@0x10")], "track_name string, name string")
    for names in ([(16, "old", 0), (16, "new", 3)], [(16, "new", 9), (16, "old", 2)]):
        m = spark.createDataFrame(names, "addr bigint, mapped string, pos int")
        assert callgraph.with_mapped_names(e, m).first().full_name == "Functions::new@0x000010"


def test_builder_packets():
    b = TraceBuilder("Console", "inline")
    video = b.add_thread("Video")
    heap = b.add_counter_track("Heap", "KiB")
    b.begin_slice(video, "blit", 40).add_annotations({"dest_sp": 7, "rows": 8, "scale": 0.25, "clipped": False, "palette": {"ink": "red"}})
    b.end_slice(video, 55)
    b.update_counter(heap, 12, 60)
    b.update_counter(heap, 12.75, 70)
    b.add_flow(video, "vsync", 80, 99, terminating=True)
    p = b.packets
    pid, first_thread = 1234, 1  # fixed values
    assert p[0] == {"track_descriptor": {"uuid": 1, "process": {"pid": pid, "process_name": "Console"}}}
    assert p[1] == {"track_descriptor": {"uuid": 2, "parent_uuid": 1, "thread": {"pid": pid, "tid": first_thread, "thread_name": "Video"}}}
    assert p[2]["track_descriptor"]["name"] == "Heap (KiB)"
    fields = {a["name"]: next((k, v) for k, v in a.items() if k.endswith("value")) for a in p[3]["track_event"]["debug_annotations"]}
    assert fields == {"dest_sp": ("pointer_value", 7), "rows": ("int_value", 8), "scale": ("double_value", 0.25), "clipped": ("bool_value", False), "palette": ("string_value", "{'ink': 'red'}")}
    assert "name" not in p[4]["track_event"] and p[4]["timestamp"] == 55
    assert p[5]["track_event"]["counter_value"] == 12 and p[6]["track_event"]["double_counter_value"] == 12.75
    assert p[7]["track_event"]["terminating_flow_ids"] == [99]
    assert b.get_track_info(99) == {} and [k for k, _ in b.get_all_tracks()] == [1, 2, 3]
    with pytest.raises(ValueError, match="encoding"):
        TraceBuilder("x", "other")


def test_interned_packets():
    """A word is sent once; after a reset it is sent again under a new number."""
    b = TraceBuilder("p")
    t = b.add_thread("t")
    for ts in (5, 6):
        b.begin_slice(t, "poll", ts).add_annotations({"port": "A3", "mask": 255})
    first, second = b.packets[2:]
    assert (first["sequence_flags"], second["sequence_flags"]) == (3, 2)
    assert {k: len(v) for k, v in first["interned_data"].items()} == {"event_names": 1, "debug_annotation_names": 2, "debug_annotation_string_values": 1}
    assert "interned_data" not in second
    b.reset_interning()
    b.begin_slice(t, "poll", 7)
    assert b.packets[-1]["sequence_flags"] == 3 and b.packets[-1]["interned_data"]["event_names"][0]["iid"] == 2


def test_dialects():
    c = TraceBuilder("p", dialect="cpp", pid=77)
    t = c.add_thread("T")
    assert c.packets[1]["track_descriptor"] == {"uuid": 2, "thread": {"pid": 77, "tid": 1001, "thread_name": "T"}, "name": "T"}
    assert c.packets[0]["sequence_flags"] == 1
    c.update_counter(t, 4.0, 1)
    c.update_counter(t, 4.5, 2)
    assert [list(p["track_event"])[-1] for p in c.packets[2:]] == ["counter_value", "double_counter_value"]
    r = TraceBuilder("p", dialect="rust")
    r.end_slice(1, 1999)
    assert r.packets[-1]["timestamp"] == 1000


def frames_trace():
    b = TraceBuilder("p", "inline")
    b.add_frame_timeline_expected_surface_start(1000, cookie=11, token=1, display_frame_token=2, layer_name="l")
    b.add_frame_timeline_actual_surface_start(1100, cookie=12, token=1, display_frame_token=2, present_type=1, on_time_finish=False, jank_type=64, present_delay_millis=0.5, animation_time_millis=2.5, pid=9)
    b.add_frame_timeline_expected_display_start(1200, cookie=21, token=-3)
    b.add_frame_timeline_actual_display_start(1300, cookie=22, token=3, latched_unsignaled_count=4)
    for ts, c in ((1400, 11), (1700, 22)):
        b.end_frame_timeline(ts, c)
    with pytest.raises(TypeError, match="unknown"):
        b.add_frame_timeline_expected_display_start(1, cookie=1, token=1, layer_name="x")
    return b


def nested_trace():
    b = TraceBuilder("p")
    with b.add_instant_event(1, "root", 5).annotation("root") as a:
        a.string("label", "top")
        c = a.nested("child")
        c.string("name", "leaf")
        c.integer("count", -2)
        c.pointer("big", 2**64 - 1)
    b.packets[-1]["track_event"]["debug_annotations"].append({"name": "list", "array_values": [{"int_value": 1}, {"string_value": "é"}, {"double_value": 0.5}]})
    b.packets.append({"previous_packet_dropped": True, "first_packet_on_sequence": True, "interned_data": {"event_names": [{"iid": 1, "name": b"a\xff"}]}})
    return b


@pytest.mark.parametrize("make", [calls, frames_trace, nested_trace])
def test_round_trip(spark, tmp_path, make):
    b = make()
    data = b.serialize()
    assert [wire.decode("TracePacket", data[a:e]) for a, e in TR.packet_spans(data)] == json_like(b.packets)
    df = b.frame(spark)
    assert [S.to_packet(r.asDict(recursive=True)) for r in df.orderBy("packet_idx").collect()] == [{k: v for k, v in p.items()} for p in b.packets]
    assert TR.serialized(df).first().content == data
    b.save(str(tmp_path / "a.trace"))
    TR.register(spark)
    read = spark.read.format("trace").option("rangeBytes", 64).load(str(tmp_path / "a.trace")).drop("trace")
    assert sorted(map(str, read.collect())) == sorted(map(str, df.drop("trace").collect()))
    assert sorted(map(str, TR.read_traces(spark, str(tmp_path)).drop("trace").collect())) == sorted(map(str, df.drop("trace").collect()))
    out = str(tmp_path / "out")
    df.coalesce(1).write.format("trace").mode("overwrite").save(out)
    (name,) = [f for f in os.listdir(out) if f.endswith(".trace")]
    with open(f"{out}/{name}", "rb") as f:
        assert f.read() == data


def json_like(packets):
    """Packets as they come back: floats of four bytes, names as bytes."""
    return [wire.decode("TracePacket", wire.encode("TracePacket", p)) for p in packets]


def test_nested_annotations(spark):
    df = nested_trace().frame(spark)
    a = {r.k: r.json for r in P.nested_json(P.annotations(df)).collect()}
    assert json.loads(a["root"])["label"] == "top" and json.loads(a["root"])["child"] == {"name": "leaf", "count": -2, "big": 2**64 - 1}
    assert a["list"] == '[1,"é",0.5]'


def test_cut_off_input():
    data = calls().serialize()
    spans = list(TR.packet_spans(data[:-3]))
    assert spans[-1][1] == len(data) - 3
    for bad in (b"\x0a\x50", b"\x0b"):
        with pytest.raises(ValueError, match="cut off|wire type"):
            wire.decode("TracePacket", bad)
    assert wire.read_varint(b"\x80\x80", 0) == (0, 2)


def executions(change=None, cut=0, value="0x0102"):
    b = TraceBuilder("p", dialect="cpp")
    ex = b.add_thread("Execution")
    inner, outer = b.add_thread("Memory_Internal"), b.add_thread("Memory_External")
    for i in range(10 - cut):
        b.add_instant_event(ex, f"Exec@0x{i:04X}", 10 * i).add_annotations({"pc": i, "opcode": "NOP" if i != change else "ADD"})
    b.add_instant_event(inner, "w", 5).add_annotations({"offset": "0x10", "value": value, "size": "2", "pc": "0x1"})
    b.add_instant_event(outer, "w", 6).add_annotations({"address": "0x20", "value": "0x7"})
    return b


def test_comparison(spark, tmp_path):
    paths = {}
    for name, kw in (("a", {}), ("b", {"change": 7}), ("c", {"cut": 2}), ("d", {"value": "0x0103"})):
        paths[name] = str(tmp_path / f"{name}.trace")
        executions(**kw).save(paths[name])
    assert reports.comparison(spark, paths["a"], paths["a"])[0]
    same, lines = reports.comparison(spark, paths["a"], paths["b"])
    assert not same and any("event #7: Annotation mismatch" in x for x in lines) and "  -opcode=NOP" in lines and "  +opcode=ADD" in lines
    assert any("event #8: Trace 2 ended" in x for x in reports.comparison(spark, paths["a"], paths["c"])[1])
    same, lines = reports.comparison(spark, paths["a"], paths["d"])
    assert not same and any("Memory_Internal value mismatch at offset 0x10: '0x02' vs '0x03'" in x for x in lines)
    assert reports.comparison(spark, paths["a"], paths["d"], skip_memory=True)[0]
    calls().save(str(tmp_path / "e.trace"))
    with pytest.raises(ValueError, match="execution"):
        reports.comparison(spark, str(tmp_path / "e.trace"), paths["a"])


def test_wide_pointers(spark):
    """Pointers of 2^63 and more differ in the comparison's text and in the summary's values."""
    frames = []
    for v in (2**63, 2**64 - 1):
        b = TraceBuilder("p")
        b.add_instant_event(b.add_thread("t"), "e", 1).add_annotations({"top_sp": v})
        frames.append(b.frame(spark))
    assert [P.compared_entries(f).first().entries[0].v for f in frames] == ["0x8000000000000000", "0xFFFFFFFFFFFFFFFF"]
    assert [P.payload_entries(f).first().v for f in frames] == ['"0x8000000000000000"', '"0xFFFFFFFFFFFFFFFF"']


def test_command_line(spark, tmp_path, capsys):
    t = str(tmp_path / "x.trace")
    calls().save(t)
    assert reports.main(["summary", t, "--track", "Functions", "--ignore-key", "ticks"]) == 0
    with open(str(tmp_path / "x.functions.yaml")) as f:
        assert f.read().startswith("functions:\n  'Functions::sub@0x4310':\n    count: 3\n")
    assert reports.main(["parse", t, "--dump-strings", "--find-pattern", "sub", "--extract-numbers", "sub", "--analyze-proto", "--hexdump", "0"]) == 0
    assert reports.main(["pcs", t]) == 0
    assert reports.main(["compare", t, str(tmp_path / "none")]) == 1
    assert reports.main(["compare", t, t]) == 2
    assert "No program counters" in capsys.readouterr().out


def drain(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    from test_operators import events, fold

    rows = [(i, int(t[1:]), 10 * i, k, n) for i, t, _, k, n in events(9)]
    src = str(tmp_path / "src")
    for part in (rows[:150], rows[150:]):  # two files, two micro-batches
        spark.createDataFrame(part, "packet_idx bigint, track bigint, ts bigint, type int, name string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = drain(spark, state.slices_stream(stream), tmp_path, "ended")
    _, begins = fold([(i, f"t{t}", ts, k, n) for i, t, ts, k, n in rows])
    assert len({r.begin_idx for r in got}) == len(got)
    assert {r.begin_idx: (r.end_idx, r.path) for r in got} == {k: (v[0], "/".join(v[2])) for k, v in begins.items() if v[0] is not None}
    timed = stream.withColumn("at", F.timestamp_micros(F.col("ts") * 60_000_000))
    counted = drain(spark, state.counts_stream(timed), tmp_path, "counted")
    assert 0 < sum(r.n for r in counted) <= len(rows)


def test_resolving_stream(spark, tmp_path):
    df = calls().frame(spark)
    entry = "array<struct<table:string,iid:bigint,value:string>>"
    s = P.sequences(df).select("packet_idx", "dropped", "cleared", "needs")
    e = P.dictionary(df).groupBy("packet_idx").agg(F.collect_list(F.struct("table", "iid", "value")).cast(entry).alias("entries"))
    look = df.where("event is not null").select("packet_idx", F.array(F.struct(F.lit("event_names").alias("table"), F.col("event.name_iid").alias("iid"), F.col("event.name").alias("inline"))).alias("lookups"))
    src = str(tmp_path / "p")
    s.join(e, "packet_idx", "left").join(look, "packet_idx", "left").withColumn("seq", F.lit(1).cast("bigint")).coalesce(1).write.parquet(src)
    got = drain(spark, state.resolved_stream(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)), tmp_path, "names")
    want = {r.packet_idx: r.name for r in P.events(df).collect()}
    assert {r.packet_idx: r.text for r in got} == want
