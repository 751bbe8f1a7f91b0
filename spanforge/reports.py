"""Reports on traces, and the command line: summary, compare, parse, pcs."""

from __future__ import annotations

import argparse
import difflib
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import compare, hotspots, memory, packets, rawbytes, tracks
from .sources.names import name_map
from .sources.trace import read_traces

MEMORY = (("Memory_Internal", "offset", 5), ("Memory_External", "addr", 6))


def described(p: DataFrame) -> DataFrame:
    """Descriptors by their own name only, as the comparison looks tracks up."""
    return packets.descriptors(p).select("track", "packet_idx", F.col("own_name").alias("name"))


def execution(p: DataFrame) -> DataFrame:
    """pos, name, text, a of the execution's events; ValueError if there is no such track."""
    track = tracks.execution_track(packets.events(p), described(p))
    if track.isEmpty():
        raise ValueError("no execution track in the trace")
    return compare.numbered(packets.instants(p, track, "Exec@"), "ts", "packet_idx").select("pos", "name", "text", "a")


def memory_writes(p: DataFrame, name: str, key: str, fallback: int) -> DataFrame:
    """pos, addr, value, pc of a memory track's writes as single bytes."""
    track = tracks.memory_track(packets.events(p), described(p), name, fallback)
    w = packets.instants(p, track).select("ts", "packet_idx", *[F.col("a")[c].alias(c) for c in ("offset", "address", "addr", "value", "pc", "size")])
    b = memory.single_bytes(w)
    addr = F.when(F.col("key") == key, F.col("addr_text"))
    return compare.numbered(b, "ts", "packet_idx", "byte_no").select("pos", addr.alias("addr"), F.col("value_text").alias("value"), "pc")


def comparison(spark: SparkSession, path1: str, path2: str, *, skip_memory: bool = False) -> tuple[bool, list[str]]:
    """Whether the traces agree, and the report's lines."""
    p1, p2 = read_traces(spark, path1), read_traces(spark, path2)
    pairs = compare.paired(execution(p1), execution(p2))
    total = compare.equal(pairs, compare.execution_error()).first()
    lines, same = [f"Execution events: {total.n1} and {total.n2}"], total.same
    if not same:
        d = compare.first_difference(pairs, compare.execution_error()).first()
        lines.append(f"First difference at event #{d.pos}: {d.error}")
        for r in compare.context(pairs, compare.execution_error()).orderBy("pos").collect():
            get = lambda side, k: (side.a or {}).get(k, "N/A") if side else "N/A"
            lines.append(f"  {'->' if r.pos == d.pos else '  '} #{r.pos}: PC={get(r.a, 'pc')} opcode={get(r.a, 'opcode')} | PC={get(r.b, 'pc')} opcode={get(r.b, 'opcode')}")
        if d.a and d.b and d.error == "Annotation mismatch":
            lines += ["  " + x for x in difflib.unified_diff(d.a.text.split("; "), d.b.text.split("; "), "Trace 1", "Trace 2", lineterm="")]
    for name, key, fallback in () if skip_memory else MEMORY:
        pairs = compare.paired(memory_writes(p1, name, key, fallback), memory_writes(p2, name, key, fallback))
        error = compare.memory_error(name, key)
        total = compare.equal(pairs, error).first()
        lines.append(f"{name} writes: {total.n1} and {total.n2}")
        if not total.same:
            same = False
            d = compare.first_difference(pairs, error).first()
            lines.append(f"First difference at write #{d.pos}: {d.error}")
    lines.append("Traces match" if same else "Traces differ")
    return same, lines


def hot_spots(spark: SparkSession, path: str, top: int = 20) -> list[str]:
    files = spark.read.format("binaryFile").load(path).select("content")
    regions = hotspots.by_region(hotspots.histogram(hotspots.counters_in(files)))
    total = hotspots.totals(regions).first()
    if not total.total:
        return ["No program counters found"]
    lines = [f"Total PC values: {total.total:,}", f"Unique addresses: {total.unique:,}"]
    for r in hotspots.hottest(regions, top).orderBy("rank").collect():
        lines.append(f"0x{r.addr:08x} {r['count']:12,} {r.percent:9.1f}% {r.cumulative:9.1f}%")
    return lines


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="spanforge")
    sub = ap.add_subparsers(dest="command", required=True)
    s = sub.add_parser("summary", help="calls by path, as YAML")
    s.add_argument("trace")
    s.add_argument("--out")
    s.add_argument("--track", action="append", required=True)
    s.add_argument("--exclude-track", action="append", default=[])
    s.add_argument("--ignore-key", action="append", default=[])
    s.add_argument("--int-format", choices=("hex", "dec"), default="hex")
    s.add_argument("--name-map")
    s.add_argument("--name-format", choices=("name@addr", "name"), default="name@addr")
    c = sub.add_parser("compare", help="two traces, event by event")
    c.add_argument("trace1")
    c.add_argument("trace2")
    c.add_argument("--verbose", "-v", action="store_true")
    c.add_argument("--skip-memory", action="store_true")
    r = sub.add_parser("parse", help="raw bytes")
    r.add_argument("trace")
    r.add_argument("--dump-strings", action="store_true")
    r.add_argument("--find-pattern")
    r.add_argument("--extract-numbers")
    r.add_argument("--num-bytes", type=int, default=2)
    r.add_argument("--analyze-proto", action="store_true")
    r.add_argument("--hexdump", type=lambda x: int(x, 0))
    h = sub.add_parser("pcs", help="program-counter hot spots")
    h.add_argument("trace")
    h.add_argument("--top", type=int, default=20)
    h.add_argument("--output")
    a = ap.parse_args(argv)
    missing = [p for p in (getattr(a, n, None) for n in ("trace", "trace1", "trace2")) if p and "://" not in p and not os.path.exists(p)]
    if missing:
        print(f"no such trace: {missing[0]}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("spanforge").getOrCreate()
    if a.command == "summary":
        names = name_map(spark, a.name_map) if a.name_map else None
        text = packets.call_summary_yaml(read_traces(spark, a.trace), include=a.track, exclude=a.exclude_track, ignore=a.ignore_key, name_map=names, name_format=a.name_format, int_format=a.int_format)
        with open(a.out or f"{os.path.splitext(a.trace)[0]}.functions.yaml", "w") as f:
            f.write(text)
        return 0
    if a.command == "compare":
        try:
            same, lines = comparison(spark, a.trace1, a.trace2, skip_memory=a.skip_memory)
        except Exception as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
        print("\n".join(lines))
        return 0 if same else 1
    if a.command == "pcs":
        lines = hot_spots(spark, a.trace, a.top)
        print("\n".join(lines))
        if lines[0].startswith("Total"):
            with open(a.output or f"{os.path.splitext(a.trace)[0]}.analysis.txt", "w") as f:
                f.write("\n".join([f"Trace file: {a.trace}", *hot_spots(spark, a.trace, 100)]) + "\n")
        return 0
    files = spark.read.format("binaryFile").load(a.trace).select("content")
    show = lambda df: [print(*x, sep="\t") for x in df.collect()]
    if a.dump_strings:
        show(rawbytes.strings(files).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("nr").alias("at")).orderBy(F.desc("n"), "at").limit(50).select("n", "value"))
    if a.find_pattern:
        show(rawbytes.occurrences(files, a.find_pattern.encode()).orderBy("position").limit(10))
    if a.extract_numbers:
        n = rawbytes.numbers(files, a.extract_numbers.encode(), a.num_bytes)
        show(n.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("at")).orderBy(F.desc("n"), "at").limit(20).select(V.hex_upper(F.col("number").cast("bigint")), "n"))
    if a.analyze_proto:
        f = rawbytes.fields(files)
        show(f.groupBy("field").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "field").limit(10))
        show(f.groupBy("wire").agg(F.sum("n").alias("n")).orderBy("wire"))
    if a.hexdump is not None:
        show(rawbytes.hexdump(files, offset=a.hexdump).orderBy("line").select("text"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
