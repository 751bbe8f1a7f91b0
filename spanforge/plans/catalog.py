"""Names of the runnable queries: QUERIES[name](spark, sf_dir), and ORACLES[name], the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import callgraph, compare, frames, hotspots, interning, memory, rawbytes, slices, tracks
from . import views
from .views import table

QUERIES: dict = {}
ORACLES: dict = {}

EV = """ev AS (SELECT event_id AS packet_idx, user_id AS track, epoch_us(ts) * 1000 AS ts,
  CASE WHEN event_type IN ('signup', 'view') THEN 1 WHEN event_type IN ('purchase', 'error') THEN 2 ELSE 3 END AS type, event_type AS name, value,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)"""
DEEP = f"""{EV}, r AS (SELECT *, sum(CASE type WHEN 1 THEN 1 ELSE -1 END) OVER w AS s FROM ev WHERE type IN (1, 2) WINDOW w AS (PARTITION BY track ORDER BY ts, type, packet_idx)),
d0 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY track ORDER BY ts, type, packet_idx)) AS depth FROM r),
d AS (SELECT *, CASE type WHEN 1 THEN depth ELSE coalesce(lag(depth) OVER (PARTITION BY track ORDER BY ts, type, packet_idx), 0) END AS level FROM d0)"""
BEGINS = f"""{DEEP}, m AS (SELECT *, lead(ts) OVER w AS end_ts, lead(packet_idx) OVER w AS end_idx FROM d WHERE type = 1 OR level > 0 WINDOW w AS (PARTITION BY track, level ORDER BY ts, type, packet_idx)),
b AS (SELECT * FROM m WHERE type = 1)"""
PATHS = f"""{BEGINS}, up AS (SELECT c.packet_idx, c.track, c.level, c.name, c.ts, c.k, (SELECT max(p.packet_idx) FROM b p WHERE p.track = c.track AND p.level = c.level - 1 AND p.packet_idx < c.packet_idx) AS parent FROM b c),
tree AS (SELECT packet_idx, 'user_' || track || '::' || name AS path, k FROM up WHERE level = 1
  UNION ALL SELECT up.packet_idx, tree.path || '/' || 'user_' || up.track || '::' || up.name, up.k FROM up JOIN tree ON up.parent = tree.packet_idx)"""
ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
EXEC = f"""n AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) - 1 AS pos FROM lineitem),
ab AS (SELECT pos, printf('Exec@0x%06X', l_partkey) AS name, printf('0x%X', l_partkey) AS pc, l_returnflag AS opcode,
  'opcode=' || l_returnflag || '; pc=' || printf('0x%X', l_partkey) || '; qty=' || l_quantity::BIGINT AS ta,
  CASE WHEN l_orderkey <= (SELECT max(l_orderkey) - 5 FROM lineitem) THEN 'opcode=' || l_returnflag || '; pc=' || printf('0x%X', l_partkey) || '; qty=' || (l_quantity::BIGINT + CASE WHEN l_orderkey % 1009 = 17 THEN 1 ELSE 0 END) END AS tb FROM n),
err AS (SELECT *, CASE WHEN tb IS NULL THEN 'Trace 2 ended but Trace 1 has more events' WHEN ta <> tb THEN 'Annotation mismatch' END AS error FROM ab)"""


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# Tracks ---------------------------------------------------------------------------------------------------------------


@query(
    "track_catalog",
    """SELECT c_custkey AS uuid, CASE c_custkey % 4 WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment WHEN 3 THEN 'shop' ELSE 'track_' || c_custkey END AS track_name, c_nationkey::BIGINT AS parent_uuid FROM customer""",
)
def track_catalog(spark: SparkSession, sf: str) -> DataFrame:
    c, m = table(spark, sf, "customer"), F.col("c_custkey") % 4
    name = V.descriptor_name(F.when(m == 1, F.col("c_name")).when(m == 2, ""), F.when(m.isin(1, 2), F.col("c_mktsegment")).otherwise(""), F.when(m > 0, "shop"), F.col("c_custkey"))
    return c.select(F.col("c_custkey").alias("uuid"), name.alias("track_name"), F.col("c_nationkey").cast("bigint").alias("parent_uuid"))


@query(
    "track_name_asof",
    f"""WITH {EV}, ds AS (SELECT track, packet_idx, 'user_' || track || '_v' || k AS name FROM ev WHERE name = 'signup')
SELECT e.packet_idx, coalesce(ds.name, 'track_' || e.track) AS track_name FROM ev e ASOF LEFT JOIN ds ON e.track = ds.track AND e.packet_idx >= ds.packet_idx""",
)
def track_name_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return tracks.named_as_of(e, views.descriptors(e)).select("packet_idx", "track_name")


@query("track_name_last", f"WITH {EV} SELECT track, arg_max('user_' || track || '_v' || k, packet_idx) AS name FROM ev WHERE name = 'signup' GROUP BY track")
def track_name_last(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.last_names(views.descriptors(views.events(spark, sf)))


@query("track_parents", "SELECT n_nationkey AS uuid, n_name AS name, r_name AS parent FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def track_parents(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("n_nationkey").alias("uuid"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))


@query("exec_track_discovery", f"""WITH {EV}, n AS (SELECT track, packet_idx, CASE WHEN k = 7 THEN 'Exec@7' ELSE name END AS name, row_number() OVER (PARTITION BY track ORDER BY packet_idx) AS nr FROM ev)
SELECT track FROM n WHERE nr <= 10 AND track <> 0 GROUP BY track HAVING bool_or(name LIKE '%Exec@%') ORDER BY min(packet_idx) LIMIT 1""")  # fmt: skip
def exec_track_discovery(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return tracks.execution_track(e.withColumn("name", F.when(F.col("k") == 7, "Exec@7").otherwise(F.col("name"))), views.descriptors(e))


@query("memory_track_fallback", f"WITH {EV} SELECT track FROM ev WHERE track = 5 AND name = 'signup' AND (SELECT count(*) FROM ev WHERE track = 5 AND type = 3) > 0 LIMIT 1")
def memory_track_fallback(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return tracks.memory_track(e, views.descriptors(e), "Memory_Internal", 5)


# Slices ---------------------------------------------------------------------------------------------------------------


@query("slice_filter", f"WITH {EV} SELECT packet_idx, track, type FROM ev WHERE type IN (1, 2)")
def slice_filter(spark: SparkSession, sf: str) -> DataFrame:
    return slices.ordered(views.events(spark, sf)).select("packet_idx", "track", "type")


@query("instant_filter", f"WITH {EV} SELECT packet_idx, name FROM ev WHERE type = 3 AND starts_with(name, 'cl')")
def instant_filter(spark: SparkSession, sf: str) -> DataFrame:
    return views.events(spark, sf).where((F.col("type") == 3) & F.col("name").startswith("cl")).select("packet_idx", "name")


@query("track_choice", f"WITH {EV} SELECT packet_idx, 'user_' || track AS track_name FROM ev WHERE track IN (1, 2, 3) AND track <> 2")
def track_choice(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.chosen(views.track_named(views.events(spark, sf)), ["user_1", "user_2", "user_3"], ["user_2"]).select("packet_idx", "track_name")


@query("slice_order", f"WITH {EV} SELECT packet_idx, row_number() OVER (ORDER BY coalesce(nullif(ts, 0), packet_idx), 'user_' || track, type, packet_idx) - 1 AS pos FROM ev WHERE type IN (1, 2)")
def slice_order(spark: SparkSession, sf: str) -> DataFrame:
    e = slices.ordered(views.track_named(views.events(spark, sf))).withColumn("at", V.time_or_index(F.col("ts"), F.col("packet_idx")))
    return compare.numbered(e.select("at", "track_name", "type", "packet_idx"), "at", "track_name", "type", "packet_idx").select("packet_idx", "pos")


@query("slice_depth", f"WITH {DEEP} SELECT packet_idx, depth::BIGINT AS depth, level::BIGINT AS level, (type = 1 OR level > 0) AS effective FROM d")
def slice_depth(spark: SparkSession, sf: str) -> DataFrame:
    return slices.depths(views.events(spark, sf)).select("packet_idx", "depth", "level", "effective")


def _begins(spark: SparkSession, sf: str) -> DataFrame:
    return slices.matched(slices.depths(views.events(spark, sf)))


@query(
    "slice_pairs",
    f"""WITH {BEGINS} SELECT c.packet_idx, c.track, c.name, c.level::BIGINT AS depth, c.end_idx, (c.end_ts - c.ts)::BIGINT AS dur_ns,
  (SELECT max(p.packet_idx) FROM b p WHERE p.track = c.track AND p.level = c.level - 1 AND p.packet_idx < c.packet_idx) AS parent_idx FROM b c""",
)
def slice_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = slices.with_parent(_begins(spark, sf))
    return b.select("packet_idx", "track", "name", F.col("level").alias("depth"), "end_idx", (F.col("end_ts") - F.col("ts")).alias("dur_ns"), "parent_idx")


@query("slice_unfinished", f"WITH {BEGINS} SELECT track, count(*) AS open FROM b WHERE end_idx IS NULL GROUP BY track")
def slice_unfinished(spark: SparkSession, sf: str) -> DataFrame:
    return _begins(spark, sf).where("end_idx is null").groupBy("track").agg(F.count(F.lit(1)).alias("open"))


@query("slice_durations", f"WITH {BEGINS} SELECT name, level::BIGINT AS level, count(*) AS n, sum(end_ts - ts)::BIGINT AS total_ns, max(end_ts - ts)::BIGINT AS longest_ns FROM b WHERE end_idx IS NOT NULL GROUP BY name, level")
def slice_durations(spark: SparkSession, sf: str) -> DataFrame:
    """total_ns is a bigint, as in SQL, unless one of the sums is no bigint (where the SQL fails): then the column is a decimal."""
    from ..session import shared_folder

    d = F.col("end_ts") - F.col("ts")
    sums = _begins(spark, sf).where("end_idx is not null").groupBy("name", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(d.cast("decimal(19,0)")).alias("total_ns"), F.max(d).alias("longest_ns"))
    folder = shared_folder(spark)
    sums.write.parquet(f"{folder}/durations")
    sums = spark.read.schema(sums.schema).parquet(f"{folder}/durations")
    most = sums.agg(F.max("total_ns")).first()[0] or 0
    return sums.withColumn("total_ns", F.col("total_ns").cast("bigint" if most < 2**63 else "decimal(38,0)"))


# Call graphs ----------------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    e = views.track_named(views.events(spark, sf)).withColumn("full_name", F.concat("track_name", F.lit("::"), "name"))
    return callgraph.graph(e)


@query("call_graph", f"WITH RECURSIVE {PATHS} SELECT path, count(*) AS count FROM tree GROUP BY path")
def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    return callgraph.counted(_graph(spark, sf)).select(F.array_join("path", "/").alias("path"), "count")


@query("call_graph_args", f"WITH RECURSIVE {PATHS} SELECT path, printf('k=\"0x%X\"', k) AS payload, count(*) AS count FROM tree WHERE k % 5 > 0 GROUP BY ALL")
def call_graph_args(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    none = F.lit(None)
    v = callgraph.normalised_value(F.lit("int"), F.col("k"), none.cast("double"), none.cast("boolean"), none.cast("string"), none.cast("string"))
    entries = e.where("k % 5 > 0").select("packet_idx", F.lit(1).alias("pos"), F.lit("k").alias("k"), v.alias("v")).unionByName(e.select("packet_idx", F.lit(0).alias("pos"), F.lit("depth").alias("k"), F.lit("1").alias("v")))
    args = callgraph.counted_args(_graph(spark, sf), callgraph.payloads(entries))
    return args.select(F.array_join("path", "/").alias("path"), V.annotation_text(F.col("payload")).alias("payload"), "count")


@query("call_graph_ranked", f"WITH RECURSIVE {PATHS}, c AS (SELECT path, count(*) AS count FROM tree GROUP BY path) SELECT row_number() OVER (ORDER BY count DESC, path) AS rank, path, count FROM c ORDER BY rank LIMIT 50")
def call_graph_ranked(spark: SparkSession, sf: str) -> DataFrame:
    top = call_graph(spark, sf).orderBy(F.desc("count"), "path").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "path")).cast("bigint"))


@query(
    "name_map_resolve",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Functions::' || p_brand || printf('@0x%06X', p_partkey) ELSE 'Functions::' || p_name || printf('@0x%x', p_partkey) END AS full_name FROM part""",
)
def name_map_resolve(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    e = p.select("p_partkey", F.lit("Functions").alias("track_name"), F.concat("p_name", F.lit("@0x"), F.lower(F.hex("p_partkey"))).alias("name"))
    return callgraph.with_mapped_names(e, p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("addr"), F.col("p_brand").alias("mapped"))).select("p_partkey", "full_name")


# Counters, flows, frames ----------------------------------------------------------------------------------------------


@query("counter_encode", f"WITH {EV} SELECT packet_idx, CASE WHEN v = floor(v) THEN v::BIGINT END AS counter_value, CASE WHEN v <> floor(v) THEN v END AS double_counter_value FROM (SELECT packet_idx, CASE WHEN k % 3 = 0 THEN floor(value) ELSE value END AS v FROM ev)")
def counter_encode(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).withColumn("v", F.when(F.col("k") % 3 == 0, F.floor("value").cast("double")).otherwise(F.col("value")))
    return e.select("packet_idx", *[c.alias(n) for n, c in frames.counter_fields(F.col("v")).items()])


@query("counter_series", f"WITH {EV} SELECT packet_idx, lead(ts) OVER w AS until_ts, value - lag(value) OVER w AS delta FROM ev WHERE type = 3 WINDOW w AS (PARTITION BY track ORDER BY ts, packet_idx)")
def counter_series(spark: SparkSession, sf: str) -> DataFrame:
    return frames.counter_series(views.events(spark, sf).where("type = 3")).select("packet_idx", "until_ts", "delta")


@query("extra_counters", f"WITH {EV} SELECT packet_idx, track + i AS track, k * i AS value FROM ev, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= k % 4")
def extra_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).where("k % 4 > 0").withColumn("i", F.sequence(F.lit(1), (F.col("k") % 4).cast("int")))
    e = e.select("packet_idx", F.transform("i", lambda i: F.col("track") + i).alias("extra_counter_track_uuids"), F.transform("i", lambda i: F.col("k") * i).alias("extra_counter_values"))
    return frames.extra_counters(e)


@query("flow_encode", "SELECT l_orderkey AS flow_id, l_linenumber::INT AS l_linenumber, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_orderkey END AS flow, CASE WHEN l_linestatus = 'F' THEN l_orderkey END AS terminating FROM lineitem")
def flow_encode(spark: SparkSession, sf: str) -> DataFrame:
    last = F.col("l_linestatus") == "F"
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("flow_id"), "l_linenumber", F.when(~last, F.col("l_orderkey")).alias("flow"), F.when(last, F.col("l_orderkey")).alias("terminating"))


@query(
    "flow_steps",
    f"""WITH {EV}, x AS (SELECT k AS flow_id, packet_idx, ts, name = 'error' AS terminating FROM ev)
SELECT a.flow_id, a.packet_idx, (row_number() OVER w - 1)::INT AS step, CASE WHEN row_number() OVER w = 1 THEN 'source' WHEN terminating OR packet_idx = last_value(packet_idx) OVER (PARTITION BY flow_id ORDER BY ts, packet_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN 'sink' ELSE 'step' END AS role
FROM x a WINDOW w AS (PARTITION BY flow_id ORDER BY ts, packet_idx)""",
)
def flow_steps(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).select(F.col("k").alias("flow_id"), "packet_idx", "ts", (F.col("name") == "error").alias("terminating"))
    return frames.flow_steps(e).select("flow_id", "packet_idx", "step", "role")


@query(
    "frame_expected_vs_actual",
    """SELECT coalesce(o_orderkey, k) AS token, e AS expected_ts, a AS actual_ts, a - e AS late_ns FROM (SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS e FROM orders) FULL JOIN (SELECT l_orderkey AS k, min(epoch_us(l_shipdate)) * 1000 AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = k""",
)
def frame_expected_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("token"), (views.micros(F.col("o_orderdate")) * 1000).alias("ts"))
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("token"), (views.micros(F.col("l_shipdate")) * 1000).alias("ts"))
    return frames.expected_and_actual(e, a)


@query(
    "frame_end_join",
    """SELECT o_orderkey, o_custkey AS cookie, e.ts AS end_ts FROM (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) * 1000 AS s FROM orders) o ASOF LEFT JOIN (SELECT l_suppkey AS cookie, epoch_us(l_shipdate) * 1000 AS ts FROM lineitem) e ON o.o_custkey = e.cookie AND o.s <= e.ts""",
)
def frame_end_join(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cookie"), (views.micros(F.col("o_orderdate")) * 1000).alias("ts"))
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cookie"), (views.micros(F.col("l_shipdate")) * 1000).alias("ts"))
    return frames.ended(s, e).select("o_orderkey", "cookie", "end_ts")


@query("jank_flags", "SELECT label, count(*) AS n FROM (SELECT o_orderkey % 65536 AS bits FROM orders), (VALUES " + ", ".join(f"({b}, '{n}')" for b, n in frames.JANK.items()) + ") t(b, label) WHERE bits & b <> 0 GROUP BY label")
def jank_flags(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.explode(frames.jank_labels((F.col("o_orderkey") % 65536).cast("int"))).alias("label"))
    return o.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("ts_us_floor", f"WITH {EV} SELECT packet_idx, floor((k - 50) * 137 / 1000.0)::BIGINT AS us FROM ev")
def ts_us_floor(spark: SparkSession, sf: str) -> DataFrame:
    return views.events(spark, sf).select("packet_idx", V.floor_us((F.col("k") - 50) * 137).alias("us"))


# Interning ------------------------------------------------------------------------------------------------------------

LOOKUPS = f"""{EV}, p AS (SELECT track % 4 AS seq, packet_idx, k, name, k % 37 = 0 AS cleared, k % 41 = 0 AS dropped, k % 2 = 0 AS needs FROM ev),
g AS (SELECT *, sum(CASE WHEN cleared OR dropped THEN 1 ELSE 0 END) OVER w AS gen, coalesce(last_value(CASE WHEN cleared OR dropped THEN cleared END IGNORE NULLS) OVER w, false) AS valid FROM p WINDOW w AS (PARTITION BY seq ORDER BY packet_idx ROWS UNBOUNDED PRECEDING))"""


@query(
    "intern_encode",
    f"""WITH {EV}, f AS (SELECT track % 4 AS seq, name || '_' || k % 8 AS value, min(packet_idx) AS first FROM ev GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY first) AS iid FROM f)
SELECT packet_idx, iid, packet_idx = first AS is_new FROM ev JOIN i ON i.seq = track % 4 AND i.value = name || '_' || k % 8""",
)
def intern_encode(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).select((F.col("track") % 4).alias("seq"), "packet_idx", F.lit(0).alias("pos"), F.concat("name", F.lit("_"), (F.col("k") % 8).cast("string")).alias("value"))
    return interning.encoded(e).select("packet_idx", "iid", "is_new")


@query("intern_flags", f"WITH {EV} SELECT packet_idx, CASE WHEN k % 3 <> 0 THEN 0 WHEN packet_idx = min(CASE WHEN k % 3 = 0 THEN packet_idx END) OVER (PARTITION BY track % 4) THEN 3 ELSE 2 END AS sequence_flags FROM ev")
def intern_flags(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).select((F.col("track") % 4).alias("seq"), "packet_idx", (F.col("k") % 3 == 0).alias("interns"))
    return interning.flags(e).select("packet_idx", "sequence_flags")


@query("intern_generations", f"WITH {LOOKUPS} SELECT packet_idx, gen::BIGINT AS gen, valid FROM g")
def intern_generations(spark: SparkSession, sf: str) -> DataFrame:
    return interning.generations(views.sequences(views.events(spark, sf))).select("packet_idx", "gen", "valid")


def _resolved(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    s = views.sequences(views.events(spark, sf))
    entries = s.where("k % 5 = 0").select("seq", "packet_idx", F.lit(0).alias("pos"), F.lit("event_names").alias("table"), (F.col("k") % 8).alias("iid"), F.concat("name", F.col("k").cast("string")).alias("value"))
    asked = s.select("seq", "packet_idx", F.lit("event_names").alias("table"), F.when(F.col("k") % 11 != 0, F.col("k") % 8).alias("iid"), F.when(F.col("k") % 11 == 0, F.col("name")).alias("inline"))
    return interning.resolved(asked, entries, s, strict=strict)


RESOLVED = f"""{LOOKUPS}, en AS (SELECT seq, gen, packet_idx, k % 8 AS iid, name || k AS value FROM g WHERE k % 5 = 0),
t AS (SELECT g.packet_idx, g.seq, g.k, CASE WHEN g.k % 11 = 0 THEN g.name WHEN g.needs AND NOT g.valid THEN NULL ELSE coalesce(en.value, '<missing EventName iid=' || g.k % 8 || '>') END AS text, g.name FROM g ASOF LEFT JOIN en ON g.seq = en.seq AND g.gen = en.gen AND g.k % 8 = en.iid AND g.packet_idx >= en.packet_idx)"""


@query("intern_resolve", f"WITH {RESOLVED} SELECT packet_idx, text FROM t")
def intern_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("packet_idx", "text")


@query("intern_resolve_strict", f"WITH {RESOLVED} SELECT packet_idx, CASE WHEN seq = 0 THEN CASE WHEN k % 11 = 0 THEN name END ELSE text END AS text FROM t")
def intern_resolve_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf, strict=True).select("packet_idx", "text")


@query("intern_missing", f"WITH {RESOLVED} SELECT text, count(*) AS n FROM t WHERE text LIKE '<missing %' GROUP BY text")
def intern_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).where(F.col("text").startswith("<missing ")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


# Annotations ----------------------------------------------------------------------------------------------------------

NAMED = """nm AS (SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN n_name || '_pc' WHEN 1 THEN lower(n_name) || '_ADDR' WHEN 2 THEN 'pc' WHEN 3 THEN 'SP' ELSE n_name || '_address' END AS name,
  ['bool', 'int', 'uint', 'float', 'str', 'other'][n_nationkey % 6 + 1] AS kind FROM nation),
h AS (SELECT *, regexp_matches(lower(name), '(_addr|_address|_pc|_sp|_pointer)$') AS py, regexp_matches(name, '(_addr|_address|_pc|_sp|_pointer)$') OR name IN ('pc', 'sp', 'address') AS cpp FROM nm),
hh AS (SELECT *, py OR lower(name) IN ('pc', 'sp', 'address') AS rust FROM h)"""


def _named(spark: SparkSession, sf: str) -> DataFrame:
    n, m = table(spark, sf, "nation"), F.col("n_nationkey") % 5
    name = F.when(m == 0, F.concat("n_name", F.lit("_pc"))).when(m == 1, F.concat(F.lower("n_name"), F.lit("_ADDR"))).when(m == 2, "pc").when(m == 3, "SP").otherwise(F.concat("n_name", F.lit("_address")))
    kinds = F.array(*map(F.lit, ("bool", "int", "uint", "float", "str", "other")))
    return n.select(F.col("n_nationkey").alias("id"), name.alias("name"), F.element_at(kinds, F.col("n_nationkey") % 6 + 1).alias("kind"))


@query("pointer_heuristic", f"WITH {NAMED} SELECT id, py, cpp, rust FROM hh")
def pointer_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("id", *[V.is_pointer_name(F.col("name"), d).alias(d) for d in V.DIALECTS])


@query(
    "annotation_types",
    f"""WITH {NAMED} SELECT id, CASE kind WHEN 'bool' THEN 'bool' WHEN 'float' THEN 'double' WHEN 'int' THEN if(py, 'pointer', 'int') WHEN 'uint' THEN if(py, 'pointer', 'int') ELSE 'string' END AS py,
  CASE kind WHEN 'bool' THEN 'bool' WHEN 'float' THEN 'double' WHEN 'int' THEN if(cpp, 'pointer', 'int') WHEN 'uint' THEN 'pointer' ELSE 'string' END AS cpp,
  CASE kind WHEN 'bool' THEN 'bool' WHEN 'float' THEN 'double' WHEN 'int' THEN if(rust, 'pointer', 'int') WHEN 'uint' THEN if(rust, 'pointer', 'uint') ELSE 'string' END AS rust FROM hh""",
)
def annotation_types(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("id", *[V.value_kind(F.col("kind"), F.col("name"), d).alias(d) for d in V.DIALECTS])


@query(
    "annotation_value_string",
    f"""WITH {EV} SELECT packet_idx, CASE k % 6 WHEN 0 THEN name WHEN 1 THEN (k - 50)::VARCHAR WHEN 2 THEN value::VARCHAR WHEN 3 THEN (k > 50)::VARCHAR WHEN 4 THEN printf('0x%X', k * 1000) ELSE '<unknown>' END AS text FROM ev""",
)
def annotation_value_string(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("string", "int", "double", "bool", "pointer", "dict"))), (F.col("k") % 6 + 1).cast("int"))
    i = F.when(F.col("k") % 6 == 4, F.col("k") * 1000).otherwise(F.col("k") - 50)
    return views.events(spark, sf).select("packet_idx", V.compared_text(kinds, F.col("name"), i, F.col("value"), F.col("k") > 50).alias("text"))


@query("annotation_string", f"WITH {EV} SELECT packet_idx, 'name=' || name || '; pc=' || printf('0x%06X', k) || '; track=' || track AS text FROM ev")
def annotation_string(spark: SparkSession, sf: str) -> DataFrame:
    parts = (("track", F.col("track").cast("string")), ("pc", V.hex_upper(F.col("k"), 6)), ("name", F.col("name")))
    return views.events(spark, sf).select("packet_idx", V.annotation_text(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in parts])).alias("text"))


@query("annotation_string_normalized", f"WITH {EV} SELECT packet_idx, CASE WHEN k % 3 = 0 THEN name ELSE printf('%X', k % 10) END AS text FROM ev")
def annotation_string_normalized(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("k") % 3 == 0, F.col("name")).otherwise(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("k") % 10)), 4, "0")))
    return views.events(spark, sf).select("packet_idx", V.stripped_hex(raw).alias("text"))


@query(
    "annotation_last_wins",
    f"""WITH {EV} SELECT packet_idx // 5 AS packet_idx, name AS k, arg_max(packet_idx % 5, packet_idx) AS pos, arg_max(k, packet_idx) AS v FROM ev WHERE k % 13 <> 0 GROUP BY ALL""",
)
def annotation_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).select(F.expr("packet_idx div 5").alias("packet_idx"), (F.col("packet_idx") % 5).alias("pos"), F.when(F.col("k") % 13 != 0, F.col("name")).otherwise("").alias("k"), F.col("k").alias("v"))
    return callgraph.last_wins(e)


@query(
    "payload_normalize",
    f"""WITH {EV} SELECT packet_idx, 'k="' || CASE WHEN k < 50 THEN printf('0x-%X', 50 - k) ELSE printf('0x%X', k - 50) END || '"; ok=' || (k > 50)::VARCHAR || '; tag="' || name || '"' AS payload FROM ev""",
)
def payload_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e, none = views.events(spark, sf), F.lit(None)
    v = lambda kind, i=none.cast("bigint"), b=none.cast("boolean"), s=none.cast("string"): callgraph.normalised_value(F.lit(kind), i, none.cast("double"), b, s, none.cast("string"))
    parts = (("tag", v("string", s=F.col("name"))), ("k", v("int", i=F.col("k") - 50)), ("ok", v("bool", b=F.col("k") > 50)), ("depth", v("int", i=F.col("k"))))
    one = e.select("packet_idx", F.posexplode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("v")) for k, x in parts])).alias("pos", "a")).select("packet_idx", "pos", "a.*")
    return callgraph.payloads(one).select("packet_idx", V.annotation_text(F.col("payload")).alias("payload"))


@query(
    "yaml_quote",
    r"""SELECT p_partkey, CASE WHEN regexp_matches(t, '[:#{}\[\]&*?|\-<>=!%@\\"]') OR regexp_matches(t, '^[0-9]') THEN '''' || replace(t, '''', '''''') || '''' ELSE t END AS k,
  CASE WHEN regexp_matches(t, '[:#{}\[\]&*?|\-<>=!%@\\"]') OR lower(t) IN ('null', 'true', 'false') THEN '''' || replace(t, '''', '''''') || '''' ELSE t END AS v
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN 'True' WHEN 2 THEN p_partkey || ' it''s' WHEN 3 THEN p_name ELSE p_type || ':' END AS t FROM part)""",
)
def yaml_quote(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("p_partkey") % 5
    t = F.when(m == 0, F.col("p_brand")).when(m == 1, "True").when(m == 2, F.concat(F.col("p_partkey").cast("string"), F.lit(" it's"))).when(m == 3, F.col("p_name")).otherwise(F.concat("p_type", F.lit(":")))
    return table(spark, sf, "part").select("p_partkey", V.yaml_key(t).alias("k"), V.yaml_value(t).alias("v"))


# Comparison -----------------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return compare.paired(views.execution(spark, sf, "a"), views.execution(spark, sf, "b"))


@query("compare_ordinal", f"WITH {EXEC} SELECT pos, name, error FROM err WHERE error IS NOT NULL")
def compare_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("pos", F.col("a.name").alias("name"), compare.execution_error().alias("error")).where("error is not null")


@query("compare_first_divergence", f"WITH {EXEC} SELECT pos, name, ta AS text1, tb AS text2, error FROM err WHERE error IS NOT NULL ORDER BY pos LIMIT 1")
def compare_first_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return compare.first_difference(_pairs(spark, sf), compare.execution_error()).select("pos", F.col("a.name").alias("name"), F.col("a.text").alias("text1"), F.col("b.text").alias("text2"), "error")


@query("compare_context", f"WITH {EXEC}, fd AS (SELECT min(pos) AS p FROM err WHERE error IS NOT NULL) SELECT pos, pc, opcode, p AS diverges_at FROM err, fd WHERE pos BETWEEN p - 5 AND p")
def compare_context(spark: SparkSession, sf: str) -> DataFrame:
    return compare.context(_pairs(spark, sf), compare.execution_error()).select("pos", "a.pc", "a.opcode", "diverges_at")


@query("compare_summary", f"WITH {EXEC} SELECT count(ta) AS n1, count(tb) AS n2, bool_and(error IS NULL) AS same FROM err")
def compare_summary(spark: SparkSession, sf: str) -> DataFrame:
    return compare.equal(_pairs(spark, sf), compare.execution_error())


@query("annotation_diff", f"WITH {EXEC}, q AS (SELECT pos, unnest([{{'side': '-', 'entry': string_split(ta, '; ')[3]}}, {{'side': '+', 'entry': string_split(tb, '; ')[3]}}], recursive := true) FROM err WHERE error = 'Annotation mismatch') SELECT * FROM q")
def annotation_diff(spark: SparkSession, sf: str) -> DataFrame:
    return compare.text_diff(_pairs(spark, sf))


@query(
    "memory_normalize",
    """WITH w AS (SELECT l_orderkey AS packet_idx, l_partkey AS p, l_suppkey * 65537 + l_partkey AS v, l_linenumber AS n, l_linestatus = 'F' AS inner_, l_suppkey % 2 = 0 AS hexed, printf('0x%04X', l_partkey % 65536) AS pc FROM lineitem),
x AS (SELECT *, unnest(range(n)) AS i FROM w)
SELECT packet_idx, i::INT AS byte_no, if(inner_, 'offset', 'addr') AS key, CASE WHEN n > 1 THEN if(inner_, printf('0x%02X', p + i), printf('0x%06X', p + i)) WHEN hexed THEN printf('0x%X', p) ELSE p::VARCHAR END AS addr_text,
  CASE WHEN n > 1 THEN printf('0x%02X', (v >> (8 * i)) & 255) ELSE printf('0x%X', v) END AS value_text, pc FROM x""",
)
def memory_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return memory.single_bytes(views.writes(spark, sf)).select("packet_idx", "byte_no", "key", "addr_text", "value_text", "pc")


@query(
    "memory_compare",
    f"""WITH w AS (SELECT *, l_linestatus = 'F' AS inner_, l_suppkey * 65537 + l_partkey AS v, unnest(range(l_linenumber)) AS i FROM lineitem),
x AS (SELECT l_orderkey, inner_, row_number() OVER (PARTITION BY inner_ ORDER BY {ORDER}, i) - 1 AS pos,
  CASE WHEN l_linenumber > 1 THEN if(inner_, printf('0x%02X', l_partkey + i), printf('0x%06X', l_partkey + i)) WHEN l_suppkey % 2 = 0 THEN printf('0x%X', l_partkey) ELSE l_partkey::VARCHAR END AS a,
  CASE WHEN l_linenumber > 1 THEN printf('0x%02X', (v >> (8 * i)) & 255) ELSE printf('0x%X', v) END AS v1,
  CASE WHEN l_linenumber > 1 THEN printf('0x%02X', ((v + 1) >> (8 * i)) & 255) ELSE printf('0x%X', v + 1) END AS v2 FROM w)
SELECT pos, if(inner_, 'Memory_Internal value mismatch at offset ', 'Memory_External value mismatch at addr ') || a || ': ''' || v1 || ''' vs ''' || v2 || '''' AS error
FROM x WHERE l_orderkey % 1009 = 17 AND v1 <> v2""",
)
def memory_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Every byte of all writes, of inner and of external ones apart."""
    writes = views.writes(spark, sf)
    raised = V.hex_upper(V.parse_int(F.col("value")) + F.when(F.col("l_orderkey") % 1009 == 17, 1).otherwise(0))
    sides = [memory.single_bytes(w) for w in (writes, writes.withColumn("value", raised))]

    def errors(kind: str, key: str) -> DataFrame:
        a, b = (compare.numbered(w.where(F.col("key") == key), *views.LINE, "byte_no").select("pos", F.col("addr_text").alias("addr"), F.col("value_text").alias("value"), "pc") for w in sides)
        return compare.paired(a, b).select("pos", compare.memory_error(kind, key).alias("error")).where("error is not null")

    return errors("Memory_Internal", "offset").unionByName(errors("Memory_External", "addr"))


# Program counters -----------------------------------------------------------------------------------------------------

PCS = "h AS (SELECT l_partkey & 65535 AS pc, count(*) AS count, min(l_orderkey * 10 + l_linenumber) AS first_pos FROM lineitem GROUP BY 1), m AS (SELECT pc + 917504 AS addr, count, first_pos FROM h)"


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.by_region(hotspots.histogram(views.program_counters(spark, sf)))


@query("pc_histogram", f"WITH {PCS} SELECT * FROM h")
def pc_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.histogram(views.program_counters(spark, sf))


@query("pc_region_map", f"WITH {PCS} SELECT * FROM m")
def pc_region_map(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf)


@query("pc_totals", f'WITH {PCS} SELECT sum(count)::BIGINT AS total, count(*) AS "unique" FROM m')
def pc_totals(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.totals(_regions(spark, sf))


@query("pc_hotspots", f"""WITH {PCS}, t AS (SELECT *, row_number() OVER w AS rank, sum(count) OVER (ORDER BY count DESC, first_pos, addr ROWS UNBOUNDED PRECEDING) AS s, sum(count) OVER () AS total FROM m WINDOW w AS (ORDER BY count DESC, first_pos, addr))
SELECT rank::INT AS rank, addr, count, count::DOUBLE / total::DOUBLE * 100 AS percent, s::DOUBLE / total::DOUBLE * 100 AS cumulative FROM t WHERE rank <= 20""")  # fmt: skip
def pc_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots.hottest(_regions(spark, sf))


@query("pc_containing_function", """WITH f AS (SELECT p_partkey * 7 AS s, p_partkey * 7 + p_size AS e, p_name AS name FROM part), a AS (SELECT DISTINCT l_partkey * 3 AS addr FROM lineitem),
j AS (SELECT addr, max(s) AS s FROM a JOIN f ON addr >= f.s AND addr < f.e GROUP BY addr)
SELECT a.addr, f.name AS function, a.addr - f.s AS distance FROM a LEFT JOIN j USING (addr) LEFT JOIN f ON f.s = j.s""")  # fmt: skip
def pc_containing_function(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "part").select((F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("end"), F.col("p_name").alias("name"))
    return hotspots.containing(table(spark, sf, "lineitem").select((F.col("l_partkey") * 3).alias("addr")).distinct(), f)


# Raw bytes ------------------------------------------------------------------------------------------------------------


@query("bin_strings_top", r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7E]{4,}') AS v FROM documents), s AS (SELECT doc_id, unnest(v) AS value, unnest(range(len(v))) AS nr FROM l)
SELECT value, count(*) AS n FROM s GROUP BY value ORDER BY n DESC, min((doc_id, nr)) LIMIT 50""")  # fmt: skip
def bin_strings_top(spark: SparkSession, sf: str) -> DataFrame:
    """Of equally frequent strings the one that came first."""
    files = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return rawbytes.strings(files).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "nr")).alias("at")).orderBy(F.desc("n"), "at").limit(50).drop("at")


@query("bin_pattern_context", """WITH h AS (SELECT page_id, hex(encode(html)) AS h FROM pages), m AS (SELECT page_id, h, unnest(list_filter(range(len(h) // 2), lambda i: substr(h, 2 * i + 1, 6) = '3C703E')) AS position FROM h)
SELECT page_id, position::INT AS position, substr(h, 2 * greatest(position - 20, 0) + 1, 2 * least(20, position)) AS before, substr(h, 2 * position + 7, 40) AS after FROM m""")  # fmt: skip
def bin_pattern_context(spark: SparkSession, sf: str) -> DataFrame:
    return rawbytes.occurrences(table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")), b"<p>")


@query("bin_extract_numbers", """WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part), m AS (SELECT p_partkey, h, unnest(list_filter(range(len(h) // 2), lambda i: substr(h, 2 * i + 1, 2) = '20')) AS i FROM h)
SELECT ('0x' || substr(h, 2 * i + 5, 2) || substr(h, 2 * i + 3, 2))::BIGINT AS number, count(*) AS n FROM m WHERE len(h) >= 2 * i + 6 GROUP BY 1""")  # fmt: skip
def bin_extract_numbers(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "part").select(F.encode("p_name", "UTF-8").alias("content"))
    return rawbytes.numbers(files, b" ").groupBy("number").agg(F.count(F.lit(1)).alias("n"))


@query("bin_varint_fields", "WITH b AS (SELECT ascii(unnest(regexp_extract_all(p_name, '[\\x00-\\x7F]'))) AS v FROM part) SELECT (v >> 3)::INT AS field, (v & 7)::INT AS wire, count(*) AS n FROM b WHERE v >> 3 > 0 GROUP BY ALL")
def bin_varint_fields(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "part").select(F.encode("p_name", "UTF-8").alias("content"))
    return rawbytes.fields(files).groupBy("field", "wire").agg(F.sum("n").alias("n"))


@query("bin_hexdump", """WITH h AS (SELECT p_partkey, p_name, lower(hex(encode(p_name))) AS h FROM part), l AS (SELECT p_partkey, p_name, h, unnest(range(0, len(h) // 2, 16)) AS line FROM h)
SELECT p_partkey, line::INT AS line, printf('%08x', line) || '  ' || rpad(rtrim(regexp_replace(substr(h, 2 * line + 1, 32), '(..)', '\\1 ', 'g')), 48, ' ') || '  ' || substr(p_name, line + 1, 16) AS text FROM l""")  # fmt: skip
def bin_hexdump(spark: SparkSession, sf: str) -> DataFrame:
    return rawbytes.hexdump(table(spark, sf, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("content")))


# The wire --------------------------------------------------------------------------------------------------------------


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    """Events as packets of eight traces, with an annotation each."""
    from ..sources.schema import PACKET

    e = views.events(spark, sf)
    empty = spark.createDataFrame([], PACKET)
    kinds = {f.name: f.dataType for f in empty.schema["event"].dataType.fields}
    ann = empty.schema["event"].dataType["annotations"].dataType
    one = {"path": F.array(F.lit(0)), "holder": F.lit("root"), "name": F.lit("k"), "kind": F.lit("int"), "int_v": F.col("k")}
    k = F.struct(*[one.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ann.elementType.fields])
    event = {"type": F.col("type"), "track_uuid": F.col("track"), "name": F.col("name"), "double_counter_value": F.col("value"), "annotations": F.array(k)}
    fields = {"trace": F.concat(F.lit("t"), (F.col("track") % 8).cast("string")), "packet_idx": F.col("packet_idx"), "timestamp": F.col("ts"), "seq_id": F.col("packet_idx"), "kind": F.lit("track_event"), "event": F.struct(*[event.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])}
    return e.select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


def _unpacked(back: DataFrame) -> DataFrame:
    v = F.col("event")
    return back.select(F.col("seq_id").alias("packet_idx"), v["track_uuid"].alias("track"), F.col("timestamp").alias("ts"), v["type"].alias("type"), v["name"].alias("name"), v["double_counter_value"].alias("value"), v["annotations"][0]["int_v"].alias("k"))


PACKETS = f"WITH {EV} SELECT packet_idx, track, ts, type, name, value, k FROM ev"


@query("codec_roundtrip", PACKETS)
def codec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Events as packets, encoded to the trace's bytes, decoded again."""
    from ..sources import trace

    return _unpacked(trace.decoded(trace.serialized(_packets(spark, sf))))


@query("trace_files", PACKETS)
def trace_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events as packets, saved as trace files in the shared folder and scanned from there by the data source."""
    from ..session import shared_folder
    from ..sources import trace

    folder = shared_folder(spark)
    trace.register(spark)
    _packets(spark, sf).write.format("trace").mode("append").save(folder)
    return _unpacked(spark.read.format("trace").load(folder))


@query("name_map_json", "SELECT p_partkey AS addr, p_name AS mapped FROM part")
def name_map_json(spark: SparkSession, sf: str) -> DataFrame:
    """Name maps written as JSON files, half of the keys hexadecimal, and read again; entries that are no names are dropped."""
    from ..session import shared_folder
    from ..sources.names import name_map

    p, folder = table(spark, sf, "part"), shared_folder(spark)
    key = F.when(F.col("p_partkey") % 2 == 0, V.hex_upper(F.col("p_partkey"))).otherwise(F.col("p_partkey").cast("string"))
    entries = p.groupBy((F.col("p_partkey") % 16).alias("g")).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col("p_name").alias("v")))).alias("names"))
    flat = F.concat(F.expr("left(to_json(names), length(to_json(names)) - 1)"), F.lit(',"no address":"x","7777777":5}'))
    text = F.when(F.col("g") % 2 == 0, F.concat(F.lit('{"names":'), flat, F.lit("}"))).otherwise(flat)
    entries.select("g", text.alias("value")).repartition("g").write.partitionBy("g").mode("append").text(folder)
    return name_map(spark, f"{folder}/g=*").select("addr", "mapped")


@query("pc_scan", "SELECT l_partkey & 65535 AS pc, count(*) AS count FROM lineitem GROUP BY 1")
def pc_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Program counters found in the bytes of files (one for each order) by the marks around them; decoys lack a mark."""
    li = table(spark, sf, "lineitem")
    low, high = (F.lpad(F.hex(x), 2, "0") for x in (F.col("l_partkey").bitwiseAND(F.lit(255)), F.shiftright("l_partkey", 8).bitwiseAND(F.lit(255))))
    event = F.concat(F.lit("0011"), F.lit("38"), low, high, F.lit("3C"), F.lit("52027063"), F.lit("FF39"), low, high, F.lit("3C52027063"))
    files = li.groupBy("l_orderkey").agg(F.unhex(F.concat(F.lit("52027063"), F.array_join(F.collect_list(event), ""))).alias("content"))
    return hotspots.counters_in(files).groupBy("pc").agg(F.count(F.lit(1)).alias("count"))


@query("utf8_replaced", f"WITH {EV} SELECT packet_idx, name || chr(65533) || k || chr(65533) AS text FROM ev")
def utf8_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Names as bytes with malformed places, as text."""
    raw = F.concat(F.encode("name", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.col("k").cast("string"), "UTF-8"), F.unhex(F.lit("C3")))
    return views.events(spark, sf).select("packet_idx", V.utf8(raw).alias("text"))


@query("builder_events", """WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, * FROM nation), b AS (SELECT i, n_name AS track_name, n_nationkey::BIGINT AS key, 'r' || n_regionkey AS region, 1000 * (i + 1) AS ts FROM n)
SELECT track_name, 'call' AS name, 1 AS type, ts, '0x' || printf('%X', key) || ';' || region AS args FROM b UNION ALL SELECT track_name, 'mark', 3, ts + 10, NULL FROM b UNION ALL SELECT track_name, NULL, 2, ts + 20, NULL FROM b""")  # fmt: skip
def builder_events(spark: SparkSession, sf: str) -> DataFrame:
    """A trace built packet by packet, with a thread for each nation (a table of fixed size), interned names, annotations; then resolved."""
    from ..operators import packets
    from ..sources.builder import TraceBuilder

    b = TraceBuilder("Nations")
    for i, r in enumerate(table(spark, sf, "nation").orderBy("n_nationkey").collect()):
        t, ts = b.add_thread(r.n_name), 1000 * (i + 1)
        b.begin_slice(t, "call", ts).add_annotations({"key_pc": r.n_nationkey, "region": f"r{r.n_regionkey}"})
        b.add_instant_event(t, "mark", ts + 10)
        b.end_slice(t, ts + 20)
    p = b.frame(spark)
    e = tracks.named_as_of(packets.events(p), packets.descriptors(p).select("track", "packet_idx", "name"))
    args = packets.compared_entries(p).select("packet_idx", F.array_join(F.transform("entries", lambda x: x["v"]), ";").alias("args"))
    return e.join(args, "packet_idx", "left").select("track_name", "name", "type", "ts", "args")
