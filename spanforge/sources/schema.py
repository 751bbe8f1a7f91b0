"""Rows of a trace: one per packet, and how they come from and go to messages."""

from __future__ import annotations

from decimal import Decimal

ANNOTATION = "struct<path:array<int>,holder:string,name:string,name_iid:bigint,kind:string,bool_v:boolean,int_v:bigint,uint_v:decimal(20,0),dbl_v:double,str_v:string,str_iid:bigint>"
EVENT = f"struct<type:int,track_uuid:bigint,name:string,name_iid:bigint,categories:array<string>,counter_value:bigint,double_counter_value:double,flow_ids:array<bigint>,terminating_flow_ids:array<bigint>,extra_counter_track_uuids:array<bigint>,extra_counter_values:array<bigint>,extra_double_counter_track_uuids:array<bigint>,extra_double_counter_values:array<double>,annotations:array<{ANNOTATION}>>"
DESCRIPTOR = "struct<uuid:bigint,parent_uuid:bigint,name:string,pid:int,tid:int,process_name:string,thread_name:string,cmdline:array<string>>"
FRAME = "struct<event:string,cookie:bigint,token:bigint,display_frame_token:bigint,pid:int,layer_name:string,present_type:int,on_time_finish:boolean,gpu_composition:boolean,jank_type:int,prediction_type:int,is_buffer:boolean,jank_severity_type:int,present_delay_millis:float,vsync_resynced_jitter_millis:float,jank_severity_score:float,jank_type_experimental:int,present_type_experimental:int,jank_debug_metadata:float,latched_fence_state:int,animation_time_millis:float,latched_unsignaled_count:bigint,addressable_unsignaled_latch_count:bigint>"
ENTRY = "struct<table:string,pos:int,iid:bigint,value:binary>"
PACKET = f"trace string, packet_idx bigint, timestamp bigint, clock_id bigint, seq_id bigint, sequence_flags int, dropped boolean, first_on_sequence boolean, kind string, event {EVENT}, descriptor {DESCRIPTOR}, frame {FRAME}, entries array<{ENTRY}>"
TABLES = {"event_names": "name", "debug_annotation_names": "name", "debug_annotation_string_values": "str"}
SAME_EVENT = ("type", "name", "categories", "counter_value", "double_counter_value", "extra_counter_values", "extra_double_counter_values")
KINDS = {"bool_value": "bool", "int_value": "int", "uint_value": "uint", "pointer_value": "pointer", "double_value": "double", "string_value": "string", "string_value_iid": "string", "legacy_json_value": "legacy_json"}


def signed(v: int | None) -> int | None:
    """An unsigned 64-bit number as the long with the same bits."""
    return v - (1 << 64) if v is not None and v >> 63 else v


def unsigned(v: int | None) -> int | None:
    return v & 0xFFFFFFFFFFFFFFFF if v is not None else None


def _flat(annotations: list[dict], path: list[int], holder: str) -> list[dict]:
    """Annotations at every depth, each with its place; a container's members follow it."""
    out = []
    for i, a in enumerate(annotations):
        inner = ("dict", a["dict_entries"]) if a.get("dict_entries") else ("array", a["array_values"]) if a.get("array_values") else None
        field = next((f for f in KINDS if f in a), None)
        row = {"path": [*path, i], "holder": holder, "name": a.get("name"), "name_iid": signed(a.get("name_iid")), "kind": inner[0] if inner else KINDS.get(field, "null")}
        row |= dict.fromkeys(("bool_v", "int_v", "uint_v", "dbl_v", "str_v", "str_iid"))
        if not inner and field:
            v = a[field]
            to = {"bool": "bool_v", "int": "int_v", "uint": "uint_v", "pointer": "uint_v", "double": "dbl_v"}.get(row["kind"], "str_iid" if field.endswith("iid") else "str_v")
            row[to] = Decimal(v) if to == "uint_v" else signed(v) if to == "str_iid" else v
        out.append(row)
        if inner:
            out += _flat(inner[1], [*path, i], inner[0])
    return out


def _nested(rows: list[dict]) -> list[dict]:
    """The inverse of _flat."""
    top: list[dict] = []
    by_path: dict[tuple, dict] = {}
    for r in sorted(rows, key=lambda r: list(r["path"])):
        a = {k: v for k, v in (("name", r["name"]), ("name_iid", unsigned(r["name_iid"]))) if v is not None}
        kind = r["kind"]
        if kind == "string":
            a |= {"string_value_iid": unsigned(r["str_iid"])} if r["str_iid"] is not None else {"string_value": r["str_v"]}
        elif kind in ("bool", "int", "double"):
            a[f"{kind}_value"] = r[{"bool": "bool_v", "int": "int_v", "double": "dbl_v"}[kind]]
        elif kind in ("uint", "pointer"):
            a[f"{kind}_value"] = int(r["uint_v"])
        elif kind == "legacy_json":
            a["legacy_json_value"] = r["str_v"]
        by_path[tuple(r["path"])] = a
        parent = by_path.get(tuple(r["path"][:-1]))
        (top if parent is None else parent.setdefault("dict_entries" if r["holder"] == "dict" else "array_values", [])).append(a)
    return top


def to_row(packet: dict, index: int, trace: str) -> dict:
    row = {"trace": trace, "packet_idx": index, "timestamp": signed(packet.get("timestamp")), "clock_id": packet.get("timestamp_clock_id"), "seq_id": packet.get("trusted_packet_sequence_id"), "sequence_flags": packet.get("sequence_flags")}
    row |= {"dropped": packet.get("previous_packet_dropped"), "first_on_sequence": packet.get("first_packet_on_sequence"), "kind": None, "event": None, "descriptor": None, "frame": None, "entries": None}
    if (e := packet.get("track_event")) is not None:
        row["kind"] = "track_event"
        row["event"] = {k: e.get(k) for k in SAME_EVENT} | {"track_uuid": signed(e.get("track_uuid")), "name_iid": signed(e.get("name_iid")), "annotations": _flat(e.get("debug_annotations", []), [], "root")}
        row["event"] |= {k: [signed(x) for x in e[k]] if k in e else None for k in ("flow_ids", "terminating_flow_ids", "extra_counter_track_uuids", "extra_double_counter_track_uuids")}
    if (d := packet.get("track_descriptor")) is not None:
        p, t = d.get("process", {}), d.get("thread", {})
        row["kind"] = "track_descriptor"
        row["descriptor"] = {"uuid": signed(d.get("uuid")), "parent_uuid": signed(d.get("parent_uuid")), "name": d.get("name"), "pid": t.get("pid", p.get("pid")), "tid": t.get("tid"), "process_name": p.get("process_name"), "thread_name": t.get("thread_name"), "cmdline": p.get("cmdline")}
    if (f := packet.get("frame_timeline_event")) is not None and f:
        kind, v = next(iter(f.items()))
        row["kind"], row["frame"] = "frame_timeline_event", {"event": kind} | v
    if (n := packet.get("interned_data")) is not None:
        row["entries"] = [{"table": t, "pos": i, "iid": signed(x.get("iid")), "value": x.get(k)} for t, k in TABLES.items() for i, x in enumerate(n.get(t, []))]
    return row


def _present(d: dict) -> dict:
    return {k: v for k, v in d.items() if v is not None and v != []}


def to_packet(row: dict) -> dict:
    """The inverse of to_row."""
    p = _present({"timestamp": unsigned(row["timestamp"]), "timestamp_clock_id": row["clock_id"], "trusted_packet_sequence_id": row["seq_id"], "sequence_flags": row["sequence_flags"], "previous_packet_dropped": row["dropped"], "first_packet_on_sequence": row["first_on_sequence"]})
    if e := row["event"]:
        ids = {k: [unsigned(x) for x in e[k] or []] for k in ("flow_ids", "terminating_flow_ids", "extra_counter_track_uuids", "extra_double_counter_track_uuids")}
        p["track_event"] = _present({k: e[k] for k in SAME_EVENT} | ids | {"track_uuid": unsigned(e["track_uuid"]), "name_iid": unsigned(e["name_iid"]), "debug_annotations": _nested(e["annotations"] or [])})
    if d := row["descriptor"]:
        thread = _present({"pid": d["pid"] if d["tid"] is not None else None, "tid": d["tid"], "thread_name": d["thread_name"]})
        process = _present({"pid": d["pid"] if d["tid"] is None else None, "process_name": d["process_name"], "cmdline": d["cmdline"]})
        p["track_descriptor"] = _present({"uuid": unsigned(d["uuid"]), "parent_uuid": unsigned(d["parent_uuid"]), "name": d["name"]}) | ({"thread": thread} if thread else {}) | ({"process": process} if process else {})
    if f := row["frame"]:
        p["frame_timeline_event"] = {f["event"]: _present({k: v for k, v in f.items() if k != "event"})}
    if row["entries"]:
        data: dict[str, list] = {}
        for x in sorted(row["entries"], key=lambda x: x["pos"]):
            data.setdefault(x["table"], []).append({"iid": unsigned(x["iid"]), TABLES[x["table"]]: bytes(x["value"] or b"")})
        p["interned_data"] = data
    return p
