"""The drift report against a plain in-memory version, and small cases."""

import json
from collections import defaultdict

import pytest

from strandline.operators import schema_drift as S
from strandline.sources.tables import table

LINES = "line_id long, source_id long, agent string, raw_line string, field string, value int"
CATALOGUE = "agent string, field_name string, json_type string, presence string"


def brute(lines, catalogue, stands):
    """stands: {(agent, field): catalogue field}, learnt by the operator."""
    known = defaultdict(dict)
    for a, f, t, p in catalogue:
        known[a][f] = ({*t.split("|")}, p)
    domain = defaultdict(lambda: defaultdict(int))
    files = defaultdict(list)
    for source, agent, raw in lines:
        try:
            o = json.loads(raw or "")
        except ValueError:
            continue
        if isinstance(o, dict) and agent in known:
            d = S.line_fields(o, agent == "codex")
            files[source, agent].append((o, d))
            for f in known[agent]:
                if d.get(f) is not None:
                    domain[agent, f][S.signature(d[f])] += 1
    out = set()
    for (source, agent), rows in files.items():
        renamed, unknown = set(), set()
        for o, d in rows:
            for f, v in d.items():
                if f in known[agent]:
                    if v is not None and S.json_type(v) not in known[agent][f][0]:
                        out.add((source, f, "retyped"))
                else:
                    c = stands.get((agent, f))
                    unknown.add((f, c))
                    n = domain[agent, c]
                    if c and d.get(c) is None and n[S.signature(v)] >= S.USUAL_SHARE * sum(n.values()) > 0:
                        renamed.add((f, c))
        out |= {(source, c, "renamed") for _, c in renamed} | {(source, f, "added") for f, c in unknown if (f, c) not in renamed}
        for f, (_, p) in known[agent].items():
            ask = []
            for o, d in rows:
                kind = o.get("type") or next((v for f2, v in d.items() if "." not in f2 and f2 not in known[agent] and isinstance(v, str) and v in (*S.ITEM_TYPES, S.FIRST_TYPE)), None)
                if p == "always" or (p == "message" and isinstance(o.get("message"), dict)) or (p == "item" and kind in S.ITEM_TYPES) or (p == "first" and kind == S.FIRST_TYPE):
                    ask.append(f in d)
            if ask and not any(ask) and f not in {c for _, c in renamed}:
                out.add((source, f, "removed"))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    lines, catalogue = (table(spark, f"/root/testdata/{sf}", t) for t in ("log_lines", "field_catalog"))
    facts = S.drift_facts(lines, catalogue)
    stands = {(r.agent, r.field): r.c for r in S.renamings(facts, S._domains(facts)).collect()}
    got = [tuple(r) for r in S.drift_report(lines, catalogue).collect()]
    want = brute([tuple(r) for r in lines.select("source_id", "agent", "raw_line").collect()], [tuple(r) for r in catalogue.collect()], stands)
    assert len(got) == len({*got}) and {*got} == want


def test_cases(spark):
    catalogue = spark.createDataFrame([("a", "type", "string", "always"), ("a", "version", "string", "message"), ("a", "message", "object", "optional"), ("b", "payload", "object", "always"), ("b", "payload.x", "string|array", "item"), ("b", "type", "string", "always")], CATALOGUE)
    plain = {"type": "user", "version": "1.2.3", "message": {}}
    raws = [
        *[(1, "a", json.dumps(plain))] * 5,
        (2, "a", json.dumps({"type": "user", "Version": "1.2.4", "message": {}})), (2, "a", json.dumps({"type": "user", "Version": [1, 2, 4], "message": {}})),
        (3, "a", json.dumps({**plain, "version": {"major": 1}, "extra": 1})), (3, "a", json.dumps({**plain, "extra": None})),
        (4, "a", json.dumps({"type": None, "message": {}})), (4, "a", "{}"),
        (5, "b", json.dumps({"type": "event_msg", "payload": {"x": ["a"], "z": 1}})), (6, "b", json.dumps({"type": "event_msg", "payload": 3})),
        (7, "c", json.dumps({"odd": 1})), (8, "a", "not json"), (8, "a", None), (8, "a", ""), (8, "a", "[1]"), (None, "a", json.dumps({"type": 1})), (9, None, "{}"),
    ]
    df = spark.createDataFrame([(i, s, a, r, "clash", i) for i, (s, a, r) in enumerate(raws)], LINES)
    got = {tuple(r) for r in S.drift_report(df, catalogue).collect()}
    assert got == {(2, "version", "renamed"), (3, "version", "retyped"), (3, "extra", "added"), (4, "version", "removed"), (5, "payload.z", "added"), (6, "payload", "retyped"), (6, "payload.x", "removed"), (None, "type", "retyped")}
    whole = {r.line_id: r for r in S.one_table(df, catalogue).collect()}
    assert whole[5].version == "1.2.4" and whole[6].failed_casts == ["version"] and whole[7].failed_casts == ["version"] and whole[7].version is None
    assert whole[0].failed_casts == [] and whole[11].payload_x == '["a"]'
    assert S.drift_report(df.limit(0), catalogue).count() == 0 and S.drift_report(df, catalogue.limit(0)).count() == 0
