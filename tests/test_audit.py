"""Checks of histories against plain readings of their rules, on random histories with missing evidence."""

import itertools
import random

from gaugeworks.operators import audit as A

SCHEMA = "history_id string, idx int, op string, status string, client string, node string, key string, version int, write_id string, seq long, depends_on struct<key:string,min_version:int,write_id:string>, order array<string>, evidence_source string, mock boolean, local_observation boolean, control_id string, cause_key string, cause_version int, cause_write_id string"
NAMES = [c.strip().split()[0] for c in SCHEMA.replace("struct<key:string,min_version:int,write_id:string>", "x").split(",")]


def random_history(rnd):
    out, ids = [], []
    for i in range(rnd.randint(0, 14)):
        e = dict.fromkeys(NAMES) | {"idx": i, "op": rnd.choice(["read", "write", "write"]), "status": rnd.choice(["ok"] * 9 + ["timeout"]), "client": rnd.choice(["a", "b", "a", "b", None]), "node": rnd.choice(["N1", "N2"]), "key": rnd.choice("xy"), "version": rnd.choice([0, 1, 2, 3, None]), "mock": rnd.choice([True, True, True, None])}
        if e["op"] == "write":
            e |= {"write_id": rnd.choice([f"w{i}", f"w{i}", ""]), "seq": rnd.choice([i, i, i, i - 3, None])}
            if rnd.random() < 0.6 and out:
                p = rnd.choice(out)
                e["depends_on"] = (p["key"], p["version"], rnd.choice([None, "", p["write_id"], "none"]))
            ids.append(e["write_id"])
        out.append(e)
    kind = rnd.randrange(3)
    i = len(out)
    if kind == 0:
        for e in [e for e in out if e["depends_on"] and rnd.random() < 0.9]:
            key, version, write_id = e["depends_on"]
            shown = version if version is None or rnd.random() < 0.8 else version - 1
            cause = [p["write_id"] for p in out if p["key"] == key and p["version"] == version]
            out.append(dict.fromkeys(NAMES) | {"idx": i, "op": "dependency_probe", "status": rnd.choice(["ok"] * 9 + ["timeout"]), "node": rnd.choice(["N1"] * 9 + [None, ""]), "key": e["key"], "version": e["version"], "write_id": e["write_id"], "local_observation": rnd.choice([True] * 9 + [False, None]), "control_id": rnd.choice(["1"] * 9 + [None, "0"]), "cause_key": key, "cause_version": shown, "cause_write_id": rnd.choice(cause[-1:] or [None])})
            i += 1
    if kind == 1:
        for _ in range(rnd.randint(0, 2)):
            order = rnd.sample(ids, len(ids)) if rnd.random() < 0.3 else list(ids)
            out.append(dict.fromkeys(NAMES) | {"idx": i, "op": "audit_order", "status": "ok", "order": order[rnd.choice([0, 0, 0, 1]) :] + ["unknown"], "evidence_source": rnd.choice(["synthetic_application_order"] * 4 + ["other"])})
            i += 1
    return out


def pairs_rule(h, first):
    """Every ok read with the operation of kind `first` that it is held against."""
    use = [e for e in h if e["status"] == "ok" and None not in (e["client"], e["key"], e["version"])]
    found, any_pair = [], False
    for r in (e for e in use if e["op"] == "read"):
        before = [e for e in use if e["op"] == first and e["idx"] < r["idx"] and (e["client"], e["key"]) == (r["client"], r["key"])]
        if before:
            any_pair = True
            w = max(before, key=lambda e: (e["version"], -e["idx"])) if first == "write" else before[-1]
            if r["version"] < w["version"]:
                found.append([w["idx"], r["idx"]])
    return (min(found, key=lambda x: x[1]) if found else None), any_pair


def candidates_rule(h, kind):
    out = []
    for e in h:
        if e["op"] == "write" and e["status"] == "ok" and e["depends_on"]:
            key, version, write_id = e["depends_on"]
            causes = [p for p in h if p["idx"] < e["idx"] and p["op"] == kind and p["status"] == "ok" and p["client"] == e["client"] and p["key"] == key and p["version"] is not None and p["version"] == version and (not write_id or p["write_id"] == write_id)]
            if causes:
                out.append((e, causes[-1]))
    return out


def probes_rule(h, candidates):
    bad, covered = [], set()
    for p, (e, c) in itertools.product(h, candidates):
        if p["op"] == "dependency_probe" and p["status"] == "ok" and p["node"] and p["local_observation"] and p["control_id"] not in (None, "", "0"):
            if p["idx"] > e["idx"] and e["write_id"] and [p[k] for k in ("key", "version", "write_id")] == [e[k] for k in ("key", "version", "write_id")] and p["cause_key"] == c["key"] and p["cause_version"] is not None:
                if p["cause_version"] < c["version"]:
                    bad.append((p["idx"], e["idx"], c["idx"]))
                elif p["cause_write_id"] == c["write_id"]:
                    covered.add(e["idx"])
    return (list(reversed(min(bad))) if bad else None), bool(candidates) and covered == {e["idx"] for e, _ in candidates}


def order_rule(h):
    writes = {e["write_id"]: e for e in h if e["op"] == "write" and e["status"] == "ok" and e["write_id"] and e["seq"] is not None}
    complete = False
    for a in (e for e in h if e["op"] == "audit_order" and e["evidence_source"] == "synthetic_application_order"):
        if len(writes) >= 2 and set(writes) <= set(a["order"]):
            complete = True
            shown = [writes[w] for w in a["order"] if w in writes]
            for i, w in enumerate(shown):
                own = [v for v in shown[:i] if v["client"] == w["client"]]
                if own and w["seq"] < own[-1]["seq"]:
                    return [own[-1]["idx"], w["idx"], a["idx"]], True
    return None, complete


def observers_rule(h, candidates):
    reads = [e for e in h if e["op"] == "read" and e["status"] == "ok" and e["mock"] is not None]
    bad, covered = [], set()
    for (e, c), s, r in itertools.product(candidates, reads, reads):
        if e["idx"] < s["idx"] < r["idx"] and (s["key"], s["version"]) == (e["key"], e["version"]) and (r["client"], r["node"], r["key"]) == (s["client"], s["node"], c["key"]) and r["version"] is not None:
            covered.add(e["idx"])
            if r["version"] < c["version"]:
                bad.append((e["idx"], s["idx"], r["idx"], c["idx"]))
    if bad:
        e, s, r, c = min(bad)
        return [c, e, s, r], True
    return None, bool(candidates) and covered == {e["idx"] for e, _ in candidates}


def rules(h):
    probed = any(e["op"] == "dependency_probe" for e in h)
    mw, wfr = candidates_rule(h, "write"), candidates_rule(h, "read")
    return {
        "read_your_writes": pairs_rule(h, "write"),
        "monotonic_reads": pairs_rule(h, "read"),
        "monotonic_writes": probes_rule(h, mw) if probed else order_rule(h),
        "writes_follow_reads": probes_rule(h, wfr) if probed else observers_rule(h, wfr),
    }


def test_verdicts_need_evidence(spark):
    rnd = random.Random(5)
    histories = {f"h{i}": random_history(rnd) for i in range(400)}
    rows = [tuple({**e, "history_id": h}[c] for c in NAMES) for h, es in histories.items() for e in es]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    seen = set()
    for name, check in A.CHECKS.items():
        got = {r.history_id: (r.status, r.witness) for r in A.verdict(df, check(df)).collect()}
        want = {}
        for h, es in histories.items():
            if es:
                witness, complete = rules(es)[name]
                failed = any(e["status"] != "ok" and e["op"] in A.REQUIRED for e in es)
                want[h] = ("VIOLATION" if witness else "INCONCLUSIVE" if failed or not complete else "PASS", witness)
        assert got == want, name
        seen |= {(name, s) for s, _ in want.values()}
    assert len(seen) == 12  # all statuses of all checks


def test_nothing_compared_is_no_pass(spark):
    rows = [("h", 0, "write", "ok", "a", "x", 1), ("h", 1, "read", "ok", "b", "x", 0), ("none", 0, "stop", "ok", None, None, None)]
    df = spark.createDataFrame(rows, "history_id string, idx int, op string, status string, client string, key string, version int")  # no column of EVIDENCE
    for check in A.CHECKS.values():
        assert {r.history_id: r.status for r in A.verdict(df, check(df)).collect()} == {"h": "INCONCLUSIVE", "none": "INCONCLUSIVE"}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    for check in A.CHECKS.values():
        assert A.verdict(df, check(df)).collect() == []


def test_failed_partition_leaves_no_verdict(spark):
    rows = [("h", 0, "read", "ok", "a", "x", 1), ("h", 1, "read", "ok", "a", "x", 1), ("h", 2, "stop", "failed", None, None, None), ("g", 0, "read", "ok", "a", "x", 1), ("g", 1, "read", "ok", "a", "x", 1), ("g", 2, "note", "failed", None, None, None)]
    df = spark.createDataFrame(rows, "history_id string, idx int, op string, status string, client string, key string, version int")
    assert {r.history_id: r.status for r in A.verdict(df, A.monotonic_reads(df)).collect()} == {"h": "INCONCLUSIVE", "g": "PASS"}
