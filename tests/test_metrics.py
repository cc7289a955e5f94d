"""Metrics of hand-made audit rows with known results."""

from collections import Counter

import pytest

from sparkguard.operators import metrics as M
from sparkguard.operators import turns as T
from sparkguard.schemas import AUDIT
from sparkguard.sources import audit as A

DAY = "2026-10-03T"
_NAMES = ("permissions", "signatures", "pii_secrets", "jev", "loop_detection")
_PLACES = ("input", "output", "tool_result", "tool_call")
_ACTIONS = ("allow", "allow", "redact", "allow", "flag", "allow", "block")


def _made(i: int) -> tuple:
    """Row i: request, caller, time, checkpoint, check, action, latency, decided_by, tokens, cost, policy; every sixth is a system event."""
    time, policy = f"09:{i // 9:02d}:{i * 7 % 60:02d}", "p" + str(i // 30)
    if i % 6 == 5:
        return (f"q{i // 4}" if i % 4 else None, None, time, None if i % 12 == 5 else "input", ("policy_loaded", "upstream_unavailable")[i % 12 > 5], ("allow", "block")[i % 12 > 5], 0.5, "rules", 0, 0.0, policy)
    check = _NAMES[i % 5]
    reply = i % 4 in (1, 3)
    return (f"q{i // 4}", f"team-{i // 4 % 3}" if i // 4 % 7 else None, time, _PLACES[i % 4], check, _ACTIONS[i % 7], (i * 37 % 101) / 4, ("jev", "fallback")[i % 3 == 0] if check == "jev" else "rules", i * 10 if reply else 0, i / 8 if reply else 0.0, policy)


CHECKS = [_made(i) for i in range(60)]
TURNS = [  # request, caller, ts, checkpoint, action, conversation, overhead, calls, tools, prompt, completion, cost, upstream, model
    ("w1", "ops", DAY + "07:00:00", "input", "flag", "day-1", 5.0, None, None, None, None, 0.0, None, "small"),
    ("w1", "ops", DAY + "07:00:03", "tool_call", "allow", "day-1", 2.0, 3, "find_parts,find_parts,send_mail", 50, 25, 0.125, 40.0, "small"),
    ("w2", "ops", DAY + "07:10:00", "tool_result", "allow", "day-1", 7.0, None, None, None, None, 0.0, None, "small"),
    ("w2", "ops", DAY + "07:10:04", "output", "redact", "other", 4.0, 0, None, 70, 5, 0.375, 60.0, "small"),
    ("w3", "ops", DAY + "08:00:00", "input", "block", "day-2", 9.0, None, None, None, None, 0.0, None, "small"),
    ("w4", "ops", DAY + "08:30:00", "input", "allow", "day-3", 3.0, None, None, None, None, 0.0, None, "large"),
    ("w4", "ops", DAY + "08:30:09", "tool_call", "block", "day-3", 1.0, 1, "send_mail", 200, 100, 2.0, 80.0, "large"),
    ("w5", "lab", "2026-10-01T22:00:00", "input", "allow", "night", 1.0, None, None, None, None, 0.0, None, "large"),
    ("w5", "lab", "2026-10-01T22:00:09", "output", "allow", "night", 6.0, 0, None, 300, 30, 3.0, 500.0, "large"),
]


def frame(spark, dicts):
    names = [f.name for f in AUDIT]
    return A.derive(spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], AUDIT))


@pytest.fixture(scope="module")
def checks(spark):
    names = ("request_id", "caller_id", "ts", "checkpoint", "check", "action", "latency_ms", "decided_by", "tokens", "cost", "policy_version")
    return frame(spark, [dict(zip(names, r, strict=True), ts=DAY + r[2] + "Z", id=i, reason="x", score=0.0) for i, r in enumerate(CHECKS)]).cache()


@pytest.fixture(scope="module")
def turn(spark):
    names = ("request_id", "caller_id", "ts", "checkpoint", "action", "conversation_id", "overhead_ms", "tool_calls", "tools", "prompt_tokens", "completion_tokens", "cost", "upstream_latency_ms", "model")
    rows = [dict(zip(names, r, strict=True), id=i, check="turn_summary", reason="", score=0.0, latency_ms=0.0, decided_by="rules", tokens=(r[9] or 0) + (r[10] or 0), policy_version="1") for i, r in enumerate(TURNS)]
    return frame(spark, rows).cache()


STRENGTH = {"allow": 0, "flag": 1, "redact": 2, "block": 3}


def scanned(since: str = "") -> list[tuple]:
    """The check rows: those of a checkpoint that aren't system events."""
    return [r for r in CHECKS if r[3] and r[4] in _NAMES and r[2] >= since]


def by_request(value, rows) -> dict:
    out: dict = {}
    for r in rows:
        if r[0]:
            out.setdefault(r[0], []).append(value(r))
    return out


def nearest(values: list[float], p: int) -> float:
    return sorted(values)[-(-p * len(values) // 100) - 1]


def test_totals_and_timeline(checks):
    r = M.requests(checks)
    strongest = {k: max(v) for k, v in by_request(lambda r: STRENGTH[r[5]], scanned()).items()}
    count = Counter(strongest.values())
    assert M.totals(r).first().asDict() == {"requests": len(strongest), "allowed": count[0], "redacted": count[2], "blocked": count[3], "flagged": count[1]} and min(count.values()) > 0
    minute = {k: min(v)[:5] for k, v in by_request(lambda r: r[2], scanned()).items()}
    want = {m: [0, 0, 0, 0] for m in minute.values()}
    for k, m in minute.items():
        want[m][0] += 1
        if strongest[k]:
            want[m][{3: 1, 2: 2, 1: 3}[strongest[k]]] += 1
    assert [tuple(x) for x in M.timeline(r).orderBy("minute").collect()] == [(f"{DAY}{m}:00Z", *n) for m, n in sorted(want.items())]
    every = [sum(v) for v in by_request(lambda r: r[6], scanned()).values()]
    rules = [sum(v) for v in by_request(lambda r: r[6] if r[4] != "jev" else 0.0, scanned()).values()]
    assert tuple(M.overhead(r).first()) == pytest.approx((nearest(every, 50), nearest(every, 95), nearest(rules, 50), nearest(rules, 95)))


def test_counts(checks):
    judged = [r[6] for r in scanned() if r[4] == "jev"]
    assert tuple(M.judge_latency(checks).first()) == (nearest(judged, 50), nearest(judged, 95))
    assert {x.decided_by: x.rows for x in M.decided_by(checks).collect()} == Counter(r[7] for r in scanned())
    assert {x.check: x.rows for x in M.system_events(checks).collect()} == Counter(r[4] for r in CHECKS if r[4] not in _NAMES)
    assert {x.policy_version: x.rows for x in M.policy_versions(checks).collect()} == Counter(r[10] for r in CHECKS)


def test_usage(checks):
    usage = M.usage_rows(checks)
    most = by_request(lambda r: (r[8], r[9], r[1]), CHECKS)
    rows = [max(v, key=lambda x: x[:2]) for v in most.values()]
    assert tuple(M.usage_total(usage).first()) == pytest.approx((sum(r[0] for r in rows), sum(r[1] for r in rows)))
    got = {x.caller_id: (x.tokens_today, x.cost_today) for x in M.usage_today(usage, DAY[:10]).collect()}
    assert got == {c: (sum(r[0] for r in rows if r[2] == c), pytest.approx(sum(r[1] for r in rows if r[2] == c))) for c in {r[2] for r in rows} if c}
    late = M.since(checks, DAY + "09:04:00Z")
    assert M.totals(M.requests(late)).first().requests == len(by_request(lambda r: 1, scanned("09:04")))


@pytest.mark.parametrize(("values", "want"), [([7.0], (7.0, 7.0)), ([3.0, 1.0], (1.0, 3.0)), ([float(i) for i in range(1, 21)], (10.0, 19.0)), ([], (0.0, 0.0)), ([-5.0, 0.0, 3.0], (0.0, 3.0)), ([-5.0, -0.5, -0.25, -1e-300], (-0.5, -1e-300)), ([float("inf"), 1.0, float("-inf")], (1.0, float("inf"))), ([1e308, 1e-320, 4.0], (4.0, 1e308))])
def test_percentiles(spark, values, want):
    assert tuple(M.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), {"v": "v"}).first()) == want


def test_percentiles_of_long_tails(spark):
    """Few chunks, a value that is most of the rows, a long tail, nulls: as by sorting."""
    rows = [(k, None if i % 17 == 0 else 5.0 if i % 3 else float(i**4 % 9973) ** 3, -float(i)) for k in ("a", "b") for i in range(400 if k == "a" else 7)]
    got = M.percentiles(spark.createDataFrame(rows, "k string, v double, w double"), {"v": "v", "x": "w"}, ("k",), 4)
    for r in got.collect():
        v, w = ([x for x in c if x is not None] for c in ([r_[1] for r_ in rows if r_[0] == r.k], [r_[2] for r_ in rows if r_[0] == r.k]))
        assert tuple(r)[1:] == (nearest(v, 50), nearest(v, 95), nearest(w, 50), nearest(w, 95))


def test_agents(turn):
    a = {r.caller_id: r for r in T.agents(T.turns(turn)).collect()}["ops"]
    # w1 and w2 share a session, as a turn's session is that of its first request row
    assert (a.sessions, a.turns, a.max_steps, a.tool_calls, a.block_rate, a.tokens, a.cost) == (3, 4, 2, 4, 0.5, 450, 2.5)
    assert (a.avg_upstream_latency_ms, a.avg_overhead_ms, round(a.overhead_share, 6)) == (60.0, 7.75, round(22 / 202, 6))
    assert {(r.caller_id, r.tool): r.calls for r in T.tool_usage(T.turns(turn)).collect()} == {("ops", "find_parts"): 2, ("ops", "send_mail"): 2}


def test_economics_and_latency(turn):
    t = T.turns(turn)
    assert tuple(T.session_cost(t).first()) == (0.5, 3.0, 1.375)
    assert T.blocked_before_upstream(turn).first()[0] == 1
    r = T.request_latency(t).first()
    assert (r.pre_ms_p50, r.pre_ms_p95, r.upstream_ms_p50, r.upstream_ms_p95, r.post_ms_p50, r.post_ms_p95, r.total_ms_p50, r.total_ms_p95) == (5, 9, 60, 500, 2, 6, 71, 507)


def test_derived_columns(spark):
    base = dict(id=1, check="jev", action="allow", reason="risk 0.9 [exfiltration, other]", score=0.0, latency_ms=0.0, decided_by="jev", tokens=0, cost=0.0, policy_version="1", checkpoint="input")
    rows = frame(spark, [{**base, "ts": "2026-10-03T09:05:59+02:00"}, {**base, "ts": "2026-10-03T23:10:00", "check": "signatures", "reason": "signature X-1 (code_execution): y"}, {**base, "ts": "2026-10-03T00:00:00Z", "check": "budget"}]).collect()
    assert [(r.hour, r.category) for r in rows] == [(7, "exfiltration"), (23, "code_execution"), (0, None)]
    assert rows[0].minute == "2026-10-03T07:05:00Z"


def test_read_back(spark, tmp_path, checks):
    text = "\n".join(checks.select(*[f.name for f in AUDIT]).toJSON().collect())
    (tmp_path / "audit-2026-10-03.jsonl").write_text(text + '\n\n{"id": 99, "torn\n{"id": 98, "ts": "bad"}\n')
    (tmp_path / "audit-2026-10-01.jsonl").write_text("not json\n")
    assert A.read_audit(spark, str(tmp_path)).count() == len(CHECKS)
    assert A.read_audit(spark, str(tmp_path), DAY + "09:04:00Z").count() == sum(r[2] >= "09:04" for r in CHECKS)
    assert A.read_audit(spark, str(tmp_path / "none")).count() == 0
    A.write_audit(checks, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(CHECKS)
    A.export_csv(checks, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[-1] == "category"
