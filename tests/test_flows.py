"""Golden conversations, life cycle, identity and the sequential fold as an independent check."""

import math
import random

import pytest

from flowloom import fixed_values as fv
from flowloom.operators import flows as fl
from flowloom.operators import packets as pk

C, S = ("10.10.0.1", 51000), ("10.10.0.2", 8080)


def tcp(seq, ts, a, b, flags, payload=0, window=8192):
    return ((seq, ts, *a, *b), dict(flags=flags, payload=payload, window=window))


TCP_TALK = [
    tcp(1, 0, C, S, 2), tcp(2, 100_000, S, C, 18, window=65535), tcp(3, 200_000, C, S, 16), tcp(4, 300_000, C, S, 24, 100),
    tcp(5, 400_000, S, C, 24, 200, 65535), tcp(6, 500_000, C, S, 17), tcp(7, 600_000, S, C, 17, window=65535)]


def test_tcp_conversation(make_packets):
    rows = fl.assemble_flows(make_packets(TCP_TALK)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.state, r.close_reason, r.packet_count, r.half_open) == ("COMPLETED", "fin", 7, False)
    expected = dict(
        destination_port=8080, flow_duration=600000, total_fwd_packets=4, total_backward_packets=3, total_length_of_fwd_packets=100,
        total_length_of_bwd_packets=200, fwd_packet_length_max=100, fwd_packet_length_min=0, fwd_packet_length_mean=25,
        fwd_packet_length_std=math.sqrt(1875), bwd_packet_length_min=0, bwd_packet_length_std=math.sqrt(80000 / 9), flow_bytes_per_s=500,
        flow_packets_per_s=7 / 0.6, flow_iat_std=0, flow_iat_min=100000, fwd_iat_total=500000, fwd_iat_std=47140.4520791, fwd_iat_min=100000,
        bwd_iat_total=500000, bwd_iat_std=50000, bwd_iat_min=200000, fwd_header_length=160, bwd_header_length=120, bwd_packets_per_s=5,
        max_packet_length=200, packet_length_mean=300 / 7, packet_length_std=math.sqrt(1820000 / 343), fin_flag_count=1, psh_flag_count=1,
        ack_flag_count=1, urg_flag_count=0, down_up_ratio=0.75, init_win_bytes_forward=8192, init_win_bytes_backward=65535,
        act_data_pkt_fwd=1, min_seg_size_forward=20, active_mean=600000, idle_mean=0, idle_std=0)
    assert set(expected) == set(fv.FEATURE_COLUMNS)
    for name, value in expected.items():
        assert r[name] == pytest.approx(value, abs=1e-6), name


def test_udp_exchange(make_packets):
    a, b = ("10.20.0.1", 53000), ("10.20.0.2", 53)
    r = fl.assemble_flows(make_packets([
        ((1, 0, *a, *b), dict(payload=50, proto=17)), ((2, 50_000, *b, *a), dict(payload=100, proto=17))])).first()
    assert r.close_reason == "flush" and r.state == "COMPLETED"
    for name, value in dict(flow_bytes_per_s=3000, flow_packets_per_s=40, flow_iat_min=50000, fwd_header_length=28, bwd_header_length=28,
                            bwd_packets_per_s=20, max_packet_length=100, packet_length_mean=75, packet_length_std=25, down_up_ratio=1,
                            init_win_bytes_forward=0, min_seg_size_forward=0, active_mean=50000, idle_mean=0, fwd_packet_length_std=0).items():
        assert r[name] == pytest.approx(value), name


def test_life_cycle(make_packets):
    one = lambda rows, **kw: [(r.close_reason, r.packet_count) for r in fl.assemble_flows(make_packets(rows), **kw).orderBy("start_us").collect()]
    assert one([tcp(1, 0, C, S, 4)]) == [("rst", 1)]
    assert one([tcp(1, 0, C, S, 2), tcp(2, 1, C, S, 17)]) == [("flush", 2)]
    assert one([tcp(1, 0, C, S, 2), tcp(2, 1, C, S, 17), tcp(3, 2, S, C, 17)]) == [("fin", 3)]
    late_ack = [tcp(1, 0, C, S, 17), tcp(2, 1, S, C, 17), tcp(3, 2, C, S, 16)]
    assert one(late_ack) == [("fin", 2), ("flush", 1)]
    idle = [tcp(1, 0, C, S, 17), tcp(2, 120_000_000, C, S, 16), tcp(3, 240_000_001, C, S, 16)]
    assert one(idle, mode="live") == [("timeout", 2), ("timeout", 1)]
    half = [tcp(1, 0, C, S, 2), tcp(2, 5_000_000, C, S, 2), tcp(3, 10_000_001, C, S, 2)]
    assert one(half, mode="live") == [("timeout", 2), ("timeout", 1)]


def test_identity(make_packets):
    same = pk.with_flow_key(make_packets([tcp(1, 0, ("127.0.0.1", 50000), ("127.0.0.1", 443), 2), tcp(2, 1, ("127.0.0.1", 443), ("127.0.0.1", 50000), 18)]))
    assert {tuple(r) for r in same.select(*pk.KEY).collect()} == {("127.0.0.1", 443, "127.0.0.1", 50000, 6)}
    big = ("10.0.0.9", 51000), ("10.0.0.1", 80)
    r = fl.assemble_flows(make_packets([tcp(1, 0, big[0], big[1], 2, window=0), tcp(2, 1, big[1], big[0], 18, window=0), tcp(3, 2, *big, 16, window=4096)])).first()
    assert (r.dst_port, r.total_fwd_packets, r.total_backward_packets, r.init_win_bytes_forward, r.init_win_bytes_backward) == (80, 2, 1, 0, 0)


def test_active_and_idle(make_packets):
    r = fl.assemble_flows(make_packets([tcp(i, t, C, S, 16) for i, t in enumerate((0, 100_000, 1_500_000, 1_600_000))])).first()
    assert (r.active_mean, r.idle_mean, r.idle_std) == (100_000, 1_400_000, 0)


def test_flush_order(make_packets):
    rows = [tcp(i, i, (f"10.0.0.{n}", 1000), ("10.9.0.1", 80), 2) for i, n in enumerate((9, 1, 5))]
    assert [r.src_ip for r in fl.in_replay_order(fl.assemble_flows(make_packets(rows))).collect()] == ["10.0.0.1", "10.0.0.5", "10.0.0.9"]


def fold(rows, idle, half):
    """Packet at a time, as a check: [(first seq, packets, reason)]."""
    table, out = {}, []
    for (seq, ts, sip, sp, dip, dp), kw in rows:
        key = tuple(sorted([(sip, sp), (dip, dp)]))
        f = table.get(key)
        if f and idle is not None:
            gap = ts - f["last"]
            if gap > idle or (gap > half and f["sides"] == {f["init"]} and not f["fin"]):
                out.append((f["seq"], f["n"], "timeout"))
                f = None
        if f is None:
            f = table[key] = {"seq": seq, "n": 0, "init": (sip, sp), "sides": set(), "fin": set(), "last": ts}
        f["n"] += 1
        f["last"] = ts
        f["sides"].add((sip, sp))
        if kw["flags"] & 1:
            f["fin"].add((sip, sp))
        if kw["flags"] & 4 or len(f["fin"]) == 2:
            out.append((f["seq"], f["n"], "rst" if kw["flags"] & 4 else "fin"))
            del table[key]
    return sorted(out + [(f["seq"], f["n"], "timeout" if idle is not None else "flush") for f in table.values()])


def random_packets(seed, n=400):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 400_000, 1_000_000, 5_000_000, 5_000_001, 7_000_000, 120_000_000, 120_000_001])
        a, b = (C, S) if rng.random() < 0.6 else (S, C)
        rows.append(tcp(i, t, a, b, rng.choice([2, 16, 16, 24, 17, 17, 1, 4, 5] if seed % 2 else [2, 16, 16, 16, 17]), rng.randrange(50)))
    return rows


@pytest.mark.parametrize("mode", ["replay", "live"])
@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_sequential_fold(make_packets, mode, seed):
    rows = random_packets(seed)
    want = fold(rows, *((None, None) if mode == "replay" else (120_000_000, 5_000_000)))
    packets = make_packets(rows)
    plain = fl.assemble_flows(packets, mode)
    assert sorted((r.first_seq, r.packet_count, r.close_reason) for r in plain.collect()) == want
    # the same key cut into chunks: every value must be the same
    chunked = fl.assemble_flows(packets, mode, max_key_rows=37)
    show = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.drop("close_seq").collect())
    assert show(chunked) == show(plain)


def test_features_are_finite(make_packets):
    assert tuple(fl.feature_check(fl.assemble_flows(make_packets(random_packets(5)), "live")).first())[1] == 0
    assert len(fv.FEATURE_COLUMNS) == 40 and len(set(fv.LABELLED_COLUMNS)) == 75


def test_bursts_of_a_huge_flow(make_packets):
    seg = pk.segment_flows(make_packets(random_packets(2)))
    show = lambda d: sorted(map(tuple, d.select(*fl.FLOW_ID, "burst_no", "packets", "start_us", "end_us", "active_us").collect()))
    assert show(fl.active_bursts(seg, max_flow_rows=10)) == show(fl.active_bursts(seg))
