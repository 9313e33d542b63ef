"""Packets of tunnels that many sessions share."""

from callweave.operators import records
from tests.test_assembled_calls import rows_of_joins


def test_sessions_meet_counts_not_packets(spark):
    one = "struct<value:string>"
    held = [("c", f"s{n}", "1", ("a",), (str(n % 2),), ("gnb",) if n % 3 else None) for n in range(60)] + [("c", "s0", "1", ("a",), ("0",), None), ("c", "x", "1", ("b",), ("0",), None)]
    sessions = spark.createDataFrame(held, f"capture_id string, supi string, pdu_id string, gtp_address {one}, gtp_teid {one}, gtp_teid_owner {one}")
    packets = [("c", ("a",), {"teid": "0"})] * 40 + [("c", ("a",), {"teid": "1"})] * 7 + [("c", ("a",), {}), ("d", ("a",), {"teid": "0"})]
    gtp = spark.createDataFrame(packets, "capture_id string, dst struct<ip:string>, detail map<string,string>")
    rows, most = rows_of_joins(records.tunnel_packets(sessions, gtp))
    # The session stated twice has its packets twice.
    want = {(f"s{n}", "gnb" if n % 3 else "upf"): (7 if n % 2 else 40) * (1 + (n == 0)) for n in range(60)}
    assert {(x.supi, x.side): x.packets for x in rows} == want and most <= len(held)
