import json

import pytest

from callweave.operators import rollups as R
from callweave.operators.procedures import write_xdr
from callweave.sources import enrich, readers

XML = """<?xml version="1.0"?><traceCollecFile><traceRecSession><ue idType="IMSI" idValue="001010000000001"/>
<msg function="S1" name="Attach" changeTime="0.1"><initiator type="eNB">Address=10.0.0.1,Port=36412</initiator><target type="MME">Address=10.0.0.2,Fqdn=mme.example</target></msg>
<msg function="S1" name="Accept" changeTime="0.2"><initiator type="MME">Address=10.0.0.2</initiator><target type="eNB">Address=10.0.0.1</target></msg></traceRecSession></traceCollecFile>"""


def test_trace_xml_and_sidecar(spark, tmp_path):
    (tmp_path / "cap.xml").write_text(XML)
    trace = readers.read_trace_xml(spark, str(tmp_path / "cap.xml"))
    rows = trace.orderBy("ordinal").collect()
    assert [(r.ordinal, r.name, r.initiator_type, r.initiator_address, r.initiator_port, r.target_fqdn, r.id_value) for r in rows] == [(1, "Attach", "eNB", "10.0.0.1", 36412, "mme.example", "001010000000001"), (2, "Accept", "MME", "10.0.0.2", None, None, "001010000000001")]
    end = "struct<ip:string,port:int,host:string,role:string,lane:string>"
    some = lambda n: spark.createDataFrame([("cap.xml", k + 1, (None,) * 5, (None,) * 5, []) for k in range(n)], f"capture_id string, frame long, src {end}, dst {end}, keys array<struct<kind:string,value:string>>")
    got = enrich.sidecar(some(2), trace).orderBy("frame").collect()
    assert [(r.src.role, r.dst.host, [k.value for k in r.keys]) for r in got] == [("eNB", "mme.example", ["001010000000001"]), ("MME", None, ["001010000000001"])]
    assert all(r.src.role is None and r.keys == [] for r in enrich.sidecar(some(3), trace).collect())


def test_dimensions_are_checked(spark, tmp_path):
    cause = {"table": "t", "value": 1, "name": "One", "outcome": None}
    path = tmp_path / "causes.json"
    path.write_text(json.dumps(cause) + "\n" + json.dumps({**cause, "value": 2, "outcome": "user"}))
    causes = readers.load_causes(spark, str(path))
    assert causes.count() == 2
    path.write_text(json.dumps(cause) + "\n" + json.dumps(cause))
    with pytest.raises(ValueError, match="twice"):
        readers.load_causes(spark, str(path))
    rules = spark.createDataFrame([("t", [1, 2], "says")], "table string, values array<int>, says string")
    assert readers.check_sequences(rules, spark.createDataFrame([("t", 1), ("t", 2)], "table string, value int")).count() == 1
    with pytest.raises(ValueError, match="without a cause"):
        readers.check_sequences(rules, spark.createDataFrame([("t", 1)], "table string, value int"))
    (tmp_path / "nodes.json").write_text(json.dumps({"10.0.0.1": "amf-1"}))
    assert [tuple(r) for r in readers.load_node_map(spark, str(tmp_path / "nodes.json")).collect()] == [("10.0.0.1", "amf-1")]


def test_a_user_outcome_is_no_failure(spark):
    rows = spark.createDataFrame([(("t", 1), True), (("t", 2), True), (("t", 9), True), (None, True)], "cause struct<table:string,value:int>, is_failure boolean")
    dim = spark.createDataFrame([("t", 1, "One", None), ("t", 2, "Two", "user")], "table string, value int, name string, outcome string")
    got = {(r.cause.value if r.cause else None): (r.cause_name, r.is_failure) for r in R.with_causes(rows, dim).collect()}
    assert got == {1: ("One", True), 2: ("Two", False), 9: ("not catalogued", True), None: (None, True)}


def test_packets_and_records(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"capture_id": "c", "number": 1, "udp_port": [5, 6], "esp_spi": "0xff"}) + "\n" + json.dumps({"capture_id": "c", "number": 2}))
    got = {r.number: (r.src_port, r.dst_port, r.esp_spi) for r in readers.read_packets(spark, str(tmp_path / "p.json")).collect()}
    assert got == {1: (5, 6, 255), 2: (None, None, None)}
    rows = spark.createDataFrame([("c", 2, "s", 1, 0, 0), ("c", 1, "s", 2, 0, 0)], "capture_id string, start_frame long, supi string, segment long, first_pos int, last_pos int")
    write_xdr(rows, spark.createDataFrame([("c", 2)], "capture_id string, messages long"), str(tmp_path / "xdr"))
    assert [r.start_frame for r in spark.read.parquet(str(tmp_path / "xdr/records")).collect()] == [1, 2]
