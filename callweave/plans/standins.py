"""The test tables read as signalling tables: events as messages, orders and lineitem as requests and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROTOCOLS = ("ngap", "nas-5gs", "pfcp", "diameter", "sip")
#: A few causes by public name, so that joins have hits and misses. Values that aren't listed stay uncatalogued.
CAUSES = (
    ("nas_5gmm", 3, "Illegal UE", None), ("nas_5gmm", 5, "PEI not accepted", None), ("nas_5gmm", 6, "Illegal ME", None), ("nas_5gmm", 7, "5GS services not allowed", None),
    ("nas_5gmm", 9, "UE identity cannot be derived by the network", None), ("nas_5gmm", 10, "Implicitly de-registered", None), ("nas_5gmm", 11, "PLMN not allowed", None), ("nas_5gmm", 12, "Tracking area not allowed", None),
    ("nas_5gmm", 13, "Roaming not allowed in this tracking area", None), ("nas_5gmm", 15, "No suitable cells in tracking area", None), ("nas_5gmm", 20, "MAC failure", None), ("nas_5gmm", 21, "Synch failure", None),
    ("nas_5gmm", 22, "Congestion", None), ("nas_5gmm", 27, "N1 mode not allowed", None), ("nas_5gmm", 65, "Maximum number of PDU sessions reached", None), ("nas_5gmm", 90, "Payload was not forwarded", "user"),
    ("nas_5gmm", 91, "DNN not supported or not subscribed in the slice", None), ("nas_5gmm", 95, "Semantically incorrect message", None), ("nas_5gmm", 96, "Invalid mandatory information", None), ("nas_5gmm", 98, "Message type not compatible with the protocol state", None),
)
#: The same view in SQL, for oracles.
SQL = """with raw as (
  select event_id, user_id, event_type, ts as event_time, epoch_us(ts) / 1e6 as ts, cast(json_extract_string(props, '$.k') as int) as k from events
), m as (
  select 'cap' || (user_id % 3) as capture_id, event_id as frame, 0 as seq, ts, event_time, user_id, k,
    (['ngap','nas-5gs','pfcp','diameter','sip'])[k % 5 + 1] as protocol, event_type as label,
    '10.0.' || (user_id % 7) || '.' || user_id as src_ip, '10.9.0.' || (k % 10) as dst_ip, cast(user_id as varchar) as flow_id,
    event_type = 'error' as is_failure, case when k % 3 = 0 then '00101' || lpad(cast(user_id as varchar), 10, '0') end as supi,
    case when k >= 95 then cast(floor(ts / 3600) as bigint) || '-' || k end as seid,
    (user_id % 20) || '-' || k as e2e, case when k % 4 > 0 then cast(k % 7 as varchar) end as tac, case when k % 5 > 0 then 'dnn' || (k % 3) end as dnn
  from raw
), causes(value, name, outcome) as (values {causes}) """.replace("{causes}", ", ".join(f"({v}, '{n}', {'null' if o is None else repr(o)})" for _, v, n, o in CAUSES))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the messages table, with flow_id = user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user, k = F.col("user_id").cast("string"), F.col("k")
    end = lambda ip: F.struct(ip.alias("ip"), F.lit(None).cast("int").alias("port"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("lane"))
    key = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    ts = F.unix_micros(F.col("ts")) / 1e6
    none = F.array().cast("array<struct<kind:string,value:string>>")
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    return e.select(
        F.concat(F.lit("cap"), F.col("user_id") % 3).alias("capture_id"), F.col("event_id").alias("frame"), F.lit(0).alias("seq"), ts.alias("ts"), F.col("ts").alias("event_time"),
        F.element_at(F.array(*map(F.lit, PROTOCOLS)), k % 5 + 1).alias("protocol"), F.col("event_type").alias("label"), end(F.concat_ws(".", F.lit("10.0"), F.col("user_id") % 7, "user_id")).alias("src"), end(F.concat(F.lit("10.9.0."), k % 10)).alias("dst"),
        F.array_compact(F.array(key("supi", F.when(k % 3 == 0, F.concat(F.lit("00101"), F.lpad(user, 10, "0")))), key("amf_ue_ngap_id", F.concat_ws("/", F.lit("cap"), user)), key("pfcp_seid", F.when(k >= 95, F.concat_ws("-", F.floor(ts / 3600), k))))).alias("keys"),
        none.alias("releases"), F.array().cast("array<struct<kind:string,value:string,looks:string>>").alias("quotes"), F.when(F.col("event_type") == "error", F.struct(F.lit("nas_5gmm").alias("table"), k.alias("value"))).alias("cause"), (F.col("event_type") == "error").alias("is_failure"),
        F.map_from_entries(F.array_compact(F.array(entry("seqno", k.cast("string")), entry("end-to-end-id", F.concat_ws("-", F.col("user_id") % 20, k)), entry("tac", F.when(k % 4 > 0, (k % 7).cast("string"))), entry("dnn", F.when(k % 5 > 0, F.concat(F.lit("dnn"), (k % 3).cast("string"))))))).alias("detail"),
        user.alias("flow_id"),
    )


def causes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAUSES, "table string, value int, name string, outcome string")
