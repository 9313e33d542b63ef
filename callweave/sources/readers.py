"""Sources: dissected frames, packet index, trace XML, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def get(path: str, kind: str = "string", of: str = "layers") -> Column:
    """A field of the layers; the first element where it is a list."""
    return F.coalesce(F.try_variant_get(of, f"$.{path}[0]", kind), F.try_variant_get(of, f"$.{path}", kind))


def frame_rows(lines: DataFrame) -> DataFrame:
    """value, capture_id -> capture_id, frame, abs_ts, layers: rows with a frame number; row by row, so a stream will do."""
    held = lines.select("capture_id", F.try_parse_json("value").alias("v")).where("v is not null")
    number = F.coalesce(F.try_variant_get("v", "$.layers.frame.frame_frame_number[0]", "string"), F.try_variant_get("v", "$.layers.frame.frame_frame_number", "string")).try_cast("long")
    stamp = F.try_variant_get("v", "$.timestamp", "string").try_cast("double") / 1000
    return held.select("capture_id", number.alias("frame"), stamp.alias("abs_ts"), F.try_variant_get("v", "$.layers", "variant").alias("layers")).where("frame is not null")


def parse_frames(lines: DataFrame) -> DataFrame:
    """value, capture_id -> frames: rows with a frame number; blank, malformed and index-only lines are left out.

    abs_ts is the timestamp in seconds (null: no clock); ts counts from the
    capture's first kept frame.
    """
    rows = frame_rows(lines)
    base = rows.groupBy("capture_id").agg(F.min_by("abs_ts", F.when(F.col("abs_ts").isNotNull(), F.col("frame"))).alias("base"))
    return rows.join(base, "capture_id").withColumn("ts", F.round(F.col("abs_ts") - F.col("base"), 6)).drop("base")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("capture_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return with_endpoints(parse_frames(lines))


def bad_lines(lines: DataFrame) -> DataFrame:
    """Per capture: lines that are no frame, by reason."""
    v = F.try_parse_json("value")
    reason = F.when(F.trim("value") == "", "blank").when(v.isNull(), "malformed").when(F.try_variant_get(v, "$.index", "variant").isNotNull(), "index").when(F.coalesce(F.try_variant_get(v, "$.layers.frame.frame_frame_number[0]", "string"), F.try_variant_get(v, "$.layers.frame.frame_frame_number", "string")).isNull(), "no frame number")
    return lines.select("capture_id", reason.alias("reason")).where("reason is not null").groupBy("capture_id", "reason").agg(F.count("*").alias("n"))


def with_endpoints(frames: DataFrame) -> DataFrame:
    """Addresses (IPv4, IPv6, exported PDU), ports (SCTP, TCP, UDP, exported), TCP stream."""
    ports = lambda d: F.coalesce(get(f"sctp.sctp_sctp_{d}port"), get(f"tcp.tcp_tcp_{d}port"), get(f"udp.udp_udp_{d}port"), get(f"exported_pdu.exported_pdu_exported_pdu_{d}_port")).try_cast("int")
    ip = lambda d, e: F.coalesce(get(f"ip.ip_ip_{d}"), get(f"ipv6.ipv6_ipv6_{d}"), get(f"exported_pdu.exported_pdu_exported_pdu_ipv4_{e}"), get(f"exported_pdu.exported_pdu_exported_pdu_ipv6_{e}"))
    return frames.withColumns({"src_ip": ip("src", "src"), "dst_ip": ip("dst", "dst"), "src_port": ports("src"), "dst_port": ports("dst"), "stream": get("tcp.tcp_tcp_stream").try_cast("long")})


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """The packet index: JSON rows of the columns below; ports are the first of TCP, UDP, SCTP."""
    schema = "capture_id string, number long, time_rel double, time_epoch double, src string, dst string, tcp_port array<int>, udp_port array<int>, sctp_port array<int>, protocol string, length int, info string, protocols string, reassembled_in long, fragments array<long>, esp_spi string"
    rows = spark.read.schema(schema).json(path)
    port = lambda n: F.coalesce(F.get("tcp_port", F.lit(n)), F.get("udp_port", F.lit(n)), F.get("sctp_port", F.lit(n)))
    return rows.withColumns({"src_port": port(0), "dst_port": port(1), "esp_spi": F.conv(F.regexp_replace("esp_spi", "^0x", ""), 16, 10).try_cast("long")}).drop("tcp_port", "udp_port", "sctp_port")


def read_trace_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per msg of a trace: ordinal, function, name, ends with address, port and type, and the subscriber around it."""
    end = "struct<_type:string,_VALUE:string>"
    schema = f"ue struct<_idType:string,_idValue:string>, msg array<struct<_function:string,_name:string,_changeTime:string,initiator:{end},target:{end}>>"
    rows = spark.read.format("xml").option("rowTag", "traceRecSession").schema(schema).load(path).withColumn("capture_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).withColumn("__at", F.monotonically_increasing_id())
    each = rows.select("capture_id", "__at", "ue", F.posexplode("msg").alias("i", "m"))
    part = lambda e, n: F.nullif(F.regexp_extract(f"m.{e}._VALUE", rf"{n}=([^,;\s]+)", 1), F.lit(""))
    ends = [c for e in ("initiator", "target") for c in (F.col(f"m.{e}._type").alias(f"{e}_type"), part(e, "Address").alias(f"{e}_address"), part(e, "Port").try_cast("int").alias(f"{e}_port"), part(e, "Fqdn").alias(f"{e}_fqdn"))]
    ordinal = F.row_number().over(Window.partitionBy("capture_id").orderBy("__at", "i"))
    return each.select("capture_id", ordinal.alias("ordinal"), F.col("m._function").alias("function"), F.col("m._name").alias("name"), *ends, F.col("ue._idType").alias("id_type"), F.col("ue._idValue").alias("id_value"))


def _refuse(bad: DataFrame, what: str) -> None:
    found = bad.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {found}")


def check_causes(dim: DataFrame) -> DataFrame:
    """(table, value) is unique and outcome is null or "user"."""
    _refuse(dim.groupBy("table", "value").count().where("count > 1"), "causes given twice")
    _refuse(dim.where("outcome is not null and outcome <> 'user'"), "unknown outcomes")
    return dim


def load_causes(spark: SparkSession, path: str) -> DataFrame:
    return check_causes(spark.read.schema("table string, value int, name string, spec string, clause string, plain string, common_causes array<string>, outcome string").json(path))


def check_sequences(rules: DataFrame, causes: DataFrame) -> DataFrame:
    """Two values or more, all known to the table."""
    _refuse(rules.where("size(values) < 2"), "short sequences")
    _refuse(rules.select("table", F.explode("values").alias("value")).join(causes, ["table", "value"], "left_anti"), "values without a cause")
    return rules


def load_sequences(spark: SparkSession, path: str, causes: DataFrame) -> DataFrame:
    return check_sequences(spark.read.schema("table string, values array<int>, says string").json(path), causes)


def load_node_map(spark: SparkSession, path: str) -> DataFrame:
    """address, name from one JSON object."""
    held = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("address", "name"))
    _refuse(held.where("address = '' or name is null or name = ''"), "empty names")
    return held
