"""What all normalisers share: blocks of a layer, keys, the message row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.scalars import connection_scope, integer_of, key
from callweave.schema import END, KEY

COLUMNS = ["capture_id", "frame", "ts", "event_time", "protocol", "label", "src", "dst", "keys", "releases", "quotes", "cause", "is_failure", "detail", "block"]


def blocks(frames: DataFrame, layer: str) -> DataFrame:
    """A row per block of the layer, which may be an object or a list of them: b, block (its place), scope."""
    path = f"$['{layer}']" if "-" in layer else f"$.{layer}"
    many = F.try_variant_get("layers", path, "array<variant>")
    one = F.try_variant_get("layers", path, "variant")
    held = frames.withColumn("__b", F.when(many.isNotNull(), many).when(one.isNotNull(), F.array(one)))
    return held.where("__b is not null").select("*", F.posexplode("__b").alias("block", "b")).drop("__b", "layers").withColumn("scope", connection_scope(F.col("src_ip"), F.col("dst_ip"), F.col("stream")))


def text(field: str) -> Column:
    """A field of the block as text; the first element of a list."""
    path = f"$['{field}']" if "-" in field else f"$.{field}"
    return F.coalesce(F.try_variant_get("b", path + "[0]", "string"), F.try_variant_get("b", path, "string"))


def texts(field: str) -> Column:
    path = f"$['{field}']" if "-" in field else f"$.{field}"
    one = F.try_variant_get("b", path, "string")
    return F.coalesce(F.try_variant_get("b", path, "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def number(field: str) -> Column:
    return integer_of(text(field))


def has(field: str) -> Column:
    return F.try_variant_get("b", f"$.{field}", "variant").isNotNull()


def scoped(kind: str, value: Column) -> Column:
    return key(kind, value, F.col("scope"))


def tunnels(kind: str, teids: Column, addresses: Column) -> Column:
    """Keys of tunnels: owning address and TEID; TEID 0 is none."""
    pairs = F.filter(F.arrays_zip(teids.alias("t"), addresses.alias("a")), lambda p: p["t"].isNotNull() & p["a"].isNotNull() & (F.coalesce(integer_of(p["t"]), F.lit(0)) != 0))
    return F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("kind"), F.concat_ws("/", p["a"], integer_of(p["t"]).cast("string")).alias("value")))


def named(code: Column, names: dict[int, str], otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), code.cast("int")), F.concat(F.lit(otherwise), code.cast("string")))


def details(**values: Column) -> Column:
    """A map without its nulls; _ in a name stands for -."""
    if not values:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def cause(table: str | Column, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct((F.lit(table) if isinstance(table, str) else table).alias("table"), value.cast("int").alias("value")))


def messages(rows: DataFrame, protocol: str, label: Column, keys: Column, failed: Column, detail: Column, releases: Column | None = None, cause_: Column | None = None, src_role: Column | None = None, dst_role: Column | None = None, src_host: Column | None = None, dst_host: Column | None = None, quotes: Column | None = None) -> DataFrame:
    """Block rows -> message rows."""
    null = F.lit(None).cast("string")

    def end(ip: str, port: str, host: Column | None, role: Column | None) -> Column:
        return F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"), (null if host is None else host).alias("host"), (null if role is None else role).alias("role"), null.alias("lane")).cast(END)

    none = F.array().cast(f"array<{KEY}>")
    kept = F.array_distinct(F.array_compact(keys.cast(f"array<{KEY}>")))
    given = F.lit(None).cast("struct<table:string,value:int>") if cause_ is None else cause_
    return rows.select(
        "capture_id", "frame", F.coalesce("ts", F.lit(0.0)).alias("ts"), F.timestamp_micros(F.round(F.col("abs_ts") * 1_000_000).cast("long")).alias("event_time"), F.lit(protocol).alias("protocol"), label.alias("label"),
        end("src_ip", "src_port", src_host, src_role).alias("src"), end("dst_ip", "dst_port", dst_host, dst_role).alias("dst"), F.coalesce(kept, none).alias("keys"), F.coalesce(releases, none).alias("releases") if releases is not None else none.alias("releases"),
        (F.array() if quotes is None else quotes).cast("array<struct<kind:string,value:string,looks:string>>").alias("quotes"), given.alias("cause"), F.coalesce(failed, F.lit(False)).alias("is_failure"), detail.alias("detail"), "block",
    ).where("label is not null")


def checked(made: DataFrame, name: str) -> DataFrame:
    missing = set(COLUMNS) - set(made.columns)
    if missing:
        raise ValueError(f"{name}: its messages lack {sorted(missing)}")
    return made.select(COLUMNS)


def sequenced(union: DataFrame) -> DataFrame:
    """seq: the place of a message in its frame, by protocol order and block; on a stream a number in the same order, with gaps."""
    names = ["capture_id", "frame", "seq", "ts", "event_time", "protocol", "label", "src", "dst", "keys", "releases", "quotes", "cause", "is_failure", "detail"]
    if union.isStreaming:
        return union.withColumn("seq", (F.col("__order") * 65536 + F.col("block")).cast("int")).select(names)
    w = Window.partitionBy("capture_id", "frame").orderBy("__order", "protocol", "block", "label")
    return union.withColumn("seq", (F.row_number().over(w) - 1).cast("int")).select(names)

