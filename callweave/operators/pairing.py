"""As-of joins, request/answer pairing, prefix and dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import staged
from callweave.operators.rollups import dimension

QUOTE_AGE, FORWARD_LEAD = 60.0, 10.0


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, value: list[str], strict: bool = True) -> DataFrame:
    """left with the columns `value` of right's latest row before (strict) or not after it, per key.

    One union and one window: each key is read once, in order, without a range join.
    """
    order = F.lit(0 if strict else 1)
    marked = left.select("*", F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("__v"), order.alias("__o"), F.lit(True).alias("__left"))
    other = right.select(*by, at, F.struct(*value).alias("__v"), (1 - order).alias("__o"), F.lit(False).alias("__left"))
    w = Window.partitionBy(*by).orderBy(at, "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marked.unionByName(other, allowMissingColumns=True).withColumn("__got", F.last("__v", ignorenulls=True).over(w)).where("__left")
    return both.select(*left.columns, *(F.col(f"__got.{v}").alias(v) for v in value))


def late_body_attach(continuations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each continuation with the latest earlier message (strictly earlier frame) of its protocol, key, source address and port."""
    by = ["capture_id", "protocol", "key", "src_ip", "src_port"]
    return asof_backward(continuations, messages.withColumn("target_frame", F.col("frame")), by, "frame", ["target_frame"])


def bind_quotes(quotes: DataFrame, sightings: DataFrame, max_age: float = QUOTE_AGE, max_lead: float = FORWARD_LEAD) -> DataFrame:
    """quotes (capture_id, kind, value, looks, frame, ts) -> bound_frame: the native sighting each refers to.

    sightings: capture_id, kind, value, frame, ts, releases (the key is released by this message).
    The sighting before binds if the key wasn't released from it on and the
    quote is forwarded or at most max_age old; else a forwarded quote binds the
    next one at most max_lead later. Sightings in the same frame don't count.
    """
    by = ["capture_id", "kind", "value"]
    rows = quotes.select(*by, "frame", "ts", "looks", F.lit(None).cast("boolean").alias("releases"), F.lit(True).alias("q")).unionByName(sightings.select(*by, "frame", "ts", F.lit(None).cast("string").alias("looks"), "releases", F.lit(False).alias("q")))
    before = Window.partitionBy(*by).orderBy("frame").rangeBetween(Window.unboundedPreceding, -1)
    # Read from the end, so that each frame grows by a row instead of being taken anew.
    after = Window.partitionBy(*by).orderBy(-F.col("frame")).rangeBetween(Window.unboundedPreceding, -1)
    seen = F.when(~F.col("q"), F.struct("frame", "ts", "releases"))
    got = rows.withColumns({"p": F.max(seen).over(before), "n": F.min(seen).over(after)}).where("q")
    fresh = ~F.col("p.releases") & ((F.col("looks") == "forwarded") | (F.col("ts") - F.col("p.ts") <= max_age))
    lead = (F.col("looks") == "forwarded") & (F.col("n.ts") - F.col("ts") <= max_lead)
    return got.select(*by, "frame", "looks", F.when(fresh, F.col("p.frame")).when(lead, F.col("n.frame")).alias("bound_frame"))


def pair_hops(requests: DataFrame, answers: DataFrame, slot: list[str], order: list[str]) -> DataFrame:
    """The n-th request of a slot with its n-th answer; extras on either side are rows of their own."""
    number = F.row_number().over(Window.partitionBy(*slot).orderBy(*order))
    r = requests.select(*slot, number.alias("n"), F.struct(*order).alias("request"))
    a = answers.select(*slot, number.alias("n"), F.struct(*order).alias("answer"))
    return r.join(a, [*slot, "n"], "full")


#: Diameter: a hop by its peers and hop-by-hop id, then by its peers and end-to-end id.
HOP_STAGES = (("hop", ("capture_id", "peers", "hop")), ("end", ("capture_id", "peers", "end")))


def pair_cascade(requests: DataFrame, answers: DataFrame, stages=HOP_STAGES, order: tuple[str, ...] = ("frame", "seq")) -> DataFrame:
    """request, answer (structs of their rows), stage: pairs by the first stage's slot, then by the next one's among what is left.

    In a slot the n-th request meets the n-th answer. A row that lacks a part of a
    slot waits for a later stage; what no stage pairs is a leg of its own ("loose"):
    rather one leg more than two messages that don't belong together. Each row is
    used once. A stage is one full outer join of what the stage before has left.
    """
    req, ans = requests, answers
    paired = None
    for name, slot in stages:
        whole = lambda df: F.lit(True) if not slot else F.expr(" and ".join(f"{c} is not null" for c in slot))  # noqa: B023, E731
        number = F.row_number().over(Window.partitionBy(*slot).orderBy(*order))
        side = lambda df, as_: df.where(whole(df)).select(*slot, number.alias("n"), F.struct(*df.columns).alias(as_))  # noqa: B023, E731
        met = staged(side(req, "request").join(side(ans, "answer"), [*slot, "n"], "full").select("request", "answer"), f"legs-{name}")
        both = met.where("request is not null and answer is not null").withColumn("stage", F.lit(name))
        paired = both if paired is None else paired.unionByName(both)
        req = req.where(~whole(req)).unionByName(met.where("answer is null").select("request.*"))
        ans = ans.where(~whole(ans)).unionByName(met.where("request is null").select("answer.*"))
    kinds = {f.name: f.dataType for f in paired.schema.fields}
    alone = req.select(F.struct(*requests.columns).alias("request"), F.lit(None).cast(kinds["answer"]).alias("answer")).unionByName(ans.select(F.lit(None).cast(kinds["request"]).alias("request"), F.struct(*answers.columns).alias("answer")))
    return paired.unionByName(alone.withColumn("stage", F.lit("loose")))


def diameter_legs(messages: DataFrame) -> DataFrame:
    """capture_id, request_frame, answer_frame, hop, end, stage: the legs of Diameter messages between two peers."""
    part = lambda n: F.try_element_at("detail", F.lit(n))
    rows = messages.where("protocol = 'diameter'").select("capture_id", "frame", "seq", "label", F.array_join(F.array_sort(F.array("src.ip", "dst.ip")), "|").alias("peers"), part("hop-by-hop-id").alias("hop"), part("end-to-end-id").alias("end"))
    asks = F.col("label").rlike("(^| )Request$")
    legs = pair_cascade(rows.where(asks), rows.where(~asks))
    first = lambda c: F.coalesce(F.col(f"request.{c}"), F.col(f"answer.{c}"))
    return legs.select(first("capture_id").alias("capture_id"), F.col("request.frame").alias("request_frame"), F.col("answer.frame").alias("answer_frame"), first("hop").alias("hop"), first("end").alias("end"), "stage")


def unanswered(requests: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    return requests.join(answers.select(*by).distinct(), by, "left_anti")


def first_answer_after(requests: DataFrame, answers: DataFrame, by: list[str], at: str) -> DataFrame:
    """Each request with the delay to the first answer of the same key at or after it."""
    later = Window.partitionBy(*by).orderBy(F.col(at).desc(), F.col("__o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = requests.select("*", F.lit(1).alias("__o"), F.lit(None).cast("double").alias("__a")).unionByName(answers.select(*by, at, F.lit(0).alias("__o"), F.col(at).alias("__a")), allowMissingColumns=True)
    got = both.withColumn("answered_at", F.last("__a", ignorenulls=True).over(later)).where("__o = 1")
    return got.withColumn("delay", F.round(F.col("answered_at") - F.col(at), 6)).drop("__o", "__a")


def reference_points(messages: DataFrame, points: DataFrame) -> DataFrame:
    """interface by protocol and unordered role pair; equal or missing roles have none; a Diameter message's own value first.

    points: protocol, role_a, role_b, interface.
    """
    pair = lambda a, b: F.array_join(F.array_sort(F.array(a, b)), "|")
    dim = dimension(points.select(F.col("protocol").alias("__p"), pair(F.col("role_a"), F.col("role_b")).alias("__pair"), "interface"))
    known = F.when(F.col("src.role") != F.col("dst.role"), pair(F.col("src.role"), F.col("dst.role")))
    own = F.when(F.col("protocol") == "diameter", F.try_element_at("detail", F.lit("reference_point")))
    joined = messages.join(dim, (F.col("protocol") == F.col("__p")) & (known == F.col("__pair")), "left")
    return joined.withColumn("interface", F.coalesce(own, "interface")).drop("__p", "__pair")


def apply_roles(messages: DataFrame, roles: DataFrame) -> DataFrame:
    """Fills src.role and dst.role from roles (capture_id, address, role); address may be ip or ip:port, the latter first."""
    for end in ("src", "dst"):
        ip, port = F.col(f"{end}.ip"), F.concat_ws(":", f"{end}.ip", f"{end}.port")
        for n, address in enumerate((port, ip)):
            dim = roles.select(F.col("capture_id").alias("__c"), F.col("address").alias("__a"), F.col("role").alias(f"__{end}{n}"))
            messages = messages.join(dim, (F.col("capture_id") == F.col("__c")) & (address == F.col("__a")), "left").drop("__c", "__a")
        messages = messages.withColumn(end, F.col(end).withField("role", F.coalesce(f"__{end}0", f"__{end}1", f"{end}.role"))).drop(f"__{end}0", f"__{end}1")
    return messages


def fill_hosts(ends: DataFrame, by: list[str]) -> DataFrame:
    """host where missing: its own hint, else the one other origin seen in the same group. ends: host, hint, origin and `by`."""
    origins = ends.groupBy(*by).agg(F.min("origin").alias("lo"), F.max("origin").alias("hi"))
    joined = ends.join(origins, by, "left")
    return joined.withColumn("host", F.coalesce("host", "hint", F.when(F.col("lo") == F.col("hi"), F.col("lo")))).drop("lo", "hi")


def callback_match(requests: DataFrame, registered: DataFrame) -> DataFrame:
    """Requests whose path equals or lies below a registered path, with its producer; paths of two producers are dropped.

    Each request path is exploded into its own prefixes, so this is an equi join. The longest prefix wins.
    """
    clean = registered.groupBy("capture_id", F.rtrim("path", F.lit("/")).alias("prefix")).agg(F.min("producer").alias("producer"), F.max("producer").alias("other")).where("producer = other").drop("other")
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = requests.withColumn("prefix", F.explode(prefixes)).join(clean, ["capture_id", "prefix"])
    return hits.groupBy(*requests.columns).agg(F.max_by("producer", F.length("prefix")).alias("producer"))


def fragments_of(packets: DataFrame) -> DataFrame:
    """whole, fragment: a row per fragment that a whole packet names, with whether it is there."""
    named = packets.select("capture_id", F.col("number").alias("whole"), F.explode("fragments").alias("fragment"))
    there = packets.select("capture_id", F.col("number").alias("fragment"), F.lit(True).alias("present"))
    return named.join(there, ["capture_id", "fragment"], "left").fillna(False, ["present"])


def declared_spis(packets: DataFrame, associations: DataFrame) -> DataFrame:
    """Packets per ESP SPI, whether an association declares it, and whether it can be read."""
    used = packets.where("esp_spi is not null").groupBy("capture_id", "esp_spi").agg(F.count("*").alias("packets"))
    return used.join(associations.select("capture_id", F.col("spi").alias("esp_spi"), "readable", F.lit(True).alias("declared")), ["capture_id", "esp_spi"], "left").fillna(False, ["declared"])


def by_either(a: DataFrame, b: DataFrame, keys: list[str], out: list[Column]) -> DataFrame:
    """An OR of equi joins as a union of them."""
    found = None
    for k in keys:
        one = a.alias("a").join(b.alias("b"), F.col(f"a.{k}") == F.col(f"b.{k}")).select(*out)
        found = one if found is None else found.unionByName(one)
    return found.distinct()
