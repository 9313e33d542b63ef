"""Which network element plays which role: votes, tiers, contradictions, ports, relays, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.scalars import hints, path_of
from callweave.operators.role_evidence import ONLY_CONSUMER, access_votes, diameter_ends, resource_consumer, table
from callweave.operators.sequences import detail

# Strength of each kind of evidence (0 strongest), and roles that one element may hold together.
TIERS = {"wire-hint": 0, "trace-hint": 0, "ngap-dir": 0, "s1ap-dir": 0, "pfcp-dir": 0, "diameter-dir": 0, "ipsec-fanout": 0, "n2-port": 1, "contact": 1, "service": 2, "service-consumer": 2, "resource-consumer": 2, "notify": 2, "declared-nf-type": 2, "user-agent": 3}
FAMILIES = ((("PGW", "PCEF"), "PGW"), (("AF", "P-CSCF"), "P-CSCF"))
RELAY_ROLES = {"sbi": "SCP", "diameter": "DRA", "sip": "SIP proxy"}
N2_PORT = 38412
# Who begins an NGAP procedure, and an S1AP one (by code); the service that an NF type provides.
NGAP_BY_GNB = ("NGSetup", "InitialUEMessage", "RANConfigurationUpdate", "UERadioCapabilityInfoIndication", "HandoverPreparation", "HandoverNotification", "HandoverCancel", "PathSwitchRequest")
NGAP_BY_AMF = ("AMFConfigurationUpdate", "AMFStatusIndication", "Paging", "InitialContextSetup", "DownlinkNASTransport", "HandoverResourceAllocation")
S1AP_BY_ENB = (0, 2, 4, 12, 13, 17, 18)
S1AP_BY_MME = (1, 9, 10, 11, 23)
SERVICES = {
    "namf-comm": "AMF", "namf-evts": "AMF", "namf-mt": "AMF", "namf-loc": "AMF", "nsmf-pdusession": "SMF", "nsmf-event-exposure": "SMF",
    "nudm-sdm": "UDM", "nudm-uecm": "UDM", "nudm-ueau": "UDM", "nudm-ee": "UDM", "nausf-auth": "AUSF", "nausf-sorprotection": "AUSF",
    "npcf-am-policy-control": "PCF", "npcf-smpolicycontrol": "PCF", "npcf-policyauthorization": "PCF", "npcf-ue-policy-control": "PCF",
    "nbsf-management": "BSF", "nnrf-nfm": "NRF", "nnrf-disc": "NRF", "nudr-dr": "UDR", "nnssf-nsselection": "NSSF", "nsmsf-sms": "SMSF",
    "nchf-convergedcharging": "CHF", "nnef-eventexposure": "NEF",
}
DECLARED = ("SCP", "SEPP", "LMF", "GMLC", "NEF", "NWDAF", "AF")
WEAKEST = 4


def tier(basis: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.substring_index(basis, ":", 1)), F.lit(WEAKEST))


def role_votes(messages: DataFrame, relays: DataFrame | None = None) -> DataFrame:
    """capture_id, address, port, role, basis: the first basis per address, port and role; relays receive none.

    Evidence: roles and hints that messages and traces state, request directions of
    NGAP, S1AP, PFCP and Diameter (answers reversed), the N2 port, services, consumers
    that a service or a resource has alone, callbacks registered by a producer, declared
    types, user agents, and for protected SIP the fan-out of its peers or, where that
    decides nothing, Contact headers.
    """
    lit, p, label, ends = F.lit, F.col("protocol"), F.col("label"), ("src", "dst")
    base = F.regexp_replace("label", "(Response|Failure)$", "")
    code = detail("procedure-code").cast("int")
    answer = F.when(p == "ngap", base != label).when(p == "s1ap", detail("outcome").isNotNull()).when(p == "diameter", label.endswith(" Answer")).otherwise(F.lit(False))
    asker, asked = F.when(answer, F.col("dst")).otherwise(F.col("src")), F.when(answer, F.col("src")).otherwise(F.col("dst"))
    address = lambda end: F.coalesce(end["ip"], end["host"])
    vote = lambda when, end, role, basis: F.when(when & role.isNotNull(), F.struct(address(end).alias("address"), end["port"].alias("port"), role.alias("role"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis")))
    both = lambda when, first, second, basis: [vote(when, asker, lit(first), basis), vote(when, asked, lit(second), basis)]
    command = F.concat_ws("/", detail("application-id"), detail("command-code"))
    askers, answerers = diameter_ends()
    agent = F.coalesce(F.col("cause.table") == "diameter_base", lit(False)) & F.col("cause.value").between(3000, 3999)
    service, path = detail("service"), F.substring_index(detail("path"), "?", 1)
    provider = F.try_element_at(table(SERVICES), service)
    consumer, only = resource_consumer(service, path), F.when(path != "", F.try_element_at(table(ONLY_CONSUMER), service))
    declared, user_agent = detail("declared-nf-type"), F.upper(F.trim(F.regexp_extract(detail("user-agent"), "^([^-/]+)", 1)))
    votes = [
        *(vote(F.col(f"{e}.role").isNotNull(), F.col(e), F.col(f"{e}.role"), "wire-hint") for e in ends),
        *both((p == "ngap") & base.isin(*NGAP_BY_GNB), "gNB", "AMF", "ngap-dir"), *both((p == "ngap") & base.isin(*NGAP_BY_AMF), "AMF", "gNB", "ngap-dir"),
        *both((p == "s1ap") & code.isin(*S1AP_BY_ENB), "eNB", "MME", "s1ap-dir"), *both((p == "s1ap") & code.isin(*S1AP_BY_MME), "MME", "eNB", "s1ap-dir"),
        vote(p == "diameter", asker, F.try_element_at(table(askers), command), "diameter-dir"), vote((p == "diameter") & ~agent, asked, F.try_element_at(table(answerers), command), "diameter-dir"),
        *both((p == "pfcp") & label.startswith("Session Establishment Request"), "SMF", "UPF", "pfcp-dir"),
        *(vote((p == "ngap") & (F.col(f"{e}.port") == N2_PORT), F.col(e), lit("AMF"), "n2-port") for e in ends),
        vote(p == "sbi", F.col("dst"), provider, "service"), vote(p == "sbi", F.col("src"), only, "service-consumer"), vote(p == "sbi", F.col("src"), consumer, "resource-consumer"),
        vote((p == "sbi") & declared.isin(*DECLARED, *SERVICES.values()), F.col("src"), declared, "declared-nf-type"), vote((p == "sbi") & user_agent.isin(*SERVICES.values()), F.col("src"), user_agent, "user-agent"),
    ]
    hinted = [F.transform(F.map_entries(hints(F.coalesce(detail(name), lit("")))), lambda e: F.when((e["key"] != "") & e["value"].isNotNull(), F.struct(e["key"].alias("address"), F.lit(None).cast("int").alias("port"), e["value"].alias("role"), lit(basis).alias("basis")))) for name, basis in (("nf-role-hints", "wire-hint"), ("trace-role-hints", "trace-hint"))]  # noqa: B023
    cast = "array<struct<address:string,port:int,role:string,basis:string>>"
    votes = F.concat(F.array(*votes).cast(cast), *(h.cast(cast) for h in hinted))
    held = messages.select("capture_id", "frame", "seq", F.explode(F.array_compact(votes)).alias("v")).select("capture_id", "frame", "seq", "v.*").where("address is not null")
    held = held.unionByName(_callback_votes(messages)).unionByName(access_votes(messages, judge_fanout))
    if relays is not None:
        held = held.join(relays.select("capture_id", "address"), ["capture_id", "address"], "left_anti")
    return held.groupBy("capture_id", "address", "port", "role").agg(F.min_by("basis", F.struct("frame", "seq", tier(F.col("basis")))).alias("basis"))


def _callback_votes(messages: DataFrame) -> DataFrame:
    """Who calls a path that a consumer gave to a service is that service's provider; a path given to two kinds says nothing."""
    given = messages.where("protocol = 'sbi'").select("capture_id", F.explode(F.split(detail("callback-uris"), "[ ,;]+")).alias("uri"), F.try_element_at(F.create_map(*(F.lit(x) for kv in SERVICES.items() for x in kv)), detail("service")).alias("role"))
    given = given.where("role is not null and uri <> ''").groupBy("capture_id", F.rtrim(path_of(F.col("uri")), F.lit("/")).alias("callback")).agg(F.min("role").alias("role"), F.max("role").alias("other")).where("role = other").drop("other")
    calls = messages.where("protocol = 'sbi'").select("capture_id", "frame", "seq", F.coalesce("src.ip", "src.host").alias("address"), F.col("src.port").alias("port"), F.substring_index(detail("path"), "?", 1).alias("path")).where("path is not null")
    # A path is joined by each of its own prefixes, so no range join is needed.
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = calls.withColumn("callback", F.explode(F.array_distinct(prefixes))).join(given, ["capture_id", "callback"])
    return held.select("capture_id", "frame", "seq", "address", "port", "role", F.lit("notify").alias("basis"))


def _collapse(votes: DataFrame, by: list[str]) -> DataFrame:
    """role of the strongest tier per address: a single one, or a family's name; else null and contradicted."""
    t = tier(F.col("basis"))
    best = votes.withColumns({"t": t, "best": F.min(t).over(Window.partitionBy(*by))}).where("t = best")
    sets = best.groupBy(*by).agg(F.array_sort(F.collect_set("role")).alias("roles"), F.min_by("basis", "role").alias("basis"))
    family = F.coalesce(*(F.when(F.size(F.array_except("roles", F.array(*map(F.lit, f)))) == 0, F.lit(n)) for f, n in FAMILIES))
    return sets.withColumn("role", F.when(F.size("roles") == 1, F.get("roles", F.lit(0))).otherwise(family))


def resolve_roles(votes: DataFrame) -> DataFrame:
    """capture_id, address (ip, or ip:port where only ports can be told apart), role, basis, roles (of the strongest tier).

    A contradictory address with two ports or more, each decided and not all
    alike, is split by port; otherwise its role stays null.
    """
    whole = _collapse(votes, ["capture_id", "address"])
    ports = _collapse(votes.where("port is not null"), ["capture_id", "address", "port"])
    decided = ports.groupBy("capture_id", "address").agg(F.count("*").alias("n"), F.every(F.col("role").isNotNull()).alias("all"), F.count_distinct("role").alias("d")).where("n > 1 and `all` and d > 1").select("capture_id", "address")
    split = whole.where("role is null").select("capture_id", "address").join(decided, ["capture_id", "address"])
    by_port = ports.join(split, ["capture_id", "address"]).select("capture_id", F.concat_ws(":", "address", "port").alias("address"), "role", "basis", "roles")
    return whole.join(split, ["capture_id", "address"], "left_anti").select("capture_id", "address", "role", "basis", "roles").unionByName(by_port)


def role_contradictions(resolved: DataFrame) -> DataFrame:
    return resolved.where("role is null").select("capture_id", "address", "roles")


def role_basis(votes: DataFrame) -> DataFrame:
    """All evidence per address."""
    return votes.groupBy("capture_id", "address").agg(F.array_sort(F.collect_set(F.concat_ws("=", "role", "basis"))).alias("evidence"))


def find_relays(messages: DataFrame, least_paths: int = 2) -> DataFrame:
    """capture_id, address, role: addresses that pass messages on; two relay roles for one address leave it out.

    Evidence: the same path arrived before it left, for two paths or more; a
    message names another target than its receiver; a sender has a route record.
    """
    role = F.try_element_at(F.create_map(*(F.lit(x) for kv in RELAY_ROLES.items() for x in kv)), F.col("protocol"))
    rows = messages.select("capture_id", "ts", "frame", "seq", "protocol", role.alias("relay_role"), F.coalesce("src.ip", "src.host").alias("s"), F.coalesce("dst.ip", "dst.host").alias("d"), detail("path").alias("path"), detail("relay-target").alias("target"), detail("relay-record").alias("record")).where("relay_role is not null")
    place = F.struct("ts", "frame", "seq")
    with_path = rows.where("path is not null")
    arrived = with_path.groupBy("capture_id", "protocol", "path", F.col("d").alias("address")).agg(F.min(place).alias("arrived"))
    left = with_path.withColumns({"address": F.col("s"), "place": place}).join(arrived, ["capture_id", "protocol", "path", "address"]).where("place > arrived")
    onward = arrived.select("capture_id", "protocol", "path", F.col("address").alias("d"), F.col("arrived").alias("there"))
    left = left.join(onward, ["capture_id", "protocol", "path", "d"]).where("there >= place")
    mirrored = left.groupBy("capture_id", "address", "relay_role").agg(F.count_distinct("path").alias("n")).where(F.col("n") >= least_paths)
    named = rows.where("target is not null and target <> d").select("capture_id", F.col("d").alias("address"), "relay_role")
    noted = rows.where("record is not null").select("capture_id", F.col("s").alias("address"), "relay_role")
    every = mirrored.select("capture_id", "address", "relay_role").unionByName(named).unionByName(noted)
    return every.groupBy("capture_id", "address").agg(F.min("relay_role").alias("role"), F.max("relay_role").alias("other")).where("role = other").drop("other")


def fanout_votes(protected: DataFrame, least: int = 2) -> DataFrame:
    """Addresses with two protected peers or more are the network side, their other peers the access side."""
    pairs = protected.select("capture_id", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("capture_id", "p.*").distinct()
    return judge_fanout(pairs, least).select("capture_id", "address", "role", "basis")


def judge_fanout(pairs: DataFrame, least: int = 2) -> DataFrame:
    """The same on distinct pairs (x, y), both ways round, which may carry ports: lists of x's ports, kept as one."""
    if "ports" not in pairs.columns:
        pairs = pairs.withColumn("ports", F.array().cast("array<int>"))
    # Both directions are there, so a peer's degree is the count of its own rows.
    own, peer = Window.partitionBy("capture_id", "x"), Window.partitionBy("capture_id", "y")
    ranked = pairs.withColumn("peers_peers", F.count("*").over(peer)).withColumn("peers", F.count("*").over(own))
    held = ranked.groupBy("capture_id", F.col("x").alias("address")).agg(F.max("peers").alias("peers"), F.max("peers_peers").alias("most"), F.array_distinct(F.flatten(F.collect_set("ports"))).alias("ports"))
    role = F.when(F.col("peers") >= least, "P-CSCF").when(F.col("most") >= least, "UE")
    return held.select("capture_id", "address", role.alias("role"), F.lit("ipsec-fanout").alias("basis"), "ports").where("role is not null")


def lanes(resolved: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Lane names: a given name, else the role; a name used twice in a capture gets the address behind it; UEs have none."""
    held = resolved.where("role is null or role <> 'UE'")
    if names is not None:
        held = held.join(names.select("address", F.col("name").alias("given")), "address", "left")
    else:
        held = held.withColumn("given", F.lit(None).cast("string"))
    base = F.coalesce("given", "role", "address")
    n = F.count("*").over(Window.partitionBy("capture_id", base))
    return held.withColumns({"base": base, "n": n}).select("capture_id", "address", F.when(F.col("n") > 1, F.concat_ws(" ", "base", F.concat(F.lit("("), "address", F.lit(")")))).otherwise(F.col("base")).alias("lane"))


def participants(rows: DataFrame, order: list[str]) -> DataFrame:
    """Ladder order: by a fixed rank of roles, then label."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ((r, n) for n, r in enumerate(order)) for x in kv)), F.col("role")), F.lit(len(order)))
    return rows.withColumn("rank", rank).withColumn("place", F.row_number().over(Window.partitionBy("capture_id").orderBy("rank", "label")))
