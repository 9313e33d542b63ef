"""Evidence for roles from public interface definitions: Diameter applications, consumers of services, the access side of IMS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.scalars import hints
from callweave.operators.sequences import detail

LAST = 2**62

# Applications and commands of the Diameter registry. Per application: its number, the two ends of the
# interface, what the first end asks of the second, and what the second sends unasked. Cx has two kinds of client.
INTERFACES = (
    ("Cx", 16777216, "I-CSCF", "HSS", (300, 302), ()),
    ("Cx", 16777216, "S-CSCF", "HSS", (301, 303), (304, 305)),
    ("Sh", 16777217, "AS", "HSS", (306, 307, 308), (309,)),
    ("Rx", 16777236, "AF", "PCRF", (265, 275), (258, 274)),
    ("Gx", 16777238, "PCEF", "PCRF", (272,), (258,)),
    ("S6a", 16777251, "MME", "HSS", (316, 318, 321, 323), (317, 319, 320, 322)),
    ("S13", 16777252, "MME", "EIR", (324,), ()),
    ("SLg", 16777255, "GMLC", "MME", (8388620,), (8388621,)),
    ("SWm", 16777264, "ePDG", "AAA", (265, 268, 275), (258, 274)),
    ("SWx", 16777265, "AAA", "HSS", (301, 303), (304, 305)),
    ("S6b", 16777272, "PGW", "AAA", (265, 275), (258, 274)),
    ("SLh", 16777291, "GMLC", "HSS", (8388622,), ()),
    ("Sy", 16777302, "PCRF", "OCS", (275, 8388635), (8388636,)),
)
# Services that one kind of consumer alone may use (3GPP TS 29.503, 29.507, 29.509, 29.512, 29.525, 29.540).
ONLY_CONSUMER = {
    "nausf-auth": "AMF", "npcf-am-policy-control": "AMF", "npcf-smpolicycontrol": "SMF", "npcf-ue-policy-control": "AMF",
    "nsmsf-sms": "AMF", "nudm-ueau": "AUSF",
}
# Where a service has several consumers, the one that uses a resource (path part; 3GPP TS 29.502, 29.503).
RESOURCE_CONSUMERS = {
    "nsmf-pdusession": {"AMF": ("sm-contexts",), "SMF": ("pdu-sessions",)},
    "nudm-sdm": {"AMF": ("am-data", "lcs-mo-data", "nssai", "smf-select-data", "ue-context-in-smf-data"), "GMLC": ("lcs-privacy-data",), "SMF": ("sm-data",), "SMSF": ("sms-mng-data",)},
    "nudm-uecm": {"AMF": ("amf-3gpp-access", "amf-non-3gpp-access"), "NWDAF": ("nwdaf-registrations",), "SMF": ("smf-registrations",), "SMSF": ("smsf-3gpp-access", "smsf-non-3gpp-access")},
}


def table(names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))


def diameter_ends() -> tuple[dict[str, str], dict[str, str]]:
    """application/command -> who asks, and who answers."""
    asks: dict[str, str] = {}
    answers: dict[str, str] = {}
    for _, number, client, server, asked, pushed in INTERFACES:
        for commands, sender, receiver in ((asked, client, server), (pushed, server, client)):
            for command in commands:
                asks[f"{number}/{command}"], answers[f"{number}/{command}"] = sender, receiver
    return asks, answers


def interface_names() -> dict[str, str]:
    return {str(number): name for name, number, *_ in INTERFACES}


def resource_consumer(service: Column, path: Column) -> Column:
    """Who asks for this path of the service: the first of its parts that one kind of consumer alone uses."""
    known = table({f"{service}/{part}": role for service, by in RESOURCE_CONSUMERS.items() for role, parts in by.items() for part in parts})
    found = F.transform(F.split(path, "/"), lambda part: F.try_element_at(known, F.concat_ws("/", service, part)))
    return F.when(service.isNotNull(), F.get(F.array_compact(found), F.lit(0)))


def access_votes(messages: DataFrame, fanout) -> DataFrame:
    """capture_id, frame, seq, address, port, role, basis of the two ends of protected SIP.

    fanout judges the pairs of addresses that met under IPsec; its votes hold for
    each port seen there. Only where it decides nothing in a capture do the
    Contact headers that name their own sender as a UE count. These votes come
    after all others, so they don't displace a basis found before.
    """
    address = lambda end: F.coalesce(F.col(end)["ip"], F.col(end)["host"])
    rows = messages.where((F.col("protocol") == "sip") & (detail("ipsec-roles").isNotNull() | detail("fallback-role-hints").isNotNull()))
    both = F.array(*(F.struct(address(e).alias("x"), F.col(e)["port"].alias("port"), address(o).alias("y")) for e, o in (("src", "dst"), ("dst", "src"))))
    protected = rows.where(detail("ipsec-roles").isNotNull()).select("capture_id", F.explode(both).alias("e")).select("capture_id", "e.*").where("x is not null and y is not null")
    voted = fanout(protected.groupBy("capture_id", "x", "y").agg(F.collect_set("port").alias("ports")))
    by_port = voted.withColumn("port", F.explode_outer("ports"))
    named = rows.where(detail("fallback-role-hints").isNotNull()).join(voted.select("capture_id").distinct(), "capture_id", "left_anti")
    pairs = named.select("capture_id", "src", "dst", F.explode(hints(detail("fallback-role-hints"))).alias("address", "role")).where("address <> '' and role is not null")
    # The end that a hint is about lends its port.
    port = F.when(F.col("address") == address("src"), F.col("src.port")).when(F.col("address") == address("dst"), F.col("dst.port"))
    contact = pairs.select("capture_id", "address", port.cast("int").alias("port"), "role", F.lit("contact").alias("basis")).distinct()
    every = by_port.select("capture_id", "address", F.col("port").cast("int").alias("port"), "role", "basis").unionByName(contact)
    return every.withColumns({"frame": F.lit(LAST), "seq": F.lit(LAST)})
