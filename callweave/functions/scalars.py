"""Column functions over identifiers, addresses and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.schema import TITLE_ORDER


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def msisdn_of(uri: Column) -> Column:
    """Digits and + of a URI that declares a number (tel:, leading +, phone-context, user=phone); at least four."""
    low = F.lower(uri)
    user = F.regexp_extract(low, r"^(?:<)?(?:sips?:|tel:)?([^@;>]*)", 1)
    declared = low.rlike(r"^<?tel:") | user.startswith("+") | low.contains("phone-context=") | low.contains("user=phone")
    number = F.regexp_replace(user, r"[^0-9+]", "")
    return F.when(declared & (F.length(F.regexp_replace(number, r"\+", "")) >= 4), number)


def international_msisdn(uri: Column) -> Column:
    """A number with + and at least eight digits."""
    number = msisdn_of(uri)
    return F.when(number.startswith("+") & (F.length(number) >= 9), number)


def msisdn_from_tbcd(hexes: Column) -> Column:
    """Nibble-swapped digits without the filler f."""
    clean = F.regexp_replace(F.lower(hexes), ":", "")
    return _or_null(F.regexp_replace(F.regexp_replace(clean, "(.)(.)", "$2$1"), "f+$", ""))


def msisdn_from_enum_name(name: Column) -> Column:
    """+number from reversed digits under e164.arpa; at least eight digits."""
    digits = F.regexp_replace(F.reverse(F.regexp_extract(F.lower(name), r"^((?:[0-9]\.)+)e164\.arpa\.?$", 1)), r"\.", "")
    return F.when(F.length(digits) >= 8, F.concat(F.lit("+"), digits))


def imsi_from_ims_identity(identity: Column) -> Column:
    """14 or 15 digits at a 3GPP IMS domain."""
    return _or_null(F.regexp_extract(F.lower(identity), r"^(?:sip:)?([0-9]{14,15})@(?:[a-z0-9-]+\.)*ims\.mnc[0-9]{2,3}\.mcc[0-9]{3}\.3gppnetwork\.org", 1))


def supi_from_identifier(identifier: Column) -> Column:
    """Digits of imsi-..., or of an eight-part suci-... of the null scheme."""
    parts = F.split(identifier, "-")
    null_scheme = (F.size(parts) == 8) & (F.get(parts, F.lit(0)) == "suci") & (F.get(parts, F.lit(1)) == "0") & (F.get(parts, F.lit(5)) == "0")
    return F.when(identifier.rlike("^imsi-[0-9]+$"), F.substring(identifier, 6, 100)).when(null_scheme, F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(7))))


def integer_of(text: Column) -> Column:
    """A long from decimal, 0x... or colon-separated hexadecimal digits."""
    plain = F.lower(F.trim(text))
    hexes = F.regexp_replace(F.regexp_replace(plain, "^0x", ""), ":", "")
    return F.when(plain.rlike("^-?[0-9]+$"), plain.try_cast("long")).when(plain.rlike("^(0x[0-9a-f]+|[0-9a-f]{2}(:[0-9a-f]{2})*)$"), F.conv(hexes, 16, 10).try_cast("long"))


def bit_string(value: Column, bits: int, octets: int) -> Column:
    """A BIT STRING read left-aligned in its octets."""
    return F.shiftright(value, 8 * octets - bits)


def connection_scope(a: Column, b: Column, stream: Column) -> Column:
    """Both addresses in order, and the transport stream if there is one."""
    return F.concat(F.array_join(F.array_sort(F.array(a, b)), ","), F.coalesce(F.concat(F.lit("#"), stream.cast("string")), F.lit("")))


def key(kind: str, value: Column, scope: Column | None = None) -> Column:
    """An identity key; the value is always text, with its scope in front."""
    text = value.cast("string")
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), (text if scope is None else F.concat_ws("/", scope, text)).alias("value")))


def episodic(value: Column, episode: Column) -> Column:
    return F.when(episode > 0, F.concat_ws("@", value, episode + 1)).otherwise(value)


def subscriber_identity(keys: Column) -> Column:
    """The key that names a subscriber: by kind, then least value."""
    ranked = F.transform(F.filter(keys, lambda k: k["kind"].isin(*TITLE_ORDER)), lambda k: F.struct(F.array_position(F.array(*map(F.lit, TITLE_ORDER)), k["kind"]).alias("rank"), k["kind"].alias("kind"), k["value"].alias("value")))
    best = F.array_min(ranked)
    return F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), best["value"].alias("value")))


def access_kind(token: Column) -> Column:
    up = F.upper(token)
    return F.when(up.contains("WLAN") | up.contains("IEEE-802.11"), "vowifi").when(up.contains("NR"), "vonr").when(up.contains("E-UTRAN") | up.contains("LTE"), "volte")


def service_from_path(path: Column) -> Column:
    """First part of a service path, n... names only."""
    return _or_null(F.regexp_extract(path, r"^/?(n[a-z0-9]+-[a-z0-9-]+)(?:/|$)", 1))


def host_of(url: Column) -> Column:
    return F.lower(_or_null(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:?#]+)", 1)))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_parameters(url: Column) -> Column:
    """name -> value of a URL's query; the first of a repeated name."""
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p.contains("="))
    names = F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.transform(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == n), lambda p: F.regexp_extract(p, "=(.*)$", 1)), 1)))


#: Protocol -> network domain.
DOMAINS = {"ngap": "5GC", "nas-5gs": "5GC", "sbi": "5GC", "pfcp": "5GC", "s1ap": "EPC", "nas-eps": "EPC", "gtpv2": "EPC", "gtp": "EPC", "sgsap": "CS", "megaco": "CS", "sip": "IMS", "enum": "IMS", "diameter": "EPC"}


def domain_of(protocol: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in DOMAINS.items() for x in kv)), protocol)


def hints(text: Column) -> Column:
    """addr=role;addr=role -> map; later pairs of an address win."""
    return F.str_to_map(text, F.lit(";"), F.lit("="))


def command_name(name: Column) -> Column:
    """A command without its vendor prefix."""
    return F.regexp_replace(name, r"^(?:3GPP-|ETSI-|[0-9]+:)", "")


def sip_status(label: Column) -> Column:
    return _or_null(F.regexp_extract(label, r"^([1-6][0-9]{2})(?: |$)", 1)).cast("int")


def iso_micros(ts: Column) -> Column:
    """Epoch seconds -> ISO text in UTC with microseconds; 0 and null have none."""
    return F.when(ts != 0.0, F.date_format(F.timestamp_micros(F.round(ts * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def own_label(label: Column) -> Column:
    """A collapsed row's own label: what stands before the joiner."""
    return F.split(label, r" \+ ")[0]


def is_nas(protocol: Column, detail: Column) -> Column:
    stack = F.concat(F.lit(","), F.regexp_replace(F.coalesce(F.try_element_at(detail, F.lit("protocols")), F.lit("")), " ", ""), F.lit(","))
    return protocol.isin("nas-5gs", "nas-eps") | stack.rlike(",nas-(5gs|eps),")
