"""Network values as Column expressions: states, interfaces, addresses, platforms, roles, names."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spelling -> canonical state.
STATES = {
    "estab": "Established", "establ": "Established", "established": "Established", "idle": "Idle", "active": "Active", "connect": "Connect", "opensent": "OpenSent", "openconfirm": "OpenConfirm",
    "full": "Full", "2way": "2-Way", "2-way": "2-Way", "exstart": "ExStart", "exchange": "Exchange", "loading": "Loading", "init": "Init", "attempt": "Attempt",
    "up": "up", "connected": "up", "down": "down", "notconnect": "down", "notconnected": "down",
    "disabled": "admin-down", "administratively down": "admin-down", "admin down": "admin-down", "admin-down": "admin-down",
    "err-disabled": "err-disabled", "err disabled": "err-disabled", "testing": "testing", "dormant": "dormant",
    "desg": "designated", "designated": "designated", "root": "root", "altn": "alternate", "alternate": "alternate", "back": "backup", "backup": "backup",
    "fwd": "forwarding", "forwarding": "forwarding", "lrn": "learning", "learning": "learning", "lis": "listening", "listening": "listening", "blk": "blocking", "blocking": "blocking", "dis": "disabled",
    "loop": "loopback", "dr": "dr", "bdr": "bdr", "dother": "dother", "waiting": "waiting", "p2p": "point-to-point", "p-2-p": "point-to-point",
}
# Accepted spelling -> platform.
PLATFORMS = {
    "cisco_ios": "cisco_ios", "ios": "cisco_ios", "cisco": "cisco_ios", "cisco_ios_xe": "cisco_ios", "iosxe": "cisco_ios", "cisco_nxos": "cisco_nxos", "nxos": "cisco_nxos", "nx_os": "cisco_nxos",
    "cisco_iosxr": "cisco_iosxr", "cisco_xr": "cisco_iosxr", "iosxr": "cisco_iosxr", "ios_xr": "cisco_iosxr", "xr": "cisco_iosxr",
    "juniper_junos": "juniper_junos", "junos": "juniper_junos", "juniper": "juniper_junos", "juniperjunos": "juniper_junos",
    "arista_eos": "arista_eos", "eos": "arista_eos", "arista": "arista_eos", "huawei_vrp": "huawei_vrp", "vrp": "huawei_vrp", "huawei": "huawei_vrp",
}
# Role words in a host's name, the first one found counts.
ROLES = "border core spine leaf edge wan dist access oob router".split()
# Product ids that begin so run this platform.
IOS_PRODUCTS = "C9800 C9300 C9200 C9500 C9400 C9600 WS-C ISR ASR".split()
# Short interface name -> full name.
INTERFACES = {
    "eth": "Ethernet", "et": "Ethernet", "fa": "FastEthernet", "gi": "GigabitEthernet", "gig": "GigabitEthernet", "te": "TenGigabitEthernet", "ten": "TenGigabitEthernet",
    "twe": "TwentyFiveGigE", "fo": "FortyGigabitEthernet", "hu": "HundredGigE", "lo": "Loopback", "po": "Port-channel", "tu": "Tunnel", "vl": "Vlan", "ma": "Management", "mgmt": "Management", "se": "Serial",
}
# Statuses of a sound edge.
SOUND = {"l2_cdp": ["up", "new", ""], "bgp": ["established"], "ospf": ["full", "2way"]}
SENTINELS = ["unassigned", "none", "n/a", "-", "--"]


# The words in a field's name that tell what it holds, and what such a value looks like.
FIELD_WORDS = {
    "state": ["state", "status", "role", "admin", "oper"],
    "interface": ["interface", "port", "intf", "link"],
    "ip": ["ip", "ipv4", "ipv6", "address", "router_id", "destination", "source", "next_hop", "gateway", "loopback"],
    "asn": ["asn", "as_number", "as"],
    "mac": ["mac", "hwaddr", "chassis_id", "physical_address"],
}
STATE_VALUE = r"^[A-Za-z0-9/_+\- ]{1,40}$"
IP_VALUE = r"^(\d{1,3}(?:\.\d{1,3}){3}(?:/\d+)?|[0-9a-fA-F:]+(?:/\d+)?)$"
ASN_VALUE = r"^(\d+|\d+\.\d+)$"
# Marks of page breaks in extracted documents.
PAGE_MARK = r"=== PAGE \d+ ==="


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def canonical_state(value: Column) -> Column:
    """The standard name of a protocol state, by exact spelling, else by spelling before / or -; null if unknown."""
    text = F.trim(value)
    low = F.lower(text)
    head = F.regexp_extract(low, "^(p-2-p|2-way|err-disabled|admin-down|[^/-]+)(?=[/-])", 1)
    tail = F.substring(text, F.length(head) + 1, F.length(text))
    states = _map(STATES)
    return F.coalesce(F.element_at(states, low), F.when(head != "", F.concat(F.element_at(states, head), tail)))


def canonical_interface(value: Column) -> Column:
    """Gi0/0 -> GigabitEthernet0/0; names with another beginning pass unchanged."""
    parts = "^([A-Za-z-]+?) ?([0-9].*)$"
    long = F.element_at(_map(INTERFACES), F.lower(F.regexp_extract(value, parts, 1)))
    return F.coalesce(F.concat(long, F.regexp_extract(value, parts, 2)), value)


def usable_interface(value: Column) -> Column:
    text = F.trim(value)
    return (text != "") & ~text.contains(" ") & ~text.rlike("^[0-9]+$")


def ipv4_number(value: Column) -> Column:
    """The address as a number, null if it is no IPv4 address. Octets with leading zeros are not valid."""
    octets = F.split(F.split_part(value, F.lit("/"), F.lit(1)), r"\.")
    sound = value.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}(/\d+)?$") & ~value.rlike(r"(^|\.)0\d")
    return F.when(sound, reduce(lambda a, i: a * 256 + F.get(octets, F.lit(i)).cast("long"), range(1, 4), F.get(octets, F.lit(0)).cast("long")))


@F.pandas_udf(StringType())
def _ipv6_text(values: pd.Series) -> pd.Series:
    """The shortest form of IPv6 addresses, a prefix kept; what is none comes back as it is."""

    def one(value: str | None) -> str | None:
        address, slash, length = (value or "").partition("/")
        try:
            return str(ipaddress.IPv6Address(address)) + slash + length
        except ValueError:
            return value

    return values.map(one)


def canonical_ip(value: Column) -> Column:
    """IPv4 with an optional prefix as it is where its octets are sound, IPv6 in its shortest form; all else unchanged.

    Octets with leading zeros make no address, so such text stays too. Only texts with a colon leave the JVM.
    """
    six = F.when(value.rlike(r"^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*(/\d+)?$"), value)
    return F.coalesce(_ipv6_text(six), value)


def asn_number(value: Column) -> Column:
    """Plain or dotted AS number as a number: 1.1 -> 65537."""
    part = lambda i: F.split_part(value, F.lit("."), F.lit(i)).try_cast("long")
    return F.when(value.contains("."), part(1) * 65536 + part(2)).otherwise(value.try_cast("long"))


def mac_colons(value: Column) -> Column:
    bare = F.lower(F.regexp_replace(value, "[.:-]", ""))
    return F.when(bare.rlike("^[0-9a-f]{12}$"), F.regexp_replace(bare, "(..)(?=.)", "$1:")).otherwise(value)


def canonical_platform(value: Column) -> Column:
    """One name for each platform; unknown ones cleaned, blank ones null."""
    clean = F.lower(F.regexp_replace(F.trim(value), "-", "_"))
    return F.when(clean != "", F.coalesce(F.element_at(_map(PLATFORMS), clean), clean))


def vendor_of(platform: Column) -> Column:
    return F.initcap(F.split_part(platform, F.lit("_"), F.lit(1)))


def role_of_host(host: Column) -> Column:
    """A role word that is a whole segment of the first DNS label."""
    segments = F.split(F.split_part(F.lower(host), F.lit("."), F.lit(1)), "[^a-z0-9]+")
    return F.coalesce(*[F.when(F.array_contains(segments, role), F.lit(role)) for role in ROLES])


def platform_of_product(product: Column) -> Column:
    return F.when(product.rlike("^(" + "|".join(IOS_PRODUCTS) + ")"), F.lit("cisco_ios"))


def link_id(a_dev: Column, a_if: Column, b_dev: Column, b_if: Column) -> Column:
    """The same for both directions and any case."""
    ends = [F.lower(F.concat_ws(":", d, i)) for d, i in ((a_dev, a_if), (b_dev, b_if))]
    return F.md5(F.concat_ws("|", F.least(*ends), F.greatest(*ends)))


def view_name(value: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9_]+", "_"), F.lit("_"))


def fingerprint(value: Column, mode: str = "documented") -> Column:
    """Distinct sorted words; mode 'literal' strips capitals before lowering, as older profiles did."""
    text = F.regexp_replace(value, "[^a-z0-9 ]", "") if mode == "literal" else F.regexp_replace(F.lower(value), "[^a-z0-9 ]", "")
    words = F.filter(F.split(F.trim(text), " +"), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def command_slug(value: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(F.trim(value)), "[ /]", "_"), F.lit(60))


def file_slug(value: Column) -> Column:
    """A file name of a command: lower case, all but letters, digits, dots and dashes as one underscore."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9.-]+", "_"), F.lit("_"))


def snapshot_id(at: Column, workspace: str = "unknown") -> Column:
    """snap_20240131_235959_<workspace>."""
    return F.concat(F.lit("snap_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(f"_{workspace}"))


def snapshot_time(value: Column) -> Column:
    """The time in a snapshot's id, null if there is none."""
    return F.try_to_timestamp(F.regexp_extract(value, r"^snap_(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz")


def clean_text(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(value, PAGE_MARK, ""), "\n{3,}", "\n\n")
    return F.btrim(text, F.lit(" \t\n\r"))


def bgp_state(value: Column) -> Column:
    """A summary's last column: a prefix count means Established."""
    return F.when(F.trim(value) == "", "Unknown").when(value.rlike(r"^\d+$"), "Established").otherwise(value)


def ospf_state(value: Column) -> Column:
    title = F.initcap(value)
    return F.when(value.contains("/"), F.upper(value)).when(F.upper(value) == "2WAY", "2-Way").otherwise(title)


def ospf_sound(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(value), "/.*$", ""), "-", "").isin("FULL", "2WAY")


def bgp_unsound(value: Column) -> Column:
    return ~F.lower(value).startswith("established") & ~value.rlike("^[0-9,]+$")


def edge_sound(protocol: Column, status: Column) -> Column:
    return reduce(lambda c, p: c.when(protocol == p, F.lower(status).isin(SOUND[p])), list(SOUND)[1:], F.when(protocol == "l2_cdp", F.lower(status).isin(SOUND["l2_cdp"]))).otherwise(F.lower(status).isin(SOUND["l2_cdp"]))


# The roles that make a device of a kind, and the patterns in a host's name that do.
KIND_ROLES = {"firewall": ["firewall", "fw", "edge-fw"], "router": ["router", "rtr", "border", "core"], "switch": ["switch", "access", "distribution", "dist"]}
KIND_NAMES = {
    "firewall": r"(?i)(?:^|[-_.])(?:fw\d?|firewall|asa|palo|checkpoint)\b",
    "router": r"(?i)(?:^|[-_.])(?:r\d|router|rtr|rt\d|bgp|asr|edge\b|border\b|core\b)",
}


def device_kind(host: Column, role: Column) -> Column:
    """firewall, router or switch: by role, else by the first kind whose pattern the name has, else switch."""
    own = F.lower(F.trim(role))
    by_role = [F.when(own.isin(roles), F.lit(kind)) for kind, roles in KIND_ROLES.items()]
    by_name = [F.when(host.rlike(pattern), F.lit(kind)) for kind, pattern in KIND_NAMES.items()]
    return F.coalesce(*by_role, *by_name, F.lit("switch"))


def rollout_stage(role: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    return F.when(low.contains("access"), 0).when(low.contains("dist"), 1).when(low.contains("wan"), 2).when(low.contains("core"), 3).otherwise(1)


def first_present(*values: Column) -> Column:
    """The first that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def interface_list(value: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(value, ",", " "), r"\s+"), lambda x: x != "")


def _canonical(says: Callable[[str], Column], value: Column) -> Column:
    """The value by the first rule whose kind the field's name says and which has a form for it."""
    text = F.trim(value)
    long = canonical_interface(text)
    address = text.rlike(IP_VALUE) & (ipv4_number(text).isNotNull() | text.contains(":"))
    rules = [
        F.when(says("state") & text.rlike(STATE_VALUE), canonical_state(text)), F.when(says("interface") & (long != text), long), F.when(says("ip") & address, canonical_ip(text)),
        F.when(says("asn") & text.rlike(ASN_VALUE), asn_number(text).cast("string")), F.when(says("mac"), mac_colons(text)),
    ]
    return F.when(F.lower(text).isin(SENTINELS), value).otherwise(F.coalesce(*rules, text, F.lit("")))


def normalised(field: str, value: Column) -> Column:
    """The value of a parsed field in canonical form: state, interface, address, AS number, MAC, or trimmed.

    What the field's name says is tried in this order; a rule that has no form for a value leaves it to the next. Sentinels
    stay as they are, blank is ''.
    """
    return _canonical(lambda kind: F.lit(re.search(rf"(?:^|_)({'|'.join(FIELD_WORDS[kind])})(?:$|_)", field.lower()) is not None), value)


def normalised_by(field: Column, value: Column) -> Column:
    """normalised() for a field whose name is itself a value."""
    return _canonical(lambda kind: F.lower(field).rlike(rf"(?:^|_)({'|'.join(FIELD_WORDS[kind])})(?:$|_)"), value)
