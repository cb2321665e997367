"""Scopes of addresses and names: tables of networks, evaluated by masks as SQL over the parts of a match."""

from __future__ import annotations

import ipaddress

# Fixed values: (network, scope, least prefix of a subnet that still lies in it; 0: any), asked in this order.
IPV4 = (
    ("192.0.2.0/24", "DOCUMENTATION", 24),
    ("198.51.100.0/24", "DOCUMENTATION", 24),
    ("203.0.113.0/24", "DOCUMENTATION", 24),
    ("10.0.0.0/8", "PRIVATE", 0),
    ("172.16.0.0/12", "PRIVATE", 0),
    ("192.168.0.0/16", "PRIVATE", 0),
    ("127.0.0.0/8", "LOOPBACK", 0),
    ("169.254.0.0/16", "LINK_LOCAL", 0),
    ("100.64.0.0/10", "SHARED", 0),
    ("224.0.0.0/4", "MULTICAST", 0),
    ("0.0.0.0/8", "UNSPECIFIED", 0),
    ("198.18.0.0/15", "RESERVED", 0),
    ("240.0.0.0/4", "RESERVED", 0),
    ("192.0.0.0/24", "RESERVED", 0),
)
IPV6 = (
    ("2001:db8::/32", "DOCUMENTATION", 32),
    ("3ff0::/12", "DOCUMENTATION", 32),
    ("::ffff:0:0/96", "MAPPED", 0),
    ("::/128", "UNSPECIFIED", 0),
    ("::1/128", "LOOPBACK", 0),
    ("fe80::/10", "LINK_LOCAL", 0),
    ("fc00::/7", "PRIVATE", 0),
    ("fec0::/10", "PRIVATE", 0),
    ("ff00::/8", "MULTICAST", 0),
)
# Names that are reserved, and suffixes of private names.
RESERVED_NAMES = r"(?i)(?:^|\.)(?:example\.(?:com|net|org)|example|invalid|test|localhost)$"
PRIVATE_NAMES = r"(?i)\.(?:local|internal|lan|corp|home\.arpa|intranet)$"


def ipv4_scope(number: str, prefix: str = "null") -> str:
    """Scope of an address given as a number, and of a subnet of it where ``prefix`` is not null."""
    cases = []
    for network, scope, least in IPV4:
        net = ipaddress.ip_network(network)
        narrow = f" and coalesce({prefix}, 32) >= {least}" if least else ""
        cases.append(f"when {number} & {int(net.netmask)}L = {int(net.network_address)}L{narrow} then '{scope}'")
    return f"case {' '.join(cases)} else 'PUBLIC' end"


def ipv6_scope(groups: str, prefix: str = "null") -> str:
    """Scope of an address given as an array of eight numbers; one that carries an IPv4 address has its scope."""
    cases = []
    for network, scope, least in IPV6:
        net = ipaddress.ip_network(network)
        parts = [(int(net.netmask) >> 112 - 16 * k & 0xFFFF, int(net.network_address) >> 112 - 16 * k & 0xFFFF) for k in range(8)]
        same = [f"{groups}[{k}] & {mask} = {value}" for k, (mask, value) in enumerate(parts) if mask]
        narrow = [f"coalesce({prefix}, 128) >= {least}"] if least else []
        inner = ipv4_scope(f"(cast({groups}[6] as bigint) * 65536 + {groups}[7])") if scope == "MAPPED" else f"'{scope}'"
        cases.append(f"when {' and '.join(same + narrow)} then {inner}")
    return f"case {' '.join(cases)} else 'PUBLIC' end"


def name_scope(name: str, rlike: str = "{0} rlike {1}") -> str:
    return f"case when {rlike.format(name, _raw(RESERVED_NAMES))} then 'RESERVED_NAME' when {rlike.format(name, _raw(PRIVATE_NAMES))} then 'PRIVATE' else 'PUBLIC' end"


def _raw(s: str) -> str:
    return f"r'{s}'"
