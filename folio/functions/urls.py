"""Which base addresses a model client may call: public http(s) only, or this machine only."""

from __future__ import annotations

import ipaddress
import re
import socket
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_NAMES = frozenset({"localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "127.0.0.1", "::1", "0.0.0.0"})


def numeric(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that ``host`` spells: plain, decimal, hexadecimal, octal or with parts left out; None for a name."""
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        pass
    try:
        return ipaddress.IPv4Address(socket.inet_aton(host))
    except (OSError, ValueError):
        pass
    try:
        value = int(host, 0)
    except ValueError:
        return None
    return ipaddress.IPv4Address(value) if 0 <= value < 1 << 32 else None


def internal(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    own = getattr(address, "ipv4_mapped", None) or address
    return any((own.is_private, own.is_loopback, own.is_link_local, own.is_unspecified, own.is_multicast))


def refusal(url: str | None) -> str | None:
    """Why ``url`` may not be called, None where it may."""
    try:
        parts = urlsplit((url or "").rstrip("/"))
        host = unquote(parts.hostname or "")
    except ValueError:
        return "malformed"
    if parts.scheme not in ("http", "https"):
        return "scheme"
    if not host:
        return "no host"
    if host.lower().rstrip(".") in LOCAL_NAMES:
        return "local name"
    address = numeric(host)
    return "internal address" if address is not None and internal(address) else None


def checked_url(url: str) -> str:
    if why := refusal(url):
        raise ValueError(f"base address {url!r} refused: {why}")
    return re.sub(r"/+\Z", "", url)


def checked_local_url(url: str) -> str:
    """For a model server on this machine."""
    if urlsplit(url).hostname not in ("localhost", "127.0.0.1", "::1"):
        raise ValueError(f"model server {url!r} isn't on this machine")
    return url


@F.pandas_udf(T.BooleanType())
def url_allowed(url: pd.Series) -> pd.Series:
    return url.map(lambda u: refusal(u) is None)
