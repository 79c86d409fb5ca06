"""Whether an address may be fetched from: only globally routable unicast ones."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blocked(address: str | None) -> bool:
    """True for anything but a global unicast address; mapped IPv4 addresses count as what they map."""
    try:
        ip = ipaddress.ip_address((address or "").strip().strip("[]"))
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not ip.is_global or ip.is_multicast


@F.pandas_udf(T.BooleanType())
def blocked_udf(address: pd.Series) -> pd.Series:
    return address.map(blocked)
