"""URLs, signatures and request headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE_SECONDS = 3600
BLOCK_BYTES = 64
#: scheme, authority, path, rest.
_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(.*)$"


def canonical_url(url: Column) -> Column:
    """Repeated schemes dropped, scheme and host in lower case, slashes at the path's end removed."""
    once = F.regexp_replace(F.regexp_replace(url, "^(?:https://)+(?=https://)", ""), "^(?:http://)+(?=http://)", "")
    part = lambda k: F.regexp_extract(once, _URL, k)
    scheme, host = part(1), part(2)
    return F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), F.lower(host))).otherwise(""), F.regexp_replace(part(3), "/+$", ""), part(4))


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def query_payload(params: Column) -> Column:
    """A map's entries as a query string in order of its keys."""
    entries = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def hmac_sha256(payload: Column, secret: str) -> Column:
    """Hexadecimal HMAC-SHA256 with a fixed secret."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK_BYTES else key).ljust(BLOCK_BYTES, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, payload.cast("binary")), 256))), 256)


def verified(params: Column, secret: str, now_ms: Column) -> Column:
    """Whether a signed parameter map is untouched and not too old; a time in the future passes."""
    rest = F.map_filter(params, lambda k, v: k != "sig")
    stamp = params["ts"].try_cast("bigint")
    return F.coalesce((hmac_sha256(query_payload(rest), secret) == params["sig"]) & (now_ms - stamp <= SIGNATURE_SECONDS * 1000), F.lit(False))


def is_ip(s: Column) -> Column:
    byte = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return s.rlike(rf"^{byte}(?:\.{byte}){{3}}$") | (s.contains(":") & s.rlike(r"^[0-9a-fA-F:.]+$"))


def client_ip(forwarded: Column, real: Column, remote: Column) -> Column:
    """The first forwarded address, else the proxy's, else the peer's; empty if none is valid."""
    first = F.trim(F.split(forwarded, ",")[0])
    peer = F.regexp_extract(remote, r"^\[?(.*?)\]?:\d+$", 1)
    return F.coalesce(F.when(is_ip(first), first), F.when(is_ip(real), real), F.when(is_ip(peer), peer), F.lit(""))


def device(user_agent: Column) -> Column:
    return F.when(F.lower(user_agent).contains("mobile"), "mobile").otherwise("desktop")


#: Ordered (pattern, family): the first that matches tells the operating system.
OS_FAMILIES = (("Windows Phone", "Windows Phone"), ("Windows", "Windows"), ("iPhone|iPad|iPod", "iOS"), ("Android", "Android"), ("Mac OS X|Macintosh", "Mac OS X"), ("CrOS", "Chrome OS"), ("Ubuntu", "Ubuntu"), ("Linux", "Linux"))


def os_family(user_agent: Column) -> Column:
    out = F.lit("Other")
    for pattern, name in reversed(OS_FAMILIES):
        out = F.when(user_agent.rlike(pattern), name).otherwise(out)
    return out


def language(accept: Column) -> Column:
    first = F.trim(F.split(accept, ",")[0])
    return F.when(F.length(first) >= 2, F.substring(first, 1, 2)).otherwise(F.lit("en"))
