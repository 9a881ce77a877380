"""Places of request addresses from a table of networks.

networks: network (``a.b.c.d/length``), country, city, lat, lon.  The longest network that holds an
address gives its place.  An address meets a network by an equality on (length, leading bits), so
nothing is compared pair by pair; every different address is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS_BITS = 32
PLACE = {"country": "", "city": "", "lat": 0.0, "lon": 0.0}


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a whole number; null for anything else."""
    byte = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    parts = F.split(ip, r"\.")
    number = sum((F.get(parts, F.lit(k)).try_cast("bigint") * 256 ** (3 - k) for k in range(1, 4)), F.get(parts, F.lit(0)).try_cast("bigint") * 256**3)
    return F.when(ip.rlike(rf"^{byte}(\.{byte}){{3}}$"), number)


def leading(number: Column, length: Column) -> Column:
    """The leading ``length`` bits of an address."""
    return F.call_function("shiftright", number, (F.lit(ADDRESS_BITS) - length).cast("int"))


def located(requests: DataFrame, networks: DataFrame, ip: str = "ip", override: str | None = None) -> DataFrame:
    """Adds country, city, lat and lon; an override, where one is given, is the country and leaves the rest empty.

    Unknown, missing and unreadable addresses have the empty place; of equal networks the greatest country stays.
    """
    parts = F.split("network", "/")
    nets = networks.select(F.get(parts, F.lit(1)).try_cast("int").alias("length"), ip_number(F.get(parts, F.lit(0))).alias("number"), F.struct(*PLACE).alias("place"))
    nets = nets.where(F.col("length").between(0, ADDRESS_BITS) & F.col("number").isNotNull()).select("length", leading(F.col("number"), F.col("length")).alias("bits"), "place")
    lengths = sorted(r.length for r in nets.select("length").distinct().collect())  # at most 33
    asked = requests.select(F.col(ip).alias("__ip")).distinct().withColumn("number", ip_number(F.col("__ip"))).where("number is not null")
    tried = asked.select("__ip", "number", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("length"))
    found = tried.select("__ip", "length", leading(F.col("number"), F.col("length")).alias("bits")).join(nets, ["length", "bits"])
    best = found.groupBy("__ip").agg(F.max_by("place", F.struct("length", "place")).alias("__place"))
    own = F.lit(None).cast("string") if override is None else F.nullif(F.col(override), F.lit(""))
    place = {c: F.when(own.isNotNull(), own if c == "country" else F.lit(empty)).otherwise(F.coalesce(f"__place.{c}", F.lit(empty))) for c, empty in PLACE.items()}
    return requests.join(best, requests[ip] == best["__ip"], "left").select(*(requests[c] for c in requests.columns), *(v.alias(c) for c, v in place.items()))
