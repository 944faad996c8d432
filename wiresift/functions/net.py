"""Column functions over packet fields: addresses, flags, flow hashes, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# TCP flag bits.
SYN, ACK, FIN, RST = 1, 2, 4, 8

# Start value of the 64-bit flow hash, as two 32-bit halves, and
# its multiplier 1099511628211 = 2^40 + 435.
HASH_START = 1469598103934665603
HASH_PRIME_LOW = 435

_MASK32 = 0xFFFFFFFF


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ip_to_string(ip: Column | str) -> Column:
    """Unsigned 32-bit address as a dotted quad."""
    ip = _col(ip)
    octets = [F.shiftright(ip, s).bitwiseAND(F.lit(255).cast("long")) for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def has_flag(bit: int, flags: Column | str = "flags") -> Column:
    return _col(flags).bitwiseAND(F.lit(bit)) != 0


def syn_only(flags: Column | str = "flags") -> Column:
    """SYN set and ACK clear: the first packet of a handshake."""
    return has_flag(SYN, flags) & ~has_flag(ACK, flags)


def payload_contains(needle: bytes, payload: Column | str = "payload_sample") -> Column:
    """Case-sensitive byte search; false for an empty payload."""
    payload = _col(payload)
    return (F.length(payload) > 0) & payload.contains(F.lit(bytearray(needle)))


def port_above(port: int, dst_port: Column | str = "dst_port") -> Column:
    return _col(dst_port) > port


def _bytes_of(value: Column | str, width: int) -> list[Column]:
    v = _col(value).cast("long")
    return [F.shiftright(v, 8 * i).bitwiseAND(F.lit(255).cast("long"))
            for i in reversed(range(width))]


def _start_hash(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_high": F.lit(HASH_START >> 32).cast("long"),
        "_low": F.lit(HASH_START & _MASK32).cast("long"),
    })


def _hash_bytes(df: DataFrame, octets: list[Column]) -> DataFrame:
    """Take some bytes into the 64-bit xor-multiply hash held in _high and _low.

    Multiplying by 2^40 + 435 modulo 2^64 splits into a product by 435 and a
    shift, and with 32-bit halves no step leaves the signed 64-bit range, so
    it also runs under ANSI arithmetic. One projection per byte keeps every
    step compiled; a lambda over an array of bytes is interpreted, and one
    expression for all bytes grows too large to compile well.
    """
    mask = F.lit(_MASK32).cast("long")
    for octet in octets:
        df = df.withColumn("_mixed", F.col("_low").bitwiseXOR(octet))
        product = F.col("_mixed") * HASH_PRIME_LOW
        high = F.col("_high") * HASH_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft("_mixed", 8)
        df = df.withColumns({"_high": high.bitwiseAND(mask), "_low": product.bitwiseAND(mask)})
    return df.drop("_mixed")


def _hex64() -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(half), 8, "0") for half in ("_high", "_low")]))


def with_flow_key(df: DataFrame, name: str = "flow_key", shard_key: str | None = None) -> DataFrame:
    """Add the connection hash, over both addresses and both ports, as 16 hex digits.

    The protocol is not part of it. The source comes first, so the source hash
    is an intermediate state of it and can be had as column ``shard_key``.
    """
    df = _hash_bytes(_start_hash(df), _bytes_of("src_ip", 4))
    if shard_key:
        df = df.withColumn(shard_key, _hex64())
    rest = _bytes_of("dst_ip", 4) + _bytes_of("src_port", 2) + _bytes_of("dst_port", 2)
    return _hash_bytes(df, rest).withColumn(name, _hex64()).drop("_high", "_low")


def with_shard_key(df: DataFrame, name: str = "shard_key") -> DataFrame:
    """Add the source hash as 16 hex digits."""
    return _hash_bytes(_start_hash(df), _bytes_of("src_ip", 4)).withColumn(name, _hex64()).drop("_high", "_low")


def with_shard(df: DataFrame, shards: int, name: str = "shard") -> DataFrame:
    """Add the source hash modulo ``shards``, taken over the two halves."""
    n = F.lit(shards)
    shard = F.pmod(F.pmod("_high", n) * ((1 << 32) % shards) + F.col("_low"), n)
    return _hash_bytes(_start_hash(df), _bytes_of("src_ip", 4)).withColumn(name, shard.cast("int")).drop("_high", "_low")
