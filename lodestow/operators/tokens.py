"""Access tokens and receipts: keyed digests of an action, in JVM functions alone (HMAC-SHA256)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestow.functions.scalars import base64url, bytes_be, percent_encode, unbase64url

ACTIONS = ("batch_create", "commit", "create", "delete", "inspect", "read", "write")
MAC_BYTES = 32


def mac(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256; a secret longer than a block is hashed first."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    digest = lambda data: F.unhex(F.sha2(data, 256))
    return digest(F.concat(pad(0x5C), digest(F.concat(pad(0x36), message))))


def _message(action: Column, key: Column, expires: Column) -> Column:
    """Length-prefixed fields, so that no two actions share a message."""
    name = action.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(name).cast("long")), 4, "0")), name, F.unhex(F.lpad(F.hex(F.octet_length(key).cast("long")), 8, "0")), key, F.unhex(F.lpad(F.hex(expires.cast("long")), 16, "0")))


def token(secret: bytes, action: Column, key: Column, expires: Column) -> Column:
    """base64url(expires, big-endian, and the MAC), without padding."""
    return base64url(F.concat(F.unhex(F.lpad(F.hex(expires.cast("long")), 16, "0")), mac(secret, _message(action, key, expires))))


def verified(secret: bytes, text: Column, action: Column, key: Column, now: Column) -> Column:
    """Whether a token decodes, has its length, belongs to the action and has not expired."""
    raw = unbase64url(text)
    expires = F.conv(F.hex(F.substring(raw, 1, 8)), 16, 10).cast("long")
    good = (F.octet_length(raw) == 8 + MAC_BYTES) & (expires > now)
    return F.when(text.rlike(r"^[A-Za-z0-9_-]{54}$"), good & (token(secret, action, key, expires) == text)).otherwise(F.lit(False))


def upload_token(secret: bytes, upload: Column, size: Column) -> Column:
    """base64url(MAC, upload id and size, big-endian): what a writer shows to go on with an upload."""
    data = F.concat(bytes_be(upload, 8), bytes_be(size, 8))
    return base64url(F.concat(mac(secret, data), data))


def opened_upload(secret: bytes, text: Column) -> Column:
    """The struct (upload, size) of a genuine upload token, else null."""
    raw = unbase64url(text)
    data = F.substring(raw, MAC_BYTES + 1, 16)
    good = text.rlike(r"^[A-Za-z0-9_-]{64}$") & (mac(secret, data) == F.substring(raw, 1, MAC_BYTES))
    number = lambda at: F.conv(F.hex(F.substring(data, at, 8)), 16, -10).cast("long")
    return F.when(good, F.struct(number(1).alias("upload"), number(9).alias("size")))


def presigned_url(base: str, key: Column, text: Column) -> Column:
    return F.concat(F.lit(f"{base}/"), percent_encode(key), F.lit("?t="), text)
