"""Personal-data masking.

HMAC-SHA256 is built from two nested ``sha2`` calls over binary
concatenations; the padded keys are computed once on the driver and enter
the plan as binary literals, so masking stays inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: str) -> tuple[bytes, bytes]:
    k = key.encode("utf-8")
    if len(k) > _BLOCK:
        k = hashlib.sha256(k).digest()
    k = k.ljust(_BLOCK, b"\x00")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha256_hex(key: str, msg: str) -> str:
    """Driver-side HMAC (salt derivation, tests)."""
    return hmac.new(key.encode("utf-8"), msg.encode("utf-8"), hashlib.sha256).hexdigest()


def hmac_sha256_col(c: Column, key: str) -> Column:
    """HMAC-SHA256 hex digest of a string column with a fixed key."""
    ipad, opad = _pads(key)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), F.encode(c.cast("string"), "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)


def mask_claimant(c: Column) -> Column:
    """every ASCII letter becomes 'x'."""
    return F.regexp_replace(c, "[A-Za-z]", "x")


def mask_policy(c: Column, salt: str) -> Column:
    """F8: keyed pseudonym; NULL and blank stay as they are."""
    return F.when(c.isNull() | (c == F.lit("")), c).otherwise(hmac_sha256_col(c, salt))


@dataclass(frozen=True)
class Salt:
    value: str
    source: str  # "env" | "tenant" | "ephemeral"


def choose_salt(explicit: str = "", master_key: str = "", tenant_id: str = "") -> Salt:
    """explicit salt, else one derived from a master key and tenant, else random per run."""
    if explicit:
        return Salt(explicit, "env")
    if master_key and tenant_id:
        return Salt("v1|" + hmac_sha256_hex(master_key, tenant_id), "tenant")
    return Salt("v1|" + hashlib.sha256(os.urandom(32)).hexdigest(), "ephemeral")


def scrub_name(c: Column, hide: bool = True, audit_salt: str = "") -> Column:
    """file names in audit records: as is, keyed hash, or 'redacted'."""
    if not hide:
        return c
    if audit_salt:
        return hmac_sha256_col(c, audit_salt)
    return F.lit("redacted")

