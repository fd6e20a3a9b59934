"""The same scalars for driver-side code and kernels."""

from __future__ import annotations

import hashlib


def fingerprint(secret: str) -> str:
    return hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def mask(secret: str) -> str:
    keep = min(2 if len(secret) <= 12 else 6, max(len(secret) // 4, 1))
    return f"{secret[:keep]}…({len(secret)} chars)"


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1000:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1000
    return f"{n:.1f} TB"
