"""Injection detection, redaction and secret masking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of prompt injection.
INJECTION = [
    r"(?i)ignore\s+(all\s+)?(previous|prior)\s+(instructions|rules|prompts)",
    r"(?i)override\s+(system|security|rules|filters)",
    r"(?i)bypass\s+(security|filters|restrictions|safety)",
    r"(?i)act\s+as\s+(admin|developer|system|root)",
    r"(?i)print\s+(system|internal|secret|your)\s+(prompt|instructions|config)",
    r"(?i)reveal\s+(your|the)\s+(prompt|instructions|configuration|system)",
    r"(?i)execute\s+(arbitrary|any|malicious)\s+code",
    r"(?i)disable\s+(safety|security|filters|restrictions)",
    r"(?i)<\s*/?\s*(script|iframe|object|embed)\s*>",
    r"(?i)javascript\s*:",
    r"(?i)data\s*:\s*text/html",
    r"(?i)eval\s*\(",
    r"(?i)exec\s*\(",
    r"(?i)__import__",
    r"(?i)os\.system",
    r"(?i)subprocess\.",
    r"(?i)break\s+(out|free)",
    r"(?i)escape\s+(sandbox|constraints)",
]
# Patterns of secrets, masked in this order.
SECRETS = {
    "api_key": r"""(?i)(api[_-]?key|apikey)\s*[=:]\s*["']?([a-zA-Z0-9_\-]{20,})["']?""",
    "password": r"""(?i)(password|passwd|pwd)\s*[=:]\s*["']?([^\s"']{8,})["']?""",
    "token": r"""(?i)(token|auth[_-]?token)\s*[=:]\s*["']?([a-zA-Z0-9_\-\.]{20,})["']?""",
    "secret": r"""(?i)(secret|private[_-]?key)\s*[=:]\s*["']?([a-zA-Z0-9_\-]{20,})["']?""",
}
# Patterns of dangerous code; the first that matches is the reason.
DANGEROUS = [
    r"os\.system\s*\(",
    r"subprocess\..*shell\s*=\s*True",
    r"eval\s*\(",
    r"exec\s*\(",
    r"__import__\s*\(",
    r"""open\s*\([^)]*['"]\/""",
    r"shutil\.rmtree",
    r"rm\s+-rf",
]


def injection(text: Column, threshold: float = 0.5) -> dict[str, Column]:
    matched = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(p)) for p in INJECTION]))
    confidence = F.least(F.lit(1.0), F.size(matched) / 2.0)
    return {"matched": matched, "confidence": confidence, "flagged": (F.size(matched) > 0) & (confidence >= threshold)}


def redacted(text: Column) -> Column:
    for p in INJECTION:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def masked(text: Column, registered: dict[str, str] | None = None) -> Column:
    """Registered values become [name_hash8], then the patterns' matches [REDACTED_kind]."""
    import hashlib

    for name, value in (registered or {}).items():
        text = F.replace(text, F.lit(value), F.lit(f"[{name}_{hashlib.sha256(value.encode()).hexdigest()[:8]}]"))
    for kind, p in SECRETS.items():
        text = F.regexp_replace(text, p, f"[REDACTED_{kind}]")
    return text


def verdict(text: Column, most: int = 10000) -> Column:
    """The first reason against a text, else an empty string."""
    bad = injection(text)
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(F.length(text) > most, "too long")
        .when(bad["flagged"], F.concat(F.lit("suspicious "), F.format_number(bad["confidence"], 2)))
        .otherwise("")
    )


def without_commands(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\$\([^)]+\)", "[REMOVED]"), "`[^`]+`", "[REMOVED]")


def danger(text: Column) -> Column:
    out = None
    for p in DANGEROUS:
        out = (F if out is None else out).when(text.rlike(p), F.lit(p))
    return out.otherwise("")


def processed(text: Column) -> Column:
    """Struct of what the input pipeline makes of a text: is_safe, processed (empty where an injection is suspected, else with secrets
    masked) and the metadata. A null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    # each is made once: the lambda binds what the struct reads several times
    once = F.array(F.struct(injection(text)["matched"].alias("found"), masked(text).alias("clean")))

    def made(p: Column) -> Column:
        bad = F.size(p["found"]) > 0
        metadata = F.struct(
            bad.alias("injection_detected"),
            F.when(bad, F.least(F.lit(1.0), F.size(p["found"]) / 2)).otherwise(0.0).alias("injection_confidence"),
            p["found"].alias("blocked_patterns"),
            (~bad & (p["clean"] != text)).alias("masked"),
            F.length(text).alias("original_length"),
        )
        return F.struct((~bad).alias("is_safe"), F.when(bad, "").otherwise(p["clean"]).alias("processed"), metadata.alias("metadata"))

    return F.transform(once, made)[0]


def report(counts: DataFrame, secrets: Column) -> DataFrame:
    """One row of storage counts with the state of the guards."""
    on = ["security_active", "injection_protection", "sandbox_enabled"]
    return counts.withColumns({n: F.lit(True) for n in on} | {"secrets_masked": secrets > 0})
