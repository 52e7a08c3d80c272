"""Text functions on columns: tokens, redaction, descriptions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def tokens(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger word count; 0 where either has none."""
    x, y = tokens(a), tokens(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / most).otherwise(0.0)


def terms(text: Column) -> Column:
    """Distinct runs of three or more letters in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))


MASK = "***REDACTED***"
#: What is masked in text, in this order (pattern, replacement). The last one leaves alone what
#: an earlier one masked.
MASKS = (
    (r"([a-zA-Z][\w+.-]*://)([^:/?#\s]+):([^@/?#\s]+)@", f"$1$2:{MASK}@"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._\-]+", f"Bearer {MASK}"),
    (r"\bhf_[A-Za-z0-9]{10,}\b", MASK),
    (r"\b(sk|pk|key|tok)-[A-Za-z0-9_\-]{8,}\b", MASK),
    (
        r"(?i)\b([\w.-]*(?:password|passwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth)[\w.-]*)\s*[=:]\s*"
        r"""(?!\S*\*\*\*REDACTED|"[^"]*\*\*\*REDACTED|'[^']*\*\*\*REDACTED|bearer(?!\S))("[^"]*"|'[^']*'|[^\s]+)""",
        f"$1={MASK}",
    ),
)
#: Names of fields whose values are masked whole.
SECRET_NAMES = r"(?i)(pass(word)?|secret|token|api[_-]?key|auth|credential|access[_-]?key|private[_-]?key|dsn|database_url|bearer)"


def redact(text: Column) -> Column:
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def redact_value(value: Column, kind: DataType) -> Column:
    """A column of type ``kind`` with all its text redacted, however deep, and the values of secret-named
    fields and map entries masked (where they aren't text, emptied)."""
    if isinstance(kind, StringType):
        return redact(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact_value(x, kind.elementType))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        masked = F.lit(MASK) if isinstance(kind.valueType, StringType) else F.lit(None).cast(kind.valueType)
        return F.transform_values(value, lambda k, v: F.when(k.rlike(SECRET_NAMES), masked).otherwise(redact_value(v, kind.valueType)))
    if isinstance(kind, StructType):
        hidden = lambda f: F.lit(MASK if isinstance(f.dataType, StringType) else None).cast(f.dataType)
        fields = [hidden(f) if re.search(SECRET_NAMES, f.name) else redact_value(value[f.name], f.dataType) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*[c.alias(f.name) for c, f in zip(fields, kind.fields, strict=True)]))
    return value


def redact_fields(fields: Column) -> Column:
    """A map of text with secret-named entries masked and the others' text redacted."""
    return redact_value(fields, MapType(StringType(), StringType()))


def describe_event(event_type: Column, camera: Column, zones: Column, objects: Column, severity: Column) -> Column:
    """What an event is searched by."""
    listed = lambda before, items, after="": F.when(F.size(items) > 0, F.concat(F.lit(before), F.array_join(items, ", "), F.lit(after)))
    seen_by = F.when(camera != "", F.concat(F.lit("at "), camera))
    grave = F.when((severity != "") & (severity != "info"), F.concat(F.lit("severity="), severity))
    return F.concat_ws(" ", F.coalesce(event_type, F.lit("event")), seen_by, listed("[", zones, "]"), listed("objects: ", objects), grave)


def describe_observation(verdict: Column, kind: Column, actions: Column, explanation: Column) -> Column:
    """What a model's observation is searched by."""
    judged = F.when(verdict != "", F.concat(F.lit("verdict: "), verdict))
    acted = F.when(F.size(actions) > 0, F.concat(F.lit("actions: "), F.array_join(actions, ", ")))
    said = F.concat_ws(" ", judged, F.nullif(kind, F.lit("")), acted, F.nullif(F.substring(explanation, 1, 400), F.lit("")))
    return F.coalesce(F.nullif(said, F.lit("")), F.lit("vlm observation"))
