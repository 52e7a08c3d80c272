"""Column functions: ids, times, numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def seconds(ts: Column | str) -> Column:
    return micros(ts) / F.lit(1e6)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID (version 5): SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def first_present(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in columns])


def confidence(x: Column) -> Column:
    """A confidence as given: percentages are scaled, what is above 100 counts as 1, junk as 0.5."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), 0.5).when(v > 100, 1.0).when(v > 1, v / 100).when(v < 0, 0.0).otherwise(v)


def as_list(x: Column) -> Column:
    """A list given as text, parted by semicolons or line ends."""
    return F.filter(F.transform(F.split(x, "[;\n]+"), lambda s: F.trim(s)), lambda s: s != "")
