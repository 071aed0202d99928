"""Tables, types and input checks of the temporal graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: edge types, model kinds and commit paths by number; node types in one-hot order
EDGE_TYPES = {1: "DIAGNOSED_WITH", 2: "PRESCRIBED_MEDICATION", 3: "UNDERWENT_PROCEDURE", 4: "TREATED_BY_PROVIDER", 5: "HAS_LAB_RESULT", 6: "HAS_ENCOUNTER"}
MODEL_KINDS = {1: "GraphSAGE", 2: "GCN", 3: "GAT"}
PATHS = {1: "associative", 2: "gat_constrained", 3: "fallback", 4: "non_associative"}
NODE_TYPES = ["Patient", "Condition", "Medication", "Provider", "LabResult", "Encounter"]
NAMESPACES = {"Patient": 1, "Condition": 100_000, "Medication": 200_000, "Procedure": 300_000, "Provider": 400_000, "LabResult": 500_000, "Encounter": 600_000}
NEWEST = 2**63 - 1
MAX_JSON_BYTES, MAX_JSON_DEPTH, MAX_SKEW_US = 64 * 1024, 32, 300_000_000

NODE_VERSIONS = "node_id long, ts long, seq long, node_type string, properties string, deleted boolean"
EDGE_VERSIONS = "src long, edge_type int, dst long, ts long, seq long, properties string, deleted boolean"
EMBEDDING_VERSIONS = "node_id long, ts long, seq long, vector array<float>, model_id string, model_kind int, computation_path int"
COMMIT_META = "node_id long, ts long, seq long, model_id string, computation_path int, attribution struct<top:array<struct<src:long,dst:long,value:double>>,rest_sum:double,rest_count:long>"
REPAIR_MARKERS = "node_id long, ts long, reason string, model_id string"
TRACE = "op string, node_id long, node_type string, src long, dst long, edge_type int, timestamp_us long, properties string"


class GraphError(Exception):
    """Base of the engine's errors."""


class InvalidRequest(GraphError):
    """A request that no retry can make valid."""


class Aborted(GraphError):
    """A write that lost its place in time; a newer timestamp may be accepted."""


class Unavailable(GraphError):
    """State that is not there yet."""


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def edge_type_name(c: Column) -> Column:
    return F.create_map(*[x for k, v in EDGE_TYPES.items() for x in (F.lit(k), F.lit(v))])[c]


def require_edge_type(c: Column) -> Column:
    """The type itself; unknown ones raise."""
    return F.when(c.isin(*EDGE_TYPES), c).otherwise(F.raise_error(F.concat(F.lit("unknown edge type "), c.cast("string"))).cast("int"))


def require_model_kind(kind: int) -> int:
    """Deployed kinds only: the second is declared but never deployed."""
    if kind not in MODEL_KINDS or kind == 2:
        raise InvalidRequest(f"model kind {kind} is not deployed")
    return kind


def clamp_limit(asked: int, default: int, most: int) -> int:
    """0 asks for the default; anything else is at most ``most``."""
    return default if asked == 0 else min(asked, most)


def clamp_k(k: int) -> int:
    """Top-k sizes: 0 means 10, more than 1000 is refused."""
    if k > 1000 or k < 0:
        raise InvalidRequest("k must be 0 to 1000")
    return k or 10


def timestamp_allowed(ts: Column, now: Column) -> Column:
    """0 (assigned later) or no more than five minutes ahead."""
    return (ts == 0) | (ts <= now + MAX_SKEW_US)


def valid_name(c: Column) -> Column:
    """Checkpoint names: 1 to 64 of letters, digits, dot, underscore, minus, not beginning with a dot."""
    return c.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,63}$")


def reject_wide_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Negative ids (2**63 and above in unsigned form) raise."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} out of range")).cast("long")).otherwise(F.col(c)))
    return df
