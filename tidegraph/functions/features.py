"""Feature columns: clipped numbers, one-hot codes, diagnosis chapters, JSON depth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..schema import NODE_TYPES, InvalidRequest

# fixed values: last code of each numeric diagnosis chapter
CHAPTER_ENDS = [139, 239, 279, 289, 319, 389, 459, 519, 579, 629, 679, 709, 739, 759, 779, 799, 999]
# fixed values: spellings of a missing value
MISSING = ("?", "", "None", "NULL", "Unknown/Invalid")


def scaled(c: Column, scale: float) -> Column:
    """min(max(x / scale, 0), 1); what is no number counts 0."""
    return F.greatest(F.least(F.coalesce(F.try_divide(c.try_cast("double"), F.lit(scale)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def one_hot(c: Column, values: list[str], other: bool = True) -> Column:
    """Zeros and a one; a trailing place for anything else, null included."""
    hits = [F.when(c == v, 1.0).otherwise(0.0) for v in values]
    return F.array(*hits, *([F.when(c.isin(*values), 0.0).otherwise(1.0)] if other else []))


def type_one_hot(c: Column) -> Column:
    """Six places by node type; unknown types are all zero."""
    return one_hot(c, NODE_TYPES, other=False)


def chapter_of(c: Column, chapters: list[tuple[int, int]]) -> Column:
    """Which of the inclusive ranges the whole part of a code lies in; then come V codes, E codes and the rest."""
    n = len(chapters)
    code = F.upper(F.trim(c))
    whole = code.try_cast("double").cast("long")
    out = F.when(code.startswith("V"), n).when(code.startswith("E"), n + 1)
    for i, (low, high) in enumerate(chapters):
        out = out.when(whole.between(low, high), i)
    return out.otherwise(n + 2)


def diagnosis_chapter(c: Column) -> Column:
    """Chapter number of a diagnosis code: numeric ranges, then V codes, E codes and the rest."""
    return chapter_of(c, list(zip([1, *(x + 1 for x in CHAPTER_ENDS)], CHAPTER_ENDS)))


def block_width(block: dict) -> int:
    """Places that a block of a feature specification takes."""
    if block["kind"] == "numeric":
        return 1
    if block["kind"] == "onehot":
        return len(block["values"]) + 1
    if block["kind"] == "icd9_chapter":
        return len(block["chapters"]) + 3
    raise InvalidRequest(f"unknown kind of block {block['kind']}")


def featurize(spec: dict, node_type: Column, properties: Column) -> Column:
    """The feature array of a node from its type and the JSON of its properties, as a specification tells.

    One place for each of ``types``, then the blocks in order: ``numeric`` (scaled, clipped), ``onehot``
    (with a place for other values and none) and ``icd9_chapter`` (no place where the code is null). Blocks
    of other node types are zeros, as are all places of an unknown type; null properties count as empty.
    Specifications that read a forbidden field or whose types are not those of the graph raise.
    """
    if list(spec["types"]) != NODE_TYPES:
        raise InvalidRequest("the specification's types are not the graph's")
    require_features([b["field"] for b in spec["blocks"]], set(spec["forbidden_fields"]))
    parts = [type_one_hot(node_type)]
    for block in spec["blocks"]:
        value = F.get_json_object(properties, f"$['{block['field']}']")
        width = block_width(block)
        if block["kind"] == "numeric":
            own = F.array(scaled(value, float(block["scale"])))
        elif block["kind"] == "onehot":
            own = one_hot(F.coalesce(value, F.lit("")), block["values"])
        else:
            at = F.when(value.isNotNull(), chapter_of(value, [(low, high) for _, low, high in block["chapters"]]))
            own = F.array(*[F.when(at == i, 1.0).otherwise(0.0) for i in range(width)])
        parts.append(F.when(node_type == block["for"], own).otherwise(F.array(*[F.lit(0.0)] * width)))
    return F.concat(*parts)


def present(c: Column) -> Column:
    """Not null and none of the spellings of a missing value."""
    return c.isNotNull() & ~F.trim(c).isin(*MISSING)


@F.pandas_udf(IntegerType())
def json_depth(texts: pd.Series) -> pd.Series:
    """Deepest nesting of brackets outside strings."""

    def depth(text: str | None) -> int:
        now = most = 0
        quoted = escaped = False
        for ch in text or "":
            if quoted:
                quoted, escaped = (escaped or ch != '"'), (ch == "\\" and not escaped)
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                now += 1
                most = max(most, now)
            elif ch in "}]":
                now -= 1
        return most

    return texts.map(depth).astype("int32")


def require_features(columns: list[str], forbidden: set[str]) -> list[str]:
    """Features that would leak the label raise."""
    found = sorted(set(columns) & forbidden)
    if found:
        raise InvalidRequest(f"forbidden features {found}")
    return columns
