"""Statistical value types: what functions take, what they give back.

The rules are data: for each function the accepted combinations of operand
types with the resulting type, and whose value labels survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from .errors import InvalidValueTypeError

BINARY, CONTINUOUS, DISCRETE, ORDINAL, NOMINAL = "binary", "continuous", "discrete", "ordinal", "nominal"
DATETIME, COORDS, GEOMETRY = "datetime", "coords", "geometry"
ALL = (BINARY, CONTINUOUS, DISCRETE, NOMINAL, ORDINAL, COORDS, DATETIME)
NUMERIC = (CONTINUOUS, DISCRETE)

#: Labels of the result: none, those of the first or those of the second operand.
NO_LABELS, FIRST_LABELS, SECOND_LABELS = 0, 1, 2

Rule = tuple[dict[tuple[str, ...], str], int]


def _same(types: Sequence[str], labels: int = NO_LABELS) -> Rule:
    return {(t,): t for t in types}, labels


def _to(result: str, types: Sequence[str], labels: int = NO_LABELS) -> Rule:
    return {(t,): result for t in types}, labels


def _pairs(result: str, groups: Sequence[Sequence[str]], labels: int = NO_LABELS) -> Rule:
    """All pairs within each group give `result`."""
    return {(a, b): result for group in groups for a in group for b in group}, labels


def _mixed(labels: int = NO_LABELS) -> Rule:
    """Two discrete operands stay discrete, any other numeric pair is continuous."""
    return {(a, b): DISCRETE if a == b == DISCRETE else CONTINUOUS for a in NUMERIC for b in NUMERIC}, labels


def _rules() -> dict[str, Rule]:
    """The promotion table."""
    equality = [(BINARY,), NUMERIC, (NOMINAL,), (ORDINAL,), (COORDS,), (DATETIME,)]
    order = [(BINARY,), NUMERIC, (ORDINAL,), (DATETIME,)]
    table: dict[str, Rule] = {
        "not": _same([BINARY], FIRST_LABELS),
        "is_missing": _to(BINARY, ALL),
        "not_missing": _to(BINARY, ALL),
        "absolute": _same(NUMERIC),
        "ceiling": _to(DISCRETE, NUMERIC),
        "floor": _to(DISCRETE, NUMERIC),
        "add": ({(BINARY, BINARY): DISCRETE} | _mixed()[0], NO_LABELS),
        "divide": _pairs(CONTINUOUS, [NUMERIC]),
        "normalized_difference": _pairs(CONTINUOUS, [NUMERIC]),
        "intersects": ({(COORDS, COORDS): BINARY, (COORDS, GEOMETRY): BINARY}, NO_LABELS),
        "mean": _to(CONTINUOUS, NUMERIC),
        "median": _to(CONTINUOUS, NUMERIC),
        "standard_deviation": _to(CONTINUOUS, NUMERIC),
        "variance": _to(CONTINUOUS, NUMERIC),
        "mode": _same(ALL, FIRST_LABELS),
        "max": _same([BINARY, CONTINUOUS, DISCRETE, ORDINAL, DATETIME], FIRST_LABELS),
        "min": _same([BINARY, CONTINUOUS, DISCRETE, ORDINAL, DATETIME], FIRST_LABELS),
        "range": ({(CONTINUOUS,): CONTINUOUS, (DISCRETE,): DISCRETE, (DATETIME,): CONTINUOUS}, NO_LABELS),
        "n": _to(DISCRETE, ALL),
        "product": _same(NUMERIC),
        "sum": _same([BINARY, CONTINUOUS, DISCRETE]),
        "count": _to(DISCRETE, [BINARY]),
        "percentage": _to(CONTINUOUS, [BINARY]),
        "first": _same([t for t in ALL if t != COORDS], FIRST_LABELS),
        "last": _same(ALL, FIRST_LABELS),
        "assign": ({(a, b): b for a in ALL for b in ALL}, SECOND_LABELS),
        "assign_at": ({(t, t): t for t in ALL} | {(CONTINUOUS, DISCRETE): CONTINUOUS, (DISCRETE, CONTINUOUS): CONTINUOUS}, NO_LABELS),
    }
    for name in ("cosine", "cosecant", "cotangent", "cube_root", "exponential", "natural_logarithm", "secant", "sine", "square_root", "tangent", "to_degrees", "to_radians"):
        table[name] = _to(CONTINUOUS, NUMERIC)
    for name in ("multiply", "power", "subtract"):
        table[name] = _mixed()
    for name in ("and", "or", "exclusive_or"):
        table[name] = _pairs(BINARY, [(BINARY,)], FIRST_LABELS)
    for name in ("equal", "not_equal", "in", "not_in"):
        table[name] = _pairs(BINARY, equality)
    for name in ("greater", "greater_equal", "less", "less_equal"):
        table[name] = _pairs(BINARY, order)
    for name in ("after", "before", "during"):
        table[name] = _pairs(BINARY, [(DATETIME,)])
    for name in ("all", "any", "none"):
        table[name] = _same([BINARY], FIRST_LABELS)
    return table


RULES = _rules()


def candidates(value: object) -> tuple[str, ...]:
    """Types that a plain Python constant may have, the likeliest first."""
    import datetime

    if isinstance(value, bool):
        return (BINARY,)
    if isinstance(value, int):
        return (DISCRETE, ORDINAL, NOMINAL, CONTINUOUS, BINARY) if value in (0, 1) else (DISCRETE, ORDINAL, NOMINAL, CONTINUOUS)
    if isinstance(value, float):
        return (CONTINUOUS,)
    if isinstance(value, str):
        return (NOMINAL, ORDINAL)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return (DATETIME,)
    if isinstance(value, (list, tuple, set, frozenset)):
        own = [candidates(v) for v in value if v is not None]
        return tuple(t for t in own[0] if all(t in o for o in own)) if own else ALL
    return ALL


def resolve(function: str, *operands: Sequence[str], manual: dict[str, Rule] | None = None) -> tuple[str | None, int]:
    """Result type and label rule of `function`, or InvalidValueTypeError.

    Each operand comes as its possible types.  If the first has one type and
    the second may share it, that pair is preferred.
    """
    rules = RULES | (manual or {})
    if function not in rules:  # a custom function without rules is not checked
        return None, NO_LABELS
    accepted, labels = rules[function]
    options: list[tuple[str, ...]] = [()]
    for types in operands:
        options = [(*o, t) for o in options for t in types]
    if len(operands) == 2 and len(operands[0]) == 1 and operands[0][0] in operands[1]:
        options.insert(0, (operands[0][0], operands[0][0]))
    for option in options:
        if option in accepted:
            return accepted[option], labels
    raise InvalidValueTypeError(f"{function!r} doesn't take operands of type {' and '.join('/'.join(o) for o in operands)}")
