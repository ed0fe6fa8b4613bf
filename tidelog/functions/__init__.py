"""The rule vocabulary as column functions: numbers, comparisons, lists, records, options and folds.

Everything is a Catalyst expression. Numbers are 64-bit and checked: under ANSI mode, Spark's default, overflow and an index out of range are
errors.
"""

from __future__ import annotations

import importlib
import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.schema import EvaluationError

Value = Column | int | str | bool


def _col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _long(x: Value) -> Column:
    return _col(x).cast("bigint")


# numbers
def int_add(a: Value, b: Value) -> Column:
    return _long(a) + _long(b)


def int_mul(a: Value, b: Value) -> Column:
    return _long(a) * _long(b)


def int_neg(a: Value) -> Column:
    return -_long(a)


def int_sub(a: Value, b: Value) -> Column:
    """a + (-b), so subtracting the least number is an error."""
    return int_add(a, int_neg(b))


def int_eq(a: Value, b: Value) -> Column:
    return _long(a) == _long(b)


def is_natural(a: Value) -> Column:
    """a >= 0, from which the other comparisons derive."""
    return _long(a) >= 0


def ge(a: Value, b: Value) -> Column:
    return _long(a) >= _long(b)


def gt(a: Value, b: Value) -> Column:
    return _long(a) > _long(b)


def le(a: Value, b: Value) -> Column:
    return _long(a) <= _long(b)


def lt(a: Value, b: Value) -> Column:
    return _long(a) < _long(b)


def clamp_natural(a: Value) -> Column:
    return F.greatest(_long(a), F.lit(0).cast("bigint"))


def checked(value: Column, condition: Column, message: str) -> Column:
    """``value``, or an error when the row is computed."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def natural_add(a: Value, b: Value) -> Column:
    """A sum of numbers that must not be negative."""
    return checked(int_add(a, b), is_natural(a) & is_natural(b), "a negative number where a natural one is needed")


_WIDTHS = {f"I{n}": (-(1 << n - 1), (1 << n - 1) - 1) for n in (8, 16, 32, 64)} | {f"I{n}+": (0, (1 << min(n, 63)) - 1) for n in (8, 16, 32, 64)}


def in_width(value: Value, width: str) -> Column:
    """``value`` if it fits a fixed width: I8 to I64 signed, I8+ to I64+ not negative (I8+ is 0 to 255, I64+ all that a column can hold)."""
    low, high = _WIDTHS[width]
    v = _long(value)
    return checked(v, (v >= F.lit(low)) & (v <= F.lit(high)), f"a number outside {width}")


# choice and equality
def if_else(condition: Column, then: Value, otherwise: Value) -> Column:
    """A choice; a condition that is null is an error, as only true and false choose."""
    return checked(F.when(condition, _col(then)).otherwise(_col(otherwise)), condition.isNotNull(), "a choice without a truth value")


def tag_eq(a: Value, b: Value) -> Column:
    return _col(a) == _col(b)


user_eq = tag_eq


def identity(x: Value) -> Column:
    return _col(x)


wrap = unwrap = identity
data_id = event_id = event_type_id = timestamp = identity


def user_id(n: Value) -> Column:
    return _long(n)


def pair(key: Value, value: Value) -> Column:
    return F.struct(_col(key).alias("k"), _col(value).alias("v"))


def unit() -> Column:
    return F.struct(F.lit(True).alias("unit"))


# lists
def list_of(*items: Value) -> Column:
    return F.array(*map(_col, items))


def list_length(xs: Column) -> Column:
    return checked(F.size(xs).cast("bigint"), xs.isNotNull(), "the length of no list")


def list_index(xs: Column, i: Value) -> Column:
    """The item at a 0-based place; outside the list is an error."""
    return checked(F.get(xs, _col(i).cast("int")), (_col(i) >= 0) & (_col(i) < F.size(xs)), "an index outside the list")


def list_view(xs: Column) -> Column:
    """{left: the first item, rest: the others}; an empty list is an error."""
    parts = F.struct(F.get(xs, F.lit(0)).alias("left"), F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))).alias("rest"))
    return checked(parts, F.size(xs) > 0, "the head of an empty list")


def fold_left(xs: Column, start: Value, f: Callable[[Column, Column], Column]) -> Column:
    """f(... f(f(start, x0), x1) ..., xn)."""
    return F.aggregate(xs, _col(start), f)


def fold_right(xs: Column, start: Value, f: Callable[[Column, Column], Column]) -> Column:
    """f(x0, f(x1, ... f(xn, start)))."""
    return F.aggregate(F.reverse(xs), _col(start), lambda acc, x: f(x, acc))


def count_up(n: Value) -> Column:
    """0, 1, ... n-1; empty for 0 and below."""
    n = _long(n)
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def loop_times(n: Value, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The state after f(state, i) for i in 0..n-1: a loop whose number of rounds is known beforehand."""
    return F.aggregate(count_up(n), start, f)


def loop(start, step: Callable, most: int | None = None):
    """General recursion on plain values: step(again, state), where again(state) goes round once more. It ends when a step doesn't go on, or with an
    error after ``most`` rounds where that is given."""
    again = type("Again", (tuple,), {})
    state = start
    for _ in itertools.count() if most is None else range(most):
        out = step(lambda s: again((s,)), state)
        if not isinstance(out, again):
            return out
        state = out[0]
    raise EvaluationError(f"a loop of more than {most} rounds")


def loop_column(state: Column, step: Callable, kind: str) -> Column:
    """General recursion for every row: ``step(again, state)`` as in ``loop`` on each value, a dict where it is a struct. What no expression can say, so it runs
    in Python, in Arrow batches."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else loop(v, step) for v in values.to_pylist()], arrow)

    arrow = to_arrow_type(T.DataType.fromDDL(kind))
    return run(state)


# records
def record(**fields: Value) -> Column:
    return F.struct(*[_col(v).alias(k) for k, v in fields.items()])


def record_get(r: Column, name: str) -> Column:
    return r.getField(name)


def record_concat(left: Column, left_names: list[str], right: Column, right_names: list[str]) -> Column:
    """The fields of both; of a name in both the left one."""
    return F.struct(*[left[n].alias(n) for n in left_names], *[right[n].alias(n) for n in right_names if n not in left_names])


def record_keep(r: Column, *names: str) -> Column:
    return F.struct(*[r[n].alias(n) for n in names])


def record_drop(r: Column, *names: str) -> Column:
    return r.dropFields(*names)


# options are records {has, body}; the body may itself be null
def none(kind: str = "bigint") -> Column:
    return F.struct(F.lit(False).alias("has"), F.lit(None).cast(kind).alias("body"))


def some(x: Value) -> Column:
    return F.struct(F.lit(True).alias("has"), _col(x).alias("body"))


def some_if(condition: Column, x: Value) -> Column:
    """``x`` where the condition holds, else nothing."""
    holds = F.coalesce(condition, F.lit(False))
    return F.struct(holds.alias("has"), F.when(holds, _col(x)).alias("body"))


def some_of(x: Value) -> Column:
    """A nullable value as an option: null is nothing."""
    return some_if(_col(x).isNotNull(), x)


def opt_unwrap(x: Column, default: Value) -> Column:
    return F.when(x["has"], x["body"]).otherwise(_col(default))


# characters
def char_slice(text: Column, low: Value, high: Value) -> Column:
    """Characters [low, high) of a text, counted in Unicode scalars."""
    return F.substring(text, _col(low).cast("int") + 1, F.greatest(_col(high).cast("int") - _col(low).cast("int"), F.lit(0)))


_REGISTRY: dict[str, Callable] = {
    "DataId": data_id,
    "Id": identity,
    "EventTypeId": event_type_id,
    "LocEventId": event_id,
    "Timestamp": timestamp,
    "UserId": user_id,
    "_*_": int_mul,
    "_++_": natural_add,
    "_+_": int_add,
    "_-_": int_sub,
    "_<=_": le,
    "_<_": lt,
    "_=>_": pair,
    "_>=_": ge,
    "_>_": gt,
    "id": identity,
    "if": if_else,
    "int-clamp>int+": clamp_natural,
    "int_==": int_eq,
    "int_>=0": is_natural,
    "int_add": int_add,
    "int_mul": int_mul,
    "int_neg": int_neg,
    "iter_<": count_up,
    "iter_list": F.explode,
    "list_indexl": list_index,
    "list_length": list_length,
    "list_viewl": list_view,
    "loop": loop,
    "loop_iter": fold_left,
    "mk_none": none,
    "mk_some": some,
    "mk_some_if": some_if,
    "opt_unwrap": opt_unwrap,
    "record_drop_fields": record_drop,
    "record_get": record_get,
    "record_keep_fields": record_keep,
    "tag_==": tag_eq,
    "unit": unit,
    "user_eq": user_eq,
    "w_unwrap": unwrap,
    "w_wrap": wrap,
}


#: Names of what isn't a column function: rules, logs, folds and text.
_ELSEWHERE = {
    "Gear": "operators.gears:Gear",
    "Query": "sources.log:delta_since",
    "StateGraph": "operators.stategraph:fold",
    "StateGraphOut": "operators.timeline:last",
    "anchor_agg_apply": "operators.text:anchors",
    "mk_anchor_agg": "operators.text:Tree",
    "mk_event_type": "schema:EventTypes",
    "mk_gear": "operators.gears:Gear",
    "mk_query": "sources.log:change_feed",
    "mk_stategraph": "operators.stategraph:Context",
    "mk_text_agg": "operators.text:apply_texts",
    "query_delta": "sources.log:delta_since",
    "resolve_data": "sources.log:resolve",
    "resolve_event": "sources.log:resolve_event",
    "secondary_get": "operators.gears:Gears",
    "sender-to>user": "sources.log:resolve",
    "sgctx_dep_query": "operators.stategraph:depend",
    "sgctx_query": "operators.timeline:own_before",
    "sgctx_update": "operators.timeline:insert",
    "stategraph_apply": "operators.stategraph:replay",
    "stategraph_out": "operators.stategraph:fold",
    "text_agg_apply": "operators.text:apply_texts",
    "text_agg_merge": "operators.text:merge",
}


def names() -> list[str]:
    """All names of the rule language, in order."""
    return sorted({*_REGISTRY, *_ELSEWHERE})


def lookup(name: str) -> Callable:
    """A function by its name in the rule language."""
    if name in _ELSEWHERE:
        module, _, attribute = _ELSEWHERE[name].partition(":")
        return getattr(importlib.import_module(f"tidelog.{module}"), attribute)
    try:
        return _REGISTRY[name]
    except KeyError:
        raise EvaluationError(f"no function {name}") from None
