import pytest
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog.schema import EvaluationError


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers(spark):
    assert value(spark, fn.int_add(40, 2)) == 42 and value(spark, fn.int_sub(1, 3)) == -2
    for bad in (fn.int_add(2**63 - 1, 1), fn.int_mul(2**62, 2), fn.int_neg(F.lit(-(2**63))), fn.in_width(256, "I8+"), fn.in_width(-129, "I8"), fn.natural_add(-1, 2)):
        with pytest.raises(Exception):
            value(spark, bad)
    assert value(spark, fn.in_width(255, "I8+")) == 255 and value(spark, fn.in_width(2**62, "I64+")) == 2**62
    assert value(spark, fn.clamp_natural(-5)) == 0 and value(spark, fn.natural_add(1, 2)) == 3
    assert [value(spark, f(1, 2)) for f in (fn.ge, fn.gt, fn.le, fn.lt, fn.int_eq)] == [False, False, True, True, False]


def test_choice_and_options(spark):
    assert value(spark, fn.if_else(F.lit(True), 1, 0)) == 1
    with pytest.raises(Exception):
        value(spark, fn.if_else(F.lit(None).cast("boolean"), 1, 0))
    assert value(spark, fn.opt_unwrap(fn.some_if(F.lit(False), 1), 7)) == 7
    assert value(spark, fn.opt_unwrap(fn.some(3), 7)) == 3 and value(spark, fn.opt_unwrap(fn.none(), 7)) == 7 and value(spark, fn.none()).has is False
    assert value(spark, fn.opt_unwrap(fn.some_of(F.lit(None).cast("bigint")), 7)) == 7 and value(spark, fn.opt_unwrap(fn.some(F.lit(None).cast("bigint")), 7)) is None


def test_lists(spark):
    xs = fn.list_of(3, 4, 5)
    assert value(spark, xs) == [3, 4, 5] and value(spark, fn.list_length(xs)) == 3 and value(spark, fn.list_index(xs, 2)) == 5
    v = value(spark, fn.list_view(xs))
    assert (v.left, v.rest) == (3, [4, 5])
    for bad in (fn.list_index(xs, 3), fn.list_index(xs, -1), fn.list_view(F.array().cast("array<int>")), fn.list_length(F.lit(None).cast("array<int>"))):
        with pytest.raises(Exception):
            value(spark, bad)
    words = F.array(*map(F.lit, "abc"))
    assert value(spark, fn.fold_left(words, "", lambda a, x: F.concat(a, x))) == "abc"
    assert value(spark, fn.fold_right(words, "", lambda x, a: F.concat(a, x))) == "cba"
    assert value(spark, fn.count_up(3)) == [0, 1, 2] and value(spark, fn.count_up(0)) == []


def test_loops_and_records(spark):
    assert fn.loop((6, 1), lambda again, s: s[1] if s[0] == 0 else again((s[0] - 1, s[1] * s[0]))) == 720
    assert value(spark, fn.loop_times(F.lit(6), F.lit(1).cast("bigint"), lambda acc, i: acc * (i + 1))) == 720
    with pytest.raises(EvaluationError):
        fn.loop(0, lambda again, s: again(s), most=5)
    r = fn.record_concat(fn.record(a=1, b=2), ["a", "b"], fn.record(b=9, c=3), ["b", "c"])
    assert value(spark, r).asDict() == {"a": 1, "b": 2, "c": 3}
    assert value(spark, fn.record_drop(r, "b")).asDict() == {"a": 1, "c": 3} and value(spark, fn.record_keep(r, "c")).asDict() == {"c": 3}
    assert value(spark, fn.char_slice(F.lit("Привет"), 1, 3)) == "ри"
    assert fn.lookup("int_add") is fn.int_add
    assert all(callable(fn.lookup(name)) for name in fn.names())
    with pytest.raises(EvaluationError):
        fn.lookup("nothing")
