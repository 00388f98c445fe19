r"""Arithmetic answers such as ``2*sqrt(2)`` or ``3^2`` evaluated inside Spark.

An operator-precedence parser over an array of tokens: one ``aggregate``
shifts tokens onto a stack of operators and a stack of values, and reduces
while the operator on top binds tighter.  No Python stands in the plan.

Accepted are decimal numbers, ``+ - * / % **`` (``^`` is ``**``), signs,
parentheses, ``pi`` and ``sqrt(..)``, with the usual precedence: a power binds
tighter than a sign before it and is read from the right; a remainder has the
divisor's sign.  Anything else has no value: other names (a lone ``e`` is a
free symbol), two values in a row, a division by zero, a root or power that is
not real, and any number that is not finite on the way.  Arithmetic is double
precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwise.functions.text import bind, py_strip

NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
TOKEN = NUMBER + r"|\*\*|sqrt|pi|[-+*/%()]"
# like 007, which is no decimal number in an expression
ZERO_LED = r"^0[0-9]*[1-9][0-9]*$"
PRECEDENCE = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "u+": 3, "u-": 3, "**": 4}

#: What may come next: an operand, an operator, or the parenthesis of a function.
OPERAND, OPERATOR, CALL = 0, 1, 2


def _state(ops: Column, values: Column, wants: Column, ok: Column) -> Column:
    return F.struct(ops.alias("ops"), values.alias("values"), wants.alias("wants"), ok.alias("ok"))


def _binds(op: Column) -> Column:
    out = F.lit(0)
    for name, rank in PRECEDENCE.items():
        out = F.when(op == name, F.lit(rank)).otherwise(out)
    return out


def _reduce(s: Column) -> Column:
    """The operator on top applied to the values on top."""
    n = F.size(s["values"])
    op, b, a = F.element_at(s["ops"], -1), F.get(s["values"], n - 1), F.get(s["values"], n - 2)
    rest = F.try_mod(a, b)
    rest = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    result = (F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b))
              .when(op == "%", rest).when(op == "**", F.pow(a, b)).when(op == "u-", -b).when(op == "u+", b)
              .when((op == "sqrt") & (b >= 0), F.sqrt(b)))
    left = n - F.when(op.isin("u-", "u+", "sqrt"), 1).otherwise(2)
    real = lambda r: _state(F.slice(s["ops"], F.lit(1), F.size(s["ops"]) - 1),
                            F.array_append(F.slice(s["values"], F.lit(1), F.greatest(left, F.lit(0))), r), s["wants"],
                            s["ok"] & r.isNotNull() & ~F.isnan(r) & (F.abs(r) != float("inf")))
    return bind(result, real)


def _reduce_while(s: Column, condition) -> Column:
    """Reductions as long as ``condition`` holds for the operator on top."""
    steps = F.sequence(F.lit(1), F.size(s["ops"]) + 1)
    go = lambda a: a["ok"] & (F.size(a["ops"]) > 0) & condition(F.get(a["ops"], F.size(a["ops"]) - 1))
    return F.aggregate(steps, s, lambda a, _: F.when(go(a), _reduce(a)).otherwise(a))


def _failed(s: Column) -> Column:
    return _state(s["ops"], s["values"], s["wants"], F.lit(False))


def _with(s: Column, op: Column, wants: int) -> Column:
    return _state(F.array_append(s["ops"], op), s["values"], F.lit(wants), s["ok"])


def _shift(s: Column, token: Column) -> Column:
    operand, operator = s["wants"] == OPERAND, s["wants"] == OPERATOR
    number = F.when(token == "pi", F.pi()).otherwise(token.try_cast("double"))
    value = _state(s["ops"], F.array_append(s["values"], number), F.lit(OPERATOR),
                   s["ok"] & ~token.rlike(ZERO_LED) & (number < float("inf")))
    # a power is read from the right, the others from the left
    tighter = lambda top: (top != "(") & ((_binds(top) > _binds(token)) | ((_binds(top) == _binds(token)) & (token != "**")))
    binary = bind(_reduce_while(s, tighter), lambda a: _with(a, token, OPERAND))

    def closed(a: Column) -> Column:
        """Back to the opening parenthesis, which goes, and the function before it."""
        inner = _state(F.slice(a["ops"], F.lit(1), F.greatest(F.size(a["ops"]) - 1, F.lit(0))), a["values"], F.lit(OPERATOR),
                       a["ok"] & (F.size(a["ops"]) > 0))
        return bind(inner, lambda i: F.when(F.get(i["ops"], F.size(i["ops"]) - 1) == "sqrt", _reduce(i)).otherwise(i))

    close = bind(_reduce_while(s, lambda top: top != "("), closed)
    is_value = token.rlike("^[0-9.p]")
    return (F.when(~s["ok"], s)
            .when(is_value & operand, value)
            .when((token == "(") & (operand | (s["wants"] == CALL)), _with(s, token, OPERAND))
            .when((token == "sqrt") & operand, _with(s, token, CALL))
            .when((token == ")") & operator, close)
            .when(token.isin("+", "-") & operand, _with(s, F.concat(F.lit("u"), token), OPERAND))
            .when(~is_value & ~token.isin("(", ")", "sqrt") & operator, binary)
            .otherwise(_failed(s)))


def expression_value(text: Column) -> Column:
    """Value of an arithmetic expression, or null."""
    empty = _state(F.array().cast("array<string>"), F.array().cast("array<double>"), F.lit(OPERAND), F.lit(True))

    def parsed(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
        # nothing but blanks between the tokens
        whole = (t != "") & (F.array_join(tokens, "") == F.regexp_replace(t, r"[ \t]", ""))
        run = bind(F.aggregate(tokens, empty, _shift), lambda s: _reduce_while(s, lambda top: top != "("))
        return F.when(whole, bind(run, lambda s: F.when(
            s["ok"] & (s["wants"] == OPERATOR) & (F.size(s["ops"]) == 0) & (F.size(s["values"]) == 1), F.get(s["values"], F.lit(0)))))

    return bind(F.replace(py_strip(text), F.lit("^"), F.lit("**")), parsed)
