"""Answer normalisation, number parsing and boxed-answer extraction.

Everything is a Catalyst expression.  Multi-step normalisations are exposed
as DataFrame transforms that add one column per step, so the optimizer keeps
each (regex-heavy) step as a single evaluated expression instead of inlining
copies of it.  Each Spark builder has a DuckDB twin (``*_sql``) for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.text import bind, py_strip, py_strip_sql

# ---- fixed values ---------------------------------------------------------
BOXED_WRAPPER = r"\\boxed\s*\{([^{}]*)\}"
ANSWER_HASH = r"(?is)##answer\s*:\s*(.*?)\s*##"
ANSWER_TAG = r"(?is)#answer#\s*:\s*(.*)$"
ASSIGNMENT = r"^[a-zA-Z]\w*\s*=\s*(.+)$"
LATEX_FRACTION = r"\\(?:dfrac|tfrac|frac)\s*\{([^{}]+)\}\s*\{([^{}]+)\}"
PLAIN_NUMBER = r"^[+-]?(?:\d+\.\d*|\d*\.\d+|\d+)(?:[eE][+-]?\d+)?$"
# a/b as a fraction string: the denominator carries no sign
RATIO = r"^([+-]?\d+)/(\d+)$"
PAREN_RATIO = r"^\(([+-]?\d+)\)/\(([+-]?\d+)\)$"
UNICODE_MINUS, FULLWIDTH_COMMA = "\u2212", "\uff0c"
TRAILING_PERIODS = "[\u3002.]+$"
LATEX_COMMAND_ARG = r"\\[a-zA-Z]+\{([^}]*)\}"
BOX_OPEN = "\\boxed{"
ABS_TOL = 1e-9
REL_TOL = 1e-9

_MARK = "\ue000"  # stands in for an opening "\boxed{" while scanning


# ---- wrapper stripping ----------------------------------------------------

def _extract_if(s: Column, pattern: str, needs: str) -> Column:
    """Replace by the stripped group when the pattern matches.

    ``needs`` is a character every match contains: rows without it skip the
    regex work (a cheap, exact pre-check).
    """
    return bind(s, lambda x: F.when(F.instr(x, needs) > 0,
                                    F.when(x.rlike(pattern), py_strip(F.regexp_extract(x, pattern, 1))).otherwise(x))
                .otherwise(x))


def strip_wrappers(s: Column) -> Column:
    """The answer with markdown/LaTeX wrappers removed.

    Order: strip; unicode minus and full-width comma; strip spaces; drop
    '$'; unwrap \\boxed{..}; drop \\left / \\right; take the body of
    ``##answer: .. ##`` then of ``#answer#: ..``; the right side of
    ``name = ..``; drop trailing periods; strip.
    """
    a = py_strip(s.cast("string"))
    a = F.replace(F.replace(a, F.lit(UNICODE_MINUS), F.lit("-")), F.lit(FULLWIDTH_COMMA), F.lit(","))
    a = F.regexp_replace(a, "^ +| +$", "")
    a = F.regexp_replace(F.replace(a, F.lit("$"), F.lit("")), BOXED_WRAPPER, "$1")
    a = F.replace(F.replace(a, F.lit("\\left"), F.lit("")), F.lit("\\right"), F.lit(""))
    a = _extract_if(_extract_if(a, ANSWER_HASH, "#"), ANSWER_TAG, "#")
    a = _extract_if(a, "(?d)" + ASSIGNMENT, "=")
    return py_strip(F.regexp_replace(a, TRAILING_PERIODS, ""))


def strip_wrappers_steps(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Add ``dst`` = ``src`` with its wrappers removed."""
    return df.withColumn(dst, strip_wrappers(F.col(src)))


def fractions_to_plain(s: Column) -> Column:
    r"""\frac{a}{b} -> (a)/(b), innermost first, repeated to a fixed point.

    Each pass rewrites every brace-free fraction; the number of passes is
    bounded by the number of "frac" occurrences.
    """
    def body(x):
        n = ((F.length(x) - F.length(F.replace(x, F.lit("frac"), F.lit("")))) / 4).cast("int")
        looped = F.aggregate(F.sequence(F.lit(1), n), x,
                             lambda acc, _: F.regexp_replace(acc, LATEX_FRACTION, "($1)/($2)"))
        return F.when(F.instr(x, "frac") > 0, F.when(n > 0, looped).otherwise(x)).otherwise(x)
    return bind(s, body)


def _normalised(s: Column) -> Column:
    """The whole normalisation, done again after each trailing '%' that is cut off."""
    return F.replace(fractions_to_plain(strip_wrappers(s)), F.lit(" "), F.lit(""))


def number_from_normalised(df: DataFrame, norm: str, dst: str, src: str | None = None,
                           frac_col: str | None = None) -> DataFrame:
    """Add ``dst`` = numeric value of an already wrapper-stripped column ``norm``.

    ``frac_col`` (optional) keeps the fraction-rewritten text, which is the
    input of the symbolic fallback.  ``src`` is the raw answer: blank raw
    answers have no value.
    """
    t = f"_{dst}_t"
    frac = fractions_to_plain(F.col(norm))
    if frac_col:
        df = df.withColumn(frac_col, frac)
        frac = F.col(frac_col)
    df = df.withColumn(t, F.replace(frac, F.lit(" "), F.lit("")))

    def percent_loop(x):
        k = F.length(x) - F.length(F.replace(x, F.lit("%"), F.lit("")))
        start = F.struct(x.alias("s"), F.lit(0).alias("n"))
        loop = F.aggregate(F.sequence(F.lit(1), k), start, lambda acc, _: F.when(
            acc["s"].endswith("%"),
            F.struct(_normalised(acc["s"].substr(F.lit(1), F.length(acc["s"]) - 1)).alias("s"),
                     (acc["n"] + 1).alias("n"))).otherwise(acc))
        return F.when(F.instr(x, "%") > 0, F.when(k > 0, loop).otherwise(start)).otherwise(start)

    def value(st):
        core, n = st["s"], st["n"]
        base = (F.when(core == "", F.lit(None).cast("double"))
                .when(core.rlike(PLAIN_NUMBER), core.cast("double"))
                .when(core.rlike(RATIO), F.try_divide(F.regexp_extract(core, RATIO, 1).cast("double"),
                                                      F.nullif(F.regexp_extract(core, RATIO, 2).cast("double"), F.lit(0.0))))
                .when(core.rlike(PAREN_RATIO), F.try_divide(F.regexp_extract(core, PAREN_RATIO, 1).cast("double"),
                                                            F.nullif(F.regexp_extract(core, PAREN_RATIO, 2).cast("double"), F.lit(0.0)))))
        return bind(base, lambda b: F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), b,
                                                              lambda acc, _: acc / 100.0)).otherwise(b))

    scaled = bind(bind(F.col(t), percent_loop), value)
    if src is not None:
        scaled = F.when(F.length(py_strip(F.col(src).cast("string"))) == 0, F.lit(None)).otherwise(scaled)
    return df.withColumn(dst, scaled).drop(t)




def simple_number_steps(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Add ``dst`` = the numeric value of ``src`` or null (no symbolic fallback).

    Accepts plain and scientific numbers, ``a/b`` and ``(a)/(b)``; every
    trailing '%' divides by 100 (recursively, re-normalising in between);
    a zero denominator gives null.
    """
    n = f"_{dst}_n"
    df = strip_wrappers_steps(df, src, n)
    return number_from_normalised(df, n, dst, src).drop(n)


def values_close(a: Column, b: Column, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> Column:
    """``math.isclose``: equal, or both finite and within tolerance."""
    def body(p):
        x, y = p["x"], p["y"]
        finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
        tol = F.greatest(F.lit(rel_tol) * F.greatest(F.abs(x), F.abs(y)), F.lit(abs_tol))
        return (x == y) | (finite & (F.abs(x - y) <= tol))
    return bind(F.struct(a.alias("x"), b.alias("y")), body)


def light_normalise(s: Column) -> Column:
    """Candidate-vs-gold normalisation: strip, lower, unwrap \\cmd{x}, drop {}$."""
    a = F.lower(py_strip(s))
    a = F.regexp_replace(a, LATEX_COMMAND_ARG, "$1")
    return py_strip(F.regexp_replace(a, "[{}$]", ""))


# ---- boxed answers --------------------------------------------------------

def boxed_contents(text: Column) -> Column:
    """Contents of every closed ``\\boxed{...}`` with balanced braces.

    Each opening is replaced by a marker, the text is cut at braces and
    markers (zero-width split), and one pass over the pieces tracks depth.
    Braces outside a box are ignored; a box still open at the end is lost.
    """
    t = F.replace(text, F.lit(BOX_OPEN), F.lit(_MARK))
    pieces = F.split(t, f"(?=[{_MARK}{{}}])|(?<=[{_MARK}{{}}])")
    init = F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc, p):
        d, cur, out = acc["d"], acc["cur"], acc["out"]
        opened = F.struct(F.lit(1).alias("d"), F.lit("").alias("cur"), out.alias("out"))
        deeper = lambda lit: F.struct((d + 1).alias("d"), F.concat(cur, F.lit(lit)).alias("cur"), out.alias("out"))
        closed = F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"), F.concat(out, F.array(cur)).alias("out"))
        inner_close = F.struct((d - 1).alias("d"), F.concat(cur, F.lit("}")).alias("cur"), out.alias("out"))
        text_in = F.struct(d.alias("d"), F.concat(cur, p).alias("cur"), out.alias("out"))
        return (F.when(p == _MARK, F.when(d == 0, opened).otherwise(deeper(BOX_OPEN)))
                .when(p == "{", F.when(d > 0, deeper("{")).otherwise(acc))
                .when(p == "}", F.when(d == 1, closed).when(d > 1, inner_close).otherwise(acc))
                .otherwise(F.when(d > 0, text_in).otherwise(acc)))

    return F.aggregate(pieces, init, step)["out"]


def single_boxed(text: Column) -> Column:
    """The one boxed answer of a text (stripped); null for zero or several."""
    return bind(boxed_contents(F.coalesce(text, F.lit(""))),
                lambda found: F.when(F.size(found) == 1, py_strip(F.get(found, 0))))


# ---- DuckDB twins -----------------------------------------------------------

def _sq(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _bind(expr: str, var: str, body: str) -> str:
    """Evaluate ``expr`` once and use it as ``var`` inside ``body``."""
    return f"(list_transform([{expr}], lambda {var}: {body})[1])"


def strip_wrappers_sql(expr: str) -> str:
    a = py_strip_sql(f"cast({expr} as varchar)")
    a = f"replace(replace({a}, chr(8722), '-'), chr(65292), ',')"
    a = f"regexp_replace({a}, '^ +| +$', '', 'g')"
    a = f"regexp_replace(replace({a}, '$', ''), {_sq(BOXED_WRAPPER)}, '\\1', 'g')"
    a = f"replace(replace({a}, chr(92) || 'left', ''), chr(92) || 'right', '')"
    for i, pat in enumerate((ANSWER_HASH, ANSWER_TAG, ASSIGNMENT)):
        v = f"sw{i}"
        a = _bind(a, v, f"case when regexp_matches({v}, {_sq(pat)}) then "
                        f"{py_strip_sql(f'regexp_extract({v}, {_sq(pat)}, 1)')} else {v} end")
    return py_strip_sql(f"regexp_replace({a}, {_sq(TRAILING_PERIODS)}, '')")


def fractions_to_plain_sql(expr: str) -> str:
    return _bind(expr, "fr", f"list_reduce(range((length(fr) - length(replace(fr, 'frac', ''))) // 4), "
                             f"lambda fa, fi: regexp_replace(fa, {_sq(LATEX_FRACTION)}, '(\\1)/(\\2)', 'g'), fr)")


def simple_number_sql(expr: str) -> str:
    t = f"replace({fractions_to_plain_sql(strip_wrappers_sql(expr))}, ' ', '')"
    cut = "substr(acc.s, 1, length(acc.s) - 1)"
    again = f"replace({fractions_to_plain_sql(strip_wrappers_sql(cut))}, ' ', '')"
    loop = _bind(t, "tt", f"list_reduce(range(length(tt) - length(replace(tt, '%', ''))), lambda acc, i: "
                          f"case when ends_with(acc.s, '%') then {{'s': {again}, 'n': acc.n + 1}} else acc end, "
                          f"{{'s': tt, 'n': 0}})")
    c = "st.s"
    base = (f"case when {c} = '' then null "
            f"when regexp_full_match({c}, {_sq(PLAIN_NUMBER[1:-1])}) then cast({c} as double) "
            f"when regexp_full_match({c}, {_sq(RATIO[1:-1])}) then "
            f"cast(regexp_extract({c}, {_sq(RATIO)}, 1) as double) / nullif(cast(regexp_extract({c}, {_sq(RATIO)}, 2) as double), 0) "
            f"when regexp_full_match({c}, {_sq(PAREN_RATIO[1:-1])}) then "
            f"cast(regexp_extract({c}, {_sq(PAREN_RATIO)}, 1) as double) / nullif(cast(regexp_extract({c}, {_sq(PAREN_RATIO)}, 2) as double), 0) end")
    value = _bind(loop, "st", f"list_reduce(range(st.n), lambda acc, i: acc / 100.0e0, {base})")
    return f"(case when length({py_strip_sql(f'cast({expr} as varchar)')}) = 0 then null else {value} end)"


def values_close_sql(a: str, b: str) -> str:
    return (f"({a} = {b} or (isfinite({a}) and isfinite({b}) and abs({a} - {b}) <= "
            f"greatest({REL_TOL} * greatest(abs({a}), abs({b})), {ABS_TOL})))")


def light_normalise_sql(expr: str) -> str:
    a = f"lower({py_strip_sql(expr)})"
    a = f"regexp_replace({a}, {_sq(LATEX_COMMAND_ARG)}, '\\1', 'g')"
    return py_strip_sql(f"regexp_replace({a}, '[{{}}$]', '', 'g')")


def single_boxed_sql(expr: str) -> str:
    chars = f"string_split(replace(coalesce({expr}, ''), chr(92) || 'boxed{{', chr(57344)), '')"
    step = ("case when x = chr(57344) then (case when acc.d = 0 then {'d': 1, 'cur': '', 'out': acc.out} "
            "else {'d': acc.d + 1, 'cur': acc.cur || chr(92) || 'boxed{', 'out': acc.out} end) "
            "when x = '{' then (case when acc.d > 0 then {'d': acc.d + 1, 'cur': acc.cur || '{', 'out': acc.out} else acc end) "
            "when x = '}' then (case when acc.d = 1 then {'d': 0, 'cur': '', 'out': list_append(acc.out, acc.cur)} "
            "when acc.d > 1 then {'d': acc.d - 1, 'cur': acc.cur || '}', 'out': acc.out} else acc end) "
            "when acc.d > 0 then {'d': acc.d, 'cur': acc.cur || x, 'out': acc.out} else acc end")
    red = f"list_reduce({chars}, lambda acc, x: {step}, {{'d': 0, 'cur': '', 'out': []::varchar[]}}).out"
    return _bind(red, "bx", f"case when len(bx) = 1 then {py_strip_sql('bx[1]')} end")
