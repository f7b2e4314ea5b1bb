"""A small formula language, compiled to columns.

``lhs ~ term + term ...``: a term is a column, ``log(c)``, ``log1p(c)``, ``exp(c)``, ``sqrt(c)``,
``I(sql expression)``, ``C(c)`` (indicators of all levels but the first in sorted order), a product
``a:b``, or ``a*b`` for both and their product. ``0`` or ``-1`` leaves out the intercept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"log": F.log, "np.log": F.log, "log1p": F.log1p, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}


@dataclass(frozen=True)
class Compiled:
    """Outcome, labelled terms, and whether there is an intercept; levels are fixed at compiling."""

    outcome: str
    terms: tuple[tuple[str, Column], ...]
    intercept: bool

    def apply(self, df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
        """Keys, outcome (where the frame has it) and terms as doubles; rows with a null in them go."""
        names = [n for n, _ in self.terms]
        have = [F.col(self.outcome).cast("double").alias(self.outcome)] if self.outcome in df.columns else []
        out = df.select(*keys, *have, *[c.cast("double").alias(n) for n, c in self.terms])
        return out.dropna(subset=[*keys, *([self.outcome] if have else []), *names]), names


def _split(text: str, marks: str) -> list[str]:
    """Parts between marks that stand outside of brackets; a mark stays in front of its part."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c in marks and i > start:
            out.append(text[start:i])
            start = i
    if depth:
        raise ValueError(f"brackets don't match in {text!r}")
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def _factor(df: DataFrame, text: str) -> list[tuple[str, Column]]:
    text = text.strip()
    if m := re.fullmatch(r"C\((\w+)\)", text):
        levels = [r[0] for r in df.select(m[1]).where(F.col(m[1]).isNotNull()).distinct().orderBy(m[1]).collect()]
        if len(levels) > 1000:
            raise ValueError(f"{m[1]} has {len(levels)} levels")
        return [(f"C({m[1]})[{v}]", F.when(F.col(m[1]) == F.lit(v), 1.0).when(F.col(m[1]).isNotNull(), 0.0)) for v in levels[1:]]
    if m := re.fullmatch(r"I\((.+)\)", text):
        return [(text, F.expr(m[1].replace("**", "^") if "**" not in m[1] else _powers(m[1])))]
    if (m := re.fullmatch(r"([\w.]+)\((\w+)\)", text)) and m[1] in FUNCTIONS:
        return [(text, FUNCTIONS[m[1]](F.col(m[2]).cast("double")))]
    if text in df.columns:
        return [(text, F.col(text))]
    raise ValueError(f"cannot read the term {text!r}")


def _powers(text: str) -> str:
    return re.sub(r"(\w+)\s*\*\*\s*(\d+(?:\.\d+)?)", r"power(\1, \2)", text)


def _product(df: DataFrame, text: str) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    for k, part in enumerate(_split(text, ":")):
        factors = _factor(df, part.lstrip(":"))
        out = factors if k == 0 else [(f"{a}:{b}", x.cast("double") * y.cast("double")) for a, x in out for b, y in factors]
    return out


def compile_formula(formula: str, df: DataFrame) -> Compiled:
    left, tilde, right = formula.partition("~")
    outcome = left.strip()
    if not tilde or not re.fullmatch(r"\w+", outcome):
        raise ValueError("a formula is 'column ~ terms'")
    if outcome not in df.columns:
        raise ValueError(f"no column {outcome!r}")
    terms: dict[str, Column] = {}
    intercept = True
    for part in _split(right, "+-"):
        sign, body = (part[0], part[1:].strip()) if part[0] in "+-" else ("+", part)
        if body in ("0", "1"):
            intercept = (body == "1") == (sign == "+")
            continue
        found: list[tuple[str, Column]] = []
        stars = [p.lstrip("*").strip() for p in _split(body, "*")]
        for s in stars:
            found += _product(df, s)
        if len(stars) > 1:
            found += _product(df, ":".join(stars))
        for name, column in found:
            if sign == "-":
                terms.pop(name, None)
            else:
                terms[name] = column
    return Compiled(outcome, tuple(terms.items()), intercept)
