"""The assertion language: parsed on the driver, compiled to column expressions, evaluated for all rules in one pass.

    expr := or ['=>' expr]; or := and {OR and}; and := disj {AND disj}; disj := not {disjoint not}; not := NOT not | atom
    atom := '(' expr ')' | any(D, expr) | all(D, expr) | none(D, expr) | has_segment(kind, name) | ~ 'path' | term op term
    term := number | 'text' | projection | segment(kind) | agg(D[, …]) with + - * / between; op := = != < <= > >= =~ !~
    D    := a kind | shape:S | children (direct children of the symbol); out_refs | in_refs where references are given

Quantifiers and aggregates become columns of one aggregation over the children (and one over the references), joined to
their owners once, however many rules there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import identity as ident
from spanloom.functions import logic, stats

_TOKEN = re.compile(r"\s*(?:(=>|=~|!~|!=|<=|>=|[=<>~(),+*/-])|(\d+(?:\.\d+)?)|'((?:[^'\\]|\\.)*)'|([A-Za-z_][\w.]*(?::[A-Za-z_]\w*)?))")
PROJECTIONS = {
    "name": lambda: F.col("name"), "kind": lambda: F.col("kind"), "shape": lambda: F.col("shape"), "visibility": lambda: F.col("visibility"), "srcset": lambda: F.col("srcset"),
    "uri": lambda: F.col("identity"), "path": lambda: F.col("path"), "depth": lambda: F.col("depth"), "start_line": lambda: F.col("start_line"), "end_line": lambda: F.col("end_line"),
    "lines": lambda: F.col("end_line") - F.col("start_line") + 1, "navigable": lambda: F.col("navigable"),
}
REF_PROJECTIONS = {"kind": lambda: F.col("kind"), "status": lambda: F.col("status"), "confidence": lambda: F.col("evidence"), "target": lambda: F.col("target_identity")}
NUMERIC = {"depth", "start_line", "end_line", "lines"}
_AGG = {
    "sum": lambda x: stats.total(x), "min": F.min, "max": F.max, "avg": F.avg, "median": stats.median, "var": stats.variance, "stddev": F.stddev_pop, "cv": stats.cv,
}
_EMPTY = {"count": 0, "sum": 0, "any": False, "all": True, "none": True}


class RuleError(ValueError):
    """An expression that can't be read or has no meaning; found before anything runs."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    expr: str
    severity: str = "warning"
    message: str = "{uri}"
    #: Where kind is a shape, written shape:S, a rule with the same id for a kind comes first.


@dataclass
class _Compiler:
    scope: str = "def"
    children: dict[str, Column] = field(default_factory=dict)
    refs: dict[str, Column] = field(default_factory=dict)
    empty: dict[str, object] = field(default_factory=dict)
    premises: dict[str, Column] = field(default_factory=dict)


class _Parser:
    def __init__(self, text: str, out: _Compiler, scope: str = "def"):
        self.text, self.out, self.scope, self.at = text, out, scope, 0
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleError(f"cannot read {text[at:].strip()!r} in {text!r}")
            self.tokens.append(next((k, v) for k, v in zip(("op", "num", "str", "id"), m.groups()) if v is not None))
            at = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "id") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if self.at >= len(self.tokens) or values and self.tokens[self.at][1] not in values:
            raise RuleError(f"expected {' or '.join(values) or 'more'} in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Column:
        e = self.expr(top=True)
        if self.at < len(self.tokens):
            raise RuleError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return e

    def expr(self, top: bool = False) -> Column:
        left = self.disjunction()
        if self.peek("=>"):
            self.take()
            if top and self.scope == "def":
                self.out.premises[self.text] = left
            return logic.implies(left, self.expr())
        return left

    def disjunction(self) -> Column:
        out = self.conjunction()
        while self.peek("OR"):
            self.take()
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.apart()
        while self.peek("AND"):
            self.take()
            out = out & self.apart()
        return out

    def apart(self) -> Column:
        terms = [self.negation()]
        while self.peek("disjoint"):
            self.take()
            terms.append(self.negation())
        return terms[0] if len(terms) == 1 else logic.disjoint(*terms)

    def negation(self) -> Column:
        if self.peek("NOT"):
            self.take()
            return ~self.negation()
        return self.atom()

    def atom(self) -> Column:
        if self.peek("("):
            mark = self.at
            self.take()
            try:
                e = self.expr()
                self.take(")")
                if not self.peek("+", "-", "*", "/", "=", "!=", "<", "<=", ">", ">="):
                    return e
            except RuleError:
                pass
            self.at = mark  # brackets around a term
        if self.peek("any", "all", "none"):
            return self.quantifier()
        if self.peek("has_segment"):
            self.take()
            self.take("(")
            kind = self.take()
            self.take(",")
            name = self.take()
            self.take(")")
            return ident.has_segment(ident.segments("identity"), kind, name)
        if self.peek("~"):
            self.take()
            return ident.matches_path(ident.segments("identity"), self.take())
        left, kind = self.term()
        op = self.take("=", "!=", "<", "<=", ">", ">=", "=~", "!~")
        if op in ("=~", "!~"):
            if kind != "text":
                raise RuleError(f"{op} needs a text on its left in {self.text!r}")
            pattern = self.take()
            if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
                raise RuleError(f"look-around and back-references are not supported: {pattern!r}")
            found = left.rlike(f"(?U){pattern}")
            return found if op == "=~" else ~found
        right, other = self.term()
        if kind != other:
            raise RuleError(f"{kind} {op} {other} in {self.text!r}")
        return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]

    def term(self) -> tuple[Column, str]:
        out, kind = self.factor()
        while self.peek("+", "-", "*", "/"):
            op = self.take()
            more, other = self.factor()
            if (kind, other) != ("number", "number"):
                raise RuleError(f"{op} needs numbers in {self.text!r}")
            out = {"+": out + more, "-": out - more, "*": out * more, "/": out / more}[op]
        return out, kind

    def factor(self) -> tuple[Column, str]:
        if self.peek("("):
            self.take()
            t = self.term()
            self.take(")")
            return t
        if self.at >= len(self.tokens):
            raise RuleError(f"{self.text!r} ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return F.lit(float(value) if "." in value else int(value)), "number"
        if kind == "str":
            return F.lit(re.sub(r"\\(.)", r"\1", value)), "text"
        if kind == "id" and self.peek("(") and value in (*_AGG, "count", "percentile"):
            return self.aggregate(value), "number"
        if value == "segment" and self.peek("("):
            self.take()
            name = self.take()
            self.take(")")
            return ident.segment(ident.segments("identity"), name), "text"
        known = REF_PROJECTIONS if self.scope == "ref" else PROJECTIONS
        if kind == "id" and value in known:
            return known[value](), "number" if value in NUMERIC else "text"
        raise RuleError(f"unknown projection {value!r} in {self.text!r}")

    def domain(self) -> tuple[str, Column]:
        d = self.take()
        if self.scope != "def":
            raise RuleError("domains don't nest")
        if d in ("out_refs", "in_refs"):
            return d, F.lit(True)
        if d == "children":
            return "children", F.lit(True)
        return "children", F.col("shape") == d[6:] if d.startswith("shape:") else F.col("kind") == d

    def inner(self, where: str) -> _Parser:
        p = _Parser("", self.out, "ref" if where != "children" else "item")
        p.text, p.tokens, p.at = self.text, self.tokens, self.at
        return p

    def column(self, what: str, where: str, agg: Column, start: int) -> Column:
        """A column of the aggregation that the owner is joined with; written twice, it is computed once."""
        into = self.out.children if where == "children" else self.out.refs
        name = f"_{where}: " + " ".join(v for _, v in self.tokens[start : self.at])
        name = re.sub(r"[`.]", "_", name)
        into[name] = agg
        if what in _EMPTY:
            self.out.empty[name] = _EMPTY[what]
            return F.coalesce(F.col(f"`{name}`"), F.lit(_EMPTY[what]))
        return F.col(f"`{name}`")

    def quantifier(self) -> Column:
        start = self.at
        what = self.take()
        self.take("(")
        where, inside = self.domain()
        self.take(",")
        p = self.inner(where)
        e = p.expr()
        self.at = p.at
        self.take(")")
        item = F.when(inside, F.coalesce(e, F.lit(False)))
        if what == "all":
            ok = F.count_if(F.coalesce(item, F.lit(False))) == F.count_if(inside) if where == "children" else F.count_if(inside & e.eqNullSafe(F.lit(False))) == 0
        else:
            ok = F.count_if(F.coalesce(item, F.lit(False))) > 0 if what == "any" else F.count_if(F.coalesce(item, F.lit(False))) == 0
        return self.column(what, where, ok, start)

    def aggregate(self, what: str) -> Column:
        start = self.at - 1
        self.take("(")
        where, inside = self.domain()
        if what == "count":
            e = F.lit(True)
            if self.peek(","):
                self.take()
                p = self.inner(where)
                e = p.expr()
                self.at = p.at
            agg = F.count_if(inside & F.coalesce(e, F.lit(False)))
        else:
            self.take(",")
            p = self.inner(where)
            x, kind = p.term()
            self.at = p.at
            if kind != "number":
                raise RuleError(f"{what} needs a number in {self.text!r}")
            x = F.when(inside, x)
            if what == "percentile":
                self.take(",")
                agg = stats.percentile(x, float(self.take()))
            else:
                agg = _AGG[what](x)
        self.take(")")
        return self.column(what, where, agg, start)


def expand(expr: str, aliases: dict[str, str], seen: tuple = ()) -> str:
    """Aliases written $name become their text in brackets; a circle is an error."""
    def one(m: re.Match) -> str:
        name = m[1]
        if name in seen:
            raise RuleError(f"alias ${name} refers to itself")
        if name not in aliases:
            raise RuleError(f"unknown alias ${name}")
        return f"({expand(aliases[name], aliases, (*seen, name))})"

    return re.sub(r"\$(\w+)", one, expr)


def merge(*configs: list[Rule]) -> list[Rule]:
    """Later configurations replace rules of the same id and kind."""
    return list({(r.rule_id, r.kind): r for c in configs for r in c}.values())


def profile(rules: list[Rule], enable: list[str] = (), disable: list[str] = ()) -> list[Rule]:
    on = [r for r in rules if not enable or any(re.search(p, r.rule_id) for p in enable)]
    return [r for r in on if not any(re.search(p, r.rule_id) for p in disable)]


def _evaluated(symbols: DataFrame, rules: list[Rule], refs: DataFrame | None) -> tuple[DataFrame, list[tuple[Rule, Column, Column | None]]]:
    out = _Compiler()
    compiled = []
    for r in rules:
        e = _Parser(r.expr, out).whole()
        compiled.append((r, e, out.premises.get(r.expr)))
    kinds = [r.kind for r in rules if not r.kind.startswith("shape:")]
    shapes = [r.kind[6:] for r in rules if r.kind.startswith("shape:")]
    rows = symbols.filter(F.col("kind").isin(*kinds) | F.col("shape").isin(*shapes))
    if out.children:
        items = symbols.filter("parent_id is not null").groupBy(F.col("parent_id").alias("_owner")).agg(*[a.alias(n) for n, a in out.children.items()])
        rows = rows.join(items, F.col("symbol_id") == F.col("_owner"), "left").drop("_owner")
    for where, key in (("out_refs", "source_symbol_id"), ("in_refs", "target_id")):
        mine = {n: a for n, a in out.refs.items() if n.startswith(f"_{where}")}
        if mine:
            if refs is None:
                raise RuleError(f"{where} needs references")
            items = refs.filter(f"{key} is not null").groupBy(F.col(key).alias("_owner")).agg(*[a.alias(n) for n, a in mine.items()])
            rows = rows.join(items, F.col("symbol_id") == F.col("_owner"), "left").drop("_owner")
    # a rule for a kind comes before one of the same id for its shape
    named = {(r.rule_id, r.kind) for r in rules}
    result = []
    for r, e, premise in compiled:
        if r.kind.startswith("shape:"):
            own = [k for i, k in named if i == r.rule_id and not k.startswith("shape:")]
            on = (F.col("shape") == r.kind[6:]) & ~F.col("kind").isin(*own)
        else:
            on = F.col("kind") == r.kind
        result.append((r, F.when(on, e), None if premise is None else F.when(on, premise), on))
    return rows, result


def check(symbols: DataFrame, rules: list[Rule], refs: DataFrame | None = None) -> DataFrame:
    """rule_id, symbol_id, severity, message for each explicit failure."""
    rows, compiled = _evaluated(symbols, rules, refs)
    values = {n: f() for n, f in PROJECTIONS.items()}
    found = [F.when(logic.fails(e) & on, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), ident.render(r.message, values).alias("message"))) for r, e, _, on in compiled]
    hits = rows.select("symbol_id", F.explode(F.array_compact(F.array(*found))).alias("v"))
    return hits.select("v.rule_id", "symbol_id", "v.severity", "v.message")


def report(symbols: DataFrame, rules: list[Rule], refs: DataFrame | None = None) -> DataFrame:
    """rule_id, evaluated, antecedent_matches, violations. A rule whose premise never holds is worth a warning."""
    rows, compiled = _evaluated(symbols, rules, refs)
    each = F.array(
        *[
            F.struct(F.lit(r.rule_id).alias("rule_id"), on.alias("on"), F.coalesce(p if p is not None else on, F.lit(False)).alias("premise"), (logic.fails(e) & on).alias("failed"))
            for r, e, p, on in compiled
        ]
    )
    out = rows.select(F.explode(each).alias("v")).select("v.*").filter("on")
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("premise").alias("antecedent_matches"), F.count_if("failed").alias("violations"))


def summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def exit_code(violations: DataFrame) -> int:
    """1 if an error is among the violations, else 0."""
    return int(not violations.filter("severity = 'error'").isEmpty())


def suppress(violations: DataFrame, directives: DataFrame) -> DataFrame:
    """Without what directives(symbol_id, rule_id, null for any) cover."""
    whole = directives.filter("rule_id is null").select("symbol_id").distinct()
    one = directives.filter("rule_id is not null").select("symbol_id", "rule_id").distinct()
    return violations.join(whole, "symbol_id", "left_anti").join(one, ["symbol_id", "rule_id"], "left_anti")
