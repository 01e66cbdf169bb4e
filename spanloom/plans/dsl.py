"""The query language: `verb [positional] field:value …`, read and checked on the driver, answered by DataFrames."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import identity as ident
from spanloom.operators import graph, linkage, search

MULTI = {"path", "lang", "kind", "shape", "srcset", "severity", "file", "relation"}
ALIASES = {"max_items": "limit", "language": "lang", "scope": "prefix"}
CONSISTENCY = ("current", "refresh_if_stale", "stale_ok")


@dataclass(frozen=True)
class Verb:
    name: str
    fields: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    paged: bool = False
    #: The field that a bare word fills.
    positional: str | None = None


def _v(name: str, fields: str = "", required: str = "", paged: bool = False, positional: str | None = None) -> Verb:
    return Verb(name, tuple(fields.split()), tuple(required.split()), paged, positional)


VERBS = {
    v.name: v
    for v in (
        _v("query.describe", "verb", positional="verb"), _v("workspace.status"), _v("tree.children", "workspace path depth lang", paged=True, positional="path"),
        _v("symbol.search", "workspace path lang kind shape name text include_non_navigable include_code context_lines", paged=True, positional="text"),
        _v("symbol.insights", "workspace path lang kind shape name include_non_navigable"), _v("symbol.detail", "workspace uri context_lines", "uri", positional="uri"),
        _v("syntax.tree", "workspace focus max_depth max_nodes named_only include_text max_text_chars", "focus", positional="focus"),
        _v("syntax.parse", "language source uri max_depth max_nodes named_only include_text max_text_chars", "language source"),
        _v("symbol.usages", "workspace uri direction path lang include_descendants", "uri", True, "uri"), _v("view.read", "uri scheme context_lines include_code", "uri", positional="uri"),
        _v("rules.list", "workspace profile rules lang severity", paged=True), _v("rules.check", "workspace profile rules file report", paged=True),
        _v("rules.applicable", "workspace focus profile rules", "focus", True, "focus"), _v("change.review", "workspace"), _v("change.context", "workspace focus profile max_items", "focus", positional="focus"),
        _v("symbol.graph", "workspace focus direction relation min_count include_internal", "focus", positional="focus"),
        _v("graph.path", "workspace from to expect relation max_depth max_symbols max_edges min_coverage", "from to"),
        _v("graph.corridor", "workspace from to path lang kind shape srcset relation max_depth max_symbols max_edges min_coverage", "from to relation"),
        _v("identity.children", "workspace prefix", positional="prefix"), _v("identity.graph", "workspace prefix path min_count", paged=True, positional="prefix"),
        _v("metrics.coupling", "workspace from to relation snapshot export", "from to"), _v("resolution.audit", "workspace prefix cluster", paged=True),
        _v("notes", "action id moniker kind status title body created_by orphan include_done", paged=True, positional="action"),
    )
}


class QueryError(ValueError):
    """code and message; found before anything runs."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Query:
    verb: str
    values: dict[str, list[str]] = field(default_factory=dict)

    def one(self, name: str, default=None):
        return self.values.get(name, [default])[0]

    def number(self, name: str, default: int) -> int:
        raw = self.one(name, str(default))
        if not re.fullmatch(r"\d+", raw):
            raise QueryError("invalid_value", f"{name} must be a whole number, not {raw!r}")
        return int(raw)


_TOKEN = re.compile(r'\s*((?:[A-Za-z_]+:)?(?:"(?:[^"\\]|\\.)*"|(?:`(?:[^`]|``)*`|[^\s"`])+))')


def parse(text: str) -> Query:
    """Values may be quoted; commas separate the values of multi-valued fields; unknown names get a suggestion."""
    parts, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("syntax", f"cannot read {text[at:].strip()!r}")
        parts.append(m[1])
        at = m.end()
    if not parts or parts[0] not in VERBS:
        near = difflib.get_close_matches(parts[0] if parts else "", VERBS, 1)
        raise QueryError("unknown_verb", f"{parts[0] if parts else ''!r}" + (f"; did you mean {near[0]}?" if near else ""))
    verb = VERBS[parts[0]]
    allowed = [*verb.fields, "consistency", "limit", "cursor"] if verb.paged else [*verb.fields, "consistency", "limit"]
    q = Query(verb.name)
    for p in parts[1:]:
        name, colon, value = p.partition(":")
        name = ALIASES.get(name, name) if ALIASES.get(name) in allowed else name
        if not colon or (name not in allowed and verb.positional and verb.positional not in q.values and ("/" in p or not re.fullmatch(r"[a-z_]+", name))):
            name, value = verb.positional, p
        if name not in allowed:
            near = difflib.get_close_matches(name or "", allowed, 1)
            raise QueryError("unknown_field", f"{name!r} of {verb.name}" + (f"; did you mean {near[0]}?" if near else ""))
        value = re.sub(r"\\(.)", r"\1", value[1:-1]) if len(value) > 1 and value[0] == value[-1] == '"' else value
        if name in q.values and name not in MULTI:
            raise QueryError("repeated_field", name)
        q.values.setdefault(name, []).extend(value.split(",") if name in MULTI else [value])
    for name in verb.required:
        if name not in q.values:
            raise QueryError("missing_field", f"{verb.name} needs {name}")
    if q.one("consistency", "current") not in CONSISTENCY:
        raise QueryError("invalid_value", f"consistency must be one of {', '.join(CONSISTENCY)}")
    if "limit" in q.values:
        try:
            search.bounded(q.number("limit", 80))
        except ValueError as e:
            raise QueryError("invalid_value", str(e)) from None
    return q


#: Fields that are part of the language but that nothing here acts on: a query with one is refused, not answered as if it weren't there.
UNSUPPORTED = {
    "symbol.search": "include_code context_lines", "symbol.detail": "context_lines", "rules.list": "profile lang", "rules.check": "profile report", "rules.applicable": "profile",
    "change.context": "profile", "graph.corridor": "min_coverage", "identity.graph": "path", "metrics.coupling": "snapshot export", "resolution.audit": "cluster",
    "notes": "id kind status title body created_by orphan",
}


def _refuse(q: Query) -> None:
    for name in UNSUPPORTED.get(q.verb, "").split():
        if name in q.values:
            raise QueryError("unsupported_field", f"{name} of {q.verb}")
    if q.verb == "notes" and q.one("action", "list") != "list":
        raise QueryError("unsupported", f"notes {q.one('action')}; see spanloom.sources.files")
    for name, known in (("direction", ("both", "incoming", "outgoing")), ("expect", ("reachable", "no_path")), ("include_internal", ("true", "false"))):
        if q.one(name, known[0]) not in known:
            raise QueryError("invalid_value", f"{name} must be one of {', '.join(known)}")


def _in_language(identity: str, q: Query) -> Column:
    """By the identity's language segment."""
    return ident.segment(ident.segments(identity), "lang").isin(*q.values["lang"])


def describe(spark, verb: str | None = None) -> DataFrame:
    rows = [(v.name, ",".join(v.fields), ",".join(v.required), v.paged) for v in VERBS.values() if verb in (None, v.name)]
    return spark.createDataFrame(rows, "verb string, fields string, required string, paged boolean")


def _faceted(symbols: DataFrame, q: Query) -> DataFrame:
    out = symbols
    if "path" in q.values:
        out = out.filter(ident.matches_glob("path", q.values["path"]))
    if q.one("include_non_navigable", "false") != "true" and q.verb.startswith("symbol."):
        out = out.filter("navigable")
    if "lang" in q.values:
        out = out.filter(_in_language("identity", q))
    if "srcset" in q.values:
        out = out.filter(F.col("srcset").isin(*q.values["srcset"]))
    kinds, shapes = q.values.get("kind", []), q.values.get("shape", [])
    by_kind, by_shape = F.col("kind").isin(*kinds), F.col("shape").isin(*shapes)
    if kinds and shapes:
        out = out.filter(by_kind | by_shape if "text" in q.values else by_kind & by_shape)
    elif kinds or shapes:
        out = out.filter(by_kind if kinds else by_shape)
    return out.filter(F.col("name").rlike(f"(?U){q.one('name')}")) if "name" in q.values else out


def run(text: str, symbols: DataFrame, refs: DataFrame, generation: int = 0, rule_set: list = (), note_table: DataFrame | None = None) -> DataFrame:
    """Answers a query over symbols and references of one generation."""
    from spanloom.plans import rules

    q = parse(text)
    _refuse(q)
    spark, relations = symbols.sparkSession, q.values.get("relation")
    limit, offset = q.number("limit", 80), search.resume(q.one("cursor"), generation)

    def paged(df: DataFrame, order: list) -> DataFrame:
        return search.page(df, order, offset, limit)

    def nodes(name: str) -> DataFrame:
        return symbols.filter(ident.in_scope("identity", q.one(name))).select(F.col("symbol_id").alias("node"))

    def edges() -> DataFrame:
        rows = refs.filter(F.col("kind").isin(relations)) if relations else refs
        return rows.select("reference_id", F.col("source_symbol_id").alias("s"), F.col("target_id").alias("t"))

    def budget(name: str) -> int | None:
        return q.number(name, 1) if name in q.values else None

    match q.verb:
        case "query.describe":
            return describe(spark, q.one("verb"))
        case "workspace.status":
            counts = [F.count(F.lit(1)).alias("symbols"), F.count_distinct("source_id").alias("files")]
            return symbols.agg(*counts).crossJoin(refs.agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("status") == "resolved").alias("resolved")))
        case "tree.children":
            deep = q.number("depth", 1) + (q.one("path", "").count("/") + 1 if q.one("path") else 0)
            rows = symbols.filter(F.col("path").startswith(q.one("path", "")))
            rows = rows.filter(_in_language("identity", q)) if "lang" in q.values else rows
            return paged(rows.groupBy(F.substring_index("path", "/", deep).alias("folder")).agg(F.count(F.lit(1)).alias("defs"), F.count_distinct("path").alias("files")), ["folder"])
        case "symbol.search":
            rows = _faceted(symbols, q)
            if "text" in q.values:
                return paged(search.scored(rows, q.one("text")), [F.desc("score"), F.asc("identity")])
            return paged(rows.select("symbol_id", "identity", "path", "start_line"), ["path", "start_line", "symbol_id"])
        case "symbol.insights":
            rows = _faceted(symbols, q)
            facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("kind", "shape", "visibility")])).alias("x")
            return rows.select(facets).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n")).orderBy("facet", F.desc("n"), "value")
        case "symbol.detail":
            return symbols.filter(F.col("identity") == q.one("uri"))
        case "symbol.usages":
            deep = q.one("include_descendants", "false") == "true"
            incoming = graph.usages(symbols, refs, q.one("uri"), deep).withColumn("direction", F.lit("incoming"))
            outgoing = graph.ends(symbols, refs).filter(ident.in_scope("source_identity", q.one("uri")) if deep else F.col("source_identity") == q.one("uri")).withColumn("direction", F.lit("outgoing"))
            wanted = {"incoming": incoming, "outgoing": outgoing}.get(q.one("direction", "both"))
            rows = wanted if wanted is not None else incoming.unionByName(outgoing)
            if "lang" in q.values:
                rows = rows.filter(_in_language("source_identity", q))
            if "path" in q.values:
                there = symbols.filter(ident.matches_glob("path", q.values["path"])).select(F.col("symbol_id").alias("source_symbol_id"))
                rows = rows.join(there, "source_symbol_id", "left_semi")
            return paged(rows.select("direction", "kind", "source_identity", "target_identity", "status", "reference_id"), ["direction", "kind", "source_identity", "reference_id"])
        case "symbol.graph":
            rows = graph.symbol_graph(symbols, refs, q.one("focus"), q.one("direction", "both"), relations, q.number("min_count", 1))
            rows = rows.filter("role <> 'internal'") if q.one("include_internal") == "false" else rows
            return rows.orderBy(F.desc("n"), "role", "source_identity", "target_identity").limit(limit)
        case "graph.path":
            rows = refs.filter(F.col("kind").isin(relations)) if relations else refs
            return graph.path(rows, nodes("from"), nodes("to"), q.number("max_depth", 8), budget("max_symbols"), budget("max_edges"), q.number("min_coverage", 100), q.one("expect", "reachable"))
        case "graph.corridor":
            scoped = _faceted(symbols, q).select(F.col("symbol_id").alias("node"))
            return graph.corridor(edges(), nodes("from"), nodes("to"), q.number("max_depth", 8), budget("max_symbols"), budget("max_edges")).join(scoped, "node", "left_semi")
        case "identity.children":
            return graph.identity_children(symbols, q.one("prefix", "")).orderBy("segment")
        case "identity.graph":
            return paged(graph.identity_graph(symbols, refs, q.one("prefix", ""), q.number("min_count", 1)), ["section", F.desc("n"), "source", "target"])
        case "metrics.coupling":
            return graph.coupling(symbols, refs, q.one("from"), q.one("to"), relations)
        case "resolution.audit":
            rows = refs.filter(F.col("target_identity").contains(q.one("prefix", "")))  # a substring, not a path prefix
            return paged(linkage.audit(rows, ["kind", "status", "evidence", "reason"]), [F.desc("n"), "kind", "status", "evidence", "reason"])
        case "rules.list" | "rules.applicable":
            wanted = rules.profile(list(rule_set), q.values.get("rules", []))
            wanted = [r for r in wanted if r.severity in q.values.get("severity", [r.severity])]
            if q.verb == "rules.applicable":
                kind = ident.parse(q.one("focus"))[-1][0]
                wanted = [r for r in wanted if r.kind == kind]
            return spark.createDataFrame([(r.rule_id, r.kind, r.severity, r.expr) for r in wanted], "rule_id string, kind string, severity string, expr string")
        case "rules.check":
            found = rules.check(symbols, rules.profile(list(rule_set), q.values.get("rules", [])), refs)
            if "file" in q.values:
                found = found.join(symbols.filter(F.col("path").isin(*q.values["file"])).select("symbol_id"), "symbol_id", "left_semi")
            return paged(found, ["rule_id", "symbol_id"])
        case "notes":
            if note_table is None:
                raise QueryError("unavailable", "no notes are loaded")
            from spanloom.sources.files import list_notes

            return list_notes(note_table, q.one("moniker"), q.one("include_done", "false") == "true")
        case "change.context":
            focus = q.one("focus")
            part = lambda n, df: df.limit(search.bounded(q.number("max_items", 20), ceiling=100)).select(F.lit(n).alias("section"), F.to_json(F.struct("*")).alias("item"))
            out = part("graph", graph.symbol_graph(symbols, refs, focus))
            if rule_set:
                out = out.unionByName(part("rules", rules.check(symbols.filter(ident.in_scope("identity", focus)), list(rule_set), refs)))
            return out
        case _:
            raise QueryError("unsupported", f"{q.verb} needs a parser or two generations; see spanloom.operators.changes")
