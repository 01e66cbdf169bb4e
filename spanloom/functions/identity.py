"""Identity algebra: predicates and projections on `kind:name/kind:name/…` identities, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that hold one of these are quoted with back-ticks, and a back-tick in them is doubled.
_SPECIAL = r"[/` \t\n\f\r]"
#: The least that must be quoted to be read back; the star graph's identities leave blanks bare.
BARE_BLANKS = "[/`]"
_SEGMENT = r"[^/:`]+:(?:`(?:[^`]|``)*`|[^/`]*)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def write_segment(kind: str, name: str) -> str:
    return f"{kind}:" + ("`" + name.replace("`", "``") + "`" if re.search(_SPECIAL, name) or not name else name)


def parse(identity: str) -> list[tuple[str, str]]:
    """Segments of an identity, on the driver."""
    out = []
    for found in re.findall(_SEGMENT, identity):
        kind, _, name = found.partition(":")
        out.append((kind, name[1:-1].replace("``", "`") if name.startswith("`") else name))
    return out


def _unquoted(raw: Column) -> Column:
    return F.when(raw.startswith("`"), F.replace(F.regexp_replace(raw, "^`|`$", ""), F.lit("``"), F.lit("`"))).otherwise(raw)


def segments(identity: Column | str) -> Column:
    """array<struct<kind, name>>; quoted names may hold slashes and colons."""
    found = F.regexp_extract_all(_c(identity), F.lit(f"({_SEGMENT})"), F.lit(1))

    def one(s: Column) -> Column:
        return F.struct(F.substring_index(s, ":", 1).alias("kind"), _unquoted(F.regexp_replace(s, "^[^:]*:", "")).alias("name"))

    return F.transform(found, one)


def serialise(segs: Column | str, special: str = _SPECIAL) -> Column:
    """The identity as text; names that hold what special matches, and empty ones, are quoted."""

    def one(s: Column) -> Column:
        quoted = F.concat(F.lit("`"), F.replace(s["name"], F.lit("`"), F.lit("``")), F.lit("`"))
        return F.concat(s["kind"], F.lit(":"), F.when(s["name"].rlike(special) | (s["name"] == ""), quoted).otherwise(s["name"]))

    return F.array_join(F.transform(_c(segs), one), "/")


def _quoted(identity: Column | str) -> Column:
    return _c(identity).contains("`")


def raw_segments(identity: Column | str) -> Column:
    """array<string>: the segments as they are written; slashes inside back-ticks don't part them."""
    return F.regexp_extract_all(_c(identity), F.lit(f"({_SEGMENT})"), F.lit(1))


def is_ancestor(a: Column | str, b: Column | str) -> Column:
    """a @> b: b is a or lies under it."""
    return (_c(a) == _c(b)) | _c(b).startswith(F.concat(_c(a), F.lit("/")))


def is_descendant(a: Column | str, b: Column | str) -> Column:
    return is_ancestor(b, a)


def in_scope(identity: Column | str, prefix: str) -> Column:
    """Under an identity prefix, boundary included; an empty prefix is everything."""
    return F.lit(True) if not prefix else (_c(identity) == prefix) | _c(identity).startswith(prefix + "/")


def ancestors(identity: Column | str) -> Column:
    """The identity and all its prefixes, shortest first: what turns a prefix join into an equi-join.

    Without quoted names the k-th prefix is cut at the k-th slash; else prefixes are put together from whole segments."""
    parts = raw_segments(identity)
    plain = F.transform(F.sequence(F.lit(1), F.size(F.split(_c(identity), "/"))), lambda i: F.call_function("substring_index", _c(identity), F.lit("/"), i))
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(_quoted(identity), whole).otherwise(plain)


def bare_name(name: Column | str) -> Column:
    return F.substring_index(_c(name), "(", 1)


def parent(identity: Column | str) -> Column:
    """All but the last segment; null for a root."""
    return F.nullif(F.regexp_replace(_c(identity), f"(?:^|/){_SEGMENT}$", ""), F.lit(""))


def last_segment(identity: Column | str) -> Column:
    return F.when(_quoted(identity), F.get(raw_segments(identity), F.size(raw_segments(identity)) - 1)).otherwise(F.substring_index(_c(identity), "/", -1))


def last_kind(identity: Column | str) -> Column:
    return F.substring_index(last_segment(identity), ":", 1)


def last_name(identity: Column | str) -> Column:
    """The last segment's name, without its quotes."""
    return _unquoted(F.regexp_replace(last_segment(identity), "^[^:]*:", ""))


def depth(identity: Column | str) -> Column:
    return F.when(_quoted(identity), F.size(raw_segments(identity))).otherwise(F.size(F.split(_c(identity), "/")))


def cut(identity: Column | str, n: int) -> Column:
    """The first n segments."""
    return F.when(_quoted(identity), F.array_join(F.slice(raw_segments(identity), 1, n), "/")).otherwise(F.substring_index(_c(identity), "/", n))


def child_of(identity: Column | str, prefix: str) -> Column:
    """The segment right below a prefix, or null outside of it; an empty prefix is above all."""
    if not prefix:
        return cut(identity, 1)
    return F.when(_c(identity).startswith(prefix + "/"), cut(F.substring(_c(identity), len(prefix) + 2, 2**31 - 1), 1))


def segment(segs: Column | str, kind: str) -> Column:
    """The name of the first segment of that kind, '' where there is none."""
    return F.coalesce(F.get(F.filter(_c(segs), lambda s: s["kind"] == kind), F.lit(0))["name"], F.lit(""))


def all_segments(segs: Column | str, kind: str) -> Column:
    """All names of that kind joined by dots, with backslashes and dots in them escaped: a group key."""
    names = F.transform(F.filter(_c(segs), lambda s: s["kind"] == kind), lambda s: F.regexp_replace(s["name"], r"([\\.])", r"\\$1"))
    return F.array_join(names, ".")


def has_segment(segs: Column | str, kind: str, name: str) -> Column:
    return F.exists(_c(segs), lambda s: (s["kind"] == kind) & (s["name"] == name))


#: Languages in which a match by name leaves parameters aside.
BARE_LANGUAGES = ("sql", "ts", "java", "python", "rs", "go", "cs")


def bind_key(identity: Column | str) -> Column:
    """An equi-join key that all pairs of bind_match share: the parent path and the last name without its parameters."""
    return F.concat_ws("\u0001", F.coalesce(parent(identity), F.lit("")), bare_name(last_name(identity)))


def bind_match(a: Column | str, b: Column | str) -> Column:
    """a ?= b: the same but for the last kind; parameters are left aside where both are of one language that has them."""
    x, y = last_name(a), last_name(b)
    lang = segment(segments(a), "lang")
    bare = (lang == segment(segments(b), "lang")) & lang.isin(*BARE_LANGUAGES) & (bare_name(x) == bare_name(y))
    return parent(a).eqNullSafe(parent(b)) & ((x == y) | bare)


def sort_key(segs: Column | str) -> Column:
    """Binary key in tree order: a parent comes before what lies under it, by length-prefixed components."""
    def part(x: Column) -> Column:
        return F.concat(F.lpad(F.hex(F.octet_length(x)), 4, "0"), F.hex(F.encode(x, "UTF-8")))

    return F.unhex(F.array_join(F.transform(_c(segs), lambda s: F.concat(part(s["kind"]), part(s["name"]))), ""))


def snake(name: Column | str) -> Column:
    split = F.regexp_replace(F.regexp_replace(_c(name), "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(split, r"[\s-]+", "_"))


def render(template: str, values: dict[str, Column]) -> Column:
    """A message with {name}, {name.snake} and the like filled in; unknown keys stay as they are."""
    parts = []
    for piece in re.split(r"(\{[a-z_.]+\})", template):
        key = piece[1:-1]
        if piece.startswith("{") and key in values:
            parts.append(F.coalesce(values[key].cast("string"), F.lit("")))
        elif piece.startswith("{") and key.endswith(".snake") and key[:-6] in values:
            parts.append(F.coalesce(snake(values[key[:-6]].cast("string")), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def _steps(pattern: str) -> list[tuple[str, str]]:
    """(kind, name) of each step; ('**', ''), ('*', '*') and names written /re/ among them."""
    out, at = [], 0
    while at < len(pattern):
        m = re.compile(r"(\*\*)(?:/|$)|([^:/`]+):/((?:[^/\\]|\\.)*)/(?:/|$)|([^:/`]+):(`(?:[^`]|``)*`|[^/`]*)(?:/|$)|(\*)(?:/|$)").match(pattern, at)
        if not m or m.end() == at:
            raise ValueError(f"no path step at {pattern[at:]!r}")
        if m[1]:
            out.append(("**", ""))
        elif m[2]:
            if re.search(r"\(\?<?[=!]|\\[1-9]", m[3]):
                raise ValueError("look-around and back-references are not supported")
            out.append((m[2], f"/{m[3]}/"))
        elif m[4]:
            out.append((m[4], m[5][1:-1].replace("``", "`") if m[5].startswith("`") else m[5]))
        else:
            out.append(("*", "*"))
        at = m.end()
    return out


def matches_path(segs: Column | str, pattern: str) -> Column:
    """~ : the whole path against steps `kind:name`, `kind:*`, `*:name`, `*`, `kind:/re/` and `**` (any number of segments).

    Regex steps are tried on each segment and leave a mark; then one anchored pattern over the marked path decides."""
    steps = _steps(pattern)
    tried = [name[1:-1] for _, name in steps if len(name) > 1 and name[0] == name[-1] == "/"]

    def mark(s: Column) -> Column:
        flags = [F.when(s["name"].rlike(f"(?U){r}"), F.lit("1")).otherwise(F.lit("0")) for r in tried]
        return F.concat(F.lit("\u0001"), s["kind"], F.lit("\u0002"), s["name"], F.lit("\u0003"), *flags)

    text, k = "", 0
    for kind, name in steps:
        if kind == "**":
            text += "(?:\u0001[^\u0001]*)*"
            continue
        text += "\u0001" + ("[^\u0001\u0002]*" if kind == "*" else re.escape(kind)) + "\u0002"
        if len(name) > 1 and name[0] == name[-1] == "/":
            text += f"[^\u0001\u0003]*\u0003[01]{{{k}}}1[01]*"
            k += 1
        else:
            text += ("[^\u0001\u0003]*" if name == "*" else re.escape(name)) + "\u0003[01]*"
    return F.array_join(F.transform(_c(segs), mark), "").rlike(f"^(?:{text})$")


def glob_regex(glob: str) -> str:
    """`*` inside a path component, `?` one character, `**` any depth."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def matches_glob(path: Column | str, globs: list[str]) -> Column:
    """Any of the globs, or a plain prefix where it has no wildcard; file:// is looked through."""
    plain = F.regexp_replace(_c(path), "^file://", "")
    out = F.lit(False)
    for g in globs:
        out = out | (plain.rlike(glob_regex(g)) if re.search(r"[*?]", g) else (plain == g) | plain.startswith(g.rstrip("/") + "/"))
    return out
