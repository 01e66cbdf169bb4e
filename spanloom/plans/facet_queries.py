"""Scans, identity algebra, facets, projections, search and paging over the star graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import identity as ident
from spanloom.operators import graph, search
from spanloom.plans.base import Queries

Q = Queries()
add = Q.add


@add("SELECT symbol_id, source_id, CAST(parent_id AS VARCHAR) AS parent_id, identity, name, kind, shape, visibility, srcset, CAST(start_line AS VARCHAR) AS start_line, CAST(end_line AS VARCHAR) AS end_line, depth, navigable, path FROM sym")
def symbols_scan(g):
    return g.symbols.withColumns({c: F.col(c).cast("string") for c in ("parent_id", "start_line", "end_line")})


@add("SELECT reference_id, source_symbol_id, source_id, target_identity, kind, status, CAST(target_id AS VARCHAR) AS target_id, CAST(candidate_id AS VARCHAR) AS candidate_id, evidence, reason FROM ref")
def references_scan(g):
    return g.refs.withColumns({c: F.col(c).cast("string") for c in ("target_id", "candidate_id")})


@add("""SELECT symbol_id, identity FROM sym WHERE kind = 'order' AND visibility = 'F' AND srcset <> '1-URGENT'""")
def facet_exact(g):
    return g.symbols.filter("kind = 'order' and visibility = 'F' and srcset <> '1-URGENT'").select("symbol_id", "identity")


@add("""SELECT symbol_id, name FROM sym WHERE shape IN ('type', 'namespace') AND regexp_matches(name, '^(A|1.*7$|Brand#[1-3]2)')""")
def facet_regex(g):
    return g.symbols.filter(F.col("shape").isin("type", "namespace") & F.col("name").rlike("(?U)^(A|1.*7$|Brand#[1-3]2)")).select("symbol_id", "name")


@add("""SELECT symbol_id, identity FROM sym WHERE regexp_matches(identity, '^region:(AFRICA|ASIA)/([^/]*/)*customer:[^/]*/order:[^/]*$')""")
def facet_path(g):
    rows = g.symbols.filter("kind = 'order'").withColumn("segs", ident.segments("identity"))
    return rows.filter(ident.matches_path("segs", "region:/^(AFRICA|ASIA)$/**/customer:*/order:*".replace("$/**", "$//**"))).select("symbol_id", "identity")


@add("""SELECT symbol_id, regexp_extract(identity, 'nation:([^/]*)', 1) AS nation, CASE WHEN identity LIKE '%customer:%' THEN regexp_extract(identity, 'customer:([^/]*)', 1) ELSE '' END AS customer,
 CASE WHEN kind = 'nation' AND name = 'NATION_7' OR identity LIKE '%/nation:NATION_7/%' THEN true ELSE false END AS in_nation_7 FROM sym WHERE kind <> 'line'""")
def segment_lookup(g):
    rows = g.symbols.filter("kind <> 'line'").withColumn("segs", ident.segments("identity"))
    return rows.select("symbol_id", ident.segment("segs", "nation").alias("nation"), ident.segment("segs", "customer").alias("customer"), ident.has_segment("segs", "nation", "NATION_7").alias("in_nation_7"))


@add("""SELECT a.symbol_id AS ancestor_id, count(*) AS descendants FROM sym a JOIN sym b ON a.kind IN ('region', 'nation') AND b.kind IN ('customer', 'supplier', 'nation', 'region')
 AND (b.identity = a.identity OR starts_with(b.identity, a.identity || '/')) GROUP BY 1""")
def ancestor_filter(g):
    above = g.symbols.filter("kind in ('region', 'nation')").select(F.col("symbol_id").alias("ancestor_id"), F.col("identity").alias("prefix"))
    below = g.symbols.filter("kind in ('customer', 'supplier', 'nation', 'region')").select(F.explode(ident.ancestors("identity")).alias("prefix"))
    return below.join(above, "prefix").groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("descendants"))


@add("""SELECT symbol_id, CASE WHEN contains(identity, '/') THEN regexp_replace(identity, '/[^/]*$', '') END AS parent, kind AS last_kind, name AS last_name, depth FROM sym""")
def identity_parts(g):
    return g.symbols.select("symbol_id", ident.parent("identity").alias("parent"), ident.last_kind("identity").alias("last_kind"), ident.last_name("identity").alias("last_name"), ident.depth("identity").alias("depth"))


@add("""SELECT a.symbol_id AS left_id, b.symbol_id AS right_id FROM sym a JOIN sym b ON a.kind = 'customer' AND b.kind = 'supplier' AND a.name = b.name AND a.parent_id = b.parent_id""")
def bind_match_join(g):
    a = g.symbols.filter("kind = 'customer'").select(F.col("symbol_id").alias("left_id"), F.col("identity").alias("a"), ident.bind_key("identity").alias("key"))
    b = g.symbols.filter("kind = 'supplier'").select(F.col("symbol_id").alias("right_id"), F.col("identity").alias("b"), ident.bind_key("identity").alias("key"))
    return a.join(b, "key").filter(ident.bind_match("a", "b")).select("left_id", "right_id")


@add("""SELECT page_id, 'lang:html/path:`' || url || '`/section:part `` ' || page_id || '``/item:a:' || page_id AS identity, 4 AS depth, 'lang:html/path:`' || url || '`/section:`part ```` ' || page_id || '`````' AS parent, 'item' AS last_kind,
 'a:' || page_id AS last_name, 'path:`' || url || '`' AS second, url AS name FROM pages""".replace("section:part `` ' || page_id || '``/item", "section:`part ```` ' || page_id || '`````/item"), graph=False)
def identity_quoted(g):
    """Identities whose names hold slashes, colons, blanks and back-ticks: written, read back and taken apart."""
    lit = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    segs = F.array(lit("lang", F.lit("html")), lit("path", F.col("url")), lit("section", F.concat(F.lit("part `` "), F.col("page_id"), F.lit("``"))), lit("item", F.concat(F.lit("a:"), F.col("page_id"))))
    rows = g.table("pages").select("page_id", ident.serialise(segs).alias("identity"))
    return rows.select(
        "page_id", "identity", ident.depth("identity").alias("depth"), ident.parent("identity").alias("parent"), ident.last_kind("identity").alias("last_kind"), ident.last_name("identity").alias("last_name"),
        ident.child_of("identity", "lang:html").alias("second"), ident.segment(ident.segments("identity"), "path").alias("name"),
    )


@add("""SELECT symbol_id, rank() OVER (ORDER BY len(split_part(identity, '/', 1)) - 7, split_part(identity, '/', 1), depth, len(name), name) AS pos FROM sym WHERE kind IN ('region', 'nation')""")
def identity_order(g):
    """Regions and nations in tree order: shorter components first, a parent before its children."""
    rows = g.symbols.filter("kind in ('region', 'nation')").withColumn("key", ident.sort_key(ident.segments("identity")))
    return rows.select("symbol_id", F.expr("rank() over (order by key)").cast("long").alias("pos"))


@add("""SELECT symbol_id, identity AS again FROM sym WHERE kind IN ('supplier', 'brand', 'part')""")
def uri_round_trip(g):
    """The star graph's identities read and written again as they are, with bare blanks."""
    rows = g.symbols.filter("kind in ('supplier', 'brand', 'part')")
    return rows.select("symbol_id", ident.serialise(ident.segments("identity"), ident.BARE_BLANKS).alias("again"))


@add("""SELECT symbol_id, 'no ' || kind || ' named ' || replace(lower(name), ' ', '_') || ' in ' || path AS message FROM sym WHERE kind IN ('nation', 'region')""")
def message_template(g):
    return g.symbols.filter("kind in ('nation', 'region')").select(
        "symbol_id", ident.render("no {kind} named {name.snake} in {path}", {"kind": F.col("kind"), "name": F.col("name"), "path": F.col("path")}).alias("message")
    )


@add(""", wanted AS (SELECT * FROM (VALUES ('region:ASIA'), ('nation:NATION_7'), ('customer:7'), ('region:NOWHERE')) t(ref)),
hits AS (SELECT ref, symbol_id, CASE WHEN identity = ref THEN 1 ELSE 2 END AS tier FROM wanted JOIN sym ON sym.kind IN ('region', 'nation', 'customer') AND (identity = ref OR kind || ':' || name = ref)),
best AS (SELECT ref, min(tier) AS tier FROM hits GROUP BY 1)
SELECT wanted.ref, CASE WHEN count(hits.symbol_id) = 0 THEN 'symbol_not_found' WHEN count(hits.symbol_id) > 1 THEN 'symbol_ambiguous' ELSE 'found' END AS outcome,
 CAST(CASE WHEN count(hits.symbol_id) = 1 THEN min(hits.symbol_id) END AS VARCHAR) AS symbol_id FROM wanted LEFT JOIN best USING (ref) LEFT JOIN hits ON hits.ref = wanted.ref AND hits.tier = best.tier GROUP BY 1""")
def lookup_by_reference(g):
    return search.lookup(g.symbols.filter("kind in ('region', 'nation', 'customer')"), ["region:ASIA", "nation:NATION_7", "customer:7", "region:NOWHERE"]).withColumn("symbol_id", F.col("symbol_id").cast("string"))


@add("""SELECT reference_id, kind, target_identity FROM ref WHERE kind IN ('calls', 'references') AND starts_with(target_identity, 'region:ASIA/') AND regexp_matches(target_identity, '(1|3)$')""")
def extract_filter(g):
    return search.extract_filter(g.refs, kinds=["calls", "references"], under="region:ASIA", names=["1$", "3$"], identity="target_identity").select("reference_id", "kind", "target_identity")


@add("""SELECT symbol_id FROM sym WHERE (kind = 'nation' OR shape = 'callable') AND contains(lower(name), '1')""")
def kind_or_shape_with_text(g):
    return g.symbols.filter(search.kind_shape("nation", "callable", text=True) & F.lower("name").contains("1")).select("symbol_id")


@add("""SELECT path, count(*) AS n FROM sym WHERE regexp_matches(path, '^src/customers/[^/]/[^/]*7\\.star$') OR path LIKE 'src/brands/%' OR regexp_matches(path, '^([^/]+/)*nation\\.star$') GROUP BY 1""")
def file_globs(g):
    return g.symbols.filter(ident.matches_glob("path", ["src/customers/?/*7.star", "src/brands", "**/nation.star"])).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@add("""SELECT path, count(*) AS n FROM sym WHERE NOT path LIKE 'src/customers/%' GROUP BY 1""")
def glob_exclusion(g):
    return g.symbols.filter(~ident.matches_glob("path", ["src/customers/**"])).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@add("""SELECT symbol_id FROM sym WHERE kind = 'order' AND name = '17' UNION ALL SELECT symbol_id FROM sym WHERE kind = 'order' AND regexp_matches(name, '^17\\(') AND NOT EXISTS (SELECT 1 FROM sym WHERE kind = 'order' AND name = '17')""")
def callable_fallback(g):
    return search.callable_fallback(g.symbols.filter("kind = 'order'"), "17").select("symbol_id")


@add("""SELECT symbol_id, path LIKE '%/5/%' AS is_test FROM sym WHERE kind = 'customer'""")
def artifact_flag(g):
    return g.symbols.filter("kind = 'customer'").select("symbol_id", search.is_test("kind", "name", "path", ("5",)).alias("is_test"))


@add("""SELECT c.symbol_id, c.name, c.kind, c.shape, CAST(c.end_line - c.start_line + 1 AS VARCHAR) AS lines, c.depth, p.name AS parent_name, p.kind AS parent_kind, p.srcset AS parent_srcset
 FROM sym c LEFT JOIN sym p ON c.parent_id = p.symbol_id WHERE c.kind IN ('order', 'line')""")
def def_projections(g):
    own = g.symbols.filter("kind in ('order', 'line')")
    up = g.symbols.select(F.col("symbol_id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("kind").alias("parent_kind"), F.col("srcset").alias("parent_srcset"))
    return own.join(up, "parent_id", "left").select(
        "symbol_id", "name", "kind", "shape", (F.col("end_line") - F.col("start_line") + 1).cast("string").alias("lines"), "depth", "parent_name", "parent_kind", "parent_srcset"
    )


@add("""SELECT reference_id, ref.kind, s.kind AS source_kind, s.visibility AS source_visibility, t.kind AS target_kind, CASE WHEN t.source_id = s.source_id THEN t.visibility END AS target_visibility
 FROM ref JOIN sym s ON s.symbol_id = source_symbol_id LEFT JOIN sym t ON t.symbol_id = target_id WHERE ref.kind IN ('references', 'located_in')""")
def ref_projections(g):
    """The target's visibility is known where the target is in the same file; elsewhere it doesn't apply."""
    s = g.symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("kind").alias("source_kind"), F.col("visibility").alias("source_visibility"), F.col("source_id").alias("sf"))
    t = g.symbols.select(F.col("symbol_id").alias("target_id"), F.col("kind").alias("target_kind"), F.col("visibility").alias("tv"), F.col("source_id").alias("tf"))
    rows = g.refs.filter("kind in ('references', 'located_in')").join(s, "source_symbol_id").join(t, "target_id", "left")
    return rows.select("reference_id", "kind", "source_kind", "source_visibility", "target_kind", F.when(F.col("tf") == F.col("sf"), F.col("tv")).alias("target_visibility"))


_SCORE = """CASE WHEN lower({c}) = '{t}' THEN {e} WHEN contains(lower({c}), '{t}') THEN {s} + CASE WHEN starts_with(lower({c}), '{t}') THEN 30 ELSE 0 END + greatest(0, 30 - (length({c}) - length('{t}'))) ELSE 0 END"""


def _score(t):
    return " + ".join(_SCORE.format(c=c, t=t, e=2 * e, s=s) for c, e, s in (("name", 120, 50), ("kind", 35, 20), ("identity", 20, 10)))


@add(f""", s AS (SELECT symbol_id, identity, CAST({_score('asia')} AS BIGINT) AS score FROM sym WHERE navigable)
SELECT symbol_id, identity, score FROM s WHERE score > 0 ORDER BY score DESC, identity LIMIT 50""")
def symbol_search_ranked(g):
    return search.search(g.symbols.filter("navigable"), "asia", 50)


@add(f""", s AS (SELECT symbol_id, identity, CAST({_score('asia')} AS BIGINT) AS score FROM sym WHERE navigable), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, identity) AS position FROM s WHERE score > 0)
SELECT symbol_id, identity, score, position, (SELECT count(*) FROM o) AS total FROM o WHERE position > 20 AND position <= 40""")
def search_page2(g):
    return search.page(search.scored(g.symbols.filter("navigable"), "asia"), [F.desc("score"), F.asc("identity")], offset=20, limit=20)


@add("""SELECT symbol_id, row_number() OVER (ORDER BY path LIKE '%/5/%', path, start_line NULLS FIRST, symbol_id) AS position FROM sym WHERE kind IN ('customer', 'supplier')""")
def navigation_order(g):
    rows = g.symbols.filter("kind in ('customer', 'supplier')").withColumn("test", search.is_test("kind", "name", "path", ("5",)))
    top = search.ranked(rows, ["test", "path", "start_line", "symbol_id"])
    return top.select("symbol_id", "position")


@add(""", o AS (SELECT reference_id, kind, target_identity, row_number() OVER (ORDER BY kind, target_identity, reference_id) AS position FROM ref WHERE kind = 'calls'),
 l AS (SELECT target_identity AS g FROM o WHERE position = 25) SELECT reference_id, target_identity, position FROM o, l WHERE position <= 25 OR target_identity = g""")
def usage_page_by_group(g):
    return search.group_page(g.refs.filter("kind = 'calls'"), ["kind", "target_identity", "reference_id"], "target_identity", 25).select("reference_id", "target_identity", "position")


@add("""SELECT symbol_id, identity FROM sym WHERE kind = 'customer' AND (identity, symbol_id) > ('region:ASIA', 0) ORDER BY identity, symbol_id LIMIT 30""")
def keyset_page(g):
    return search.keyset(g.symbols.filter("kind = 'customer'"), "identity", "symbol_id", ("region:ASIA", 0), 30).select("symbol_id", "identity")


@add("""SELECT doc_id, n_terms FROM (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_terms FROM documents)""", graph=False)
def source_text_scan(g):
    return g.table("documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_terms"))


@add("""SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents WHERE text IS NOT NULL""", graph=False)
def symbol_detail_snippet(g):
    """Lines 2 to 4 of every source: the context of a symbol on line 3."""
    return g.table("documents").filter("text is not null").select("doc_id", search.snippet(F.col("text"), F.lit(3), F.lit(3), 1).alias("snippet"))
