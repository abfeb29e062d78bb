"""Named queries over the driver tables, each with the DuckDB SQL that gives the same rows.

The tables stand in for the parts of word-processing documents: documents split at line feeds are block lists, pages
are markup parts, conversations are comment threads and list items, lineitem rows are table rows, events are edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fonts, markup, numbers
from ..operators import blocks, comments, compare, history, layout, quality, runs, sections, styles, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Highlight colours by name (fixed values).
PALETTE = {
    "black": "#000000", "blue": "#0000FF", "cyan": "#00FFFF", "darkBlue": "#00008B", "darkCyan": "#008B8B", "darkGray": "#A9A9A9", "darkGreen": "#006400", "darkMagenta": "#8B008B", "darkRed": "#8B0000", "darkYellow": "#808000", "green": "#00FF00",
    "lightGray": "#D3D3D3", "magenta": "#FF00FF", "red": "#FF0000", "white": "#FFFFFF", "yellow": "#FFFF00",
}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sources and blocks

LINES = "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS node_index, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(LINES)
def blocks_from_text(spark, d):
    return blocks.text_blocks(table(spark, d, "documents"))


@query(rf"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY node_index) - 1 AS INTEGER) AS node_index, text FROM ({LINES}) WHERE regexp_matches(text, '\S')")
def nonempty_blocks_ranked(spark, d):
    return blocks.nonempty_blocks(blocks.text_blocks(table(spark, d, "documents")))


HEIGHTS = f"SELECT doc_id, node_index, CASE WHEN node_index = 0 THEN 41.0 ELSE 22.0 END AS height, CASE WHEN node_index = 0 THEN 20.0 ELSE 8.0 END AS gap FROM ({LINES})"


def heights(docs: DataFrame) -> DataFrame:
    level = F.when(F.col("node_index") == 0, 1)
    size = layout.run_height(F.lit(None).cast("double"))
    return blocks.text_blocks(docs).select("doc_id", "node_index", layout.line_height(size, level).cast("double").alias("height"), layout.block_gap(level).cast("double").alias("gap"))


@query(HEIGHTS)
def block_heights(spark, d):
    return heights(table(spark, d, "documents"))


PAGED = f"""
WITH RECURSIVE b AS ({HEIGHTS}),
p AS (
  SELECT doc_id, node_index, 1 AS page, 72.0::DOUBLE AS y, (72.0 + height + gap)::DOUBLE AS below FROM b WHERE node_index = 0
  UNION ALL
  SELECT b.doc_id, b.node_index, CASE WHEN below + height > 984 THEN page + 1 ELSE page END, CASE WHEN below + height > 984 THEN 72.0 ELSE below END,
         CASE WHEN below + height > 984 THEN 72.0 ELSE below END + height + gap
  FROM p JOIN b ON b.doc_id = p.doc_id AND b.node_index = p.node_index + 1)
"""


@query(PAGED + "SELECT lang, sum(pages)::BIGINT AS pages, count(*) AS docs FROM (SELECT doc_id, max(page) AS pages FROM p GROUP BY doc_id) JOIN documents USING (doc_id) GROUP BY lang")
def paginate_simple(spark, d):
    docs = table(spark, d, "documents")
    pages = layout.page_counts(heights(docs))
    return pages.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("pages").alias("pages"), F.count("*").alias("docs"))


@query(PAGED + "SELECT doc_id, node_index, page, y FROM p")
def paginate_blocks(spark, d):
    return layout.paginate(heights(table(spark, d, "documents")))


BREAKS = f"SELECT doc_id, node_index FROM ({LINES}) WHERE node_index > 0 AND length(text) % 7 = 0"


@query(f"""
WITH n AS (SELECT doc_id, count(*) AS n FROM ({LINES}) GROUP BY doc_id),
s AS (SELECT doc_id, 0 AS start, n FROM n UNION SELECT doc_id, node_index, n FROM ({BREAKS}) JOIN n USING (doc_id) WHERE node_index < n)
SELECT doc_id, row_number() OVER w - 1 AS page, start, coalesce(lead(start) OVER w, n) AS "end" FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY start)
""")
def page_ranges(spark, d):
    lines = blocks.text_blocks(table(spark, d, "documents"))
    return layout.page_ranges(lines.where("node_index > 0 AND length(text) % 7 = 0").select("doc_id", "node_index"), lines.groupBy("doc_id").agg(F.count("*").alias("n")))


@query(f"""
SELECT doc_id, node_index FROM (
  SELECT doc_id, node_index, length(text) % 5 = 0 OR coalesce(lag(text LIKE '%|%') OVER w, false) AS hit, row_number() OVER w AS nth
  FROM ({LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY node_index)) WHERE hit AND nth > 1
""")
def hard_breaks(spark, d):
    lines = blocks.text_blocks(table(spark, d, "documents"))
    return layout.hard_breaks(lines.select("doc_id", "node_index", (F.length("text") % 5 == 0).alias("break_before"), F.contains("text", F.lit("|")).alias("break_inside")))


@query("""
SELECT table_id, count(*) FILTER (WHERE upto <= 62 OR nth = 1) AS rows_fit, max(upto) FILTER (WHERE upto <= 62 OR nth = 1) AS used FROM (
  SELECT l_orderkey AS table_id, row_number() OVER w AS nth, sum(greatest(1, l_quantity)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) GROUP BY table_id
""")
def fit_rows_in_page(spark, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), place.alias("row"), F.col("l_quantity").alias("height"))
    return layout.fit_rows(rows, 60)


@query("SELECT doc_id, greatest(42, least(120, floor(n_chars * 0.18 + 0.5)))::DOUBLE AS hint_limit FROM documents")
def rendered_break_hint(spark, d):
    return table(spark, d, "documents").select("doc_id", layout.break_hint_limit(F.col("n_chars")).cast("double").alias("hint_limit"))


# ---- markup


@query(r"SELECT page_id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS ord, unnest(b) AS block FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?/>|<li(?:\s[^>]*)?>.*?</li>') AS b FROM pages)")
def html_tag_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(markup.tag_blocks(F.col("html"), "li")).alias("ord", "block"))


@query(r"""
SELECT page_id, ord, CASE WHEN starts_with(target, 'http') OR starts_with(target, '#') THEN target WHEN contains(target, '#') THEN target ELSE target || '#' || page_id END AS href
FROM (SELECT page_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS ord, unnest(t) AS target FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]+)"', 1) AS t FROM pages))
""")
def html_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]+)"'), F.lit(1))).alias("ord", "target"))
    plain = F.startswith("target", F.lit("http")) | F.startswith("target", F.lit("#"))
    return links.select("page_id", "ord", F.when(plain, F.col("target")).otherwise(markup.hyperlink(F.col("target"), F.col("page_id").cast("string"))).alias("href"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?i)<title(?:\s[^>]*)?>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.squeeze(F.regexp_extract("html", r"(?i)<title(?:\s[^>]*)?>([^<]*)</title>", 1)).alias("title"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS decoded FROM pages")
def entity_decode(spark, d):
    return table(spark, d, "pages").select("page_id", markup.decode_entities(F.col("html")).alias("decoded"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def escape_xml(spark, d):
    return table(spark, d, "documents").select("doc_id", markup.escape_text(F.col("text")).alias("escaped"))


@query(r"SELECT p_partkey, TRY_CAST(regexp_extract('Heading ' || (p_size % 9) || ' ' || p_name, '(?i)heading\s*([1-6])', 1) AS INTEGER) AS level FROM part")
def heading_level(spark, d):
    name = F.concat(F.lit("Heading "), (F.col("p_size") % 9).cast("string"), F.lit(" "), "p_name")
    return table(spark, d, "part").select("p_partkey", markup.heading_level(name).alias("level"))


@query("""
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN k IN ('0', '1', '2', '3') THEN k NOT IN ('0') ELSE true END AS flag
FROM (SELECT event_id, event_type, CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 5 AS VARCHAR) AS k FROM events)
""")
def on_off_values(spark, d):
    k = (F.regexp_extract("props", "[0-9]+", 0).cast("bigint") % 5).cast("string")
    xml = F.when(F.col("event_type") == "view", "<w:i/>").when(k.isin("0", "1", "2", "3"), F.concat(F.lit('<w:b w:val="'), k, F.lit('"/>'))).otherwise("<w:b/>")
    return table(spark, d, "events").select("event_id", markup.on_off(xml, "w:b").alias("flag"))


@query(r"""
SELECT page_id, 'word/_rels/p' || page_id || '.xml.rels' AS rels, url AS absolute, 'word/media/i' || page_id || '.png' AS sibling, 'media/i' || page_id || '.png' AS up, 'x/' || page_id AS root FROM pages
""")
def resolve_part_path(spark, d):
    i = F.col("page_id").cast("string")
    base = F.concat(F.lit("word/p"), i, F.lit(".xml"))
    at = lambda *x: F.concat(*[F.lit(s) if isinstance(s, str) else s for s in x])
    return table(spark, d, "pages").select(
        "page_id", markup.rels_part(base).alias("rels"), markup.resolve_path(base, F.col("url")).alias("absolute"), markup.resolve_path(base, at("./media//i", i, ".png")).alias("sibling"),
        markup.resolve_path(base, at("../word/.././media/i", i, ".png")).alias("up"), markup.resolve_path(base, at("/x/", i)).alias("root"),
    )


EXT = "CASE p_size % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'xml' WHEN 3 THEN 'svg' WHEN 4 THEN 'bin' ELSE 'rels' END"


@query(f"""
WITH p AS (SELECT p_partkey, '/word/' || p_partkey || '.' || {EXT} AS name, lower({EXT}) AS ext FROM part),
o AS (SELECT '/word/' || p_partkey || '.' || {EXT} AS name, p_brand AS type FROM part WHERE p_partkey % 11 = 0)
SELECT p_partkey, coalesce(o.type, CASE ext WHEN 'xml' THEN 'application/xml' WHEN 'rels' THEN 'application/rels' END, CASE ext WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' END) AS type
FROM p LEFT JOIN o USING (name)
""")
def content_type_lookup(spark, d):
    part = table(spark, d, "part")
    ext = F.element_at(F.array(*map(F.lit, ("png", "JPG", "xml", "svg", "bin", "rels"))), (F.col("p_size") % 6 + 1).cast("int"))
    named = part.select("p_partkey", F.concat(F.lit("/word/"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("name"), "p_brand")
    override = named.where("p_partkey % 11 = 0").select("name", F.col("p_brand").alias("own"))
    default = spark.createDataFrame([("xml", "application/xml"), ("rels", "application/rels")], "ext string, by_ext string")  # two rows
    return named.withColumn("ext", markup.extension(F.col("name"))).join(override, "name", "left").join(F.broadcast(default), "ext", "left").select("p_partkey", F.coalesce("own", "by_ext", markup.media_type(F.col("name"))).alias("type"))


@query(r"SELECT doc_id, regexp_replace('[' || (doc_id % 30) || ']  ' || text, '^\[[0-9]*\]\s*', '') AS stripped FROM documents")
def strip_index(spark, d):
    return table(spark, d, "documents").select("doc_id", markup.strip_leading_index(F.concat(F.lit("["), (F.col("doc_id") % 30).cast("string"), F.lit("]  "), "text")).alias("stripped"))


@query("SELECT p_partkey, round(p_retailprice / 9525, 3) AS px, greatest(floor(p_size / 15.0 + 0.5), 0)::BIGINT AS twips_px, '#' || upper(printf('%06x', p_partkey * 4097 % 16777216)) AS color, floor(p_size * (96 / 72.0) + 0.5)::BIGINT AS pt_px FROM part")
def unit_conversions(spark, d):
    color = F.lower(F.lpad(F.hex(F.col("p_partkey") * 4097 % 16777216), 6, "0"))
    return table(spark, d, "part").select(
        "p_partkey", markup.emu_to_pixels(F.col("p_retailprice").cast("string")).alias("px"), markup.twips_to_pixels(F.col("p_size").cast("string")).cast("bigint").alias("twips_px"), markup.hex_color(color).alias("color"),
        markup.css_length_to_pixels(F.concat(F.col("p_size").cast("string"), F.lit("pt"))).cast("bigint").alias("pt_px"),
    )


@query(r"SELECT doc_id, NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS valid, regexp_matches(text, '[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}]') AS east_asian, regexp_matches(text, '[\x{0590}-\x{08FF}\x{FB1D}-\x{FEFC}]') AS complex FROM documents")
def text_classes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", markup.valid_xml_text(t).alias("valid"), markup.east_asian(t).alias("east_asian"), markup.complex_script(t).alias("complex"))


# ---- sections


@query("""
SELECT e.event_id, o.o_orderkey AS section FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate) o
ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate
""")
def section_asof(spark, d):
    points = table(spark, d, "events").select("event_id", F.col("user_id").alias("grp"), "ts")
    starts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("grp"), "o_orderdate").agg(F.min("o_orderkey").alias("section"))
    return sections.as_of(points, starts, "grp", "ts", "o_orderdate", "section").select("event_id", "section")


@query("""
SELECT event_id, last_value(ref IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS inherited
FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN event_type || event_id END AS ref FROM events)
""")
def inherit_refs(spark, d):
    ref = F.when(F.col("event_type").isin("view", "click"), F.concat("event_type", F.col("event_id").cast("string")))
    rows = table(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("place"), ref.alias("ref"))
    return sections.inherit(rows, ["user_id"], "place", "ref").select("event_id", "inherited")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN first WHEN doc_id % 4 % 2 = 1 AND n_chars % 2 = 0 AND even IS NOT NULL THEN even ELSE coalesce(dflt, first, even) END AS part
FROM (SELECT *, CASE WHEN doc_id % 5 > 0 THEN 'first' END AS first, CASE WHEN doc_id % 7 > 2 THEN 'even' END AS even, CASE WHEN doc_id % 11 > 3 THEN 'default' END AS dflt FROM documents)
""")
def variant_select(spark, d):
    i = F.col("doc_id")
    v = sections.variant(i % 4, i % 3 == 0, F.col("n_chars") % 2 == 0, F.when(i % 5 > 0, "first"), F.when(i % 7 > 2, "even"), F.when(i % 11 > 3, "default"))
    return table(spark, d, "documents").select("doc_id", v.alias("part"))


# ---- tables

CELLS = "SELECT l_orderkey AS table_id, l_linenumber AS cell, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) % 4 AS span FROM lineitem"
CELL_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def line_cells(spark, d) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), F.lit(0).alias("row"), (place - 1).alias("cell"), (F.col("l_quantity").cast("bigint") % 4).alias("span"), "l_returnflag", "l_linestatus"
    )


NUMBERED = f"SELECT *, l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {CELL_ORDER}) - 1 AS cell, CAST(l_quantity AS BIGINT) % 4 AS span FROM lineitem"


@query(f"SELECT table_id, cell::INTEGER AS cell, coalesce(sum(greatest(span, 1)) OVER (PARTITION BY table_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grid_col FROM ({NUMBERED})")
def grid_cursor(spark, d):
    return tables.grid_columns(line_cells(spark, d)).select("table_id", "cell", "grid_col")


MERGE = "CASE l_returnflag WHEN 'A' THEN 'restart' WHEN 'R' THEN 'continue' END"


@query(f"""
WITH c AS (SELECT table_id, cell, {MERGE} AS m FROM ({NUMBERED})),
g AS (SELECT *, sum(CASE WHEN m = 'continue' THEN 0 ELSE 1 END) OVER (PARTITION BY table_id ORDER BY cell ROWS UNBOUNDED PRECEDING) AS grp FROM c),
h AS (SELECT *, first_value(m) OVER w AS hm, first_value(cell) OVER w AS hr, count(*) OVER (PARTITION BY table_id, grp) AS n FROM g WINDOW w AS (PARTITION BY table_id, grp ORDER BY cell))
SELECT table_id, cell::INTEGER AS row, (CASE WHEN m = 'continue' AND hm = 'restart' THEN hr ELSE cell END)::INTEGER AS anchor_row, (CASE WHEN m = 'restart' THEN n WHEN m = 'continue' AND hm = 'restart' THEN 0 ELSE 1 END)::BIGINT AS row_span FROM h
""")
def vmerge_rowspan(spark, d):
    merge = F.when(F.col("l_returnflag") == "A", "restart").when(F.col("l_returnflag") == "R", "continue")
    cells = line_cells(spark, d).select("table_id", F.lit(0).alias("grid_col"), F.col("cell").alias("row"), merge.alias("v_merge"))
    return tables.vertical_merges(cells).select("table_id", "row", "anchor_row", "row_span")


@query(f"""
SELECT table_id, cell::INTEGER AS cell, array_to_string(list_filter([
  'wholeTable', CASE WHEN cell >= 1 AND (cell - 1) % 2 = 0 THEN 'band1Horz' END, CASE WHEN cell >= 1 AND (cell - 1) % 2 = 1 THEN 'band2Horz' END, CASE WHEN c >= 1 AND (c - 1) % 2 = 0 THEN 'band1Vert' END, CASE WHEN c >= 1 AND (c - 1) % 2 = 1 THEN 'band2Vert' END,
  CASE WHEN cell = 0 THEN 'firstRow' END, CASE WHEN cell = n - 1 THEN 'lastRow' END, CASE WHEN c = 0 THEN 'firstCol' END, CASE WHEN c = 4 THEN 'lastCol' END, CASE WHEN cell = 0 AND c = 0 THEN 'nwCell' END, CASE WHEN cell = 0 AND c = 4 THEN 'neCell' END,
  CASE WHEN cell = n - 1 AND c = 0 THEN 'swCell' END, CASE WHEN cell = n - 1 AND c = 4 THEN 'seCell' END], lambda x: x IS NOT NULL), ',') AS conditions
FROM (SELECT table_id, cell, l_partkey % 5 AS c, count(*) OVER (PARTITION BY table_id) AS n FROM ({NUMBERED}))
""")
def band_conditions(spark, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (place - 1).alias("cell"), (F.col("l_partkey") % 5).alias("c"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    return cells.select("table_id", "cell", F.array_join(tables.conditions(F.col("cell"), F.col("n"), F.col("c"), F.lit(5)), ",").alias("conditions"))


@query(f"SELECT table_id, greatest(sum(greatest(span, 1)), 1)::BIGINT AS columns FROM ({NUMBERED}) GROUP BY table_id")
def table_columns(spark, d):
    return tables.column_counts(line_cells(spark, d))


# ---- numbering

LEVELS = "SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 ELSE 1 END AS ilvl FROM conversations"


@query(f"""
WITH c AS ({LEVELS}),
g AS (SELECT *, sum(CASE WHEN ilvl = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS top FROM c),
n AS (SELECT *, count(*) FILTER (WHERE ilvl = 1) OVER (PARTITION BY conv_id, top ORDER BY turn ROWS UNBOUNDED PRECEDING) AS sub FROM g)
SELECT conv_id, turn, CASE WHEN ilvl = 0 THEN top || '.' ELSE top || '.' || sub || ')' END AS label FROM n
""")
def numbering_labels(spark, d):
    from ..operators.numbering import counters

    items = table(spark, d, "conversations").select(F.col("conv_id").alias("list_id"), "turn", F.when(F.col("role") == "user", 0).otherwise(1).alias("ilvl"))
    c = counters(items, "list_id", "turn", 2)
    top, sub = F.coalesce(F.col("counts")[0], F.lit(0)).cast("string"), F.col("counts")[1].cast("string")
    return c.select(F.col("list_id").alias("conv_id"), "turn", F.when(F.col("ilvl") == 0, F.concat(top, F.lit("."))).otherwise(F.concat(top, F.lit("."), sub, F.lit(")"))).alias("label"))


@query("SELECT p_partkey, repeat(chr(CAST(97 + p_partkey % 26 AS INTEGER)), CAST(p_partkey // 26 + 1 AS INTEGER)) AS letter, CASE WHEN (p_partkey + 1) % 100 BETWEEN 11 AND 13 THEN (p_partkey + 1) || 'th' ELSE (p_partkey + 1) || CASE (p_partkey + 1) % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END AS ordinal FROM part")
def letter_format(spark, d):
    n = F.col("p_partkey") + 1
    return table(spark, d, "part").select("p_partkey", numbers.letters(n).alias("letter"), numbers.ordinal(n).alias("ordinal"))


def roman_sql(n: str) -> str:
    rest, parts = n, []
    for value, symbol in numbers.ROMAN:
        parts.append(f"repeat('{symbol.lower()}', CAST({rest} // {value} AS INTEGER))")
        rest = f"({rest} % {value})"
    return " || ".join(parts)


@query(f"SELECT p_partkey, CASE WHEN p_partkey NOT BETWEEN 1 AND 3999 THEN CAST(p_partkey AS VARCHAR) ELSE {roman_sql('p_partkey')} END AS numeral FROM part")
def roman_format(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.roman(F.col("p_partkey")).alias("numeral"))


# ---- styles


@query("""
SELECT doc_id, CASE WHEN d3 IS NOT NULL THEN d3 WHEN coalesce(p AND c, false) THEN false ELSE coalesce(c, p, doc_id % 2 = 0) END AS bold
FROM (SELECT doc_id, quality = 1 AS p, toxic = 1 AS c, CASE WHEN doc_id % 6 = 0 THEN doc_id % 12 = 0 END AS d3 FROM documents LEFT JOIN labels USING (doc_id))
""")
def toggle_resolve(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return rows.select("doc_id", styles.toggle(i % 2 == 0, F.col("quality") == 1, F.col("toxic") == 1, F.when(i % 6 == 0, i % 12 == 0)).alias("bold"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name, 'default') AS font
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def style_cascade(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return rows.select("c_custkey", styles.cascade(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("r_name"), F.lit("default")).alias("font"))


@query("""
WITH RECURSIVE s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS parent, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS v FROM nation),
c AS (SELECT id AS style_id, id AS at, v, 0 AS depth FROM s UNION ALL SELECT style_id, s.parent, p.v, depth + 1 FROM c JOIN s ON s.id = c.at JOIN s p ON p.id = s.parent WHERE s.parent IS NOT NULL)
SELECT style_id, arg_min(v, depth) FILTER (WHERE v IS NOT NULL) AS font, max(depth) AS depth FROM c GROUP BY style_id
""")
def based_on_chain(spark, d):
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.lit(0).alias("sheet"), n.alias("style_id"), F.when(n > 0, F.floor(n / 2).cast("int")).alias("based_on"), F.when(n % 3 == 0, F.col("n_name")).alias("font"))
    return styles.effective(rows, ["sheet"], ["font"]).select("style_id", "font", "depth")


@query("""
SELECT p_partkey, array_to_string(list_transform(list_sort(stops), lambda s: s.pos || ':' || s.align), ' ') AS stops FROM (
  SELECT p_partkey, list({'pos': pos, 'align': align}) AS stops FROM (
    SELECT p_partkey, pos, arg_max(align, pri) AS align FROM (
      SELECT p_partkey, unnest([p_size, p_size + 10, p_size + 20]) AS pos, 'left' AS align, 0 AS pri FROM part
      UNION ALL SELECT p_partkey, unnest([20, 30, p_size + 10]) AS pos, unnest(['right', 'center', 'decimal']) AS align, unnest([1, 2, 3]) AS pri FROM part)
    GROUP BY p_partkey, pos) GROUP BY p_partkey)
""")
def tab_stop_union(spark, d):
    stop = lambda p, a: F.struct(p.cast("bigint").alias("pos"), F.lit(a).alias("align"))
    s = F.col("p_size")
    merged = styles.merge_tab_stops(F.array(stop(s, "left"), stop(s + 10, "left"), stop(s + 20, "left")), F.array(stop(F.lit(20), "right"), stop(F.lit(30), "center"), stop(s + 10, "decimal")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(merged, lambda t: F.concat(t["pos"].cast("string"), F.lit(":"), t["align"])), " ").alias("stops"))


# ---- runs


@query("""
WITH g AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM g)
SELECT user_id, run::BIGINT AS run, event_type, string_agg(props, '' ORDER BY event_id) AS props, count(*) AS n FROM i GROUP BY user_id, run, event_type
""")
def merge_adjacent(spark, d):
    return runs.merge_adjacent(table(spark, d, "events").select("user_id", "event_id", "event_type", "props"), ["user_id"], "event_id", ["event_type"], "props")


EAST_SQL = "".join(rf"\p{{{x}}}" for x in fonts.EAST_ASIA) + r"\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
COMPLEX_SQL = "".join(rf"\p{{{x}}}" for x in fonts.COMPLEX)


@query(rf"""
WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS ch FROM (SELECT doc_id, string_split(text, '') AS l FROM documents)),
o AS (SELECT *, CASE WHEN unicode(ch) > 65535 THEN 2 ELSE 1 END AS n, CASE WHEN unicode(ch) <= 127 THEN 'ascii' WHEN regexp_matches(ch, '^[{EAST_SQL}]') THEN 'eastAsia' WHEN regexp_matches(ch, '^[{COMPLEX_SQL}]') THEN 'complexScript' WHEN NOT regexp_matches(ch, '^[\p{{M}}\p{{Z}}\p{{P}}\x{{200c}}\x{{200d}}\x{{fe00}}-\x{{fe0f}}]') THEN 'highAnsi' END AS own FROM c WHERE ch <> ''),
s AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(own IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'highAnsi') AS script, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT *, CASE script WHEN 'ascii' THEN 'Serif' WHEN 'eastAsia' THEN 'Song' WHEN 'complexScript' THEN 'Naskh' ELSE CASE WHEN doc_id % 2 = 0 THEN ' "SERIF"' ELSE 'Sans' END END AS family FROM s),
g AS (SELECT *, lower(trim(family, ' "')) AS key FROM f),
n AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY doc_id ORDER BY k) IS NOT DISTINCT FROM key THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM n)
SELECT doc_id, segment::INTEGER AS segment, arg_min(script, k) AS script, trim(arg_min(family, k)) AS family, min(upto - n)::BIGINT AS "start", max(upto)::BIGINT AS "end", string_agg(ch, '' ORDER BY k) AS text FROM i GROUP BY doc_id, segment
""")
def script_segments(spark, d):
    style = {"ascii": F.lit("Serif"), "high_ansi": F.when(F.col("doc_id") % 2 == 0, ' "SERIF"').otherwise("Sans"), "east_asia": F.lit("Song"), "complex": F.lit("Naskh")}
    return runs.script_segments(table(spark, d, "documents").select("doc_id", "text"), style)


@query("""
WITH p AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM conversations),
c AS (SELECT *, greatest(0, least(200 - place, length(text)))::INTEGER AS cut FROM p)
SELECT conv_id, turn, 'left' AS side, substring(text, 1, cut) AS text FROM c WHERE cut > 0 UNION ALL SELECT conv_id, turn, 'right', substring(text, cut + 1) FROM c WHERE cut < length(text)
""")
def split_runs(spark, d):
    return runs.split_at(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", F.lit(200))


# ---- comments


@query("SELECT a.conv_id, a.turn, CAST(NULL AS BOOLEAN) IS NULL AND a.turn % 3 = 0 AS resolved, b.turn AS parent_id FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def comment_threads(spark, d):
    c = table(spark, d, "conversations")
    para = lambda t, k: F.concat(t.cast("string"), F.lit(k))
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.array(para(F.col("turn"), "a"), para(F.col("turn"), "b")).alias("para_ids"))
    ext = c.select(F.col("conv_id").alias("doc_id"), para(F.col("turn"), "b").alias("para_id"), (F.col("turn") % 3 == 0).alias("done"), para(F.col("turn") - 1, "a").alias("parent_para_id"))
    return comments.threads(rows, ext).select(F.col("doc_id").alias("conv_id"), F.col("id").alias("turn"), "resolved", "parent_id")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def note_text(spark, d):
    return blocks.joined_text(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id AS doc_id, max(turn) + 1 AS next_id FROM conversations GROUP BY conv_id")
def next_comment_id(spark, d):
    return comments.next_comment_id(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN coalesce(quality = 1, toxic = 1, false) THEN '☒' ELSE '☐' END WHEN doc_id % 3 = 1 THEN coalesce(lang, source, '') ELSE coalesce(lang, '') END AS shown FROM documents LEFT JOIN labels USING (doc_id)")
def form_field_text(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    kind = F.element_at(F.array(*map(F.lit, ("checkbox", "text", "dropdown"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.select("doc_id", comments.field_text(kind, F.col("quality") == 1, F.col("toxic") == 1, F.col("lang"), F.col("source")).alias("shown"))


# ---- aggregates


@query("SELECT md5(text) AS block_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return blocks.duplicates(table(spark, d, "documents").select(F.md5("text").alias("block_id")), "block_id")


@query("""
SELECT lang, count(*) AS docs, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS paragraphs, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality IS NULL) AS unlabelled
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def doc_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("p")).join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("p").cast("bigint").alias("paragraphs"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query("SELECT source, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, 2 - (GROUPING(source) + GROUPING(lang)) AS level FROM documents GROUP BY ROLLUP (source, lang)")
def corpus_rollup(spark, d):
    return quality.rollup_report(table(spark, d, "documents"), ["source", "lang"], docs=F.count("*"), chars=F.sum("n_chars"))


@query("SELECT event_type, max(value) AS max_value, max(event_id % 100)::BIGINT AS max_k, count(*) FILTER (WHERE value > 40 OR event_id % 100 > 98) AS failed_pages, count(*) AS pages, bool_and(NOT (value > 40 OR event_id % 100 > 98)) AS passed FROM events GROUP BY event_type")
def threshold_eval(spark, d):
    rows = table(spark, d, "events").select("event_type", "value", (F.col("event_id") % 100).alias("k"))
    return compare.evaluate_thresholds(rows, ["event_type"], {"value": 40, "k": 98})


@query("""
SELECT p_partkey, wd AS width_diff, hd AS height_diff, ad AS aspect_diff, wd > 0.3 OR hd > 0.3 OR ad > 0.3 AS failed FROM (
  SELECT p_partkey, round(abs(rw - w) / greatest(rw, w), 6) AS wd, round(abs(rh - h) / greatest(rh, h), 6) AS hd, round(abs(rw / rh - w / h) / greatest(rw / rh, w / h), 6) AS ad
  FROM (SELECT p_partkey, 816.0::DOUBLE AS rw, 1056.0::DOUBLE AS rh, 600.0::DOUBLE + p_size * 7 AS w, p_retailprice AS h FROM part))
""")
def geometry_diff(spark, d):
    pairs = table(spark, d, "part").select("p_partkey", F.lit(816.0).alias("ref_width"), F.lit(1056.0).alias("ref_height"), (F.lit(600.0) + F.col("p_size") * 7).alias("width"), F.col("p_retailprice").alias("height"))
    return compare.geometry(pairs, 0.3).select("p_partkey", "width_diff", "height_diff", "aspect_diff", "failed")


def nearest_sql() -> str:
    options = ", ".join(f"({int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:7], 16)}, '{n}')" for n, h in sorted(PALETTE.items()))
    return f"""
SELECT p_partkey, n AS name FROM (SELECT p_partkey, n, row_number() OVER (PARTITION BY p_partkey ORDER BY (c // 65536 - r) ** 2 + (c // 256 % 256 - g) ** 2 + (c % 256 - b) ** 2, n) AS k
FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS c FROM part), (VALUES {options}) v(r, g, b, n)) WHERE k = 1"""


@query(nearest_sql())
def nearest_color(spark, d):
    color = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    return table(spark, d, "part").select("p_partkey", compare.nearest_color(color, PALETTE).alias("name"))


# ---- joins of the comparison


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS case_id, o_orderkey AS page FROM orders), v AS (SELECT DISTINCT o_custkey AS case_id, l_orderkey + (CASE WHEN l_partkey % 50 = 0 THEN 1000000 ELSE 0 END) AS page FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT case_id, count(*) FILTER (WHERE v IS NULL) AS missing, count(*) FILTER (WHERE r IS NULL) AS unexpected, count(*) FILTER (WHERE r AND v) AS paired, count(*) FILTER (WHERE v IS NULL OR r IS NULL) = 0 AS equal
FROM (SELECT case_id, page, true AS r FROM r) FULL JOIN (SELECT case_id, page, true AS v FROM v) USING (case_id, page) GROUP BY case_id
""")
def comparison_plan(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    ref = orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("page"))
    page = F.col("l_orderkey") + F.when(F.col("l_partkey") % 50 == 0, 1000000).otherwise(0)
    seen = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_id"), page.alias("page"))
    return compare.comparison_plan(ref, seen, ["case_id"], "page")


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def unmatched_sources(spark, d):
    return compare.unmatched(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def matched_sources(spark, d):
    return compare.matched(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("""
WITH e AS (SELECT DISTINCT doc_id AS k FROM documents WHERE n_chars >= 200), f AS (SELECT k, count(*) AS n FROM (SELECT doc_id AS k FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY k)
SELECT k, CASE WHEN f.n IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'duplicate' END AS issue FROM e FULL JOIN f USING (k) WHERE f.n IS NULL OR e.k IS NULL OR f.n > 1
""")
def metric_index(spark, d):
    labels = table(spark, d, "labels")
    found = labels.select(F.col("doc_id").alias("k")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("k")))
    return quality.exactly_once(table(spark, d, "documents").where("n_chars >= 200").select(F.col("doc_id").alias("k")), found, ["k"])


@query(f"""
WITH s AS (SELECT doc_id, ordinal, node_index AS want FROM (SELECT doc_id, node_index, row_number() OVER (PARTITION BY doc_id ORDER BY node_index) AS ordinal FROM ({BREAKS}))),
p AS (SELECT doc_id, node_index, row_number() OVER (PARTITION BY doc_id ORDER BY node_index) AS ordinal FROM ({LINES}) WHERE node_index > 0 AND length(text) % 5 = 0)
SELECT doc_id, sum(CASE WHEN node_index = want THEN 25 ELSE -100 * abs(node_index - want) END)::BIGINT AS score FROM s JOIN p USING (doc_id, ordinal) GROUP BY doc_id
""")
def break_score(spark, d):
    lines = blocks.text_blocks(table(spark, d, "documents")).where("node_index > 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_index"))
    pick = lambda c: lines.where(c).select("doc_id", place.alias("ordinal"), F.col("node_index").alias("start"))
    return layout.score_breaks(pick("length(text) % 5 = 0"), pick("length(text) % 7 = 0"))


@query("""
WITH c AS (SELECT doc_id, n_chars // 2000 + 1 AS target, s AS scale, CAST(ceil(n_chars / (1900.0 * s)) AS BIGINT) AS page_count FROM documents, (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2])::DOUBLE AS s)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(page_count - target), abs(scale - 1), scale) AS k, max(CASE WHEN scale = 1 THEN abs(page_count - target) END) OVER (PARTITION BY doc_id) AS off, max(CASE WHEN scale = 1 THEN page_count END) OVER (PARTITION BY doc_id) AS own FROM c)
SELECT doc_id, CASE WHEN off > 3 THEN 1.0 ELSE scale END::DOUBLE AS scale, CASE WHEN off > 3 THEN own ELSE page_count END AS page_count FROM b WHERE k = 1
""")
def scale_search(spark, d):
    scales = F.explode(F.array(*[F.lit(s) for s in (0.8, 0.9, 1.0, 1.1, 1.2)]))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", (F.floor(F.col("n_chars") / 2000) + 1).alias("target"), scales.alias("scale"))
    return layout.best_scale(rows.withColumn("page_count", F.ceil(F.col("n_chars") / (F.lit(1900.0) * F.col("scale")))))


# ---- edits and histories


@query("""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NOT NULL AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 600000000 AND lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS burst FROM g
""")
def commit_bursts(spark, d):
    return history.bursts(table(spark, d, "events"), "user_id", "ts", "event_type", 600_000, "event_id").select("event_id", "user_id", "burst")


def action(kind: Column) -> Column:
    return F.when(kind == "click", "undo").when(kind == "error", "redo").when(kind == "signup", "reset").otherwise("commit")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'undo' WHEN 'error' THEN 'redo' WHEN 'signup' THEN 'reset' ELSE 'commit' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
h AS (
  SELECT user_id, 0::BIGINT AS event_id, '' AS action, 0::BIGINT AS k, 0::BIGINT AS u, 0::BIGINT AS r FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT e.user_id, e.event_id, e.action, e.k,
    CASE e.action WHEN 'commit' THEN least(u + 1, 100) WHEN 'undo' THEN greatest(u - 1, 0) WHEN 'redo' THEN CASE WHEN r > 0 THEN least(u + 1, 100) ELSE u END ELSE 0 END,
    CASE e.action WHEN 'commit' THEN 0 WHEN 'undo' THEN CASE WHEN u > 0 THEN r + 1 ELSE r END WHEN 'redo' THEN greatest(r - 1, 0) ELSE 0 END
  FROM h JOIN e ON e.user_id = h.user_id AND e.k = h.k + 1)
SELECT user_id, event_id, action, u AS undo_depth, r AS redo_depth FROM h WHERE k > 0
""")
def history_depth(spark, d):
    return history.depths(table(spark, d, "events").select("user_id", "event_id", action(F.col("event_type")).alias("action")), "user_id", "event_id", "action")


TURNS = "SELECT conv_id AS doc_id, turn AS node_index, role, length(text)::INTEGER AS size FROM conversations"


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("node_index"), "role", F.length("text").alias("size"))


@query(f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY node_index, k) - 1 AS INTEGER) AS node_index, role, size FROM (SELECT *, 1 AS k FROM ({TURNS}) UNION ALL SELECT DISTINCT doc_id, 1, 'inserted', 0, 0 FROM ({TURNS}))
""")
def insert_rows(spark, d):
    rows = turns(spark, d)
    return blocks.insert_rows(rows, rows.select("doc_id").distinct().select("doc_id", F.lit(1).alias("node_index"), F.lit("inserted").alias("role"), F.lit(0).alias("size")))


@query(f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY node_index) - 1 AS INTEGER) AS node_index, role, size FROM (
  SELECT *, count(*) FILTER (WHERE role <> 'user') OVER (PARTITION BY doc_id) AS kept, min(node_index) OVER (PARTITION BY doc_id) AS f FROM ({TURNS})) WHERE role <> 'user' OR (kept = 0 AND node_index = f)
""")
def remove_rows(spark, d):
    return blocks.remove_rows(turns(spark, d), F.col("role") == "user")


@query(f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY node_index, k) - 1 AS INTEGER) AS node_index, role, size FROM (SELECT *, 0 AS k FROM ({TURNS}) UNION ALL SELECT *, 1 FROM ({TURNS}) WHERE role = 'assistant')
""")
def duplicate_rows(spark, d):
    return blocks.duplicate_rows(turns(spark, d), F.col("role") == "assistant")


@query("SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN substring(text, 1, strpos(text, 'the') - 1) || 'THE' || substring(text, strpos(text, 'the') + 3) ELSE text END AS text FROM documents")
def replace_first(spark, d):
    return table(spark, d, "documents").select("doc_id", blocks.replace_first(F.col("text"), "the", "THE").alias("text"))


@query("SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 3")
def copy_slice(spark, d):
    return table(spark, d, "conversations").where(F.col("turn").between(1, 3)).select("conv_id", "turn", "role")


# ---- quality


@query("""
SELECT CAST(doc_id AS VARCHAR) AS key, 'short' AS rule FROM documents WHERE n_chars < 40 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'length' FROM documents WHERE n_chars <> length(text) UNION ALL SELECT CAST(doc_id AS VARCHAR), 'pipes' FROM documents WHERE contains(text, '|')
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'balance' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'nation' FROM customer WHERE c_nationkey NOT BETWEEN 0 AND 20
""")
def quality_issues(spark, d):
    docs = quality.issues(table(spark, d, "documents"), "doc_id", {"short": F.col("n_chars") < 40, "length": F.col("n_chars") != F.length("text"), "pipes": F.contains("text", F.lit("|"))})
    return docs.unionByName(quality.issues(table(spark, d, "customer"), "c_custkey", {"balance": F.col("c_acctbal") < 0, "nation": ~F.col("c_nationkey").between(0, 20)}))


# ---- packages, streams and pages


@query(LINES.replace("SELECT doc_id,", "SELECT CAST(doc_id AS VARCHAR) AS doc_id,", 1))
def package_round_trip(spark, d):
    """Every document written as a package and read back: the same blocks."""
    from ..sources import model, packages, render

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def build(frames):
        for frame in frames:
            bodies = [render.document([render.paragraph(None, [{"text": t}]) for t in x.split("\n")]) for x in frame["text"]]
            yield frame[["doc_id"]].assign(content=[packages.zip_bytes({"word/document.xml": b.encode()}) for b in bodies])

    files = docs.mapInPandas(build, "doc_id string, content binary")
    return model.blocks(packages.read_parts(files, "doc_id")).select("doc_id", "node_index", "text")


@query(ORACLES["history_depth"].replace("SELECT user_id, event_id, action, u AS", "SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, action, u AS"))
def history_stream(spark, d):
    """The undo fold as a stream over the events, run to its end."""
    import uuid

    from ..operators.scratch import shared_dir
    from ..streaming import edits as live

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema)
    # A stream reads folders: the table's own, or the one that its single file lies in.
    single = any(f.endswith("/events.parquet") for f in events.inputFiles())
    source = stream.option("pathGlobFilter", "events.parquet").parquet(d) if single else stream.parquet(f"{d}/events.parquet")
    actions = source.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), action(F.col("event_type")).alias("action"))
    run = live.history_stream(actions).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(live.OUTPUT).parquet(f"{base}/out")


@query(f"""
WITH c AS ({LEVELS}),
g AS (SELECT *, sum(CASE WHEN ilvl = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS top FROM c)
SELECT conv_id, turn, CASE WHEN ilvl = 0 THEN top ELSE sum(CASE WHEN ilvl = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END::BIGINT AS n FROM g
""")
def numbering_without_restart(spark, d):
    from ..operators.numbering import counters

    items = table(spark, d, "conversations").select(F.col("conv_id").alias("list_id"), "turn", F.when(F.col("role") == "user", 0).otherwise(1).alias("ilvl"))
    c = counters(items, "list_id", "turn", 2, restarts=F.array(F.lit(None).cast("int"), F.lit(0)))
    return c.select(F.col("list_id").alias("conv_id"), "turn", F.element_at("counts", F.col("ilvl") + 1).alias("n"))


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn AS page, turn // 3 AS section, CASE WHEN turn // 3 % 2 = 1 THEN 5 END AS start FROM conversations),
m AS (SELECT *, CASE WHEN start IS NOT NULL AND lag(section) OVER w IS DISTINCT FROM section THEN page END AS start_page FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
l AS (SELECT *, last_value(start_page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS base FROM m)
SELECT doc_id, page, CASE WHEN base IS NULL THEN page + 1 ELSE page - base + 5 END::BIGINT AS number FROM l
""")
def page_numbers(spark, d):
    from ..operators import pages

    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.floor(F.col("turn") / 3).alias("section_index"))
    rows = rows.withColumn("page_start", F.when(F.col("section_index") % 2 == 1, 5)).withColumn("page_format", F.lit("decimal"))
    return pages.page_numbers(rows).select("doc_id", "page", "number")


@query("""
WITH h AS (SELECT conv_id, turn // 2 AS page, arg_min(text, turn) AS f, arg_max(text, turn) AS l FROM conversations WHERE role = 'assistant' AND turn % 3 > 0 GROUP BY conv_id, turn // 2),
p AS (SELECT DISTINCT conv_id, turn // 2 AS page FROM conversations)
SELECT conv_id AS doc_id, page, coalesce(f, last_value(l IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reference FROM p LEFT JOIN h USING (conv_id, page)
""")
def style_references(spark, d):
    from ..operators import pages

    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("node_index"), "role", "text")
    return pages.style_references(rows.select("doc_id", "page").distinct(), rows.where("role = 'assistant' AND node_index % 3 > 0").select("doc_id", "page", "node_index", "text"))


@query("""
SELECT conv_id AS doc_id, coalesce(min(CASE WHEN length(text) % 4 = 0 THEN turn // 2 END), max(turn // 2) + 1)::INTEGER AS retained FROM conversations GROUP BY conv_id
""")
def retained_pages(spark, d):
    from ..operators import pages

    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node_index"), F.floor(F.col("turn") / 2).alias("page"), "text", "role")
    before = rows.select("doc_id", "node_index", "page", pages.signature("text", "role").alias("signature"))
    edited = rows.withColumn("text", F.when(F.length("text") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return pages.retained_pages(before, edited.select("doc_id", "node_index", pages.signature("text", "role").alias("signature")))



@query("""
SELECT conv_id, turn, true AS ok, '<w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>' || role || '</w:t></w:r><w:del w:id="99"><w:r><w:delText>x</w:delText></w:r></w:del></w:p>' AS xml FROM conversations
""")
def accept_revisions(spark, d):
    from ..operators import edits

    c = table(spark, d, "conversations")
    xml = F.concat(F.lit('<w:p><w:r><w:t>a</w:t></w:r><w:ins w:id="'), F.col("turn").cast("string"), F.lit('"><w:r><w:t>'), "role", F.lit('</w:t></w:r></w:ins><w:del w:id="99"><w:r><w:delText>x</w:delText></w:r></w:del></w:p>'))
    return edits.resolve_revisions(c.select("conv_id", "turn", xml.alias("xml"), F.col("turn").cast("string").alias("revision_id")), True).select("conv_id", "turn", "ok", "xml")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 5 THEN 'ok' ELSE 'stale' END AS result FROM conversations")
def create_comments(spark, d):
    from ..operators import edits

    c = table(spark, d, "conversations")
    xml = F.concat(F.lit("<w:p><w:r><w:t>"), markup.escape_text(F.col("text")), F.lit("</w:t></w:r></w:p>"))
    rows = c.select("conv_id", "turn", xml.alias("xml"), F.lit(0).alias("start"), F.when(F.length("text") > 5, 5).otherwise(100).alias("end"), F.col("turn").alias("comment_id"))
    return edits.create_comments(rows).select("conv_id", "turn", F.when(F.col("ok"), "ok").otherwise(F.col("reason")).alias("result"))


@query("""
SELECT l_orderkey AS p, sum(CASE WHEN greatest(abs(a0 - b0), abs(a1 - b1), abs(a2 - b2)) > 40 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS mismatch_ratio, avg((abs(a0 - b0) + abs(a1 - b1) + abs(a2 - b2)) / 3.0::DOUBLE / 255.0) AS mean_absolute_diff
FROM (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS a0, CAST(l_partkey % 256 AS INTEGER) AS a1, CAST(l_suppkey % 256 AS INTEGER) AS a2, CAST(l_linenumber * 9 AS INTEGER) AS b0, CAST(l_partkey % 200 AS INTEGER) AS b1, CAST(l_suppkey % 99 AS INTEGER) AS b2 FROM lineitem) GROUP BY l_orderkey
""")
def image_metrics(spark, d):
    channel = {"a0": F.col("l_quantity"), "a1": F.col("l_partkey") % 256, "a2": F.col("l_suppkey") % 256, "b0": F.col("l_linenumber") * 9, "b1": F.col("l_partkey") % 200, "b2": F.col("l_suppkey") % 99}
    px = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("p"), *[c.cast("int").alias(n) for n, c in channel.items()])
    return compare.image_metrics(px, ["p"], 40).select("p", "mismatch_ratio", "mean_absolute_diff")


@query(r"SELECT page_id, NOT regexp_matches(p, '^$|\\|^/|^[A-Za-z]:|://|(^|/)(\.|\.\.)?(/|$)') AS portable FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'a/' || page_id || '.png' WHEN 2 THEN '../' || page_id WHEN 3 THEN '/x' ELSE 'a//b' END AS p FROM pages)")
def portable_paths(spark, d):
    from ..operators import validation

    i = F.col("page_id")
    p = F.when(i % 5 == 0, F.col("url")).when(i % 5 == 1, F.concat(F.lit("a/"), i.cast("string"), F.lit(".png"))).when(i % 5 == 2, F.concat(F.lit("../"), i.cast("string"))).when(i % 5 == 3, "/x").otherwise("a//b")
    return table(spark, d, "pages").select("page_id", validation.portable_path(p).alias("portable"))


@query("SELECT o_orderkey, o_orderstatus <> 'P' AS valid FROM orders")
def xml_date_times(spark, d):
    from ..operators import validation

    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    value = F.when(F.col("o_orderstatus") == "P", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30T00:00:00Z"))).otherwise(F.concat(stamp, F.lit("+02:00")))
    return table(spark, d, "orders").select("o_orderkey", validation.xml_date_time(value).alias("valid"))


@query("""
SELECT c_custkey, field, expected, actual FROM (
  SELECT c_custkey, unnest(['segment', 'nation']) AS field, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS expected, unnest([CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, CAST(c_nationkey + (c_custkey % 3 = 0)::INTEGER AS VARCHAR)]) AS actual FROM customer)
WHERE expected IS DISTINCT FROM actual
""")
def environment_differences(spark, d):
    from ..operators import validation

    c = table(spark, d, "customer")
    want = c.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    have = c.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_nationkey") + (F.col("c_custkey") % 3 == 0).cast("int")).alias("nation"))
    return validation.environment_differences(want, have, ["c_custkey"], ["segment", "nation"])


@query("""
WITH s AS (SELECT user_id, event_id, event_type AS sig, CAST(event_type = 'error' AS INTEGER) AS issues FROM events),
f AS (SELECT *, coalesce(issues > 0 OR sig IS DISTINCT FROM lag(sig) OVER w OR lag(issues) OVER w > 0, true) AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) >= 2 AND issues = 0 AS ready FROM g
""")
def readiness(spark, d):
    from ..operators import validation

    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("sig"), (F.col("event_type") == "error").cast("int").alias("issues"))
    return validation.ready(rows, ["user_id"], "event_id", "sig").select("user_id", "event_id", "ready")


@query("SELECT p_partkey, greatest(120.0, 1056 - greatest(96.0, 48 + p_size * 4) - greatest(96.0, 48 + p_size * 2))::DOUBLE AS body FROM part")
def body_heights(spark, d):
    from ..operators import pages

    v = lambda x: F.lit(float(x))
    return table(spark, d, "part").select("p_partkey", pages.body_height(v(1056), v(96), v(96), v(48), F.col("p_size") * 4.0, v(48), F.col("p_size") * 2.0).alias("body"))


@query(None)
def segment_pages(spark, d):
    """Full pagination of every document: lines split, first lines kept with what follows."""
    from ..operators import segmentation

    lines = blocks.text_blocks(table(spark, d, "documents"))
    count = F.greatest(F.ceil(F.length("text") / 90), F.lit(1)).cast("int")
    rows = lines.select(
        "doc_id", "node_index", F.lit("paragraph").alias("kind"), (count * 20.0 + 8).alias("height_px"), F.lit(20.0).alias("line_height_px"), count.alias("line_count"), F.lit(8.0).alias("after_px"),
        (F.col("node_index") == 0).alias("keep_next"), F.length("text").alias("text_length"), (F.col("text") != "").alias("visible"),
    )
    return segmentation.paginate_blocks(rows, 912)


# ---- further joins and conversions


@query("""
SELECT e.event_id, o.o_orderkey, greatest(e.s, o.s) AS "from", least(e.e, o.e) AS "to" FROM
(SELECT event_id, user_id AS g, event_id AS s, event_id + 1 + CAST(floor(value) AS BIGINT) % 50 AS e FROM events) e JOIN (SELECT o_orderkey, o_custkey AS g, o_orderkey AS s, o_orderkey + o_custkey % 60 AS e FROM orders) o USING (g) WHERE e.s < o.e AND o.s < e.e AND o.s < o.e
""")
def interval_overlaps(spark, d):
    from ..operators import intervals

    left = table(spark, d, "events").select("event_id", F.col("user_id").alias("g"), F.col("event_id").alias("start"), (F.col("event_id") + 1 + F.floor("value") % 50).alias("end"))
    right = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("r_start"), (F.col("o_orderkey") + F.col("o_custkey") % 60).alias("r_end"))
    return intervals.overlaps(left, right, ["g"], 64).select("event_id", "o_orderkey", "from", "to")


@query("""
WITH f AS (SELECT * FROM (VALUES ('s', 0, 'wholeTable', 'a', 'x'), ('s', 1, 'band1Horz', NULL, 'y'), ('s', 2, 'firstRow', 'c', NULL)) v(style_id, p, condition, fill, font)),
c AS (SELECT p_partkey, unnest(['wholeTable', CASE WHEN p_size % 2 = 0 THEN 'band1Horz' END, CASE WHEN p_size % 3 = 0 THEN 'firstRow' END]) AS condition FROM part)
SELECT p_partkey, arg_max(fill, p) FILTER (WHERE fill IS NOT NULL) AS fill, arg_max(font, p) FILTER (WHERE font IS NOT NULL) AS font FROM c JOIN f USING (condition) GROUP BY p_partkey
""")
def conditional_styles(spark, d):
    s = F.col("p_size")
    cells = table(spark, d, "part").select("p_partkey", F.lit("s").alias("style_id"), F.array_compact(F.array(F.lit("wholeTable"), F.when(s % 2 == 0, "band1Horz"), F.when(s % 3 == 0, "firstRow"))).alias("conditions"))
    formats = spark.createDataFrame([("s", "wholeTable", "a", "x"), ("s", "band1Horz", None, "y"), ("s", "firstRow", "c", None)], "style_id string, condition string, fill string, font string")
    return styles.conditional(cells, formats, ["p_partkey"], ["fill", "font"])


@query("""
SELECT conv_id AS doc_id, target, CASE WHEN turn IS NOT NULL THEN 'rId' || turn ELSE 'rId' || (top + row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY target)) END AS rid
FROM (SELECT DISTINCT conv_id, 't' || (turn + length(text) % 3) AS target FROM conversations) r
LEFT JOIN (SELECT conv_id, turn, 't' || turn AS target FROM conversations WHERE turn % 2 = 0) k USING (conv_id, target) JOIN (SELECT conv_id, max(turn) FILTER (WHERE turn % 2 = 0) AS top FROM conversations GROUP BY conv_id) USING (conv_id)
""")
def new_relationships(spark, d):
    from ..sources import packages

    c = table(spark, d, "conversations")
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    wanted = c.select(F.col("conv_id").alias("doc_id"), F.lit("p").alias("part"), name(F.col("turn") + F.length("text") % 3).alias("target"), F.lit("image").alias("type"))
    have = c.where("turn % 2 = 0").select(F.col("conv_id").alias("doc_id"), F.lit("p").alias("part"), F.concat(F.lit("rId"), F.col("turn").cast("string")).alias("rid"), name(F.col("turn")).alias("target"))
    return packages.new_relationships(wanted, have).select("doc_id", "target", "rid")


@query("""
WITH r AS (SELECT l_orderkey AS table_id, l_linenumber AS row, min(CAST(l_quantity AS BIGINT)) * 40 AS a, min(CAST(l_suppkey AS BIGINT)) % 7 * 60 + 500 AS b, CASE WHEN l_orderkey % 2 = 0 THEN [700, 700] ELSE [400, 800] END AS grid FROM lineitem GROUP BY ALL),
o AS (SELECT table_id, any_value(grid) AS grid, any_value(table_id % 2 = 0) OR count_if((abs(a - grid[1]) * 5 > grid[1])::INT + (abs(b - grid[2]) * 5 > grid[2])::INT > 1) * 2 > count(*) AS bad, list_sort(list_distinct([0] || flatten(list([a, a + b])))) AS ends FROM r GROUP BY table_id),
m AS (SELECT *, list_reduce(list_transform(ends, lambda x: [x]), lambda p, x: CASE WHEN x[1] - p[-1] <= 80 THEN p ELSE list_append(p, x[1]) END) AS lines FROM o),
e AS (SELECT r.*, m.bad, m.lines, list_transform(m.lines, lambda x: abs(x)) AS d0, list_transform(m.lines, lambda x: abs(x - r.a)) AS d1, list_transform(m.lines, lambda x: abs(x - r.a - r.b)) AS d2 FROM r JOIN m USING (table_id)),
p AS (SELECT *, list_position(d0, list_min(d0)) AS p0, list_position(d1, list_min(d1)) AS p1, list_position(d2, list_min(d2)) AS p2 FROM e),
u AS (SELECT table_id, row, bad, grid, lines, unnest([1, 2]) AS cell, unnest([greatest(p1 - p0, 1), greatest(p2 - p1, 1)]) AS span FROM p)
SELECT table_id, row, cell::INTEGER AS cell, CASE WHEN bad THEN span ELSE 1 END::INTEGER AS span,
  CASE WHEN bad THEN array_to_string(list_transform(lines[2:], lambda x, i: x - lines[i]), ',') ELSE array_to_string(grid, ',') END AS grid FROM u
""")
def snapped_grid(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("bigint")).alias("q"), F.min(F.col("l_suppkey").cast("bigint")).alias("s"))
    widths = F.array(F.col("q") * 40, F.col("s") % 7 * 60 + 500)
    cells = rows.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.posexplode(widths).alias("cell", "width_twips")).withColumn("cell", F.col("cell") + 1)
    grid = F.when(F.col("table_id") % 2 == 0, F.array(F.lit(700), F.lit(700))).otherwise(F.array(F.lit(400), F.lit(800))).cast("array<bigint>")
    declared = cells.withColumns({"grid": grid, "span": F.lit(1), "continued": F.lit(False)})
    return tables.snapped_grid(declared).select("table_id", "row", "cell", "span", F.array_join(F.col("grid").cast("array<string>"), ",").alias("grid"))


@query(None)
def line_counts(spark, d):
    """Lines of each document at 90 characters a line, broken at words."""
    from ..operators import lines

    return lines.line_counts(table(spark, d, "documents").select("doc_id", "text", F.lit(90.0).alias("width")), "text", "width", {}, 1.0).select("doc_id", "lines")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, epoch_us(min(time_bucket(INTERVAL 1 HOUR, ts))) // 3600000000 AS first_hour FROM events GROUP BY event_type")
def edit_rates(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min(F.date_trunc("hour", "ts")).alias("h"))
    return rows.select("event_type", "n", "users", F.floor(F.unix_seconds(F.col("h").cast("timestamp")) / 3600).alias("first_hour"))


@query(None)
def reconcile_pages(spark, d):
    """Each document's page count brought to one more than its estimate, by the height of its pages."""
    from ..operators import reconcile

    lines = blocks.text_blocks(table(spark, d, "documents"))
    count = F.greatest(F.ceil(F.length("text") / 90), F.lit(1)).cast("int")
    rows = lines.select("doc_id", "node_index", (count * 20.0 + 8).alias("height_px"), F.lit(20.0).alias("line_height_px"), count.alias("line_count"), F.lit(8.0).alias("after_px"))
    targets = table(spark, d, "documents").select("doc_id", (F.ceil(F.length("text") / 3500) + 1).alias("target"))
    return reconcile.reconcile(rows, targets, 912)


@query("SELECT conv_id, turn, md5(CAST(to_json({'role': role, 'text': text}) AS VARCHAR)) AS signature FROM conversations")
def content_signatures(spark, d):
    """The change key of each conversation turn."""
    from ..functions.signature import signature

    return table(spark, d, "conversations").select("conv_id", "turn", signature(F.struct("role", "text")).alias("signature"))


@query(r"""
WITH c AS (SELECT conv_id, turn, text, least(length(text), 3 + turn * 7) AS a, left(text, least(length(text), 3 + turn * 7)) AS head, substring(text, least(length(text), 3 + turn * 7) + 1) AS tail FROM conversations),
e AS (SELECT *, CASE turn % 4 WHEN 0 THEN head || 'new' || chr(10) || tail WHEN 1 THEN regexp_replace(head, '\S*\s*$', '') || tail WHEN 2 THEN head || substring(tail, 2) ELSE head || regexp_replace(tail, '^\s*\S*', '') END AS t,
  CASE turn % 4 WHEN 0 THEN a + 4 WHEN 1 THEN length(regexp_replace(head, '\S*\s*$', '')) ELSE a END AS caret FROM c)
SELECT conv_id, turn, CASE WHEN t <> text THEN t END AS text, CASE WHEN t <> text THEN caret END::INTEGER AS caret FROM e
""")
def text_intents(spark, d):
    """Each turn's text after an insertion, a deletion of the word before or behind the caret, or of the character behind it."""
    from ..operators import intents

    at = F.least(F.length("text"), 3 + F.col("turn") * 7)
    kind = F.element_at(F.array(*map(F.lit, ("insertFromPaste", "deleteWordBackward", "deleteContentForward", "deleteWordForward"))), (F.col("turn") % 4 + 1).cast("int"))
    todo = intents.intent(kind, F.lit(None).cast("string"), F.lit("new\r"))
    return table(spark, d, "conversations").withColumn("__i", todo).withColumn("__e", intents.applied(F.col("text"), at, at, F.col("__i"))).select("conv_id", "turn", "__e.text", "__e.caret")


@query("""
WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, (l_linenumber - 1) * 10 AS s, l_linenumber * 10 AS e, CAST(l_quantity AS DOUBLE) AS width FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
m AS (SELECT *, o_orderkey % 45 AS place, row_number() OVER (PARTITION BY o_orderkey ORDER BY line) AS k FROM orders JOIN f ON doc_id = o_orderkey AND o_orderkey % 45 BETWEEN s AND e)
SELECT doc_id, place AS "offset", (line - 1) * 20.0::DOUBLE AS y, CASE WHEN place >= e THEN width ELSE 0 END::DOUBLE AS x FROM m WHERE k = 1
""")
def caret_places(spark, d):
    """The caret at an offset of each order, whose lines are lines of text."""
    from ..operators import pages

    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    n, zero = F.col("l_linenumber"), F.lit(0.0)
    fragments = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("node_index"), ((n - 1) * 10).alias("start"), (n * 10).alias("end"), zero.alias("x"), ((n - 1) * 20.0).alias("y"), F.col("q").cast("double").alias("width"), F.lit(20.0).alias("height"))
    targets = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("node_index"), (F.col("o_orderkey") % 45).alias("offset"))
    return pages.caret_rects(targets, fragments).select("doc_id", "offset", F.col("y").cast("double").alias("y"), "x")


@query("""
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS id, turn, role, text, count(*) OVER w AS n, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM conversations WINDOW w AS (PARTITION BY conv_id)),
one AS (SELECT DISTINCT id, n, first FROM c), s AS (SELECT * FROM (VALUES ('S0', '', '', 'true'), ('S1', 'S0', '', ''), ('S2', 'S1', '2', '')) v(k, base, heading, bold))
SELECT id, 'block' AS relation, turn::VARCHAR AS k, concat_ws('|', 'paragraph', 'S' || turn % 3, 'justify', '1', turn % 2, text) AS value FROM c
UNION ALL SELECT id, 'block', n::VARCHAR, concat_ws('|', 'table', '', '', '', '', first || chr(10) || n) FROM one
UNION ALL SELECT id, 'run', turn::VARCHAR || '/0', concat_ws('|', 'text', CASE WHEN turn % 2 = 0 THEN 'true' ELSE '' END, text) FROM c UNION ALL SELECT id, 'run', turn::VARCHAR || '/1', 'note||' || (turn + 1) FROM c WHERE turn % 4 = 1
UNION ALL SELECT id, 'cell', '0', '0|2|restart|' || first FROM one UNION ALL SELECT id, 'cell', '1', '2|1||' || n FROM one
UNION ALL SELECT id, 'section', '0', concat_ws('|', n % 3 + 1, n, 'word/header1.xml') FROM one
UNION ALL SELECT id, 'note', (turn + 1)::VARCHAR, 'note ' || turn FROM c WHERE turn % 4 = 1 UNION ALL SELECT id, 'comment', turn::VARCHAR, role || '|c' || turn FROM c WHERE turn % 5 = 2
UNION ALL SELECT id, 'level', '0', n || '|decimal|%1.' FROM one UNION ALL SELECT id, 'level', '1', '1|lowerRoman|(%2)' FROM one
UNION ALL SELECT id, 'style', k, concat_ws('|', base, heading, bold) FROM one, s UNION ALL SELECT id, 'effective', k, 'true' FROM one, s
UNION ALL SELECT id, 'label', turn::VARCHAR, CASE WHEN turn % 2 = 0 THEN (n + turn // 2) || '.' ELSE '(i)' END FROM c
""")
def package_relations(spark, d):
    """Conversations written as packages with styles, lists, a table, notes, comments and a header, and every relation read back."""
    from ..operators import numbering
    from ..operators.scratch import written
    from ..sources import model, packages

    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    one = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(turns.alias("t")).withColumn("n", F.size("t"))
    word = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    text = lambda c: xml('<w:r><w:t xml:space="preserve">', c, "</w:t></w:r>")
    s = lambda c: c.cast("string")

    def paragraph(x: Column) -> Column:
        note = F.when(x["turn"] % 4 == 1, xml('<w:r><w:footnoteReference w:id="', s(x["turn"] + 1), '"/></w:r>')).otherwise("")
        bold = F.when(x["turn"] % 2 == 0, "<w:rPr><w:b/></w:rPr>").otherwise("")
        props = xml('<w:pPr><w:pStyle w:val="S', s(x["turn"] % 3), '"/><w:numPr><w:ilvl w:val="', s(x["turn"] % 2), '"/><w:numId w:val="1"/></w:numPr><w:jc w:val="both"/></w:pPr>')
        return xml("<w:p>", props, "<w:r>", bold, '<w:t xml:space="preserve">', word(x["text"]), "</w:t></w:r>", note, "</w:p>")

    each = lambda keep, f: F.array_join(F.transform(F.filter("t", keep), f), "")
    cells = xml('<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p>', text(word(F.get("t", F.lit(0))["role"])), "</w:p></w:tc><w:tc><w:p>", text(s(F.col("n"))), "</w:p></w:tc></w:tr></w:tbl>")
    section = xml('<w:sectPr><w:headerReference w:type="default" r:id="rId1"/><w:pgNumType w:start="', s(F.col("n")), '"/><w:cols w:num="', s(F.col("n") % 3 + 1), '"/></w:sectPr>')
    parts = {
        "word/document.xml": xml("<w:document><w:body>", F.array_join(F.transform("t", paragraph), ""), cells, section, "</w:body></w:document>"),
        "word/_rels/document.xml.rels": F.lit('<Relationships><Relationship Id="rId1" Type="t/header" Target="header1.xml"/></Relationships>'),
        "word/header1.xml": F.lit("<w:hdr><w:p/></w:hdr>"),
        "word/styles.xml": F.lit('<w:styles><w:style w:type="paragraph" w:styleId="S0"><w:rPr><w:b/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="S1"><w:basedOn w:val="S0"/></w:style><w:style w:type="paragraph" w:styleId="S2"><w:name w:val="heading 2"/><w:basedOn w:val="S1"/></w:style></w:styles>'),
        "word/footnotes.xml": xml("<w:footnotes>", each(lambda x: x["turn"] % 4 == 1, lambda x: xml('<w:footnote w:id="', s(x["turn"] + 1), '"><w:p>', text(xml("note ", s(x["turn"]))), "</w:p></w:footnote>")), "</w:footnotes>"),
        "word/comments.xml": xml("<w:comments>", each(lambda x: x["turn"] % 5 == 2, lambda x: xml('<w:comment w:id="', s(x["turn"]), '" w:author="', word(x["role"]), '"><w:p>', text(xml("c", s(x["turn"]))), "</w:p></w:comment>")), "</w:comments>"),
        "word/numbering.xml": xml('<w:numbering><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="', s(F.col("n")), '"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="(%2)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'),
    }
    rows = one.select("id", F.explode(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])).alias("name", "content"))
    files = packages.write_packages(rows.select(F.col("id").alias("doc_id"), "name", "content", F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("error")))
    read = written(packages.read_parts(files, "doc_id"))  # ten readers
    body = F.col("container") == "word/document.xml"
    join = lambda *cs: F.concat_ws("|", *[F.coalesce(s(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in cs])
    row = lambda df, relation, k, value: df.select(F.col("doc_id").alias("id"), F.lit(relation).alias("relation"), s(k).alias("k"), value.alias("value"))
    blocks_ = model.blocks(read).where(body)
    listed = blocks_.where("kind = 'paragraph'").select("doc_id", "node_index", "style.num_id", "style.ilvl")
    sheet = model.style_sheet(read).select("doc_id", "style_id", "based_on", "heading", F.col("run.bold").alias("bold"))
    refs = model.section_references(read).select("doc_id", "section_index", "part")
    out = [
        row(blocks_, "block", F.col("node_index"), join("kind", "style.style_id", "style.align", "style.num_id", "style.ilvl", "text")), row(model.runs(read).where(body & (F.size("cell_path") == 0)), "run", F.concat_ws("/", "node_index", "run_index"), join("kind", "style.bold", F.coalesce(s(F.col("note_id")), F.col("text")))),
        row(model.cells(read), "cell", F.col("cell"), join("grid_col", "grid_span", "v_merge", "text")), row(model.sections(read).join(refs, ["doc_id", "section_index"]), "section", F.col("section_index"), join("layout.columns", "layout.page_start", "part")),
        row(model.note_paragraphs(read), "note", F.col("id"), F.col("text")), row(model.comment_rows(read), "comment", F.col("id"), join("author", "text")), row(model.numbering_levels(read), "level", F.col("ilvl"), join("start", "format", "lvl_text")),
        row(sheet, "style", F.col("style_id"), join("based_on", "heading", "bold")), row(styles.effective(sheet, ["doc_id"], ["bold"]), "effective", F.col("style_id"), s(F.col("bold"))),
        row(numbering.labels(listed, model.numbering_levels(read), model.numbering_instances(read)), "label", F.col("node_index"), F.col("label")),
    ]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result
