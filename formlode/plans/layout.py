"""Queries on document layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from formlode.functions import text as tx
from formlode.operators import layout as la
from formlode.shared import written

from .adapters import table
from .registry import a4, query, r4
from .vectors import _NORM

_ELT = """WITH elt AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, t AS text, CAST((i - 1) // 40 AS INTEGER) AS page, CAST(10 + length(t) % 9 AS INTEGER) AS size, CAST(((i - 1) % 40) * 18 AS INTEGER) AS top, length(t) % 5 = 0 AS bold
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)) """
_STAT = f""", st AS (SELECT doc_id, page, avg(size) AS average, CAST(max(size) AS DOUBLE) AS largest, CAST(min(size) AS DOUBLE) AS smallest, CAST(list_sort(list(size))[CAST(count(*) // 2 AS INTEGER) + 1] AS DOUBLE) AS median FROM elt GROUP BY ALL),
  hd AS (SELECT elt.*, CASE WHEN size >= largest OR spot >= 0.9::DOUBLE OR (spot >= 0.8::DOUBLE AND bold) THEN 'h1' WHEN (spot >= 0.7::DOUBLE AND bold) OR size / average >= 1.5::DOUBLE OR (size / average >= 1.2::DOUBLE AND bold) THEN 'h2' WHEN bold THEN 'h3' ELSE 'normal' END AS level
    FROM (SELECT elt.*, average, largest, smallest, CASE WHEN largest > smallest THEN (size - smallest) / (largest - smallest) ELSE 0.5::DOUBLE END AS spot FROM elt JOIN st USING (doc_id, page)) elt) """


def elements(spark, sf):
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return docs.select("doc_id", "line_no", "text", F.floor(F.col("line_no") / 40).cast("int").alias("page"), (10 + F.length("text") % 9).alias("size"), ((F.col("line_no") % 40) * 18).alias("top"), (F.length("text") % 5 == 0).alias("bold"))


def numbered(spark, sf):
    text = F.when(F.col("line_no") % 7 < 4, F.concat(F.col("line_no") % 7 + 1, F.lit(". "), "text")).otherwise(F.col("text"))
    return elements(spark, sf).withColumn("text", text)


_NUM = _ELT.replace("t AS text", "CASE WHEN (i - 1) % 7 < 4 THEN ((i - 1) % 7 + 1) || '. ' || t ELSE t END AS text")


def headings(spark, sf):
    return la.heading_base(elements(spark, sf))


@query("numbering", _NUM + "SELECT doc_id, line_no, CASE WHEN trim(text) SIMILAR TO '[0-9]+\\.[0-9]+\\.[0-9]+.*' THEN 'decimal_3' WHEN regexp_matches(trim(text), '^[0-9]+\\.[0-9]+') THEN 'decimal_2' WHEN regexp_matches(trim(text), '^[0-9]+\\.') THEN 'decimal_1' WHEN regexp_matches(trim(text), '^[A-Z]\\.') THEN 'letter_dot' WHEN regexp_matches(trim(text), '^[a-z]\\)') THEN 'letter_paren' WHEN regexp_matches(trim(text), '^[IVXivx]+\\.') THEN 'roman' WHEN regexp_matches(lower(trim(text)), '^(chapter|section) [0-9]+') THEN 'named' END AS pattern FROM elt")
def numbering(spark, sf):
    return numbered(spark, sf).select("doc_id", "line_no", tx.numbering(F.col("text")).alias("pattern"))


@query("caps_features", _ELT + ", c AS (SELECT doc_id, line_no, regexp_replace(text, '^[-*• \\t]+', '') AS t FROM elt) SELECT doc_id, line_no, length(regexp_replace(t, '[^A-Z]', '', 'g')) > 0.9::DOUBLE * length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS all_caps FROM c WHERE length(regexp_replace(t, '[^A-Za-z]', '', 'g')) > 0")
def caps_features(spark, sf):
    t = elements(spark, sf).filter(F.regexp_replace("text", "[^A-Za-z]", "") != "")
    return t.select("doc_id", "line_no", tx.capitals(F.col("text"))["all_caps"].alias("all_caps"))


@query("position_features", _ELT + ", p AS (SELECT doc_id, line_no, top, (line_no * 37 % 200)::DOUBLE AS l, least(612, line_no * 37 % 200 + length(text) * 5)::DOUBLE AS r FROM elt) SELECT doc_id, line_no, abs(l - (612 - r)) < 61.2::DOUBLE AND (r - l) / 612 < 0.8::DOUBLE AND least(l, 612 - r) >= 30.6::DOUBLE AS is_centered, l > 91.8::DOUBLE AS is_indented, top / 792::DOUBLE < 0.2::DOUBLE AS is_near_top FROM p")
def position_features(spark, sf):
    left = (F.col("line_no") * 37 % 200).cast("double")
    rows = elements(spark, sf).withColumns({"left": left, "right": F.least(F.lit(612.0), left + F.length("text") * 5)})
    return la.position_features(rows, 612.0, 792.0).select("doc_id", "line_no", "is_centered", "is_indented", "is_near_top")


@query("font_stats", _ELT + _STAT + f"SELECT doc_id, page, {r4('average')} AS average, largest, smallest, median FROM st")
def font_stats(spark, sf):
    from formlode.functions.rounding import half_up

    return la.font_stats(elements(spark, sf)).withColumn("average", half_up(F.col("average")))


@query("heading_base", _ELT + _STAT + "SELECT doc_id, line_no, level FROM hd")
def heading_base(spark, sf):
    return headings(spark, sf).select("doc_id", "line_no", "level")


@query("heading_repair", _ELT + _STAT + ", r AS (SELECT doc_id, line_no, level, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS n FROM hd WHERE level <> 'normal' AND length(text) >= 3) SELECT doc_id, line_no, level, CASE n WHEN 1 THEN 'h1' WHEN 2 THEN 'h2' ELSE 'h3' END AS repaired FROM r")
def heading_repair(spark, sf):
    return la.heading_repair(headings(spark, sf).filter("level <> 'normal' AND length(text) >= 3")).select("doc_id", "line_no", "level", "repaired")


@query("header_filldown", _ELT + _STAT + ", f AS (SELECT doc_id, line_no, level, max(CASE WHEN level = 'h1' THEN line_no END) OVER w AS h1_line, max(CASE WHEN level = 'h2' THEN line_no END) OVER w AS h2_line FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) SELECT doc_id, line_no, h1_line, h2_line, max(CASE WHEN level = 'h3' THEN line_no END) OVER (PARTITION BY doc_id, h2_line ORDER BY line_no) AS h3_line FROM f")
def header_filldown(spark, sf):
    return la.header_filldown(headings(spark, sf)).select("doc_id", "line_no", "h1_line", "h2_line", "h3_line")


_MOVED = "(line_no % 40) * 18 + 12 * (((line_no % 40) * 3) // 5)"


@query("whitespace", _ELT + f", m AS (SELECT doc_id, page, line_no, {_MOVED} AS top FROM elt), s AS (SELECT doc_id, line_no, coalesce(top - (lag(top) OVER w + 14), 0)::DOUBLE AS space_above, coalesce(lead(top) OVER w - (top + 14), 0)::DOUBLE AS space_below FROM m WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, line_no)) SELECT *, space_above > 7 AND space_below > 7 AS is_isolated FROM s")
def whitespace(spark, sf):
    spread = F.col("top") + 12 * F.floor((F.col("line_no") % 40) * 3 / 5)
    return la.whitespace(elements(spark, sf).withColumn("top", spread), 14.0).select("doc_id", "line_no", "space_above", "space_below", "is_isolated")


#: Marks put before lines, and what they are.
_MARKS = [("1. ", "numeric", 1), ("2) ", "numeric", 2), ("3. ", "numeric", 3), ("5. ", "numeric", 5), ("a. ", "lower_alpha", 0), ("b) ", "lower_alpha", 1), ("B. ", "upper_alpha", 1), ("C. ", "upper_alpha", 2), ("ii. ", "roman", 2), ("iii) ", "roman", 3), ("iv. ", "roman", 4), ("XIV. ", "roman", 14), ("• ", "symbol", None), ("- ", "symbol", None), ("", None, None)]
_MARKED = ", mk(i, mark, kind, value) AS (VALUES " + ", ".join(f"({i}, '{m}', {f'{k!r}' if k else 'NULL'}, {'NULL' if v is None else v})" for i, (m, k, v) in enumerate(_MARKS)) + ")"


@query("list_chains", _ELT + _MARKED + f", i AS (SELECT doc_id, page, line_no, mk.kind, CAST(mk.value AS INTEGER) AS value FROM elt JOIN mk ON mk.i = line_no % {len(_MARKS)} WHERE mk.kind IS NOT NULL AND length(text) > 0), j AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND (value IS NULL OR lag(value) OVER w = value - 1) AND lag(line_no) OVER w = line_no - 1 THEN 0 ELSE 1 END AS fresh FROM i WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)) SELECT doc_id, line_no, kind, value, CAST(sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS BIGINT) AS chain FROM j")
def list_chains(spark, sf):
    mark = F.element_at(F.array(*[F.lit(m) for m, _, _ in _MARKS]), (F.col("line_no") % len(_MARKS) + 1).cast("int"))
    lines = elements(spark, sf).withColumn("text", F.concat(mark, F.trim(F.regexp_replace("text", "[^A-Za-z ]", "x"))))
    return la.list_chains(lines).select("doc_id", "line_no", "kind", "value", "chain")


@query("nearest_flagged", _ELT + "SELECT doc_id, line_no, max(CASE WHEN bold THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS before, min(CASE WHEN bold THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM elt")
def nearest_flagged(spark, sf):
    return la.nearest_flagged(elements(spark, sf), F.col("bold")).select("doc_id", "line_no", "before", "after")


@query("line_ids", _ELT + "SELECT doc_id, line_no, CAST(line_no + 1 AS INTEGER) AS gid FROM elt")
def line_ids(spark, sf):
    return la.line_ids(elements(spark, sf)).select("doc_id", "line_no", "gid")


_VOTE = ", vo AS (SELECT doc_id, size, count(*) FILTER (level = 'h1') AS h1, count(*) FILTER (level = 'h2') AS h2, count(*) FILTER (level = 'h3') AS h3, count(*) FILTER (level = 'normal') AS normal, count(*) AS total FROM hd GROUP BY ALL), vs AS (SELECT *, CASE WHEN greatest(h1, h2, h3, normal) > 0.7::DOUBLE * total THEN CASE greatest(h1, h2, h3, normal) WHEN h1 THEN 'h1' WHEN h2 THEN 'h2' WHEN h3 THEN 'h3' ELSE 'normal' END END AS suggested FROM vo) "


@query("style_votes", _ELT + _STAT + _VOTE + "SELECT * FROM vs")
def style_votes(spark, sf):
    return la.style_votes(headings(spark, sf))


@query("top_styles", _ELT + _STAT + _VOTE + "SELECT * FROM (SELECT doc_id, size, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY h1 DESC, size) AS INTEGER) AS rank, h1 AS votes FROM vs WHERE h1 > 0) WHERE rank <= 3")
def top_styles(spark, sf):
    return la.top_styles(la.style_votes(headings(spark, sf)), "h1", 3)


_REP = f", rp AS (SELECT doc_id, line, count(*) AS n, CASE WHEN avg(top) < 100 THEN 'header' ELSE 'footer' END AS zone FROM (SELECT doc_id, top, {_NORM.format('text')} AS line FROM elt) WHERE length(line) > 5 GROUP BY ALL HAVING count(*) >= 3) "


@query("repeated_lines", _ELT + _REP + "SELECT doc_id, line, n, zone FROM rp")
def repeated_lines(spark, sf):
    return la.repeated_lines(elements(spark, sf))


_DUE = "CASE WHEN regexp_matches(trim(text), '^[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'h3' WHEN regexp_matches(trim(text), '^[0-9]+\\.[0-9]+') THEN 'h2' WHEN regexp_matches(trim(text), '^[0-9]+\\.') THEN 'h1' END"


@query("heading_audit", _NUM + _STAT + f", p AS (SELECT doc_id, page, count(*) FILTER (level = 'h1') AS h1, count(*) FILTER (level = 'h2') AS h2, count(*) FILTER (level = 'h3') AS h3, count(*) FILTER (level <> 'normal' AND {_DUE} <> level) AS odd, min(line_no) FILTER (level <> 'normal') AS a, max(line_no) FILTER (level <> 'normal') AS b FROM hd GROUP BY ALL) SELECT doc_id, count(*) AS pages, CAST(sum(h1) AS BIGINT) AS h1, CAST(sum(h2) AS BIGINT) AS h2, CAST(sum(h3) AS BIGINT) AS h3, count(*) FILTER (h3 > 0 AND h1 = 0 AND h2 = 0) AS orphan_pages, CAST(sum(odd) AS BIGINT) AS mismatches, min(a) AS first_line, max(b) AS last_line FROM p GROUP BY ALL")
def heading_audit(spark, sf):
    rows = numbered(spark, sf)
    return la.heading_audit(la.heading_base(rows))


@query("heading_refine", _NUM + _STAT + _VOTE + _REP + f", x AS (SELECT hd.doc_id, line_no, CASE WHEN zone IS NOT NULL THEN 'normal' ELSE level END AS refined, suggested, {_DUE} AS due FROM hd LEFT JOIN rp ON rp.doc_id = hd.doc_id AND rp.line = {_NORM.format('text')} LEFT JOIN vs ON vs.doc_id = hd.doc_id AND vs.size = hd.size), y AS (SELECT *, coalesce(suggested <> refined, false) AS s, coalesce(refined <> 'normal' AND due <> refined, false) AS d FROM x) SELECT doc_id, line_no, refined, CASE WHEN s THEN suggested WHEN d THEN due END AS suggestion, CASE WHEN s AND d THEN 0.64::DOUBLE WHEN s OR d THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM y")
def heading_refine(spark, sf):
    # Lines are asked three times: each is normalised once, where it is read, and stored with its level.
    lines = numbered(spark, sf).withColumn("line", tx.normalised(F.col("text")))
    rows = written(la.heading_base(lines).select("doc_id", "line_no", "text", "line", "size", "top", "level"), "headings")
    return la.heading_refine(rows, la.repeated_lines(rows), la.style_votes(rows)).select("doc_id", "line_no", "refined", "suggestion", "confidence")


@query("page_metadata", _ELT + "SELECT doc_id, page, coalesce(min(line_no) FILTER (bold), -1) AS first_line, coalesce(max(line_no) FILTER (bold), -1) AS last_line, count(*) FILTER (bold) AS lines FROM elt GROUP BY ALL")
def page_metadata(spark, sf):
    rows = elements(spark, sf)
    return la.page_metadata(rows.filter("bold"), rows.select("doc_id", "page").distinct())


@query("margin_zones", _ELT + ", z AS (SELECT *, CASE WHEN count(*) FILTER (top < 63.36::DOUBLE) OVER w > 0 THEN 63.36::DOUBLE ELSE 39.6::DOUBLE END AS a, CASE WHEN count(*) FILTER (top > 728.64::DOUBLE) OVER w > 0 THEN 728.64::DOUBLE ELSE 752.4::DOUBLE END AS b FROM elt WINDOW w AS (PARTITION BY doc_id, page)) SELECT doc_id, page, CASE WHEN top < a THEN 'header' WHEN top > b THEN 'footer' ELSE 'body' END AS zone, count(*) AS n FROM z GROUP BY ALL")
def margin_zones(spark, sf):
    return la.margin_zones(elements(spark, sf), 792.0).groupBy("doc_id", "page", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("neighbour_lines", _ELT + "SELECT DISTINCT e.doc_id, e.line_no FROM elt e JOIN elt h ON h.doc_id = e.doc_id AND h.size = 18 AND abs(e.line_no - h.line_no) <= 2")
def neighbour_lines(spark, sf):
    rows = elements(spark, sf)
    return la.neighbour_lines(rows, rows.filter("size = 18"), 2).select("doc_id", "line_no")


@query("reading_order", _ELT + "SELECT doc_id, page, array_to_string(list(line_no ORDER BY top, line_no), ',') AS lines FROM elt GROUP BY ALL")
def reading_order(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("top", "line_no"))), lambda x: x["line_no"].cast("string"))
    return elements(spark, sf).groupBy("doc_id", "page").agg(F.array_join(ordered, ",").alias("lines"))


@query("page_chunks", _ELT + ", c AS (SELECT *, unnest(range(greatest(0, CAST(floor((page - 3) / 2.0::DOUBLE) AS BIGINT) + 1), CAST(page // 2 AS BIGINT) + 1)) AS chunk FROM elt) SELECT doc_id, chunk, count(*) AS lines, CAST(sum(len(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS BIGINT) AS words, min(line_no) AS first_line, max(line_no) AS last_line, count(*) FILTER (bold) AS fields, string_agg(text, chr(10) ORDER BY line_no) AS text FROM c GROUP BY ALL")
def page_chunks(spark, sf):
    return la.page_chunks(elements(spark, sf), 3, 1)


@query("window_chunks")
def window_chunks(spark, sf):
    return la.window_chunks(elements(spark, sf).filter("bold"), 10, 400)


@query("key_batches", "SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 7 AS batch FROM part")
def key_batches(spark, sf):
    return la.key_batches(table(spark, sf, "part").select("p_brand", "p_partkey"), "p_partkey", "p_brand", 7)


@query("chunk_merge", _ELT + ", c AS (SELECT doc_id, line_no % 3 AS field_id, line_no AS chunk, size AS value, CASE WHEN bold THEN 'b' || size END AS label FROM elt) SELECT doc_id, field_id, arg_max(value, chunk) AS value, arg_min(label, chunk) FILTER (label IS NOT NULL) AS label FROM c GROUP BY ALL")
def chunk_merge(spark, sf):
    rows = elements(spark, sf).select("doc_id", (F.col("line_no") % 3).alias("field_id"), F.col("line_no").alias("chunk"), F.col("size").alias("value"), F.when(F.col("bold"), F.concat(F.lit("b"), "size")).alias("label"))
    return la.merged_chunks(rows)


_THIRD = "CASE WHEN top / 720::DOUBLE < 0.33::DOUBLE THEN 'top' WHEN top / 720::DOUBLE < 0.67::DOUBLE THEN 'middle' ELSE 'bottom' END"
_FP = f""", b AS (SELECT doc_id, page, line_no, top, {_NORM.format('text')} AS line, {_THIRD} AS zone FROM elt),
  pg AS (SELECT doc_id, page, count(*) AS n, sum(length(line)) AS chars, min(top) AS low, max(top) AS high, list(line ORDER BY line_no) AS o, count(*) FILTER (zone = 'top') AS t, count(*) FILTER (zone = 'middle') AS m, count(*) FILTER (zone = 'bottom') AS u FROM b GROUP BY ALL),
  pl AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last FROM pg),
  fp AS (SELECT doc_id, sha256(concat_ws('|', max(last), sum(n), sum(chars), sum(t), sum(m), sum(u), coalesce(sum(chars) FILTER (page < 2), 0), string_agg(concat_ws(',', n, low, high), '|' ORDER BY page), string_agg(concat_ws('~', o[1], o[n // 2 + 1], o[n]), '|' ORDER BY page) FILTER (page = 0 OR page = last OR page IN (last // 4, last * 2 // 4, last * 3 // 4)))) AS fingerprint FROM pl GROUP BY doc_id) """


def fingerprints(spark, sf):
    return la.doc_fingerprint(elements(spark, sf).withColumn("zone", la.third(F.col("top") / 720.0)))


@query("doc_fingerprint", _ELT + _FP + "SELECT doc_id, fingerprint FROM fp")
def doc_fingerprint(spark, sf):
    return fingerprints(spark, sf)


_FORM = """, w AS (SELECT doc_id, page, CASE length(text) % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'CHECKBOX' ELSE 'CHOICE' END AS kind, top + 7 AS y, 100 + length(text) % 300 AS x, top + 19 AS y2, 100 + length(text) % 300 + 40 + line_no % 50 AS x2 FROM elt WHERE line_no % 5 = 2),
  q AS (SELECT doc_id, page, kind, CAST(floor(y / 792.0::DOUBLE * 1000 + 0.5::DOUBLE) AS BIGINT) AS y, CAST(floor(x / 612.0::DOUBLE * 1000 + 0.5::DOUBLE) AS BIGINT) AS x, CAST(floor(y2 / 792.0::DOUBLE * 1000 + 0.5::DOUBLE) AS BIGINT) AS y2, CAST(floor(x2 / 612.0::DOUBLE * 1000 + 0.5::DOUBLE) AS BIGINT) AS x2, CASE WHEN (y + 6.0::DOUBLE) / 792 < 0.33::DOUBLE THEN 0 WHEN (y + 6.0::DOUBLE) / 792 < 0.67::DOUBLE THEN 1 ELSE 2 END AS spot FROM w),
  pk AS (SELECT doc_id, page, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT doc_id, page, kind, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL),
  dk AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS widgets, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT doc_id, kind, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL),
  pp AS (SELECT doc_id, page, sha256(string_agg(y || ',' || x || ',' || y2 || ',' || x2, ';' ORDER BY y, x, y2, x2)) AS h, count(*) FILTER (spot = 0) || '/' || count(*) FILTER (spot = 1) || '/' || count(*) FILTER (spot = 2) AS thirds FROM q GROUP BY ALL),
  dp AS (SELECT doc_id, string_agg(page || ':' || kinds, '|' ORDER BY page) AS page_kinds, string_agg(page || ':' || h, '|' ORDER BY page) AS boxes, string_agg(page || ':' || thirds, '|' ORDER BY page) AS thirds FROM pp JOIN pk USING (doc_id, page) GROUP BY ALL),
  ff AS (SELECT doc_id, fingerprint AS f, coalesce(widgets, 0) AS widgets, coalesce(kinds, '') AS kinds, coalesce(page_kinds, '') AS page_kinds, coalesce(boxes, '') AS boxes, coalesce(thirds, '') AS thirds FROM fp LEFT JOIN dk USING (doc_id) LEFT JOIN dp USING (doc_id))
  SELECT doc_id, sha256(f || '#6120x7920#' || widgets || '#' || kinds || '#' || page_kinds || '#' || boxes || '#' || thirds) AS fingerprint, widgets, kinds, page_kinds, boxes, thirds FROM ff"""


@query("form_fingerprint", _ELT + _FP + _FORM)
def form_fingerprint(spark, sf):
    lines = elements(spark, sf).withColumn("zone", la.third(F.col("top") / 720.0))
    n = F.length("text")
    kind = F.when(n % 4 == 1, "TEXT").when(n % 4 == 2, "CHECKBOX").when(n % 4 == 3, "CHOICE")
    boxes = lines.filter("line_no % 5 = 2").select("doc_id", "page", kind.alias("kind"), (100 + n % 300).alias("left"), (F.col("top") + 7).alias("top"), (40 + F.col("line_no") % 50).alias("width"), F.lit(12).alias("height"))
    return la.form_fingerprint(lines, boxes, 612.0, 792.0)


@query("fingerprint_dups", _ELT + _FP + "SELECT fingerprint, count(*) AS n, min(doc_id) AS first_id FROM fp GROUP BY ALL HAVING count(*) > 1")
def fingerprint_dups(spark, sf):
    return fingerprints(spark, sf).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("registry_stats", _ELT + _FP + f"SELECT count(*) AS entries, CAST(sum(n) AS BIGINT) AS uses, {a4('n')} AS avg_uses FROM (SELECT fingerprint, count(*) AS n FROM fp GROUP BY ALL)")
def registry_stats(spark, sf):
    from formlode.functions.rounding import mean

    uses = fingerprints(spark, sf).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return uses.agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("uses"), mean("n").alias("avg_uses"))


@query("outline_match", _ELT + ", n AS (SELECT doc_id, line_no, lower(trim(text)) AS line FROM elt WHERE trim(text) <> ''), t AS (SELECT item_id AS title_id, lower(trim(text)) AS title FROM benchmark WHERE trim(text) <> ''), e AS (SELECT doc_id, line_no, min(title_id) AS title_id, 'exact' AS kind FROM n JOIN t ON line = title GROUP BY ALL), r AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = n.doc_id AND e.line_no = n.line_no)) SELECT *, 'h' || least(title_id % 5 + 1, 3) AS heading FROM (SELECT * FROM e UNION ALL SELECT doc_id, line_no, min(title_id) AS title_id, 'partial' AS kind FROM r JOIN t ON length(title) > 10 AND (contains(line, title) OR contains(title, line)) GROUP BY doc_id, line_no)")
def outline_match(spark, sf):
    return la.outline_match(elements(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("title_id"), F.col("text").alias("title"), (F.col("item_id") % 5 + 1).alias("level")), short_lines=True)


def widgets(spark, sf):
    rows = elements(spark, sf).filter("line_no % 5 = 2")
    return rows.select("doc_id", "page", F.col("line_no").alias("widget_id"), (F.col("top") + 7).cast("double").alias("top"), (F.col("top") + 19).cast("double").alias("bottom"), (100 + F.length("text") % 300).cast("double").alias("left"))


_WID = ", wid AS (SELECT doc_id, page, line_no AS widget_id, (top + 7)::DOUBLE AS top, (top + 19)::DOUBLE AS bottom, (100 + length(text) % 300)::DOUBLE AS l FROM elt WHERE line_no % 5 = 2) "


@query("nearest_line", _ELT + _WID + f", f AS (SELECT w.doc_id, w.page, widget_id, bottom + CASE WHEN widget_id % 10 = 2 THEN 900 ELSE 0 END AS bottom FROM wid w), d AS (SELECT w.doc_id, widget_id, e.line_no, row_number() OVER (PARTITION BY w.doc_id, widget_id ORDER BY abs(w.bottom - (e.top + 14)), e.line_no) AS n FROM f w JOIN elt e ON e.doc_id = w.doc_id AND e.page = w.page AND abs(w.bottom - (e.top + 14)) <= 10), j AS (SELECT w.*, d.line_no, (SELECT max(line_no) FROM elt WHERE elt.doc_id = w.doc_id) AS last FROM f w LEFT JOIN d ON d.doc_id = w.doc_id AND d.widget_id = w.widget_id AND d.n = 1) SELECT doc_id, page, widget_id, CAST(coalesce(line_no, last + row_number() OVER (PARTITION BY doc_id, line_no IS NULL ORDER BY page, bottom, widget_id)) AS INTEGER) AS line_no, line_no IS NULL AS is_new FROM j")
def nearest_line(spark, sf):
    moved = F.col("bottom") + F.when(F.col("widget_id") % 10 == 2, 900).otherwise(0)  # beyond every line
    return la.nearest_line(widgets(spark, sf).withColumn("bottom", moved), elements(spark, sf).withColumn("bottom", (F.col("top") + 14).cast("double")))


@query("label_proximity", _ELT + _WID + "SELECT w.doc_id, w.page, widget_id, e.line_no AS text_id FROM wid w JOIN elt e ON e.doc_id = w.doc_id AND e.page = w.page AND abs(w.top - e.top) < 15 AND w.l >= 20 AND w.l - (20 + length(e.text)) < 200")
def label_proximity(spark, sf):
    texts = elements(spark, sf).select("doc_id", "page", F.col("line_no").alias("text_id"), F.col("top").cast("double").alias("top"), F.lit(20.0).alias("left"), (20.0 + F.length("text")).alias("right"))
    return la.label_proximity(texts, widgets(spark, sf))


@query("underline_match", _ELT + "SELECT doc_id, line_no FROM elt e WHERE EXISTS (SELECT 1 FROM elt s WHERE s.doc_id = e.doc_id AND s.page = e.page AND s.bold AND length(s.text) > 20 AND (s.top + 16) - (e.top + 14) >= -5 AND (s.top + 16) - (e.top + 14) <= 10)")
def underline_match(spark, sf):
    rows = elements(spark, sf)
    lines = rows.select("doc_id", "page", "line_no", (F.col("top") + 14).alias("bottom"), F.lit(20).alias("left"), (F.length("text") + 20).alias("right"))
    strokes = rows.filter("bold").select("doc_id", "page", (F.col("top") + 16).alias("y1"), (F.col("top") + 16).alias("y2"), F.lit(20).alias("x1"), (F.length("text") + 20).alias("x2"))
    return la.underlined(lines, strokes).select("doc_id", "line_no")


@query("box_overlap", _ELT + "SELECT e.doc_id, e.page, e.line_no AS word_id, min(s.line_no) AS span_id FROM elt e JOIN elt s ON s.doc_id = e.doc_id AND s.page = e.page AND least(e.top + 14, s.top + 20) - greatest(e.top, s.top) > 0 AND (contains(s.text, e.text) OR contains(e.text, s.text)) GROUP BY ALL")
def box_overlap(spark, sf):
    rows = elements(spark, sf)
    words = rows.select("doc_id", "page", F.col("line_no").alias("word_id"), "text", F.lit(20).alias("x"), F.lit(90).alias("x2"), F.col("top").alias("y"), (F.col("top") + 14).alias("y2"))
    spans = rows.select("doc_id", "page", F.col("line_no").alias("span_id"), "text", F.lit(50).alias("x"), F.lit(120).alias("x2"), F.col("top").alias("y"), (F.col("top") + 20).alias("y2"))
    return la.box_overlap(words, spans)


@query("option_groups", _ELT + ", g AS (SELECT doc_id, line_no, unnest(range(CAST(line_no % 4 + 1 AS BIGINT))) AS pos, size FROM elt) SELECT doc_id || '_' || line_no AS group_key, CAST(line_no * 10 + pos AS INTEGER) AS field_id, CASE WHEN pos < 2 THEN 'v' || (size + pos) ELSE '' END AS export_value FROM g")
def option_groups(spark, sf):
    rows = elements(spark, sf).select(F.concat_ws("_", "doc_id", "line_no").alias("group_key"), F.transform(F.sequence(F.lit(0), F.col("line_no") % 4), lambda i: F.col("line_no") * 10 + i).alias("field_ids"), F.array(F.concat(F.lit("v"), "size"), F.concat(F.lit("v"), F.col("size") + 1)).alias("export_values"))
    return la.option_groups(rows)


@query("widget_names", _ELT + ", w AS (SELECT doc_id, page, line_no AS widget_id, top + (line_no % 3) AS y FROM elt WHERE line_no % 5 = 2), m AS (SELECT w.*, (SELECT min(e.line_no) FROM elt e WHERE e.doc_id = w.doc_id AND e.page = w.page AND abs(e.top - w.y) < 2 AND e.line_no % 4 <> 0) AS f FROM w) SELECT doc_id, page, widget_id, CASE WHEN f IS NULL THEN 'unmapped_unknown' WHEN f % 3 = 0 THEN 'key_' || f ELSE 'unmapped_' || f END AS name FROM m")
def widget_names(spark, sf):
    rows = elements(spark, sf)
    box = lambda y: [F.lit(20.0).alias("x"), y.alias("y"), F.lit(90.0).alias("x2"), (y + 14).alias("y2")]
    widgets_ = rows.filter("line_no % 5 = 2").select("doc_id", "page", F.col("line_no").alias("widget_id"), *box(F.col("top") + F.col("line_no") % 3))
    fields = rows.filter("line_no % 4 <> 0").select("doc_id", "page", F.col("line_no").alias("field_id"), *box(F.col("top")))
    keys = rows.select("doc_id", F.col("line_no").alias("field_id"), F.concat(F.lit("key_"), "line_no").alias("key"), F.when(F.col("line_no") % 3 == 0, 0.9).otherwise(0.5).alias("conf"))
    return la.widget_names(widgets_, fields, keys)


@query("cell_locate", _ELT + ", w AS (SELECT doc_id, page, line_no AS widget_id, 30 + (length(text) % 50) * 10 AS cx, top + 9.5::DOUBLE AS cy FROM elt WHERE line_no % 5 = 2), c AS (SELECT range % 3 AS col, range // 3 AS row FROM range(9)), b AS (SELECT *, col * 100 AS x, row * 200 AS y, row_number() OVER (PARTITION BY doc_id, widget_id ORDER BY CASE WHEN cx BETWEEN col * 100 AND col * 100 + 90 AND cy BETWEEN row * 200 AND row * 200 + 190 THEN -1 ELSE (cx - (col * 100 + 45)) ** 2 + (cy - (row * 200 + 95)) ** 2 END, row, col) AS n FROM w, c WHERE page % 3 <> 1) SELECT doc_id, page, widget_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM b WHERE n = 1 UNION ALL SELECT doc_id, page, widget_id, CAST(greatest(0, least(2, floor((cy - 100.0::DOUBLE) / 500.0::DOUBLE * 3))) AS BIGINT), CAST(greatest(0, least(2, floor((cx - 50.0::DOUBLE) / 240.0::DOUBLE * 3))) AS BIGINT) FROM w WHERE page % 3 = 1")
def cell_locate(spark, sf):
    rows = elements(spark, sf)
    cx = 30.0 + (F.length("text") % 50) * 10
    widgets_ = rows.filter("line_no % 5 = 2").select("doc_id", "page", F.col("line_no").alias("widget_id"), (cx - 5).alias("x"), (cx + 5).alias("x2"), F.col("top").alias("y"), (F.col("top") + 19).alias("y2"))
    grid = rows.filter("page % 3 <> 1").select("doc_id", "page").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("doc_id", "page", F.floor(F.col("i") / 3).alias("row"), (F.col("i") % 3).cast("long").alias("col"))
    cells = grid.select("doc_id", "page", "row", "col", (F.col("col") * 100.0).alias("x"), (F.col("col") * 100.0 + 90).alias("x2"), (F.col("row") * 200.0).alias("y"), (F.col("row") * 200.0 + 190).alias("y2"))
    return la.cell_locate(widgets_, cells, (50.0, 100.0, 290.0, 600.0), (3, 3))


@query("line_rebuild", _ELT + ", w AS (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM elt), x AS (SELECT *, 70 + i * 21 AS x, coalesce(lag(70 + i * 21 + length(word)) OVER (PARTITION BY doc_id, line_no ORDER BY i), 70) AS b FROM w) SELECT doc_id, line_no, string_agg(repeat(' ', CAST(greatest((x - b) // 7, 0) AS BIGINT)) || regexp_replace(word, '[_.]{3,}', ' ', 'g'), '' ORDER BY i) AS line FROM x GROUP BY ALL")
def line_rebuild(spark, sf):
    words = elements(spark, sf).select("doc_id", "line_no", F.posexplode(F.split("text", " ")).alias("p", "word"))
    x = 70 + (F.col("p") + 1) * 21
    return la.line_rebuild(words.select("doc_id", "line_no", F.col("p").alias("word_no"), "word", x.alias("x"), (x + F.length("word")).alias("x2")))


# Every fifth line in capitals, so that the rules on them decide some lines.
_ABC, _BIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def marked(spark, sf):
    rows = numbered(spark, sf).withColumn("text", F.when(F.col("line_no") % 5 == 3, F.translate("text", _ABC, _BIG)).otherwise(F.col("text")))
    left = (F.col("line_no") * 37 % 200).cast("double")
    rows = rows.withColumns({"left": left, "right": F.least(F.lit(612.0), left + F.length("text") * 5), "is_isolated": F.col("line_no") % 4 == 0, "underlined": F.col("line_no") % 6 == 1})
    return la.heading_base(rows, keep_statistics=True)


_PATTERN = "CASE WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'decimal_3' WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+') THEN 'decimal_2' WHEN regexp_matches(t, '^[0-9]+\\.') THEN 'decimal_1' WHEN regexp_matches(t, '^[A-Z]\\.') THEN 'letter_dot' WHEN regexp_matches(t, '^[a-z]\\)') THEN 'letter_paren' WHEN regexp_matches(t, '^[IVXivx]+\\.') THEN 'roman' WHEN regexp_matches(lower(t), '^(chapter|section) [0-9]+') THEN 'named' END"
_HINTS = ("'numbered_' || p", "CASE WHEN centred THEN 'centered' END", "CASE WHEN high THEN 'near_top' END", "CASE WHEN dented THEN 'indented' END", "CASE WHEN dented AND r3 = 'h1' THEN 'demoted_indented' END",
    "CASE WHEN caps THEN 'all_caps' END", "CASE WHEN caps AND r4 = 'normal' THEN 'promoted_all_caps' END", "CASE WHEN caps AND bold AND r5 = 'h3' THEN 'promoted_bold_caps' WHEN caps AND bold AND centred AND r5 = 'h2' THEN 'promoted_centered_caps' END",
    "CASE WHEN titled THEN 'title_case' END", "CASE WHEN alone THEN 'isolated' END", "CASE WHEN n < 50 THEN 'short_text' END", "CASE WHEN n > 200 THEN 'long_text' END", "CASE WHEN r7 <> r8 THEN 'demoted_long' END",
    "CASE WHEN bold THEN 'bold' END", "CASE WHEN under THEN 'underlined' END", "CASE WHEN under AND r8 = 'normal' THEN 'promoted_underlined' END", "CASE WHEN under AND bold AND r9 = 'h3' THEN 'promoted_underlined_bold' WHEN under AND centred AND r9 IN ('h3', 'h2') THEN 'promoted_underlined_centered' END", "CASE WHEN big THEN 'large_font' END")
_POINTS = " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in (("centred", 15), ("high", 10), ("caps", 15), ("titled", 10), ("alone", 10), ("n < 50", 5), ("bold", 10), ("under", 20), ("big", 10)))


@query("heading_context", _NUM.replace("WITH elt AS", "WITH low AS") + f""", elt AS (SELECT doc_id, line_no, page, size, top, bold, CASE WHEN line_no % 5 = 3 THEN translate(text, '{_ABC}', '{_BIG}') ELSE text END AS text FROM low)""" + _STAT + f""",
  a AS (SELECT hd.*, trim(text) AS t, length(trim(text)) AS n, (line_no * 37 % 200)::DOUBLE AS l, least(612, line_no * 37 % 200 + length(text) * 5)::DOUBLE AS r, line_no % 4 = 0 AS alone, line_no % 6 = 1 AS under, regexp_replace(trim(text), '^[-*• \t]+', '') AS body FROM hd),
  b AS (SELECT *, {_PATTERN} AS p, abs(l - (612 - r)) < 61.2::DOUBLE AND (r - l) / 612 < 0.8::DOUBLE AND least(l, 612 - r) >= 30.6::DOUBLE AS centred, l > 91.8::DOUBLE AS dented, top / 792::DOUBLE < 0.2::DOUBLE AS high, size / average >= 1.3::DOUBLE AS big,
    length(regexp_replace(body, '[^A-Z]', '', 'g')) > 0.9::DOUBLE * length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS caps, list_filter(string_split_regex(body, '[ \t]+'), lambda w: regexp_matches(w, '^[A-Za-z]')) AS words FROM a),
  c AS (SELECT *, len(words) > 0 AND len(list_filter(words, lambda w: regexp_matches(w, '^[A-Z]'))) > 0.7::DOUBLE * len(words) AS titled, CASE WHEN p IN ('decimal_1', 'named') THEN 'h1' WHEN p = 'decimal_3' OR p = 'letter_paren' THEN 'h3' WHEN p IS NOT NULL THEN 'h2' ELSE level END AS r1 FROM b),
  d AS (SELECT *, CASE WHEN centred AND bold AND r1 = 'h3' THEN 'h2' WHEN centred AND bold AND r1 = 'normal' THEN 'h3' ELSE r1 END AS r2 FROM c),
  e AS (SELECT *, CASE WHEN high AND bold AND level IN ('h2', 'h3') THEN 'h1' ELSE r2 END AS r3 FROM d),
  f AS (SELECT *, CASE WHEN dented AND r3 = 'h1' THEN 'h2' ELSE r3 END AS r4 FROM e),
  g AS (SELECT *, CASE WHEN caps AND r4 = 'normal' THEN 'h3' ELSE r4 END AS r5 FROM f),
  h AS (SELECT *, CASE WHEN caps AND bold AND r5 = 'h3' THEN 'h2' WHEN caps AND bold AND centred AND r5 = 'h2' THEN 'h1' ELSE r5 END AS r6 FROM g),
  i AS (SELECT *, CASE WHEN alone AND bold AND r6 = 'normal' THEN 'h3' ELSE r6 END AS r7 FROM h),
  j AS (SELECT *, CASE WHEN n > 200 AND r7 IN ('h2', 'h3') AND p IS NULL AND NOT caps AND NOT centred THEN 'normal' ELSE r7 END AS r8 FROM i),
  k AS (SELECT *, CASE WHEN under AND r8 = 'normal' THEN 'h3' ELSE r8 END AS r9 FROM j),
  m AS (SELECT *, CASE WHEN under AND bold AND r9 = 'h3' THEN 'h2' WHEN under AND centred AND r9 IN ('h3', 'h2') THEN 'h1' ELSE r9 END AS r10 FROM k)
  SELECT doc_id, line_no, CASE WHEN n < 3 THEN 'normal' ELSE r10 END AS refined, CASE WHEN n < 3 THEN 0.9::DOUBLE ELSE least(100, 50 + CASE WHEN p IN ('decimal_1', 'named') THEN 40 WHEN p IN ('decimal_2', 'letter_dot', 'roman') THEN 35 WHEN p IS NOT NULL THEN 30 ELSE 0 END + {_POINTS}) / 100.0::DOUBLE END AS confidence,
    CASE WHEN n < 3 THEN 'too_short' ELSE array_to_string(list_filter([{', '.join(_HINTS)}], lambda x: x IS NOT NULL), ',') END AS hints FROM m""")
def heading_context(spark, sf):
    return la.heading_context(marked(spark, sf), 612.0, 792.0).select("doc_id", "line_no", "refined", "confidence", "hints")


@query("field_hierarchy", _ELT + _STAT + """, x AS (SELECT doc_id, line_no, page, CASE WHEN line_no % 11 = 3 THEN '' ELSE substr(text, 1, 30) END AS text, CASE WHEN line_no % 40 IN (1, 9) THEN 'title' WHEN level = 'normal' AND line_no % 3 = 0 THEN 'h4' ELSE level END AS level, CASE WHEN line_no % 4 > 0 THEN 'part ' || line_no % 4 END AS section_context, line_no % 2 = 0 AS is_field FROM hd),
  y AS (SELECT *, max(CASE WHEN level = 'h2' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS at2 FROM x),
  z AS (SELECT *, max(CASE WHEN level = 'h3' THEN line_no END) OVER (PARTITION BY doc_id, at2 ORDER BY line_no) AS at3 FROM y),
  pg AS (SELECT doc_id, page, min(CASE WHEN level = 'title' THEN line_no END) AS at0, min(CASE WHEN level = 'h1' THEN line_no END) AS at1, max(CASE WHEN level = 'h2' THEN line_no END) AS last2 FROM x GROUP BY ALL)
  SELECT z.doc_id, z.line_no, z.page, z.line_no AS field_id, t0.text AS title, t1.text AS h1, coalesce(nullif(t2.text, ''), d2.text) AS h2, coalesce(t2.section_context, d2.section_context) AS section_context, CASE WHEN z.level = 'h3' THEN z.text WHEN z.level = 'h4' THEN nullif(t3.text, '') END AS h3, CASE WHEN z.level = 'h4' THEN z.text END AS h4
  FROM z JOIN pg ON pg.doc_id = z.doc_id AND pg.page = z.page LEFT JOIN x t0 ON t0.doc_id = z.doc_id AND t0.line_no = at0 LEFT JOIN x t1 ON t1.doc_id = z.doc_id AND t1.line_no = at1 LEFT JOIN x t2 ON t2.doc_id = z.doc_id AND t2.line_no = at2 LEFT JOIN x t3 ON t3.doc_id = z.doc_id AND t3.line_no = at3 LEFT JOIN x d2 ON d2.doc_id = z.doc_id AND d2.line_no = last2 WHERE z.is_field""")
def field_hierarchy(spark, sf):
    line, level = F.col("line_no"), F.col("level")
    text = F.when(line % 11 == 3, "").otherwise(F.substring("text", 1, 30))
    named = F.when((line % 40).isin(1, 9), "title").when((level == "normal") & (line % 3 == 0), "h4").otherwise(level)
    context = F.when(line % 4 > 0, F.concat(F.lit("part "), line % 4))
    rows = headings(spark, sf).withColumns({"text": text, "level": named, "section_context": context, "field_id": F.when(line % 2 == 0, line)})
    return la.field_hierarchy(rows)
