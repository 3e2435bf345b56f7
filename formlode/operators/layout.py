"""Analytics of page layout: fonts, headings, lists, margins, repeated lines, spatial joins and chunks.

Elements are rows (doc_id, page, line_no, text, size, bold, top, ...); all order comes from explicit columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlode.functions.rounding import half_up
from formlode.functions.text import capitals, normalised, numbering

PAGE = ("doc_id", "page")


def normalised_box(left: str, top: str, right: str, bottom: str, width: str, height: str, page_width: float, page_height: float, digits: int | None = 3) -> Column:
    """A box completed from either corner or size, relative to its page."""
    x2 = F.coalesce(F.col(right), F.col(left) + F.col(width))
    y2 = F.coalesce(F.col(bottom), F.col(top) + F.col(height))
    put = (lambda c: half_up(c, digits)) if digits is not None else (lambda c: c)
    parts = {"x": F.col(left) / page_width, "y": F.col(top) / page_height, "x2": x2 / page_width, "y2": y2 / page_height}
    return F.struct(*[put(c).alias(n) for n, c in parts.items()])


def third(centre: Column) -> Column:
    return F.when(centre < 0.33, "top").when(centre < 0.67, "middle").otherwise("bottom")


def position_features(lines: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Centred, indented, near the top, and width share of each line from left, right and top."""
    left, right = F.col("left"), page_width - F.col("right")
    share = (F.col("right") - F.col("left")) / page_width
    centred = (F.abs(left - right) < page_width * 0.1) & (share < 0.8) & (F.least(left, right) >= page_width * 0.05)
    return lines.withColumns({"is_centered": centred, "is_indented": left > page_width * 0.15, "is_near_top": F.col("top") / page_height < 0.2, "width_ratio": share})


def font_stats(elements: DataFrame) -> DataFrame:
    """Mean, upper median, largest and smallest size of each page, of sizes from 6 to 72; 12 where a page has none."""
    sane = F.when(F.col("size").between(6, 72), F.col("size"))
    ordered = F.array_sort(F.collect_list(sane))
    rows = elements.groupBy(*PAGE).agg(F.avg(sane).alias("average"), F.max(sane).alias("largest"), F.min(sane).alias("smallest"), ordered.alias("s"))
    median = F.get("s", F.floor(F.size("s") / 2).cast("int"))
    default = F.lit(12.0)
    return rows.select(*PAGE, *[F.coalesce(F.col(c).cast("double"), default).alias(c) for c in ("average", "largest", "smallest")], F.coalesce(median.cast("double"), default).alias("median"))


def heading_base(elements: DataFrame, keep_statistics: bool = False) -> DataFrame:
    """h1, h2, h3 or normal from the size's place in its page and from boldness; with the page's statistics if asked for."""
    rows = elements.join(font_stats(elements), list(PAGE))
    size, bold = F.col("size"), F.col("bold")
    reach = F.col("largest") - F.col("smallest")
    at = F.when(reach > 0, (size - F.col("smallest")) / reach).otherwise(0.5)
    ratio = F.when(F.col("average") > 0, size / F.col("average")).otherwise(1.0)
    level = (
        F.when((size >= F.col("largest")) | (at >= 0.9) | ((at >= 0.8) & bold), "h1")
        .when(((at >= 0.7) & bold) | (ratio >= 1.5) | ((ratio >= 1.2) & bold), "h2").when(bold, "h3").otherwise("normal")
    )
    rows = rows.withColumn("level", level)
    return rows if keep_statistics else rows.drop("average", "largest", "smallest", "median")


def heading_repair(headings: DataFrame) -> DataFrame:
    """Per page the first heading is h1, the second h2, and later h1 and h2 become h3; in closed form by rank."""
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no"))
    return headings.withColumn("repaired", F.when(rank == 1, "h1").when(rank == 2, "h2").otherwise("h3"))


def header_filldown(elements: DataFrame) -> DataFrame:
    """Each line's latest h1, h2 and h3 before or at it; h3 starts anew at each h2."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    named = lambda level: F.last(F.when(F.col("level") == level, F.col("line_no")), ignorenulls=True)
    rows = elements.withColumns({"h1_line": named("h1").over(upto), "h2_line": named("h2").over(upto)})
    within = Window.partitionBy("doc_id", "h2_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("h3_line", named("h3").over(within))


def whitespace(lines: DataFrame, height: float) -> DataFrame:
    """Space above and below each line of a page; isolated if both exceed half the line height."""
    order = Window.partitionBy(*PAGE).orderBy("top", "line_no")
    above = F.coalesce(F.col("top") - (F.lag("top").over(order) + height), F.lit(0.0))
    below = F.coalesce(F.lead("top").over(order) - (F.col("top") + height), F.lit(0.0))
    return lines.withColumns({"space_above": above, "space_below": below}).withColumn("is_isolated", (F.col("space_above") > height * 0.5) & (F.col("space_below") > height * 0.5))


#: The marks of unordered list items, and the kinds of ordered ones in the order in which they are tried.
SYMBOLS = "•○■▪▫►▸⇒✓✔⇨◆◇*-"
BULLETS = (("numeric", r"^([0-9]+)[.)]\s+"), ("lower_alpha", r"^([a-z])[.)]\s+"), ("upper_alpha", r"^([A-Z])[.)]\s+"), ("roman", r"^([ivxIVX]+)[.)]\s+"))


def roman_value(numeral: Column) -> Column:
    """The number that a numeral of i, v and x stands for: each letter, taken off where a larger one follows."""
    worth = lambda c: F.when(c == "x", 10).when(c == "v", 5).when(c == "i", 1).otherwise(0)
    letters = F.split(F.lower(numeral), "")
    return F.aggregate(F.transform(letters, lambda c, i: F.when(worth(c) < worth(F.coalesce(F.get(letters, i + 1), F.lit(""))), -worth(c)).otherwise(worth(c))), F.lit(0), lambda a, x: a + x)


def list_chains(lines: DataFrame) -> DataFrame:
    """(.., kind, value, chain) of list items: numbers, letters from 0, roman numerals, or symbols of no value.

    A page's chain ends where an item is of another kind, does not follow its predecessor's value, or another line stands between.
    """
    found = [F.regexp_extract(F.trim("text"), pattern, 1).alias(kind) for kind, pattern in BULLETS]
    symbol = F.trim("text").rlike(f"^[{SYMBOLS}]\\s+").alias("symbol")
    letter = lambda x, first: F.ascii(x) - ord(first)

    def item(m: Column) -> Column:
        kind = F.coalesce(*[F.when(m[k] != "", F.lit(k)) for k, _ in BULLETS], F.when(m["symbol"], F.lit("symbol")))
        worth = {"numeric": m["numeric"].try_cast("int"), "lower_alpha": letter(m["lower_alpha"], "a"), "upper_alpha": letter(m["upper_alpha"], "A"), "roman": roman_value(m["roman"])}
        return F.struct(kind.alias("kind"), F.coalesce(*[F.when(kind == k, v) for k, v in worth.items()]).alias("value"))

    # A filter on the kind would be pushed below, and what makes the text evaluated again for each pattern.
    marks = F.filter(F.transform(F.array(F.struct(*found, symbol)), item), lambda i: i["kind"].isNotNull())
    items = lines.withColumn("_item", F.explode(marks)).withColumns({"kind": F.col("_item.kind"), "value": F.col("_item.value")}).drop("_item")
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    next_ = F.col("value").isNull() | (F.lag("value").over(order) == F.col("value") - 1)
    follows = (F.lag("kind").over(order) == F.col("kind")) & next_ & (F.lag("line_no").over(order) == F.col("line_no") - 1)
    starts = items.withColumn("_new", F.when(follows, 0).otherwise(1))
    return starts.withColumn("chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def nearest_flagged(lines: DataFrame, flag: Column) -> DataFrame:
    """The nearest flagged line at or before and at or after each line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    mark = F.when(flag, F.col("line_no"))
    return lines.withColumns({"before": F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})


def line_ids(lines: DataFrame) -> DataFrame:
    return lines.withColumn("gid", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "top", "line_no")))


def style_votes(headings: DataFrame, least: float = 0.7) -> DataFrame:
    """Votes of heading levels for each font size of a document, and the dominant level if its share exceeds ``least``."""
    levels = ("h1", "h2", "h3", "normal")
    votes = headings.groupBy("doc_id", "size").agg(*[F.count_if(F.col("level") == v).alias(v) for v in levels], F.count(F.lit(1)).alias("total"))
    best = F.greatest(*levels)
    winner = F.when(best == F.col("h1"), "h1").when(best == F.col("h2"), "h2").when(best == F.col("h3"), "h3").otherwise("normal")
    return votes.withColumn("suggested", F.when(best > least * F.col("total"), winner))


def top_styles(votes: DataFrame, level: str, k: int = 3) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc(level), "size")
    return votes.filter(F.col(level) > 0).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("doc_id", "size", "rank", F.col(level).alias("votes"))


def _line(lines: DataFrame) -> Column:
    """The normalised text: the column ``line`` where there is one."""
    return F.col("line") if "line" in lines.columns else normalised(F.col("text"))


def repeated_lines(lines: DataFrame, least: int = 3, shortest: int = 5, split: float = 100.0) -> DataFrame:
    """Normalised lines that a document has at least ``least`` times: header if their mean top is small, else footer.

    Lines may bring their normalised text as ``line``.
    """
    named = lines.select("doc_id", "top", _line(lines).alias("line"))
    # The length is an aggregate, as a filter on the line would be pushed below and normalise each line twice.
    groups = named.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"), F.avg("top").alias("mean_top"), F.max(F.length("line")).alias("length"))
    groups = groups.filter((F.col("n") >= least) & (F.col("length") > shortest))
    return groups.select("doc_id", "line", "n", F.when(F.col("mean_top") < split, "header").otherwise("footer").alias("zone"))


def heading_refine(headings: DataFrame, repeated: DataFrame, votes: DataFrame) -> DataFrame:
    """(.., refined, suggestion, confidence): headings in repeated lines become normal; differing styles and numbers cast doubt.

    The dominant level of the font size is suggested where it differs, else the level that a decimal number stands for. Each doubt
    multiplies the confidence by 0.8, down to 0.6. Headings may bring their normalised text as ``line``.
    """
    rows = headings.withColumn("line", _line(headings)).join(repeated.select("doc_id", "line", "zone"), ["doc_id", "line"], "left")
    rows = rows.join(votes.select("doc_id", "size", "suggested"), ["doc_id", "size"], "left")
    refined = F.when(F.col("zone").isNotNull(), "normal").otherwise(F.col("level"))
    number = numbering(F.col("text"))
    due = F.when(number == "decimal_1", "h1").when(number == "decimal_2", "h2").when(number == "decimal_3", "h3")
    by_style = F.coalesce(F.col("suggested") != refined, F.lit(False))
    by_number = F.coalesce((refined != "normal") & (due != refined), F.lit(False))
    confidence = F.greatest(F.lit(0.6), F.when(by_style & by_number, 0.64).when(by_style | by_number, 0.8).otherwise(1.0))
    suggestion = F.when(by_style, F.col("suggested")).when(by_number, due)
    return rows.withColumns({"refined": refined, "suggestion": suggestion, "confidence": confidence}).drop("line")


def heading_audit(headings: DataFrame) -> DataFrame:
    """Per document: heading counts and range, pages with h3 but neither h1 nor h2, and decimal numbers at odds with their level."""
    number = numbering(F.col("text"))
    due = F.when(number == "decimal_1", "h1").when(number == "decimal_2", "h2").when(number == "decimal_3", "h3")
    heading = F.col("level") != "normal"
    edge = [f(F.when(heading, F.col("line_no"))).alias(n) for f, n in ((F.min, "first_line"), (F.max, "last_line"))]
    page = headings.groupBy(*PAGE).agg(*[F.count_if(F.col("level") == v).alias(v) for v in ("h1", "h2", "h3")], F.count_if(heading & (due != F.col("level"))).alias("odd"), *edge)
    orphan = (F.col("h3") > 0) & (F.col("h1") == 0) & (F.col("h2") == 0)
    return page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(v).alias(v) for v in ("h1", "h2", "h3")], F.count_if(orphan).alias("orphan_pages"), F.sum("odd").alias("mismatches"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))


def page_metadata(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Smallest and largest line of each page and their number; -1 where a page has none."""
    have = elements.groupBy(*PAGE).agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.count(F.lit(1)).alias("n"))
    return pages.join(have, list(PAGE), "left").select(*PAGE, F.coalesce("a", F.lit(-1)).alias("first_line"), F.coalesce("b", F.lit(-1)).alias("last_line"), F.coalesce("n", F.lit(0)).alias("lines"))


def margin_zones(lines: DataFrame, page_height: float) -> DataFrame:
    """header, footer or body: the outer 8 % of a page, or 5 % on a side where no line falls there."""
    page = Window.partitionBy(*PAGE)
    top = F.when(F.count_if(F.col("top") < page_height * 0.08).over(page) > 0, page_height * 0.08).otherwise(page_height * 0.05)
    bottom = F.when(F.count_if(F.col("top") > page_height * 0.92).over(page) > 0, page_height * 0.92).otherwise(page_height * 0.95)
    return lines.withColumn("zone", F.when(F.col("top") < top, "header").when(F.col("top") > bottom, "footer").otherwise("body"))


def neighbour_lines(lines: DataFrame, hits: DataFrame, reach: int) -> DataFrame:
    """Lines within ``reach`` of a hit of their document, each once."""
    near = hits.select("doc_id", F.explode(F.sequence(F.col("line_no") - reach, F.col("line_no") + reach)).alias("line_no")).distinct()
    return lines.join(near, ["doc_id", "line_no"], "left_semi")


def page_chunks(lines: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of ``size`` pages, each ``overlap`` pages into the one before: lines, words, fields (bold lines), line range and text."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    pages = lines.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("w"), F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.count_if("bold").alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    low = F.greatest(F.lit(0), F.floor((F.col("page") - size) / step) + 1)
    spread = pages.withColumn("chunk", F.explode(F.sequence(low, F.floor(F.col("page") / step))))
    return spread.groupBy("doc_id", "chunk").agg(F.sum("n").alias("lines"), F.sum("w").alias("words"), F.min("a").alias("first_line"), F.max("b").alias("last_line"), F.sum("f").alias("fields"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n").alias("text"))


def window_chunks(widgets: DataFrame, reach: int = 10, limit: int = 400) -> DataFrame:
    """(doc_id, chunk, first_line, last_line, widgets): widgets with their surrounding lines, packed while lines fit the limit.

    A document's widgets are packed in order; what counts is the number of different lines covered, not the span. One whose own
    lines exceed the limit makes a chunk of its own.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out, doc = [], rows.doc_id.iloc[0]
        low = high = count = covered = None
        for line in sorted(rows.line_no):
            a, b = max(0, line - reach), line + reach
            fresh = b - max(a, high + 1) + 1 if low is not None else 0
            if low is not None and covered + fresh <= limit:
                high, count, covered = max(high, b), count + 1, covered + fresh
            else:
                if low is not None:
                    out.append((doc, len(out), low, high, count))
                low, high, count, covered = a, b, 1, b - a + 1
        out.append((doc, len(out), low, high, count))
        return pd.DataFrame(out, columns=["doc_id", "chunk", "first_line", "last_line", "widgets"])

    return widgets.select("doc_id", "line_no").groupBy("doc_id").applyInPandas(pack, "doc_id long, chunk int, first_line int, last_line int, widgets int")


def section_tree(sections: DataFrame, nameless: str = "Section") -> DataFrame:
    """(h1, h2): for each h1 its sorted sections (name, h3), each with its sorted h3 headings, of (h1, h2, h3) rows; h3 may be null."""
    inner = sections.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("h3")).alias("h3"))
    named = F.struct(F.coalesce("h2", F.lit(nameless)).alias("name"), "h3")
    return inner.groupBy("h1").agg(F.array_sort(F.collect_list(named)).alias("h2"))


def label_proximity(texts: DataFrame, widgets: DataFrame, height: float = 15.0, gap: float = 200.0) -> DataFrame:
    """(page key, widget_id, text_id): labels whose top is near and whose right end lies at most ``gap`` left of the widget.

    Tops are bucketed by ``height``, so that the range join is an equi-join on neighbouring buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / height)
    left = texts.withColumn("b", F.explode(F.array(bucket("top") - 1, bucket("top"), bucket("top") + 1))).select(*PAGE, "b", "text_id", F.col("top").alias("t_top"), F.col("left").alias("t_left"), F.col("right").alias("t_right"))
    right = widgets.withColumn("b", bucket("top")).select(*PAGE, "b", "widget_id", "top", "left")
    near = (F.abs(F.col("top") - F.col("t_top")) < height) & (F.col("left") >= F.col("t_left")) & (F.col("left") - F.col("t_right") < gap)
    return right.join(left, [*PAGE, "b"]).filter(near).select(*PAGE, "widget_id", "text_id")


def nearest_line(widgets: DataFrame, lines: DataFrame, most: float = 10.0) -> DataFrame:
    """(page key, widget_id, line_no, is_new): the line of a page whose bottom is closest to the widget's, within ``most``.

    A widget without one gets a new line, numbered after the document's last in the order of page, bottom and id.
    """
    near = widgets.join(lines.select(*PAGE, "line_no", F.col("bottom").alias("line_bottom")), list(PAGE))
    dist = F.abs(F.col("bottom") - F.col("line_bottom"))
    best = near.filter(dist <= most).groupBy(*PAGE, "widget_id").agg(F.min(F.struct(dist.alias("d"), "line_no")).alias("m"))
    rows = widgets.join(best, [*PAGE, "widget_id"], "left").join(lines.groupBy("doc_id").agg(F.max("line_no").alias("last")), "doc_id", "left")
    fresh = F.col("m.line_no").isNull()
    order = Window.partitionBy("doc_id", fresh).orderBy("page", "bottom", "widget_id")
    number = F.when(fresh, F.coalesce("last", F.lit(-1)) + F.row_number().over(order)).otherwise(F.col("m.line_no"))
    return rows.select(*PAGE, "widget_id", number.cast("int").alias("line_no"), fresh.alias("is_new"))


def outline_match(lines: DataFrame, outline: DataFrame, longest: int = 10, short_lines: bool = False) -> DataFrame:
    """(doc_id, line_no, title_id, heading, kind): lines equal to a title, without case, or containing or contained in one of more than ``longest`` characters.

    With ``short_lines`` a line that a title contains may be of any length, as in the reference; without, it has more than ``longest`` characters too.

    outline: title_id, title and, if known, level; the heading is the level of the matched title, h3 for deeper ones and h1 for a level
    below 1, null without a level.

    Exact titles are an equi-join. A line that contains a title holds the title's inner words, those between its first and last space, next to
    each other: up to three of them are the key of a further equi-join, so a line has as many keys as words. Only titles without inner words
    are sought by their first ``longest`` + 1 characters at each place of the lines. A title that contains a line holds the line's first
    characters, at any of its own places. A short line is one of the title's pieces as a whole, so it is sought among all different pieces, each
    with its first title, and makes no pairs. The first title wins.
    """
    named = lines.select("doc_id", "line_no", F.lower(F.trim("text")).alias("line")).filter("line <> ''")
    level = F.col("level").cast("int") if "level" in outline.columns else F.lit(None).cast("int")
    entry = F.struct("title_id", F.when(level.isNotNull(), F.least(F.lit(3), F.greatest(F.lit(1), level))).alias("level")).alias("entry")
    titles = outline.select(entry, F.lower(F.trim("title")).alias("title")).filter("title <> ''")
    first = F.min("entry").alias("entry")
    exact = named.join(titles, named.line == titles.title).groupBy("doc_id", "line_no").agg(first).withColumn("kind", F.lit("exact"))
    unequal = named.join(exact, ["doc_id", "line_no"], "left_anti")
    rest = unequal.filter(F.length("line") > longest)
    n, long_titles = longest + 1, titles.filter(F.length("title") > longest)
    head = lambda c: F.substring(c, 1, n).alias("part")
    # All overlapping pieces in one walk over the text.
    parts = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))).alias("part")
    inner = F.greatest(F.size(F.split("title", " ")) - 2, F.lit(0))
    keyed = long_titles.withColumn("inner", F.least(inner, F.lit(3)))
    inside = rest.limit(0).crossJoin(long_titles)
    for count in sorted(r.inner for r in keyed.select("inner").distinct().collect()):  # at most four
        some = keyed.filter(F.col("inner") == count).drop("inner")
        if count:
            words = F.split("line", " ")
            # The words are bound once by the outer function; named within the inner one, the line would be split again for each run.
            joined = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - count + 1), lambda i: F.array_join(F.slice(w, i, F.lit(count)), " "))
            runs = F.transform(F.array(words), joined)[0]
            lines_by = rest.filter(F.size(words) >= count).select("*", F.explode(F.array_distinct(runs)).alias("part"))
            hits = lines_by.join(some.withColumn("part", F.array_join(F.slice(F.split("title", " "), 2, count), " ")), "part")
        else:
            hits = rest.select("*", parts("line")).join(some.select("*", head("title")), "part")
        inside = inside.unionByName(hits.drop("part"))
    inside = inside.filter(F.col("line").contains(F.col("title")))
    around = rest.select("*", head("line")).join(long_titles.select("*", parts("title")), "part").filter(F.col("title").contains(F.col("line"))).drop("part")
    held = inside.unionByName(around).select("doc_id", "line_no", "entry")
    if short_lines and longest > 0:
        # One walk by whole characters; what begins at a place are the heads of the piece found there.
        at = F.array_distinct(F.regexp_extract_all("title", F.lit(f"(?s)(?=(.{{1,{longest}}}))."), F.lit(1)))
        pieces = long_titles.select("entry", F.explode(at).alias("part"))
        heads = F.transform(F.sequence(F.lit(1), F.length("part")), lambda k: F.left(F.col("part"), k))
        pieces = pieces.select("entry", F.explode(heads).alias("line")).groupBy("line").agg(first)
        held = held.unionByName(unequal.filter(F.length("line") <= longest).join(pieces, "line").select("doc_id", "line_no", "entry"))
    found = held.groupBy("doc_id", "line_no").agg(first)
    both = exact.unionByName(found.withColumn("kind", F.lit("partial")))
    return both.select("doc_id", "line_no", "entry.title_id", F.concat(F.lit("h"), "entry.level").alias("heading"), "kind")


def doc_fingerprint(lines: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): sha256 over page and line counts, sizes by third, boxes of pages, and lines of five pages.

    Boxes are each page's number of lines and their least and largest top. The first, middle and last lines are taken from the
    first and last pages and the quartiles between, the text length from the first two pages and from all.
    """
    # Only normalised texts count, so copies in another case or spacing agree.
    body = lines.withColumn("line", normalised(F.col("text")))
    n = F.count(F.lit(1))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    pages = body.groupBy(*PAGE).agg(n.alias("n"), F.sum(F.length("line")).alias("chars"), F.min("top").alias("low"), F.max("top").alias("high"), ordered.alias("o"), *[F.count_if(F.col("zone") == z).alias(z) for z in ("top", "middle", "bottom")])
    at = lambda i: F.get("o", i)["line"]
    pages = pages.withColumns({"box": F.concat_ws(",", "n", "low", "high"), "marks": F.concat_ws("~", at(F.lit(0)), at(F.floor(F.col("n") / 2).cast("int")), at(F.col("n").cast("int") - 1))}).drop("o")
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    pages = pages.join(last, "doc_id")
    quarter = F.col("page").isin(0) | (F.col("page") == F.col("last_page")) | F.exists(F.array(*map(F.lit, (1, 2, 3))), lambda q: F.col("page") == F.floor(F.col("last_page") * q / 4))
    texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), "|")
    total = [F.sum(c).alias(c) for c in ("n", "chars", "top", "middle", "bottom")]
    stats = pages.groupBy("doc_id").agg(F.max("last_page").alias("last"), *total, F.coalesce(F.sum(F.when(F.col("page") < 2, F.col("chars"))), F.lit(0)).alias("early"), texts(F.struct("page", F.col("box").alias("s"))).alias("boxes"), texts(F.when(quarter, F.struct("page", F.col("marks").alias("s")))).alias("marks"))
    parts = ("last", "n", "chars", "top", "middle", "bottom", "early", "boxes", "marks")
    return stats.select("doc_id", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256).alias("fingerprint"))


def box_overlap(words: DataFrame, spans: DataFrame) -> DataFrame:
    """(page key, word_id, span_id): the first span that a word's box overlaps and whose text contains or is contained in it."""
    pair = words.join(spans.select(*PAGE, "span_id", F.col("x").alias("sx"), F.col("x2").alias("sx2"), F.col("y").alias("sy"), F.col("y2").alias("sy2"), F.col("text").alias("span")), list(PAGE))
    wide = F.least("x2", "sx2") - F.greatest("x", "sx") > 0
    high = F.least("y2", "sy2") - F.greatest("y", "sy") > 0
    same = F.col("span").contains(F.col("text")) | F.col("text").contains(F.col("span"))
    return pair.filter(wide & high & same).groupBy(*PAGE, "word_id").agg(F.min("span_id").alias("span_id"))


def underlined(lines: DataFrame, strokes: DataFrame, reach: float = 5.0, drop: float = 10.0) -> DataFrame:
    """Lines whose bottom lies within a horizontal stroke's band and whose box the widened stroke meets."""
    flat = strokes.filter((F.abs(F.col("y2") - F.col("y1")) < 2) & (F.abs(F.col("x2") - F.col("x1")) > 20)).select(*PAGE, "y1", "x1", "x2")
    hit = (F.col("y1") - F.col("bottom") >= -reach) & (F.col("y1") - F.col("bottom") <= drop) & (F.col("left") <= F.col("x2") + reach) & (F.col("right") >= F.col("x1") - reach)
    a, b = lines.alias("a"), flat.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & hit
    return a.join(b, on, "left_semi")


def option_groups(groups: DataFrame) -> DataFrame:
    """(group, field_id, export_value) of each option; a missing export value is empty."""
    return groups.select("group_key", "export_values", F.posexplode("field_ids").alias("pos", "field_id")).select("group_key", "field_id", F.coalesce(F.get("export_values", F.col("pos")), F.lit("")).alias("export_value"))


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """For each field the value of the latest chunk, and the first non-null class by chunk."""
    return chunks.groupBy("doc_id", "field_id").agg(F.max_by("value", "chunk").alias("value"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("chunk"))).alias("label"))


def key_batches(keys: DataFrame, key: str, by: str, size: int) -> DataFrame:
    """Batches of ``size`` keys in order, within each group of ``by``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1
    return keys.withColumn("batch", F.floor(rank / max(1, size)))



def widget_names(widgets: DataFrame, fields: DataFrame, keys: DataFrame, near: float = 2.0, least: float = 0.7) -> DataFrame:
    """The name of each widget: its field's key if sure enough, else unmapped_<field>; without a field unmapped_unknown.

    A field matches if all four edges differ by less than ``near``; the smallest field id wins. The left edge is bucketed by
    ``near``, so that the match is an equi-join on neighbouring buckets.
    """
    edges = ("x", "y", "x2", "y2")
    bucket = F.floor(F.col("x") / near)
    spread = fields.withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).select(*PAGE, "b", "field_id", *[F.col(e).alias(f"f_{e}") for e in edges])
    close = F.lit(True)
    for e in edges:
        close = close & (F.abs(F.col(e) - F.col(f"f_{e}")) < near)
    found = widgets.withColumn("b", bucket).join(spread, [*PAGE, "b"]).filter(close).groupBy(*PAGE, "widget_id").agg(F.min("field_id").alias("field_id"))
    rows = widgets.select(*PAGE, "widget_id").join(found, [*PAGE, "widget_id"], "left").join(keys, ["doc_id", "field_id"], "left")
    sure = F.when(F.col("conf") >= least, F.col("key"))
    return rows.select(*PAGE, "widget_id", F.coalesce(sure, F.concat(F.lit("unmapped_"), F.col("field_id").cast("string")), F.lit("unmapped_unknown")).alias("name"))


def cell_locate(widgets: DataFrame, cells: DataFrame, table_box: tuple[float, float, float, float] | None = None, shape: tuple[int, int] = (1, 1)) -> DataFrame:
    """(page key, widget_id, row, col): the cell that holds the widget's centre, else the cell with the nearest centre.

    On a page without cells the place follows from the centre's share of the table's box (left, top, right, bottom), which is cut into
    ``shape`` rows and columns; centres beyond it belong to its edge. Without a box such widgets get nulls.
    """
    cx, cy = (F.col("x") + F.col("x2")) / 2, (F.col("y") + F.col("y2")) / 2
    own = widgets.select(*PAGE, "widget_id", cx.alias("cx"), cy.alias("cy"))
    pair = own.join(cells, list(PAGE), "left")
    inside = (F.col("cx") >= F.col("x")) & (F.col("cx") <= F.col("x2")) & (F.col("cy") >= F.col("y")) & (F.col("cy") <= F.col("y2"))
    gap = (F.col("cx") - (F.col("x") + F.col("x2")) / 2) ** 2 + (F.col("cy") - (F.col("y") + F.col("y2")) / 2) ** 2
    best = F.min(F.struct(F.when(inside, 0.0).otherwise(1.0).alias("out"), F.when(inside, 0.0).otherwise(gap).alias("gap"), "row", "col")).alias("m")
    rows = pair.groupBy(*PAGE, "widget_id", "cx", "cy").agg(best)
    spread = [F.lit(None).cast("long")] * 2
    if table_box:
        left, top, right, bottom = table_box
        share = lambda c, a, b, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - a) / (b - a) * n))).cast("long")
        spread = [share("cy", top, bottom, shape[0]), share("cx", left, right, shape[1])]
    return rows.select(*PAGE, "widget_id", F.coalesce("m.row", spread[0]).alias("row"), F.coalesce("m.col", spread[1]).alias("col"))


def line_rebuild(words: DataFrame, margin: int = 70, pitch: int = 7) -> DataFrame:
    """(doc_id, line_no, line): words from left to right, one space for each ``pitch`` of gap, from a left margin; runs of _ or . are blank."""
    order = Window.partitionBy("doc_id", "line_no").orderBy("x", "word_no")
    before = F.coalesce(F.lag("x2").over(order), F.lit(margin))
    spaces = F.greatest(F.floor((F.col("x") - before) / pitch), F.lit(0)).cast("int")
    shown = F.regexp_replace("word", r"[_.]{3,}", " ")
    rows = words.withColumn("piece", F.concat(F.repeat(F.lit(" "), spaces), shown))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "word_no", "piece"))), lambda w: w["piece"])
    return rows.groupBy("doc_id", "line_no").agg(F.array_join(ordered, "").alias("line"))


def form_fingerprint(lines: DataFrame, widgets: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """(doc_id, fingerprint, widgets, kinds, page_kinds, boxes, thirds): the fingerprint of the text and of the widgets' layout.

    widgets: doc_id, page, kind, left, top, width, height. kinds and page_kinds count widgets by kind; boxes holds for each page a hash of
    its boxes in thousandths of the page, whatever their order; thirds counts their centres. A null kind is UNKNOWN, a null number -1.
    Documents without widgets have empty parts; widgets of documents without lines don't count.
    """
    share = lambda c, whole: F.coalesce(F.floor(c / whole * 1000 + 0.5), F.lit(-1))
    top, left = F.col("top"), F.col("left")
    box = F.struct(share(top, page_height).alias("y"), share(left, page_width).alias("x"), share(top + F.col("height"), page_height).alias("y2"), share(left + F.col("width"), page_width).alias("x2"))
    spot = third((top + F.col("height") / 2) / page_height)
    # One shuffle by document serves all three groupings; a document's widgets are bounded by its pages.
    rows = widgets.select(*PAGE, F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"), box.alias("box"), spot.alias("spot")).repartition("doc_id")
    joined = lambda listed, f, mark: F.array_join(F.transform(F.array_sort(listed), f), mark)
    count = F.count(F.lit(1)).alias("n")
    by_kind = rows.groupBy(*PAGE, "kind").agg(count, F.collect_list("box").alias("boxes"), *[F.count_if(F.col("spot") == t).alias(t) for t in ("top", "middle", "bottom")])
    kinds = joined(F.collect_list(F.struct("kind", "n")), lambda k: F.concat(k["kind"], F.lit("="), k["n"]), ",")
    shown = joined(F.flatten(F.collect_list("boxes")), lambda b: F.concat_ws(",", b["y"], b["x"], b["y2"], b["x2"]), ";")
    pages = by_kind.groupBy(*PAGE).agg(kinds.alias("kinds"), F.sha2(shown, 256).alias("hash"), F.concat_ws("/", *[F.sum(t).cast("string") for t in ("top", "middle", "bottom")]).alias("thirds"))
    told = lambda c: joined(F.collect_list(F.struct("page", c)), lambda p: F.concat(p["page"].cast("string"), F.lit(":"), p[c]), "|")
    totals = by_kind.groupBy("doc_id", "kind").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("widgets"), kinds.alias("kinds"))
    parts = pages.groupBy("doc_id").agg(told("kinds").alias("page_kinds"), told("hash").alias("boxes"), told("thirds").alias("thirds")).join(totals, "doc_id")
    both = doc_fingerprint(lines).join(parts, "doc_id", "left").fillna(0, ["widgets"]).fillna("", ["kinds", "page_kinds", "boxes", "thirds"])
    size = F.lit(f"{int(page_width * 10 + 0.5)}x{int(page_height * 10 + 0.5)}")
    names = ("widgets", "kinds", "page_kinds", "boxes", "thirds")
    return both.select("doc_id", F.sha2(F.concat_ws("#", "fingerprint", size, *[F.col(c).cast("string") for c in names]), 256).alias("fingerprint"), *names)


#: The heading level that a numbering pattern suggests, and what it adds to the confidence, in hundredths.
NUMBERED = (("h1", 40, ("decimal_1", "named")), ("h2", 35, ("decimal_2", "letter_dot", "roman")), ("h3", 30, ("decimal_3", "letter_paren")))


def heading_context(lines: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """(.., refined, confidence, hints): base levels moved by numbering, place, capitals, isolation, length, underline and boldness.

    lines: level, text, top, left, right, size, average (the page's mean size), bold, underlined, is_isolated; null flags are false.
    The moves are made in this order, each seeing what earlier ones decided; hints name what was seen and which moves were made.
    Lines of fewer than three characters are normal.
    """
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("bold", "underlined", "is_isolated")}
    text, n = F.trim(F.coalesce("text", F.lit(""))), F.col("_n")
    rows = position_features(lines.withColumns(flags), page_width, page_height)
    rows = rows.withColumns({"_p": numbering(text), "_c": capitals(text), "_n": F.length(text), "refined": F.col("level")})
    bold, underlined, now = F.col("bold"), F.col("underlined"), F.col("refined")
    centred, caps, is_ = F.coalesce("is_centered", F.lit(False)), F.col("_c.all_caps"), lambda *levels: now.isin(*levels)
    suggested = [(F.col("_p").isin(*names), level, None) for level, _, names in NUMBERED]
    moves = [
        suggested,
        [(centred & bold & is_("h3"), "h2", None), (centred & bold & is_("normal"), "h3", None)],
        [(F.col("is_near_top") & bold & F.col("level").isin("h2", "h3"), "h1", None)],
        [(F.col("is_indented") & is_("h1"), "h2", "demoted_indented")],
        [(caps & is_("normal"), "h3", "promoted_all_caps")],
        [(caps & bold & is_("h3"), "h2", "promoted_bold_caps"), (caps & bold & centred & is_("h2"), "h1", "promoted_centered_caps")],
        [(F.col("is_isolated") & bold & is_("normal"), "h3", None)],
        [((n > 200) & is_("h2", "h3") & F.col("_p").isNull() & ~caps & ~centred, "normal", "demoted_long")],
        [(underlined & is_("normal"), "h3", "promoted_underlined")],
        [(underlined & bold & is_("h3"), "h2", "promoted_underlined_bold"), (underlined & centred & is_("h3", "h2"), "h1", "promoted_underlined_centered")],
    ]
    none = F.lit(None).cast("struct<to:string,hint:string>")
    for i, cases in enumerate(moves):
        made = none
        for when, to, hint in reversed(cases):
            made = F.when(when, F.struct(F.lit(to).alias("to"), F.lit(hint).cast("string").alias("hint"))).otherwise(made)
        rows = rows.withColumn(f"_m{i}", made).withColumn("refined", F.coalesce(f"_m{i}.to", "refined"))

    large = F.when(F.col("average") > 0, F.col("size") / F.col("average")).otherwise(1.0) >= 1.3
    numbered = F.coalesce(*[F.when(when, points) for (when, _, _), (_, points, _) in zip(suggested, NUMBERED)], F.lit(0))
    moved = lambda i: F.col(f"_m{i}.hint")
    seen = lambda when, hint: F.when(when, F.lit(hint))
    hints = F.array(
        F.concat(F.lit("numbered_"), "_p"), seen(centred, "centered"), seen(F.col("is_near_top"), "near_top"),
        seen(F.col("is_indented"), "indented"), moved(3), seen(caps, "all_caps"), moved(4), moved(5), seen(F.col("_c.title_case"), "title_case"),
        seen(F.col("is_isolated"), "isolated"), seen(n < 50, "short_text"), seen(n > 200, "long_text"), moved(7),
        seen(bold, "bold"), seen(underlined, "underlined"), moved(8), moved(9), seen(large, "large_font"),
    )
    worth = ((centred, 15), (F.col("is_near_top"), 10), (caps, 15), (F.col("_c.title_case"), 10), (F.col("is_isolated"), 10), (n < 50, 5), (bold, 10), (underlined, 20), (large, 10))
    points = numbered + 50
    for when, more in worth:
        points = points + F.when(when, more).otherwise(0)
    short = n < 3
    result = {
        "confidence": F.when(short, 0.9).otherwise(F.least(F.lit(100), points) / 100.0),
        "hints": F.when(short, "too_short").otherwise(F.array_join(hints, ",")),
        "refined": F.when(short, "normal").otherwise(F.col("refined")),
    }
    return rows.withColumns(result).drop("_p", "_c", "_n", *[f"_m{i}" for i in range(len(moves))])


def field_hierarchy(headers: DataFrame) -> DataFrame:
    """(doc_id, line_no, page, title, h1, h2, section_context, h3, h4) of the headers that name a field (field_id not null).

    headers: doc_id, line_no, page, level, text, section_context, field_id. A field stands under the latest h2 at or before it, with
    that heading's section context, else under the last h2 of its page; title and h1 are the first of its page. An h3 field is its
    own h3; an h4 field has the latest h3 since the h2. Empty texts count as absent.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level, filled = F.col("level"), lambda c: F.when(c != "", c)
    # A structure keeps an h2 whose text or context is null distinct from no h2 at all.
    entry = lambda name: F.when(level == name, F.struct("line_no", "text", "section_context"))
    rows = headers.withColumns({
        "_h2": F.last(entry("h2"), ignorenulls=True).over(upto),
        "_page_h2": F.last(entry("h2"), ignorenulls=True).over(page),
        "title": F.first(entry("title"), ignorenulls=True).over(page)["text"],
        "h1": F.first(entry("h1"), ignorenulls=True).over(page)["text"],
    })
    since = Window.partitionBy("doc_id", "_h2.line_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_h3", F.last(entry("h3"), ignorenulls=True).over(since)["text"]).filter("field_id IS NOT NULL")
    either = lambda name: F.coalesce(filled(F.col(f"_h2.{name}")), F.col(f"_page_h2.{name}")).alias(name)
    h3 = F.when(level == "h3", F.col("text")).when(level == "h4", filled(F.col("_h3")))
    own = [h3.alias("h3"), F.when(level == "h4", F.col("text")).alias("h4")]
    return rows.select("doc_id", "line_no", "page", "field_id", "title", "h1", either("text").alias("h2"), either("section_context"), *own)
