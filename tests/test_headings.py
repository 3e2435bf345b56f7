"""Heading rules, each in a case that it decides, and field hierarchies, against written-out results."""

from formlode.operators import layout as la

WIDE, HIGH = 600.0, 800.0
#: level, text, left, right, top, bold, underlined, isolated, size -> refined, confidence, hints
CASES = [
    ("h1", "ab", 0, 100, 400, False, False, False, 10, "normal", 0.9, "too_short"),
    ("normal", "1. the plan", 0, 100, 400, False, False, False, 10, "h1", 0.95, "numbered_decimal_1,short_text"),
    ("h1", "1.2 the plan", 0, 100, 400, False, False, False, 10, "h2", 0.9, "numbered_decimal_2,short_text"),
    ("h3", "the plan of it", 150, 450, 400, True, False, False, 10, "h2", 0.8, "centered,indented,short_text,bold"),
    ("normal", "the plan of it", 80, 520, 400, True, False, False, 10, "h3", 0.8, "centered,short_text,bold"),
    ("h3", "the plan of it", 0, 100, 100, True, False, False, 10, "h1", 0.75, "near_top,short_text,bold"),
    ("h1", "the plan of it", 100, 200, 400, False, False, False, 10, "h2", 0.55, "indented,demoted_indented,short_text"),
    ("normal", "PLAN", 0, 100, 400, False, False, False, 10, "h3", 0.8, "all_caps,promoted_all_caps,title_case,short_text"),
    ("normal", "PLAN", 0, 100, 400, True, False, False, 10, "h2", 0.9, "all_caps,promoted_all_caps,promoted_bold_caps,title_case,short_text,bold"),
    ("h2", "PLAN", 80, 520, 400, True, False, False, 10, "h1", 1.0, "centered,all_caps,promoted_centered_caps,title_case,short_text,bold"),
    ("normal", "the plan of it", 0, 100, 400, True, False, True, 10, "h3", 0.75, "isolated,short_text,bold"),
    ("h2", "word " * 41 + "end", 0, 600, 400, False, False, False, 10, "normal", 0.5, "long_text,demoted_long"),
    ("h2", "(" + "word " * 41 + "end", 0, 600, 400, False, True, False, 10, "h3", 0.7, "long_text,demoted_long,underlined,promoted_underlined"),
    ("normal", "the plan of it", 0, 100, 400, True, True, False, 10, "h2", 0.85, "short_text,bold,underlined,promoted_underlined,promoted_underlined_bold"),
    ("normal", "the plan of it", 80, 520, 400, False, True, False, 10, "h1", 0.9, "centered,short_text,underlined,promoted_underlined,promoted_underlined_centered"),
    ("normal", "the plan of it", 0, 100, 400, None, None, None, 13, "normal", 0.65, "short_text,large_font"),
    ("normal", None, 0, 100, 400, None, None, None, 13, "normal", 0.9, "too_short"),
]


def test_every_heading_rule(spark):
    rows = [(i, *c[:9], 10.0) for i, c in enumerate(CASES)]
    schema = "i int, level string, text string, left int, right int, top int, bold boolean, underlined boolean, is_isolated boolean, size int, average double"
    got = la.heading_context(spark.createDataFrame(rows, schema), WIDE, HIGH).orderBy("i").collect()
    assert [(r.refined, r.confidence, r.hints) for r in got] == [c[9:] for c in CASES]


def test_field_hierarchy(spark):
    lines = [
        # page, level, text, context, field
        (0, "h4", "before", None, 1), (0, "title", "T", None, None), (0, "title", "later", None, None), (0, "h1", "one", None, None),
        (0, "h2", "two", "part", 2), (0, "h3", "three", None, 3), (0, "h4", "four", None, 4),
        (0, "h2", "next", None, None), (0, "h4", "alone", None, 5), (0, None, "plain", None, 6),
        (1, "h4", "over", None, 7), (1, "h2", "", "end", 8), (2, "h2", "last", "x", None),
    ]
    rows = [(1, i, *line) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, page int, level string, text string, section_context string, field_id int")
    got = {r.field_id: (r.title, r.h1, r.h2, r.section_context, r.h3, r.h4) for r in la.field_hierarchy(df).collect()}
    assert got == {
        1: ("T", "one", "next", None, None, "before"),
        2: ("T", "one", "two", "part", None, None),
        3: ("T", "one", "two", "part", "three", None),
        4: ("T", "one", "two", "part", "three", "four"),
        5: ("T", "one", "next", None, None, "alone"),
        6: ("T", "one", "next", None, None, None),
        7: (None, None, "next", "end", None, "over"),
        8: (None, None, "", "end", None, None),
    }
