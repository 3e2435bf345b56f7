"""Operators against plain Python on small cases that the test tables do not hold."""

import json

from formlode.functions import json as js
from formlode.functions import text as tx
from formlode.operators import layout as la
from formlode.operators import values as va
from formlode.sources import files
from pyspark.sql import functions as F


def test_window_chunks_count_lines_not_spans(spark):
    lines = [0, 3, 500, 504, 900]
    df = spark.createDataFrame([(1, x) for x in lines], "doc_id long, line_no int")
    for limit in (1, 45, 66, 1000):
        chunks, seen = [], set()
        for x in lines:
            own = set(range(max(0, x - 10), x + 11))
            if chunks and len(seen | own) <= limit:
                seen |= own
                chunks[-1][1:] = [max(seen), chunks[-1][2] + 1]
            else:
                seen = own
                chunks.append([min(own), max(own), 1])
        got = la.window_chunks(df, 10, limit).orderBy("chunk").collect()
        assert [[r.first_line, r.last_line, r.widgets] for r in got] == chunks


def test_json_of_any_depth_goes_flat_and_back(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": "x \"y\""}}}}}, "k": "1"}, "z": "2"}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, "{}"), (3, None), (4, "no json")], "id long, t string")
    flat = js.flatten_json(rows, "id", "t")
    assert {(r.id, r.path, r.value) for r in flat.collect()} == {(1, "a.b.c.d.e.f.g", 'x "y"'), (1, "a.k", "1"), (1, "z", "2")}
    assert json.loads(js.unflatten_json(flat, "id").first().json) == deep
    both = spark.createDataFrame([(1, "a", "leaf"), (1, "a.b", "in")], "id long, path string, value string")
    assert json.loads(js.unflatten_json(both, "id").first().json) == {"a": {"b": "in"}}
    assert js.unflatten_json(both.filter("id > 1"), "id").count() == 0


def test_json_texts_that_look_like_objects_are_leaves(spark):
    given = {"a": "{draft", "c": '{"k":1}', "l": [1, {"x": 2}], "n": None, "t": True, "d": 1.5, "i": 12, "e": {}, "o": {"e": {}, "s": "{}"}}
    rows = spark.createDataFrame([(1, json.dumps(given)), (2, "[1]"), (3, '"{}"'), (4, "{broken")], "id long, t string")
    got = {(r.id, r.path): r.value for r in js.flatten_json(rows, "id", "t").collect()}
    assert got == {
        (1, "a"): "{draft", (1, "c"): '{"k":1}', (1, "l"): '[1,{"x":2}]', (1, "n"): None, (1, "t"): "true", (1, "d"): "1.5", (1, "i"): "12", (1, "o.s"): "{}",
    }
    assert js.flatten_json(rows.limit(0), "id", "t").collect() == []


def test_list_chains_by_kind(spark):
    texts = ["1. a", "2) b", "4. c", "i. d", "ii. e", "iii) f", "iv. g", "xix. h", "a. i", "b. j", "B. k", "- l", "* m", "plain", "- n"]
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], "doc_id long, page int, line_no int, text string")
    got = [(r.kind, r.value, r.chain) for r in la.list_chains(df).orderBy("line_no").collect()]
    assert [k for k, _, _ in got] == ["numeric"] * 3 + ["lower_alpha"] + ["roman"] * 4 + ["lower_alpha"] * 2 + ["upper_alpha"] + ["symbol"] * 3
    assert [v for _, v, _ in got] == [1, 2, 4, 8, 2, 3, 4, 19, 0, 1, 1, None, None, None]
    assert [c for _, _, c in got] == [1, 1, 2, 3, 4, 4, 4, 5, 6, 6, 7, 8, 8, 9]


def test_corpus_files(spark):
    rows = [("a.csv", '\ufeffx,"1, 2"\n\n,\n"a\nb",c\n'), ("b.JSON", '{"é": [1]}'), ("c.json", "{"), ("d.txt", " \n t \t"), ("e.bin", "?"), ("f.json", None), ("g", "x")]
    got = {r.path: (r.text, r.error) for r in files.corpus_text(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["a.csv"] == ("x | 1, 2\n | \na\nb | c", None)
    assert got["b.JSON"][0] == json.dumps({"é": [1]}, indent=2, ensure_ascii=False)
    assert got["c.json"][0] is None and got["c.json"][1].startswith("malformed")
    assert got["d.txt"] == ("t", None) and got["e.bin"] == (None, "unsupported: bin")
    assert got["f.json"][1].startswith("malformed") and got["g"][1] == "unsupported: "


def test_titles_within_lines(spark):
    lines = spark.createDataFrame([(1, 0, "Part one: the annual report of 2023"), (1, 1, "Annual Report"), (1, 2, "the annual"), (1, 3, None), (1, 4, "report of 2023 and more")], "doc_id long, line_no int, text string")
    titles = spark.createDataFrame([(1, "annual report"), (2, "the annual report of 2023"), (3, None), (4, "short")], "title_id long, title string")
    got = {r.line_no: (r.title_id, r.kind) for r in la.outline_match(lines, titles).collect()}
    assert got == {0: (1, "partial"), 1: (1, "exact")}
    for level, heading in ((1, "h1"), (3, "h3"), (7, "h3"), (None, None)):
        found = la.outline_match(lines, titles.withColumn("level", F.lit(level).cast("int"))).collect()
        assert {(r.line_no, r.heading) for r in found} == {(0, heading), (1, heading)}


def test_files_without_a_path_are_errors(spark):
    rows = spark.createDataFrame([(None, "a"), ("b.txt", " b "), ("c", "c")], "path string, content string")
    got = {r.path: (r.text, r.error) for r in files.corpus_text(rows).collect()}
    assert got == {None: (None, "unsupported: "), "b.txt": ("b", None), "c": (None, "unsupported: ")}


def test_first_items_shown(spark):
    rows = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(50)] + [("b", 1, False), (None, 2, True), ("c", 3, None)], "g string, i int, f boolean")
    got = {r.g: (r.shown, r.more) for r in va.shown_first(rows, "g", "i", "f", 3).collect()}
    assert got == {"a": ("0,2,4", 22), "b": ("", 0), None: ("2", 0), "c": ("", 0)}


def test_fingerprints_differ_by_inner_lines(spark):
    base = [(d, i, i // 5, (i % 5) * 10, f"line {i}" if i != 7 or d == 1 else "Line 8") for d in (1, 2) for i in range(20)]
    df = spark.createDataFrame([(*r, "top") for r in base], "doc_id long, line_no int, page int, top int, text string, zone string")
    first, second = (r.fingerprint for r in la.doc_fingerprint(df).orderBy("doc_id").collect())
    assert first != second
    same = la.doc_fingerprint(df.filter("doc_id = 1").withColumn("text", F.upper("text"))).first().fingerprint
    assert same == first


def test_outline_match_as_by_comparing_all(spark):
    titles = ["alpha beta gamma delta epsilon", "one two three four", "left middle right", "two  spaces", "internationalisation", "plain second", "a  b\tc  d e f g", "short", "été nouveau à paris", "\U0001d400\U0001d401 mathematical"]
    lines = [pre + t + post for t in titles for pre in ("", "x", "see ", "see  ") for post in ("", "s", " now", "\u00a0")] + [t[2:14] for t in titles] + [t[:12] for t in titles] + ["", "middle", "nothing like it here"]
    df = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(lines)], "doc_id long, line_no int, text string")
    outline = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "title_id long, title string")
    want = {}
    for i, line in enumerate(lines):
        line = line.strip(" ").lower()
        same = [j for j, t in enumerate(titles) if t == line]
        near = [j for j, t in enumerate(titles) if len(line) > 10 and len(t) > 10 and (t in line or line in t)]
        if line and (same or near):
            want[i] = (min(same or near), "exact" if same else "partial")
    found = la.outline_match(df, outline)
    assert {r.line_no: (r.title_id, r.kind) for r in found.collect()} == want
    words = la.outline_match(df, outline.filter("title_id < 3"))._jdf.queryExecution().optimizedPlan().toString()
    # Titles with inner words ask for no pieces of lines, and pieces of titles come from one walk.
    assert "regexp_extract_all(line" not in words and "regexp_extract_all(title" in words


def _times(query, word):
    return query._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_lines_are_made_once_in_list_chains_and_repeats(spark):
    made = spark.range(3).selectExpr("1L AS doc_id", "0 AS page", "int(id) AS line_no", "0 AS top", "regexp_replace(concat('1. form ', id), 'm', 'n') AS text")
    assert _times(la.list_chains(made), "regexp_replace") == 1
    assert _times(la.repeated_lines(made.withColumn("text", F.lower("text"))), "lower") <= 2  # the text's and the rule's


def test_lines_may_bring_their_normalised_text(spark):
    rows = spark.createDataFrame([(1, i, "Page  No!", 10, 10, "h1") for i in range(3)] + [(1, 3, "2.1 Other", 12, 300, "h1")], "doc_id long, line_no int, text string, size int, top int, level string")
    both = [la.heading_refine(r, la.repeated_lines(r), la.style_votes(r)).select("line_no", "refined", "suggestion", "confidence") for r in (rows, rows.withColumn("line", tx.normalised(F.col("text"))))]
    assert both[0].exceptAll(both[1]).count() == both[1].exceptAll(both[0]).count() == 0
    assert [r.refined for r in both[1].orderBy("line_no").collect()] == ["normal"] * 3 + ["h1"]


def test_capitals_in_other_scripts(spark):
    rows = spark.createDataFrame([("- FORM \u00c9T\u00c9",), ("Every \u042f Word",), ("\u00c9t\u00e9",), ("low And Low",)], "t string")
    got = [r.c for r in rows.select(tx.capitals(F.col("t")).alias("c")).collect()]
    assert [(c.all_caps, c.title_case) for c in got] == [(True, True), (False, True), (False, False), (False, False)]
