"""The ten corpus operators against brute force on small fixtures with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from formlode.llm import langid, mixing, quality_classifier, toxicity, warc
from formlode.llm.near_dup import near_duplicates
from formlode.llm.packing import pack_sequences
from formlode.llm.quality_rules import quality_rules
from formlode.llm.substring_dedup import substring_dedup
from formlode.llm.topk import exact_top_k
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}é" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[50] = "other"
    out = [base, base, " ".join(near), f"{prose(3, 40)} {passage} {prose(4, 5)}", f"{prose(5, 90)}\n{passage}", None, "", " \n\t ", "word", "word", "a b c", prose(6, 20000), f"{passage} {passage}"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", -1, -2) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, `b` int")


def empty(docs):
    return docs.filter("doc_id < 0")


def removed_by_brute_force(texts, size):
    words = {i: WORD.findall(t or "") for i, t in texts}
    seen = collections.Counter(tuple(w[a : a + size]) for w in words.values() for a in range(len(w) - size + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - size + 1):
            if seen[tuple(w[a : a + size])] > 1:
                gone.update(range(a, a + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("size", [2, 7, 35])
def test_substring_dedup(docs, texts, size):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, window=size).collect()}
    assert got == removed_by_brute_force(texts, size)
    assert substring_dedup(empty(docs)).count() == 0


def test_substring_dedup_keeps_columns_and_rejects_bad_windows(docs):
    out = substring_dedup(docs)
    assert {"lang", "b", "removed_spans"} <= set(out.columns)
    row = out.filter("doc_id = 12").first()
    assert [(s.start, s.end) for s in row.removed_spans] == [(0, 120)]
    with pytest.raises(ValueError):
        substring_dedup(docs, window=1)


def groups_by_brute_force(texts, size):
    sets = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=4).collect()}
    assert got == groups_by_brute_force(texts, 4)
    assert near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_of_chains_and_clouds(spark):
    draw, base = random.Random(9), prose(11, 150).split()
    rows = []
    for i in range(60):
        own = list(base)
        for at in draw.sample(range(150), draw.randrange(0, 14)):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == groups_by_brute_force(rows, 4)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (4, "other words stand in this row")]
    got = sorted(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 3] == [(3, True), (3, True)]
    assert sorted(((r.n_shingles, r.component_id) for r in got if r.doc_id is None), key=str) == [(0, None), (2, 3)]


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_sequences(docs, capacity=256).collect()
    by, places, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        by[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    for i, t in texts:
        ids = np.array(encoder.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at, total = 0, total + len(ids)
        for n, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert n == 0 or r.length == 256
            at += r.length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(places) <= -(-total // 256) + 1
    assert pack_sequences(empty(docs)).count() == 0


def test_top_k(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 4) / 4]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 0.0, 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [1e13, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(df.filter("vec_id <> 206"), F.col("vec_id") % 10 == 0, k=5).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows[:120]}
    for q in range(0, 120, 10):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q))[:5]
        assert [got[q, n] for n in range(1, 6)] == [(i, -s) for s, i in best]
    assert not {q for q, _ in got} - set(range(0, 120, 10))
    assert exact_top_k(df.filter("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_quality_statistics(docs, texts):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in texts:
        w = WORD.findall(t or "")
        windows = [tuple(w[a : a + 3]) for a in range(len(w) - 2)]
        seen, inside = collections.Counter(windows), set()
        for a, x in enumerate(windows):
            if seen[x] > 1:
                inside |= {a, a + 1, a + 2}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules(empty(docs)).count() == 0


def test_quality_rules_reject_outliers_only(spark):
    rows = [(i, prose(i, 100), None if i % 2 else "en", "s") for i in range(200)]
    rows += [(1000 + i, prose(i, 100).replace(" ", "### "), "en", "s") for i in range(5)]
    kept = {r.doc_id for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("kept").collect()}
    assert kept == set(range(200))


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", big + "\r\n\r\nend")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(warc.typed(pages), archive_bytes=300)
    assert index.select("path").distinct().count() > 1
    got = {r.record_id: r for r in warc.read_records(index).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 2) if i in (1, None) else ("response", None))
        assert got[i].payload == (None if i in (1, None) else html or "")
    assert warc.read_records(index.filter("record_id = 7")).count() == 1
    assert warc.read_records(warc.write_archives(warc.typed(pages.filter("page_id < 0")))).count() == 0


def syllables(seed, n, parts):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(n))


TONGUES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "en", "ber", "ung"], "cc": ["eau", "oi", "qu", "ré"]}


@pytest.fixture(scope="module")
def tongues(spark):
    rows = [(n * 1000 + i, syllables(n * 1000 + i, 30, parts), lang) for n, (lang, parts) in enumerate(TONGUES.items()) for i in range(80)]
    return spark.createDataFrame(rows, "id long, text string, lang string")


def test_language_id(spark, tongues):
    filters = langid.learned(tongues.filter("id % 4 <> 0"))
    held = tongues.filter("id % 4 = 0").withColumnRenamed("id", "doc_id")
    right = langid.identified(held, filters).join(held, "doc_id").filter("lang_pred = lang").count()
    assert right == held.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(odd, filters).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in TONGUES
    nothing = langid.learned(tongues.filter("id < 0"))
    assert {r.lang_pred for r in langid.identified(odd, nothing).collect()} == {"und"}


def test_mixing_meets_targets(tongues):
    posterior = mixing.learned(tongues.withColumnRenamed("lang", "domain"))
    docs = tongues.withColumnRenamed("id", "doc_id")
    goal = {"aa": 6000.0, "bb": 600.0, "cc": 0.0}
    out = mixing.mixed(docs, posterior, targets=goal)
    assert np.allclose(out.reached, [6000, 600, 0], rtol=0.02, atol=30)
    assert out.rows.filter("rate < 0").count() == 0
    assert mixing.mixed(docs, posterior, least=1.0).rows.filter("rate < 1").count() == 0
    assert mixing.mixed(docs.filter("doc_id < 0"), posterior).rows.count() == 0


def test_toxicity(spark):
    rows = [(i, prose(i, 60) + (" scoundrel " + prose(i + 1, 20) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = toxicity.learned(df.select("id", "text"), df.filter("id % 3 <> 1"))
    held = df.filter("id % 3 = 1").withColumnRenamed("id", "doc_id")
    got = toxicity.scored(held, model).join(held, "doc_id").collect()
    assert all((r.score >= 0.7) == bool(r.label) for r in got)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    scores = [r.score for r in toxicity.scored(odd, model).collect()]
    assert scores[0] == scores[1] and 0 <= scores[0] <= 1
    assert toxicity.scored(odd, toxicity.learned(df.select("id", "text"), df.filter("label = 1"))).count() == 2


def test_quality_classifier(spark):
    rows = [(i, prose(i, 60).replace(" ", "$$$ ") if i % 5 == 0 else prose(i, 60), int(i % 5 != 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = quality_classifier.learned(df.select("id", "text"), df.filter("id % 2 = 0"))
    held = df.filter("id % 2 = 1").withColumnRenamed("id", "doc_id")
    got = toxicity.scored(held, model).join(held, "doc_id").collect()
    assert all((r.score >= 0.3) == bool(r.label) for r in got)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.scored(odd, model).collect())
