"""Each repetition feature can reject by itself, and clean documents stay."""

from formlode.llm.quality_rules import quality_rules

from .test_operators import prose


def lined(words):
    return "\n".join(" ".join(words[a : a + 10]) for a in range(0, len(words), 10))


def test_repeated_lines_or_words_alone_are_rejected(spark):
    rows = [(i, lined(prose(i, 100 + i).split())) for i in range(200)]
    own = prose(900, 130).split()
    rows.append((1001, "\n".join(f"{' '.join(own[a : a + 10])}\nshare\nw{a}" for a in range(0, 130, 10))))  # 12 of 39
    once = prose(901, 74).split()
    rows.append((1002, lined([*once, *once[20:44]])))  # 48 of 98 words, no line twice
    rows.append((1003, "\n".join(["share", *[f"{' '.join(own[a : a + 10])}\nshare" for a in range(0, 110, 10)], "share"])))  # 12 of 24
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert all(got[i].kept for i in range(200)) and got[1001].kept
    assert (got[1002].n_dup_lines, got[1002].n_repeat_words, got[1002].n_words) == (0, 48, 98)
    assert (got[1003].n_dup_lines, got[1003].n_lines, got[1003].n_repeat_words) == (12, 24, 0)
    assert not any(got[i].base_failed or got[i].kept for i in (1002, 1003))
