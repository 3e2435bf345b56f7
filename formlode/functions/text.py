"""Column expressions on short texts: normalising, parsing, validating, classifying. ASCII-explicit patterns throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, key prefixes and names that results depend on.
SKIP = ("skip", "n/a", "na", "not applicable", "don't have", "do not have", "none", "-")
EXIT = ("exit", "quit", "stop", "cancel", "bye", "goodbye", "done", "finish")
YES = ("yes", "y", "yeah", "yep", "sure", "ok", "okay", "1", "confirm")
NO = ("no", "n", "nope", "nah", "0", "2")
US = ("united states", "us", "usa", "u.s.a", "u.s.", "united states of america")
INTERNAL = ("telephone_part_", "fax_part_")
US_ONLY = "form_pf"
ADDRESS_GROUPS = (("address_registered.", "registered"), ("address_mailing.", "mailing"), ("address_jurisdiction.", "jurisdiction"), ("wiring_details.wiring_address.", "wiring"), ("wiring_address.", "wiring"))
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
EMAIL_IN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_IN = r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}"
ZIP_IN = r"\b[0-9]{5}\b"


def normalised(x: Column) -> Column:
    """Lower case, single spaces, only ASCII word characters and spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9_ \t\n\r]+", ""), r"[ \t\n\r]+", " "))


def joined(*parts: Column, headers: Column | None = None) -> Column:
    """Non-blank parts and headers, joined by one space."""
    items = F.array(*[F.trim(p) for p in parts])
    if headers is not None:
        items = F.concat(items, F.transform(headers, lambda p: F.trim(p)))
    return F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), " ")


def snake(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), " -", "__")


def intent(x: Column) -> Column:
    word = F.lower(F.trim(x))
    return F.when(word.isin(*SKIP), "skip").when(word.isin(*EXIT), "exit").when(word.isin(*YES), "affirmative").when(word.isin(*NO), "negative").otherwise("other")


def pseudonym(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("string"), 256), 1, 16)


def address_lines(x: Column) -> Column:
    """(line1, line2): the first two comma parts and the rest; a single part stays whole."""
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    return F.struct(F.array_join(F.slice(parts, 1, 2), ", ").alias("line1"), F.when(n > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(n - 2, F.lit(1))), ", ")).otherwise("").alias("line2"))


def phone_parts(x: Column) -> Column:
    """(country, area, number): digit runs; with 11 digits or more the first run is the country code."""
    runs = F.filter(F.split(x, "[^0-9]+"), lambda t: t != "")
    digits = F.length(F.array_join(runs, ""))
    country = F.when(digits >= 11, F.when(F.size(runs) > 1, F.get(runs, F.lit(0))).otherwise(F.substring(F.get(runs, F.lit(0)), 1, 1))).otherwise("")
    flat = F.array_join(runs, "")
    local = F.when(digits >= 11, F.substr(flat, F.length(country) + 1)).otherwise(flat)
    return F.struct(country.alias("country"), F.substring(local, 1, 3).alias("area"), F.substr(local, F.lit(4)).alias("number"))


def numbering(x: Column) -> Column:
    """Numbering pattern of a heading; the order of the rules decides."""
    t = F.trim(x)
    return (
        F.when(t.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+"), "decimal_3").when(t.rlike(r"^[0-9]+\.[0-9]+"), "decimal_2").when(t.rlike(r"^[0-9]+\."), "decimal_1")
        .when(t.rlike(r"^[A-Z]\."), "letter_dot").when(t.rlike(r"^[a-z]\)"), "letter_paren").when(t.rlike(r"^[IVXivx]+\."), "roman")
        .when(F.lower(t).rlike(r"^(chapter|section) [0-9]+"), "named")
    )


def numbering_level(pattern: Column) -> Column:
    return F.when(pattern.isin("decimal_1", "letter_dot", "named"), 1).when(pattern.isin("decimal_2", "letter_paren", "roman"), 2).when(pattern == "decimal_3", 3)


def valid_phone(x: Column) -> Column:
    """With + or 00: 11 digits for country code 1, else 12; without: 11 digits."""
    v = F.trim(x)
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    one = v.rlike(r"^(\+|00)1")
    least = F.when(v.rlike(r"^(\+|00)"), F.when(one, 11).otherwise(12)).otherwise(11)
    return v.rlike(r"^[+0-9][-0-9 ().]*$") & (digits >= least)


def rule_errors(key: Column, value: Column) -> Column:
    """The rules that a (key, value) pair breaks: empty, email, phone, boolean."""
    k, blank = F.lower(key), F.coalesce(value, F.lit("")) == ""
    checks = [
        F.when(blank, "empty"),
        F.when(~blank & k.contains("email") & ~value.rlike(EMAIL), "email"),
        F.when(~blank & k.rlike("phone|telephone|mobile|fax") & ~valid_phone(value), "phone"),
        F.when(~blank & k.contains("_check") & ~F.lower(value).isin("true", "false"), "boolean"),
    ]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def field_label(path: Column, configured: Column) -> Column:
    """The configured label, else the last path segment in words."""
    leaf = F.regexp_replace(F.element_at(F.split(path, r"\."), -1), "(_id|_check)$", "")
    return F.coalesce(configured, F.initcap(F.translate(leaf, "_", " ")))


def address_group(path: Column) -> Column:
    out = None
    for pattern, name in ADDRESS_GROUPS:
        out = F.when(path.contains(pattern), name) if out is None else out.when(path.contains(pattern), name)
    return out


def address_part(path: Column) -> Column:
    leaf = F.element_at(F.split(path, r"\."), -1)
    return F.regexp_replace(F.regexp_replace(leaf, "address_registered_|address_mailing_|address_jurisdiction_|wiring_details_address_|wiring_address_", ""), "_id", "")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with ``x`` evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def capitals(x: Column) -> Column:
    """(caps_ratio, all_caps, title_case) of a line without leading bullets."""

    def parts(t: Column) -> Column:
        left = lambda kept: F.length(F.regexp_replace(t, f"[^{kept}]+", ""))
        first = F.transform(F.split(t, "[ \t]+"), lambda w: F.substring(w, 1, 1))
        words = F.filter(first, lambda c: c.between("A", "Z") | c.between("a", "z"))
        return F.struct(left("A-Za-z").alias("letters"), left("A-Z").alias("upper"), words.alias("words"))

    def rated(p: Column) -> Column:
        share = F.when(p["letters"] == 0, 0.0).otherwise(p["upper"] / p["letters"])
        title = (F.size(p["words"]) > 0) & (F.size(F.filter(p["words"], lambda c: c.between("A", "Z"))) > 0.7 * F.size(p["words"]))
        return F.struct(share.alias("caps_ratio"), (share > 0.9).alias("all_caps"), title.alias("title_case"))

    return bound(bound(F.regexp_replace(x, r"^[-*\u2022 \t]+", ""), parts), rated)


def chosen_options(x: Column, options: int) -> Column:
    """Indexes that an answer like "1, 3" chooses; yes all, no none, null if any part is no number; out of range is ignored."""
    word = F.lower(F.trim(x))
    parts = F.transform(F.split(word, ","), lambda p: F.trim(p))
    numeric = F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    picked = F.filter(F.transform(parts, lambda p: p.try_cast("int")), lambda i: (i >= 1) & (i <= options))
    none = F.array().cast("array<int>")
    return F.when(word.isin("none", "no"), none).when(word.isin("yes", "all"), F.sequence(F.lit(1), F.lit(options))).when(numeric, picked)
