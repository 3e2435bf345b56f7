"""Form values: merging, validation, completeness and reports over (user_id, session_id, key, value, ts) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlode.functions.json import flatten_json
from formlode.functions.rounding import half_up, ratio
from formlode.functions.text import US, US_ONLY

#: Where a country of registration may stand, in the order of precedence.
COUNTRY_KEYS = ("address_registered.address_registered_country_id", "address_registered.country", "registered_country", "country_of_registration")


def country_filtered(values: DataFrame) -> DataFrame:
    """Drops keys for US forms in sessions whose registered country is known and not the US."""
    found = [F.max(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("value"))) for k in COUNTRY_KEYS]
    country = values.groupBy("session_id").agg(F.lower(F.trim(F.coalesce(*found))).alias("_country"))
    foreign = F.coalesce(~F.col("_country").isin(*US), F.lit(False))
    return values.join(country, "session_id", "left").filter(~(foreign & F.col("key").startswith(US_ONLY))).drop("_country")


def user_facing(values: DataFrame, prefixes: tuple[str, ...] = ("telephone_part_", "fax_part_")) -> DataFrame:
    """Without keys whose last segment starts with an internal prefix."""
    leaf = F.element_at(F.split("key", r"\."), -1)
    return values.filter(~leaf.rlike("^(" + "|".join(prefixes) + ")"))


def merge_first(profile: DataFrame, session: DataFrame) -> DataFrame:
    """Profile keys win, even with a null value; session keys fill what the profile lacks."""
    a = profile.select("user_id", "key", F.struct("value").alias("p"))
    b = session.select("user_id", "key", F.struct("value").alias("s"))
    return a.join(b, ["user_id", "key"], "full").select("user_id", "key", F.coalesce("p", "s")["value"].alias("value"))


def merge_last(values: DataFrame) -> DataFrame:
    """The latest non-empty value of each user and key."""
    return values.filter(F.coalesce("value", F.lit("")) != "").groupBy("user_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def deep_update(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Flattened nested update: updates win; what they turn into an object or a scalar is dropped from the base.

    A base key is shadowed if an update has it, lies below it, or lies above it; ancestors are compared as equi-joins.
    """

    def ancestors(df: DataFrame, own: str) -> DataFrame:
        parts = F.split("key", r"\.")
        up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
        return df.select("user_id", F.col("key").alias(own), F.explode(up).alias("up"))

    above = base.join(updates.select("user_id", "key"), ["user_id", "key"], "left_anti")
    below = ancestors(updates.select("user_id", "key"), "u").select("user_id", F.col("up").alias("key")).distinct()
    kept = above.join(below, ["user_id", "key"], "left_anti")
    scalars = updates.select("user_id", F.col("key").alias("up"))
    hidden = ancestors(kept, "own").join(scalars, ["user_id", "up"], "left_semi").select("user_id", F.col("own").alias("key")).distinct()
    return kept.join(hidden, ["user_id", "key"], "left_anti").select("user_id", "key", "value").unionByName(updates.select("user_id", "key", "value"))


def group_copy(values: DataFrame, source: str, target: str) -> DataFrame:
    """Fills existing empty keys of the target group from the same key of the source group."""
    twin = values.filter(F.col("key").startswith(source)).select("user_id", F.concat(F.lit(target), F.expr(f"substring(key, {len(source) + 1})")).alias("key"), F.col("value").alias("copy"))
    rows = values.join(twin, ["user_id", "key"], "left")
    return rows.select("user_id", "key", F.coalesce(F.nullif("value", F.lit("")), F.when(F.col("key").startswith(target), F.col("copy")), "value").alias("value"))


def missing_keys(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, key, mandatory, kind, label): wanted keys of each user without a value that is neither null nor empty.

    wanted: a form's keys, with mandatory, type and section. kind is boolean or text; of the keys of a section that a user lacks,
    the first by name bears the section as its label, the others none.
    """
    users = values.select("user_id").distinct()
    filled = values.filter(F.coalesce("value", F.lit("")) != "").select("user_id", "key").distinct()
    kind = F.when(F.col("type").isin("boolean", "checkbox"), "boolean").otherwise("text")
    form = wanted.select("key", "mandatory", kind.alias("kind"), "section")
    lacking = users.crossJoin(F.broadcast(form)).join(filled, ["user_id", "key"], "left_anti")  # wanted is a form's key list
    first = F.row_number().over(Window.partitionBy("user_id", "mandatory", "section").orderBy("key")) == 1
    return lacking.select("user_id", "key", "mandatory", "kind", F.when(first, F.col("section")).alias("label"))


def shown_first(rows: DataFrame, group: str, item: str, flag: str, most: int = 20) -> DataFrame:
    """(group, shown, more): the first flagged items of each group, joined by commas, and how many follow; '' and 0 without any.

    Only the first ``most`` items are gathered: Spark limits each group to them before it shuffles, and counts apart.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(item))
    first = rows.filter(flag).withColumn("_rank", rank).filter(F.col("_rank") <= most).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("shown"))
    totals = rows.groupBy(group).agg(F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("_n"))
    return totals.join(first, totals[group].eqNullSafe(first[group]), "left").select(totals[group], F.coalesce("shown", F.lit("")).alias("shown"), F.greatest(F.lit(0), F.col("_n") - most).cast("int").alias("more"))


def accepted(current: DataFrame, answers: DataFrame, schema: DataFrame, errors) -> DataFrame:
    """Current values updated by known, valid, non-empty answers."""
    good = answers.join(schema.select("key"), "key", "left_semi").filter(F.size(errors(F.col("key"), F.col("value"))) == 0)
    new = good.select("user_id", "key", F.col("value").alias("answer"))
    return current.join(new, ["user_id", "key"], "full").select("user_id", "key", F.coalesce(F.nullif("answer", F.lit("")), "value").alias("value"))


def fill_report(values: DataFrame, schema: DataFrame) -> DataFrame:
    """Per session: filled, mandatory and optional counts, rates to one digit, and sorted missing lists; other keys are ignored."""
    sessions = values.select("user_id", "session_id").distinct()
    filled = values.filter(F.coalesce("value", F.lit("")) != "").select("user_id", "session_id", "key").distinct().withColumn("filled", F.lit(True))
    each = sessions.crossJoin(F.broadcast(schema.select("key", "mandatory"))).join(filled, ["user_id", "session_id", "key"], "left")
    have, must = F.col("filled").isNotNull(), F.col("mandatory")
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(F.floor(100.0 * a / b * 10 + 0.5) / 10.0)
    lost = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(~have & which, F.col("key")))), ",")
    counts = {"total": F.count(F.lit(1)), "filled": F.count_if(have), "mandatory": F.count_if(must), "mandatory_filled": F.count_if(have & must), "optional": F.count_if(~must), "optional_filled": F.count_if(have & ~must)}
    rows = each.groupBy("user_id", "session_id").agg(*[c.alias(n) for n, c in counts.items()], lost(must).alias("missing"), lost(~must).alias("missing_optional"))
    rates = {"fill_rate": ("filled", "total"), "mandatory_rate": ("mandatory_filled", "mandatory"), "optional_rate": ("optional_filled", "optional")}
    return rows.withColumns({n: rate(F.col(a), F.col(b)) for n, (a, b) in rates.items()})


def capped(values: Column, most: int = 20) -> Column:
    """(shown, more) of a sorted list: at most so many values, and how many are left out."""
    return F.struct(F.slice(values, 1, most).alias("shown"), F.greatest(F.lit(0), F.size(values) - most).alias("more"))


def filled_state(kind, value) -> object:
    """Whether a widget shows a value: text unless blank, null, no or false; boxes for yes, true, 1 and on."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(kind == "checkbox", v.isin("yes", "true", "1", "on")).otherwise(~v.isin("", "null", "no", "false"))


def fuzzy_resolve(values: DataFrame, column: str, options: list[str], least: float = 70.0) -> DataFrame:
    """The option a text means: a number picks by position, else the best by 100 * (1 - distance / longer length), from ``least`` on.

    Distinct texts meet a short literal list of options inside one expression; no join is made.
    """
    text = F.lower(F.trim(F.col(column)))
    score = lambda o: F.floor(100.0 * (1 - F.levenshtein(text, F.lower(o)) / F.greatest(F.length(text), F.length(o))) * 100 + 0.5) / 100
    rated = F.array(*[F.struct((-score(F.lit(o))).alias("s"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(options)])
    best = F.array_min(rated)
    number = text.try_cast("int")
    by_number = F.get(F.array(*map(F.lit, options)), number - 1)
    resolved = F.when(number.isNotNull(), F.when(number.between(1, len(options)), by_number)).when(-best["s"] >= least, best["o"])
    return values.withColumns({"resolved": resolved, "score": F.when(number.isNull(), -best["s"])})


def cache_lookup(wanted: DataFrame, registry: DataFrame, files: list[str]) -> DataFrame:
    """(fingerprint, usage_count, last_used, files.., hit): hits bump the use count and the time, misses start at 1.

    Of the files that requests bring the latest that is not null replaces the entry's; what they don't bring stays. Unwanted
    entries stay as they are, and hit is null for them.
    """
    latest = [F.max(F.when(F.col(f).isNotNull(), F.struct("at", f)))[f].alias(f"_{f}") for f in files]
    asked = wanted.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), *latest)
    rows = asked.join(registry, "fingerprint", "full")
    uses = (F.coalesce("usage_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("usage_count")
    kept = [F.coalesce(f"_{f}", f).alias(f) for f in files]
    return rows.select("fingerprint", uses, F.greatest("at", "last_used").alias("last_used"), *kept, F.when(F.col("n").isNotNull(), F.col("usage_count").isNotNull()).alias("hit"))


def llm_usage(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Calls, tokens, fields and cost of each model, and what a call and a field cost in millionths; prices are for a million tokens."""
    rows = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "fields")])
    micros = F.col("tokens_in") * price_in + F.col("tokens_out") * price_out
    tokens = F.col("tokens_in") + F.col("tokens_out")
    each = {"tokens_per_call": ratio(tokens, F.col("calls")), "micros_per_call": ratio(micros, F.col("calls")), "micros_per_field": ratio(micros, F.col("fields"))}
    return rows.withColumns({"cost_usd": half_up(micros / 1000000, 6), **each})


def schema_for_type(types: DataFrame, config: DataFrame, column: str, default: str = "default") -> DataFrame:
    """(entity_type, key): the keys that a JSON configuration has for each type, under dot paths, else those of the default.

    config: one row, an object of objects of any depth.
    """
    rows = config.select(F.lit(1).alias("one"), F.explode(F.from_json(column, "map<string,string>")).alias("entity", "form"))
    keys = flatten_json(rows.select("entity", "form"), "entity", "form").select("entity", F.col("path").alias("key"))
    known = rows.select(F.col("entity").alias("known"))
    named = types.join(F.broadcast(known), F.col("entity_type") == F.col("known"), "left")  # a form's configuration
    return named.select("entity_type", F.coalesce("known", F.lit(default)).alias("entity")).join(F.broadcast(keys), "entity").select("entity_type", "key")


def field_labels(values: DataFrame, labels: DataFrame, label) -> DataFrame:
    """Distinct keys with their configured or derived labels."""
    return values.select("key").distinct().join(labels, "key", "left").select("key", label(F.col("key"), F.col("label")).alias("label"))
