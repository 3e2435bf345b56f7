"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its n-grams; the filters are bit-sliced, so that one slot holds the bits of all
languages and the AND of an n-gram's slots tells every language that has it. Per-language popcounts over a whole text are
corrected for each filter's rate of false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import Grams, Texts, U, mix, slices
from .training import bounded_sample

SIZES = (3, 5)
#: Slots (as a power of two) and hashes of the filters; documents learned from and n-grams kept, of each language.
BITS, HASHES, DOCUMENTS, GRAMS = 20, 2, 1500, 30_000
#: A language has an n-gram if it is at least this often there, against the language where it is most frequent.
LEAST_SHARE = 0.1


def _slots(key: np.ndarray, n: int) -> Iterator[np.ndarray]:
    h = mix(key + U(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for i in range(HASHES):
        yield (h >> U(64 - BITS * (i + 1))).astype(np.int64) & ((1 << BITS) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, times) of the texts of each batch."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, column in slices(batch.column(1)):
            texts = Texts(column, lower=True)
            own = np.array(langs[a:b], object)
            for n in SIZES:
                grams = Grams(texts, n)
                for lang in dict.fromkeys(own):
                    key, times = np.unique(grams.key[(own == lang)[grams.owner]], return_counts=True)
                    made = [pa.array([lang] * len(key), pa.string()), pa.array([n] * len(key), pa.int32()), pa.array(key.view(np.int64)), pa.array(times)]
                    yield pa.RecordBatch.from_arrays(made, ["lang", "n", "gram", "times"])


class Filters:
    """The bit-sliced filters and each language's rate of false positives."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, int]], usual: str | None):
        self.kind, self.wide = next(((k, size) for k, size in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= size), (np.uint64, 64))
        self.langs, self.usual = langs, usual
        # One table for each ``wide`` languages.
        self.tables = [np.zeros(1 << BITS, self.kind) for _ in range(-(-len(langs) // self.wide))]
        grams: dict[tuple[str, int], list[int]] = {}
        for lang, n, gram in rows:
            grams.setdefault((lang, n), []).append(gram)
        place = {lang: i for i, lang in enumerate(langs)}
        for (lang, n), own in grams.items():
            table, bit = divmod(place[lang], self.wide)
            for slot in _slots(np.array(own, np.int64).view(U), n):
                self.tables[table][slot] |= self.kind(1 << bit)
        full = [np.mean((self.tables[i // self.wide] >> self.kind(i % self.wide)) & self.kind(1)) for i in range(len(langs))]
        self.false = np.array(full, np.float64) ** HASHES

    def counts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Corrected count of each language's n-grams, and the number of all n-grams, for each text."""
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for n in SIZES:
            grams = Grams(texts, n)
            slots = list(_slots(grams.key, n))
            masks = [np.bitwise_and.reduce([table[slot] for slot in slots]) for table in self.tables]
            for i in range(len(self.langs)):
                hits[:, i] += grams.sums(((masks[i // self.wide] >> self.kind(i % self.wide)) & self.kind(1)).astype(np.uint8))
            total += grams.count
        return np.maximum(0.0, (hits - self.false * total[:, None]) / np.maximum(1e-9, 1 - self.false)), total


def learned(labelled: DataFrame, documents: int = DOCUMENTS, grams: int = GRAMS) -> Filters:
    """Filters from (id, text, lang) rows with both set: from the rows of at most ``documents`` ids of each language.

    Of each language and size the ``grams`` most frequent n-grams that LEAST_SHARE leaves it are kept. Any number of languages is
    learned; repeated rows count as often as they occur, texts of any length are read whole.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language, as in the model
    chosen = bounded_sample(rows.select("id", "lang"), "lang", documents, sizes)
    # Bounded: at most ``documents`` rows for each language of the model.
    texts = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("lang", "text")
    counts = texts.mapInArrow(_counted, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    share = F.col("times") / F.sum("times").over(Window.partitionBy("lang", "n"))
    rated = counts.withColumn("share", share).withColumn("most", F.max("share").over(Window.partitionBy("n", "gram")))
    kept = rated.filter((F.col("share") >= LEAST_SHARE * F.col("most")) & (F.col("times") > 1))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram"))).filter(F.col("_rank") <= grams)
    found = [(r.lang, r.n, r.gram) for r in ranked.select("lang", "n", "gram").toLocalIterator()]
    usual = min(sizes, key=lambda x: (-sizes[x], x)) if sizes else None
    return Filters(sorted(sizes), found, usual)


def _predict(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, _, column in slices(batch.column(1)):
                counts, _ = filters.counts(Texts(column, lower=True))
                for row in counts:
                    order = np.argsort(-row, kind="stable")
                    best, second = (row[order[0]], row[order[1]] if len(order) > 1 else 0.0) if len(order) else (0.0, 0.0)
                    langs.append(filters.langs[order[0]] if best > 0 else filters.usual)
                    scores.append(float(best / (best + second)) if best > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [batch.schema.names[0], *batch.schema.names[2:], "lang_pred", "score"])

    return run


def identified(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row, from its whole text; und and 0 for a null text or one without a letter.

    Repeated rows have equal results, ties between languages go to the first by name; columns beside the id and the text are
    ignored, and an empty table gives no rows.

    score is the best language's corrected count against the two best. A text with letters but no n-gram of any language, such
    as one shorter than the n-grams, is given the most frequent language with score 0; with no language learned, und.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("text"), body.rlike(r"\p{L}").alias("lettered"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_predict(filters), f"id {kind}, lettered boolean, lang_pred string, score double")
    named = F.col("lettered") & F.col("lang_pred").isNotNull()
    return out.select(F.col("id").alias(id_col), F.when(named, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(named, F.col("score")).otherwise(0.0).alias("score"))
