"""Quality rules with thresholds from the data. DataFrame functions only.

Fixed cutoffs would treat languages and sources alike. Here each measure's distribution is kept as a mergeable KLL sketch per
(lang, source), built with partial aggregation before the shuffle; the fence is q75 + 3 * (q75 - q50, at least a floor), and
its lower counterpart. Groups with few rows use the sketch merged over their language, and languages with few rows the one
merged over all. Sketches are a few KB; their table has a row per group and is joined to the measures, not to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import SEPARATOR_CHARS, hash_bucket, materialize, words

#: measure: (lower floor of the spread, upper floor of the spread); None: that side isn't fenced.
MEASURES: dict[str, tuple[float | None, float | None]] = {
    "symbol_share": (None, 0.01), "line_repeats": (None, 0.08), "word_repeats": (None, 0.08), "word_length": (0.3, 0.3),
}
MIN_GROUP = 40
SALTS = 16


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: windows sorted by hash, repeats marked, their places sorted, spans joined."""
    n = F.size(w)
    windows = F.transform(
        F.arrays_zip(F.slice(w, 1, F.greatest(n - 2, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(n - 2, F.lit(0))).alias("b"), F.slice(w, 3, F.greatest(n - 2, F.lit(0))).alias("c")),
        lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("at")),
    )
    return windows


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for every row of docs (doc_id, lang, source, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.col("lang"), F.col("source"), text.alias("text"))
    strip = F.translate("text", SEPARATOR_CHARS, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SEPARATOR_CHARS, "") != "")
    d = d.select(
        "doc_id", "lang", "source",
        words(F.col("text")).alias("w"),
        F.length(strip).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    d = d.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(_repeat_words(F.col("w"))).alias("g"))
    d = d.withColumn("m", F.size("g"))
    same_as_next = F.zip_with(F.slice("g", 1, F.greatest(F.col("m") - 1, F.lit(0))), F.slice("g", 2, F.greatest(F.col("m") - 1, F.lit(0))), lambda x, y: F.when(x["h"] == y["h"], F.array(x["at"], y["at"])))
    d = d.withColumn("at", F.array_sort(F.array_distinct(F.flatten(F.filter(same_as_next, lambda x: x.isNotNull())))))
    d = d.withColumn("k", F.size("at"))
    gaps = F.zip_with(F.slice("at", 1, F.greatest(F.col("k") - 1, F.lit(0))), F.slice("at", 2, F.greatest(F.col("k") - 1, F.lit(0))), lambda x, y: F.least(y - x, F.lit(3)))
    covered = F.when(F.col("k") > 0, F.aggregate(gaps, F.lit(3), lambda a, x: a + x)).otherwise(0)
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def _shares(m: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return m.withColumns({
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "line_repeats": F.col("n_dup_lines") / n * 10.0,
        "word_repeats": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    })


def thresholds(m: DataFrame) -> DataFrame:
    """(lang, source, n, {measure}_low, {measure}_high): one row per group."""
    own = m.where("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(k).alias(k) for k in MEASURES))
    lang = own.groupBy("lang").agg(F.sum("n").alias("n_lang"), *(F.kll_merge_agg_double(k).alias(f"{k}_l") for k in MEASURES))
    whole = lang.groupBy(F.lit(1).alias("one")).agg(*(F.kll_merge_agg_double(f"{k}_l").alias(f"{k}_w") for k in MEASURES))
    t = own.join(lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    t = t.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")  # one row
    out = ["lang", "source", "n"]
    for k, (low, high) in MEASURES.items():
        sketch = F.when(F.col("n") >= MIN_GROUP, F.col(k)).when(F.col("n_lang") >= MIN_GROUP, F.col(f"{k}_l")).otherwise(F.col(f"{k}_w"))
        q = lambda p, s=sketch: F.kll_sketch_get_quantile_double(s, F.lit(p))
        if low is not None:
            out.append((q(0.25) - 3 * F.greatest(q(0.5) - q(0.25), F.lit(low))).alias(f"{k}_low"))
        if high is not None:
            out.append((q(0.75) + 3 * F.greatest(q(0.75) - q(0.5), F.lit(high))).alias(f"{k}_high"))
    return t.select(*out)


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of docs.

    Null and empty texts have no words, fail the base rules and are not kept. Null langs and sources are groups of their own.
    Repeated rows come out as often as they came in. An empty table gives an empty result.
    """
    m = materialize(_shares(measures(docs)), "measures")
    salted = thresholds(m).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "salt", *(f"{k}_{side}" for k, v in MEASURES.items() for side, x in zip(("low", "high"), v, strict=True) if x is not None))
    j = m.withColumn("salt", hash_bucket(SALTS, F.col("doc_id"), F.col("word_chars")))
    j = j.join(salted, [j.lang.eqNullSafe(F.col("_l")), j.source.eqNullSafe(F.col("_s")), j.salt == salted.salt], "left")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out_of = [F.col(k) < F.col(f"{k}_low") for k, v in MEASURES.items() if v[0] is not None] + [F.col(k) > F.col(f"{k}_high") for k, v in MEASURES.items() if v[1] is not None]
    strange = F.lit(False)
    for x in out_of:
        strange = strange | F.coalesce(x, F.lit(False))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~strange).alias("kept"))
