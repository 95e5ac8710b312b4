"""Cases in which an operator once did less than the whole job."""

import collections

from pyspark.sql import Window
from pyspark.sql import functions as F
from test_llm_operators import WORD, documents, odd_rows, shingles

from evidencelake.llm import minhash, mixing, quality_model, toxicity


def classes_at(rows, percent):
    """Smallest id of each row's near-duplicates, by brute force."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_the_pipeline_drops_near_copies_from_080(spark):
    import corpus_pipeline

    base = [f"t{i}" for i in range(102)]  # 98 shingles
    rows = [(10 * g + 1, " ".join(f"{w}g{g}" for w in base)) for g in range(12)]
    rows += [(10 * g + 2, " ".join(f"{w}g{g}" for w in base[:92] + [f"n{i}" for i in range(10)])) for g in range(12)]  # 88 common of 108
    rows += [(10 * g + 3, " ".join(f"{w}g{g}" for w in base[:80] + [f"m{i}" for i in range(22)])) for g in range(12)]  # too far from both
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = classes_at(rows, 80)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {i for i in label if label[i] == i}
    assert len({*label.values()}) == 24
    assert minhash.keep_first(docs, percent=85).count() == 36


def test_the_pipelines_stages_judge_rows_without_id_by_their_text(spark, tmp_path):
    """Each stage on odd rows: what it does with a text doesn't depend on the row's doc_id."""
    import corpus_pipeline

    clean, rude = " ".join(f"b{i}" for i in range(100)), "you stupid damn idiot shut up " * 8
    rows = [*odd_rows(), (None, rude, "en", "a"), (77, rude, "en", "a"), (None, "short text of its own", "en", "b"), (5, "another text under a repeated id", "en", "b")]
    docs = documents(spark, rows)
    labels = [(8, 1, 0), (77, 0, 1), (6, 1, 0), (4, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lab = spark.read.parquet(f"{tmp_path}/labels.parquet")
    key = lambda d: collections.Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in d.collect())
    every = key(docs)

    # Per row by score alone: (text -> predicted), from tables whose ids are all different.
    apart = docs.select(F.row_number().over(Window.orderBy("doc_id", "text")).alias("n"), "text").withColumn("doc_id", 1000 + F.col("n"))
    text = {r["doc_id"]: r["text"] for r in apart.collect()}
    known = toxicity.known_labels(lab)
    mined = toxicity.mine(docs, known)
    coefficients = toxicity.train(toxicity.count_hits(docs, mined), known)
    bad = {text[r["doc_id"]] for r in toxicity.score(toxicity.count_hits(apart, mined), coefficients).where("predicted = 1").collect()}
    assert rude in bad and clean not in bad
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert got.schema == docs.schema
    assert key(got) == collections.Counter({k: n for k, n in every.items() if k[1] not in bad})
    model = quality_model.train(docs, lab)
    good = {text[r["doc_id"]] for r in quality_model.score(apart, model).where("predicted = 1").collect()}
    assert key(corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path))) == collections.Counter({k: n for k, n in every.items() if k[1] in good})

    got = key(corpus_pipeline.mix_sources(spark, docs, ""))
    again = key(corpus_pipeline.mix_sources(spark, docs.repartition(5), ""))
    assert got == again and any(i is None for i, *_ in got)
    taken = mixing.mix(docs).where("taken > 0").selectExpr("doc_id", "source", "size", "cast(ceil(taken / size) as int) times").collect()
    want, have = collections.Counter(), collections.Counter()
    for r in taken:
        want[r["doc_id"], r["source"], r["size"]] += r["times"]
    for (i, t, _, s), n in got.items():
        have[i, s, len(WORD.findall(t))] += n
    assert have == want
    first = key(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    assert sum(n for (i, *_), n in first.items() if i is None) == sum(n for (i, *_), n in every.items() if i is None)
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), "").count() == 0
