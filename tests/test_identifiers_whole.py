"""Identifiers anywhere in a text are found, by the registered queries too."""

from evidencelake.plans.registry import queries


def test_identifiers_after_the_first_characters(spark, tmp_path):
    pad = "plain words without anything " * 40
    late = {"DOI": "10.5555/late.one", "PMID": "31234567", "PMCID": "PMC7654321", "NCT": "NCT76543210", "ChiCTR": "ChiCTR2000012345", "ORCID": "0000-0001-5109-3700"}
    tail = "doi 10.5555/late.one , PMID: 31234567 , PMC7654321 , NCT76543210 , ChiCTR2000012345 , 0000-0001-5109-3700 "
    spark.createDataFrame([(1, pad + tail + pad), (2, pad), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["m1_extract_identifiers"](spark, str(tmp_path)).collect()
    per = {i: [(r["type"], r["value"]) for r in sorted(got, key=lambda r: r["position"]) if r["doc_id"] == i] for i in (1, 2, 3)}
    assert set(per[1]) - set(late.items()) and set(late.items()) <= set(per[1])
    assert len(per[1]) == len(per[2]) + 6 == len(per[3]) + 6
    flags = queries()["m2_identifier_flags"](spark, str(tmp_path)).collect()
    assert {r["value"] for r in flags if r["doc_id"] == 1} == {"38000001", "31234567"}
