"""Every operator over nulls, empty and blank texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from loomlog.llm import decontamination, exact_dedup, langid, line_dedup, neardup, packing, pii, secrets, suffix_dedup, toxicity

ROWS = [
    (1, "the same text of a few words\nline two\nline three", "en"),
    (2, "the same text of a few words\nline two\nline three", "en"),
    (2, "the same text of a few words\nline two\nline three", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "  \n ", "fr"),
    (None, "un autre texte sans identifiant", "fr"),
    (6, "x" * 5000 + " tail", "en"),
    (7, "123 456 !!", "fr"),
]
SCHEMA = "doc_id long, text string, lang string, digest string, run int, doc long, key string, size int, kept boolean"


def operators(spark):
    items = spark.createDataFrame([(1, "the same text of a few words"), (2, ""), (3, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (None, 1, 1), (6, None, 0)], "doc_id long, toxic int, quality int")
    return {
        "secrets": secrets.secrets,
        "decontamination": lambda d: decontamination.leaks(d, items),
        "clean": lambda d: decontamination.clean(d, items),
        "suffix_dedup": suffix_dedup.removed,
        "line_dedup": line_dedup.line_dedup,
        "near_duplicates": neardup.near_duplicates,
        "exact_dedup": exact_dedup.exact_dedup,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "personal_data": pii.personal_data,
        "packing": packing.packed,
        "language_id": langid.language_id,
        "accepted": langid.accepted,
    }


NAMES = ["secrets", "decontamination", "clean", "suffix_dedup", "line_dedup", "near_duplicates", "exact_dedup", "toxicity", "personal_data", "packing", "language_id", "accepted"]
SUBSETS = {"decontamination", "clean", "accepted"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame([(*r, "d", 1, 2, "k", 3, True) for r in ROWS], SCHEMA)
    rows = operators(spark)[name](docs).collect()
    if name not in SUBSETS and name != "packing":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    if name == "packing":
        assert sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) == sorted(str(r[0]) for r in ROWS)
    if name == "decontamination":
        assert {r["doc_id"] for r in rows} == {1, 2} and {r["item_id"] for r in rows} == {1}
    if name == "clean":
        assert {r["doc_id"] for r in rows} == {3, 4, 5, 6, 7, None} and rows[0].asDict().keys() == set(docs.columns)
    if name == "accepted":
        assert {3, 4, 5}.isdisjoint(r["doc_id"] for r in rows) and rows[0].asDict().keys() == set(docs.columns)
    if name == "exact_dedup":
        by = {(r["doc_id"], r["text_sha256"]): r for r in rows}
        assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] in (1, 2)} == {(2, 3)} and len(by) == 8
        assert {r["group_size"] for r in rows if r["doc_id"] in (3, 4)} == {2}
    if name == "near_duplicates":
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] in (1, 2, 3, 5)} == {(1, 1, True), (2, 1, False), (3, 3, True), (5, 5, True)}
        assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    if name == "suffix_dedup":
        assert [r["n_removed"] for r in rows if r["doc_id"] == 6][0] > 4800
    if name == "line_dedup":
        assert sorted(r["n_removed"] for r in rows if r["doc_id"] in (1, 2)) == [0, 3, 3]
    if name == "language_id":
        assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 7)} == {"und"}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).collect() == []
