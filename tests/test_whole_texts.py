"""f_strings reads whole texts, not their first characters."""

from rillgraph import catalog


def test_f_strings_reads_past_80_characters(spark, tmp_path):
    text = "a" * 100 + " then. last word."
    spark.createDataFrame([(7, text, len(text))], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    row = catalog.queries()["f_strings"](spark, str(tmp_path)).first()
    assert row["has"] and row["arrows"] == "a" * 100 + " ->en. last word."
    assert row["head"] == "a" * 100 + " then" and row["dotted"] == "then"
