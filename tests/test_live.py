"""The stream of messages reads the table whether it is one file or a folder of files."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("files", [1, 3])
def test_messages_in_one_file_or_in_a_folder(spark, tmp_path, files):
    said = [(c, t, "user", f"great trip number {t}, not bad") for c in range(4) for t in range(3)]
    rows = spark.createDataFrame(said, "conv_id long, turn int, role string, text string")
    at = tmp_path / "conversations.parquet"
    rows.repartition(files).write.parquet(str(tmp_path / "parts"))
    parts = sorted((tmp_path / "parts").glob("part-*.parquet"))
    if files == 1:
        parts[0].rename(at)
    else:
        at.mkdir()
        for p in parts:
            p.rename(at / p.name)
    out = entry.queries()["d6_live_sentiment"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(f"{c}-{t}" for c, t, _, _ in said)
