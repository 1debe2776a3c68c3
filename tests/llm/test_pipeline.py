import corpus_pipeline as pipeline
from common import ODD, components_of, empty, frame
from pyspark.sql import functions as F

from stayframe.session import scratch_path

FOLDER = "/root/testdata/sf0.01"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    for name, stage in pipeline.STAGES:
        place = scratch_path(spark, name)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(place)
        after = spark.read.parquet(place)
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == set(before)
            break
        assert after.columns == docs.columns
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        assert kept.items() <= before.items()
        if name in ("toxicity", "quality"):
            fine = [i for i in before if i in labels and not labels[i]["toxic"] and labels[i]["quality"]]
            assert sum(i in kept for i in fine) > 0.9 * len(fine)
        elif name == "exact_dedup":
            squeeze = lambda t: "".join((t or "").split())
            assert len(kept) == len({squeeze(t) for t in before.values()})
        else:
            label = components_of(sorted(before.items()), 5, 80, 100)
            assert set(kept) == {i for i in before if label[i] == i}
        docs = after


def test_stages_on_odd_rows(spark):
    for rows in (frame(spark), empty(spark)):
        docs = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in pipeline.STAGES:
            found = stage(spark, docs, FOLDER)
            if name != "packing":
                assert found.columns == docs.columns
            assert found.count() <= max(len(ODD), 100) * (docs.count() > 0)


CLASHES = ["_text", "_gone", "quality_score", "toxicity", "row_key", "row_key_", "row_key_gone", "times", "keep_id", "kept", "Score"]
SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"


def stages_of_copies():
    return {n: f for n, f in pipeline.STAGES if n.endswith("dedup")}


def test_clashing_columns_stay_as_they_are(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    for n, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.col("doc_id") * 100 + n)
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[c] == r["doc_id"] * 100 + n for r in rows for n, c in enumerate(CLASHES))


def test_rows_that_share_an_id_are_told_apart(spark):
    near = SENTENCE + " " + SENTENCE.replace("one", "won") + " and the end"
    rows = [
        (1, "a clean text of its own that shares an id with a near copy", "en", "a", 1),
        (1, near + " indeed", "en", "a", 1),
        (2, near, "en", "a", 1),
        (3, "twice the same row", "en", "a", 1),
        (3, "twice the same row", "en", "a", 1),
        (None, "twice the same row", "en", "b", 1),
        (None, "nobody knows this one", None, None, None),
        (4, "another text", "en", "a", 1),
        (5, "another  text", "en", "a", 1),
    ]
    docs = frame(spark, rows)
    stages = stages_of_copies()
    exact = stages["exact_dedup"](spark, docs, FOLDER)
    assert exact.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in exact.collect()), key=str)
    # The longer spelling stays of 4 and 5; of the three equal rows one does.
    want = [rows[0][:2], rows[1][:2], rows[2][:2], rows[6][:2], rows[8][:2]]
    assert [r for r in left if r[1] != "twice the same row"] == sorted(want, key=str)
    assert len(left) == len(want) + 1
    kept = sorted(((r["doc_id"], r["text"]) for r in stages["near_dedup"](spark, docs, FOLDER).collect()), key=str)
    # 2 has its id alone, so it stands before the near copy, whose namesake is left in peace.
    want = [rows[0][:2], rows[2][:2], rows[6][:2], rows[7][:2]]
    assert [r for r in kept if r[1] != "twice the same row"] == sorted(want, key=str)
    assert len(kept) == len(want) + 1
