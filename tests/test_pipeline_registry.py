"""Category tables, saved pipelines in another session, and the model registry."""
import json
import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from quarry.operators import dictionary, features as fx, pipeline, registry, scoring
from quarry.plans import job

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_category_codes_are_dense_and_sorted(spark):
    rows = [(f"v{i * 37 % 2000}", i % 3, None if i % 5 else i % 2 == 0, None) for i in range(6000)]
    df = spark.createDataFrame(rows, "`a[b] c` string, k int, flag boolean, nothing string")
    table = dictionary.category_table(df, df.columns)
    got = {}
    for r in table.collect():
        got.setdefault(r["column_name"], {})[r["value"]] = r["code"]
    want = {"a[b] c": sorted({r[0] for r in rows}), "k": ["0", "1", "2"], "flag": ["false", "true"]}
    assert got == {c: {v: i for i, v in enumerate(vs)} for c, vs in want.items()}
    assert dictionary.sizes(table) == {c: len(v) for c, v in want.items()}
    coded = dictionary.encode(df, table, {"a[b] c": ("a[b] c", "code"), "k": ("k", "k")}, -1)
    assert coded.columns == [*df.columns, "code"] and coded.count() == len(rows)
    assert coded.where(F.col("code") != F.col("k")).count() > 0
    assert dictionary.category_table(df, []).count() == 0 and dictionary.category_table(df.limit(0), ["k"]).count() == 0


FRESH = """
import json, sys
from pyspark.sql import functions as F
from quarry.operators import scoring
from quarry.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=2)
out = scoring.score_saved(spark.read.parquet(sys.argv[1]), sys.argv[2])
print("ROWS" + json.dumps(sorted([r["id"], r["prediction"], r["confidence_score"], r["predicted_label"]] for r in out.collect())))
"""


def test_saved_pipeline_scores_raw_rows_in_another_session(spark, tmpdir_path):
    rows = [(i, None if i % 11 == 0 else float(i % 50), "x" if i % 3 else None, i % 4 == 0, ["low", "mid", "top"][i % 50 // 17])
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, c string, b boolean, y string")
    labels = fx.label_table(df, df, "y")
    pre = fx.Preprocessor.fit(df, ["a"], ["c", "b"])
    data = fx.encode_labels(pre.assemble(df, keep=["y"]), "y", labels, "label")
    model = pipeline.scoring_pipeline(pre.stages(), LogisticRegression().fit(data), "classification", labels)
    model.write().save(f"{tmpdir_path}/model")
    raw = df.drop("y").withColumn("prediction_of", F.lit("kept")).unionByName(
        spark.createDataFrame([(900, None, "never seen", None, "kept")], "id long, a double, c string, b boolean, prediction_of string"))
    raw.write.parquet(f"{tmpdir_path}/raw")
    here = scoring.score_saved(raw, f"{tmpdir_path}/model")
    assert here.columns == [*raw.columns, "prediction", "confidence_score", "predicted_label"]
    want = sorted([r["id"], r["prediction"], r["confidence_score"], r["predicted_label"]] for r in here.collect())
    direct = {r["id"]: r["prediction"] for r in model.transform(raw).collect()}
    assert {w[0]: w[1] for w in want} == direct and {w[3] for w in want} == {"low", "mid", "top"}
    done = subprocess.run([sys.executable, "-c", FRESH, f"{tmpdir_path}/raw", f"{tmpdir_path}/model"], capture_output=True, text=True,
                          env=os.environ | {"PYTHONPATH": ROOT}, cwd=tmpdir_path, timeout=300)
    line = [x for x in done.stdout.splitlines() if x.startswith("ROWS")]
    assert line, done.stderr[-2000:]
    assert json.loads(line[0][4:]) == want
    with pytest.raises(ValueError, match="lacks"):
        scoring.score_saved(raw.drop("a"), f"{tmpdir_path}/model")


def test_registry_versions_are_never_shared(spark, tmpdir_path):
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda i: registry.claim_version(spark, tmpdir_path), range(24)))
    assert sorted(versions) == list(range(1, 25))


def test_registry_keeps_the_last_state(spark, tmpdir_path):
    a = registry.register(spark, tmpdir_path, "first", "p1", "run", "regression", "r2", 0.5)
    b = registry.register(spark, tmpdir_path, "second", "p2", "run", "regression", "r2", 0.7)
    registry.promote(spark, tmpdir_path, a)
    registry.promote(spark, tmpdir_path, b)
    state = {r["version"]: r for r in registry.models(spark, tmpdir_path).collect()}
    assert (state[a]["stage"], state[b]["stage"], state[b]["model_path"]) == ("Archived", "Production", "p2")
    assert scoring.production_model(registry.models(spark, tmpdir_path)).first()["name"] == "second"
    with pytest.raises(KeyError):
        registry.promote(spark, tmpdir_path, 99)


def test_run_saves_registers_and_compares_its_models(spark, tmpdir_path):
    rows = [(float(i % 50) + i / 1000, "x" if i % 3 else "y", ["no", "yes"][i % 50 > 24]) for i in range(240)]
    df = spark.createDataFrame(rows, "a double, c string, y string")
    opts = job.RunOptions(model_list=("logistic_regression",), top_k=1, n_iter=1, cv=2, drift_threshold=10.0)
    res = job.run(spark, df, "y", opts, base_path=tmpdir_path)
    shown = res.frames["predictions"]
    assert shown.columns[:2] == ["row", "actual"] and len(shown.columns) == 2 + len(res.model_paths) and shown.count() == 48
    assert {"logistic_regression_prediction", "tuned_logistic_regression_prediction"} == set(shown.columns[2:])
    right = shown.where(F.col("actual") == F.col("logistic_regression_prediction")).count()
    assert right >= 45 and {r[0] for r in shown.select(shown.columns[2]).distinct().collect()} == {"no", "yes"}
    preview = res.frames["prediction_preview"].collect()
    assert [r["row_id"] for r in preview] == list(range(1, 26))
    current = scoring.production_model(registry.models(spark, f"{tmpdir_path}/models")).first()
    assert current["version"] == res.versions[0] and current["run_id"] == res.run_id
    again = scoring.score_saved(df.drop("y"), current["model_path"])
    assert again.count() == 240 and {"prediction", "predicted_label"} <= set(again.columns)
