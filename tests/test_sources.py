import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.operators import prior, quality
from lagwise.sources import series, store


def test_matrices_and_csv(spark, tmp_path):
    (tmp_path / "machine-1.txt").write_text("1,2\n3, nan\n")
    (tmp_path / "machine-2.txt").write_text("5\n6\n\n")
    rows = {(r["entity"], r["t"]): r["xs"] for r in series.read_matrices(spark, str(tmp_path)).collect()}
    assert rows == {("machine-1", 0): [1.0, 2.0], ("machine-1", 1): [3.0, None], ("machine-2", 0): [5.0], ("machine-2", 1): [6.0]}
    (tmp_path / "c.csv").write_text("timestamp,a,b\n1,2.5,3\n")
    assert series.read_csv(spark, str(tmp_path / "c.csv")).dtypes == [("a", "double"), ("b", "int")]


def test_bundles_and_arrays(spark, tmp_path):
    a = np.arange(6, dtype="f4").reshape(3, 2)
    np.savez(tmp_path / "one.npz", train=a, test=a[:2], label=np.array([0, 1]))
    np.savez(tmp_path / "bad.npz", train=a)
    df = series.read_bundles(spark, str(tmp_path))
    assert {(r["entity"], r["split"], r["t"]): r["xs"] for r in df.where("split = 'label'").collect()} == {("one", "label", 0): [0.0], ("one", "label", 1): [1.0]}
    assert df.count() == 7
    for end, x in (("train", a), ("test", a[:, 0]), ("test_label", np.array([[0], [1], [1]]))):
        np.save(tmp_path / f"MSL_{end}.npy", x)
    counts = {(r["entity"], r["split"]): r["count"] for r in series.read_arrays(spark, str(tmp_path)).groupBy("entity", "split").count().collect()}
    assert counts == {("MSL", "train"): 3, ("MSL", "test"): 3, ("MSL", "label"): 3}
    series.write_series(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("entity = 'one' and split = 'train'").count() == 3


def test_results(spark, tmp_path):
    for name, auc in (("A_seed_seed0", 0.5), ("A_seed_seed1", 0.7), ("B_seed2", 0.9), ("odd", 0.1)):
        (tmp_path / "m" / name).mkdir(parents=True)
        (tmp_path / "m" / name / f"{name}_epoch_metrics.csv").write_text(f"epoch,auc_pr\n1,{auc}\n")
    rows = sorted((r["entity"], r["seed"], r["auc_pr"]) for r in series.read_epoch_metrics(spark, str(tmp_path / "m")).collect())
    assert rows == [("A_seed", 0, 0.5), ("A_seed", 1, 0.7), ("B", 2, 0.9)]
    with pytest.raises(FileNotFoundError):
        series.read_epoch_metrics(spark, str(tmp_path / "m" / "odd"))
    table = spark.createDataFrame([("A", 0, 1.0)], "entity string, seed int, x double")
    series.append_metrics(table, str(tmp_path / "append"))
    series.append_metrics(table, str(tmp_path / "append"))
    assert spark.read.option("header", True).csv(str(tmp_path / "append")).count() == 2
    series.write_summary(table, str(tmp_path / "summary"))
    series.write_run(str(tmp_path / "run"), scaler=table)
    assert spark.read.parquet(str(tmp_path / "run" / "scaler")).count() == 1


def test_event_files(spark, tmp_path):
    truth, found = "0 1 1 0 0 0", "0 0 1 1 0 0"
    for name, digits in (("d_groundtruth", truth), ("d_algo", found)):
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write("\n".join(digits.split()) + "\n")
    ev = series.read_events(spark, str(tmp_path))
    row = quality.batch_affiliation(ev).first()
    assert (row["dataset"], row["algorithm"]) == ("d", "algo")
    assert 0.5 < row["aff_precision"] < 1 and 0.5 < row["aff_recall"] < 1


def test_predictions_at_the_ends(spark):
    """All points predicted, none, one more than the truth has; a dataset without a true event is left out."""
    truth = [0, 0, 1, 1, 0, 0, 0, 1]
    found = {"groundtruth": truth, "all": [1] * 8, "none": [0] * 8, "same": truth, "short": truth[:4]}
    rows = [("d", name, t, y) for name, ys in found.items() for t, y in enumerate(ys)] + [("calm", name, t, 0) for name in ("groundtruth", "all") for t in range(3)]
    df = spark.createDataFrame(rows, "dataset string, algorithm string, t long, y int")
    got = {r["algorithm"]: r for r in quality.batch_affiliation(df, size=3).collect()}
    assert set(got) == {"all", "none", "same", "short"}
    assert (got["same"]["aff_precision"], got["same"]["aff_recall"], got["same"]["aff_f"]) == (1.0, 1.0, 1.0)
    assert got["all"]["aff_recall"] == 1.0 and 0 < got["all"]["aff_precision"] < 1
    assert (got["none"]["aff_precision"], got["none"]["aff_recall"], got["none"]["aff_f"]) == (None, 0.0, None)
    assert got["short"]["aff_precision"] == 1.0 and got["short"]["aff_recall"] == 0.5
    assert quality.batch_affiliation(df.limit(0)).count() == 0


def test_lines_of_files_read_in_ranges(spark, tmp_path):
    """Files of many byte ranges keep their order; blank lines count for none; a file without a line end ends all the same."""
    rng = np.random.default_rng(3)
    want = {}
    for name, end in (("m-1", "\n"), ("m-2", "\r\n"), ("m-3", "\n")):
        a = rng.integers(0, 1000, (int(rng.integers(300, 600)), 3))
        text = end.join(",".join(map(str, r)) + (end if i % 7 == 3 else "") for i, r in enumerate(a.tolist()))
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
        want |= {(name, t): r for t, r in enumerate(a.astype(float).tolist())}
    (tmp_path / "empty.txt").write_text("")
    with gzip.open(tmp_path / "packed.txt.gz", "wt") as f:
        f.write("5\n6\n")
    want |= {("packed.txt", 0): [5.0], ("packed.txt", 1): [6.0]}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        raw = spark.read.text(str(tmp_path / "m-1.txt"))
        assert raw.rdd.getNumPartitions() > 3
        got = series.read_matrices(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(want) and {(r["entity"], r["t"]): r["xs"] for r in got} == want


def test_store_of_priors(spark, tmp_path):
    path, by = str(tmp_path / "priors"), ["entity"]
    rng = np.random.default_rng(5)
    rows = [(e, v, t, int(rng.integers(0, 50))) for e in range(3) for v in range(2) for t in range(40)]
    cells = spark.createDataFrame(rows, "entity long, var int, t long, x long")
    asked = []

    def compute(some):
        asked.append(some)
        bins = prior.digitise(some, by, 3).withColumn("chunk", F.lit(0))
        return prior.build("te", bins, by, 2)

    first = store.reuse(path, cells.where("entity < 2"), by, "tau=2", compute)
    assert {r["entity"]: r["reused"] for r in first.select("entity", "reused").distinct().collect()} == {0: False, 1: False}
    asked.clear()
    both = store.reuse(path, cells, by, "tau=2", compute)
    assert [r["entity"] for r in asked[-1].select("entity").distinct().collect()] == [2]
    assert {r["entity"]: r["reused"] for r in both.select("entity", "reused").distinct().collect()} == {0: True, 1: True, 2: False}
    # no run is added when nothing is missing, and the stored rows are those that computing gives
    runs = sorted(p.name for p in (tmp_path / "priors").iterdir() if p.name.startswith("run="))
    again = store.reuse(path, cells, by, "tau=2", compute)
    assert len(runs) == 2 and sorted(p.name for p in (tmp_path / "priors").iterdir() if p.name.startswith("run=")) == runs
    columns = ["entity", "tau", "src", "tgt", "raw", "weight", "gate"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, compute(cells).select(columns).collect()))
    # what a failed run left is not read; a changed cell or another parameter is computed; a twin counts once
    again.drop("reused").write.parquet(f"{path}/_failed")
    changed = cells.withColumn("x", F.expr("case when entity = 1 and t = 7 and var = 0 then x + 1 else x end"))
    assert {r["entity"]: r["reused"] for r in store.reuse(path, changed, by, "tau=2", compute).select("entity", "reused").distinct().collect()} == {0: True, 1: False, 2: True}
    store.append(again.drop("reused"), path)
    assert store.reuse(path, cells, by, "tau=2", compute).count() == again.count()
    assert store.reuse(path, cells.limit(0), by, "tau=2", compute).count() == 0
