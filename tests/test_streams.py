"""Log streams over files, across restarts."""

import os

from maskquery.streaming import logs


def line(a):
    return f"step 1 of 1 - accuracy: {a} - loss: 0.5 - val_accuracy: 0.25 - val_loss: 0.125"


def test_epochs_go_on_after_a_restart(spark, tmp_path):
    src, state = tmp_path / "in", str(tmp_path / "state")
    src.mkdir()

    def add(name, rows):
        spark.createDataFrame(rows, "run string, line_no long, line string").coalesce(1).write.parquet(str(tmp_path / name))
        for f in os.listdir(tmp_path / name):
            if f.endswith(".parquet"):
                os.rename(tmp_path / name / f, src / f)

    def go():
        stream = spark.readStream.schema("run string, line_no long, line string").option("maxFilesPerTrigger", 1).parquet(str(src))
        return sorted((r.run, r.epoch, r.accuracy) for r in logs.training_metrics(stream, state).collect())

    add("a", [("x", 2, line(0.2)), ("x", 1, line(0.1)), ("y", 1, "warming up")])
    assert go() == [("x", 1, 0.1), ("x", 2, 0.2)]
    add("b", [("y", 5, line(0.5)), ("x", 3, line(0.3))])
    assert go() == [("x", 1, 0.1), ("x", 2, 0.2), ("x", 3, 0.3), ("y", 1, 0.5)]
    assert go() == [("x", 1, 0.1), ("x", 2, 0.2), ("x", 3, 0.3), ("y", 1, 0.5)]


def test_log_files_are_read_by_run(spark, tmp_path):
    for run, text in (("r1", "one\n" + line(0.5) + "\n"), ("r2", "gpu_timer.cc:1] Skipping the delay kernel, measurement accuracy will be reduced\n" + line(0.25) + "\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "train.log").write_text(text)
    kept = logs.drain(logs.drop_noise(logs.read_log_stream(spark, str(tmp_path)))).collect()
    assert sorted((r.run, r.line[:3]) for r in kept) == [("r1", "one"), ("r1", "ste"), ("r2", "ste")]
