from brightmill.streaming.watch import landing, watch


def test_files_are_analysed_once_as_they_land(spark, tmp_path):
    folder, out, mark = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    folder.mkdir()
    (folder / "a.py").write_text("eval('1')\n")
    (folder / "a.txt").write_text("eval('1')\n")
    watch(landing(spark, folder, "p"), out, mark, once=True).awaitTermination()
    (folder / "b.py").write_text("import os\nos.system('x')\n")
    watch(landing(spark, folder, "p"), out, mark, once=True).awaitTermination()
    rows = spark.read.parquet(out).select("path", "detector", "evidence").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.detector, r.evidence) for r in rows) == [("a.py", "dynamic_exec", "eval"), ("a.py", "shell_exec", "eval()"), ("b.py", "shell_exec", "os.system()")]
