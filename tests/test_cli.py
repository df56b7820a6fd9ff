import json

from brightloom import cli


def run(capsys, spark, *argv):
    assert cli.main([str(a) for a in argv], spark) == 0
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("id,name,vec\n1,red part,[1 0]\n2,blue part,[0 1]\n3,red car,[1 1]\n")
    runs = ("--runs", tmp_path / "runs")
    assert run(capsys, spark, *runs, "file-sql", tmp_path / "t.csv", "SELECT id FROM input WHERE id > 2") == [{"id": 3}]
    assert run(capsys, spark, "probe", tmp_path / "t.csv")[0]["format"] == "csv"
    assert run(capsys, spark, "vector-search", tmp_path / "t.csv", "vec", "[0 1]", "--top-k", "1")[0]["row_id"] == 1
    cli.main(["keyword-index", str(tmp_path / "t.csv"), "name", str(tmp_path / "index")], spark)
    assert {r["id"] for r in run(capsys, spark, "keyword-search", tmp_path / "index", "red")} == {1, 3}
    cli.main(["embedding-build", str(tmp_path / "t.csv"), str(tmp_path / "emb"), "--doc-id", "id"], spark)
    assert len(run(capsys, spark, "embedding-query", tmp_path / "emb", "red part", "--top-k", "2")) == 2
    made = run(capsys, spark, *runs, "run-list")
    assert len(made) == 1 and run(capsys, spark, *runs, "run-show", made[0]["id"])[0]["artifacts"][0]["rows"] == 1
