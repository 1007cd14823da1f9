"""The command line on a small project and a collection."""

from lexforge import __main__ as cli

PAGE = b"<html><head><title>One</title></head><body>hello <a href='gone.htm'>x</a></body></html>"


def test_compile_list_extract(spark, tmp_path, capsys):
    home = tmp_path / "a b"
    (home / "sub").mkdir(parents=True)
    (home / "p.hhp").write_bytes(b"[OPTIONS]\nTitle=P\nCompiled file=out\\p.chm\n[FILES]\nsub\\one.htm\n")
    (home / "sub" / "one.htm").write_bytes(PAGE)
    assert cli.main([str(home / "p.hhp")], spark) == 0
    made = home / "out" / "p.chm"
    said = capsys.readouterr()
    assert "1 files" in said.out and "gone.htm" in said.err and made.read_bytes()[:4] == b"ITSF"
    assert cli.main(["--list", str(made)], spark) == 0 and "/sub/one.htm" in capsys.readouterr().out
    assert cli.main(["-x", str(made), str(tmp_path / "got")], spark) == 0
    assert (tmp_path / "got" / "sub" / "one.htm").read_bytes() == PAGE


def test_what_goes_wrong(spark, tmp_path, capsys):
    assert cli.main([], spark) == 2 and cli.main([str(tmp_path / "none.hhp")], spark) == 1
    (tmp_path / "p.hhp").write_bytes(b"[FILES]\none.htm\n")
    assert cli.main([str(tmp_path / "p.hhp")], spark) == 1 and "one.htm" in capsys.readouterr().err
    (tmp_path / "bad.chm").write_bytes(b"ITSFnothing")
    assert cli.main(["-l", str(tmp_path / "bad.chm")], spark) == 1


def test_members_of_a_collection(spark):
    from lexforge.plans.compile import collection_members

    inside = {"m.hhp": "[MERGE FILES]\nb.chm\na.chm\nc.chm\nd.chm\n", "a.hhp": "", "a.chm": "", "b/b.hhp": "", "c/c.chm": ""}
    files = spark.createDataFrame([("m", k, bytearray(v.encode())) for k, v in inside.items()], "project string, rel string, data binary")
    found = [(r.member, r.path, r.kind) for r in collection_members(files, "m.hhp").orderBy("seq").collect()]
    assert found == [("b", "b/b.hhp", "project"), ("a", "a.hhp", "project"), ("c", "c/c.chm", "archive"), ("d", None, "missing"), ("m", "m.hhp", "master")]
