import json
import shutil

from blockloom import convert as C
from tests.test_parse import CASES, block


def test_convert_and_normalize(spark, tmp_path, capsys):
    (tmp_path / "my-book.txt").write_text("\f".join([block("GREY MOTH") + "\n\n" + block("GREY MOTH"), CASES["place"][0], CASES["no_hp"][0]]))
    p = C.read(spark, str(tmp_path / "my-book.txt"))
    out = tmp_path / "out"
    got = C.convert(spark, p, str(out), C.Options(readable=True, index=True, library=str(tmp_path / "lib.json")))
    assert got == {"adversaries": 2, "environments": 1, "rejected": 1, "complete": 3, "with_issues": 0}
    assert sorted(f.name for f in out.glob("*.md")) == ["Adversaries_Index.md", "Grey_Moth.md", "Grey_Moth_1.md", "Old_Mill.md"]
    assert [x["name"] for x in json.loads((tmp_path / "lib.json").read_text())] == ["GREY MOTH", "GREY MOTH", "OLD MILL"]
    C.convert(spark, p, str(out), C.Options(properties=True))
    assert {"Grey_Moth_2.md", "Grey_Moth_3.md", "Old_Mill_1.md"} <= {f.name for f in out.glob("*.md")}
    page = (out / "Grey_Moth.md").read_text()
    (out / "Grey_Moth.md").write_text(page.replace("\n\n> ", "\n\n\n\n> "))
    log = C.normalize(spark, str(out), backup=True)
    assert log["changed"] >= 1 and log["failed"] == 0 and (out / "Grey_Moth.md").read_text() == page and (out / "Grey_Moth.md.bak").exists()
    C.main(["convert", str(tmp_path / "my-book.txt"), "--list"])
    C.main(["convert", str(out / "Grey_Moth.md"), "--report"])
    said = capsys.readouterr().out
    assert "1. GREY MOTH - Tier 1 Skulk" in said and "not parsed: p3: LOST MOTH" in said and "**Complete:** 1" in said


def test_response_and_sources(spark, tmp_path):
    (tmp_path / "my-book.txt").write_text("\f".join([block("GREY MOTH"), CASES["no_hp"][0]]))
    p = C.read(spark, str(tmp_path / "my-book.txt"))
    C.convert(spark, p, str(tmp_path / "out"), C.Options(readable=True, index=True, response=str(tmp_path / "said.json")))
    said = json.loads((tmp_path / "said.json").read_text())
    assert said["files_written"] == ["Grey_Moth.md", "Adversaries_Index.md"] and said["adversary_count"] == 1 and said["success"]
    assert len(said["unparsed_blocks"]) == 1 and said["validation_warnings"] == []
    assert said["summary"].startswith("1 adversaries converted. 2 files written to ") and said["summary"].endswith("1 of 2 stat blocks could not be parsed.")
    page = tmp_path / "out" / "Grey_Moth.md"
    page.write_text(page.read_text().split("\n---\n")[0] + "\n")
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "zoo-book.txt").write_text("none\fa grey moth.")
    (texts / "hope-and-fear.txt").write_text("x\fy\fThe Grey, Moth")
    log = C.normalize(spark, str(tmp_path / "out"), sources=str(texts))
    assert log["sources_added"] == 1 and "*Source: Hope and Fear, p. 3*" in page.read_text()
    for _ in range(2):  # the second run has an index and no texts
        page.write_text(page.read_text().split("\n---\n")[0] + "\n")
        log = C.normalize(spark, str(tmp_path / "out"), sources=str(texts), index_at=str(tmp_path / "words"))
        assert log["sources_added"] == 1 and "*Source: Hope and Fear, p. 3*" in page.read_text()
        if texts.exists():
            shutil.rmtree(texts)


def test_table(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("name,tier,damage_dice,battle_points\nB <i>,2,1d6,3\nA,,1d4,1\nC,10,1d4,1\n")
    C.main(["table", str(tmp_path / "sheet.csv"), "-o", str(tmp_path / "t.html"), "--sort", "tier", "--descending"])
    page = (tmp_path / "t.html").read_text()
    places = [page.index(x) for x in ("<td>C</td><td>10</td>", "<td>B &lt;i&gt;</td><td>2</td><td>1d6</td></tr>", "<td>A</td><td></td>")]
    assert places == sorted(places)
    assert "Battle" not in page and '<input name="tier">' in page and '<input name="name">' not in page
