import json
import subprocess

import pytest

from recordloom import cli
from recordloom.functions.columns import FILE_PREFIXES
from recordloom.operators import migrations
from recordloom.sources import catalog
from tests.test_records import KR, ST


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    op = "<channel><item><target_code>100</target_code><wordInfo><word>말</word></wordInfo><senseInfo><sense_no>001</sense_no></senseInfo></item></channel>"
    for name, data in (("krdict", KR.replace(b"<LexicalEntry/>", b"")), ("stdict", ST), ("opendict", op.encode())):
        (root / name).mkdir()
        (root / name / "001.xml").write_bytes(data)
    run = lambda *w: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", "-C", str(root), *w], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-q", "-m", "corpus")
    (root / "krdict" / "999.xml").write_text("<untracked/>")
    return root


def test_commands(spark, corpus, tmp_path, capsys):
    out = tmp_path / "out"
    base = ["--source", str(corpus), "--output", str(out)]
    assert cli.main(["preflight", *base], spark) == 0 and "status=ready" in capsys.readouterr().out and not out.exists()
    assert cli.main(["inspect", "--source", str(corpus), "--dictionary", "krdict"], spark) == 0
    shown = dict(x.split("=", 1) for x in capsys.readouterr().out.split())
    assert (shown["entries"], shown["volumes"], shown["source"]) == ("2", "1", "krdict/001.xml") and len(shown["record_sha256"]) == 64
    assert cli.main(["build", *base, "--dictionary", "krdict"], spark) == 0
    assert cli.main(["audit", *base, "--dictionary", "krdict"], spark) == 0
    capsys.readouterr()
    failing = {
        "KDEP-E008": ["build", *base, "--dictionary", "krdict"],
        "KDEP-E006": ["build", *base, "--dictionary", "stdict", "--volume", "2"],
        "KDEP-E010": ["audit", *base, "--dictionary", "stdict"],
        "KDEP-E004": ["preflight", "--source", str(corpus), "--output", str(corpus / "x")],
        "KDEP-E001": ["preflight", "--source", str(tmp_path / "none"), "--output", str(out)],
        "KDEP-E003": ["preflight", "--source", str(corpus), "--output", str(corpus / ".." / out / f"{FILE_PREFIXES['krdict']}-001-of-001.epub")],
    }
    for code, words in failing.items():
        assert cli.main(words, spark) == 3 and code in capsys.readouterr().err, code
    with pytest.raises(SystemExit) as usage:
        cli.main(["batch", *base, "--overwrite", "--resume"], spark)
    assert usage.value.code == 2
    assert cli.main(["batch", *base, "--resume", "--jobs", "2"], spark) == 0
    books = json.loads((out / "batch-report.json").read_text())
    assert (books["status"], books["passed"], [b["dictionary"] for b in books["books"]]) == ("passed", 3, ["krdict", "stdict", "opendict"])
    assert cli.main(["batch", *base, "--overwrite", "--checker", "false"], spark) == 3
    books = json.loads((out / "batch-report.json").read_text())
    assert (books["failed"], books["unprocessed"]) == (1, 2)


def test_source_audit(spark, corpus, tmp_path, capsys):
    out = tmp_path / "audit"
    words = ["source-audit", "--source", str(corpus), "--output", str(out)]
    assert cli.main(words, spark) == 0
    value = json.loads((out / "report.json").read_text())
    assert {r["dictionary"]: r["entries"] for r in value["entry_counts"]} == {"krdict": 2, "stdict": 1, "opendict": 1}
    assert len(value["namespaces"]) == 12 and len(value["collisions"]) == 66
    assert {r["dictionary"]: (r["resolved"], r["self_reference"]) for r in value["statuses"]} == {"krdict": (2, 0), "stdict": (0, 1)}
    assert (value["cycles"]["groups"], value["cycles"]["relation_edges"]) == (1, 2)
    assert sum(r.in_cycle for r in spark.read.json(f"file://{out}/relations").collect()) == 2
    written = {x: spark.read.json(f"file://{out}/{x}") for x in ("entities", "cycles", "types")}
    assert written["cycles"].first().relation_edges == 2 and written["types"].count() == value["type_count"]
    assert written["entities"].where("entity_kind = 'entry'").count() == 4
    assert (out / "report.md").read_text().count("\n## ") == 8
    assert cli.main(words, spark) == 3 and "KDEP-E008" in capsys.readouterr().err
    (corpus / "stdict" / "001.xml").write_bytes(ST + b"\n")
    assert cli.main([*words, "--overwrite"], spark) == 3 and "KDEP-E005" in capsys.readouterr().err
    (corpus / "stdict" / "001.xml").write_bytes(ST)
    with pytest.raises(catalog.CatalogError):
        catalog.git_tracked(spark, str(tmp_path), ["krdict"])


def test_migrations(tmp_path):
    root, done = str(tmp_path / "store"), []
    steps = [migrations.Step(k, f"step {k}", f"definition {k}", lambda r, k=k: done.append(k)) for k in (1, 2, 3)]
    assert len(migrations.migrate(root, steps[:2])) == 2 and done == [1, 2]
    assert len(migrations.migrate(root, steps)) == 3 and done == [1, 2, 3]
    assert len(migrations.migrate(root, steps)) == 3 and done == [1, 2, 3]
    with pytest.raises(migrations.MigrationError, match="newer"):
        migrations.migrate(root, steps[:2])
    with pytest.raises(migrations.MigrationError, match="as it was applied"):
        migrations.migrate(root, [migrations.Step(1, "step 1", "other", print), *steps[1:]])
    (tmp_path / "store" / "schema.json").write_text('{"application": "x", "history": []}')
    with pytest.raises(migrations.MigrationError, match="another"):
        migrations.migrate(root, steps)
