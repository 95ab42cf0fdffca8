import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_optional_operators(tmp_path):
    for name in ("__spark_entry__.py", "tidewater"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['tidewater.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_command_line(capsys):
    from tidewater.cli import main

    assert main(["list"]) == 0 and "bm25_pack" in capsys.readouterr().out
