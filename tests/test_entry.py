import importlib.util

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_a_session_and_without_the_folder(tmp_path):
    """In a process of its own, as it is and as a copy without the training operators; a broken module there isn't hidden."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "evidencelake", tmp_path / "evidencelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    names = lambda at: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=at, capture_output=True, text=True, timeout=120)
    whole, rest = names(root), names(tmp_path)
    assert whole.returncode == rest.returncode == 0, (whole.stderr, rest.stderr)
    if entry._have_llm():
        assert int(whole.stdout.split()[0]) - int(rest.stdout.split()[0]) in (13, 14)
    (tmp_path / "evidencelake" / "llm").mkdir()
    (tmp_path / "evidencelake" / "llm" / "__init__.py").write_text("")
    (tmp_path / "evidencelake" / "llm" / "queries.py").write_text("import a_module_that_is_not_there")
    assert "a_module_that_is_not_there" in names(tmp_path).stderr


def test_nothing_else_imports_the_training_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in (root / "evidencelake").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "evidencelake.llm" not in p.read_text()
    assert importlib.util.find_spec("evidencelake.plans.registry")
