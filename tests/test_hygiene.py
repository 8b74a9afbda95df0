"""Rules of the library, checked on its source text."""
import pathlib
import re

PKG = pathlib.Path(__file__).resolve().parent.parent / "tallyspark"
# The document operators have rules of their own (Arrow functions where named).
SOURCES = {p: p.read_text() for p in PKG.rglob("*.py") if "llm" not in p.relative_to(PKG).parts}


def _code(text):
    # Drop comments and docstrings' prose lines well enough for these checks.
    return "\n".join(line.split("#", 1)[0] for line in text.splitlines())


def test_no_local_checkpoint_or_python_udfs():
    for path, text in SOURCES.items():
        code = _code(text)
        assert "localCheckpoint" not in code, path
        assert not re.search(r"\budf\(|pandas_udf|\.rdd\b|mapPartitions", code), path


def test_operators_never_collect():
    for path, text in SOURCES.items():
        if "operators" in path.parts:
            code = _code(text)
            assert not re.search(r"\.(collect|toPandas|toLocalIterator|take|first)\(", code), path


def test_no_broadcast_hints():
    for path, text in SOURCES.items():
        assert "broadcast(" not in _code(text), path


def test_temp_folders_only_in_local_session():
    for path, text in SOURCES.items():
        if "mkdtemp" in _code(text) or "tempfile" in _code(text):
            assert path.name == "session.py", path



def test_the_library_does_not_import_the_document_operators():
    for path, text in SOURCES.items():
        assert not re.search(r"\bllm\b", _code(text)), path
