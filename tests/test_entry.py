"""The library without its optional parts, and the stream."""

import json
import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.mark.parametrize("gone", [["corpus_pipeline.py", "graphwright/llm", "tests/llm"], ["graphwright/llm"], ["corpus_pipeline.py"]])
def test_without_optional_parts(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "graphwright"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if os.path.exists(source):
            (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, target)
    for name in gone:
        path = tmp_path / name
        (shutil.rmtree if path.is_dir() else os.remove)(path) if path.exists() else None
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names, sql = map(set, json.loads(out.stdout.splitlines()[-1]))
    own = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= names and own <= sql and not ("graphwright/llm" in gone and names - own)


def test_nothing_else_imports_the_optional_parts():
    for folder, _, files in os.walk(os.path.join(ROOT, "graphwright")):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as text:
                        assert not re.search(r"\bllm\b", text.read()), f


def test_stream(spark, tmp_path):
    from graphwright.plans.shapes import ShapesGraph
    from graphwright.streaming.incremental import validate_stream

    shapes = ShapesGraph.from_text("@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <urn:ex:> . ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:p ; sh:property [ sh:path ex:p ; sh:maxCount 1 ] .")
    source, table, seen = str(tmp_path / "in"), str(tmp_path / "table"), {}
    one = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    one([("<urn:a>", "<urn:ex:p>", "<urn:x>"), ("<urn:b>", "<urn:ex:p>", "<urn:x>")]).coalesce(1).write.parquet(source)

    def sink(found, number):
        seen.setdefault(number, []).extend(r.focus for r in found.collect())

    def run():
        stream = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", 1).parquet(source)
        query = validate_stream(stream, shapes, table, sink, str(tmp_path / "checkpoint"), available_now=True)
        query.awaitTermination(120)

    run()
    one([("<urn:a>", "<urn:ex:p>", "<urn:y>")]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert [x for n in sorted(seen) for x in seen[n]] == ["<urn:a>"]
