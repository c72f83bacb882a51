import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from recordchecks.llm.common import read_table

REPO = Path(__file__).parents[2]
SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage works on all that its predecessor kept, and its decisions take effect."""
    import re

    from recordchecks.llm import mixing, simhash
    docs = read_table(spark, SMALL, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        seen[name] = docs
        if name != "pack":
            assert docs.columns == columns
        if name == "near_dedup":
            assert docs.count() == simhash.near_duplicates(before).select("component_id").distinct().count()
        if name == "private_data":
            assert docs.count() == before.count()
            assert not [r for r in docs.select("text").collect() if re.search(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", r[0])]
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "mix":
            assert docs.count() == mixing.mix(before).groupBy().sum("copies").first()[0]
        if name == "pack":
            words = sum(len((r[0] or "").encode().split()) for r in before.select("text").collect())
            assert docs.groupBy().sum("n_words").first()[0] == words
    low = read_table(spark, SMALL, "labels").where("quality = 0").join(seen["quality"], "doc_id").count()
    good = read_table(spark, SMALL, "labels").where("quality = 1").join(seen["quality"], "doc_id").count()
    assert low <= 0.1 * good


def test_repeated_and_null_rows(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows + [(30 + i, f"plain text number {i} of many words here", "s") for i in range(40)])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_the_rest_imports_without_the_subpackage(tmp_path):
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; "
            "assert e.queries() and not [k for k in e.queries() if k.startswith('op') and k[2].isdigit()]")
    import shutil
    shutil.copytree(REPO / "recordchecks", tmp_path / "recordchecks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", code.replace("sys.modules['corpus_pipeline'] = None; ", ""), str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
