"""The pipeline against its stages in plain Python, and the library without the subpackage."""

import os
import subprocess
import sys

import corpus_pipeline
from buylens.llm import quality
from buylens.llm.shared import stored
from tests.llm.test_jaccard import brute
from tests.llm.test_text_rules import leaks
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages(llm, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    kept = [r.doc_id for r in quality.scored(docs).where("kept").collect()]
    alone = sorted(doc for doc, _, least in brute([(i, rows[i].text) for i in kept]) if doc == least)
    items = [(r.item_id, r.text) for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i, (_, hit, _) in zip(alone, leaks([rows[i].text for i in alone], items), strict=True) if not hit]
    got, steps = docs, []
    for name, stage in corpus_pipeline.STAGES:
        got = stored(stage(llm, got, SF), "stage")
        steps.append(got)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert got.columns == docs.columns
    assert [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in steps[:4]] == [sorted(kept), alone, clean, clean]
    texts = [(r.doc_id, r.text) for r in steps[3].collect()]
    used, bound = check_pieces(got.collect(), texts)
    assert used <= bound + 1 and corpus_pipeline.run(llm, SF).count() == got.count()


def test_odd_rows(llm, odd):
    got = odd.withColumn("n_chars", odd["doc_id"])
    for _, stage in corpus_pipeline.STAGES:
        got = stored(stage(llm, got, SF), "stage")
    assert {r.doc_id for r in got.collect()} == {6, 8, None}


def test_library_without_the_subpackage(tmp_path):
    """The entry module imports and has its other queries when the subpackage is not there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("buylens", "oracle"):
        for folder, _, files in os.walk(f"{root}/{name}"):
            if "/llm" in folder or "__pycache__" in folder:
                continue
            os.makedirs(tmp_path / os.path.relpath(folder, root), exist_ok=True)
            for file in files:
                os.symlink(f"{folder}/{file}", tmp_path / os.path.relpath(folder, root) / file)
    (tmp_path / "__spark_entry__.py").write_text(open(f"{root}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
