"""The corpus pipeline stage by stage against plain versions, and the guard of the entry module."""

import os
import pathlib
import re
import subprocess
import sys
import zlib

import pytest

import corpus_pipeline
from sigtide.llm import pii, quality_model, quality_rules

from .helpers import awkward, empty
from .test_pii import slow as slow_spans
from .test_quality_rules import slow as slow_measures
from .test_simhash import slow_classes, slow_fingerprint
from .test_tokens import check_packing

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What each stage returned, written and read again as the check does."""
    out, docs = [spark.read.parquet(f"{sf}/documents.parquet")], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "SimHash near-dedup", "PII", "best-fit packing"]
    for df in steps[:-1]:
        assert df.columns == DOCS and df.count() > 0
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(steps[-1].columns)


def test_rules_reject_and_keep_rows_whole(steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[:2])
    kept = {r.doc_id for r in quality_rules.quality_rules(steps[0]).where("kept").collect()}
    assert set(after) == kept and all(before[i] == after[i] for i in kept)
    for i, r in before.items():
        n_words, _, _, _, n_repeat = slow_measures(r.text)
        assert not (i in kept and (n_words < 20 or 100 * n_repeat > 30 * n_words))


def test_classifier_keeps_clean_documents(spark, sf, steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[1:3])
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in before if i in good and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(before[i] == r for i, r in after.items())
    clean = [i for i in held if good[i] == 1]
    assert sum(i in after for i in clean) >= 0.95 * len(clean)
    score = {r.doc_id: r.predicted for r in quality_model.quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(after) == {i for i in before if score[i] == 1}


def test_one_of_each_class_stays(steps):
    before, after = (df.collect() for df in steps[2:4])
    classes = slow_classes([r.doc_id for r in before], [slow_fingerprint(r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(classes))


def test_personal_data_goes(steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[3:5])
    assert set(before) == set(after)
    for i, r in after.items():
        text, at, out = before[i].text or "", 0, ""
        for kind, a, z in slow_spans(text):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, z)
        assert re.sub(r"\[FOUND_[A-Z]+\]", "", r.text or "") == out + text[at:] or "[FOUND_" in (r.text or "")
        assert not slow_spans(re.sub(r"\[[A-Z_]+\]", " ", r.text or ""))
        assert r[2:] == before[i][2:]
    assert any("[EMAIL]" in (r.text or "") for r in after.values())


def test_all_that_is_left_is_packed(steps):
    check_packing(steps[-1].collect(), [(r.doc_id, r.text) for r in steps[-2].collect()])


def test_run_equals_the_stages(spark, sf, steps):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(*cols).collect())) == sorted(map(tuple, steps[-1].select(*cols).collect()))


def test_filters_on_awkward_rows(spark, sf):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        for df in (awkward(spark), empty(spark)):
            got = stage(spark, df, sf)
            assert got.columns == df.columns and got.count() <= df.count(), k
    assert pii.redact(awkward(spark)).where("doc_id = 1").first().text is None


def test_entry_without_the_subpackage(tmp_path):
    """The folders can go; an import error inside them is not hidden."""
    root = pathlib.Path(corpus_pipeline.__file__).parent
    (tmp_path / "a").mkdir()
    for f in ("__spark_entry__.py", "sigtide"):
        (tmp_path / "a" / f).symlink_to(root / f)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    (tmp_path / "b" / "sigtide").symlink_to(root / "sigtide")
    (tmp_path / "b" / "corpus_pipeline.py").write_text("import no_such_module")
    (tmp_path / "c" / "sigtide").mkdir(parents=True)
    for p in (root / "sigtide").iterdir():
        if p.name != "llm":
            (tmp_path / "c" / "sigtide" / p.name).symlink_to(p)
    (tmp_path / "c" / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import __spark_entry__ as e; print(len([n for n in e.queries() if n.startswith('op')]), len(e.queries()) > 100)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(
        p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not (pathlib.Path(p) / "sigtide").exists())}
    run = {d: subprocess.run([sys.executable, "-P", "-c", f"import sys; sys.path.insert(0, {str(tmp_path / d)!r}); {code}"], capture_output=True, text=True, cwd=tmp_path, env=env) for d in "abc"}
    assert run["a"].stdout.strip() == "0 True" and run["c"].stdout.strip() == "0 True", (run["a"].stderr, run["c"].stderr)
    assert run["b"].returncode and "no_such_module" in run["b"].stderr
