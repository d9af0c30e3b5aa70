"""Task functions load and run in a process that has neither this package nor its folder."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from tidebar.llm import alignment, covering, jaccard_join, licenses, packing, phrases, records, toxicity, wrappers
from tidebar.session import carry_code

TEXTS = ["under the mit license", "bad words here. good ones there\nand a line", "", None]
BATCH = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4], pa.int64()), pa.array(TEXTS, pa.string())], ["doc_id", "text"])
BARE = """
import os, pickle, sys
run, batch = pickle.load(sys.stdin.buffer)
assert not any(name.split(".")[0] == "tidebar" for name in sys.modules), "the package was imported"
rows = run(iter([batch]))
print("rows", sum(len(x) for x in rows) if rows is not None else 0)
"""


class Taken(Exception):
    """Carries the function that an operator would have sent to its tasks."""


def task_function(module, monkeypatch, call):
    """The function that call hands to map_batches in the module."""

    def take(df, fn, schema):
        raise Taken(fn)

    monkeypatch.setattr(module, "map_batches", take)
    with pytest.raises(Taken) as taken:
        call()
    return taken.value.args[0]


def in_bare_process(fn, batch, folder):
    carry_code()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-c", BARE], input=cloudpickle.dumps((fn, batch)), capture_output=True, cwd=folder, env=env, timeout=120)
    assert made.returncode == 0, made.stderr.decode()[-2000:]
    return int(made.stdout.split()[-1])


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(zip([1, 2, 3, 4], TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize(
    "fn",
    [jaccard_join.set_rows(3, 9, 10), jaccard_join.set_elements(3), covering.fingerprint_rows(4), alignment.aligned_rows(alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)],
    ids=["sets", "elements", "fingerprints", "alignment"],
)
def test_functions_of_id_and_text(fn, tmp_path):
    assert in_bare_process(fn, BATCH, tmp_path) >= 1


def test_words_of_phrases(tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array([t or "" for t in TEXTS])], ["lang", "text"])
    assert in_bare_process(phrases.word_rows(0), batch, tmp_path) >= 1


def test_licenses(texts, tmp_path, monkeypatch):
    assert in_bare_process(task_function(licenses, monkeypatch, lambda: licenses.scan(texts)), BATCH, tmp_path) == 4


def test_packing(texts, tmp_path, monkeypatch):
    assert in_bare_process(task_function(packing, monkeypatch, lambda: packing.pieces(texts)), BATCH, tmp_path) == 4


def test_toxicity(texts, tmp_path, monkeypatch):
    import numpy as np

    model = toxicity.fit(pa.array(["bad words here"] * 20 + ["good ones there"] * 20), np.repeat([True, False], 20))
    assert in_bare_process(task_function(toxicity, monkeypatch, lambda: toxicity.scored(model, texts)), BATCH, tmp_path) == 4


def test_wrappers(tmp_path):
    pages = pa.RecordBatch.from_arrays([pa.array(["h"]), pa.array(["<body><p>text</p></body>"])], ["host", "html"])
    assert in_bare_process(wrappers._partial, pages, tmp_path) >= 1


def test_record_files_are_read_by_many_tasks(spark, texts, tmp_path):
    many = texts.union(spark.range(100, 400).selectExpr("id", "repeat('word and ', 50)"))
    files = records.write_records(many, str(tmp_path / "records"), file_bytes=2_000)
    read = records.read_records(files)
    assert files.where("records > 0").count() > 4
    assert read.count() == 304
    assert len({r[0] for r in read.selectExpr("spark_partition_id()").collect()}) > 1


def test_a_task_keeps_only_what_it_uses():
    """Tables that another operator left in the worker are forgotten when a task begins."""
    from tidebar.llm import common

    for key in (("encoder", "x"), ("partition", 1, 2), ("powers",)):
        common.kept_by_worker(key, dict)
    common.forget_all_but(("partition",))
    made = []
    for key in (("encoder", "x"), ("partition", 1, 2), ("powers",)):
        common.kept_by_worker(key, lambda: made.append(key) or {})
    assert made == [("encoder", "x")]
