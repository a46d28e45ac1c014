"""The pipeline's stages on odd rows, and that the library doesn't need this subpackage."""

import os
import re

import corpus_pipeline
import cases


def test_stages(spark, tmp_path):
    rows = cases.documents(spark)
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, rows, cases.FOLDER)
        if at + 1 < len(corpus_pipeline.STAGES):
            assert left.columns == rows.columns
        left.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < left.count() <= rows.count()
        rows = left
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "bpe_encoding"]


def test_nothing_else_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(f"{root}/thetaloom"):
        for file in files:
            if file.endswith(".py") and not folder.endswith("/llm"):
                with open(f"{folder}/{file}") as text:
                    assert not re.search(r"thetaloom\.llm|from thetaloom import llm", text.read())
