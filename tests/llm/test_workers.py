"""Executors have the public libraries, not this repository."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from mlwatch.llm import quality, rows

REPO = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys, tempfile
sys.path.insert(0, {repo!r})  # of the driver alone
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="mlwatch-")).config("spark.ui.enabled", "false").getOrCreate())
from mlwatch.llm.queries import QUERIES
for key in {keys!r}:
    print(key, QUERIES[key](spark, "/root/testdata/sf0.001").count(), flush=True)
"""

KEYS = [
    "op3_language_id", "op4_byte_bpe", "op5_nearest_neighbours", "op6_quality_classifier", "op7_secret_scan",
    "op11_toxicity", "op12_centroid_clustering", "op13_embedding_whitening",
]


def test_workers_without_the_repository(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=str(REPO), keys=KEYS))
    path = ":".join(p for p in sys.path if p and Path(p).resolve() != REPO)
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=600,
        env={**os.environ, "PYTHONPATH": path},
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == KEYS


def test_samples_of_very_large_tables(spark):
    """The share of a sample is right for any number of rows: neither empty nor without bound."""
    ids = spark.range(200_000)
    hashed = F.xxhash64("id")
    for count in (200_000, 10**9, 10**13):
        assert 1800 < ids.filter(rows.hashed_below(hashed, count // 100, count)).count() < 2200
    assert ids.filter(rows.hashed_below(hashed, 200_000, 200_000)).count() == 200_000
    lowest = F.lit(-(1 << 63)).cast("long")  # of 5 billion rows, 4000 are wanted
    assert ids.filter(rows.hashed_below(lowest, 4000, 5 * 10**9)).count() == 200_000
    assert ids.filter(rows.hashed_below(hashed, 4000, 5 * 10**9)).count() <= 5


def test_quality_features_do_not_depend_on_pieces(monkeypatch):
    classes = quality.character_classes()
    text = "the cat cat cat sat on on the mat\n" * 50 + "x " * 30 + "end" + " wide " * 5 + "y" * 700
    whole = quality.features(text, classes)
    words = text.split()
    assert whole[-5] == np.float32(len(set(words)) / len(words))
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert (quality.features(text, classes) == whole).all()
