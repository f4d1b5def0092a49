"""Every query of the operators on tables with odd rows, extra columns that clash, and no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import queries as Q

NAMES = ["_gone", "_row_key", "_n_removed", "_epoch", "_order", "_gone_id", "words", "row", "part", "component_id", "kept", "score", "label", "cluster", "theta", "n", "_place"]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé"), 5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    same, long = text(120), "\n".join(text(60) for _ in range(7000))
    texts = [None, "", " \n", same, same, same + " tail", long, long[: 1 << 20] + "x", "All rights reserved\nCC BY", "x" * (2 << 20)] + [text(int(n)) for n in rng.integers(1, 200, 40)]
    rows = [(None if i == 7 else i - i % 17 if i == 20 else i, t, ("en", "fr", None)[i % 3], (None, "a", "b")[i % 3]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text")).select("*", *[F.array(F.lit(k)).alias(c) for k, c in enumerate(NAMES)])
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(8, 40)], "doc_id long, quality int, toxic int").select("*", F.lit("x").alias("text"), F.lit(1).alias("score"))
    vectors = [(i, rng.normal(size=64).tolist() if i % 5 else None, i % 3) for i in range(40)] + [(41, [0.0] * 64, 1), (42, [1.0] * 3, None), (None, [0.5] * 64, 1)]
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").select("*", *[F.lit("x").alias(c) for c in ("v", "k1", "id", "cluster", "distance", "copies", "x")])
    path = str(tmp_path_factory.mktemp(request.param))
    for name, table in (("documents", docs), ("labels", labels), ("embeddings", vectors)):
        (table if request.param == "odd" else table.limit(0)).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return path, request.param == "empty", len(rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_odd_tables(spark, folder, name):
    path, empty, n = folder
    out = Q.queries()[name](spark, path).collect()
    if empty:
        assert not out
    elif name == "op9_vectors":
        assert len(out) == 43
    elif name == "op11_centroids":
        assert len(out) == 34
    elif name not in ("op5_mixing", "op13_phrases"):
        assert len(out) == n and sorted(r.doc_id for r in out if r.doc_id is not None)[-1] == n - 1
