"""Each stage of the pipeline on its own input, against brute force; and the entry module without this subpackage."""

import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import quality
from test_operators import VOCABULARY, brute_components, shingle_set


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    word = lambda: str(rng.choice(VOCABULARY["en"])) if rng.random() < 0.5 else f"w{rng.integers(10**5)}"
    texts = [" ".join(word() for _ in range(int(rng.integers(60, 200)))) for _ in range(40)]
    item = " ".join(f"q{i} answer" for i in range(20))
    texts[5] += " " + item
    texts += [texts[3], texts[3], texts[4] + " one more word", "short text", None, " ".join(f"#{i}$$$%%%" for i in range(90)), "same words again " * 60]
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def test_stages(spark, tables):
    path, item = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "benchmark decontamination", "mixing", "sharding"]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, spark.createDataFrame(before, docs.schema) if before else docs, path)
        after = [tuple(r) for r in docs.collect()]
        if number < 4:
            assert docs.columns == columns
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.judged(spark.read.parquet(f"{path}/documents.parquet")).where("quality.kept").collect()}
            assert {r[0] for r in after} == kept and set(range(43)) <= kept and not kept & {43, 44, 45, 46}
        elif name == "near-duplicates":
            assert {r[0] for r in after} == {i for i, (_, c) in brute_components(before).items() if i == c}
        elif name == "benchmark decontamination":
            wanted = shingle_set(item)
            assert {r[0] for r in after} == {r[0] for r in before if len(shingle_set(r[1]) & wanted) < 0.75 * len(wanted)} and len(after) < len(before)
        elif name == "mixing":
            size = defaultdict(int)
            for r in before:
                size[r[3]] += len(r[1].split())
            taken = defaultdict(int)
            for r in after:
                taken[r[3]] += len(r[1].split())
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.15 * sum(size.values())
            assert all(taken[s] <= 2 * n for s, n in size.items())
        else:
            assert Counter(r[:5] for r in after) == Counter(before) and all(0 <= r[5] < 24 for r in after)
        before = after


def test_run_gives_the_rows_of_the_stages(spark, tables):
    path, _ = tables
    one, two = (Counter(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) for _ in range(2))
    assert one == two and one


def test_entry_works_without_this_subpackage(tmp_path):
    code = "import sys\nsys.modules['foliant.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert not [q for q in e.queries() if q.startswith('op')] and 'ver06_ledger' in e.queries() and 'ver06_ledger' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
