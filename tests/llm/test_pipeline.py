"""The pipeline stage by stage: each stage's decisions on its own input, and the whole run."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import re  # noqa: E402
from collections import Counter  # noqa: E402

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import pytest  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from tests.llm.test_documents import WORD, components_of, deduped, shingles  # noqa: E402
from tidemark.session import materialize  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "src0", 0), (90003, "12 34 !?", None, "src1", 8), (None, docs.first().text, None, "src1", 3), (90004, docs.first().text, "en", None, 3)], docs.schema)
    out = [materialize(docs.unionByName(odd).unionByName(docs.limit(1)))]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), name))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mixing", "bpe"]


def test_language_stage_drops_only_unreadable(steps):
    kept = Counter(rows(steps[1]))
    gone = [x for x in (Counter(rows(steps[0])) - kept).elements()]
    assert {i for i, t in gone if not re.search(r"[^\W\d_]", t or "")} == {90001, 90002, 90003}
    assert not any(len(WORD.findall(t or "")) > 5 for _, t in gone)
    assert all(r.lang for r in steps[1].collect())


def test_line_stage_equals_the_plain_version(steps):
    before = rows(steps[1])
    want = deduped(before)
    expected = Counter((i, want[i, t][0]) for i, t in before if want[i, t][0] == t or want[i, t][0].strip(" "))
    assert Counter(rows(steps[2])) == expected
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_group_stays(steps):
    before = rows(steps[2])
    want = components_of(before)
    got = rows(steps[3])
    assert sorted((i is None, i or 0) for i, t in got if shingles(t)) == sorted({(c is None, c or 0) for _, n, c in want if n})
    assert Counter(got) <= Counter(before)


def test_mixture_takes_one_and_a_half(steps):
    size = lambda df: sum(len(WORD.findall(t)) for _, t in rows(df))
    assert abs(size(steps[4]) - 1.5 * size(steps[3])) <= 25
    most = Counter(i for i, _ in rows(steps[4]))
    assert max(most.values()) <= 2


def test_tokens_are_the_library_s(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in rows(steps[4]))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in steps[5].collect()) == want


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
