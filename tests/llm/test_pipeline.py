"""The pipeline's rows against brute force of its stages."""
import os

import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from sparquill.llm import bpe  # noqa: E402

from tests.llm.test_line_dedup import brute as brute_lines  # noqa: E402
from tests.llm.test_minhash import brute as brute_groups  # noqa: E402
from tests.llm.test_minhash import corpus  # noqa: E402
from tests.llm.test_mixing import brute as brute_mix  # noqa: E402
from tests.llm.test_quality import rejects  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.PATH), reason="no vocabulary file")


def test_run_against_brute_force(spark, make, tmp_path):
    rows = [(d, t.replace(" w1", "\nw1", 2), "en", f"s{(d or 0) % 3}", len(t)) for d, t in corpus(8)] + [(2000, None, "en", "s1", None), (2001, "", "en", "s1", 0), (2002, "A!! B!! C!!", "en", "s2", 11), (None, "a text without an id, kept like others", None, "s0", 38)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["source"], list(r["token_ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    info = {r[0]: r for r in rows}
    left = [(d, t) for d, t, *_ in rows if not rejects(t)]
    left = [(d, t) for d, t in brute_lines(left).items() if t]
    gone = brute_groups(left)
    left = [(d, t) for d, t in left if d not in gone]
    mixed = brute_mix([(d, t, None, info[d][3], None) for d, t in left], budgets=(1.0,))
    whole = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.codec().ranks, special_tokens={})
    want = {d: (info[d][3], whole.encode_ordinary(t), t) for d, t in left if (d, info[d][3]) in mixed}
    assert got == want and len(want) >= 10


def test_stages_keep_the_columns_of_documents(spark, make):
    docs = make(corpus(9)[:20])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
