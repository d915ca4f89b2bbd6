"""Every operator and every pipeline stage with nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corrgrid.llm.bpe import encode_digests
from corrgrid.llm.chat import link_tools
from corrgrid.llm.exact_dedup import exact_dedup
from corrgrid.llm.mixing import entropy_mix
from corrgrid.llm.pii import find_pii
from corrgrid.llm.secrets import secrets
from corrgrid.llm.simhash import near_dedup
from corrgrid.llm.substring_dedup import substring_dedup
from corrgrid.llm.topk import top_k
from corrgrid.llm.toxicity import toxicity

#: Names that the operators use inside.
CLASHES = """rid norm digest text_sha weak first group_size kept kept_id kept_sha own_sha label_id own_id fold y toxic score mix_id mix_copies mix_n copies skey size n rate
    key th raw lists starts term start end at span class every entities fp node component component_id u v part members id band block q_block floor label hit_id hit_digest
    turn2 calls tools malformed json errors grp eff_turn level""".split()
LONG = " ".join(f"w{i % 700}" for i in range(20000))
ROWS = [(1, "alpha  beta\tgamma"), (2, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (4, ""), (5, LONG), (6, LONG + " tail"), (7, "x" * 60000), (None, "alpha beta gamma"), (None, None), (9, "user=bob pass=hunter22 a.b@c.org")]


def docs(spark, clash):
    df = spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}") for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return with_clashes(df) if clash else df


def with_clashes(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in df.columns])


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 0), (9, 0, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op3": substring_dedup, "op4": secrets, "op5": find_pii, "op6": exact_dedup, "op7": encode_digests, "op8": entropy_mix, "op9": near_dedup,
    "op10": lambda d: toxicity(d, labels(d.sparkSession)),
}
rows_of = lambda df: sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    plain = rows_of(OPERATORS[name](docs(spark, False)))
    assert len(plain) == len(ROWS) and rows_of(OPERATORS[name](docs(spark, True))) == plain
    assert OPERATORS[name](docs(spark, True).where("false")).count() == 0


def test_messages(spark):
    rows = [(1, 0, "a", '{"tool_calls":[{"id":"c","name":"f"}]}'), (1, 1, "t", '{"tool_call_id":"c"}'), (1, 1, "t", '{"tool_call_id":"c"}'), (None, None, None, None), (2, 0, "u", ""), (2, 1, "u", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = rows_of(link_tools(df))
    assert len(plain) == len(rows) and rows_of(link_tools(with_clashes(df))) == plain and link_tools(with_clashes(df).where("false")).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [])], "vec_id long, embedding array<double>")
    plain = rows_of(top_k(df))
    assert [tuple(r)[:3] for r in top_k(df).orderBy("rank").collect()] == [(100, 1, 1), (100, 2, 2), (100, 3, 2), (100, 4, 6)]
    assert rows_of(top_k(with_clashes(df))) == plain and top_k(with_clashes(df).where("false")).count() == 0


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels(spark).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, small_dir, name, stage):
    texts = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    before = docs(spark, True)
    after = stage(spark, before, small_dir)
    assert stage(spark, before.where("false"), small_dir).count() == 0
    if name == "bpe":
        assert after.count() == len(ROWS)
        return
    assert after.columns == before.columns
    plain = stage(spark, docs(spark, False), small_dir)
    assert texts(plain) == texts(after)
    kept = {i for i, _ in texts(after)}
    if name == "exact_dedup":
        assert kept == {1, 3, 5, 6, 7, 9}
    if name == "simhash_near_dedup":
        assert kept == {-1, 1, 3, 5, 7, 9} and after.where("doc_id is null").count() == 2
    if name == "mixing":
        assert {-1, 3, 4} <= kept and after.where("doc_id is null").count() == 2


def test_a_run_of_the_pipeline_leaves_other_results_alone(spark, small_dir):
    """A frame made before reads its own staged tables after the run; the run leaves only what its result reads."""
    import os

    from corrgrid.staging import shared_dir

    docs(spark, False).write.mode("overwrite").parquet(f"{small_dir}/documents.parquet")
    folder = shared_dir(spark).removeprefix("file:")
    mixed = entropy_mix(spark.read.parquet(f"{small_dir}/documents.parquet"))
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, small_dir)
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() > 0
    assert mixed.count() == len(ROWS)
