import corpus_pipeline as CP
from tests.llm.test_line_dedup import corpus as line_corpus
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_ngram_join import brute, corpus
from watchloom.llm.mixing import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], SCHEMA).coalesce(1)


def test_stages_keep_the_columns(spark):
    df = frame(spark, corpus(3, 30) + [(None, None)])
    for _, stage in CP.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.schema.simpleString() == df.schema.simpleString()


def test_language_stage_drops_what_has_no_language(spark):
    df = frame(spark, [(k, "the kalo mi ten") for k in range(8)] + [(20, "123 456"), (21, None), (22, "")])
    assert sorted(r.doc_id for r in CP.language_stage(spark, df, "").collect()) == list(range(8))


def test_line_stage(spark):
    rows = line_corpus(6, 40)
    want = plain_lines(rows)
    own = {i: sum(bool(x.strip()) for x in t.split("\n")) for i, t in rows}
    got = {r.doc_id: r for r in CP.line_stage(spark, frame(spark, rows), "").collect()}
    assert {d: r.text for d, r in got.items()} == {rows[i][0]: t for i, (t, n) in want.items() if not own[rows[i][0]] or n < own[rows[i][0]]}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_duplicate_stage(spark):
    rows = corpus(4, 80)
    want, _ = brute(rows)
    assert sorted(r.doc_id for r in CP.near_duplicate_stage(spark, frame(spark, rows), "").collect()) == sorted({c for _, c, _ in want})


def test_mix_stage(spark):
    df = frame(spark, [(k, "w " * (k % 9 + 1)) for k in range(90)])
    taken = {r.doc_id: r.taken // r.size for r in mix(df).collect() if r.taken}
    got = [r.doc_id for r in CP.mix_stage(spark, df, "").collect()]
    assert {d: got.count(d) for d in set(got)} == taken


def test_run(spark, tmp_path):
    frame(spark, corpus(8, 60)).write.parquet(str(tmp_path / "documents.parquet"))
    out = CP.run(spark, str(tmp_path)).collect()
    assert out and all(r.decoded for r in out)


def test_run_on_odd_tables(spark, tmp_path):
    odd = [(1, None), (1, ""), (2, "12 34"), (None, "the kalo mi ten again"), (5, "some other words of one line"), (5, "some other words of one line"), (6, "lo " * 3000)]
    extra = frame(spark, odd).selectExpr("*", "1 AS __row", "2 AS number", "'x' AS line", "3 AS kept", "4 AS digest")
    extra.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    got = [r.doc_id for r in CP.run(spark, str(tmp_path / "odd")).collect()]
    assert set(got) == {None, 5, 6} and all(got.count(d) <= 2 for d in set(got))
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert CP.run(spark, str(tmp_path / "none")).collect() == []
