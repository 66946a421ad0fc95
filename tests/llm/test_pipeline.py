"""The whole pipeline against its stages done by brute force."""

import corpus_pipeline as P
import pytest
from corpus_audit.llm import common, decontaminate, piece_nbest, toxicity
from corpus_audit.llm.queries import tokenizer
from test_decontaminate import brute
from test_golay_simhash import fingerprint, smallest_reachable
from test_window_dedup import removed

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    chain = toxicity.fit(docs, common.table(spark, SF, "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if toxicity.chances(chain, toxicity.terms_of(t))[-1] < toxicity.REJECT}
    groups = smallest_reachable({i: {fingerprint(t)} for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if groups[i] == i}
    kept = {}
    for i, _, n_removed, words, text in removed(sorted(rows.items()), 50):
        kept[i] = (words, text if not n_removed else None)
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    lattice, want = piece_nbest.lattice(tokenizer("piece_bpe_32k.model"), piece_nbest.N_BEST), {}
    staged = docs
    for name, stage in P.STAGES:
        staged = common.stored(stage(spark, staged, SF), "test")
        if name != "pieces":
            assert staged.columns == docs.columns and staged.dtypes == docs.dtypes
        if name == "window_dedup":
            repeats_gone = {r["doc_id"]: r["text"] for r in staged.collect()}
            assert set(repeats_gone) == set(kept)
            for i, (words, text) in kept.items():
                assert repeats_gone[i].split() == words if text is None else repeats_gone[i] == text
    for i, text in repeats_gone.items():
        n, hit, _ = brute(text, items, decontaminate.WINDOW)
        if n and len(hit) / n > decontaminate.MAX_COVERAGE:
            continue
        spans = decontaminate.merged([(p, p + 1) for p in hit])
        want[i] = lattice.n_best_of(decontaminate.without_words(text, spans))
    got = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert set(got) == set(want) and len(want) < 200
    for i, r in got.items():
        assert (r["score"], bytes(r["ids"])) == (want[i][0][0] / lattice.scale, want[i][0][1])
        assert r["other_scores"] == [s / lattice.scale for s, _ in want[i][1:]]
    assert sorted(map(str, got.values())) == sorted(map(str, staged.collect()))


def test_stages_keep_awkward_rows(spark, awkward):
    df = awkward(long_words=2000).select("doc_id", "text", "lang").withColumn("source", common.F.lit("s")).withColumn("n_chars", common.F.length("text").cast("long"))
    for name, stage in P.STAGES[1:]:
        df = common.stored(stage(spark, df, SF), "test")
        ids = {r["doc_id"] for r in df.collect()}
        assert {1, 3, 7, 8, 9, 10} <= ids and 2 not in ids, name


def test_near_copies_of_an_id_with_two_texts(spark):
    a, b = " ".join(f"alpha{k}" for k in range(60)), " ".join(f"beta{k}" for k in range(60))
    rows = [(1, a), (2, a), (2, b), (3, None), (4, " "), (None, a), (5, b)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, df, SF).collect()), key=repr)
    assert left == sorted([(1, a), (2, b), (3, None), (None, a)], key=repr)


def test_toxicity_stage_on_awkward_rows(spark, awkward, tmp_path):
    df = awkward().select("doc_id", "text", "lang").withColumn("source", common.F.lit("s")).withColumn("n_chars", common.F.length("text").cast("long"))
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 1), (None, 1, 1), (7, None, None), (7, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = P.drop_toxic(spark, df, str(tmp_path))
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_stages_take_an_empty_table(spark, k):
    docs = common.table(spark, SF, "documents").limit(0)
    assert P.STAGES[k][1](spark, docs, SF).count() == 0
