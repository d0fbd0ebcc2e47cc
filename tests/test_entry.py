import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents labels conversations events lineitem orders part benchmark pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(v) if isinstance(v, list) else v


CHECKED = ["b1_tokenize", "b3_cleanup", "c1_overlaps", "c2_merge_spans", "c5_token_overlaps", "d1_pattern_spans", "d3_detect_identifiers", "d4_gold_spans", "d8_residual_literals", "e1_label_to_binary", "e2_majority_vote", "e6_cue_labels", "g2_importance", "g3_anchors", "g4_cue_fallback", "h3_stance_nearest", "h7_pii_mask", "h11_all_variants", "i1_render", "j3_flip_rate", "j7_ngram_retention", "j8_residual_rates", "j10_cue_preservation", "l3_mcnemar", "l7_frontier", "m2_stratified_selection", "n3_pareto"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_golden_statistics(spark):
    rows = {r.pair: r.p for r in entry.queries()["l3_mcnemar"](spark, SF).collect()}
    assert round(rows["golden-38-22"], 4) == 0.0519
    assert round(rows["golden-48-29"], 4) == 0.0395
    assert round(rows["golden-103-42"], 4) == 0.0
    assert round(rows["golden-90-47"], 4) == 0.0003
    assert rows["golden-0-0"] == 1.0
    assert round(entry.queries()["l7_frontier"](spark, SF).first().frontier, 1) == 38.6
    chosen = [r.setting for r in entry.queries()["n2_recommended"](spark, SF).collect() if r.recommended]
    assert chosen == ["k=5, r=2"]
    assert not any(r.pareto_dominated for r in entry.queries()["n3_pareto"](spark, SF).collect())


def test_stand_in_masks_cover_whole_texts(spark):
    queries = entry.queries()
    tokens = {(r.row_id, r.idx) for r in queries["b1_tokenize"](spark, SF).collect()}
    cues = {(r.row_id, r.idx) for r in queries["e6_cue_labels"](spark, SF).collect()}
    masks = {(r.row_id, r.idx): r.mask for r in queries["a7_char_offset_mask"](spark, SF).collect()}
    assert masks.keys() == tokens and {k for k, v in masks.items() if v} == cues
    assert {r.n_mask for r in queries["j12_rationale_overlap"](spark, SF).collect()} == {len(cues)}
    assert {(r.row_id, r.variant) for r in queries["b7_fragmentary"](spark, SF).collect()} == {(r.row_id, r.variant) for r in queries["h11_all_variants"](spark, SF).collect()}


@pytest.mark.parametrize("name", ["a7_char_offset_mask", "b7_fragmentary", "j12_rationale_overlap"])
def test_whole_texts_match_oracle(spark, duck, name):
    test_query_matches_oracle(spark, duck, name)


def test_review_summary_walks_all_rows_once(spark, duck):
    """The rows of the review are walked alone, and no relation is read once for each question."""
    test_query_matches_oracle(spark, duck, "m6_review_summary")
    planned = entry.queries()["m6_review_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert planned.count("MapInArrow") == 2  # releases and judgements of the selected rows
    assert "Union" not in planned and "documents" not in planned
