import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.functions import lexicon as L
from veilspan.operators import identify, release
from veilspan.sources import readers, writers
from veilspan.streaming.scoring import score_stream


def test_injection_spans_hold_their_values():
    for index in range(60):
        template, text, spans = identify.inject("The quick brown fox.", 17, index)
        assert template in L.TEMPLATES and spans
        for s in spans:
            assert text[s["start"] : s["end"]] and s["replacement"] == f"[{s['label']}]"


def test_direct_mask_leaves_quasi_identifiers():
    text = "Mira Stone from Riverton High wrote: hello"
    found = identify.resolve(identify.candidates(text))
    direct = identify.mask(text, found, set(L.DIRECT))
    assert "[PERSON]" in direct and "Riverton High" in direct
    assert "Riverton" not in identify.mask(text, found, set(L.DIRECT + L.QUASI))


def test_dates_beat_phones():
    labels = [s["label"] for s in identify.resolve(identify.candidates("on 2026-04-17 we met"))]
    assert labels == ["DATE"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from(["A", "B"]), st.sampled_from([1.0, 1.2])), max_size=12))
def test_resolved_spans_are_disjoint_and_sorted(raw):
    spans = [identify.span(s, s + n, label, "regex", score) for s, n, label, score in raw]
    out = identify.resolve(spans)
    assert all(a["end"] <= b["start"] for a, b in zip(out, out[1:]))
    assert bool(out) == bool(spans)


def test_token_pattern():
    tokens = re.findall(L.TOKEN, "@user_1 don't visit https://a.example/x, ok? 3.5 #tag [NAME]")
    assert tokens == ["@user_1", "don't", "visit", "https://a.example/x,", "ok", "?", "3.5", "#tag", "[NAME]"]


def test_lexicons():
    assert len(L.conformance().harm) == 47 and "vermin" in L.conformance().harm
    assert len({t for _, t in L.SYNTHETIC.labelled()}) == len(L.SYNTHETIC.labelled())


def test_csv_source(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,body,mark\na,"one, two",1\n,"three",0\n')
    rows = readers.read_csv(spark, str(path), "body", "mark", "id").collect()
    assert [r.text for r in rows] == ["one, two", "three"] and rows[0].row_id == "a" and rows[1].row_id and rows[0].dataset == "notes"
    try:
        readers.read_csv(spark, str(path), "missing")
        raise AssertionError
    except ValueError:
        pass


def test_rationale_source(spark, tmp_path):
    record = {"id": "x", "annotators": [{"label": "normal", "target": ["None"]}, {"label": "hate", "target": ["Women"]}, {"label": "hate", "target": ["Women", "Other"]}], "rationales": [[1, 0, 0], [1, 1]], "post_tokens": ["a", "b", "c"]}
    (tmp_path / "r.json").write_text(json.dumps(record) + "\n" + json.dumps(record | {"id": "y"}))
    (tmp_path / "s.json").write_text(json.dumps({"train": ["x"], "test": ["y"]}))
    (row,) = readers.read_rationale_corpus(spark, str(tmp_path / "r.json"), str(tmp_path / "s.json")).collect()
    assert (row.row_id, row.label, row.target_groups, row.rationale_token_mask) == ("x", "hate", ["women"], [1, 1, 0])


def test_scores_and_offsets(spark):
    df = spark.createDataFrame([("a", "0.7"), ("b", "x"), ("c", None)], "row_id string, toxicity string")
    assert [r.binary_label for r in readers.read_toxicity_scores(df).orderBy("row_id").collect()] == [1, 0, 0]
    df = spark.createDataFrame([("a b", "[0, 2]"), (" ", "[1]")], "text string, position string")
    assert [r.offsets for r in readers.read_char_offsets(df).collect()] == [[0, 2]]


def test_runs_releases_and_checkpoints(spark, tmp_path):
    (tmp_path / "runs/one").mkdir(parents=True)
    (tmp_path / "runs/one/config.json").write_text("{}")
    (tmp_path / "runs/one/variant_metrics.json").write_text('{"raw": 1}')
    (tmp_path / "runs/two").mkdir()
    (tmp_path / "runs/two/config.json").write_text("{}")
    assert [r.run for r in readers.read_runs(spark, str(tmp_path / "runs")).collect()] == ["one"]
    path = str(tmp_path / "done")
    df = spark.createDataFrame([("a", {"raw": "x", "context": "y"}), ("b", {"raw": "x"})], "row_id string, variants map<string,string>")
    writers.append_checkpoint(df, path)
    read = readers.read_releases(spark, path, "row_id string, variants map<string,string>", ["raw", "context"])
    assert [r.row_id for r in read.collect()] == ["a"]
    assert [r.row_id for r in readers.unfinished(df, read).collect()] == ["b"]
    assert writers.markdown_table(spark.sql("SELECT 0.5D AS rate, CAST(NULL AS INT) AS n"), ("rate",)).endswith("| 50.0 | NA |")
    lines = spark.createDataFrame([("/home/someone/x",), ("10.1.2.3",), ("fine",)], "value string")
    assert writers.leaks(lines).count() == 2
    writers.write_metrics_csv(df, str(tmp_path / "csv"), "variants")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["row_id", "context", "raw"]
    writers.write_manifest(spark, str(tmp_path / "manifest"), {"rows": 2, "kind": "é"})
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "manifest"), wholetext=True).collect())) == {"rows": 2, "kind": "é"}
    (tmp_path / "bad.json").write_text('{"a": 1}\nno json\n\n')
    assert [r.value for r in readers.bad_lines(spark, str(tmp_path / "bad.json")).collect()] == ["no json"]
    try:
        writers.markdown_table(df, limit=1)
        raise AssertionError
    except ValueError:
        pass


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("they should leave",), ("hello",), (None,)], "text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "ck")).start()
    running.processAllAvailable()
    running.stop()
    got = sorted(spark.table("scored").collect(), key=str)
    assert got == sorted(score_stream(df).collect(), key=str)
    assert max(r.score or 0 for r in got) > 0.6


def test_heads():
    from veilspan.operators import classifiers as C

    names = {0: "toxicity", 1: "severe_toxicity", 2: "obscene", 3: "identity_attack", 4: "insult"}
    assert C.head(names) == (0, True)
    assert C.head({"0": "NON_HATE", "1": "HATE"}) == (1, False) and C.head({"1": "clean", "0": "hateful"}) == (0, False)
    assert C.head(None) == (1, False) and C.head({0: "a", 1: "b"}) == (1, False) and C.head({"x": "hate", 2: "a", 5: "b"}) == (5, False)
    assert C.head({0: "a", 1: "b"}, "multi_label_classification").independent
    assert C.Head(1, False).scores([[0.0, 0.0], [0.0, 100.0]]).round(6).tolist() == [0.5, 1.0] and C.Head(0, True).scores([[0.0, 9.0]]).tolist() == [0.5]


def test_scorers(spark):
    from veilspan.operators import classifiers as C

    assert C.choose("lexicon").name == "lexicon" and C.choose("big", kinds={"big": C.Kind(("no_such_module",), dict)}).why == "big needs no_such_module"
    try:
        C.choose("unknown")
        raise AssertionError
    except ValueError:
        pass
    df = spark.createDataFrame([(1, "they should leave"), (2, "hello"), (3, "hello"), (4, None)], "row_id long, text string")
    want = {1: 0.61, 2: 0.05, 3: 0.05, 4: 0.05}
    assert {r.row_id: round(r.score, 2) for r in C.score_with(df).collect()} == want

    def counting():
        class Once:
            seen = set()

            def predict_proba(self, texts):
                assert not self.seen.intersection(texts), "a text is scored once"
                self.seen.update(texts)
                return [len(t) / 100 for t in texts]

        return Once()

    built = C.choose("own", kinds={"own": C.Kind((), counting)})
    assert {r.row_id: r.score for r in C.score_with(df, built.make).collect()} == {1: 0.17, 2: 0.05, 3: 0.05, 4: 0.0}


# ------------------------------------------------------------------ releases


NAMED = "Mira Stone from Riverton High wrote: they do not hate the jewish people, mail mira.example@test.invalid now"


def released(spark, rows, settings, name="releases", columns="row_id long, text string, target_groups string"):
    return release.derive(spark.createDataFrame(rows, columns), name, settings).collect()


def test_releases_mask_identifiers(spark):
    rows = released(spark, [(1, NAMED, ""), (2, None, ""), (3, "", "")], release.Settings(lexicon=L.conformance(), radius=10))
    got = {(r.row_id, r.variant): r.released_text for r in rows}
    assert len(got) == 18 and got[1, "raw"] == NAMED
    assert got[1, "pii_mask"] == "[PERSON] from Riverton High wrote: they do not hate the jewish people, mail [EMAIL] now"
    assert got[1, "pii_quasi_mask"].startswith("[PERSON] from [SCHOOL] [SOURCE_MARKER]: they")
    for v in ("importance_only", "importance_window", "context"):
        assert not any(x in got[1, v] for x in ("Mira", "Riverton", "test.invalid")) and "hate" in got[1, v]
        assert got[2, v] == got[3, v] == release.NOTHING
    assert got[2, "pii_mask"] == got[3, "raw"] == ""
    assert "[EMAIL]" in got[1, "importance_window"]  # inside the window, replaced


def test_anchors_and_windows(spark):
    text = "we should ban vermin but not hate anyone here"
    one = release.Settings(lexicon=L.conformance(), top_k=1, share=1.0)
    anchors = released(spark, [(1, text, "")], one, "anchors")
    assert [(a.idx, a.tok) for a in anchors] == [(2, "ban")] and abs(anchors[0].delta - 0.28) < 1e-9
    narrow, wide = (released(spark, [(1, text, "")], release.Settings(lexicon=L.conformance(), top_k=1, share=1.0, radius=r), "release_importance_window")[0].released_text for r in (1, 3))
    assert narrow == "should ban vermin" and wide == "we should ban vermin but not"
    context = released(spark, [(1, text, "")], one, "release_context")[0].released_text
    assert "not hate" in context
    # A scorer of one's own in place of the lexicon.
    mine = release.Settings(lexicon=L.conformance(), top_k=1, share=1.0, scorer=lambda texts: [0.9 if "anyone" in t else 0.1 for t in texts])
    assert [a.tok for a in released(spark, [(1, text, "")], mine, "anchors")] == ["anyone"]
    # No token may be an anchor: cue tokens stand in, harm first.
    quiet = release.Settings(lexicon=L.Lexicon(["to"], ["of"], [], [], [], ["zzz"]))
    assert [(r.idx, r.tok) for r in released(spark, [(1, "to of the", "")], quiet, "cue_fallback")] == [(1, "of"), (0, "to")]


def test_groups_of_the_row(spark):
    rows = [(1, "green folk and people", "green-folk|none"), (2, "green folk and people", "")]
    cues = {(r.row_id, r.tok): r.cue for r in released(spark, rows, release.Settings(lexicon=L.conformance()), "cues")}
    assert cues == {(1, "green"): "TARGET_CUE", (1, "folk"): "TARGET_CUE"} | {(i, "people"): c for i in (1, 2) if (c := cues.get((i, "people")))}
    assert release.group_terms("a_bc/def|NaN|Women") == {"a bc def", "def", "women"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab !'ß", max_size=30), max_size=6), st.integers(0, 3))
def test_blocks_equal_rows_alone(texts, radius):
    """What a row yields does not depend on its neighbours in the block."""
    lex = L.Lexicon(["a"], ["b"], ["ab"], ["!"], ["bb"], ["aa", "b"])
    chosen = release.Settings(lexicon=lex, radius=radius, gap=2, merge_gap=3)
    for name, (_, make) in release.RELATIONS.items():
        rows = {"text": texts, "binary_label": [1] * len(texts)}
        together = sorted(zip(*[list(map(str, x)) for x in make(release.Block(rows, chosen))]))
        alone = []
        for i, t in enumerate(texts):
            alone += [(str(i), *r[1:]) for r in zip(*[list(map(str, x)) for x in make(release.Block({"text": [t], "binary_label": [1]}, chosen))])]
        assert together == sorted(alone), name


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 6)), max_size=12), st.integers(0, 5))
def test_merged_and_touched(raw, gap):
    import numpy as np

    s, e = np.array([a for a, _ in raw], int), np.array([a + n for a, n in raw], int)
    ms, me = release.merged(s, e, gap)
    inside = lambda x: any(a <= x < b for a, b in zip(ms, me))
    assert all(inside(x) for a, b in zip(s, e) for x in range(a, b)) and all(b + gap < c for b, c in zip(me, ms[1:]))
    for a, n in ((3, 2), (10, 5), (0, 50)):
        assert release.touched(np.array([a]), np.array([a + n]), *release.merged(s, e, 0))[0] == any(x < a + n and a < y for x, y in zip(s, e))


def test_releases_do_not_shuffle(spark):
    import __spark_entry__ as entry

    for name, most in (("b1_tokenize", 0), ("g3_anchors", 0), ("h10_context", 0), ("j3_flip_rate", 1)):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most + 2 * plan.count("SortMergeJoin"), name


def test_masks_cover_detected_identifiers(spark):
    import __spark_entry__ as entry
    from veilspan.plans import dialect

    sf = "/root/testdata/sf0.001"
    subject = {r.row_id: r for r in dialect.run(spark, sf, lambda q: "SELECT * FROM subject", ("subject",)).collect()}
    got = {r.row_id: r.released_text for r in entry.queries()["h7_pii_mask"](spark, sf).collect()}
    assert got.keys() == subject.keys()
    own = {v for vs in (L.EMAILS, L.HANDLES, L.PHONES, L.PEOPLE) for v in vs}
    seen = 0
    for i, row in subject.items():
        for s in identify.resolve(identify.candidates(row.text)):
            literal = row.text[s["start"] : s["end"]]
            seen += s["label"] in ("EMAIL", "IP") and literal not in own
            assert s["label"] not in ("EMAIL", "IP", "URL") or literal not in got[i]
        for g in row.gold:
            assert g.label not in ("PERSON", "EMAIL") or row.text[g.start : g.end] not in got[i]
    assert seen
    rates = {(r.variant, r.kind): r.residual_rate for r in entry.queries()["j8_residual_rates"](spark, sf).collect()}
    assert rates["raw", "direct"] == 1.0 and rates["pii_mask", "direct"] <= 0.05 and rates["pii_quasi_mask", "quasi"] <= 0.05 < rates["pii_mask", "quasi"]
    found = {(r.variant, r.label): r.n for r in entry.queries()["j9_detector_residuals"](spark, sf).collect()}
    assert found["raw", "EMAIL"] > 0 and ("pii_mask", "EMAIL") not in found


def test_pattern_and_phrase_spans_are_all_hits(spark):
    import __spark_entry__ as entry
    from veilspan.plans import dialect

    sf, queries = "/root/testdata/sf0.001", entry.queries()
    texts = {r.row_id: r.text for r in dialect.run(spark, sf, lambda q: "SELECT row_id, text FROM injected", ("injected",)).collect()}
    want = sorted((i, s["label"], t[s["start"] : s["end"]], s["start"], s["end"]) for i, t in texts.items() for s in identify.candidates(t) if s["source"] == "regex")
    assert sorted((r.row_id, r.label, r.lit, r.s, r.e) for r in queries["d1_pattern_spans"](spark, sf).collect()) == want
    assert {"HANDLE", "PHONE", "DATE", "FAMILY_RELATION"} <= {w[1] for w in want}
    phrases = sorted((i, s["label"], t[s["start"] : s["end"]].lower(), s["start"]) for i, t in texts.items() for s in identify.candidates(t) if s["source"] == "phrase")
    assert sorted((r.row_id, r.label, r.phrase, r.s) for r in queries["d2_phrase_spans"](spark, sf).collect()) == phrases
    df = spark.createDataFrame([(1, "the haunted Aunt met an aunt, cousins and a cousin")], "row_id long, text string")
    assert [(f.phrase, f.s) for f in identify.phrase_rows(df).first().found] == [("cousin", 44), ("aunt", 12), ("aunt", 24)]


def test_tokens_of_distinct_words():
    """Cutting each distinct word once gives the tokens of the whole texts, and tidying by replacement what the patterns give."""
    texts = ["http://a.b/c?d www.x.y, me@x.org. [TAG] [tag] #a_b @me @", " \n\x1c", "", None, "don't well-known été ıſ 3.5/4 (a ) 　`` x '' y ' z \"", "don't [TAG]\x85me@x.org a#b a@b ://"]
    b = release.Block({"text": texts, "target_groups": [None, "", "x|none", "been_there", "well-known", "me"]}, release.Settings())
    want = [(r, m.start(), m.end(), m.group()) for r, t in enumerate(texts) for m in re.finditer(L.TOKEN, t or "")]
    base = b.base[b.row]
    assert list(zip(b.row.tolist(), (b.s - base).tolist(), (b.e - base).tolist(), b.tok)) == want
    assert b.low == [t.lower() for *_, t in want]
    for text in filter(None, texts):
        out = re.sub(r"\s+([)])", r"\1", re.sub(r"([(])\s+", r"\1", re.sub(r"\s+([,.;:!?%])", r"\1", re.sub(r"\s+", " ", text.strip())))).strip()
        out = out.replace("`` ", '"').replace(" ''", '"').replace(" ' ", "'")
        assert release.tidy(text) == re.sub(r"\s+([\"'])", r" \1", out).strip()
