"""Rows, tokens, spans, importance, context expansion, rendering and metrics as relations."""

from __future__ import annotations

from veilspan.functions import lexicon as L
from veilspan.operators import release
from veilspan.plans.dialect import plan, relation

LEX = L.SYNTHETIC
VARIANTS, WHOLE_TEXT = release.VARIANTS, release.WHOLE_TEXT
_SET = release.Settings()
TOP_K, MIN_DELTA, SHARE, RADIUS, GAP, MERGE_GAP = _SET.top_k, _SET.min_delta, _SET.share, _SET.radius, _SET.gap, _SET.merge_gap

# ---------------------------------------------------------------- sources (A)


@relation("rows")
def _(q):
    return """SELECT d.doc_id AS row_id, 'documents' AS dataset, d.lang AS split, coalesce(d.text, '') AS text, d.source AS functionality, l.toxic AS binary_label
FROM @documents@ d LEFT JOIN @labels@ l ON d.doc_id = l.doc_id"""


@relation("unlabelled_rows")
def _(q):
    return "SELECT doc_id AS row_id, 'documents' AS dataset, lang AS split, coalesce(text, '') AS text, source AS functionality, CAST(NULL AS INT) AS binary_label FROM @documents@"


@plan("a2_smoke_rows")
def _(q):
    rows = [("'smoke-1'", "'They said not to ban anyone from the forum.'", "0"), ("'smoke-2'", "'Those people should leave and be banned.'", "1"), ("'smoke-3'", "'We condemned the threat against the group.'", "0"), ("'smoke-4'", "'The meeting is on Friday at 8pm.'", "0")]
    return q.values(rows, "row_id, text, binary_label")


@plan("a5_toxicity_scores")
def _(q):
    return f"""SELECT event_id AS row_id, CASE WHEN s >= {q.d(0.5)} THEN 1 ELSE 0 END AS binary_label, s AS toxicity
FROM (SELECT event_id, coalesce(value / (1 + abs(value)), {q.d(0.0)}) AS s FROM @events@)"""


def _group_array(q, column):
    parts = ", ".join(f"CASE WHEN {q.matches(column, r'(^|[^\p{L}\p{N}_])(' + '|'.join(terms) + r')($|[^\p{L}\p{N}_])')} THEN {q.text(group)} END" for group, terms in L.TARGET_TERMS.items())
    return q.keep(f"array({parts})" if q.name == "spark" else f"[{parts}]", "g", "g IS NOT NULL")


@relation("grouped_rows", "rows")
def _(q):
    # Group names are added to some texts, as the invented prose names none.
    tail = "CASE row_id % 7 WHEN 0 THEN ' Jewish and Muslim women' WHEN 1 THEN ' black people, gay' WHEN 2 THEN ' immigrants' ELSE '' END"
    return f"SELECT row_id, split, lower(concat(text, {tail})) AS low FROM rows"


@plan("a6_target_groups", "grouped_rows")
def _(q):
    return f"SELECT row_id, {q.join_text(_group_array(q, 'low'), '|')} AS target_groups FROM grouped_rows"


@relation("tox_spans", "cues")
def _(q):
    # A stringified offset list, as span corpora have it: the first and last character of each cue token.
    offsets = q.join_text(q.collect("CONCAT(CAST(s AS STRING), ',', CAST(e - 1 AS STRING))", "idx"), ",")
    return f"SELECT row_id, concat('[', {offsets}, ']') AS position FROM cues GROUP BY row_id"


@plan("a7_char_offset_mask", "tox_spans", "tokens")
def _(q):
    nums = q.findall("position", "[0-9]+")
    return f"""SELECT t.row_id, t.idx, t.tok, CASE WHEN {q.size(q.keep('p.nums', 'c', 'CAST(c AS INT) >= t.s AND CAST(c AS INT) < t.e'))} > 0 THEN 1 ELSE 0 END AS mask
FROM tokens t LEFT JOIN (SELECT row_id, {nums} AS nums FROM tox_spans) p ON t.row_id = p.row_id"""


@relation("sampled", "rows")
def _(q):
    return "SELECT row_id, split, functionality FROM rows ORDER BY md5(concat('17:', CAST(row_id AS STRING))), row_id LIMIT 100"


@plan("a8_sample_rows", "sampled")
def _(q):
    return "SELECT row_id, split FROM sampled ORDER BY row_id"


@plan("a9_union_stress", "rows", "sampled")
def _(q):
    return "SELECT 'main' AS part, row_id FROM rows UNION ALL SELECT 'stress' AS part, row_id FROM sampled"


@plan("a10_dataset_profile", "rows", "grouped_rows")
def _(q):
    return f"""SELECT 'split' AS kind, split AS value, count(*) AS n FROM rows GROUP BY split
UNION ALL SELECT 'label' AS kind, coalesce(CAST(binary_label AS STRING), 'none') AS value, count(*) AS n FROM rows GROUP BY binary_label
UNION ALL SELECT 'dataset' AS kind, dataset AS value, count(*) AS n FROM rows GROUP BY dataset
UNION ALL SELECT kind, value, n FROM (SELECT 'target' AS kind, g AS value, count(*) AS n FROM ({q.explode('(SELECT row_id, ' + _group_array(q, 'low') + ' AS gs FROM grouped_rows) AS _g', 'gs', 'row_id', 'g', 'gi')}) AS _e GROUP BY g ORDER BY n DESC, value LIMIT 20)"""


@plan("a13_csv_coercion")
def _(q):
    blank = "CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(CAST(round(value) AS INT) AS STRING) END"
    return f"SELECT event_id, TRY_CAST(nullif({blank}, '') AS INT) AS value FROM @events@"


@plan("a14_resume", "rows", "sampled")
def _(q):
    return "SELECT r.row_id FROM rows r LEFT ANTI JOIN sampled s ON r.row_id = s.row_id" if q.name == "spark" else "SELECT r.row_id FROM rows r ANTI JOIN sampled s ON r.row_id = s.row_id"


# ---------------------------------------------------------------- tokens and text functions (B)


@relation("tok_lists", "subject")
def _(q):
    return f"SELECT row_id, {q.findall('text', L.TOKEN)} AS toks, {q.pieces('text', L.TOKEN)} AS gaps FROM subject"


@relation("tok_rows", "tok_lists")
def _(q):
    if q.name == "spark":
        return "SELECT row_id, CAST(idx AS INT) AS idx, tok, get(gaps, idx) AS gap FROM tok_lists LATERAL VIEW posexplode(toks) _x AS idx, tok"
    return "SELECT row_id, CAST(i AS INT) AS idx, toks[i + 1] AS tok, gaps[i + 1] AS gap FROM (SELECT *, unnest(range(len(toks))) AS i FROM tok_lists)"


@relation("tokens", "tok_rows")
def _(q):
    run = "sum(length(gap) + length(tok)) OVER (PARTITION BY row_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    return f"SELECT row_id, idx, tok, low, CAST(e - length(tok) AS INT) AS s, CAST(e AS INT) AS e FROM (SELECT row_id, idx, tok, lower(tok) AS low, {run} AS e FROM tok_rows)"


@plan("b1_tokenize", "tokens")
def _(q):
    return "SELECT row_id, idx, tok, s, e FROM tokens"


def detached(q, column):
    """Space before closing marks and inside brackets removed, paired quotes made plain."""
    out = q.sub(q.sub(q.sub(column, r"\s+([,.;:!?%])", "$1"), r"([(])\s+", "$1"), r"\s+([)])", "$1")
    return f"replace(replace({out}, {q.text('`` ')}, {q.text(chr(34))}), {q.text(chr(32) + chr(39) * 2)}, {q.text(chr(34))})"


def cleaned(q, column):
    out = detached(q, f"trim({q.sub(column, r'\s+', ' ')})")
    out = f"replace({out}, {q.text(chr(32) + chr(39) + chr(32))}, {q.text(chr(39))})"
    return f"trim({q.sub(out, r'\s+([' + chr(34) + chr(39) + '])', ' $1')})"


@plan("b2_reconstruct", "tok_lists")
def _(q):
    return f"SELECT row_id, trim({detached(q, q.join_text('toks', ' '))}) AS text FROM tok_lists"


@plan("b3_cleanup", "rows")
def _(q):
    return f"SELECT row_id, {cleaned(q, 'text')} AS cleaned FROM rows"


@plan("b4_alnum_tokens", "tok_lists")
def _(q):
    return f"SELECT row_id, CAST({q.size(q.keep('toks', 't', q.matches('t', r'[\p{L}\p{N}]')))} AS INT) AS n FROM tok_lists"


@plan("b5_word_tokens", "rows")
def _(q):
    return f"SELECT row_id, CAST({q.size(q.findall('text', r'[\p{L}\p{N}_]+'))} AS INT) AS n FROM rows"


@plan("b6_normalized", "rows")
def _(q):
    return f"SELECT row_id, {q.sub('lower(text)', chr(91) + '^a-z0-9' + chr(39) + ']+', '')} AS normalized FROM rows"


@plan("b7_fragmentary", "releases")
def _(q):
    n = q.size(q.findall("x", r"[\p{L}\p{N}_]+"))
    return f"""SELECT row_id, variant, {q.matches('x', r'^[.,;:]|[,;:]$')} AS is_fragmentary,
({n} <= 4 OR x LIKE '...%' OR x LIKE '%...' OR {q.size(q.findall('x', r'[.][.][.]'))} >= 2) AS looks_fragmentary FROM (SELECT row_id, variant, released_text AS x FROM releases) r"""


@plan("b8_label_tokens", "rows")
def _(q):
    split = "split(lower(functionality || '/' || split || '-label x'), '[ /-]')" if q.name == "spark" else "regexp_split_to_array(lower(functionality || '/' || split || '-label x'), '[ /-]')"
    return f"SELECT row_id, {q.join_text(q.sort(q.distinct(q.keep(split, 't', 'length(t) > 3'))), '|')} AS toks FROM rows"


@relation("gram_lists", "rows")
def _(q):
    return f"SELECT row_id, w, {q.grams('w', 3)} AS g3, {q.grams('w', 5)} AS g5 FROM (SELECT row_id, {q.findall('lower(text)', r'[\p{L}\p{N}]+')} AS w FROM rows)"


@plan("b10_ngrams", "gram_lists")
def _(q):
    return f"SELECT row_id, CAST({q.size('g3')} AS INT) AS n3, CAST({q.size('g5')} AS INT) AS n5 FROM gram_lists"


# ---------------------------------------------------------------- cues (E) and scores (F)


@relation("lexicon")
def _(q):
    return q.values([(q.text(label), q.text(term)) for label, term in LEX.labelled()], "cue, term")


@relation("group_terms", "subject")
def _(q):
    # The terms that a row's own target groups add: their names, and the longer words of these.
    return """SELECT DISTINCT row_id, unnest(list_prepend(name, list_filter(string_split(name, ' '), lambda w: length(w) > 2))) AS term FROM (
SELECT row_id, trim(regexp_replace(lower(g), '[_/-]+', ' ', 'g')) AS name FROM (SELECT row_id, unnest(string_split(target_groups, '|')) AS g FROM subject)) x WHERE name NOT IN ('', 'none', 'other', 'nan')"""


@relation("cues", "tokens", "lexicon", "group_terms")
def _(q):
    return """SELECT t.row_id, t.idx, t.tok, t.low, t.s, t.e, CASE WHEN g.term IS NOT NULL THEN 'TARGET_CUE' ELSE x.cue END AS cue
FROM tokens t LEFT JOIN lexicon x ON t.low = x.term LEFT JOIN group_terms g ON t.row_id = g.row_id AND t.low = g.term WHERE x.cue IS NOT NULL OR g.term IS NOT NULL"""


@plan("e6_cue_labels", "cues")
def _(q):
    return "SELECT row_id, idx, tok, cue FROM cues"


@plan("e7_cue_indexes", "cues")
def _(q):
    return "SELECT row_id, cue, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM cues GROUP BY row_id, cue"


@relation("stance_rows", "cues")
def _(q):
    return "SELECT row_id, bool_or(cue IN ('NEGATION_CUE', 'QUOTE_CUE', 'COUNTERSPEECH_CUE')) AND bool_or(cue = 'HARM_CUE') AS relevant FROM cues GROUP BY row_id"


@plan("e8_stance_relevant", "rows", "stance_rows")
def _(q):
    return "SELECT r.row_id, coalesce(s.relevant, false) AS relevant FROM rows r LEFT JOIN stance_rows s ON r.row_id = s.row_id"


def _hits(q, column):
    return " + ".join(f"CASE WHEN contains({column}, {q.text(c)}) THEN 1 ELSE 0 END" for c in LEX.classifier)


def score_of(q, hits):
    return f"least({q.d(1.0)}, {q.d(L.BASE_SCORE)} + ({hits}) * {q.d(L.CUE_SCORE)})"


@relation("row_hits", "subject")
def _(q):
    return f"SELECT row_id, low, {_hits(q, 'low')} AS hits FROM (SELECT row_id, lower(text) AS low FROM subject)"


@relation("scores", "row_hits")
def _(q):
    return f"SELECT row_id, hits, {score_of(q, 'hits')} AS score FROM row_hits"


@plan("f3_lexicon_score", "scores")
def _(q):
    return "SELECT row_id, hits, score FROM scores"


@plan("f2_memoized_score", "rows")
def _(q):
    # Distinct texts are known by a digest, so no text is a join key.
    return f"""SELECT r.row_id, m.score FROM (SELECT row_id, md5(text) AS digest FROM rows) r
JOIN (SELECT digest, {score_of(q, _hits(q, 'lower(t)'))} AS score FROM (SELECT md5(text) AS digest, min(text) AS t FROM rows GROUP BY md5(text)) d) m ON r.digest = m.digest"""


# ---------------------------------------------------------------- importance (G)


@relation("eligible", "tokens", "identifiers")
def _(q):
    fit = f"{q.matches('tok', r'[\p{L}\p{N}]')} AND NOT (tok LIKE '[%' AND tok LIKE '%]') AND NOT {q.in_list('low', L.STOPWORDS)}"
    return f"""SELECT t.row_id, t.idx, t.tok, t.s, t.e FROM (SELECT * FROM tokens WHERE {fit}) t
LEFT JOIN (SELECT DISTINCT t.row_id, t.idx FROM tokens t JOIN identifiers i ON t.row_id = i.row_id AND t.s < i.e AND i.s < t.e) x ON t.row_id = x.row_id AND t.idx = x.idx WHERE x.idx IS NULL"""


@plan("g1_eligible", "eligible")
def _(q):
    return "SELECT row_id, idx, tok FROM eligible"


@relation("occurrences", "row_hits")
def _(q):
    # First and last place of each cue: a token that touches both touches all between.
    cues = q.values([(q.text(c),) for c in LEX.classifier], "cue")
    return f"""SELECT h.row_id, c.cue, {q.position('h.low', 'c.cue')} - 1 AS fs, {q.position('h.low', 'c.cue')} - 1 + length(c.cue) AS fe,
length(h.low) - {q.position('reverse(h.low)', 'reverse(c.cue)')} + 1 - length(c.cue) AS ls, length(h.low) - {q.position('reverse(h.low)', 'reverse(c.cue)')} + 1 AS le
FROM (SELECT * FROM row_hits WHERE hits > 0) h JOIN ({cues}) c ON contains(h.low, c.cue)"""


@relation("lost", "eligible", "occurrences")
def _(q):
    return """SELECT t.row_id, t.idx, count(*) AS lost FROM eligible t JOIN occurrences o ON t.row_id = o.row_id
WHERE t.s < o.fe AND o.fs < t.e AND t.s < o.le AND o.ls < t.e GROUP BY t.row_id, t.idx"""


@relation("importance", "eligible", "lost", "scores")
def _(q):
    return f"""SELECT t.row_id, t.idx, t.tok, t.s, t.e, c.score AS baseline, {score_of(q, 'c.hits - coalesce(x.lost, 0)')} AS perturbed,
c.score - {score_of(q, 'c.hits - coalesce(x.lost, 0)')} AS delta
FROM eligible t JOIN scores c ON t.row_id = c.row_id LEFT JOIN lost x ON t.row_id = x.row_id AND t.idx = x.idx"""


@plan("g2_importance", "importance")
def _(q):
    return "SELECT row_id, idx, tok, baseline, perturbed, delta FROM importance"


@relation("token_counts", "tok_lists")
def _(q):
    return f"SELECT row_id, CAST({q.size('toks')} AS INT) AS n_tokens FROM tok_lists"


@relation("anchors", "importance", "token_counts")
def _(q):
    passing = f"delta >= {q.d(MIN_DELTA)}"
    return f"""SELECT row_id, idx, tok, s, e, delta FROM (
SELECT i.row_id, i.idx, i.tok, i.s, i.e, i.delta, n.n_tokens,
row_number() OVER (PARTITION BY i.row_id ORDER BY i.delta DESC, i.idx) AS pick,
sum(CASE WHEN {passing} THEN 1 ELSE 0 END) OVER (PARTITION BY i.row_id) AS passing
FROM importance i JOIN token_counts n ON i.row_id = n.row_id) ranked
WHERE pick <= least({TOP_K}, greatest(1, CAST(floor({q.d(SHARE)} * n_tokens) AS INT))) AND (passing = 0 OR {passing})"""


@plan("g3_anchors", "anchors")
def _(q):
    return "SELECT row_id, idx, tok, delta FROM anchors"


@relation("cue_fallback", "cues", "anchors")
def _(q):
    return f"""SELECT row_id, idx, tok, s, e FROM (SELECT c.row_id, c.idx, c.tok, c.s, c.e, row_number() OVER (PARTITION BY c.row_id ORDER BY CASE cue WHEN 'HARM_CUE' THEN 0 ELSE 1 END, c.idx) AS pick
FROM cues c LEFT JOIN (SELECT DISTINCT row_id FROM anchors) a ON c.row_id = a.row_id WHERE cue IN ('HARM_CUE', 'TARGET_CUE') AND a.row_id IS NULL) x WHERE pick <= {TOP_K}"""


@plan("g4_cue_fallback", "cue_fallback")
def _(q):
    return "SELECT row_id, idx FROM cue_fallback"


@relation("chosen", "anchors", "cue_fallback")
def _(q):
    return "SELECT row_id, idx, tok, s, e FROM anchors UNION ALL SELECT row_id, idx, tok, s, e FROM cue_fallback"


# ---------------------------------------------------------------- span algebra (C)


def merged(source, gap, label="NULL"):
    """Spans of `source` (row_id, s, e) joined where one starts at most `gap` after the others' end."""
    return f"""SELECT row_id, CAST(min(s) AS INT) AS s, CAST(max(e) AS INT) AS e FROM (
SELECT row_id, s, e, sum(opens) OVER (PARTITION BY row_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT row_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY row_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS opens
FROM (SELECT DISTINCT row_id, s, e FROM {source}) u) f) g GROUP BY row_id, island"""


@relation("cue_spans", "cues")
def _(q):
    return "SELECT row_id, s, e, cue AS label FROM cues"


@plan("c1_overlaps", "cue_spans", "anchors")
def _(q):
    return "SELECT a.row_id, a.idx, c.s, c.e, c.label FROM anchors a JOIN cue_spans c ON a.row_id = c.row_id AND a.s < c.e AND c.s < a.e"


@plan("c2_merge_spans", "cue_spans")
def _(q):
    return f"""SELECT row_id, CAST(min(s) AS INT) AS s, CAST(max(e) AS INT) AS e, CASE WHEN min(label) = max(label) THEN min(label) ELSE 'MERGED' END AS label FROM (
SELECT row_id, s, e, label, sum(opens) OVER (PARTITION BY row_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT row_id, s, e, label, CASE WHEN s <= max(e) OVER (PARTITION BY row_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 4 THEN 0 ELSE 1 END AS opens FROM cue_spans) f) g GROUP BY row_id, island"""


@plan("c4_filter_labels", "cue_spans")
def _(q):
    return "SELECT row_id, s, e, label FROM cue_spans WHERE label IN ('HARM_CUE', 'TARGET_CUE')"


@relation("kept_tokens", "tokens", "only_kept")
def _(q):
    return "SELECT DISTINCT t.row_id, t.idx FROM tokens t JOIN only_kept k ON t.row_id = k.row_id AND t.s < k.e AND k.s < t.e"


@plan("c5_token_overlaps", "kept_tokens")
def _(q):
    return "SELECT row_id, idx FROM kept_tokens"


@plan("c6_token_spans", "anchors")
def _(q):
    return "SELECT DISTINCT row_id, s, e, 'ANCHOR' AS label FROM anchors"


def framed(radius):
    return f"""SELECT row_id, idx, CAST(min(s) OVER (PARTITION BY row_id ORDER BY idx ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS INT) AS s,
CAST(max(e) OVER (PARTITION BY row_id ORDER BY idx ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS INT) AS e FROM tokens"""


@relation("frames", "tokens")
def _(q):
    return framed(RADIUS)


@relation("anchor_windows", "frames", "chosen")
def _(q):
    return "SELECT f.row_id, f.idx, f.s, f.e FROM frames f JOIN chosen a ON f.row_id = a.row_id AND f.idx = a.idx"


@plan("c7_token_windows", "anchor_windows")
def _(q):
    return merged("anchor_windows", 1)


@plan("c8_window_primitives", "anchor_windows")
def _(q):
    return "SELECT row_id, idx, s, e, 'EVIDENCE_WINDOW' AS label FROM anchor_windows"


@plan("c9_span_text", "identifiers", "subject")
def _(q):
    known = q.in_list("c.label", [*L.DIRECT, *L.QUASI])
    return f"SELECT c.row_id, c.s, substring(r.text, c.s + 1, c.e - c.s) AS span_text, CASE WHEN {known} THEN concat('[', c.label, ']') ELSE '[IDENTIFIER]' END AS replacement FROM identifiers c JOIN subject r ON c.row_id = r.row_id"


@plan("c10_full_span", "subject")
def _(q):
    return "SELECT row_id, 0 AS s, length(text) AS e FROM subject WHERE length(text) > 0"


# ---------------------------------------------------------------- context expansion and variants (H)


@relation("anchor_or_harm", "cues", "chosen")
def _(q):
    return "SELECT row_id, idx, s, e FROM chosen UNION SELECT row_id, idx, s, e FROM cues WHERE cue = 'HARM_CUE'"


@relation("h1", "anchor_windows", "chosen", "cues")
def _(q):
    return """SELECT row_id, s, e FROM anchor_windows UNION
SELECT a.row_id, a.s, a.e FROM chosen a JOIN cues c ON a.row_id = c.row_id AND a.idx = c.idx AND c.cue IN ('TARGET_CUE', 'HARM_CUE')"""


@plan("h1_anchor_windows", "h1")
def _(q):
    return "SELECT row_id, s, e FROM h1"


@relation("h2", "cues", "anchor_or_harm")
def _(q):
    return f"SELECT t.row_id, least(t.s, x.s) AS s, greatest(t.e, x.e) AS e FROM cues t JOIN anchor_or_harm x ON t.row_id = x.row_id AND abs(t.idx - x.idx) <= {GAP} WHERE t.cue = 'TARGET_CUE'"


@plan("h2_target_harm", "h2")
def _(q):
    return "SELECT DISTINCT row_id, s, e FROM h2"


@relation("h3", "cues", "anchor_or_harm")
def _(q):
    return f"""SELECT row_id, s, e FROM (SELECT t.row_id, least(t.s, x.s) AS s, greatest(t.e, x.e) AS e,
row_number() OVER (PARTITION BY t.row_id, t.idx ORDER BY abs(t.idx - x.idx), x.idx) AS pick
FROM cues t JOIN anchor_or_harm x ON t.row_id = x.row_id AND abs(t.idx - x.idx) <= {GAP}
WHERE t.cue IN ('NEGATION_CUE', 'QUOTE_CUE', 'COUNTERSPEECH_CUE')) n WHERE pick = 1"""


@plan("h3_stance_nearest", "h3")
def _(q):
    return "SELECT DISTINCT row_id, s, e FROM h3"


@relation("h4", "cues")
def _(q):
    return f"""SELECT a.row_id, least(a.s, b.s) AS s, greatest(a.e, b.e) AS e FROM cues a JOIN cues b ON a.row_id = b.row_id AND abs(a.idx - b.idx) <= {GAP}
WHERE a.cue IN ('NEGATION_CUE', 'QUOTE_CUE', 'COUNTERSPEECH_CUE') AND b.cue = 'TARGET_CUE'"""


@plan("h4_stance_target", "h4")
def _(q):
    return "SELECT DISTINCT row_id, s, e FROM h4"


@relation("expanded", "h1", "h2", "h3", "h4")
def _(q):
    return "SELECT row_id, s, e FROM h1 UNION ALL SELECT row_id, s, e FROM h2 UNION ALL SELECT row_id, s, e FROM h3 UNION ALL SELECT row_id, s, e FROM h4"


@relation("context_kept", "expanded")
def _(q):
    return merged("expanded", MERGE_GAP)


@plan("h5_context_spans", "context_kept")
def _(q):
    return "SELECT row_id, s, e FROM context_kept"


@relation("only_kept", "chosen")
def _(q):
    return merged("chosen", 0)


@relation("window_kept", "anchor_windows")
def _(q):
    return merged("anchor_windows", 1)


@relation("kept", "subject", "only_kept", "window_kept", "context_kept")
def _(q):
    whole = " UNION ALL ".join(f"SELECT row_id, '{v}' AS variant, 0 AS s, length(text) AS e FROM subject WHERE length(text) > 0" for v in WHOLE_TEXT)
    return f"""{whole}
UNION ALL SELECT row_id, 'importance_only' AS variant, s, e FROM only_kept
UNION ALL SELECT row_id, 'importance_window' AS variant, s, e FROM window_kept
UNION ALL SELECT row_id, 'context' AS variant, s, e FROM context_kept"""


@relation("variants")
def _(q):
    return q.values([(f"'{v}'",) for v in VARIANTS], "variant")


@relation("mask_cuts", "kept", "identifiers")
def _(q):
    # Masks clipped to the kept spans they touch, and where the text before each begins.
    return f"""SELECT row_id, variant, ks, ms, me, label, coalesce(lag(me) OVER (PARTITION BY row_id, variant, ks ORDER BY ms), ks) AS since FROM (
SELECT k.row_id, k.variant, k.s AS ks, greatest(i.s, k.s) AS ms, least(i.e, k.e) AS me, i.label FROM kept k JOIN identifiers i ON k.row_id = i.row_id AND i.s < k.e AND k.s < i.e
WHERE k.variant <> 'raw' AND (k.variant <> 'pii_mask' OR {q.in_list('i.label', L.DIRECT)})) m"""


@relation("pieces", "kept", "mask_cuts", "subject")
def _(q):
    return """SELECT k.row_id, k.variant, k.s, trim(concat(coalesce(o.head, ''), substring(r.text, coalesce(o.upto, k.s) + 1, k.e - coalesce(o.upto, k.s)))) AS piece FROM kept k JOIN subject r ON k.row_id = r.row_id
LEFT JOIN (SELECT c.row_id, c.variant, c.ks, string_agg(concat(substring(r.text, c.since + 1, c.ms - c.since), '[', c.label, ']'), '' ORDER BY c.ms) AS head, max(c.me) AS upto
FROM mask_cuts c JOIN subject r ON c.row_id = r.row_id GROUP BY c.row_id, c.variant, c.ks) o ON k.row_id = o.row_id AND k.variant = o.variant AND k.s = o.ks WHERE k.variant <> 'raw'"""


@relation("releases", "subject", "pieces", "variants")
def _(q):
    joined = q.join_text(q.collect("piece", "s"), " ... ")
    return f"""SELECT r.row_id, v.variant, r.binary_label, r.split, r.functionality, r.text AS source_text,
CASE WHEN v.variant = 'raw' THEN r.text WHEN p.released IS NULL AND v.variant IN ('pii_mask', 'pii_quasi_mask') THEN '' WHEN p.released IS NULL THEN '[NO_TASK_EVIDENCE_RETAINED]' ELSE {cleaned(q, 'p.released')} END AS released_text
FROM subject r CROSS JOIN variants v LEFT JOIN (SELECT row_id, variant, {joined} AS released FROM pieces GROUP BY row_id, variant) p ON r.row_id = p.row_id AND v.variant = p.variant"""


for _key, _variant in (("h6_raw", "raw"), ("h7_pii_mask", "pii_mask"), ("h7_quasi_mask", "pii_quasi_mask"), ("h8_importance_only", "importance_only"), ("h9_importance_window", "importance_window"), ("h10_context", "context")):

    @relation(f"release_{_variant}", "releases")
    def _(q, variant=_variant):
        return f"SELECT row_id, released_text FROM releases WHERE variant = '{variant}'"

    @plan(_key, f"release_{_variant}")
    def _(q, variant=_variant):
        return f"SELECT row_id, released_text FROM release_{variant}"


@plan("h11_all_variants", "releases")
def _(q):
    return "SELECT row_id, variant, released_text FROM releases"


@relation("rendered", "releases", "kept")
def _(q):
    return "SELECT r.row_id, r.variant, length(r.released_text) AS n_chars, coalesce(k.n_spans, 0) AS n_spans FROM releases r LEFT JOIN (SELECT row_id, variant, count(*) AS n_spans FROM kept GROUP BY row_id, variant) k ON r.row_id = k.row_id AND r.variant = k.variant"


@plan("i1_render", "rendered")
def _(q):
    return "SELECT row_id, variant, CAST(n_chars AS INT) AS n_chars, CAST(n_spans AS INT) AS n_spans FROM rendered"


@plan("i2_render_masked", "release_pii_mask")
def _(q):
    return "SELECT row_id, released_text, CAST(length(released_text) AS INT) AS n_chars FROM release_pii_mask"


# ---------------------------------------------------------------- metrics (J)


@relation("retained", "kept", "tokens", "token_counts")
def _(q):
    semi = """SELECT t.row_id, k.variant, count(DISTINCT t.idx) AS kept_tokens FROM tokens t JOIN kept k ON t.row_id = k.row_id AND t.s < k.e AND k.s < t.e GROUP BY t.row_id, k.variant"""
    return f"SELECT n.row_id, x.variant, n.n_tokens, x.kept_tokens FROM token_counts n JOIN ({semi}) x ON n.row_id = x.row_id"


@relation("facts", "releases", "retained", "scores", "kept")
def _(q):
    hits = _hits(q, "lower(r.released_text)")
    return f"""SELECT r.row_id, r.variant, r.binary_label, r.split, r.functionality, r.released_text <> r.source_text AS changed, r.released_text = '[NO_TASK_EVIDENCE_RETAINED]' AS placeholder,
length(r.source_text) AS n_chars, coalesce(c.kept_chars, 0) AS kept_chars, coalesce(t.n_tokens, 0) AS n_tokens, coalesce(t.kept_tokens, 0) AS kept_tokens,
CAST({q.size(q.findall('r.released_text', L.TOKEN))} AS INT) AS out_tokens,
CASE WHEN s.score >= {q.d(0.5)} THEN 1 ELSE 0 END AS raw_pred, CASE WHEN {score_of(q, hits)} >= {q.d(0.5)} THEN 1 ELSE 0 END AS pred
FROM releases r JOIN scores s ON r.row_id = s.row_id LEFT JOIN retained t ON r.row_id = t.row_id AND r.variant = t.variant
LEFT JOIN (SELECT row_id, variant, sum(e - s) AS kept_chars FROM kept GROUP BY row_id, variant) c ON r.row_id = c.row_id AND r.variant = c.variant"""


@plan("j1_retained_ratios", "facts")
def _(q):
    return f"SELECT row_id, variant, CASE WHEN n_chars > 0 THEN CAST(floor(kept_chars * {q.d(1e6)} / n_chars) AS BIGINT) END AS char_ppm, CASE WHEN n_tokens > 0 THEN CAST(floor(kept_tokens * {q.d(1e6)} / n_tokens) AS BIGINT) END AS token_ppm FROM facts"


CONFUSION = """count_if(binary_label = 1 AND pred = 1) AS tp, count_if(binary_label = 0 AND pred = 1) AS fp, count_if(binary_label = 0 AND pred = 0) AS tn, count_if(binary_label = 1 AND pred = 0) AS fn"""


@plan("j2_confusion", "facts")
def _(q):
    return f"""SELECT variant, tp, fp, tn, fn, CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) END AS accuracy,
CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE {q.d(0.0)} END AS precision_pos, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE {q.d(0.0)} END AS recall_pos,
CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE {q.d(0.0)} END AS f1_pos,
CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / CAST(2 * tn + fp + fn AS DOUBLE) ELSE {q.d(0.0)} END AS f1_neg
FROM (SELECT variant, {CONFUSION} FROM facts GROUP BY variant) c"""


@plan("j3_flip_rate", "facts")
def _(q):
    return "SELECT variant, count(*) AS n, count_if(pred <> raw_pred) AS flips, count_if(pred <> raw_pred) / CAST(count(*) AS DOUBLE) AS flip_rate FROM facts GROUP BY variant"


@plan("j4_retained_pct", "facts")
def _(q):
    return f"""SELECT variant, CAST(sum(CASE WHEN n_tokens > 0 THEN CAST(floor(kept_tokens * {q.d(1e6)} / n_tokens) AS BIGINT) ELSE 0 END) AS BIGINT) AS token_ppm_sum,
CAST(sum(CASE WHEN n_chars > 0 THEN CAST(floor(kept_chars * {q.d(1e6)} / n_chars) AS BIGINT) ELSE 0 END) AS BIGINT) AS char_ppm_sum, count(*) AS n FROM facts GROUP BY variant"""


@plan("j5_output_tokens", "facts")
def _(q):
    return "SELECT variant, sum(out_tokens) / CAST(count(*) AS DOUBLE) AS mean_output_tokens, CAST(median(out_tokens) AS DOUBLE) AS median_output_tokens FROM facts GROUP BY variant"


@plan("j6_changed_rows", "facts")
def _(q):
    return "SELECT variant, count_if(changed) AS changed, count_if(placeholder) AS placeholder_only FROM facts GROUP BY variant"


@relation("gram_rows", "releases")
def _(q):
    after = lambda n: " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER p" for k in range(1, n))])
    return f"""SELECT row_id, variant, {after(3)} AS g3, {after(5)} AS g5 FROM (SELECT row_id, variant, i, lower(tok) AS w FROM (
SELECT row_id, variant, i, toks[i + 1] AS tok FROM (SELECT *, unnest(range(len(toks))) AS i FROM (SELECT row_id, variant, {q.findall('released_text', L.TOKEN)} AS toks FROM releases) a) b) c
WHERE {q.matches('tok', r'[\p{L}\p{N}]')}) d WINDOW p AS (PARTITION BY row_id, variant ORDER BY i)"""


@relation("gram_counts", "gram_rows", "releases")
def _(q):
    def counted(n):
        distinct = f"SELECT DISTINCT row_id, variant, g{n} AS g FROM gram_rows WHERE g{n} IS NOT NULL"
        return f"""(SELECT r.row_id, r.variant, coalesce(s.n, 0) AS source, coalesce(c.n, 0) AS common FROM releases r LEFT JOIN (SELECT row_id, count(*) AS n FROM ({distinct}) x WHERE variant = 'raw' GROUP BY row_id) s ON r.row_id = s.row_id
LEFT JOIN (SELECT y.row_id, y.variant, count(*) AS n FROM ({distinct}) y JOIN ({distinct}) x ON x.variant = 'raw' AND x.row_id = y.row_id AND x.g = y.g GROUP BY y.row_id, y.variant) c ON r.row_id = c.row_id AND r.variant = c.variant)"""

    return f"""SELECT a.row_id, a.variant, a.source AS n3_source, a.common AS n3_common, b.source AS n5_source, b.common AS n5_common
FROM {counted(3)} a JOIN {counted(5)} b ON a.row_id = b.row_id AND a.variant = b.variant"""


@plan("j7_ngram_retention", "gram_counts")
def _(q):
    ppm = lambda n: f"CAST(sum(CASE WHEN n{n}_source > 0 THEN CAST(floor(n{n}_common * {q.d(1e6)} / n{n}_source) AS BIGINT) ELSE 0 END) AS BIGINT)"
    return f"SELECT variant, count(*) AS n, CAST(sum(n3_source) AS BIGINT) AS n3_source, CAST(sum(n3_common) AS BIGINT) AS n3_common, CAST(sum(n5_source) AS BIGINT) AS n5_source, CAST(sum(n5_common) AS BIGINT) AS n5_common, {ppm(3)} AS ppm3_sum, {ppm(5)} AS ppm5_sum FROM gram_counts GROUP BY variant"


@relation("cue_preserved", "releases", "cues")
def _(q):
    return """SELECT r.row_id, r.variant, c.cue, bool_or(contains(lower(r.released_text), c.low)) AS preserved
FROM releases r JOIN (SELECT DISTINCT row_id, cue, low FROM cues) c ON r.row_id = c.row_id GROUP BY r.row_id, r.variant, c.cue"""


@plan("j10_cue_preservation", "cue_preserved")
def _(q):
    return "SELECT variant, cue, count(*) AS n_rows, count_if(preserved) AS n_preserved, count_if(preserved) / CAST(count(*) AS DOUBLE) AS rate FROM cue_preserved GROUP BY variant, cue"


@plan("j11_joint_preservation", "cue_preserved")
def _(q):
    stance = "cue IN ('NEGATION_CUE', 'QUOTE_CUE', 'COUNTERSPEECH_CUE')"
    return f"""SELECT variant, count_if(target AND harm) AS target_harm, count_if(target IS NOT NULL AND harm IS NOT NULL) AS n_target_harm,
count_if(stance AND harm) AS stance_harm, count_if(stance IS NOT NULL AND harm IS NOT NULL) AS n_stance_harm FROM (
SELECT row_id, variant, bool_or(CASE WHEN cue = 'TARGET_CUE' THEN preserved END) AS target, bool_or(CASE WHEN cue = 'HARM_CUE' THEN preserved END) AS harm,
bool_or(CASE WHEN {stance} THEN preserved END) AS stance FROM cue_preserved GROUP BY row_id, variant) p GROUP BY variant"""


@relation("rationale", "cues", "kept", "variants")
def _(q):
    # The cue tokens stand for the marked tokens of an annotator.
    return """SELECT t.row_id, t.idx, v.variant, bool_or(k.s IS NOT NULL) AS hit FROM (SELECT DISTINCT row_id, idx, s, e FROM cues) t CROSS JOIN variants v
LEFT JOIN kept k ON t.row_id = k.row_id AND v.variant = k.variant AND t.s < k.e AND k.s < t.e GROUP BY t.row_id, t.idx, v.variant"""


@plan("j12_rationale_overlap", "rationale")
def _(q):
    return "SELECT variant, count(*) AS n_mask, count_if(hit) AS n_overlapped FROM rationale GROUP BY variant"


@plan("j13_grouped_metrics", "facts")
def _(q):
    return f"""SELECT group_type, group_name, variant, n, tp, fp, tn, fn, flips FROM (
SELECT CASE WHEN grouping(functionality) = 0 THEN 'functionality' ELSE 'split' END AS group_type, CASE WHEN grouping(functionality) = 0 THEN functionality ELSE split END AS group_name, variant, count(*) AS n, {CONFUSION}, count_if(pred <> raw_pred) AS flips
FROM facts GROUP BY GROUPING SETS ((functionality, variant), (split, variant))) g WHERE group_name IS NOT NULL"""


@plan("j14_context_breakdown", "facts")
def _(q):
    return "SELECT functionality, variant, count(*) AS row_count, sum(kept_tokens) AS kept_tokens, sum(n_tokens) AS n_tokens, sum(out_tokens) AS out_tokens FROM facts GROUP BY functionality, variant"
