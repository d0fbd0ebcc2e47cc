"""Identifiers, annotations, judges, paired statistics, review sheets and run-level analytics as relations."""

from __future__ import annotations

from veilspan.functions import lexicon as L
from veilspan.plans import core
from veilspan.plans.dialect import plan, relation

# ---------------------------------------------------------------- identifiers (D)


def pick(q, salt, values):
    """One of `values` by a digest of the row id."""
    number = q.hex_number(f"substring(md5(concat('{salt}:', CAST(row_id AS STRING))), 1, 8)")
    return q.at(q.array(values), f"CAST({number} % {len(values)} AS INT)")


@relation("draws", "rows")
def _(q):
    named = {"template": L.TEMPLATES, "handle": L.HANDLES, "person": L.PEOPLE, "school": L.SCHOOLS, "email": L.EMAILS, "date": L.DATES, "city": L.LOCATIONS, "relation": L.FAMILY_RELATIONS, "phone": L.PHONES, "workplace": L.WORKPLACES, "event": L.EVENTS}
    return "SELECT row_id, split, functionality, binary_label, text, " + ", ".join(f"{pick(q, '17-' + k, v)} AS p_{k}" for k, v in named.items()) + " FROM rows"


@relation("injected", "draws")
def _(q):
    return """SELECT row_id, split, functionality, binary_label, p_template AS template, p_handle, p_person, p_school, p_email, p_date, p_city, p_relation, p_phone, p_workplace, p_event, CASE p_template
WHEN 'handle_prefix' THEN concat(p_handle, ' said: ', text)
WHEN 'person_school_prefix' THEN concat(p_person, ' from ', p_school, ' wrote: ', text)
WHEN 'date_city_prefix' THEN concat('On ', p_date, ', ', p_person, ' in ', p_city, ' posted: ', text)
WHEN 'family_prefix' THEN concat('My ', p_relation, ' ', p_person, ' (', p_phone, ') said ', text)
WHEN 'workplace_suffix' THEN concat(text, ' - shared near ', p_workplace, ' after the ', p_event)
ELSE concat(text, ' Contact: ', p_email) END AS text, length(text) AS n FROM draws"""


#: What each template puts in: (template, label, value, start).
GOLD = [
    ("handle_prefix", "HANDLE", "p_handle", "0"),
    ("person_school_prefix", "PERSON", "p_person", "0"), ("person_school_prefix", "SCHOOL", "p_school", "length(p_person) + 6"),
    ("date_city_prefix", "DATE", "p_date", "3"), ("date_city_prefix", "PERSON", "p_person", "length(p_date) + 5"), ("date_city_prefix", "LOCATION", "p_city", "length(p_date) + length(p_person) + 9"),
    ("family_prefix", "FAMILY_RELATION", "p_relation", "3"), ("family_prefix", "PERSON", "p_person", "length(p_relation) + 4"), ("family_prefix", "PHONE", "p_phone", "length(p_relation) + length(p_person) + 6"),
    ("workplace_suffix", "WORKPLACE", "p_workplace", "n + 15"), ("workplace_suffix", "EVENT", "p_event", "n + length(p_workplace) + 26"),
    ("email_suffix", "EMAIL", "p_email", "n + 10"),
]


@relation("gold_spans", "injected")
def _(q):
    return "\nUNION ALL ".join(f"SELECT row_id, '{label}' AS label, {value} AS literal, CAST({start} AS INT) AS s, CAST({start} + length({value}) AS INT) AS e FROM injected WHERE template = '{t}'" for t, label, value, start in GOLD)


@relation("subject", "injected")
def _(q):
    """The rows that are released: injected texts, their known identifiers, and target groups that stand in for annotated ones."""
    gold = ""
    if q.name == "spark":
        parts = {t: [f"named_struct('start', CAST({start} AS INT), 'end', CAST({start} + length({value}) AS INT), 'label', '{label}')" for u, label, value, start in GOLD if u == t] for t in L.TEMPLATES}
        gold = ", CASE template " + " ".join(f"WHEN '{t}' THEN array({', '.join(p)})" for t, p in parts.items()) + " END AS gold"
    return f"SELECT row_id, split, functionality, binary_label, text, CASE row_id % 5 WHEN 0 THEN 'with/for|None' WHEN 1 THEN 'les_pas' ELSE '' END AS target_groups{gold} FROM injected"


@plan("d4_inject", "injected")
def _(q):
    return "SELECT row_id, template, text FROM injected"


@plan("d4_gold_spans", "gold_spans", "injected")
def _(q):
    return "SELECT g.row_id, g.label, g.s, g.e, substring(t.text, g.s + 1, g.e - g.s) = g.literal AS exact FROM gold_spans g JOIN injected t ON g.row_id = t.row_id"


#: The nine detectors, as both engines read them. The oracle's engine has no look-behind: a handle's match
#: takes the character before it along, which the span then leaves out.
PLAIN = {label: ("(?i)" if loose else "") + (r"(?:^|[^\p{L}\p{N}_])@[A-Za-z0-9_]{2,32}\b" if label == "HANDLE" else p) for label, p, loose, _ in L.DETECTORS}


@relation("pattern_spans", "injected")
def _(q):
    out = []
    for label, pattern in PLAIN.items():
        hits, gaps = q.findall("text", pattern), q.pieces("text", pattern)
        if q.name == "spark":
            exploded = f"SELECT row_id, CAST(i AS INT) AS i, lit, get(gaps, i) AS gap FROM (SELECT row_id, {hits} AS hits, {gaps} AS gaps FROM injected) LATERAL VIEW posexplode(hits) _x AS i, lit"
        else:
            exploded = f"SELECT row_id, CAST(i AS INT) AS i, hits[i + 1] AS lit, gaps[i + 1] AS gap FROM (SELECT *, unnest(range(len(hits))) AS i FROM (SELECT row_id, {hits} AS hits, {gaps} AS gaps FROM injected))"
        own = "substring(lit, instr(lit, '@'))" if label == "HANDLE" else "lit"
        out.append(f"SELECT row_id, '{label}' AS label, {own} AS lit, CAST(e - length({own}) AS INT) AS s, CAST(e AS INT) AS e FROM (SELECT row_id, lit, sum(length(lit) + length(gap)) OVER (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM ({exploded}) x) y")
    return "\nUNION ALL ".join(out)


@plan("d1_pattern_spans", "pattern_spans")
def _(q):
    return "SELECT row_id, label, lit, s, e FROM pattern_spans"


@relation("phrase_spans", "injected")
def _(q):
    # Handles are left to their pattern, which finds the same places.
    out = []
    for label, phrases in L.PHRASES:
        for phrase in phrases if label != "HANDLE" else ():
            pattern = "(?i)\\b" + phrase.replace(".", "[.]") + "\\b"
            hits, gaps = q.findall("text", pattern), q.pieces("text", pattern)
            out.append(f"""SELECT row_id, '{label}' AS label, CAST(e - length(lit) AS INT) AS s, CAST(e AS INT) AS e FROM (SELECT row_id, lit, sum(length(lit) + length(gap)) OVER (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (
SELECT row_id, i, hits[i + 1] AS lit, gaps[i + 1] AS gap FROM (SELECT *, unnest(range(len(hits))) AS i FROM (SELECT row_id, {hits} AS hits, {gaps} AS gaps FROM injected WHERE contains(lower(text), {q.text(phrase.lower())})))) x) y""")
    return "\nUNION ALL ".join(out)


@relation("identifiers", "gold_spans", "pattern_spans", "phrase_spans")
def _(q):
    # A fold over the candidates in order: one that outranks all it overlaps takes their place.
    order = {label: i + 1 for i, (label, *_) in enumerate(L.DETECTORS)}
    number = "CASE label " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in order.items()) + " END"
    over = "b[1].g > k.g OR (b[1].g = k.g AND (b[1].score > k.score OR (b[1].score = k.score AND b[1].e - b[1].s > k.e - k.s)))"
    rival = "k.s < b[1].e AND b[1].s < k.e"
    fold = f"""list_reduce(list_transform(c, lambda z: [z]), lambda a, b: CASE WHEN len(list_filter(a, lambda k: {rival} AND NOT ({over}))) = 0 THEN list_concat(list_filter(a, lambda k: NOT ({rival})), b) ELSE a END)"""
    return f"""SELECT row_id, x.s AS s, x.e AS e, x.label AS label, x.score AS score FROM (SELECT row_id, unnest({fold}) AS x FROM (
SELECT row_id, list(struct_pack(s := s, e := e, g := g, score := score, label := label) ORDER BY s, g DESC, score DESC, e - s DESC, ord) AS c FROM (
SELECT row_id, s, e, 1 AS g, {q.d(1.0)} AS score, label, 0 AS ord FROM gold_spans
UNION ALL SELECT row_id, s, e, 0 AS g, CASE WHEN label = 'DATE' THEN {q.d(1.2)} ELSE {q.d(1.0)} END AS score, label, {number} AS ord FROM pattern_spans
UNION ALL SELECT row_id, s, e, 0 AS g, {q.d(1.0)} AS score, label, 99 AS ord FROM phrase_spans) u GROUP BY row_id) l) r"""


@plan("c3_resolve_overlaps", "identifiers")
def _(q):
    return "SELECT row_id, s, e, label FROM identifiers"


@plan("d3_detect_identifiers", "identifiers")
def _(q):
    kind = f"CASE WHEN {q.in_list('label', L.DIRECT)} THEN 'direct' ELSE 'quasi' END"
    return f"SELECT row_id, s, e, label, score, {kind} AS kind, concat('[', label, ']') AS replacement FROM identifiers"


@relation("residuals", "gold_spans", "releases")
def _(q):
    return "SELECT g.row_id, r.variant, g.label, g.s, contains(r.released_text, g.literal) AS residual FROM gold_spans g JOIN releases r ON g.row_id = r.row_id"


@plan("d8_residual_literals", "residuals")
def _(q):
    return "SELECT row_id, variant, label, s, residual FROM residuals"


@plan("j8_residual_rates", "residuals")
def _(q):
    return f"""SELECT variant, kind, count(*) AS total, count_if(residual) AS n_residual, count_if(residual) / CAST(count(*) AS DOUBLE) AS residual_rate, 1 - count_if(residual) / CAST(count(*) AS DOUBLE) AS removed_recall
FROM (SELECT variant, residual, CASE WHEN {q.in_list('label', L.DIRECT)} THEN 'direct' ELSE 'quasi' END AS kind FROM residuals) x GROUP BY variant, kind"""


@plan("d7_privacy_risk", "release_pii_mask")
def _(q):
    scrubbed = q.sub("released_text", r"\[(?:EMAIL|URL|HANDLE|PERSON|PHONE|SCHOOL|WORKPLACE|EVENT)\]", "")
    return f"SELECT row_id, {q.matches(scrubbed, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}|https?://|www[.]|@[A-Za-z0-9_]{2,}')} AS at_risk FROM release_pii_mask"


@plan("d6_span_json", "gold_spans")
def _(q):
    return "SELECT row_id, s, concat('{\"start\":', CAST(s AS STRING), ',\"end\":', CAST(e AS STRING), ',\"label\":\"', label, '\"}') AS json FROM gold_spans"


# ---------------------------------------------------------------- annotations (E)


@relation("raw_labels")
def _(q):
    names = ["normal", "Non-Hate", "hateful", "offensive", "not hateful", "0", "1", "TRUE", "none", "", "unclear", "abusive_language", "non_hateful", "threat"]
    return f"SELECT event_id AS row_id, {q.at(q.array(names), f'CAST(event_id % {len(names)} AS INT)')} AS label, event_id % 4 AS annotator, event_id % 97 AS item FROM @events@"


BINARY = """CASE WHEN low IN ('normal', 'non hate', 'non-hate', 'non hateful', 'not hateful', 'none', 'clean', '0') THEN 0
WHEN contains(low, 'hate') OR contains(low, 'offensive') OR contains(low, 'toxic') OR contains(low, 'abusive') OR contains(low, 'threat') THEN CASE WHEN low LIKE 'non%' OR contains(low, 'not hateful') THEN 0 ELSE 1 END
WHEN low IN ('1', 'true', 'yes') THEN 1 END"""


@plan("e1_label_to_binary", "raw_labels")
def _(q):
    return f"SELECT row_id, label, {BINARY} AS binary_label FROM (SELECT row_id, label, replace(lower(trim(label)), '_', ' ') AS low FROM raw_labels) x"


@plan("e2_majority_vote", "raw_labels")
def _(q):
    return """SELECT item, label FROM (SELECT item, label, row_number() OVER (PARTITION BY item ORDER BY n DESC, first_seen) AS pick FROM (
SELECT item, label, count(*) AS n, min(row_id) AS first_seen FROM raw_labels WHERE lower(label) NOT IN ('', 'none', 'nan') GROUP BY item, label) c) r WHERE pick = 1"""


@plan("e3_combine_rationales")
def _(q):
    # Three annotators a part mark positions 0..9; a position counts if half of those long enough mark it.
    return f"""SELECT l_partkey AS item, position, CASE WHEN sum(mark) * 2 >= count(*) THEN 1 ELSE 0 END AS mask FROM (
SELECT l_partkey, l_linenumber, CAST(l_orderkey % 10 AS INT) AS position, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS mark FROM @lineitem@) x GROUP BY l_partkey, position"""


@plan("e4_flatten_targets", "raw_labels")
def _(q):
    collected = q.sort(q.distinct(q.collect("low", "low")))
    return f"SELECT item, {q.join_text(collected, '|')} AS targets FROM (SELECT item, lower(label) AS low FROM raw_labels WHERE lower(label) NOT IN ('', 'none', 'nan', 'other')) x GROUP BY item"


@plan("e5_target_terms")
def _(q):
    words = ("split(g, ' ')" if q.name == "spark" else "string_split(g, ' ')")
    return f"SELECT p_type, {q.join_text(q.sort(q.distinct(q.keep(words, 'w', 'length(w) > 2'))), '|')} AS terms FROM (SELECT DISTINCT p_type, trim({q.sub('lower(p_type)', '[_/-]+', ' ')}) AS g FROM @part@) x"


# ---------------------------------------------------------------- judges (K) and paired statistics (L)


@relation("released_cues", "releases", "lexicon")
def _(q):
    toks = f"{q.findall('lower(released_text)', L.TOKEN)}"
    flags = ", ".join(f"{q.size(q.keep(toks_name, 't', q.in_list('t', terms)))} > 0 AS {name}" for name, terms, toks_name in (("has_neg", core.LEX.negation, "toks"), ("has_quote", [*core.LEX.quote, *L.QUOTE_SIGNS], "toks"), ("has_counter", core.LEX.counterspeech, "toks"), ("has_harm", core.LEX.harm, "toks")))
    return f"SELECT row_id, variant, binary_label, released_text, toks, {flags} FROM (SELECT row_id, variant, binary_label, released_text, {toks} AS toks FROM releases) x"


@relation("judged", "released_cues")
def _(q):
    """A deterministic stand-in for a language model judge: it reads cues of the released text."""
    target = q.join_text(q.sort(q.distinct(q.keep("toks", "t", q.in_list("t", core.LEX.target)))), " ")
    return f"""SELECT row_id, variant, binary_label, CASE WHEN released_text = '[NO_TASK_EVIDENCE_RETAINED]' THEN 'UNCLEAR' WHEN has_harm THEN 'YES' ELSE 'NO' END AS hate,
CASE WHEN released_text = '[NO_TASK_EVIDENCE_RETAINED]' THEN 'UNCLEAR' WHEN has_neg THEN 'NEGATE' WHEN has_quote THEN 'QUOTE' WHEN has_counter THEN 'OPPOSE' ELSE 'ASSERT' END AS stance, {target} AS target FROM released_cues"""


@plan("k1_stance_judge", "judged")
def _(q):
    return "SELECT row_id, variant, stance FROM judged"


@plan("k2_label_judge", "judged")
def _(q):
    return "SELECT row_id, variant, hate, target FROM judged"


@plan("k3_candidates", "subject", "stance_rows", "window_kept")
def _(q):
    return """SELECT r.row_id, coalesce(w.n_spans, 0) AS matched_spans FROM subject r JOIN stance_rows s ON r.row_id = s.row_id AND s.relevant
LEFT JOIN (SELECT row_id, count(*) AS n_spans FROM window_kept GROUP BY row_id) w ON r.row_id = w.row_id"""


@relation("paired", "judged")
def _(q):
    return "SELECT j.row_id, j.variant, j.binary_label, j.hate, j.stance, j.target, r.hate AS raw_hate, r.stance AS raw_stance, r.target AS raw_target FROM judged j JOIN (SELECT row_id, hate, stance, target FROM judged WHERE variant = 'raw') r ON j.row_id = r.row_id"


@plan("k4_stance_summary", "paired")
def _(q):
    non = "('NEGATE', 'QUOTE', 'OPPOSE')"
    return f"""SELECT variant, count(*) AS n, count_if(stance IN {non}) AS preserved, count_if(stance = raw_stance) AS exact, count_if(stance = 'ASSERT') AS collapsed_assert, count_if(stance = 'UNCLEAR') AS collapsed_unclear
FROM paired WHERE raw_stance IN {non} GROUP BY variant"""


@plan("l1_hate_fidelity", "paired")
def _(q):
    return """SELECT variant, count(*) AS n, count_if(hate = raw_hate) AS same, count_if(hate = 'UNCLEAR') AS unclear, count_if(raw_hate = 'NO' AND hate = 'YES') AS no_to_yes, count_if(raw_hate = 'YES' AND hate = 'NO') AS yes_to_no
FROM paired WHERE raw_hate IN ('YES', 'NO') GROUP BY variant"""


@plan("l2_target_recovery", "paired")
def _(q):
    cut = (lambda c: f"filter(split({c}, '[ /-]'), w -> length(w) > 3)") if q.name == "spark" else (lambda c: f"list_filter(regexp_split_to_array({c}, '[ /-]'), lambda w: length(w) > 3)")
    return f"SELECT variant, count(*) AS n, count_if({q.common(cut('target'), cut('raw_target'))} > 0) AS recovered FROM paired WHERE {q.size(cut('raw_target'))} > 0 GROUP BY variant"


@relation("discordant", "paired")
def _(q):
    one = lambda v: f"bool_or(CASE WHEN variant = '{v}' THEN hate = raw_hate END)"
    return f"SELECT count_if(a AND NOT b) AS a_only, count_if(NOT a AND b) AS b_only FROM (SELECT row_id, {one('context')} AS a, {one('importance_window')} AS b FROM paired WHERE raw_hate IN ('YES', 'NO') GROUP BY row_id) x"


def mcnemar(q, a, b):
    """Exact two-sided p: twice the lower binomial tail at one half, six decimals. Each term's logarithm follows from the one before."""
    n, k = f"({a} + {b})", f"least({a}, {b})"
    if q.name == "spark":
        step = f"x.t + ln({n} - j + 1D) - ln(CAST(j AS DOUBLE))"
        body = f"aggregate(CASE WHEN {k} > 0 THEN sequence(1L, {k}) ELSE array() END, named_struct('t', -{n} * ln(2D), 'p', exp(-{n} * ln(2D))), (x, j) -> named_struct('t', {step}, 'p', x.p + exp({step})), x -> x.p)"
    else:
        body = f"list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(CAST({n} + 1 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST({n} - i + 1 AS DOUBLE)) - {n} * ln(CAST(2 AS DOUBLE)))))"
    return f"CASE WHEN {n} = 0 THEN {q.d(1.0)} ELSE round(least({q.d(1.0)}, 2 * {body}), 6) END"


@plan("l3_mcnemar", "discordant")
def _(q):
    golden = [(38, 22), (48, 29), (103, 42), (90, 47), (0, 0)]
    rows = q.values([(q.text(f"golden-{a}-{b}"), f"CAST({a} AS BIGINT)", f"CAST({b} AS BIGINT)") for a, b in golden], "pair, a_only, b_only")
    return f"SELECT pair, a_only, b_only, {mcnemar(q, 'a_only', 'b_only')} AS p FROM (SELECT 'context-window' AS pair, CAST(a_only AS BIGINT) AS a_only, CAST(b_only AS BIGINT) AS b_only FROM discordant UNION ALL {rows}) x"


@plan("l5_gold_anchoring", "judged")
def _(q):
    return f"""SELECT variant, count(*) AS n, count_if((hate = 'YES') = (binary_label = 1)) AS correct, count_if(hate = 'YES' AND binary_label = 1) AS hit, count_if(binary_label = 1) AS gold_pos, count_if(hate = 'YES') AS judged_pos, count_if(binary_label = 0 AND hate = 'YES') AS false_flips
FROM judged WHERE binary_label IS NOT NULL AND hate IN ('YES', 'NO') GROUP BY variant"""


@plan("l6_multi_judge", "discordant")
def _(q):
    rows = q.values([("'judge-a'", "CAST(30 AS BIGINT)", "CAST(22 AS BIGINT)"), ("'judge-b'", "CAST(41 AS BIGINT)", "CAST(30 AS BIGINT)"), ("'judge-c'", "CAST(50 AS BIGINT)", "CAST(27 AS BIGINT)")], "judge, a_only, b_only")
    return f"SELECT judge, p, p < {q.d(0.05)} AS significant, CASE WHEN p < {q.d(0.05)} AND a_only > b_only THEN 'context' WHEN p < {q.d(0.05)} THEN 'window' ELSE 'none' END AS verdict FROM (SELECT judge, a_only, b_only, {mcnemar(q, 'a_only', 'b_only')} AS p FROM ({rows}) j) x"


@plan("l7_frontier")
def _(q):
    points = q.values([("'window'", "14.3e0", "1.3e0"), ("'window'", "49.7e0", "26.3e0"), ("'window'", "59.7e0", "42.1e0")], "family, tok, stance")
    return f"""SELECT round(s0 + ({q.d(57.5)} - t0) / (t1 - t0) * (s1 - s0), 6) AS frontier, round({q.d(49.1)} - (s0 + ({q.d(57.5)} - t0) / (t1 - t0) * (s1 - s0)), 6) AS above FROM (
SELECT tok AS t0, stance AS s0, lead(tok) OVER (ORDER BY tok) AS t1, lead(stance) OVER (ORDER BY tok) AS s1 FROM ({points}) p) x WHERE t0 <= {q.d(57.5)} AND t1 > {q.d(57.5)}"""


# ---------------------------------------------------------------- review sheets (M)


@relation("bundles", "releases", "subject", "residuals")
def _(q):
    count = lambda c: f"CAST({q.size(q.keep(q.findall(c, L.TOKEN), 't', q.matches('t', r'[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')))} AS INT)"
    one = lambda v: f"max(CASE WHEN variant = '{v}' THEN released_text END)"
    return f"""SELECT b.row_id, b.binary_label, only_text, window_text, context_text, {count('only_text')} AS n_only, {count('window_text')} AS n_window, {count('context_text')} AS n_context,
len(list_filter(string_split(s.target_groups, '|'), lambda g: g <> '')) AS n_groups, coalesce(x.residual, false) AS quasi_residual FROM (
SELECT row_id, max(binary_label) AS binary_label, {one('importance_only')} AS only_text, {one('importance_window')} AS window_text, {one('context')} AS context_text FROM releases GROUP BY row_id) b
JOIN subject s ON b.row_id = s.row_id LEFT JOIN (SELECT row_id, bool_or(residual) AS residual FROM residuals WHERE variant = 'pii_mask' AND NOT {q.in_list('label', L.DIRECT)} GROUP BY row_id) x ON b.row_id = x.row_id"""


@relation("reasons", "bundles")
def _(q):
    return f"""SELECT row_id, coalesce(CAST(binary_label AS STRING), 'unknown') AS label, n_only, n_window, n_context, CASE WHEN n_only <= 2 THEN 'importance_only_very_short' WHEN {q.matches('window_text', r'^[.,;:]|[,;:]$')} THEN 'importance_window_fragment'
WHEN n_context <= 6 THEN 'low_context' WHEN n_context >= n_window + 4 THEN 'context_extension' WHEN n_groups > 1 THEN 'multi_target' WHEN quasi_residual THEN 'pii_mask_quasi_risk' ELSE 'label_balance' END AS reason FROM bundles"""


@plan("m1_review_reason", "reasons")
def _(q):
    return "SELECT row_id, label, reason FROM reasons"


REASONS = ("importance_only_very_short", "importance_window_fragment", "low_context", "context_extension", "multi_target", "pii_mask_quasi_risk", "label_balance")
PRIORITY = "CASE reason " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(REASONS)) + " END"
SHUFFLE = "md5(concat('17:', CAST(row_id AS STRING)))"


@relation("selected", "reasons")
def _(q):
    # At most max(2, quota / 5) of a reason first; what is still open is filled up in order.
    return f"""SELECT row_id, label, reason FROM (SELECT row_id, label, reason, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN rn <= 8 THEN 0 ELSE 1 END, {PRIORITY}, digest, row_id) AS pick FROM (
SELECT row_id, label, reason, {SHUFFLE} AS digest, row_number() OVER (PARTITION BY label, reason ORDER BY {SHUFFLE}, row_id) AS rn FROM reasons) a WHERE rn <= 40) b WHERE pick <= 40"""


@plan("m2_stratified_selection", "selected")
def _(q):
    return "SELECT row_id, label, reason FROM selected"


@relation("review", "selected", "releases")
def _(q):
    return "SELECT row_number() OVER (ORDER BY s.row_id, r.variant) AS review_id, s.row_id, s.label, s.reason, r.variant, r.released_text FROM selected s JOIN releases r ON s.row_id = r.row_id"


@plan("m3_review_rows", "review")
def _(q):
    return "SELECT review_id, row_id, variant, reason, released_text FROM review"


@relation("prefilled", "review", "judged", "paired")
def _(q):
    return f"""SELECT v.review_id, v.row_id, v.variant, v.label, CASE WHEN p.raw_hate <> 'YES' THEN 'na' WHEN p.hate = 'YES' THEN 'yes' ELSE 'no' END AS harmful_cue_preserved,
CASE WHEN p.raw_stance NOT IN ('NEGATE', 'QUOTE', 'OPPOSE') THEN 'na' WHEN p.stance = p.raw_stance THEN 'yes' ELSE 'no' END AS stance_preserved,
CASE WHEN p.raw_target = '' THEN 'na' WHEN p.target = p.raw_target THEN 'yes' ELSE 'no' END AS target_preserved,
CASE WHEN v.released_text = '[NO_TASK_EVIDENCE_RETAINED]' THEN 'no' WHEN {q.size(q.findall('v.released_text', L.TOKEN))} >= 5 THEN 'yes' ELSE 'uncertain' END AS context_sufficient
FROM review v JOIN paired p ON v.row_id = p.row_id AND v.variant = p.variant"""


@plan("m4_prefill", "prefilled")
def _(q):
    return "SELECT review_id, row_id, variant, harmful_cue_preserved, stance_preserved, target_preserved, context_sufficient FROM prefilled"


@plan("m5_selection_summary", "selected")
def _(q):
    return "SELECT label, reason, count(*) AS n FROM selected GROUP BY label, reason"


@plan("m6_review_summary", "prefilled", within="selected")
def _(q):
    questions = ("harmful_cue_preserved", "stance_preserved", "target_preserved", "context_sufficient")
    if q.name == "spark":  # reads its source once
        cells = f"SELECT variant, question, answer FROM prefilled LATERAL VIEW stack({len(questions)}, {', '.join(f"'{c}', {c}" for c in questions)}) _x AS question, answer"
    else:
        cells = " UNION ALL ".join(f"SELECT variant, '{c}' AS question, {c} AS answer FROM prefilled" for c in questions)
    return f"SELECT variant, question, count_if(answer = 'yes') AS yes, count_if(answer = 'no') AS no, count_if(answer = 'na') AS na, CASE WHEN count_if(answer <> 'na') > 0 THEN count_if(answer = 'yes') / CAST(count_if(answer <> 'na') AS DOUBLE) END AS yes_rate FROM ({cells}) c GROUP BY variant, question"


@plan("m7_audit_selection", "reasons")
def _(q):
    return f"""SELECT row_id, label, reason FROM (SELECT row_id, label, reason, row_number() OVER (PARTITION BY label ORDER BY rn, {PRIORITY}) AS pick FROM (
SELECT row_id, label, reason, row_number() OVER (PARTITION BY label, reason ORDER BY {SHUFFLE}, row_id) AS rn FROM reasons) a WHERE rn <= 30) b WHERE pick <= 30"""


@relation("audit", "bundles", "judged")
def _(q):
    score = lambda v: f"max(CASE WHEN j.variant = '{v}' THEN CASE WHEN j.stance IN ('NEGATE', 'QUOTE', 'OPPOSE') THEN 2 ELSE 0 END + CASE WHEN j.hate = 'YES' THEN 1 ELSE 0 END + CASE WHEN j.target <> '' THEN 1 ELSE 0 END ELSE 0 END)"
    return f"SELECT b.row_id, {score('importance_only')} AS only_score, {score('importance_window')} AS window_score, {score('context')} AS context_score FROM bundles b JOIN judged j ON b.row_id = j.row_id GROUP BY b.row_id"


@relation("audit_best", "audit")
def _(q):
    return "SELECT row_id, only_score, window_score, context_score, CASE WHEN context_score > greatest(only_score, window_score) THEN 'context' WHEN window_score > greatest(only_score, context_score) THEN 'importance_window' WHEN only_score > greatest(window_score, context_score) THEN 'importance_only' ELSE 'tie' END AS best_variant FROM audit"


@plan("m8_audit_rows", "audit_best")
def _(q):
    return "SELECT row_id, only_score, window_score, context_score, best_variant FROM audit_best"


@plan("m9_audit_summary", "audit_best")
def _(q):
    return "SELECT best_variant, count(*) AS n FROM audit_best GROUP BY best_variant"


@plan("m10_legacy_sample", "sampled", "releases")
def _(q):
    return "SELECT s.row_id, r.variant, r.released_text FROM sampled s JOIN releases r ON s.row_id = r.row_id WHERE r.variant <> 'raw'"


@plan("i3_sanitize", "tok_rows", "lexicon", "rows")
def _(q):
    low = q.sub("lower(t.tok)", chr(91) + "^a-z0-9" + chr(39) + "]+", "")
    word = f"CASE WHEN x.cue = 'TARGET_CUE' THEN '[GROUP]' WHEN x.cue = 'HARM_CUE' OR t.low LIKE 'shit%' OR t.low LIKE '%slur' OR t.low LIKE '%slurs' THEN '[HARM]' ELSE t.tok END"
    body = q.join_text(q.collect("piece", "idx"), "")
    out = q.sub(q.sub(q.sub("body", r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"), r"https?://\S+|www\.\S+", "[URL]"), r"@[A-Za-z0-9_]+", "[HANDLE]")
    return f"SELECT row_id, trim({q.sub(out, chr(92) + 's+', ' ')}) AS sanitized FROM (SELECT row_id, {body} AS body FROM (SELECT t.row_id, t.idx, concat(t.gap, {word}) AS piece FROM (SELECT t.row_id, t.idx, t.tok, t.gap, {low} AS low FROM tok_rows t) t LEFT JOIN lexicon x ON t.low = x.term) p GROUP BY row_id) b"


# ---------------------------------------------------------------- run-level analytics (N)


@relation("runs")
def _(q):
    """Published aggregates of a six-run sweep: setting, k, r and seven criteria."""
    data = [(5, 2, 0.697, 13.42, 49.738, 95.338, 61.941), (3, 2, 0.7, 14.2, 44.152, 93.853, 59.924), (7, 2, 0.696, 13.14, 52.259, 95.462, 62.813), (10, 2, 0.699, 12.84, 53.952, 95.627, 63.577), (5, 1, 0.708, 15.42, 43.169, 95.338, 60.905), (5, 3, 0.692, 12.36, 55.831, 95.338, 62.541)]
    return q.values([(q.text(f"k={k}, r={r}"), str(k), str(r), *[q.d(x) for x in rest], "0") for k, r, *rest in data], "setting, top_k, radius, positive_f1, flip_pct, retained_token_pct, target_cue_pct, stance_harm_pct, placeholder_only")


@plan("n2_recommended", "runs")
def _(q):
    return f"SELECT setting, placeholder_only = 0 AND target_cue_pct >= {q.d(95.0)} AND stance_harm_pct >= {q.d(60.0)} AND flip_pct <= {q.d(13.5)} AND retained_token_pct <= {q.d(50.0)} AS recommended FROM runs"


@plan("n3_pareto", "runs")
def _(q):
    return """SELECT a.setting, count(b.setting) > 0 AS pareto_dominated FROM runs a LEFT JOIN runs b ON a.setting <> b.setting
AND b.placeholder_only <= a.placeholder_only AND b.retained_token_pct <= a.retained_token_pct AND b.flip_pct <= a.flip_pct AND b.positive_f1 >= a.positive_f1 AND b.target_cue_pct >= a.target_cue_pct AND b.stance_harm_pct >= a.stance_harm_pct
AND (b.placeholder_only < a.placeholder_only OR b.retained_token_pct < a.retained_token_pct OR b.flip_pct < a.flip_pct OR b.positive_f1 > a.positive_f1 OR b.target_cue_pct > a.target_cue_pct OR b.stance_harm_pct > a.stance_harm_pct) GROUP BY a.setting"""


@plan("n4_evaluator_runs", "runs")
def _(q):
    rows = q.values([("'k=5, r=2'", "'second evaluator'", "0.694e0"), ("'k=9, r=9'", "'no source run'", "0.5e0")], "setting, evaluator, f1")
    return f"SELECT e.setting, e.evaluator, e.f1, r.top_k, r.radius FROM ({rows}) e LEFT JOIN runs r ON e.setting = r.setting"


@plan("n5_seed_variance")
def _(q):
    return "SELECT o_orderpriority AS variant, count(*) AS n, round(avg(CAST(o_custkey AS DOUBLE)), 6) AS mean_value, round(coalesce(stddev_samp(CAST(o_custkey AS DOUBLE)), 0), 6) AS std_value FROM @orders@ GROUP BY o_orderpriority"


@relation("group_facts", "facts")
def _(q):
    return "SELECT functionality, variant, count(*) AS n, sum(kept_tokens) AS kept, count_if(pred <> raw_pred) AS flips FROM facts GROUP BY functionality, variant"


@plan("n6_group_deltas", "group_facts")
def _(q):
    # Against both reduced baselines; wins: in how many groups the context flips less.
    return """SELECT baseline, functionality, n, token_cost, flip_delta, count_if(flip_delta < 0) OVER (PARTITION BY baseline) AS wins, count(*) OVER (PARTITION BY baseline) AS n_groups FROM (
SELECT b.variant AS baseline, c.functionality, c.n, CAST(c.kept - b.kept AS BIGINT) AS token_cost, c.flips - b.flips AS flip_delta
FROM group_facts c JOIN group_facts b ON c.functionality = b.functionality AND b.variant IN ('importance_only', 'importance_window') WHERE c.variant = 'context') d"""
