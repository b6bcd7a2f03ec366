"""DuckDB SQL for the queries of quillmark.plans.queries: an independent statement of each result over the same tables."""

from __future__ import annotations

from quillmark.operators.numeric import BORDERS, P_ANY, PERCENT, PLUS_MINUS, TABLE_LINE, P_CURVE, TRIPLE
from quillmark.operators.sections import APA, BODY, DOI, HEADING, IEEE, LABELS, WORD
from quillmark.operators.similarity import STOPWORDS as COMMON
from quillmark.operators.similarity import WEB_STOPWORDS
from quillmark.operators.provenance import STOPWORDS as CLAIM_STOPWORDS
from quillmark.operators.stylometry import PHRASES, STOPWORDS
from quillmark.sources.papers import PAPERS_SQL, WORKS_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def n_tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def count(x: str, pattern: str, options: str = "") -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}{', 0, ' + q(options) if options else ''}))"


RUNS = r"[\p{L}\p{N}_]+"


def latin(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{RUNS}'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def edged(x: str, pattern: str, options: str = "") -> str:
    """How often a pattern stands between characters that aren't of a word; these are put twice, so that neighbours share none."""
    pattern = pattern.replace(" ", " +")
    return count(rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')", rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{pattern})(?:[^\p{{L}}\p{{N}}_]|$)", options)


def half(x: str, digits: int = 0) -> str:
    return f"round_even({x}, {digits})"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(line, {q(p)}, 'i') THEN {q(k)}" for k, p in LABELS.items()) + " END"
LINES = rf"""
cut AS (SELECT paper_id, unnest(string_split(full_text, chr(10))) AS raw, generate_subscripts(string_split(full_text, chr(10)), 1) - 1 AS pos FROM papers),
trimmed AS (SELECT *, {strip('raw')} AS line FROM cut WHERE regexp_matches(raw, '\S')),
candidates AS (SELECT *, regexp_matches(line, {q(HEADING)}) AND {n_tokens('line')} <= 6 AS candidate FROM trimmed),
labelled AS (SELECT *, CASE WHEN candidate THEN {_LABEL} END AS label FROM candidates),
lines AS (SELECT paper_id, pos, raw, line, label, candidate AND (label IS NOT NULL OR regexp_matches(line, '^\d')) AS heading FROM labelled)
"""
SECTIONS = (
    LINES
    + rf""",
numbered AS (SELECT *, sum(heading::INTEGER) OVER (PARTITION BY paper_id ORDER BY pos) AS sec FROM lines),
runs AS (
    SELECT paper_id, sec, max(label) FILTER (heading) AS label, coalesce(max(line) FILTER (heading), '') AS heading,
        {strip("coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT heading), '')")} AS text
    FROM numbered GROUP BY paper_id, sec
),
kept AS (SELECT paper_id, sec, coalesce(label, 'other') AS label, heading, text FROM runs WHERE text <> '' OR label IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY sec) AS idx, count(*) OVER (PARTITION BY paper_id) AS n FROM kept),
titled AS (SELECT *, idx = 1 AND n > 1 AND label = 'other' AND heading = '' AND {n_tokens('text')} < 20 AS title FROM placed),
moved AS (SELECT *, lag(title) OVER w AS after_title, lag(text) OVER w AS before FROM titled WINDOW w AS (PARTITION BY paper_id ORDER BY sec)),
headed AS (SELECT paper_id, sec, label, heading, CASE WHEN after_title THEN {strip("before || chr(10) || chr(10) || text")} ELSE text END AS text FROM moved WHERE NOT title),
flagged AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY sec) = 1 OR NOT (label = 'other' AND {n_tokens('text')} < 15) AS keep FROM headed),
parted AS (SELECT *, sum(keep::INTEGER) OVER (PARTITION BY paper_id ORDER BY sec) AS part FROM flagged),
sections AS (
    SELECT paper_id, (part - 1)::INTEGER AS idx, arg_min(label, sec) AS label, arg_min(heading, sec) AS heading, string_agg(text, chr(10) || chr(10) ORDER BY sec) AS text FROM parted GROUP BY paper_id, part
    UNION ALL SELECT paper_id, 0, 'other', '', '' FROM papers WHERE NOT regexp_matches(full_text, '\S')
)
"""
)
CHUNKS = rf"""
pieces AS (
    SELECT paper_id, idx, list_transform(list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda s: {strip('s')}), lambda s: length(s) > 8),
        lambda s: {{'done': []::VARCHAR[], 'now': [{{'s': s, 'n': {n_tokens('s')}}}], 'n': {n_tokens('s')}}}) AS p
    FROM sections
),
folded AS (
    SELECT paper_id, idx, list_reduce(p, lambda a, x: CASE WHEN a.n + x.n >= 35
        THEN {{'done': list_append(a.done, list_aggregate(list_transform(list_concat(a.now, x.now), lambda y: y.s), 'string_agg', '. ') || '.'), 'now': list_concat(a.now, x.now)[-2:], 'n': list_sum(list_transform(list_concat(a.now, x.now)[-2:], lambda y: y.n))::BIGINT}}
        ELSE {{'done': a.done, 'now': list_concat(a.now, x.now), 'n': a.n + x.n}} END, {{'done': []::VARCHAR[], 'now': []::STRUCT(s VARCHAR, n BIGINT)[], 'n': 0::BIGINT}}) AS f
    FROM pieces WHERE len(p) > 0
),
chunked AS (SELECT paper_id, idx, list_append(f.done, list_aggregate(list_transform(f.now, lambda y: y.s), 'string_agg', '. ') || '.') AS c FROM folded),
chunks AS (SELECT paper_id, idx, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS chunk FROM chunked)
"""
CITING = rf"""
bodies AS (SELECT paper_id, string_agg(text, ' ' ORDER BY idx) AS body FROM sections WHERE label IN {names(BODY)} GROUP BY paper_id),
bodied AS (SELECT paper_id, CASE WHEN regexp_matches(coalesce(body, ''), '\S') THEN body ELSE full_text END AS t FROM papers LEFT JOIN bodies USING (paper_id)),
said AS (SELECT paper_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence FROM (SELECT paper_id, {sentences("replace(t, chr(10), ' ')")} AS s FROM bodied)),
rated AS (
    SELECT *, NOT (regexp_matches(sentence, {q(IEEE)}) OR regexp_matches(sentence, {q(APA)}) OR regexp_matches(sentence, '\b10\.\d{{4,9}}/\S+\b')) AS last, substring(lower(sentence), 1, 80) AS same
    FROM said WHERE {n_tokens('sentence')} BETWEEN 12 AND 60
),
once AS (SELECT *, row_number() OVER (PARTITION BY paper_id, same ORDER BY last, pos) AS o FROM rated),
ranked_said AS (SELECT paper_id, sentence, row_number() OVER (PARTITION BY paper_id ORDER BY last, pos)::INTEGER AS rank FROM once WHERE o = 1),
citing AS (SELECT paper_id, rank, sentence FROM ranked_said WHERE rank <= 40)
"""

_DOIS = rf"list_filter(list_transform(regexp_extract_all(full_text, {q(DOI)}), lambda d: regexp_replace(d, '[.,;:\"'')]+$', '')), lambda d: length(d) >= 10)"
CITED = f"""
raw_dois AS (SELECT paper_id, generate_subscripts(d, 1) AS spot, unnest(d) AS doi FROM (SELECT paper_id, {_DOIS} AS d FROM papers)),
cited AS (SELECT paper_id, doi, (row_number() OVER (PARTITION BY paper_id ORDER BY min(spot)) - 1)::INTEGER AS pos FROM raw_dois GROUP BY paper_id, doi),
checked AS (SELECT c.paper_id, c.pos, c.doi, w.doi IS NOT NULL AS valid, w.title, w.year, CASE WHEN w.doi IS NULL THEN 'DOI not found in registry' END AS issue FROM cited c LEFT JOIN works w ON w.doi = c.doi)
"""
_BARE = rf"len(list_filter(regexp_extract_all(full_text, '(?m)^\s*(\[\d+\].*)$', 1), lambda x: NOT regexp_matches(x, {q(DOI)})))"
VALIDITY = f"""
doi_sums AS (SELECT paper_id, count(*) AS total, count_if(valid) AS good, list_sort(list(doi) FILTER (NOT valid)) AS bad FROM checked GROUP BY paper_id),
bare AS (SELECT paper_id, {_BARE}::INTEGER AS bare FROM papers),
summed AS (SELECT paper_id, bare, coalesce(total, 0) AS total, coalesce(good, 0)::BIGINT AS good, coalesce(bad, []) AS bad, coalesce(good, 0) / greatest(coalesce(total, 0), 1)::DOUBLE AS ratio FROM bare LEFT JOIN doi_sums USING (paper_id)),
validity AS (
    SELECT paper_id, (CASE WHEN total = 0 AND bare = 0 THEN 55 ELSE {half("round(greatest(0.0, least(100.0, (ratio * 0.85::DOUBLE + 0.15::DOUBLE) * 100 - least(0.35::DOUBLE, bare * 0.07::DOUBLE) * 100)), 9)")} END)::INTEGER AS citation_score,
        CASE WHEN total = 0 AND bare = 0 THEN 'The paper cites nothing that a registry could confirm.' WHEN ratio >= 0.9 THEN 'Nearly all DOIs are known to the registry.'
            WHEN ratio >= 0.6 THEN 'The registry knows most of the DOIs, not all.' ELSE 'The registry doesn''t know many of the DOIs: go through the reference list.' END AS citation_summary,
        total AS total_dois, good AS valid_dois, bad AS invalid_dois, bare AS bare_references
    FROM summed
)
"""
RETRACTED = """
retracted AS (
    SELECT c.paper_id, c.doi, w.withdrawn OR r.doi IS NOT NULL AS retracted, CASE WHEN NOT w.withdrawn THEN r.retraction_date END AS retraction_date,
        CASE WHEN w.withdrawn THEN 'registry notice' ELSE substring(r.reason, 1, 120) END AS reason, CASE WHEN w.withdrawn THEN 'retraction' ELSE r.notice_type END AS notice_type
    FROM checked c JOIN works w ON w.doi = c.doi LEFT JOIN retractions r ON r.doi = c.doi
)
"""
CONTAMINATION = f"""
tainted AS (SELECT p.paper_id, count(r.doi) AS n_dois, coalesce(count_if(r.retracted), 0)::BIGINT AS n_retracted FROM papers p LEFT JOIN retracted r ON r.paper_id = p.paper_id GROUP BY p.paper_id),
contamination AS (
    SELECT paper_id, n_dois, n_retracted, f AS contaminated_fraction,
        (CASE WHEN n_retracted = 0 THEN 0 WHEN f <= 0.1 THEN {half('round(25 + f * 550, 9)')} ELSE {half('round(least(100.0::DOUBLE, 80 + f * 20), 9)')} END)::INTEGER AS contamination,
        CASE WHEN n_dois = 0 THEN 'Without DOIs no retraction can be looked up.' WHEN n_retracted = 0 THEN 'No cited work is on the list of retractions.'
            WHEN f <= 0.1 THEN n_retracted || ' of the cited works were withdrawn, a tenth of them at most.'
            ELSE n_retracted || ' of ' || n_dois || ' cited works were withdrawn, more than a tenth: the evidence is in doubt.' END AS contamination_summary
    FROM (SELECT *, n_retracted / greatest(n_dois, 1)::DOUBLE AS f FROM tainted)
)
"""
GRAPH = f"""
ranked_dois AS (SELECT paper_id, doi, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS r FROM checked WHERE valid),
graph_nodes AS (SELECT paper_id, doi FROM ranked_dois WHERE r <= 15),
targets AS (SELECT DISTINCT g.paper_id, g.doi, unnest(w.refs) AS other FROM graph_nodes g JOIN works w ON w.doi = g.doi),
degrees AS (SELECT t.paper_id, t.doi, count(*) AS d FROM targets t JOIN graph_nodes g ON g.paper_id = t.paper_id AND g.doi = t.other GROUP BY t.paper_id, t.doi),
graph_sums AS (SELECT g.paper_id, count(*) AS n, coalesce(sum(d), 0)::BIGINT AS edges, count_if(d IS NULL)::BIGINT AS isolated FROM graph_nodes g LEFT JOIN degrees USING (paper_id, doi) GROUP BY g.paper_id),
graph_rows AS (
    SELECT p.paper_id, coalesce(t.n_dois, 0) AS n_dois, coalesce(s.n, 0) AS n, coalesce(s.edges, 0) AS edges, coalesce(s.isolated, 0) AS isolated
    FROM papers p LEFT JOIN (SELECT paper_id, count(*) AS n_dois FROM ranked_dois GROUP BY paper_id) t ON t.paper_id = p.paper_id LEFT JOIN graph_sums s ON s.paper_id = p.paper_id
),
graph_scored AS (
    SELECT *, CASE WHEN n > 1 THEN edges / (n * (n - 1))::DOUBLE ELSE 0.0::DOUBLE END AS dens FROM graph_rows
),
graph AS (
    SELECT paper_id, n_dois, edges, {half('dens', 4)} AS density, CASE WHEN n > 0 THEN edges / n::DOUBLE ELSE 0.0::DOUBLE END AS mean_degree, CASE WHEN n_dois < 2 THEN 0 ELSE isolated END AS isolated, a AS graph_anomaly,
        CASE WHEN n_dois < 2 THEN 'Fewer works than a graph needs.' WHEN a <= 20 THEN 'The cited works cite each other densely.'
            WHEN a <= 55 THEN 'The cited works cite each other here and there; some stand alone.' ELSE 'The cited works hardly cite each other.' END AS graph_summary
    FROM (SELECT *, (CASE WHEN n_dois < 2 THEN 0 ELSE {half("round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, 0.05::DOUBLE - dens) / 0.05::DOUBLE * 40 + power(isolated / greatest(n_dois, 1)::DOUBLE, 1.5) * 60)), 9)")} END)::INTEGER AS a FROM graph_scored)
)
"""


def claim(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda w: w NOT IN {names(CLAIM_STOPWORDS)}))"


VERDICTS = f"""
aligned_dois AS (SELECT c.paper_id, c.pos, c.doi, row_number() OVER (PARTITION BY c.paper_id ORDER BY c.pos) AS r FROM checked c WHERE valid),
aims AS (SELECT a.paper_id, a.pos, a.doi, {claim("w.title || ' ' || w.abstract")} AS target FROM aligned_dois a JOIN works w ON w.doi = a.doi WHERE a.r <= 20),
claims AS (SELECT paper_id, {claim('sentence')} AS w FROM citing),
overlapped AS (SELECT a.paper_id, a.pos, a.doi, len(a.target) AS n, max(coalesce({jaccard('c.w', 'a.target')}, 0.0)) AS best FROM aims a LEFT JOIN claims c ON c.paper_id = a.paper_id GROUP BY a.paper_id, a.pos, a.doi, len(a.target)),
verdicts AS (SELECT paper_id, pos, doi, CASE WHEN n = 0 THEN 'unchecked' WHEN best >= 0.25 THEN 'aligned' WHEN best >= 0.12 THEN 'weak' ELSE 'unsupported' END AS alignment, CASE WHEN n > 0 THEN {half('best', 3)} END AS overlap FROM overlapped)
"""
ALIGNMENT = f"""
verdict_sums AS (SELECT paper_id, avg(CASE alignment WHEN 'aligned' THEN 100 WHEN 'weak' THEN 50 WHEN 'unsupported' THEN 15 END) AS mean, count(*) AS n, count_if(alignment = 'unsupported')::BIGINT AS u FROM verdicts GROUP BY paper_id),
alignment AS (
    SELECT p.paper_id, (CASE WHEN mean IS NULL THEN 60 ELSE {half('round(mean, 9)')} END)::INTEGER AS alignment_score, CASE WHEN mean IS NULL THEN 0 ELSE n END AS n_verdicts, CASE WHEN mean IS NULL THEN 0 ELSE u END AS n_unsupported,
        CASE WHEN mean IS NULL THEN 'No cited work has words to compare claims with.' WHEN u > 0 THEN u || ' of ' || n || ' claims share too few words with the works they cite.' ELSE 'Each claim shares enough words with the work it cites.' END AS alignment_summary
    FROM papers p LEFT JOIN verdict_sums s ON s.paper_id = p.paper_id
)
"""


def doubles(x: str) -> str:
    return f"list_transform({x}, lambda x: TRY_CAST(x AS DOUBLE))"


_P_WORD = r"(?:^|[^\p{L}\p{N}_])p\s*(?:<|>|=|≤|≥)\s*(\d+(?:\.\d+)?)"
PVALUES = f"pvals AS (SELECT paper_id, full_text, {doubles(f'list_concat(regexp_extract_all(full_text, {q(P_ANY)}, 1), regexp_extract_all(full_text, {q(_P_WORD)}, 1))')} AS p FROM papers)"
_NEAR_BORDER = " OR ".join(f"abs(x - {b}::DOUBLE) < 0.006" for b in BORDERS)
# decimals stand between characters that aren't digits; the mark is put twice so that neighbours share none
_DECIMALS = r"list_transform(regexp_extract_all(regexp_replace(full_text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])([0-9]+\.\.[0-9]{2,4})(?:[^0-9]|$)', 1), lambda d: right(d, 1))"
_CHI2 = " + ".join(f"power(len(list_filter(digits, lambda d: d = '{i}')) - len(digits) / 10.0::DOUBLE, 2) / (len(digits) / 10.0::DOUBLE)" for i in range(10))
STATS = rf"""
{PVALUES},
numeric_rows AS (
    SELECT paper_id, p, len(p) AS np, len(list_filter(p, lambda x: {_NEAR_BORDER})) AS borders, len(list_filter(p, lambda x: x >= 0.04::DOUBLE AND x <= 0.055::DOUBLE)) AS near, len(list_filter(p, lambda x: x = 0)) AS zero,
        {_DECIMALS} AS digits, {doubles(f'regexp_extract_all(full_text, {q(PERCENT)}, 1)')} AS pct
    FROM pvals
),
numeric_more AS (SELECT *, CASE WHEN len(digits) >= 15 THEN round({_CHI2}, 9) ELSE 0 END AS chi2, len(list_filter(pct, lambda x: x = floor(x))) AS whole, len(list_filter(pct, lambda x: x = 0 OR x = 100)) AS extreme FROM numeric_rows),
digit_counts AS (SELECT paper_id, d, count(*) AS n, min(spot) AS spot FROM (SELECT paper_id, unnest(digits) AS d, generate_subscripts(digits, 1) AS spot FROM numeric_more WHERE chi2 > 22) GROUP BY paper_id, d),
digit_order AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, spot) AS r FROM digit_counts),
digit_worst AS (SELECT paper_id, string_agg(d, ', ' ORDER BY r) AS worst FROM digit_order WHERE r <= 2 GROUP BY paper_id),
statistics_found AS (
    SELECT m.paper_id, p, list_filter([
        CASE WHEN borders >= 3 THEN {{'category': 'p-value borders', 'severity': CASE WHEN borders >= 5 THEN 'high' ELSE 'medium' END, 'detail': borders || ' of ' || np || ' p-values lie next to 0.05, 0.01 or 0.001.'}} END,
        CASE WHEN near >= 2 THEN {{'category': 'borderline clustering', 'severity': 'medium', 'detail': near || ' p-values lie between 0.04 and 0.055.'}} END,
        CASE WHEN zero >= 1 THEN {{'category': 'exact zero p-values', 'severity': 'low', 'detail': zero || ' p-value(s) given as 0.'}} END,
        CASE WHEN chi2 > 22 THEN {{'category': 'digit-preference bias', 'severity': CASE WHEN chi2 > 40 THEN 'high' ELSE 'medium' END, 'detail': 'Decimals end in some digits too often (most in ' || worst || ').'}} END,
        CASE WHEN whole >= 4 AND whole / len(pct)::DOUBLE > 0.8 THEN {{'category': 'rounded percentages', 'severity': 'low', 'detail': 'More than four fifths of the percentages are whole.'}} END,
        CASE WHEN extreme >= 2 THEN {{'category': 'extreme claims', 'severity': 'medium', 'detail': extreme || ' percentages are 0 or 100 without a remainder.'}} END
    ], lambda f: f IS NOT NULL) AS findings
    FROM numeric_more m LEFT JOIN digit_worst w ON w.paper_id = m.paper_id
),
statistics AS (
    SELECT paper_id, least(100, coalesce(list_sum(list_transform(findings, lambda f: CASE f.severity WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 4 END)), 0))::INTEGER AS statistical_risk,
        CASE WHEN len(findings) = 0 THEN 'No check of the numbers found anything.'
            WHEN len(list_filter(findings, lambda f: f.severity = 'high')) > 0 THEN 'A finding of high severity: have these numbers recomputed.'
            WHEN len(list_filter(findings, lambda f: f.severity = 'medium')) > 0 THEN 'Findings of medium severity: look at these numbers again.'
            ELSE 'Findings of low severity only.' END AS statistics_summary, findings, list_sort(p) AS p_values
    FROM statistics_found
)
"""
_BENFORD = " + ".join(f"power(len(list_filter(digits, lambda x: x = '{d}')) / len(digits)::DOUBLE - log10(1 + 1 / {d}.0::DOUBLE), 2) / log10(1 + 1 / {d}.0::DOUBLE)" for d in range(1, 10))
FINGERPRINT = rf"""
fp_rows AS (
    SELECT paper_id, list_filter(list_transform(list_concat(regexp_extract_all(full_text, {q(TABLE_LINE)}, 1), regexp_extract_all(full_text, {q(TABLE_LINE)}, 2)), lambda x: regexp_extract(x, '[1-9]')), lambda d: d <> '') AS digits,
        {doubles(f'regexp_extract_all(full_text, {q(P_CURVE)}, 1)')} AS p, regexp_extract_all(full_text, {q(PLUS_MINUS)}, 2) AS sd, {count('full_text', chr(92) + 'd+' + chr(92) + '.' + chr(92) + 'd{4,}' + chr(92) + 's*±')} AS exact,
        list_zip({doubles(f'regexp_extract_all(full_text, {q(TRIPLE)}, 1)')}, {doubles(f'regexp_extract_all(full_text, {q(TRIPLE)}, 2)')}, {doubles(f'regexp_extract_all(full_text, {q(TRIPLE)}, 3)')}) AS triples
    FROM papers
),
fp_parts AS (
    SELECT paper_id,
        (CASE WHEN len(digits) < 20 THEN 50 ELSE {half(f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (20 - ({_BENFORD})) / 18)) * 100, 9)")} END)::INTEGER AS benford,
        (CASE WHEN len(p) < 3 THEN 50 ELSE {half("round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (1 - len(list_filter(p, lambda x: x >= 0.04::DOUBLE AND x < 0.05::DOUBLE)) / len(p)::DOUBLE * 3) * 60 + len(list_filter(p, lambda x: x >= 0.001::DOUBLE AND x < 0.03::DOUBLE)) / len(p)::DOUBLE * 40)), 9)")} END)::INTEGER AS p_curve,
        (CASE WHEN len(list_filter(sd, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) > 0 THEN NULL
            WHEN len(list_filter(sd, lambda x: TRY_CAST(x AS DOUBLE) = 0)) + (exact > 0)::INTEGER = 0 THEN 95
            ELSE greatest(20, 95 - 15 * (len(list_filter(sd, lambda x: TRY_CAST(x AS DOUBLE) = 0)) + (exact > 0)::INTEGER)) END)::INTEGER AS precision,
        (CASE WHEN len(list_filter(triples, lambda t: t[2] IS NULL OR t[3] IS NULL)) > 0 THEN NULL
            WHEN len(list_filter(triples, lambda t: t[1] > 0 AND t[3] > 0 AND t[3] > t[2] * 3)) = 0 THEN 95
            ELSE greatest(15, 90 - 25 * len(list_filter(triples, lambda t: t[1] > 0 AND t[3] > 0 AND t[3] > t[2] * 3))) END)::INTEGER AS consistency
    FROM fp_rows
),
fp_fused AS (SELECT *, {half("round(power(benford::DOUBLE * p_curve * precision * consistency, 0.25), 9)")}::INTEGER AS fingerprint FROM fp_parts),
fingerprint AS (
    SELECT *, CASE WHEN fingerprint >= 75 THEN 'First digits, precision and deviations look like measured data.' WHEN fingerprint >= 45 THEN 'First digits, precision or deviations are somewhat unusual: ask for the raw data.'
        WHEN fingerprint IS NOT NULL THEN 'First digits, precision or deviations are unlike measured data.' END AS fingerprint_summary FROM fp_fused
)
"""
PROVENANCE = f"""
traced AS (
    SELECT v.paper_id, v.citation_score, c.n_retracted, c.contaminated_fraction AS f, c.contamination, g.graph_anomaly, a.alignment_score, x.fingerprint,
        {half("round(v.citation_score * greatest(0.5::DOUBLE, (1 - c.contaminated_fraction) * (greatest(0.55::DOUBLE, 1 - g.graph_anomaly / 200.0::DOUBLE) * 0.6::DOUBLE + greatest(0.55::DOUBLE, a.alignment_score / 100.0::DOUBLE) * 0.4::DOUBLE)), 9)")} AS base
    FROM validity v JOIN contamination c USING (paper_id) JOIN graph g USING (paper_id) JOIN alignment a USING (paper_id) JOIN fingerprint x USING (paper_id)
),
provenance_scored AS (
    SELECT *, (CASE WHEN fingerprint IS NULL THEN 50 WHEN fingerprint < 40 THEN {half('round(base * 0.45::DOUBLE, 9)')} WHEN fingerprint < 60 THEN {half('round(base * 0.75::DOUBLE, 9)')} ELSE base END)::INTEGER AS s FROM traced
),
provenance AS (
    SELECT paper_id, s AS provenance_score, fingerprint IS NULL AS pcv_failed, CASE WHEN fingerprint IS NOT NULL THEN contamination END AS contamination, CASE WHEN fingerprint IS NOT NULL THEN graph_anomaly END AS graph_anomaly,
        CASE WHEN fingerprint IS NOT NULL THEN alignment_score END AS alignment_score, fingerprint,
        CASE WHEN fingerprint IS NOT NULL AND n_retracted > 0 THEN n_retracted || ' cited work(s) withdrawn: see what still supports the claims.'
            WHEN s >= 75 THEN 'Sources are intact and linked, and the numbers look measured.' WHEN s >= 50 THEN 'A part of the provenance is weak: see its layers.'
            ELSE 'Most of the provenance is weak: review the evidence.' END AS provenance_summary
    FROM provenance_scored
)
"""
_FIGURE = r"(?:Figure|Fig\.|Table)\s+\d+"


def _figures(x: str) -> str:
    return count(rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')", rf"(?:^|[^\p{{L}}\p{{N}}_])(?:Figure|Fig\.+|Table)\s+\d+")


_SENT = sentences("full_text")
WRITING = rf"""
parts AS (
    SELECT p.paper_id, any_value(p.full_text) AS full_text, list_distinct(list(s.label)) AS labels, coalesce(string_agg(s.text, ' ' ORDER BY s.idx) FILTER (s.label <> 'references'), '') AS body,
        coalesce(string_agg(s.text, chr(10) ORDER BY s.idx) FILTER (s.label = 'references'), '') AS refs, count(*) FILTER (s.label = 'references') AS n_refs, list(s.heading ORDER BY s.idx) AS headings
    FROM papers p JOIN sections s ON s.paper_id = p.paper_id GROUP BY p.paper_id
),
parts_more AS (
    SELECT *, len(list_filter(['abstract', 'introduction', 'methods', 'results', 'conclusion'], lambda x: NOT list_contains(labels, x))) AS missing,
        (len(list_filter({_SENT}, lambda s: contains(s, '!'))) > 0)::INTEGER
            + ({edged('full_text', 'gonna|wanna|gotta|kids|stuff|things like|a lot of|very nice|pretty good|super important|huge deal', 'i')} > 0)::INTEGER
            + ({edged('full_text', 'I|we|my|our|ours')} / greatest({count('full_text', RUNS)}, 1)::DOUBLE > 0.03)::INTEGER AS informal,
        regexp_matches(body, {q(IEEE)}) AS ieee, regexp_matches(body, {q(APA)}) AS apa,
        len(list_filter(list_distinct(regexp_extract_all(refs, {q(IEEE)})), lambda x: NOT list_contains(regexp_extract_all(body, {q(IEEE)}), x))) AS orphans,
        {_figures('full_text')} AS declared, {_figures('body')} AS called,
        list_filter(headings, lambda h: h <> '') AS named
    FROM parts
),
parts_numbered AS (SELECT *, list_transform(list_filter(named, lambda h: regexp_matches(h, '^\d')), lambda h: TRY_CAST(regexp_extract(h, '^(\d+)', 1) AS INTEGER)) AS numbers FROM parts_more),
checks AS (
    SELECT paper_id, CASE WHEN missing = 0 THEN 100.0::DOUBLE ELSE greatest(0, 100 - missing * 18) * CASE WHEN list_contains(labels, 'discussion') THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END END AS structure,
        greatest(0, 100 - informal * 22)::DOUBLE AS tone,
        (CASE WHEN ieee AND apa THEN 55 WHEN ieee OR apa THEN 95 WHEN n_refs > 0 THEN 30 ELSE 70 END)::DOUBLE AS style,
        (CASE WHEN orphans = 0 THEN 100 ELSE greatest(10, 100 - orphans * 15) END)::DOUBLE AS linkage,
        (CASE WHEN declared > called + 1 THEN greatest(20, 100 - (declared - called) * 20) ELSE 100 END)::DOUBLE AS figures,
        (100 - 25 * ((len(numbers) > 0 AND len(numbers) < len(named))::INTEGER + (len(numbers) >= 2 AND numbers <> range(1, len(numbers) + 1))::INTEGER))::DOUBLE AS hierarchy,
        CASE WHEN ieee AND NOT apa THEN 'ieee' ELSE 'none' END AS citation_style
    FROM parts_numbered
),
writing AS (
    SELECT *, CASE WHEN writing_score >= 80 THEN 'Meets standard' WHEN writing_score >= 55 THEN 'Minor issues' ELSE 'Needs revision' END AS grade
    FROM (SELECT *, {half("round(structure * 0.30::DOUBLE + tone * 0.20::DOUBLE + style * 0.20::DOUBLE + linkage * 0.15::DOUBLE + figures * 0.075::DOUBLE + hierarchy * 0.075::DOUBLE, 9)")}::INTEGER AS writing_score FROM checks)
)
"""
_HINTS = " + ".join(f"(length(lower(full_text)) - length(replace(lower(full_text), {q(p)}, ''))) // {len(p)}" for p in PHRASES)
AI = rf"""
ai_rows AS (SELECT paper_id, {latin('full_text')} AS w, {count('full_text', '[.!?]')} AS marks, {count('full_text', '[;:,]')} AS commas, {_HINTS} AS hints FROM papers),
ai_scored AS (
    SELECT paper_id, greatest(0.02::DOUBLE, least(0.98::DOUBLE, 0.10::DOUBLE + least(0.40::DOUBLE, (1.0::DOUBLE - len(list_distinct(w)) / greatest(len(w), 1)::DOUBLE) * 0.7::DOUBLE) + least(0.20::DOUBLE, hints / 10.0::DOUBLE)
        + least(0.15::DOUBLE, greatest(greatest(len(w), 1) / greatest(marks, 1)::DOUBLE - 20, 0.0::DOUBLE) / 80) + least(0.08::DOUBLE, commas / 250.0::DOUBLE))) AS ai_score
    FROM ai_rows
),
ai AS (
    SELECT paper_id, ai_score, 'heuristic' AS ai_engine, {half('ai_score * 100', 1)} AS ai_probability, CASE WHEN ai_score >= 0.62 OR ai_score <= 0.38 THEN 'high' ELSE 'low' END AS ai_confidence,
        CASE WHEN ai_score >= 0.62 THEN 'Regular as machine-written text is.' WHEN ai_score <= 0.38 THEN 'Irregular as people write.' ELSE 'Neither regular nor irregular; undecided.' END AS ai_explanation
    FROM ai_scored
)
"""


def spread(pieces: str) -> str:
    lengths = f"list_transform(list_filter({pieces}, lambda s: regexp_matches(s, '\\S')), lambda s: {n_tokens('s')}::DOUBLE)"
    return f"coalesce(list_stddev_pop({lengths}) / greatest(list_avg({lengths}), 1e-6::DOUBLE), 0.0)"


STYLE = rf"""
style_words AS (SELECT paper_id, w, count(*) AS c FROM (SELECT paper_id, unnest({latin('full_text')}) AS w FROM papers) GROUP BY paper_id, w),
style_sums AS (SELECT paper_id, sum(c) AS n, count(*) AS u, coalesce(sum(c) FILTER (w IN {names(STOPWORDS)}), 0) AS stop FROM style_words GROUP BY paper_id),
style_entropy AS (SELECT s.paper_id, sum(c / n::DOUBLE * ln(greatest(1e-9::DOUBLE, c / u::DOUBLE))) AS e FROM style_words w JOIN style_sums s ON s.paper_id = w.paper_id GROUP BY s.paper_id),
style AS (
    SELECT p.paper_id, coalesce(u, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS ttr, least(exp(-coalesce(e, 0.0)), 500.0::DOUBLE) / 500 AS perplexity, {spread(r"string_split_regex(full_text, '[.!?]+')")} AS burstiness,
        coalesce(stop, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS stop_ratio, 1 - coalesce(u, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS repetition, {count('full_text', '[;:,]')} / greatest(coalesce(n, 0), 1)::DOUBLE AS punctuation,
        {spread("string_split(full_text, chr(10) || chr(10))")} AS paragraph_cv
    FROM papers p LEFT JOIN style_sums s ON s.paper_id = p.paper_id LEFT JOIN style_entropy x ON x.paper_id = p.paper_id
)
"""


def _terms(x: str) -> str:
    words = f"list_filter(regexp_extract_all(lower({x}), '{RUNS}'), lambda w: length(w) >= 2 AND w NOT IN {names(COMMON)})"
    return f"list_concat({words}, CASE WHEN len({words}) > 1 THEN list_transform(list_zip(({words})[:-2], ({words})[2:]), lambda t: t[1] || ' ' || t[2]) ELSE []::VARCHAR[] END)"


CORPUS = "corpus AS (SELECT item_id, 'Item ' || item_id AS title, text, 'arXiv open abstract corpus' AS corpus FROM benchmark)"
TFIDF = f"""
corpus_tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM corpus) GROUP BY item_id, term),
corpus_n AS (SELECT count(*) AS n FROM corpus),
corpus_df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM corpus_tf GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM corpus_df, corpus_n WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 20000),
corpus_raw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM corpus_tf JOIN idf USING (term)),
corpus_w AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM corpus_raw)
"""
HITS = f"""
chunk_tf AS (SELECT paper_id, idx, pos, term, count(*) AS tf FROM (SELECT paper_id, idx, pos, unnest({_terms('chunk')}) AS term FROM chunks) GROUP BY paper_id, idx, pos, term),
chunk_raw AS (SELECT paper_id, idx, pos, term, (1 + ln(tf)) * idf AS w FROM chunk_tf JOIN idf USING (term)),
chunk_w AS (SELECT paper_id, idx, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY paper_id, idx, pos)) AS weight FROM chunk_raw),
cosines AS (SELECT c.paper_id, c.idx, c.pos, o.item_id, sum(c.weight * o.weight) AS score FROM chunk_w c JOIN corpus_w o ON o.term = c.term GROUP BY c.paper_id, c.idx, c.pos, o.item_id),
best_cosines AS (SELECT *, row_number() OVER (PARTITION BY paper_id, idx, pos ORDER BY round(score, 9) DESC, item_id) AS r FROM cosines),
hits AS (SELECT b.paper_id, b.idx, b.pos, b.item_id, c.title, c.corpus, b.score FROM best_cosines b JOIN corpus c ON c.item_id = b.item_id WHERE r = 1 AND round(score, 9) >= 0.6)
"""
MATCHES = f"""
hit_text AS (SELECT h.*, c.chunk, {half('round(h.score * 100, 7)', 1)} AS similarity, row_number() OVER (PARTITION BY h.paper_id, h.title ORDER BY h.idx, h.pos) AS o FROM hits h JOIN chunks c ON c.paper_id = h.paper_id AND c.idx = h.idx AND c.pos = h.pos),
hit_rank AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY similarity DESC, idx, pos)::INTEGER AS rank FROM hit_text WHERE o = 1),
matches AS (SELECT paper_id, rank, title, corpus, similarity, substring(chunk, 1, 180) AS matched_text FROM hit_rank WHERE rank <= 6)
"""
# a paper's matches, longest first, each found by its places in lower case; a place that a chosen one overlaps falls out
OVERLAY = """
mark_order AS (SELECT paper_id, title, similarity, lower(matched_text) AS m, row_number() OVER (PARTITION BY paper_id ORDER BY length(matched_text) DESC, rank) AS k FROM matches WHERE length(matched_text) >= 10),
mark_stretches AS (
    SELECT paper_id, 0::BIGINT AS k, [{'s': full_text, 'title': NULL::VARCHAR}] AS parts FROM papers
    UNION ALL
    SELECT x.paper_id, x.k + 1, flatten(list_transform(x.parts, lambda p: CASE WHEN p.title IS NOT NULL OR NOT contains(lower(p.s), o.m) THEN [p] ELSE
        flatten(list_transform(range(1, len(string_split(lower(p.s), o.m)) + 1), lambda i: [
            {'s': substring(p.s, 1 + (i - 1) * length(o.m) + list_sum(list_transform(string_split(lower(p.s), o.m)[1:i - 1] || [''], lambda y: length(y)))::BIGINT, length(string_split(lower(p.s), o.m)[i])), 'title': NULL::VARCHAR},
            {'s': substring(p.s, 1 + (i - 1) * length(o.m) + list_sum(list_transform(string_split(lower(p.s), o.m)[1:i], lambda y: length(y)))::BIGINT, length(o.m)), 'title': o.title || ' (' || o.similarity || '%)'}]))[:-2] END))
    FROM mark_stretches x JOIN mark_order o ON o.paper_id = x.paper_id AND o.k = x.k + 1
),
overlaid AS (
    SELECT paper_id, len(list_filter(arg_max(parts, k), lambda p: p.title IS NOT NULL)) AS marks,
        array_to_string(list_transform(arg_max(parts, k), lambda p: CASE WHEN p.title IS NULL THEN p.s ELSE '<mark title="' || p.title || '">' || p.s || '</mark>' END), '') AS marked
    FROM mark_stretches GROUP BY paper_id
)
"""
DUPLICATES = f"""
chunk_sets AS (SELECT paper_id, idx, pos, chunk, list_distinct(regexp_extract_all(lower(chunk), '\\S+')) AS w FROM chunks),
chunk_words AS (SELECT paper_id, idx, pos, len(w) AS n, unnest(w) AS word FROM chunk_sets WHERE len(w) >= 25),
shared AS (
    SELECT a.paper_id, a.idx AS i, a.pos AS p, b.idx AS j, b.pos AS q, a.n AS x, b.n AS y, count(*) AS common FROM chunk_words a
    JOIN chunk_words b ON b.paper_id = a.paper_id AND b.word = a.word AND (b.idx > a.idx OR b.idx = a.idx AND b.pos > a.pos) AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n
    GROUP BY a.paper_id, a.idx, a.pos, b.idx, b.pos, a.n, b.n
),
repeated AS (SELECT *, common / (x + y - common)::DOUBLE AS s FROM shared WHERE common / (x + y - common)::DOUBLE >= 0.85),
repeated_first AS (SELECT r.*, c.chunk, row_number() OVER (PARTITION BY r.paper_id, substring(c.chunk, 1, 150) ORDER BY i, p, j, q) AS o FROM repeated r JOIN chunks c ON c.paper_id = r.paper_id AND c.idx = r.i AND c.pos = r.p),
duplicates AS (SELECT paper_id, i AS idx, p AS pos, {half('s * 100', 1)} AS similarity, substring(chunk, 1, 180) AS matched_text FROM repeated_first WHERE o = 1)
"""
PLAGIARISM = f"""
match_sums AS (SELECT paper_id, count(*) AS n, max(similarity) AS top, arg_min(title, rank) AS title FROM matches GROUP BY paper_id),
dup_sums AS (SELECT paper_id, count(*) AS d FROM duplicates GROUP BY paper_id),
plag_rows AS (SELECT s.paper_id, s.sections, coalesce(m.n, 0) AS n_matches, m.top AS top_similarity, m.title AS top_title, coalesce(d.d, 0) AS duplicate_paragraphs FROM (SELECT paper_id, count(*) AS sections FROM sections GROUP BY paper_id) s LEFT JOIN match_sums m USING (paper_id) LEFT JOIN dup_sums d USING (paper_id)),
plagiarism AS (
    SELECT paper_id, sc AS plagiarism_score, CASE WHEN sc <= 5 THEN 'The corpus holds nothing alike.' WHEN sc <= 25 THEN 'A few passages are like texts of the corpus.'
            WHEN sc <= 50 THEN 'Several passages are like texts of the corpus.' ELSE 'Large parts are like texts of the corpus.' END AS plagiarism_summary,
        n_matches, top_similarity, top_title, duplicate_paragraphs, sections
    FROM (SELECT *, (CASE WHEN n_matches > 0 THEN {half("least(100.0::DOUBLE, round(top_similarity * 0.6::DOUBLE + n_matches * 6, 9))")} WHEN duplicate_paragraphs > 0 THEN least(100, duplicate_paragraphs * 12 + 20) ELSE 0 END)::INTEGER AS sc FROM plag_rows)
)
"""


def _web(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda w: w NOT IN {names(WEB_STOPWORDS)}))"


def overlap(a: str, b: str) -> str:
    return f"{half(f'({jaccard(_web(a), _web(b))}) * 100')}::INTEGER"


WEB = rf"""
web_results AS (
    SELECT substring({strip('text')}, 1, 200) AS query, CASE item_id % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'brave' ELSE 'duckduckgo' END AS provider, 1 AS spot, 'http://items.example.org/' || item_id AS url, 'Item ' || item_id AS title, text AS description FROM benchmark
    UNION ALL SELECT substring({strip('text')}, 1, 200), 'duckduckgo', 2, 'http://other.example.org/' || item_id, 'Other ' || item_id, NULL FROM benchmark
),
web_order AS (SELECT *, CASE provider WHEN 'google' THEN 0 WHEN 'brave' THEN 1 ELSE 2 END AS o FROM web_results),
web_best AS (SELECT * FROM (SELECT *, min(o) OVER (PARTITION BY query) AS m FROM web_order) WHERE o = m),
web_segments AS (SELECT doc_id AS paper_id, pos, unnest AS segment FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS unnest FROM documents) UNION ALL SELECT -1 - item_id, 0, {strip('text')} FROM benchmark),
web_asked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS n FROM web_segments),
web_scored AS (SELECT a.paper_id, a.n, b.spot, b.url, b.title, b.description, a.segment, b.provider, {overlap('a.segment', "b.title || ' ' || coalesce(b.description, '')")} AS similarity FROM web_asked a JOIN web_best b ON b.query = substring(a.segment, 1, 200) WHERE a.n <= 5 AND regexp_matches(a.segment, '\S')),
web_ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY similarity DESC, n, spot)::INTEGER AS rank FROM web_scored WHERE similarity >= 25),
web AS (SELECT paper_id, rank, url, title, substring(coalesce(description, ''), 1, 240) AS snippet, substring(segment, 1, 140) AS matched_text, similarity, provider FROM web_ranked WHERE rank <= 15)
"""
LONG = f"""
counted AS (SELECT paper_id, filename, full_text, {count('full_text', WORD)}::INTEGER AS word_count FROM all_papers),
papers AS (SELECT * FROM counted WHERE word_count >= 60)
"""
CREDIBILITY = f"""
modules AS (
    SELECT p.paper_id, p.filename, p.word_count, sha256(p.full_text) AS file_hash, a.* EXCLUDE (paper_id), g.* EXCLUDE (paper_id), v.* EXCLUDE (paper_id), s.* EXCLUDE (paper_id), w.* EXCLUDE (paper_id), t.* EXCLUDE (paper_id)
    FROM papers p JOIN ai a ON a.paper_id = p.paper_id JOIN plagiarism g ON g.paper_id = p.paper_id JOIN validity v ON v.paper_id = p.paper_id JOIN statistics s ON s.paper_id = p.paper_id JOIN writing w ON w.paper_id = p.paper_id JOIN provenance t ON t.paper_id = p.paper_id
),
contributed AS (
    SELECT *, {half('round((100 - ai_probability) * 0.25::DOUBLE, 9)', 1)} AS c1, {half('round((100 - plagiarism_score) * 0.20::DOUBLE, 9)', 1)} AS c2, {half('round(citation_score * 0.25::DOUBLE, 9)', 1)} AS c3,
        {half('round((100 - statistical_risk) * 0.10::DOUBLE, 9)', 1)} AS c4, {half('round(writing_score * 0.20::DOUBLE, 9)', 1)} AS c5
    FROM modules
),
credibility AS (
    SELECT *, CASE WHEN credibility >= 75 THEN 'Credible' WHEN credibility >= 50 THEN 'Needs review' ELSE 'High risk' END AS verdict,
        list_filter([CASE WHEN ai_probability >= 60 THEN 'Machine-written text is likely (' || ai_probability || '%).' END, CASE WHEN plagiarism_score >= 25 THEN 'Much of the text stands elsewhere (' || plagiarism_score || '%).' END,
            CASE WHEN citation_score < 60 THEN 'Few citations hold (' || citation_score || '%).' END, CASE WHEN statistical_risk >= 20 THEN 'The numbers look wrong (risk ' || statistical_risk || '%).' END,
            CASE WHEN writing_score < 55 THEN 'Writing conventions are broken.' END], lambda x: x IS NOT NULL) AS risk_triggers,
        list_filter([CASE WHEN ai_probability >= 60 THEN 'Ask the authors for earlier drafts.' END, CASE WHEN plagiarism_score >= 20 THEN 'Check the marked passages with another similarity service.' END,
            CASE WHEN total_dois > valid_dois THEN 'Look up by hand each reference whose DOI isn''t known.' END, CASE WHEN bare_references > 2 THEN 'Look up by hand the references that have no DOI.' END,
            CASE WHEN statistical_risk >= 20 THEN 'Recompute the p-values and the main results.' END,
            CASE WHEN NOT (ai_probability >= 60 OR plagiarism_score >= 20 OR total_dois > valid_dois OR bare_references > 2 OR statistical_risk >= 20) THEN 'Nothing to do before an ordinary review.' END], lambda x: x IS NOT NULL) AS action_items
    FROM (SELECT *, {half('round(c1 + c2 + c3 + c4 + c5, 6)')}::INTEGER AS credibility FROM contributed)
)
"""


def sql(final: str, *ctes: str) -> str:
    """A query over papers (of any length) and further tables."""
    return "WITH " + ", ".join(x.strip() for x in (PAPERS_SQL, *ctes)) + "\n" + final


def full(final: str) -> str:
    """A query over the results of the whole analysis."""
    papers = PAPERS_SQL.replace("papers AS (SELECT doc_id AS paper_id", "all_papers AS (SELECT doc_id AS paper_id")
    parts = (papers, LONG, WORKS_SQL, CORPUS, SECTIONS, CHUNKS, CITING, CITED, VALIDITY, RETRACTED, CONTAMINATION, GRAPH, VERDICTS, ALIGNMENT, STATS, FINGERPRINT, PROVENANCE, WRITING, AI, TFIDF, HITS, MATCHES, DUPLICATES, PLAGIARISM, CREDIBILITY)
    return "WITH " + ", ".join(x.strip() for x in parts) + "\n" + final
