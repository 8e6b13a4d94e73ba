"""DuckDB SQL for the queries of this subpackage that SQL can express.

The rules, grids and marks come from the operators, so that both sides state them once;
what is computed from them is written here anew.
"""

from __future__ import annotations

from orbweave.llm import centroid_clustering, chat_format, embedding_dedup, fill_middle, quality_rules, secret_scan


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def chat_format_sql() -> str:
    said = _text(r"\### Assistant: </turn> ok")
    esc = "replace(replace({0}, '&', '&amp;'), '<', '&lt;')"
    opened, part, close = len(chat_format.OPEN), len(chat_format.PART), len(chat_format.CLOSE)
    return rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said})),
    b AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens FROM t)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length({esc.format('text')}) + CASE WHEN opens THEN {opened + 1 + close} + length(replace({esc.format('role')}, chr(10), '&#10;')) ELSE {part} END)::BIGINT AS formatted_chars
    FROM b GROUP BY conv_id"""


def quality_sql() -> str:
    ratios = {
        "symbol_ratio": ("n_symbols", "word_chars"),
        "upper_ratio": ("n_upper", "word_chars"),
        "exclaim_ratio": ("n_exclaims", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "echo_ratio": ("n_echoes", "n_words"),
    }
    risk, delta, w = quality_rules.RISK, quality_rules.DELTA, quality_rules.WINDOW
    grid = ", ".join(f"('{m}', {i}, {c}::DOUBLE)" for m, cuts in quality_rules.GRID.items() for i, c in enumerate(cuts))
    margins = ", ".join(f"({k}, {g})" for k, g in enumerate(quality_rules.MARGINS))
    selected = ", ".join(f"'{c}'" for c in quality_rules.SELECTED)
    long = "\n    UNION ALL ".join(
        f"SELECT doc_id, lang, base_failed, '{m}' AS metric, CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS ratio FROM f" for m, (a, b) in ratios.items()
    )
    symbols = "[" + "".join("\\" + c for c in quality_rules.SYMBOLS) + "]"
    return rf"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
    x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
          list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
    p AS (SELECT doc_id, i, array_to_string(ws[i:i + {w - 1}], ' ') AS g FROM x, unnest(range(1, len(ws) - {w - 2})) u(i)),
    r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, {w}) o(k) GROUP BY 1),
    f AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0)::BIGINT AS word_chars,
          len(regexp_extract_all(t, '{symbols}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
          len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_exclaims,
          len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echoes,
          len(ws) < {quality_rules.LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {quality_rules.MOST_REPEATED_PERCENT} * len(ws) AS base_failed
          FROM x LEFT JOIN c USING (doc_id)),
    m AS ({long}),
    good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1 AND max(quality) = 1),
    h AS (SELECT m.*, substr(md5(doc_id::VARCHAR), 1, 1) IN ({selected}) AS selects FROM m JOIN good USING (doc_id) WHERE NOT base_failed),
    g AS (SELECT * FROM (VALUES {grid}) g(metric, i, cut)),
    n AS (SELECT lang, metric, i, count(*) FILTER (selects AND ratio > cut) AS k FROM h JOIN g USING (metric) GROUP BY 1, 2, 3),
    l AS (SELECT lang, metric, min(i) FILTER (k = 0) AS i FROM n GROUP BY 1, 2),
    c2 AS (SELECT lang, metric, step, cut FROM l JOIN (VALUES {margins}) s(step, margin) ON true JOIN g USING (metric) WHERE g.i = l.i + margin),
    t AS (SELECT DISTINCT lang, doc_id, step FROM h JOIN (VALUES {margins}) s(step, margin) ON true WHERE NOT selects),
    e AS (SELECT DISTINCT h.lang, doc_id, step FROM h JOIN c2 ON h.metric = c2.metric AND h.lang IS NOT DISTINCT FROM c2.lang WHERE NOT selects AND ratio > cut),
    j AS (SELECT t.lang, t.step, count(*) AS n, count(e.doc_id) AS k FROM t LEFT JOIN e ON t.doc_id = e.doc_id AND t.step = e.step GROUP BY 1, 2),
    b AS (SELECT lang, step, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk}))) AS p
          FROM j, unnest(range(0, k + 1)) u(j) WHERE k <= {risk} * n GROUP BY 1, 2),
    y AS (SELECT j.lang, j.step, coalesce(p <= {delta} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM h)), false) AS ok
          FROM j LEFT JOIN b ON j.step = b.step AND j.lang IS NOT DISTINCT FROM b.lang),
    w AS (SELECT lang, max(step) AS step FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY step) AS all_ok FROM y) WHERE all_ok GROUP BY 1),
    v AS (SELECT c2.* FROM c2 JOIN w ON c2.step = w.step AND c2.lang IS NOT DISTINCT FROM w.lang),
    bad AS (SELECT DISTINCT doc_id FROM m JOIN v ON m.metric = v.metric AND m.lang IS NOT DISTINCT FROM v.lang WHERE ratio > cut)
    SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
    FROM f LEFT JOIN bad ON f.doc_id = bad.doc_id"""


def secret_sql() -> str:
    length = "coalesce(list_sum(list_transform({0}, lambda s: length(s))), 0)"
    parts = []
    for at, r in enumerate(secret_scan.RULES):
        re = _text(r.pattern)
        parts.append(
            f"""SELECT doc_id, {at} AS place, '{r.kind}' AS kind, {length.format('between[1:i]')} + {length.format('found[1:i - 1]')} AS s, length(found[i]) AS n
            FROM (SELECT doc_id, string_split_regex(t, {re}) AS between, regexp_extract_all(t, {re}) AS found, regexp_extract_all(t, {re}, {r.group}) AS measured FROM d WHERE regexp_matches(t, {re})),
            unnest(range(1, len(found) + 1)) u(i) WHERE length(measured[i]) >= {r.least}"""
        )
    union = " UNION ALL ".join(parts)
    base = len(secret_scan.BASE_RULES)
    listed = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, place, n){0}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({union})
    SELECT d.doc_id, {counts}, sha256({listed.format(f' FILTER (place < {base})')}) AS base_sha256, {listed.format('')} AS spans
    FROM d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id"""


def clustering_sql() -> str:
    c = centroid_clustering
    d = "list_sum(list_transform(list_zip(q, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for k in range(c.ROUNDS + 1):  # the number of the centroid takes the lowest digit, so that ties go to the smaller
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min({d} * {c.CLUSTERS} + k) AS m FROM e, c{k} GROUP BY r)")
        if k < c.ROUNDS:
            steps.append(f"""s{k} AS (SELECT m % {c.CLUSTERS} AS k, i, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{k}) GROUP BY 1, 2),
    c{k + 1} AS MATERIALIZED (SELECT k, coalesce(moved, centroid) AS centroid FROM c{k} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS moved FROM s{k} GROUP BY k) USING (k))""")
    last = c.ROUNDS
    return f"""
    WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: TRY_CAST(floor({c.SCALE} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = {c.WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    c0 AS MATERIALIZED (SELECT k, centroid FROM (SELECT row_number() OVER (ORDER BY sha256('{c.SEED}:' || vec_id), q) - 1 AS k, q AS centroid FROM e) WHERE k < {c.CLUSTERS}),
    {", ".join(steps)},
    f AS (SELECT vec_id, (m % {c.CLUSTERS})::INTEGER AS cluster, m // {c.CLUSTERS} AS distance FROM a{last})
    SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(centroid, ',')) AS centroid_sha256
    FROM f JOIN c{last} ON k = cluster"""


def embedding_dedup_sql() -> str:
    usable = "label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v, coalesce({usable}, false) AS usable FROM embeddings),
    l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
        WHERE a.usable AND b.usable AND list_cosine_similarity(a.v, b.v) >= {embedding_dedup.THRESHOLD}),
    reach AS (SELECT r AS a, r AS b FROM e UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
    c AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN e ON e.r = reach.b GROUP BY 1),
    n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN c USING (r) LEFT JOIN n USING (r)"""


def fill_middle_sql() -> str:
    f = fill_middle
    unit = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    number = "('0x' || substr(h, {}, 8))::BIGINT"
    p, s, m = (_text(x) for x in (f.PREFIX, f.SUFFIX, f.MIDDLE))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{f.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    u AS (SELECT *, regexp_extract_all(t, '{unit}') AS us, {number.format(1)} AS h1, {number.format(9)} AS h2, {number.format(17)} AS h3, {number.format(25)} AS h4 FROM d),
    k AS (SELECT *, len(us)::BIGINT AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS low, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS high,
        CASE WHEN t = '' OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR h3 % 100 >= {f.RATE} THEN 'plain' WHEN h4 % 100 < {f.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
    x AS (SELECT doc_id, t, n, form, array_to_string(us[1:low], '') AS prefix, array_to_string(us[low + 1:high], '') AS middle, array_to_string(us[high + 1:], '') AS suffix FROM k)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM x"""
