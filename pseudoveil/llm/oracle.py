"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations


def secrets_sql(max_owners: int = 2, max_repos: int = 10) -> str:
    assign = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
              r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")
    token = assign + r"|([A-Za-z0-9+/_-]{20,})"
    kinds = [("assign", assign, f"length(regexp_extract(m, '{assign}', 2)) >= 6", f"regexp_extract(m, '{assign}', 2)"),
             ("access", "AKIA[A-Z0-9]+", "length(m) >= 20", "m"), ("hex", "[0-9a-f]{24,}", "true", "m"),
             ("token", token, f"regexp_extract(m, '{token}', 3) <> '' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') "
              "AND regexp_matches(m, '[A-Z]') AND NOT regexp_matches(m, 'AKIA[A-Z0-9]+|[0-9a-f]{24,}')", "m")]
    parts = [f"""
        SELECT doc_id, source, {k} AS k, '{name}' AS kind, lens[i] + pre AS s, lens[i] + pre + length(m) AS e, {value} AS v
        FROM (SELECT doc_id, source, i, ms[i] AS m, [list_sum([length(x) FOR x IN segs[1:j]]) FOR j IN range(1, len(ms) + 1)] AS lens,
                     coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS pre
              FROM (SELECT doc_id, source, ms, segs, unnest(range(1, len(ms) + 1)) AS i
                    FROM (SELECT doc_id, source, regexp_extract_all(text, '{pat}') AS ms, string_split_regex(text, '{pat}') AS segs FROM documents)))
        WHERE {keep}""" for k, (name, pat, keep, value) in enumerate(kinds)]
    return f"""
    WITH found AS ({" UNION ALL ".join(parts)}),
    owned AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n_owners,
        count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id::VARCHAR, ''))) AS n_repos FROM found GROUP BY v),
    judged AS (SELECT f.*, n_owners, n_repos, n_owners <= {max_owners} AND n_repos <= {max_repos} AS live FROM found f JOIN owned USING (v)),
    per_doc AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3 OR live) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND k < 3) AS n_copied,
        max(n_owners) FILTER (k < 3 OR live) AS most_owners, max(n_repos) FILTER (k < 3 OR live) AS most_repos
        FROM judged GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
           coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
    FROM documents d LEFT JOIN per_doc USING (doc_id)"""


def linededup_sql(min_chars: int = 40) -> str:
    """Shortest runs of ``min_chars`` from every line on and up to every line;
    a run with an earlier copy goes.  Every longer repeated run is a union of such runs."""
    return f"""
    WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    line AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM docs),
    size AS (SELECT *, sum(length(trim(lines[p]))) OVER (PARTITION BY doc_id ORDER BY p) AS upto, length(trim(lines[p])) AS n FROM line),
    run AS (
        SELECT a.doc_id, a.p AS x, min(b.p) AS y FROM size a JOIN size b ON a.doc_id = b.doc_id AND b.p >= a.p
            AND b.upto - a.upto + a.n >= {min_chars} GROUP BY 1, 2
        UNION
        SELECT a.doc_id, max(b.p), a.p FROM size a JOIN size b ON a.doc_id = b.doc_id AND b.p <= a.p
            AND a.upto - b.upto + b.n >= {min_chars} GROUP BY 1, 3),
    named AS (SELECT r.*, d.lines[x:y] AS body FROM run r JOIN docs d USING (doc_id)),
    judged AS (SELECT doc_id, x, y, row_number() OVER (PARTITION BY body ORDER BY doc_id, x) > 1 AS later FROM named),
    gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(x, y + 1)) AS p FROM judged WHERE later) GROUP BY 1)
    SELECT d.doc_id, CASE WHEN g.ps IS NULL THEN d.text ELSE
               array_to_string([k.lines[i] FOR i IN range(1, len(k.lines) + 1) IF NOT list_contains(g.ps, i)], chr(10)) END AS text,
           coalesce(len(k.lines), 0)::INT AS lines_total, coalesce(len(g.ps), 0)::INT AS lines_removed
    FROM documents d LEFT JOIN docs k USING (doc_id) LEFT JOIN gone g USING (doc_id)"""


def decontaminate_sql(window: int = 10) -> str:
    def split(table, key):
        return (f"SELECT {key} AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}")
    return f"""
    WITH doc AS ({split("documents", "doc_id")}), item AS ({split("benchmark", "item_id")}),
    wins AS (SELECT DISTINCT id AS item_id, n, w[p:p + n - 1] AS k FROM (
        SELECT id, w, least(len(w), {window}) AS n, unnest(range(1, greatest(len(w) - {window} + 2, 2))) AS p FROM item WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM wins),
    place AS (SELECT id, n, p, w[p:p + n - 1] AS k FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, sizes WHERE len(w) >= n)),
    hit AS (SELECT id, p, n, item_id FROM place JOIN wins USING (n, k)),
    word AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
    items AS (SELECT id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
              FROM (SELECT DISTINCT id, item_id::VARCHAR AS name FROM hit) GROUP BY 1)
    SELECT id AS doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM doc LEFT JOIN word USING (id) LEFT JOIN items USING (id)"""


def bitplanes_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain differences instead of bit planes."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, vec_id, v, (min([d, c]))[1] AS distance, (min([d, c]))[2] AS c FROM
            (SELECT r, vec_id, kept.v, c, list_sum([(kept.v[i] - c{n}.v[i]) * (kept.v[i] - c{n}.v[i]) FOR i IN range(1, 65)])::BIGINT AS d
             FROM kept, c{n}) GROUP BY ALL)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m.v, c0.v) AS v FROM c{n} c0 LEFT JOIN
            (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS v FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n
             FROM a{n}, range(1, 65) AS g(i) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return f"""
    WITH {", ".join(parts)}
    SELECT vec_id, a.c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
           (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} f USING (c)"""
