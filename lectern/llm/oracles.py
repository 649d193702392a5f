"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from lectern.llm import licenses

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def substring_sql(width: int = 20) -> str:
    return f"""
    WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
    word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
    win AS (SELECT doc_id, s, array_to_string(ws[s:s + {width - 1}], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS s FROM w WHERE len(ws) >= {width})),
    late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
    gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + {width})) AS i FROM late)),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""


def near_sql(k: int, num: int, den: int, table: str = "documents") -> str:
    """CTEs up to near(doc_id, n_shingles, component_id)."""
    return f"""
    nw AS (SELECT doc_id, {_WORDS.format(_LOW.format("text"))} AS ws FROM {table}),
    ns AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + {k - 1}], ' ') AS g
           FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 2}, 2))) AS s FROM nw WHERE len(ws) > 0)),
    nn AS (SELECT doc_id, count(*) AS n FROM ns GROUP BY doc_id),
    nl AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM ns x JOIN ns y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
           JOIN nn p1 ON p1.doc_id = a JOIN nn p2 ON p2.doc_id = b WHERE {den} * c >= {num} * (p1.n + p2.n - c)),
    nr AS (SELECT doc_id AS id, doc_id AS r FROM {table} UNION SELECT nl.b, nr.r FROM nr JOIN nl ON nl.a = nr.id),
    near AS (SELECT d.doc_id, CAST(coalesce(max(nn.n), 0) AS BIGINT) AS n_shingles, min(nr.r) AS component_id
             FROM {table} d JOIN nr ON nr.id = d.doc_id LEFT JOIN nn ON nn.doc_id = d.doc_id GROUP BY d.doc_id)"""


def near_duplicates_sql() -> str:
    return f"WITH RECURSIVE {near_sql(2, 4, 5)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near"


def licenses_sql() -> str:
    rows = ", ".join(
        f"({i}, '{label}', {kind}, string_split('{phrase}', ' '))"
        for i, (phrase, label, kind) in enumerate([*((p, x, "true") for p, x in licenses.BASE.items()), *((p, x, "false") for x, p in licenses.NOTICES.items())])
    )
    k, near, share = licenses.K, licenses.NEAR, licenses.SHARE
    return rf"""
    WITH tpl(t, label, base, ws) AS (VALUES {rows}),
    tg AS (SELECT t, label, base, len(ws) AS m, pos, array_to_string(ws[pos + 1:pos + {k}], ' ') AS g
           FROM (SELECT *, unnest(range(0, len(ws) - {k - 1})) AS pos FROM tpl)),
    w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    dg AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + {k}], ' ') AS g
           FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {k - 1})) AS p FROM w WHERE len(ws) >= {k})),
    hit AS (SELECT DISTINCT doc_id, t, label, base, m, pos, p - pos AS d FROM dg JOIN tg USING (g)),
    place AS (SELECT doc_id, t, label, m, d FROM hit WHERE base GROUP BY ALL HAVING count(*) = m - {k - 1}),
    diag AS (SELECT DISTINCT doc_id, t, label, m, d FROM hit WHERE NOT base),
    isle AS (SELECT *, sum(CASE WHEN d - before <= {near} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, t ORDER BY d) AS run
             FROM (SELECT *, lag(d) OVER (PARTITION BY doc_id, t ORDER BY d) AS before FROM diag)),
    span AS (SELECT isle.doc_id, isle.t, isle.label, isle.m, isle.run, count(DISTINCT hit.pos + o.o) AS found
             FROM isle JOIN hit ON hit.doc_id = isle.doc_id AND hit.t = isle.t AND hit.d = isle.d CROSS JOIN (SELECT unnest(range(0, {k})) AS o) o
             GROUP BY ALL HAVING found >= ceil(isle.m * {share})),
    lab AS (SELECT doc_id, label, true AS base, 1.0 AS score FROM place UNION ALL SELECT doc_id, label, false, found / m FROM span),
    su AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score,
                  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels FROM lab GROUP BY doc_id),
    pl AS (SELECT doc_id, count(*) AS n, min(d) AS lo, max(d) AS hi FROM place GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(pl.n, 0) AS BIGINT) AS n_base, CAST(pl.lo AS BIGINT) AS first_word,
           CAST(pl.hi AS BIGINT) AS last_word, coalesce(su.base_labels, '') AS base_labels, coalesce(su.labels, '') AS labels,
           CAST(coalesce(su.score, 0.0) AS DOUBLE) AS score
    FROM w LEFT JOIN su ON su.doc_id = w.doc_id LEFT JOIN pl ON pl.doc_id = w.doc_id"""


def resample_sql(percent: int = 10, least: int = 20, seed: str = "2024") -> str:
    """CRC-32 is worked out from its table's rule, once a different word."""
    n = 10000
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                     lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    dw AS (SELECT doc_id, unnest({words.format(_LOW.format("coalesce(text, '')"))}) AS w FROM documents),
    bw AS (SELECT unnest({words.format(_LOW.format("coalesce(text, '')"))}) AS w FROM benchmark),
    vocab AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
    code AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {n} AS b FROM vocab, tab),
    s AS (SELECT b, count(*) AS n FROM dw JOIN code USING (w) GROUP BY b),
    t AS (SELECT b, count(*) AS n FROM bw JOIN code USING (w) GROUP BY b),
    tot AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) AS s, CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) AS t),
    gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (tot.s + {n}) / ((s.n + 1.0::DOUBLE) * (tot.t + {n})))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), tot),
    wt AS (SELECT doc_id, count(*) AS n, sum(g) AS weight FROM dw JOIN code USING (w) JOIN gain USING (b) GROUP BY doc_id),
    sc AS (SELECT d.doc_id, CAST(coalesce(wt.n, 0) AS BIGINT) AS n_features, CAST(coalesce(wt.weight, 0) AS BIGINT) AS weight,
                  CAST(coalesce(wt.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
           FROM documents d LEFT JOIN wt USING (doc_id)),
    rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS many FROM sc WHERE n_features >= {least})
    SELECT sc.*, CASE WHEN r <= {percent} * many // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)"""
