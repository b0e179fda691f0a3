"""DuckDB SQL of the operators that SQL can express, by brute force."""

from __future__ import annotations

import re

from treeloom.llm import quality

_BLANK = r"[\x20\x09-\x0D]"
_REACH = """reach(id, r) AS (SELECT id, id FROM every UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r)"""


def quality_rules() -> str:
    def bits(names: list[str] | None = None) -> str:
        chosen = [(i, c) for i, (n, c) in enumerate(quality.RULES) if names is None or n in names]
        return " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in chosen)

    removed = lambda chars: f"length(t) - length(regexp_replace(t, '{chars}', '', 'g'))"
    return rf"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS t, [x for x in regexp_split_to_array(coalesce(text, ''), '{_BLANK}+') if x <> ''] AS ws,
            [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
        win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM w, unnest(range(1, len(ws) - 6)) u(i)),
        dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, {removed(r'[#*$%&|<>]')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
            CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, {removed('[A-Z]')} AS n_upper, {removed('[A-Za-z]')} AS n_letters, len([x for x in ws if contains(x, '!!')]) AS n_exclaims
            FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({bits(quality.POLICIES['base'])}) <> 0 AS base_failed,
        ({bits(quality.POLICIES[quality.DEFAULT_POLICY])}) = 0 AS kept, CAST({bits()} AS BIGINT) AS rule_bits FROM m"""


def ngram_jaccard_join() -> str:
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '{_BLANK}+') if x <> ''] AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM w, unnest(range(1, greatest(2, len(ws) - 3))) u(i) WHERE len(ws) > 0),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT c.a, c.b FROM c JOIN z x ON x.doc_id = c.a JOIN z y ON y.doc_id = c.b WHERE 5 * c.n >= 4 * (x.n + y.n - c.n)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        every AS (SELECT doc_id AS id FROM documents),
        {_REACH}
    SELECT k.id AS doc_id, k.class_id, coalesce(n, 0) AS n_links FROM (SELECT id, min(r) AS class_id FROM reach GROUP BY id) k LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) d ON d.a = k.id"""


def embedding_neardup() -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len([y for y in embedding if y IS NULL OR NOT isfinite(y)]) = 0 AND len([y for y in embedding if y <> 0]) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        every AS (SELECT vec_id AS id FROM embeddings),
        {_REACH}
    SELECT k.id AS vec_id, coalesce(n, 0) AS n_links, k.component_id, k.id = k.component_id AS kept
    FROM (SELECT id, min(r) AS component_id FROM reach GROUP BY id) k LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) d ON d.a = k.id"""


def repeats() -> str:
    """All windows of 50 bytes, as hexadecimal digits; texts are cut in pieces first, as substr counts from the start."""
    return """
    WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        c AS (SELECT doc_id, n, 1000 * k AS o, substr(x, 2000 * k + 1, 2098) AS piece FROM h, unnest(range(0, n // 1000 + 1)) u(k)),
        w AS (SELECT doc_id, o + i AS p, substr(piece, 2 * i + 1, 100) AS s FROM c, unnest(range(0, 1000)) u(i) WHERE o + i + 50 <= n),
        f AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s),
        g AS (SELECT DISTINCT w.doc_id, w.p FROM w JOIN f ON f.s = w.s WHERE w.doc_id > f.d),
        m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m) GROUP BY doc_id, run),
        z AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM r),
        k AS (SELECT z.doc_id, string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed
            FROM z JOIN h ON h.doc_id = z.doc_id GROUP BY z.doc_id)
    SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256 FROM h LEFT JOIN k ON k.doc_id = h.doc_id"""


def _spans(kind: str, rank: int, pattern: str, valid: str) -> str:
    """Spans of a pattern's matches that are valid, from the lengths of matches and of what lies between them."""
    quoted = pattern.replace("'", "''")
    hits, pieces = f"regexp_extract_all(t, '{quoted}')", f"regexp_split_to_array(t, '{quoted}')"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, e - length(hit) AS s, e FROM
        (SELECT doc_id, hit, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM
            (SELECT doc_id, unnest({hits}) AS hit, unnest(list_slice({pieces}, 1, len({hits}))) AS piece, generate_subscripts({hits}, 1) AS i FROM d)) WHERE {valid}"""


def _base_spans(kinds: list[tuple[str, str, str]], order: str) -> str:
    every = " UNION ALL ".join(_spans(kind, rank, pattern, valid) for rank, (kind, pattern, valid) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, _, _ in kinds)
    zeros = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in kinds)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({every}),
        g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY {order}) AS joined FROM x GROUP BY doc_id)
    SELECT d.doc_id, {zeros}, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def secrets_base() -> str:
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    group = assign.replace("'", "''")
    kinds = [("assign", assign, f"length(regexp_extract(hit, '{group}', 1)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20"), ("hex", "[0-9a-f]+", "length(hit) >= 24")]
    return _base_spans(kinds, "s, rank")


def pii_base() -> str:
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    digit = f"TRY_CAST(substr(reverse({digits}), i, 1) AS INTEGER)"
    luhn = f"list_sum([CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END for i in range(1, length({digits}) + 1)]) % 10 = 0"
    octets = "len([x for x in string_split(hit, '.') if length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255]) = 0"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", octets),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    ]
    return _base_spans(kinds, "rank, s")


def quality_ablation() -> str:
    policy = quality.POLICIES[quality.DEFAULT_POLICY]
    rules = ", ".join(f"('{name}', {1 << i})" for i, (name, _) in enumerate(quality.RULES) if name in policy)
    mask = quality.rule_mask(policy)
    return f"""
    WITH q AS ({quality_rules()}), p AS (SELECT rule_bits & {mask} AS bits, rule, bit FROM q, (VALUES {rules}) r(rule, bit))
    SELECT rule, count(*) FILTER (WHERE bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE bits = bit) AS n_failed_alone, count(*) FILTER (WHERE bits = 0 OR bits = bit) AS n_kept_without FROM p GROUP BY rule"""


def squeezed(sql: str) -> str:
    return re.sub(r"\s*\n\s*", "\n", sql).strip()
