"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

import re

from .license_rules import ANCHORS, RULES, SENTENCES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql(longest: int = 96) -> str:
    """Sentences as runs of at most `longest` lines between cuts, looked up as a whole;
    from the first line on, the longest run that is known, then on after it. The tables
    are those of the module, what is made of texts is not."""
    pairs = [(" ".join(w for w in re.split(r"\W|_", s.lower()) if w), k) for k, forms in SENTENCES.items() for s in forms]
    keys, ids = ", ".join(_text(s) for s, _ in pairs), ", ".join(_text(k) for _, k in pairs)
    steps = [
        f"a AS (SELECT doc_id, replace(replace(lower(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE regexp_matches(lower(text), {_text('|'.join(ANCHORS))}))",
        # lines without leaders; one that is empty then, after the first, ends a sentence
        "b AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x, i: CASE WHEN i = 1 THEN x ELSE regexp_replace(regexp_replace(x, '^[^a-z0-9]+', ''), '^((rem|dnl)[ \t]+|([0-9]{1,2}|[a-z])[.)][ \t]+)', '') END) AS l FROM a)",
        "c AS (SELECT doc_id, list_transform(l, lambda x, i: CASE WHEN i > 1 AND i < len(l) AND x = '' THEN '@' ELSE regexp_replace(regexp_replace(x || ' ', '[.;:!?]([ \t])', '@\\1', 'g'), '[^a-z0-9@]+', ' ', 'g') END) AS l FROM (SELECT doc_id, list_transform(l, lambda x: replace(x, '@', ' ')) AS l FROM b))",
        "d AS (SELECT doc_id, unnest(string_split(array_to_string(l, '#'), '@')) AS s, generate_subscripts(string_split(array_to_string(l, '#'), '@'), 1) AS n FROM c)",
        f"e AS (SELECT doc_id, n, list_transform(string_split(s, '#'), lambda x: trim(x)) AS l FROM d WHERE regexp_matches(replace(s, '#', ' '), {_text('|'.join(ANCHORS))}))",
        f"""f AS (SELECT doc_id, n, i, j, array_to_string(list_filter(l[i:j], lambda x: x <> ''), ' ') AS w FROM (SELECT doc_id, n, l, i, unnest(range(i, least(len(l), i + {longest - 1}) + 1)) AS j FROM (SELECT doc_id, n, l, unnest(range(1, len(l) + 1)) AS i FROM e)) WHERE l[i] <> '' AND l[j] <> '')""",
        f"g AS (SELECT doc_id, n, i, j, list_extract([{ids}], list_position([{keys}], w)) AS id FROM f WHERE w IN ({keys}))",
        "h AS (SELECT doc_id, list({'n': n, 'i': i, 'j': j, 'ids': id} ORDER BY n, i, j DESC) AS found FROM g GROUP BY doc_id)",
        "k AS (SELECT doc_id, list_reduce(found, lambda x, y: CASE WHEN y.n > x.n OR y.i > x.j THEN {'n': y.n, 'i': y.i, 'j': y.j, 'ids': x.ids || ' ' || y.ids} ELSE x END).ids AS ids FROM h)",
        "r0 AS (SELECT doc_id, coalesce(len(string_split(ids, ' ')), 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, ' ' || coalesce(ids, '') || ' ' AS left_, []::VARCHAR[] AS names FROM documents LEFT JOIN k USING (doc_id))",
    ]
    for k, (name, seq) in enumerate(RULES):
        want = _text(" " + "  ".join(seq) + " ")
        steps.append(
            f"r{k + 1} AS (SELECT doc_id, n_sentences, sentence_ids, regexp_replace(replace(replace(left_, ' ', '  '), {want}, ' | '), ' +', ' ', 'g') AS left_, "
            f"CASE WHEN sentence_ids <> '' AND contains(replace(left_, ' ', '  '), {want}) AND NOT list_contains(names, {_text(name)}) THEN list_append(names, {_text(name)}) ELSE names END AS names FROM r{k})"
        )
    return f"WITH {', '.join(steps)} SELECT doc_id, n_sentences::BIGINT AS n_sentences, sentence_ids, coalesce(array_to_string(names, ','), '') AS licences, list_extract(names, 1) AS licence FROM r{len(RULES)}"


def warc_sql(least: int = 1000) -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest,
             CASE WHEN octet_length(b) >= {least} THEN max(page_id) OVER (PARTITION BY sha1(b), octet_length(b)) END AS m FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to FROM d"""


def near_vectors_sql(least: float = 0.98) -> str:
    return f"""
WITH RECURSIVE ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {least}),
reach(vec_id, m) AS (SELECT vec_id, vec_id FROM ok UNION SELECT links.b, reach.m FROM reach JOIN links ON links.a = reach.vec_id WHERE reach.m < links.b),
low AS (SELECT vec_id, min(m) AS m FROM reach GROUP BY vec_id),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, coalesce(low.m, e.vec_id) AS component_id, coalesce(low.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN deg USING (vec_id) LEFT JOIN low USING (vec_id)"""


def near_duplicates_sql(least: float = 0.8) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
one AS (SELECT doc_id, unnest(s) AS x FROM sh),
size AS (SELECT doc_id, len(s) AS n FROM sh),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE c::DOUBLE / (p.n + q.n - c) >= {least}),
reach(doc_id, m) AS (SELECT doc_id, doc_id FROM size UNION SELECT links.b, reach.m FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.m < links.b),
low AS (SELECT doc_id, min(m) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(low.m, d.doc_id) AS class_id, coalesce(low.m, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN low USING (doc_id)"""
