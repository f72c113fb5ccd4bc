"""The same results in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

from catalog.inputs import HUMAN_SOURCES
from postmill.functions import fixed
from postmill.operators import minhash
from postmill.operators.encode import SPECIAL

WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
HUMAN = "source IN (" + ", ".join(f"'{s}'" for s in HUMAN_SOURCES) + ")"
LABEL = "CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 1 THEN 1 ELSE 0 END"
LABELLED = f"SELECT d.doc_id, d.text, d.source, d.lang, d.n_chars, CAST({LABEL} AS INTEGER) AS label FROM documents d JOIN labels l USING (doc_id)"
MAIN = f"SELECT d.doc_id, d.text AS tweet, CASE WHEN l.doc_id IS NULL THEN NULL ELSE {LABEL} END AS sentiment FROM documents d LEFT JOIN labels l USING (doc_id)"
GUESS = "CASE WHEN n_chars % 17 = 0 THEN NULL WHEN n_chars > 2000 THEN 2 WHEN n_chars > 300 THEN 1 ELSE 0 END"
PREDICTED = f"SELECT doc_id, label, {GUESS} AS predicted FROM ({LABELLED})"
NAMES = "CASE {} WHEN 0 THEN 'neutral' WHEN 1 THEN 'bullish' WHEN 2 THEN 'bearish' END"


def mask(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, 'http[^{WS}]+', '[URL]', 'g'), '@[^{WS}]+', '@USER', 'g')"


def at_least(text: str, n: int) -> str:
    return f"regexp_matches({text}, '^[{WS}]*([^{WS}]+[{WS}]+){{{n - 1}}}[^{WS}]')"


def normal(source: str, columns: str = "") -> str:
    """Normalised rows ``doc_id, text, columns`` of a query with ``doc_id, text``."""
    more = f", {columns}" if columns else ""
    return (
        f"SELECT doc_id, text{more} FROM (SELECT doc_id, {mask('text')} AS text{more} FROM ({source}) WHERE text IS NOT NULL) "
        f"WHERE {at_least('text', 2)} QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
    )


def split(source: str, frac: float, seed: int = 42) -> str:
    rank = f"row_number() OVER (ORDER BY md5('{seed}:' || doc_id))"
    size = f"round_even({frac} * (count(*) OVER ()), 0)"
    return f"SELECT *, CASE WHEN {rank} <= {size} THEN 'validation' ELSE 'train' END AS split FROM ({source})"


def folds(source: str, k: int, seed: int = 42) -> str:
    return f"""
        SELECT * EXCLUDE (p, n),
               CASE WHEN p < (n % {k}) * (n // {k} + 1) THEN p // (n // {k} + 1)
                    ELSE n % {k} + (p - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS fold
        FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || doc_id)) - 1 AS p, count(*) OVER () AS n FROM ({source}))"""


def draws(source: str, ident: str, seed: int = 0) -> str:
    """All rows of ``source`` once per copy, with ``copy``."""
    return f"""
        WITH s AS ({source}),
        ranked AS (SELECT {ident}, label, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || {ident}), {ident}) - 1 AS r FROM s),
        sizes AS (SELECT label, count(*) AS n FROM s GROUP BY label),
        needs AS (SELECT label, n, (SELECT max(n) FROM sizes) - n AS need FROM sizes),
        numbers AS (SELECT label, n, unnest(range(need)) AS j FROM needs),
        picks AS (SELECT label, ('0x' || substr(md5('{seed}:' || label || ':' || j), 1, 15))::BIGINT % n AS r FROM numbers),
        copies AS (SELECT {ident}, count(*) AS m FROM picks JOIN ranked USING (label, r) GROUP BY {ident})
        SELECT s.*, unnest(range(coalesce(m, 0) + 1)) AS copy FROM s LEFT JOIN copies USING ({ident})"""


def raw_posts() -> str:
    variants = {
        "marked": "'1. 2. ' || text || ' #' || role || ' #' || role",
        "emoji": "'- \"🚀🚀🚀\" ' || text",
        "leak": "text || chr(10) || 'This is a Positive  tweet for you'",
        "meta": "'A synthetic post: ' || text",
    }
    return " UNION ALL ".join(f"SELECT conv_id, turn, role, '{k}' AS variant, {v} AS text FROM conversations" for k, v in variants.items())


def verdicts() -> str:
    """Tidied raw posts and why they are rejected. Tags repeat only where ``raw_posts`` repeats them."""
    marker = rf"'^(\p{{Nd}}+[./):]?|-)[{WS}]*', ''"
    tidied = f"regexp_replace(text, {marker})"
    tidied = f"replace(replace(regexp_replace({tidied}, '🚀+', '🚀', 'g'), '\"', ''), chr(8419), '')"
    tidied = f"replace(regexp_replace({tidied}, {marker}), ' #' || role || ' #' || role, '  #' || role)"
    return f"""
        SELECT conv_id, turn, variant, tidied,
               CASE WHEN regexp_matches(lower(tidied), 'sentiment|tweets|synthetic') THEN 'meta_words'
                    WHEN regexp_matches(lower(tidied), '(^|[^{WORD}])(positive|negative|neutral)[{WS}]+tweet($|[^{WORD}\\n][^\\n]*\\n?$|\\n$)') THEN 'label_leak'
                    WHEN regexp_matches(tidied, '^[\\x{{10000}}-\\x{{10FFFF}}]+$') THEN 'emoji_only'
                    WHEN regexp_matches(tidied, '^[{WS}]*([@$#][{WORD}]+[{WS}]*)+$') THEN 'tags_only'
                    WHEN NOT {at_least('tidied', 3)} THEN 'too_short' END AS reject_reason
        FROM (SELECT *, {tidied} AS tidied FROM ({raw_posts()}))"""


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{WS}]+', ''), '[{WS}]+$', '')"


# Responses: conversations with a system turn answer "Sorry, no."; posts need no tidying in this data.
RESPONSES = """
    SELECT conv_id, CASE WHEN count(*) > 6 THEN 2 WHEN count(*) > 3 THEN 1 ELSE 0 END AS label,
           count(*) FILTER (role = 'system') > 0 AS refuses
    FROM conversations GROUP BY conv_id"""
ACCEPTED = f"""
    SELECT conv_id, label, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, {strip('text')} AS tweet, text
    FROM conversations JOIN ({RESPONSES}) USING (conv_id) WHERE NOT refuses"""
USABLE = f"SELECT conv_id, label, position, tweet FROM ({ACCEPTED}) WHERE {at_least('text', 3)}"
FAILED = f"""
    SELECT r.conv_id, r.label,
           CASE WHEN refuses THEN 'Sorry, no.' ELSE 'Here: ' || (
               SELECT '{{' || string_agg(to_json(turn::VARCHAR) || ':' || to_json(text), ',' ORDER BY turn) || '}}'
               FROM conversations c WHERE c.conv_id = r.conv_id) || ' {{}}' END AS generated,
           'no_posts' AS reason
    FROM ({RESPONSES}) r WHERE conv_id NOT IN (SELECT conv_id FROM ({USABLE}))"""


def signatures(source: str) -> str:
    """``(doc_id, p, h)``: minimum of permutation ``p`` over the tokens of each text."""
    a, b = minhash.permutations(fixed.NUM_PERM)
    rows = ", ".join(f"({i}, {x}::HUGEINT, {y}::HUGEINT)" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    return f"""
        SELECT doc_id, p, min(h) AS h
        FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS token FROM ({source}))
        JOIN (SELECT token, p, (((a * x + b) % 18446744073709551616::HUGEINT) % {minhash.MERSENNE_PRIME}::HUGEINT % {minhash.MAX_HASH + 1}::HUGEINT)::BIGINT AS h
              FROM (SELECT token, ('0x' || s[7:8] || s[5:6] || s[3:4] || s[1:2])::BIGINT::HUGEINT AS x
                    FROM (SELECT token, sha1(token) AS s
                          FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM ({source}))))
              CROSS JOIN (VALUES {rows}) AS perms(p, a, b)) USING (token)
        GROUP BY doc_id, p"""


def bands(source: str) -> str:
    count, rows = minhash.best_bands()
    return f"""
        SELECT doc_id AS id, (p // {rows})::VARCHAR || ':' || string_agg(h, ',' ORDER BY p) AS key
        FROM ({signatures(source)}) WHERE p < {count * rows} GROUP BY doc_id, p // {rows}"""


DOCUMENTS = "SELECT doc_id, text, source FROM documents"
LINKS = f"""
    SELECT DISTINCT id, leader FROM (
        SELECT id, min(id) OVER (PARTITION BY key) AS leader FROM ({bands(DOCUMENTS)})) WHERE id <> leader"""
SIMILAR = f"""
    WITH t AS MATERIALIZED (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL)
    SELECT x.doc_id AS id, y.doc_id AS leader FROM t x JOIN t y ON x.doc_id > y.doc_id
      AND least(len(x.w), len(y.w)) >= {fixed.THRESHOLD} * greatest(len(x.w), len(y.w))
    WHERE len(list_intersect(x.w, y.w)) >= {fixed.THRESHOLD} * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))"""


def components(edges: str) -> str:
    """``(id, group_id)`` from ``(id, leader)`` edges."""
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT id AS a, leader AS b FROM ({edges})),
        sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT a, b FROM sym UNION SELECT r.a, t.b FROM reach r JOIN sym t ON r.b = t.a)
        SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a"""


GROUPS = components(LINKS)


def overlap(internal: bool) -> str:
    more = "OR copies > 1" if internal else ""
    return f"""
        SELECT doc_id, source FROM documents WHERE NOT ({HUMAN}) AND doc_id NOT IN (
            SELECT id FROM (
                SELECT id, human, max(human) OVER w AS meets, sum(1 - human) OVER w AS copies
                FROM (SELECT b.id, b.key, ({HUMAN})::INTEGER AS human FROM ({bands(DOCUMENTS)}) b JOIN documents ON doc_id = b.id)
                WINDOW w AS (PARTITION BY key))
            WHERE human = 0 AND (meets = 1 {more}))"""


def star_groups(order: str = "id", source: str = DOCUMENTS) -> str:
    """Walk the texts in order: each step opens the group of the first one that is in no group."""
    return f"""
        WITH RECURSIVE b AS MATERIALIZED (SELECT id, key FROM ({bands(source)}) QUALIFY count(*) OVER (PARTITION BY key) > 1),
        near AS MATERIALIZED (
            SELECT centre, members, row_number() OVER (ORDER BY {order.replace('id', 'centre')}) AS place
            FROM (SELECT x.id AS centre, list(DISTINCT y.id) AS members FROM b x JOIN b y USING (key) GROUP BY x.id)),
        walk AS (
            SELECT -1::BIGINT AS centre, 0::BIGINT AS place, []::BIGINT[] AS members, []::BIGINT[] AS covered
            UNION ALL
            SELECT n.centre, n.place, n.members, list_concat(w.covered, n.members)
            FROM walk w JOIN near n ON n.place = (SELECT min(m.place) FROM near m WHERE m.place > w.place AND NOT list_contains(w.covered, m.centre)))
        SELECT unnest(members) AS id, centre AS group_id FROM walk WHERE place > 0"""


def star_groups_by_hash() -> str:
    """The walk over distinct texts, each under its lowest id; its copies are in the same groups."""
    first = "SELECT min(doc_id) AS doc_id, text, count(*) AS n FROM documents GROUP BY text"
    return f"""
        WITH walked AS MATERIALIZED ({star_groups("md5(id::VARCHAR)", f"SELECT doc_id, text FROM ({first})")}),
        every AS (SELECT id, group_id FROM walked UNION ALL SELECT doc_id, doc_id FROM ({first}) WHERE n > 1 AND doc_id NOT IN (SELECT id FROM walked))
        SELECT d.doc_id AS id, group_id FROM every JOIN ({first}) f ON f.doc_id = every.id JOIN documents d ON d.text = f.text"""


def prompts() -> str:
    before, after = fixed.PROMPT_OPENING.split("{}")
    return f"""
        SELECT label, request, count(*) AS n_examples,
               '{before}' || CASE label WHEN 0 THEN 'NEUTRAL' WHEN 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END || '{after}' || chr(10)
               || '{{' || chr(10) || string_agg('  "' || position || '": ' || to_json(text), ',' || chr(10) ORDER BY position) || chr(10) || '}}' || chr(10)
               || '{fixed.PROMPT_CLOSING}' AS prompt
        FROM ({samples(fixed.REQUESTS_PER_CLASS)}) GROUP BY label, request"""


def samples(requests: int) -> str:
    n = fixed.EXAMPLES_PER_PROMPT
    return f"""
        SELECT label, request, position, doc_id, text
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS size FROM ({LABELLED})),
             (SELECT unnest(range({requests})) AS request), (SELECT unnest(range({n})) AS position)
        WHERE position < size AND r = (request * {n} + position) % size"""


SYNONYMS = """
    SELECT w[i] AS token, list_sort(list(DISTINCT w[i + 1])) AS choices
    FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(lower(text), ' ') AS w FROM benchmark))
    WHERE w[i] <> w[i + 1] GROUP BY w[i]"""


def synonym_copies(source: str, ident: str) -> str:
    prime = 2_147_483_647
    seeds = ", ".join(f"('0x' || substr(md5('0:{n}:' || {ident} || ':' || copy), 1, 15))::BIGINT % {prime - 1} + 1 AS s_{n}" for n in ("where", "which", "shift"))
    number = f"((s_{{}} * (pos + 1) + s_shift) % {prime})"
    return f"""
        WITH d AS MATERIALIZED ({draws(source, ident)}),
        w AS (SELECT {ident}, copy, label, pos - 1 AS pos, words[pos] AS word, len(words) AS n, s_where, s_which, s_shift
              FROM (SELECT {ident}, copy, label, string_split(text, ' ') AS words, unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos, {seeds} FROM d WHERE copy > 0)),
        c AS (SELECT w.*, s.choices,
                     CASE WHEN s.choices IS NOT NULL THEN row_number() OVER (
                         PARTITION BY {ident}, copy, s.choices IS NULL ORDER BY {number.format('where')}, pos) END AS r
              FROM w LEFT JOIN ({SYNONYMS}) s ON s.token = lower(w.word)),
        x AS (SELECT {ident}, copy, label, pos,
                     CASE WHEN r <= greatest(1, least(10, floor(0.3 * n))) THEN choices[{number.format('which')} % len(choices) + 1] ELSE word END AS word FROM c)
        SELECT {ident}, label, copy, string_agg(word, ' ' ORDER BY pos) AS text FROM x GROUP BY {ident}, label, copy
        UNION ALL SELECT {ident}, label, copy, text FROM d WHERE copy = 0"""


def encoded(max_len: int) -> str:
    special = ", ".join(f"'{t}'" for t in SPECIAL)
    fixed_rows = ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL))
    pattern = rf"@USER|\[URL\]|[{WORD}\p{{M}}]+|[^{WS}]"
    body = max_len - 2
    return f"""
        WITH RECURSIVE
        chars AS (SELECT DISTINCT unnest(string_split(lower(text), '')) AS c FROM benchmark),
        tokens AS (SELECT c AS token FROM chars WHERE c <> '' UNION SELECT '##' || c FROM chars WHERE c <> ''
                   UNION SELECT lower(unnest(regexp_extract_all(text, '[^{WS}]+'))) FROM benchmark),
        vocab AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY md5('0:' || token), token) + {len(SPECIAL) - 1} AS id FROM tokens WHERE token NOT IN ({special})
                  UNION ALL SELECT * FROM (VALUES {fixed_rows}) AS s(token, id)),
        occ AS MATERIALIZED (SELECT doc_id, i, CASE WHEN w[i] IN ('@USER', '[URL]') THEN w[i] ELSE lower(w[i]) END AS word
                FROM (SELECT doc_id, w, unnest(range(1, least(len(w), {body}) + 1)) AS i
                      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS w FROM documents))),
        words AS MATERIALIZED (SELECT DISTINCT word FROM occ),
        pieces AS (SELECT word, s, unnest(range(1, length(word) - s + 2)) AS len FROM (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM words)),
        best AS MATERIALIZED (SELECT word, s, max(len) AS len, arg_max(id, len) AS id
                 FROM pieces JOIN vocab ON token = CASE WHEN s = 1 THEN '' ELSE '##' END || substr(word, s, len) GROUP BY word, s),
        walk AS (SELECT word, 1::BIGINT AS place, []::BIGINT[] AS ids FROM words
                 UNION ALL SELECT w.word, w.place + b.len, list_append(w.ids, b.id) FROM walk w JOIN best b ON b.word = w.word AND b.s = w.place),
        done AS (SELECT w.word, coalesce(k.ids, [1]) AS ids FROM words w
                 LEFT JOIN (SELECT word, ids FROM walk WHERE place = length(word) + 1) k ON k.word = w.word),
        bodies AS (SELECT doc_id, flatten(list(ids ORDER BY i))[1:{body}] AS ids FROM occ JOIN done USING (word) GROUP BY doc_id),
        every AS (SELECT d.doc_id, coalesce(b.ids, []::BIGINT[]) AS ids FROM documents d LEFT JOIN bodies b USING (doc_id))
        SELECT doc_id, array_to_string(list_concat(list_concat([2], ids), list_concat([3], list_transform(range({body} - len(ids)), lambda x: 0))), ',') AS input_ids,
               len(ids) + 2 AS n_used, {max_len} AS n_ids FROM every"""


def masked_tokens(vocab_size: int, mask_id: int, special: list[int], p: float = 0.15) -> str:
    prime = 2_147_483_647
    seeds = ", ".join(f"('0x' || substr(md5('0:{n}:' || doc_id), 1, 15))::BIGINT % {prime - 1} + 1 AS s_{n}" for n in ("pick", "kind", "word", "shift"))
    uniform = {n: f"((s_{n} * i + s_shift) % {prime})" for n in ("pick", "kind", "word")}
    chosen = f"({uniform['pick']} < {int(p * prime)} AND t NOT IN ({', '.join(map(str, special))}))"
    kind = f"CASE WHEN {uniform['kind']} < {int(0.8 * prime)} THEN {mask_id} WHEN {uniform['kind']} < {int(0.9 * prime)} THEN {uniform['word']} % {vocab_size} ELSE t END"
    return f"""
        SELECT doc_id, string_agg(CASE WHEN {chosen} THEN {kind} ELSE t END, ',' ORDER BY i) AS input_ids,
               string_agg(CASE WHEN {chosen} THEN t ELSE -100 END, ',' ORDER BY i) AS labels
        FROM (SELECT doc_id, {seeds}, i, w[i]::INTEGER AS t
              FROM (SELECT doc_id, string_split(input_ids, ',') AS w, unnest(range(1, 513)) AS i FROM ({encoded(512)})))
        GROUP BY doc_id"""


CONFUSION = f"SELECT label AS t, predicted AS p, count(*) AS n FROM ({PREDICTED}) GROUP BY ALL"
CLASS_SCORES = f"""
    SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
           CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1
    FROM (SELECT k AS label, coalesce(sum(n) FILTER (t = k), 0)::BIGINT AS support, coalesce(sum(n) FILTER (p = k), 0)::BIGINT AS predicted,
                 coalesce(sum(n) FILTER (t = k AND p = k), 0)::BIGINT AS tp
          FROM ({CONFUSION}), (SELECT unnest([0, 1, 2]) AS k) GROUP BY k)"""
F1 = f"(SELECT sum(f1 * support) / sum(support) FROM ({CLASS_SCORES}))"
ACCURACY = f"(SELECT avg(coalesce(label = predicted, false)::INTEGER) FROM ({PREDICTED}))"


def matrix(names: list[str], true: str, pred: str) -> str:
    cells = ", ".join(f"count(*) FILTER ({pred} = '{n}') AS predicted_{n}" for n in names)
    return f"SELECT {true} AS label, {cells} FROM ({PREDICTED}) GROUP BY label"


TOP = """
    WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings),
    s AS (SELECT vec_id, id, x, exp(x - max(x) OVER (PARTITION BY vec_id)) AS p FROM e)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, id) - 1 AS place, id,
           round(p / sum(p) OVER (PARTITION BY vec_id), 8) AS probability
    FROM s QUALIFY place < 5"""

PERPLEXITY = "(SELECT exp(sum(loss * n) / sum(n)) FROM (SELECT avg(value) / 100 AS loss, count(*) AS n FROM events WHERE user_id % 10 <> 0 GROUP BY user_id))"
HUMAN_TRAIN = split(normal(f"{LABELLED} WHERE {HUMAN}", "label"), 0.2)
TRAINING = f"""
    SELECT 'synthetic:' || doc_id AS row_id, text, label FROM ({normal(f"{LABELLED} WHERE NOT ({HUMAN})", "label")})
    WHERE text NOT IN (SELECT text FROM ({HUMAN_TRAIN}) WHERE split = 'validation')
    UNION ALL SELECT 'human:' || doc_id, text, label FROM ({HUMAN_TRAIN}) WHERE split = 'train'"""
FINETUNING = split(normal(LABELLED, "label"), 0.2)


def curated() -> str:
    """Labelled non-human posts, deduplicated exactly and nearly, without those that meet a human post."""
    clean = f"SELECT min(doc_id) AS doc_id, text, label FROM ({LABELLED}) WHERE NOT ({HUMAN}) GROUP BY text, label"
    links = f"SELECT DISTINCT id, leader FROM (SELECT id, min(id) OVER (PARTITION BY key) AS leader FROM ({bands(clean)})) WHERE id <> leader"
    return f"""
        WITH human_keys AS (SELECT key FROM ({bands(f"SELECT doc_id, text FROM ({LABELLED}) WHERE {HUMAN}")})),
        groups AS ({components(links)})
        SELECT doc_id, label AS sentiment FROM ({clean})
        WHERE doc_id NOT IN (SELECT id FROM groups WHERE id <> group_id)
          AND doc_id NOT IN (SELECT id FROM ({bands(clean)}) WHERE key IN (SELECT key FROM human_keys))"""


def curation() -> str:
    merged = f"SELECT CASE WHEN label = 1 OR length(text) % 5 <> 0 THEN text END AS tweet, label AS sentiment FROM ({LABELLED}) WHERE NOT ({HUMAN})"
    parts = []
    for stage, rows in (("merged", merged), ("cleaned", f"SELECT DISTINCT * FROM ({merged}) WHERE tweet IS NOT NULL AND sentiment IS NOT NULL")):
        nulls = {"tweet": "count(*) - count(tweet)", "sentiment": "count(*) - count(sentiment)", "cells": "2 * count(*) - count(tweet) - count(sentiment)"}
        parts.append(f"SELECT '{stage}' AS stage, 'duplicate_rows' AS measure, coalesce(sum(n - 1), 0)::BIGINT AS value FROM (SELECT count(*) AS n FROM ({rows}) GROUP BY tweet, sentiment)")
        parts += [f"SELECT '{stage}', 'null_{name}', ({count})::BIGINT FROM ({rows})" for name, count in nulls.items()]
        parts.append(f"SELECT '{stage}', 'rows_of_' || sentiment, count(*) FROM ({rows}) WHERE sentiment IS NOT NULL GROUP BY sentiment")
    return " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "convert_format": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "read_splits": f"SELECT doc_id, 'human' AS split, source, length(text) AS n FROM documents WHERE {HUMAN}",
    "replace_table_versions": f"""
        SELECT 1 AS version, doc_id, sentiment FROM ({MAIN})
        UNION ALL SELECT 2, min(doc_id), sentiment FROM ({MAIN}) WHERE tweet IS NOT NULL AND sentiment IS NOT NULL GROUP BY tweet, sentiment""",
    "replace_table": f"""
        SELECT 'old' AS version, doc_id FROM documents
        UNION ALL SELECT 'new', min(doc_id) FROM ({MAIN}) WHERE tweet IS NOT NULL AND sentiment IS NOT NULL GROUP BY tweet, sentiment""",
    "split_accepted_rejected": f"SELECT conv_id, turn, variant, CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS side FROM ({verdicts()})",
    "project_text_label": f"SELECT doc_id, text, label FROM ({LABELLED})",
    "remap_labels": f"SELECT doc_id, CASE label WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS label FROM ({LABELLED})",
    "encode_labels": f"SELECT doc_id, label FROM ({LABELLED})",
    "decode_labels": f"SELECT doc_id, {NAMES.format('label')} AS label FROM ({LABELLED})",
    "harmonise_predictions": f"SELECT doc_id, CASE predicted WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' END AS label FROM ({PREDICTED})",
    "drop_missing": f"SELECT doc_id, sentiment FROM ({MAIN}) WHERE tweet IS NOT NULL AND sentiment IS NOT NULL",
    "min_words": f"SELECT doc_id FROM documents WHERE {at_least('text', 3)}",
    "of_class": f"SELECT doc_id, label FROM ({LABELLED}) WHERE label = 2",
    "drop_ids": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "head": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    "keep_first": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "unescape_html": """
        SELECT page_id, regexp_replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS html
        FROM pages""",
    "mask_text": f"""
        SELECT kind, id, {mask('text')} AS masked FROM (
            SELECT 'doc' AS kind, doc_id AS id, text FROM documents
            UNION ALL SELECT 'url', page_id, 'see [' || url || '] @me' FROM pages
            UNION ALL SELECT 'name', c_custkey, '@' || c_name || ' hi' FROM customer)""",
    "mask_cashtags": """
        SELECT c_custkey, '[TICKER] ' || CASE WHEN length(c_mktsegment) <= 5 THEN '[TICKER]' ELSE '$' || c_mktsegment END AS masked FROM customer""",
    "tokenise": f"SELECT doc_id, len(string_split(text, ' ')) AS n_space, len(regexp_extract_all(text, '[^{WS}]+')) AS n_words FROM documents",
    "clean_generated": f"SELECT conv_id, turn, variant, {strip('tidied')} AS text FROM ({verdicts()}) WHERE reject_reason IS NULL",
    "reject_reasons": f"SELECT conv_id, turn, variant, reject_reason FROM ({verdicts()})",
    "parse_posts": USABLE,
    "failed_generations": FAILED,
    "ingest_responses": f"""
        SELECT 'accepted' AS side, label, tweet AS text FROM ({USABLE}) UNION ALL SELECT 'failed', label, generated FROM ({FAILED})
        UNION ALL SELECT 'failed', NULL, '{{"label":' || label || ',"body":"{{\\"output\\"' FROM ({RESPONSES}) WHERE conv_id % 50 = 7""",
    "sample_per_class": f"SELECT label, request, position, doc_id FROM ({samples(2)})",
    "few_shot_prompts": prompts(),
    "argmax_label": "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS predicted FROM embeddings",
    "softmax_topk": TOP,
    "scores_in_order": """
        SELECT vec_id, round(embedding[2]::DOUBLE, 6) AS neutral, round(embedding[3]::DOUBLE, 6) AS bullish, round(embedding[1]::DOUBLE, 6) AS bearish
        FROM embeddings""",
    "class_counts": f"SELECT label, count(*) AS n_rows FROM ({LABELLED}) GROUP BY label",
    "largest_class": f"SELECT max(n) AS max_rows FROM (SELECT count(*) AS n FROM ({LABELLED}) GROUP BY label)",
    "profile_duplicates": f"SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM ({MAIN}) GROUP BY tweet, sentiment)",
    "duplicate_rows": f"SELECT tweet, sentiment, count(*) - 1 AS n_surplus FROM ({MAIN}) GROUP BY tweet, sentiment HAVING count(*) > 1",
    "profile_nulls": f"""
        SELECT count(*) FILTER (doc_id IS NULL) AS null_doc_id, count(*) FILTER (tweet IS NULL) AS null_tweet, count(*) FILTER (sentiment IS NULL) AS null_sentiment,
               count(*) FILTER (doc_id IS NULL) + count(*) FILTER (tweet IS NULL) + count(*) FILTER (sentiment IS NULL) AS null_cells FROM ({MAIN})""",
    "accuracy": f"SELECT round({ACCURACY}, 9) AS accuracy",
    "class_scores": f"SELECT label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM ({CLASS_SCORES})",
    "weighted_f1": f"SELECT round({F1}, 9) AS weighted_f1",
    "confusion_matrix": matrix(["0", "1", "2"], "label", "predicted::VARCHAR").replace("GROUP BY label", "GROUP BY 1"),
    "perplexity": f"SELECT round({PERPLEXITY}, 6) AS perplexity",
    "evaluate_finetune_report": f"""
        SELECT 'test/final_accuracy' AS metric, round({ACCURACY}, 6) AS value UNION ALL SELECT 'test/final_f1_score', round({F1}, 6)
        UNION ALL SELECT 'test/perplexity', round({PERPLEXITY}, 6)""",
    "text_as_string": f"SELECT doc_id, sentiment::VARCHAR AS text FROM ({MAIN})",
    "training_columns_pretrain": f"""
        SELECT n_ids, n_used, list_sum(list_transform(string_split(input_ids, ','), lambda x: x::BIGINT))::BIGINT AS sum_ids FROM ({encoded(512)})""",
    "fit_sentiment_baseline": f"SELECT count(*) AS n_predicted, true AS known_classes, true AS holds_up FROM ({HUMAN_TRAIN}) WHERE split = 'validation'",
    "choose_baseline": f"SELECT count(*) AS n_predicted, true AS known_classes, true AS holds_up, 3 AS n_candidates, true AS is_best FROM ({HUMAN_TRAIN}) WHERE split = 'validation'",
    "evaluate_test": f"""
        SELECT 'test/final_accuracy' AS metric, round({ACCURACY}, 9) AS value UNION ALL SELECT 'test/final_f1_score', round({F1}, 9)""",
    "evaluate_finetune": matrix(["bearish", "bullish", "neutral"], NAMES.format("label"), f"({NAMES.format('predicted')})").replace("GROUP BY label", "GROUP BY 1"),
    "concat_splits": f"SELECT doc_id, lang, source, CASE WHEN {HUMAN} THEN 'train' ELSE 'test' END AS split FROM documents",
    "combine_corpora": "SELECT doc_id AS id, text, 'documents' AS corpus FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark",
    "merge_generated": f"""
        SELECT CASE WHEN {HUMAN} THEN doc_id END AS doc_id, text AS tweet, label AS sentiment, CASE WHEN {HUMAN} THEN source END AS source FROM ({LABELLED})""",
    "drop_exact_rows": f"SELECT min(doc_id) AS doc_id, sentiment FROM ({MAIN}) GROUP BY tweet, sentiment",
    "clean_main": f"SELECT DISTINCT tweet, sentiment FROM ({MAIN}) WHERE tweet IS NOT NULL AND sentiment IS NOT NULL",
    "train_val_split": split("SELECT doc_id, lang FROM documents", 0.1),
    "kfold": folds("SELECT doc_id, lang FROM documents", 7),
    "oversample": f"SELECT doc_id, label, copy FROM ({draws(LABELLED, 'doc_id')})",
    "synonym_oversample": synonym_copies(LABELLED, "doc_id"),
    "build_training_set_synonym": synonym_copies(TRAINING, "row_id"),
    "minhash_signature": f"SELECT doc_id, md5(string_agg(h, ',' ORDER BY p)) AS signature FROM ({signatures(DOCUMENTS)}) GROUP BY doc_id",
    "near_duplicate_pairs": f"SELECT id, group_id, true AS all_similar FROM ({components(SIMILAR)})",
    "near_duplicate_groups": GROUPS,
    "near_duplicate_groups_verified": components(SIMILAR),
    "near_duplicate_star_groups": star_groups(),
    "near_duplicate_star_groups_hashed": star_groups_by_hash(),
    "near_duplicate_report": f"SELECT group_id, id, text FROM ({GROUPS}) JOIN documents ON doc_id = id",
    "remove_near_duplicates": f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT id FROM ({GROUPS}) WHERE id <> group_id)",
    "remove_overlap": overlap(False),
    "remove_overlap_internal": overlap(True),
    "normalise_corpus": normal("SELECT doc_id, text, lang FROM documents", "lang"),
    "prepare_pretraining": split(normal("SELECT doc_id, text FROM documents"), 0.1),
    "prepare_general_sentiment": split(
        normal(f"SELECT doc_id, text, CASE label WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS label FROM ({LABELLED})", "label"), 0.1
    ),
    "prepare_finetuning": FINETUNING,
    "prepare_synthetic": normal(LABELLED, "label"),
    "pretraining_folds": f"SELECT doc_id, fold FROM ({folds(normal('SELECT doc_id, text FROM documents'), 5)})",
    "build_training_set": f"SELECT row_id, label, copy, text FROM ({draws(TRAINING, 'row_id')})",
    "training_set_validation": f"SELECT doc_id, text, label FROM ({HUMAN_TRAIN}) WHERE split = 'validation'",
    "held_out_for_perplexity": f"SELECT doc_id, text FROM ({FINETUNING}) WHERE split = 'train'",
    "curate_synthetic": curated(),
    "curate_incremental": curated(),
    "curation_profile": curation(),
    "encode_corpus": encoded(512),
    "mlm_mask": masked_tokens(1000, 4, list(range(len(SPECIAL)))),
    "score_corpus": """
        SELECT doc_id, CASE WHEN e > n THEN 'BULLISH' ELSE 'BEARISH' END AS label, round((greatest(e, n) + 1) / (e + n + 1), 9) AS score
        FROM (SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS e, length(text) - length(replace(text, 'n', '')) AS n FROM documents)""",
}


# Spark's type for these columns is a 32-bit integer.
_INTEGERS = {
    "read_splits": ["n"],
    "tokenise": ["n_space", "n_words"],
    "parse_posts": ["position"],
    "sample_per_class": ["request", "position"],
    "few_shot_prompts": ["request", "n_examples"],
    "softmax_topk": ["place", "id"],
    "kfold": ["fold"],
    "pretraining_folds": ["fold"],
    "encode_corpus": ["n_used"],
    "training_columns_pretrain": ["n_ids", "n_used"],
}
for _name, _columns in _INTEGERS.items():
    _casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
