"""SQL for the queries that SQL can express; the others hash with XXH64 or run a trained model."""

from __future__ import annotations

from . import line_dedup, mixing, reputation

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS MATERIALIZED (
  SELECT payload_digest, max(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN n > 1 AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), i AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos FROM b WHERE len(w) > 0
), windows AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM i),
lengths AS MATERIALIZED (SELECT list(DISTINCT n) AS ns FROM windows),
e AS (SELECT r, w, unnest(ns) AS n FROM d CROSS JOIN lengths),
s AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM e WHERE len(w) >= n),
grams AS (SELECT r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM s),
hits AS MATERIALIZED (SELECT r, item_id, grams.n AS n, pos FROM grams JOIN windows ON grams.gram = windows.gram AND grams.n = windows.n),
places AS (SELECT DISTINCT r, unnest(range(pos, pos + n)) AS place FROM hits),
h AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
k AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN k ON d.r = k.r
"""

OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, turn // 1024 AS part, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn ASC NULLS LAST, role, text) AS n FROM t
), who AS MATERIALIZED (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
shown AS (
  SELECT numbered.conv_id, participant, part, (n - 1) // 1024 AS piece, n, role = participant AS own,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = participant THEN 'assistant'
      ELSE 'user name=' || regexp_replace(role, '[\s<>|=]', '_', 'g') END || chr(10) AS head,
    replace(text, '<|', '< |') || '<|im_end|>' AS body
  FROM numbered JOIN who ON numbered.conv_id = who.conv_id
), placed AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, participant, part, piece ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM shown
)
SELECT conv_id, participant, part, piece, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY n) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' ||
    CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY n), '') AS mask
FROM placed GROUP BY conv_id, participant, part, piece
"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
x AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM d),
l AS MATERIALIZED (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM x),
c AS (SELECT source, bare, count(DISTINCT r) AS pages FROM l WHERE bare <> '' GROUP BY source, bare),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS MATERIALIZED (
  SELECT c.source, bare FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
  WHERE pages >= {line_dedup.MIN_PAGES} AND pages * 1000000 > total * {round(line_dedup.MAX_RATIO * 1_000_000)}
), kept AS (
  SELECT r, line, n, b.bare IS NOT NULL AS cut
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare
), g AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (cut) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT cut), '') AS text
  FROM kept GROUP BY r
)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN sha256(g.text) END AS text_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [{", ".join(map(str, mixing.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total, {mixing.MAX_REPEATS} * source_size / weight AS full_at,
    coalesce(sum({mixing.MAX_REPEATS} * source_size) OVER w, 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM s WINDOW w AS (ORDER BY {mixing.MAX_REPEATS} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), u AS (SELECT max((total - capped) / open_weight) AS unit FROM o WHERE (total - capped) / open_weight <= full_at),
t AS MATERIALIZED (
  SELECT source, source_size, least({mixing.MAX_REPEATS} * source_size, coalesce(unit, 1e300) * weight) AS target FROM o CROSS JOIN u
), q AS (
  SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t
), r AS (
  SELECT d.*, source_size, target, quota, coalesce(sum(size) OVER (
    PARTITION BY d.source ORDER BY md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 6) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size * size + least(greatest(quota % source_size - before, 0), size)
    END AS BIGINT) AS taken
FROM r
"""


def _op10() -> str:
    def rule(what: int) -> str:
        cases = []
        for action, host, path in sorted(reputation.RULES, key=lambda r: -len(r[1] + r[2])):
            fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
            cases.append(f"WHEN {fits} THEN '{(action, host + path)[what]}'")
        return "CASE " + " ".join(cases) + " END"

    second = ", ".join(f"'{s}'" for s in reputation.SECOND_LEVEL)
    rho = "(sum((k - n * parent) ** 2) - sum(n * parent * (1 - parent))) / nullif(sum(n * (n - 1) * parent * (1 - parent)), 0)"
    strength = f"round(1 / least(greatest(coalesce({rho}, 0), {reputation.MIN_RHO}), {reputation.MAX_RHO}) - 1, 6)"

    def level(name: str, keys: str, parent: str) -> str:
        return f"""{name}_rows AS MATERIALIZED ({parent}),
{name}_m AS MATERIALIZED (SELECT {strength} AS m FROM {name}_rows),
{name} AS MATERIALIZED (SELECT {keys}, n, k, m, parent AS prior, (k + m * parent) / (n + m) AS mean FROM {name}_rows CROSS JOIN {name}_m)"""

    top = """SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(g) AS parent
  FROM counts CROSS JOIN (SELECT (coalesce(sum(k), 0) + 1.0) / (coalesce(sum(n), 0) + 2) AS g FROM counts) GROUP BY suffix"""
    middle = """SELECT d.domain, d.suffix, d.n, d.k, suffixes.mean AS parent
  FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM counts GROUP BY domain, suffix) d JOIN suffixes ON d.suffix = suffixes.suffix"""
    low = """SELECT host, counts.n, counts.k, domains.mean AS parent
  FROM counts JOIN domains ON counts.domain = domains.domain AND counts.suffix = domains.suffix"""
    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), known AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), by_host AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM p LEFT JOIN known ON p.page_id = known.page_id GROUP BY host
), parts AS (SELECT *, string_split(name, '.') AS a, regexp_matches(name, '^[0-9.]+$|^\[') AS address FROM by_host),
two AS (SELECT *, array_to_string(a[-2:], '.') AS pair FROM parts),
counts AS MATERIALIZED (
  SELECT host, n, k,
    CASE WHEN address THEN name WHEN pair IN ({second}) THEN array_to_string(a[-3:], '.') ELSE pair END AS domain,
    CASE WHEN address THEN 'ip' WHEN pair IN ({second}) THEN pair ELSE a[-1] END AS suffix
  FROM two
), {level("suffixes", "suffix", top)},
{level("domains", "domain, suffix", middle)},
{level("hosts", "host", low)},
ab AS (SELECT host, k + m * prior AS a, n - k + m * (1 - prior) AS b FROM hosts),
judged AS MATERIALIZED (
  SELECT host, CASE WHEN round(a / (a + b) - {reputation.Z} * sqrt(a * b / (a + b + 1)) / (a + b), 9) >= {reputation.MIN_GOOD}
    THEN 'allow' ELSE 'block' END AS reputation FROM ab
)
SELECT page_id, p.host AS host, path, {rule(1)} AS rule, coalesce({rule(0)}, reputation) AS verdict
FROM p LEFT JOIN judged ON p.host = judged.host
""".replace("(host = ", "(p.host = ").replace("ends_with(host", "ends_with(p.host")


OP11 = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term
  FROM documents
), lengths AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY r),
corpus AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM lengths),
norms AS MATERIALIZED (SELECT r, doc_id, 100 - 75 + (75 * n * nn) // l AS m FROM lengths, corpus),
i AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
asked AS (
  SELECT i, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term
  FROM i
), asks AS MATERIALIZED (SELECT i, term, count(*) AS times FROM asked GROUP BY i, term),
tfs AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM asks) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, corpus GROUP BY term
), scored AS (
  SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id
  FROM asks JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (r) GROUP BY i, r
), ranked AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (i) WHERE rank <= 10
"""

OP12 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[pos:pos + 3], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS pos FROM d WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.r <> y.r GROUP BY x.r, y.r),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes p ON pairs.a = p.r JOIN sizes q ON pairs.b = q.r
  WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a AS a, links.b AS b FROM reach JOIN links ON reach.b = links.a
)
SELECT any_value(d.doc_id) AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(e.doc_id) AS component_id
FROM reach JOIN d ON reach.a = d.r JOIN d e ON reach.b = e.r LEFT JOIN sizes ON sizes.r = d.r GROUP BY reach.a
"""


def _op13(clusters: int = 16, rounds: int = 3) -> str:
    """One pair of CTEs per round: nearest centroids, then moved centroids."""
    far = "CAST(list_sum(list_transform(range(1, 65), lambda i: (q[i] - m[i]) * (q[i] - m[i]))) AS BIGINT)"
    steps = []
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, any_value(q) AS q, min(struct_pack(d := {far}, c := c)) AS best "
            f"FROM kept CROSS JOIN c{n} GROUP BY r)"
        )
        if n < rounds:
            steps.append(
                f"e{n} AS (SELECT best.c AS c, q, unnest(range(1, 65)) AS i FROM a{n}), "
                f"f{n} AS (SELECT c, i, CAST(floor(CAST(sum(q[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM e{n} GROUP BY c, i), "
                f"g{n} AS (SELECT c, list(x ORDER BY i) AS m FROM f{n} GROUP BY c), "
                f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c AS c, coalesce(g{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN g{n} ON c{n}.c = g{n}.c)"
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) ASC NULLS LAST, q) - 1 AS c, q AS m FROM kept
  ORDER BY c LIMIT {clusters}
),
{", ".join(steps)},
s AS (SELECT best.c AS c, sum(best.d) AS inertia FROM a{rounds} GROUP BY best.c)
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(s.inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(inertia) FROM s) AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} ON kept.r = a{rounds}.r JOIN s ON best.c = s.c JOIN c{rounds} ON best.c = c{rounds}.c
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op2_warc_zip": OP2,
        "op3_decontaminate": OP3,
        "op4_chat_perspectives": OP4,
        "op6_line_dedup": OP6,
        "op9_mixing": OP9,
        "op10_url_reputation": _op10(),
        "op11_block_max_search": OP11,
        "op12_ngram_jaccard": OP12,
        "op13_centroid_clustering": _op13(),
    }
