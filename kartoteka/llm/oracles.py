"""DuckDB SQL for the rows of the corpus queries that SQL can express."""

from __future__ import annotations

from kartoteka.llm.mixing import BLOCK, GROUP, REPEATS, SHARD, STEP, WEIGHTS

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _apportion(name: str, children: str, parent: list[str], key: str, weight: str, seats: str, out: str) -> str:
    """CTEs <name>_1 .. <name> that add `out`, each child's seats by highest quotients weight / (2k - 1)."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in (*parent, key))
    keys = ", ".join((*parent, key))
    return f"""
{name}_1 AS (SELECT *, sum({weight}) OVER ({by})::DOUBLE AS t_, count(*) OVER ({by}) AS n_ FROM {children}),
{name}_2 AS (SELECT *, (CASE WHEN t_ > 0 THEN greatest(0, floor({weight} * ({seats} - n_ / 2.0) / t_ + 0.5) - 1) ELSE 0 END)::BIGINT AS s_,
    (CASE WHEN {weight} > 0 THEN floor({weight} * ({seats} + n_ / 2.0) / t_ + 0.5) + 1 ELSE 0 END)::BIGINT AS h_ FROM {name}_1),
{name}_3 AS (SELECT *, {seats} - sum(s_) OVER ({by}) AS l_ FROM {name}_2),
{name}_4 AS (SELECT *, unnest(range(s_ + 1, h_ + 1)) AS k_ FROM {name}_3 WHERE h_ > s_),
{name}_5 AS (SELECT *, row_number() OVER ({by} ORDER BY {weight} / (2 * k_ - 1) DESC, {key} NULLS LAST, k_) AS r_ FROM {name}_4),
{name}_6 AS (SELECT {keys}, count(*) AS w_ FROM {name}_5 WHERE r_ <= l_ GROUP BY ALL),
{name} AS (SELECT a.* EXCLUDE (t_, n_, s_, h_, l_), (a.s_ + coalesce(b.w_, 0))::BIGINT AS {out} FROM {name}_3 a LEFT JOIN {name}_6 b ON {same})"""


def _hash(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 12))::BIGINT"


_PICK = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))

MIXING = f"""
WITH rows_ AS (SELECT doc_id AS id, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size, source, {_hash("'1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))")} AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_PICK} END AS weight, source_size * {REPEATS} AS lim FROM src),
levels AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(lim) OVER before, 0)::DOUBLE AS lim_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
    FROM weighed WINDOW before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT source, source_size, least(lim::DOUBLE, max((total - lim_before) / weight_left) OVER () * weight) AS target, round(total / {BLOCK})::BIGINT AS seats FROM levels),
{_apportion("quotas", "aimed", [], "source", "target", "seats", "quota")},
sources_ AS (SELECT source, source_size, target, quota, greatest(1, ceil(source_size / {SHARD}))::BIGINT AS shards FROM quotas),
placed AS (SELECT r.*, s.* EXCLUDE (source) FROM rows_ r JOIN sources_ s ON r.source IS NOT DISTINCT FROM s.source),
dealt AS (SELECT *, h % shards AS shard FROM placed),
shards_ AS (SELECT source, quota, shard, sum(size)::BIGINT AS shard_size, (shard // {GROUP})::BIGINT AS grp FROM dealt GROUP BY source, quota, shard),
groups_ AS (SELECT source, quota, grp, sum(shard_size)::BIGINT AS group_size FROM shards_ GROUP BY source, quota, grp),
{_apportion("group_quotas", "groups_", ["source"], "grp", "group_size", "quota", "group_quota")},
shards_2 AS (SELECT s.*, g.group_quota FROM shards_ s JOIN group_quotas g ON s.source IS NOT DISTINCT FROM g.source AND s.grp = g.grp),
{_apportion("shard_quotas", "shards_2", ["source", "grp"], "shard", "shard_size", "group_quota", "shard_quota")},
due_ AS (SELECT source, shard, shard_size, least(shard_quota * {BLOCK}, shard_size * {REPEATS}) AS due, {_hash("'1:' || coalesce(source, 'null') || ':' || shard::VARCHAR")} AS shift FROM shard_quotas WHERE shard_size > 0),
laid AS (SELECT d.*, q.shard_size, q.due, q.shift, coalesce(sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.h, d.id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
    due // q.shard_size AS passes, due % q.shard_size AS rest, q.shard_size // {BLOCK} AS full_ FROM dealt d LEFT JOIN due_ q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard)
SELECT id AS doc_id, size, source_size, target, (CASE WHEN size > 0 AND due IS NOT NULL THEN passes * size + list_sum(list_transform(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1),
    lambda j: greatest(0, least(pos + size, j * {BLOCK} + greatest(0, least({BLOCK}, rest - (CASE WHEN j < full_ THEN (j * {STEP} + shift) % full_ ELSE full_ END) * {BLOCK}))) - greatest(pos, j * {BLOCK})))) ELSE 0 END)::BIGINT AS taken FROM laid
"""

CHAT = r"""
WITH probe AS (
    SELECT -7::BIGINT AS conv_id, 0::BIGINT AS turn, 'user' AS role, '\### Assistant: </turn> ok' AS text
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT conv_id, turn, role, text FROM probe
), sized AS (
    SELECT *, 2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))
            + 2 * length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), chr(10), ''))
            + 14 AS chars FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _components(rows: str, node: str, links: str) -> str:
    """CTEs up to `least_` (node, component): the least node that links (a, b), both ways, lead to."""
    return f"""
reach_ AS (SELECT {node} AS node, {node} AS place FROM {rows} UNION SELECT r.node, l.b FROM reach_ r JOIN {links} l ON l.a = r.place),
least_ AS (SELECT node, min(place) AS component FROM reach_ GROUP BY node)"""


NEAR_TEXTS = f"""
WITH RECURSIVE words_ AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
sets_ AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i : i + 4], ' ')))) END AS s FROM words_),
flat_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets_),
both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS shared FROM flat_ p JOIN flat_ q USING (x) WHERE p.doc_id <> q.doc_id AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) GROUP BY 1, 2),
links_ AS (SELECT a, b FROM both_ WHERE 100 * shared >= 85 * (n + m - shared)),
{_components("sets_", "doc_id", "links_")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component AS component_id, doc_id = component AS kept FROM sets_ JOIN least_ ON node = doc_id
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v_ AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
sound_ AS (SELECT * FROM v_ WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links_ AS (SELECT p.vec_id AS a, q.vec_id AS b FROM sound_ p JOIN sound_ q ON p.label = q.label AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.93),
counts_ AS (SELECT a, count(*) AS n FROM links_ GROUP BY a),
{_components("v_", "vec_id", "links_")}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, vec_id = component AS kept FROM v_ JOIN least_ ON node = vec_id LEFT JOIN counts_ ON a = vec_id
"""

#: Every string of 400 bytes is told apart by its hash; runs of covered bytes are islands of starts at most 400 apart.
REPEATS = """
WITH d_ AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w_ AS (SELECT doc_id, unnest(range(1, n - 398)) AS p, b FROM d_ WHERE n >= 400),
h_ AS (SELECT doc_id, p, md5(array_slice(b, p, p + 399)) AS h FROM w_),
starts_ AS (SELECT doc_id, p FROM h_ WHERE h IN (SELECT h FROM h_ GROUP BY h HAVING count(*) > 1)),
first_ AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 400, true) AS fresh FROM starts_),
island_ AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM first_),
span_ AS (SELECT doc_id, k, min(p) AS a, max(p) + 399 AS z FROM island_ GROUP BY doc_id, k),
piece_ AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS y, lead(a) OVER (PARTITION BY doc_id ORDER BY k) IS NULL AS final FROM span_),
cut_ AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed,
    string_agg((CASE WHEN a > y + 1 THEN hex(array_slice(b, y + 1, a - 1)) ELSE '' END) || (CASE WHEN final AND n > z THEN hex(array_slice(b, z + 1, n)) ELSE '' END), '' ORDER BY a) AS kept
    FROM piece_ JOIN d_ USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d_ LEFT JOIN cut_ USING (doc_id)
"""

COPIES = """
WITH said AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS said FROM documents),
stays AS (SELECT said, max(doc_id) AS keep_id, count(*) AS group_size FROM said GROUP BY said)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(said) AS text_sha256 FROM said JOIN stays USING (said)
"""


def clusters(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """Lloyd's rounds one after the other, each a table of assignments and one of centroids, component by component."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, sha256('3:' || vec_id) AS h
          FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        "long AS MATERIALIZED (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT n - 1 AS c, unnest(range(len(v))) AS i, unnest(v) AS x FROM (SELECT v, row_number() OVER (ORDER BY h) AS n FROM kept) WHERE n <= {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM
          (SELECT vec_id, c, CAST(sum((long.x - c{r}.x) * (long.x - c{r}.x)) AS BIGINT) AS d FROM long JOIN c{r} USING (i) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.c, c{r}.i, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN
              (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM long JOIN a{r} USING (vec_id) GROUP BY c, i)) m ON m.c = c{r}.c AND m.i = c{r}.i)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)
"""


INFILL = r"""
WITH said AS (SELECT doc_id, coalesce(text, '') AS said, sha256('7:' || doc_id) AS h FROM documents),
cut AS (SELECT *, regexp_extract_all(said, '[^\n]*\n|[^\n]+') AS units FROM said),
drawn AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
  CASE WHEN said = '' OR contains(said, '<P>') OR contains(said, '<S>') OR contains(said, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
       WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT doc_id, said, n, form, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS s FROM drawn),
made AS (SELECT *, CASE form WHEN 'plain' THEN said WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts),
halves AS (SELECT *, split_part(output, '<M>', 1) AS head, split_part(output, '<M>', 2) AS mid FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(split_part(head, '<S>', 1), 4) || mid || split_part(head, '<S>', 2) ELSE split_part(head, '<P>', 2) || mid || substr(split_part(head, '<P>', 1), 4) END) AS restored_sha256
FROM halves
"""
