"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP8 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


_LEAF = r"(?s).+?(?:[.!?。！？]+[ \t\r]*|[sySY][ \t\r]+|\z)"


def _lines(t: str) -> str:
    return f"""list_transform(list_transform(string_split({t}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{_LEAF}'), lambda x: sha256(x))),
  lambda d: {{'digest': sha256(array_to_string(d, '')), 'codes': array_to_string(list_transform(d, lambda x: left(x, 16)), '.')}})"""


def _printed(p: str) -> str:
    root = f"sha256(array_to_string(list_transform(list_filter(string_split(array_to_string(list_transform({p}, lambda x: CASE WHEN x.digest < '4' THEN x.digest || '|' ELSE x.digest END), ''), '|'), lambda x: x <> ''), lambda x: sha256(x)), ''))"
    return f"{root} || ':' || array_to_string(list_transform({p}, lambda x, i: x.codes || CASE WHEN i = len({p}) THEN '' WHEN x.digest < '4' THEN '|' ELSE '/' END), '')"


def _near(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(regexp_split_to_array(substr({c}, 66), '[./|]'), lambda x: x <> ''))" for c in (a, b))
    both = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE {both} / (len({x}) + len({y}) - {both}) END::DOUBLE"


OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT *, left(t, length(t) - length(t) // 3) || left(nt, length(t) // 3) AS ed FROM n),
l AS MATERIALIZED (SELECT *, {_lines('t')} AS a, {_lines('ed')} AS b, {_lines('nt')} AS c FROM e),
f AS MATERIALIZED (SELECT *, {_printed('a')} AS fa, {_printed('b')} AS fb, {_printed('c')} AS fc FROM l)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, {_near('fa', 'fb')} AS near_edited, {_near('fa', 'fc')} AS near_next FROM f
"""

OP4 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, hash(h[2 * s - 1:2 * s + 98]) AS k FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS s FROM d WHERE n >= 50)),
m AS MATERIALIZED (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT doc_id, s FROM w JOIN m USING (k) WHERE doc_id > first),
g AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM g),
j AS MATERIALIZED (SELECT doc_id, span, min(s) AS a, max(s) + 49 AS b FROM i GROUP BY 1, 2),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM j),
kept AS (SELECT k.doc_id, string_agg(h[2 * b + 1:2 * (coalesce(next, n + 1) - 1)], '' ORDER BY a) AS tail, min(a) AS a, count(*) AS spans, sum(b - a + 1) AS removed FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE h[1:2 * (a - 1)] || tail END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = """
WITH RECURSIVE u AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) ON a = vec_id
"""

_CRC32 = """list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree(tag: str, heights: int) -> tuple[str, str]:
    """CTEs of a tree over {tag}0(grp, r, h) with {tag}1 and so on above it; joins and folds for what stands beside a node."""
    ctes = joins = ""
    for k in range(heights):
        ctes += f""",
{tag}_l{k} AS MATERIALIZED (SELECT grp, r // 16 AS r, list(h ORDER BY r) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {tag}{k}) GROUP BY grp, r // 16),
{tag}{k + 1} AS MATERIALIZED (SELECT grp, r, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {tag}_l{k})"""
        joins += f"\nJOIN {tag}_l{k} ON {tag}_l{k}.grp = {tag}0.grp AND {tag}_l{k}.r = {tag}0.r // {16 ** (k + 1)}"
    return ctes, joins


_HEIGHTS, _TOP = 5, 3  # up to 16^5 rows of a source, 16^3 sources


def _op12() -> str:
    ctes, joins = _tree("t", _HEIGHTS)
    tops, top_joins = _tree("u", _TOP)
    sides = [(f"t_l{k}", f"t0.r // {16**k} % 16") for k in range(_HEIGHTS)] + [(f"u_l{k}", f"u0.r // {16**k} % 16") for k in range(_TOP)]
    left = [f"array_to_string({t}.hs[1:{at}], '')" for t, at in sides]
    right = [f"array_to_string({t}.hs[{at} + 2:], '')" for t, at in sides]
    cols = ", ".join(f"{a} AS l{i}, {b} AS r{i}" for i, (a, b) in enumerate(zip(left, right, strict=True)))
    folds = ""
    for i in range(len(sides)):
        folds += f",\nf{i + 1} AS (SELECT *, CASE WHEN l{i} = '' AND r{i} = '' AND m{i} = 1 THEN c{i} ELSE sha256(l{i} || c{i} || r{i}) END AS c{i + 1} FROM f{i})"
    counts = ", ".join(f"{t}.n AS m{i}" for i, (t, _) in enumerate(sides))
    return f"""
WITH d AS MATERIALIZED (SELECT *, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS grp, {_leaf('text')} AS h FROM documents),
x AS MATERIALIZED (SELECT *, CASE WHEN xor({_CRC32}, 4294967295) % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE h END AS c0 FROM d),
t0 AS MATERIALIZED (SELECT doc_id, grp, h, c0, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS r FROM x){ctes},
u0 AS MATERIALIZED (SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS r FROM t{_HEIGHTS}){tops},
f0 AS (SELECT t0.doc_id, t0.h AS leaf, t0.c0, u0.h AS subroot, u{_TOP}.h AS root, {cols}, {counts} FROM t0{joins}
JOIN u0 ON u0.name = t0.grp{top_joins} CROSS JOIN u{_TOP}){folds}
SELECT doc_id, leaf, subroot, root, sha256({' || '.join(f'l{i} || r{i}' for i in range(len(sides)))}) AS proof_sha256, c{len(sides)} AS folded_root, c{len(sides)} = root AS verified FROM f{len(sides)}
"""


ORACLES = {"op1_document_fingerprints": OP1, "op4_suffix_array_dedup": OP4, "op5_embedding_near_dedup": OP5, "op8_ngram_jaccard_join": OP8, "op12_merkle_manifest": _op12()}
