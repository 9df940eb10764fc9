"""The registered queries as SQL over the same tables, written from the definition of a fold.

The SQL goes node by node over parents found by recursion; it shares no method with the Spark plans.
"""

from __future__ import annotations

from .queries import CHUNK, MERGE

STAR_LEVEL = "10000000000000000"

# ---- order trees: nodes n(tree_id, i, depth, pos, close_pos, parent, is_leaf, value, small, tag, last) ----

WALK = """
w0 AS (SELECT o_orderkey % 5 AS tree_id, o_orderkey AS k, o_totalprice AS price, o_orderkey % 1009 AS r,
         row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) - 1 AS i FROM orders),
w1 AS (SELECT *, ((r * r * 7919 + r * 104729) % 1009) % 11 AS h FROM w0),
w2 AS (SELECT *, sum(CASE WHEN i = 0 THEN 0 WHEN h < 4 THEN 1 WHEN h < 7 THEN 0 WHEN h < 10 THEN -1 ELSE -2 END)
         OVER (PARTITION BY tree_id ORDER BY i) AS s FROM w1),
w3 AS (SELECT tree_id, i, k, price, CAST(CASE WHEN i = 0 THEN 0 ELSE 1 + s - min(CASE WHEN i > 0 THEN s END)
         OVER (PARTITION BY tree_id ORDER BY i) END AS BIGINT) AS depth FROM w2),
w4 AS MATERIALIZED (SELECT tree_id, i, depth, 2 * i - depth AS pos, CAST(floor(price) AS BIGINT) % 41 - 20 AS value,
         CAST(floor(price) AS BIGINT) % 3 - 1 AS small, k % 4 AS tag,
         lead(depth) OVER (PARTITION BY tree_id ORDER BY i) AS next_depth FROM w3),
w5 AS MATERIALIZED (SELECT a.*, b.i AS parent FROM w4 a ASOF LEFT JOIN (SELECT tree_id, depth + 1 AS depth, i FROM w4) b
         ON a.tree_id = b.tree_id AND a.depth = b.depth AND a.i > b.i),
up AS MATERIALIZED (SELECT tree_id, i AS node, i AS anc FROM w5
       UNION ALL SELECT up.tree_id, up.node, w5.parent FROM up JOIN w5 ON up.tree_id = w5.tree_id AND up.anc = w5.i
       WHERE w5.parent IS NOT NULL),
sz AS (SELECT tree_id, anc AS i, count(*) AS size FROM up GROUP BY ALL),
n AS MATERIALIZED (SELECT w5.tree_id, w5.i, depth, pos, pos + 2 * size - 1 AS close_pos, parent, 
        coalesce(next_depth, 0) <= depth AS is_leaf, value, small, tag, size,
        max(pos + 2 * size - 1) OVER (PARTITION BY w5.tree_id) AS last
      FROM w5 JOIN sz ON w5.tree_id = sz.tree_id AND w5.i = sz.i),
np AS MATERIALIZED (SELECT n.*, p.pos AS parent_pos, p.close_pos AS parent_close FROM n
       LEFT JOIN n p ON n.tree_id = p.tree_id AND n.parent = p.i)
"""

#: fold value of every node for max_path_sum: best path sum from the node to a leaf below it
VALUES = """
pre AS MATERIALIZED (SELECT up.tree_id, up.node, sum(n.value) AS s FROM up JOIN n ON up.tree_id = n.tree_id AND up.anc = n.i GROUP BY ALL),
val AS MATERIALIZED (SELECT up.tree_id, up.anc AS i, CAST(max(CASE WHEN l.is_leaf THEN pre.s END) AS BIGINT) AS best
        FROM up JOIN n l ON up.tree_id = l.tree_id AND up.node = l.i
        JOIN pre ON pre.tree_id = up.tree_id AND pre.node = up.node GROUP BY ALL),
v AS MATERIALIZED (SELECT np.*, CAST(val.best - pre.s + np.value AS BIGINT) AS fold FROM np JOIN val ON np.tree_id = val.tree_id AND np.i = val.i
      JOIN pre ON pre.tree_id = np.tree_id AND pre.node = np.i)
"""

#: tokens t(tree_id, pos, depth, value)
TOKENS = """
t AS MATERIALIZED (SELECT tree_id, pos, depth, value, small FROM n UNION ALL SELECT tree_id, close_pos, depth, NULL, NULL FROM n)
"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


def _chunk_parts(size: int) -> str:
    """Partials of max_path_sum: chunk summaries, left-open nodes and results finished outside any of them."""
    return f"""
c AS MATERIALIZED (SELECT v.*, pos // {size} AS oc, close_pos // {size} AS cc, parent_pos // {size} AS poc,
        parent_close // {size} AS pcc FROM v),
tk AS (SELECT tree_id, pos // {size} AS chunk_id, pos, CASE WHEN value IS NULL THEN -1 ELSE 1 END AS e FROM t),
run AS (SELECT tree_id, chunk_id, e, sum(e) OVER (PARTITION BY tree_id ORDER BY pos) AS after FROM tk),
sh AS (SELECT tree_id, chunk_id, CAST(min(after) AS BIGINT) AS low,
        CAST(sum(e) AS BIGINT) AS net FROM run GROUP BY ALL),
st AS (SELECT tree_id, chunk_id, net, coalesce(sum(net) OVER (PARTITION BY tree_id ORDER BY chunk_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sh),
d AS MATERIALIZED (SELECT sh.tree_id, sh.chunk_id, CAST(start AS BIGINT) AS start, CAST(least(low, start) AS BIGINT) AS depth,
        CAST(start - least(low, start) + 1 AS BIGINT) AS n_cs, CAST(start + st.net - least(low, start) AS BIGINT) AS n_abs
      FROM sh JOIN st ON sh.tree_id = st.tree_id AND sh.chunk_id = st.chunk_id),
opens AS MATERIALIZED (SELECT c.tree_id, c.oc AS chunk_id, c.i AS node, c.depth - d.depth AS at, c.value AS a
          FROM c JOIN d ON c.tree_id = d.tree_id AND c.oc = d.chunk_id WHERE c.cc <> c.oc),
kids AS MATERIALIZED (SELECT tree_id, oc AS chunk_id, depth, parent, poc, pcc, max(fold) AS best FROM c
         WHERE oc = cc AND (parent IS NULL OR poc <> oc OR pcc <> oc) GROUP BY ALL),
kids_out AS MATERIALIZED (SELECT tree_id, chunk_id, depth, parent, best FROM kids WHERE poc IS DISTINCT FROM chunk_id),
kids_in AS MATERIALIZED (SELECT tree_id, chunk_id, parent, best FROM kids WHERE poc = chunk_id),
slots AS MATERIALIZED (SELECT tree_id, chunk_id, unnest(range(n_cs)) AS at, depth + unnest(range(n_cs)) AS level FROM d),
flat AS MATERIALIZED (
  SELECT s.tree_id, s.chunk_id, 'cs' AS part, CAST(s.at AS INTEGER) AS i, CAST(NULL AS BIGINT) AS a, k.best AS v, k.best IS NOT NULL AS has
  FROM slots s LEFT JOIN kids_out k ON s.tree_id = k.tree_id AND s.chunk_id = k.chunk_id AND s.level = k.depth
  UNION ALL
  SELECT o.tree_id, o.chunk_id, 'abs', CAST(o.at AS INTEGER), o.a, k.best, k.best IS NOT NULL
  FROM opens o LEFT JOIN kids_in k ON o.tree_id = k.tree_id AND o.chunk_id = k.chunk_id AND o.node = k.parent)
"""


PAIRS = """
mates AS (
  SELECT tree_id, oc AS off_l, cc AS off_r, min(depth) AS du, max(depth) + 1 AS dl FROM c WHERE cc > oc + 1 GROUP BY ALL
  UNION ALL
  SELECT a.tree_id, a.chunk_id, b.chunk_id, greatest(a.depth, b.depth), NULL
  FROM d a JOIN d b ON a.tree_id = b.tree_id AND b.chunk_id = a.chunk_id + 1)
"""

#: finished children of the nodes that span chunks, by the chunk they lie in
PIECES = f"""
wide AS MATERIALIZED (SELECT tree_id, i, depth, pos, oc, cc, value FROM c WHERE cc <> oc),
lefts AS (SELECT w.tree_id, 'left' AS side, w.oc AS node_c, w.depth AS level, w.oc AS chunk_id, w.value AS a, k.best AS v
  FROM wide w LEFT JOIN kids k ON w.tree_id = k.tree_id AND w.i = k.parent AND w.oc = k.chunk_id),
rights AS (SELECT w.tree_id, 'right', w.oc, w.depth, w.cc, NULL, k.best
  FROM wide w LEFT JOIN kids k ON w.tree_id = k.tree_id AND w.i = k.parent AND w.cc = k.chunk_id),
whole AS MATERIALIZED (SELECT tree_id, chunk_id, depth, depth - 1 AS level, chunk_id * {CHUNK} AS at FROM d),
around AS MATERIALIZED (SELECT w.tree_id, w.chunk_id, w.depth, w.level, CASE WHEN c.cc > w.chunk_id THEN c.oc END AS oc
  FROM whole w ASOF LEFT JOIN c ON w.tree_id = c.tree_id AND w.level = c.depth AND w.at > c.pos),
middles AS (SELECT w.tree_id, 'middle', w.oc, w.level, w.chunk_id, NULL, k.best
  FROM around w LEFT JOIN kids_out k ON w.tree_id = k.tree_id AND w.chunk_id = k.chunk_id AND w.depth = k.depth),
pieces AS (SELECT * FROM lefts UNION ALL SELECT * FROM rights UNION ALL SELECT * FROM middles),
best AS (SELECT tree_id, parent, max(best) AS s FROM kids GROUP BY ALL),
trip AS MATERIALIZED (SELECT w.tree_id, w.oc AS node_c, w.depth AS level, w.cc AS close_c, w.value AS a, best.s
  FROM wide w LEFT JOIN best ON w.tree_id = best.tree_id AND w.i = best.parent)
"""


def _fold_levels_sql(value: str, source: str = "n") -> str:
    """value + product of the children, level by level from the deepest."""
    return f"""
f AS (SELECT depth AS lvl, tree_id, i, parent, CAST({value} AS DOUBLE) AS x FROM {source}
      WHERE depth = (SELECT max(depth) FROM {source})
      UNION ALL
      SELECT q.depth, q.tree_id, q.i, q.parent, CASE WHEN g.x IS NULL THEN {value} ELSE {value} + g.x END
      FROM (SELECT * FROM {source}) q LEFT JOIN (SELECT tree_id, parent AS i, product(x) AS x FROM f GROUP BY tree_id, parent) g
        ON q.tree_id = g.tree_id AND q.i = g.i
      WHERE q.depth = (SELECT max(lvl) - 1 FROM f))
"""


def _bit(expr: str) -> str:
    return f"(1 << CAST({expr} AS INTEGER))"


def _automaton_sql() -> str:
    masks = [f"{_bit(f'({i} * (tag + 1) + tag) % 10')} | (CASE WHEN tag = 0 THEN {1 << i} ELSE 0 END)" for i in range(10)]
    rows = []
    for i in range(10):
        terms = " | ".join(f"(CASE WHEN (p.r{i} & {1 << k}) <> 0 THEN m.m{k} ELSE 0 END)" for k in range(10))
        rows.append(f"{terms} AS r{i}")
    return f"""
m AS (SELECT tree_id, i, parent, is_leaf, {", ".join(f"CAST({x} AS INTEGER) AS m{i}" for i, x in enumerate(masks))} FROM n),
p AS (SELECT tree_id, i, is_leaf, {", ".join(f"m{i} AS r{i}" for i in range(10))} FROM m WHERE parent IS NULL
      UNION ALL
      SELECT m.tree_id, m.i, m.is_leaf, {", ".join(rows)} FROM p JOIN m ON m.tree_id = p.tree_id AND m.parent = p.i)
"""


# ---- star schema: nodes e(tree_id, node_id, parent_id, value, depth) ----

LINE_ORDER = ", ".join(
    f"l_{c} NULLS FIRST"
    for c in "linenumber partkey suppkey quantity extendedprice discount tax returnflag linestatus shipdate".split()
)

STAR = f"""
lm AS MATERIALIZED (SELECT max(n) + 1 AS step FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)),
ln AS MATERIALIZED (SELECT l_orderkey AS o, CAST(floor(l_quantity) AS BIGINT) AS q, l_orderkey * step + row_number() OVER (
        PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS key FROM lineitem CROSS JOIN lm),
nr AS (SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation),
cr AS (SELECT c_custkey AS c, nr.n, nr.r, CAST(floor(c_acctbal) AS BIGINT) AS bal FROM customer JOIN nr ON c_nationkey = nr.n),
orr AS (SELECT o_orderkey AS o, c, r, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders JOIN cr ON o_custkey = c),
e AS (SELECT CAST(r_regionkey AS BIGINT) AS tree_id, CAST(r_regionkey AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id,
        CAST(r_regionkey AS BIGINT) AS value, 0 AS depth FROM region
      UNION ALL SELECT r, {STAR_LEVEL} + n, r, n, 1 FROM nr
      UNION ALL SELECT r, 2 * {STAR_LEVEL} + c, {STAR_LEVEL} + n, bal % 100, 2 FROM cr
      UNION ALL SELECT r, 3 * {STAR_LEVEL} + o, 2 * {STAR_LEVEL} + c, price % 1000, 3 FROM orr
      UNION ALL SELECT r, 4 * {STAR_LEVEL} + ln.key, 3 * {STAR_LEVEL} + ln.o, q, 4 FROM ln JOIN orr ON ln.o = orr.o)
"""


def _star_fold_sql(value: str, agg: str, levels: int = 4, top: int = 0) -> str:
    """Nested GROUP BY, one per level."""
    parts, below = [], None
    for depth in range(levels, top - 1, -1):
        if below is None:
            parts.append(f"s{depth} AS (SELECT tree_id, node_id, parent_id, {value} AS x FROM e WHERE depth = {depth})")
        else:
            parts.append(
                f"s{depth} AS (SELECT e.tree_id, e.node_id, e.parent_id, {value} + coalesce(g.x, 0) AS x FROM e"
                f" LEFT JOIN (SELECT parent_id, {agg}(x) AS x FROM s{below} GROUP BY parent_id) g ON g.parent_id = e.node_id"
                f" WHERE e.depth = {depth})"
            )
        below = depth
    return ",\n".join(parts)


def _gen_sql(extra: str) -> str:
    return f"""
WITH spec AS (SELECT CAST(c_nationkey AS BIGINT) AS tree_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
{extra}"""


def _mix_sql(x: str) -> str:
    """The 32-bit mixing of the generator."""
    for shift, factor in ((16, 0x045D9F3B), (15, 0x2545F491)):
        x = f"(xor({x}, ({x}) >> {shift}) * {factor} % 4294967296)"
    return f"xor({x}, ({x}) >> 16)"


def _draw_sql(place: str, more: int = 0) -> str:
    return _mix_sql(f"((tree_id * {0x2545F491} % 4294967296 + {7 * 0x045D9F3B % 2**32} + {place} + {more}) % 4294967296)")


def _grown_sql(deepness: float) -> str:
    """Trees token by token: forced opens at depth 1, then coins, then closes."""
    return f"""WITH RECURSIVE spec AS MATERIALIZED (
  SELECT CAST(c_nationkey AS BIGINT) AS tree_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
coins AS MATERIALIZED (SELECT tree_id, k, {_draw_sql("k")} < {int(deepness * 2**32)} AS up
  FROM (SELECT tree_id, unnest(range(1, 2 * n + 1)) AS k FROM spec)),
g AS (
  SELECT tree_id, n, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS depth, CAST(1 AS BIGINT) AS opens, CAST(0 AS BIGINT) AS k,
    true AS is_open FROM spec
  UNION ALL
  SELECT tree_id, n, pos + 1, depth + CASE WHEN o THEN 1 ELSE -1 END, opens + CASE WHEN o THEN 1 ELSE 0 END, next_k, o
  FROM (SELECT g.*, CASE WHEN opens = g.n THEN false WHEN depth = 1 THEN true ELSE up END AS o,
          CASE WHEN opens = g.n OR depth = 1 THEN g.k ELSE g.k + 1 END AS next_k
        FROM g LEFT JOIN coins ON g.tree_id = coins.tree_id AND g.k + 1 = coins.k WHERE pos < 2 * g.n - 1))
"""


def all_oracles() -> dict[str, str]:
    walk, toks = _with(WALK), _with(WALK, TOKENS)
    vals = _with(WALK, VALUES)
    parts = _with(WALK, VALUES, TOKENS, _chunk_parts(CHUNK))
    pairs = _with(WALK, VALUES, TOKENS, _chunk_parts(CHUNK), PAIRS)
    pieces = _with(WALK, VALUES, TOKENS, _chunk_parts(CHUNK), PIECES)
    best = vals + "SELECT tree_id, fold AS value FROM v WHERE parent IS NULL"
    prod = _with(WALK, _fold_levels_sql("small")) + "SELECT tree_id, CAST(x AS BIGINT) AS value FROM f WHERE parent IS NULL"
    auto = _with(WALK, _automaton_sql()) + (
        f"SELECT tree_id, {', '.join(f'bit_or(r{i}) AS r{i}' for i in range(10))} FROM p WHERE is_leaf GROUP BY tree_id"
    )
    out: dict[str, str] = {}
    for name, sql in (("max_path_sum", best), ("sum_product", prod), ("path_automaton", auto)):
        for plan in ("chunks", "levels", "rounds", "pairs"):
            out[f"fold_{plan}_{name}"] = sql
    out["fold_tree_max_path_sum"] = best
    out["fold_rounds_value_sum"] = walk + "SELECT tree_id, CAST(sum(value) AS BIGINT) AS value FROM n GROUP BY tree_id"
    star = "WITH " + STAR.strip() + ",\n"
    out["fold_levels_star_max_path_sum"] = star + _star_fold_sql("value", "max") + "SELECT tree_id, CAST(x AS BIGINT) AS value FROM s0"
    out["fold_levels_star_nodes"] = out["fold_levels_star_max_path_sum"]
    out["fold_levels_star_sum_product"] = star + _star_fold_sql("value % 2", "product") + "SELECT tree_id, CAST(x AS BIGINT) AS value FROM s0"
    out["fold_levels_star_value_sum"] = star.rstrip().rstrip(",") + " SELECT tree_id, CAST(sum(value) AS BIGINT) AS value FROM e GROUP BY tree_id"
    out["fold_forest_star"] = star + _star_fold_sql("value", "max", 4, 1) + "SELECT tree_id, CAST(max(x) AS BIGINT) AS value FROM s1 GROUP BY tree_id"
    out["fold_forest"] = (
        "SELECT CAST(c_nationkey AS BIGINT) AS tree_id, CAST(max(floor(o_totalprice)) AS BIGINT) AS value"
        " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
    )
    out["fold_rounds_conversations"] = (
        "SELECT conv_id AS tree_id, CAST(sum(length(text)) AS BIGINT) AS value FROM conversations GROUP BY conv_id"
    )
    custom = _with(
        WALK,
        "pw AS (SELECT tree_id, i, 1 AS w FROM n WHERE parent IS NULL UNION ALL"
        " SELECT n.tree_id, n.i, (pw.w * 3) % 1000003 FROM pw JOIN n ON n.tree_id = pw.tree_id AND n.parent = pw.i)",
    ) + (
        "SELECT n.tree_id, CAST(((sum(n.value * w) % 1000003) + 1000003) % 1000003 AS BIGINT) AS value"
        " FROM n JOIN pw ON n.tree_id = pw.tree_id AND n.i = pw.i GROUP BY n.tree_id"
    )
    for plan in ("chunks", "levels", "pairs"):
        out[f"tree_algebra_custom_{plan}"] = custom

    total = walk + "SELECT tree_id, CAST(sum(value) AS BIGINT) AS value FROM n GROUP BY tree_id"
    for name, sql in (("max_path_sum", best), ("sum_product", prod), ("path_automaton", auto), ("value_sum", total)):
        for plan in ("rounds", "pairs"):
            out[f"fold_{plan}_{name}_contract"] = sql
    out["fold_chunks_merge_rounds"] = best
    # on a path the best path sum is the sum of all values
    for name in ("fold_rounds_path_max_path_sum", "fold_rounds_path_value_sum", "fold_levels_path_tall", "fold_tree_tall"):
        out[name] = total

    def ordered(codes: str) -> str:
        return walk + (
            f", x AS ({codes}), y AS (SELECT tree_id, list(code ORDER BY pos) AS codes FROM x GROUP BY tree_id)"
            " SELECT tree_id, CAST(list_reduce(list_prepend(0, codes), lambda h, code : (((h * 31 + code) % 1000003) + 1000003) % 1000003)"
            " AS BIGINT) AS value FROM y"
        )

    opens = "SELECT tree_id, {pos} AS pos, 2 * value + CASE WHEN {leaf} THEN 1 ELSE 0 END AS code FROM {source}"
    closes = " UNION ALL SELECT tree_id, {close}, 7 FROM {source} WHERE NOT ({leaf})"
    parts_of = {"pos": "pos", "close": "close_pos", "leaf": "is_leaf", "source": "n"}
    for name in ("fold_ordered_walk", "fold_ordered_levels", "fold_chunks_ordered", "fold_ordered_chunks"):
        out[name] = ordered((opens + closes).format(**parts_of))
    last = "(SELECT *, count(*) OVER (PARTITION BY tree_id) AS total FROM n)"
    parts_of = {"pos": "i", "close": "2 * total - 1 - i", "leaf": "i = total - 1", "source": last}
    out["fold_ordered_path"] = out["fold_tree_ordered_tall"] = ordered((opens + closes).format(**parts_of))
    out["rank_edges_path"] = walk + (
        "SELECT tree_id, i AS node_id, i AS open_pos, 2 * total - 1 - i AS close_pos, CAST(i AS INTEGER) AS depth"
        f" FROM {last} AS p"
    )
    out["rank_edges_walk"] = walk + (
        "SELECT tree_id, pos AS node_id, pos AS open_pos, close_pos, CAST(depth AS INTEGER) AS depth FROM n"
    )

    token_text = "coalesce(CAST(value AS VARCHAR), '/')"
    lines = f"SELECT tree_id, pos // {CHUNK} AS chunk_id, string_agg({token_text}, ' ' ORDER BY pos) AS line FROM t GROUP BY ALL"
    out["read_tree_text"] = toks + lines
    out["split_chunks"] = toks + lines
    out["read_numbered_text"] = toks + lines
    out["read_depth_text"] = toks + "SELECT tree_id, pos, value, CAST(depth AS INTEGER) AS depth FROM t"
    out["tokenize"] = toks + "SELECT tree_id, pos, value FROM t"
    out["index_tokens"] = out["read_token_ranges"] = toks + f"SELECT tree_id, pos, {token_text} AS token FROM t"
    out["chunk_starts"] = toks + (
        f"SELECT tree_id, pos // {CHUNK} AS chunk_id, count(*) AS n_tokens, min(pos) AS start FROM t GROUP BY ALL"
    )
    out["serialize_depth_split"] = toks + (
        ", m AS (SELECT tree_id, greatest(count(*) // CAST(ceil(count(*) / 512.0) AS BIGINT), 1) AS m FROM t GROUP BY tree_id),"
        f" b AS (SELECT t.tree_id, pos // m AS line, string_agg(CAST(depth AS VARCHAR) || ' ' || {token_text}, ' ' ORDER BY pos) AS body"
        " FROM t JOIN m ON t.tree_id = m.tree_id GROUP BY ALL)"
        " SELECT tree_id, line, CAST(line AS VARCHAR) || chr(9) || body AS text FROM b"
    )
    out["serialize_depth"] = (
        "WITH x AS (SELECT conv_id AS tree_id, turn, length(text) AS len, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),"
        " k AS (SELECT tree_id, n, turn AS pos, turn, CAST(len AS VARCHAR) AS w FROM x"
        " UNION ALL SELECT tree_id, n, 2 * n - 1 - turn, turn, '/' FROM x),"
        " m AS (SELECT *, greatest(2 * n // CAST(ceil(2 * n / 4096.0) AS BIGINT), 1) AS m FROM k),"
        " b AS (SELECT tree_id, pos // m AS line, string_agg(CAST(turn AS VARCHAR) || ' ' || w, ' ' ORDER BY pos) AS body FROM m GROUP BY ALL)"
        " SELECT tree_id, line, CAST(line AS VARCHAR) || chr(9) || body AS text FROM b"
    )
    out["result_codec"] = parts + (
        "SELECT tree_id, chunk_id, part, i, coalesce(CAST(v AS VARCHAR), '_') AS t, v FROM flat"
    )

    out["tree_map"] = toks + "SELECT tree_id, pos, value * value + 1 AS value FROM t"
    out["leaf_filter"] = walk + "SELECT tree_id, pos AS node_id, value FROM n WHERE is_leaf"
    out["root_filter"] = walk + "SELECT tree_id, pos AS node_id, value FROM n WHERE parent IS NULL"
    out["token_depth"] = toks + "SELECT tree_id, pos, value, CAST(depth AS INTEGER) AS depth FROM t"
    out["serialize_tree"] = toks + "SELECT tree_id, pos, CAST(depth AS INTEGER) AS depth, value FROM t"
    out["match_brackets"] = walk + (
        "SELECT tree_id, pos AS node_id, close_pos, parent_pos AS parent_id, CAST(depth AS INTEGER) AS depth, is_leaf, value FROM np"
    )
    out["match_brackets_segments"] = out["match_brackets"]
    out["token_depth_segments"] = out["token_depth"]
    out["tree_edges"] = walk + "SELECT tree_id, parent_pos AS parent_id, pos AS node_id FROM np WHERE parent IS NOT NULL"
    out["validate_tokens"] = (
        "WITH x AS (SELECT event_id % 7 AS tree_id, CASE WHEN event_id % 5 < 2 THEN 1 ELSE -1 END AS e, event_id FROM events),"
        " y AS (SELECT tree_id, e, sum(e) OVER (PARTITION BY tree_id ORDER BY event_id) AS d FROM x)"
        " SELECT tree_id, CAST(greatest(-min(d), 0) AS BIGINT) AS extra_closes,"
        " CAST(sum(e) + greatest(-min(d), 0) AS BIGINT) AS unclosed_opens, min(d) >= 0 AND sum(e) = 0 AS valid FROM y GROUP BY tree_id"
    )
    out["validate_tokens_walk"] = walk + (
        "SELECT DISTINCT tree_id, CAST(0 AS BIGINT) AS extra_closes, CAST(0 AS BIGINT) AS unclosed_opens, true AS valid FROM n"
    )
    out["tree_root_value"] = walk + "SELECT tree_id, value FROM n WHERE parent IS NULL"
    out["preorder"] = walk + "SELECT tree_id, i AS rank, pos, value FROM n"
    out["tree_size"] = walk + "SELECT tree_id, count(*) AS n_nodes FROM n GROUP BY tree_id"
    out["subtree_size"] = walk + "SELECT tree_id, pos AS node_id, size FROM n"
    out["tree_max_depth"] = walk + "SELECT tree_id, CAST(max(depth) AS INTEGER) AS max_depth FROM n GROUP BY tree_id"
    edge = star.rstrip().rstrip(",")
    out["tree_from_edges"] = edge + (
        " SELECT tree_id, node_id, parent_id, value, CAST(depth AS INTEGER) AS depth,"
        " inner_.id IS NULL AS is_leaf FROM e LEFT JOIN (SELECT DISTINCT parent_id AS id FROM e) inner_ ON e.node_id = inner_.id"
    )
    # token positions from the pre-order rank of the path of node ids: open = 2 * rank - depth
    out["number_edges"] = edge.replace("WITH ", "WITH RECURSIVE ", 1) + (
        ", pt AS (SELECT tree_id, node_id, depth, [node_id] AS path FROM e WHERE parent_id IS NULL UNION ALL"
        " SELECT e.tree_id, e.node_id, e.depth, list_append(pt.path, e.node_id) FROM pt JOIN e ON e.parent_id = pt.node_id),"
        " rk AS (SELECT tree_id, node_id, path, depth, 2 * (row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1) - depth AS o FROM pt),"
        " an AS (SELECT tree_id, unnest(path) AS node_id FROM rk), sz AS (SELECT tree_id, node_id, count(*) AS size FROM an GROUP BY ALL)"
        " SELECT rk.tree_id, rk.node_id, o AS open_pos, o + 2 * size - 1 AS close_pos FROM rk JOIN sz"
        " ON rk.tree_id = sz.tree_id AND rk.node_id = sz.node_id"
    )

    out["chunk_partial"] = parts + "SELECT tree_id, chunk_id, part, i, a, v, has FROM flat"
    out["merge_partials"] = _with(WALK, VALUES, TOKENS, _chunk_parts(CHUNK * MERGE)) + (
        "SELECT tree_id, chunk_id, part, i, a, v, has FROM flat"
    )
    out["chunk_shape"] = parts + "SELECT tree_id, chunk_id, CAST(n_cs AS INTEGER) AS n_cs, CAST(n_abs AS INTEGER) AS n_abs FROM d"
    out["chunk_depth"] = parts + (
        "SELECT tree_id, chunk_id, CAST(n_cs AS INTEGER) AS n_cs, CAST(n_abs AS INTEGER) AS n_abs, CAST(depth AS INTEGER) AS depth,"
        " lead(chunk_id) OVER (PARTITION BY tree_id ORDER BY chunk_id) AS next_id FROM d"
    )
    out["mating_pairs"] = pairs + "SELECT tree_id, off_l, off_r, CAST(du AS INTEGER) AS du, CAST(dl AS INTEGER) AS dl FROM mates"
    # on a path node i opens at i and closes at 2 * total - 1 - i; depths rise and then fall, so a chunk is lowest at an end
    out["mating_pairs_path"] = walk + (
        f", c AS (SELECT tree_id, i, i // {CHUNK} AS oc, (2 * total - 1 - i) // {CHUNK} AS cc FROM {last} AS p),"
        f" ln AS (SELECT tree_id, 2 * count(*) AS m FROM n GROUP BY tree_id),"
        f" s AS (SELECT tree_id, m, unnest(range((m + {CHUNK - 1}) // {CHUNK})) AS j FROM ln),"
        f" e AS (SELECT tree_id, j, m, {CHUNK} * j AS a, least({CHUNK} * (j + 1), m) AS b FROM s),"
        " d AS (SELECT tree_id, j, least(a, m - a, b, m - b) AS depth FROM e)"
        " SELECT tree_id, oc AS off_l, cc AS off_r, CAST(min(i) AS INTEGER) AS du, CAST(max(i) + 1 AS INTEGER) AS dl FROM c"
        " WHERE cc > oc + 1 GROUP BY ALL UNION ALL"
        " SELECT x.tree_id, x.j, y.j, CAST(greatest(x.depth, y.depth) AS INTEGER), NULL FROM d x JOIN d y"
        " ON x.tree_id = y.tree_id AND y.j = x.j + 1"
    )
    out["pair_tree"] = pairs + (
        "SELECT k.tree_id, k.off_l, k.off_r, CAST(k.du AS INTEGER) AS du, CAST(k.dl AS INTEGER) AS dl, p.off_l AS parent_l, p.off_r AS parent_r"
        " FROM mates k LEFT JOIN mates p ON p.tree_id = k.tree_id AND p.dl = k.du AND p.off_l <= k.off_l AND k.off_r <= p.off_r"
    )
    out["pair_pieces"] = pieces + (
        "SELECT tree_id, side, node_c, CAST(level AS INTEGER) AS level, chunk_id, a, v, v IS NOT NULL AS has FROM pieces"
    )
    out["pair_triplets"] = pieces + (
        "SELECT tree_id, node_c, CAST(level AS INTEGER) AS level, close_c, a, s, s IS NOT NULL AS has FROM trip"
    )
    out["compose_pairs"] = pieces + (
        ", g AS (SELECT *, min(level) OVER w AS du, max(level) OVER w + 1 AS dl, sum(a) OVER (w ORDER BY level) AS pa"
        " FROM trip WINDOW w AS (PARTITION BY tree_id, node_c, close_c)),"
        " u AS (SELECT tree_id, node_c, close_c, du, dl, CAST(max(CASE WHEN level < dl - 1 THEN pa + s END) AS BIGINT) AS k,"
        " CAST(sum(CASE WHEN level < dl - 1 THEN a END) AS BIGINT) AS p FROM g GROUP BY ALL)"
        " SELECT u.tree_id, u.node_c AS off_l, u.close_c AS off_r, CAST(u.du AS INTEGER) AS du, CAST(u.dl AS INTEGER) AS dl, k, p,"
        " u.dl - u.du > 1 AS wrapped, t.a, t.s, t.s IS NOT NULL AS has FROM u JOIN trip t ON t.tree_id = u.tree_id"
        " AND t.node_c = u.node_c AND t.close_c = u.close_c AND t.level = u.dl - 1"
    )

    out["sum_zip"] = toks + "SELECT tree_id, pos, value + small AS value FROM t"
    out["zip_trees"] = toks + "SELECT tree_id, pos, CASE WHEN value IS NOT NULL THEN greatest(value, small * 10) END AS value FROM t"
    out["zip_check"] = toks + (
        ", j AS (SELECT coalesce(a.tree_id, b.tree_id) AS tree_id, coalesce(a.pos, b.pos) AS pos, a.pos IS NULL OR b.pos IS NULL"
        " OR (a.value IS NULL) <> (b.value IS NULL) AS bad FROM t a FULL JOIN (SELECT (tree_id + 1) % 5 AS tree_id, pos, value FROM t) b"
        " ON a.tree_id = b.tree_id AND a.pos = b.pos)"
        " SELECT tree_id, count(*) AS n_positions, count(*) FILTER (WHERE bad) AS n_mismatches,"
        " min(pos) FILTER (WHERE bad) AS first_mismatch FROM j GROUP BY tree_id"
    )

    for name, deepness in (("gen_trees", 0.5), ("gen_trees_path", 1.0)):
        out[name] = _grown_sql(deepness) + "SELECT tree_id, pos, CAST(CASE WHEN is_open THEN 1 END AS BIGINT) AS value FROM g"
    masks = ", ".join(
        f"CAST(CASE WHEN is_open THEN {_draw_sql('pos', (i + 1) * 0x1B873593)} % 1024 END AS INTEGER) AS r{i}" for i in range(10)
    )
    out["gen_trees_matrix"] = _grown_sql(0.7) + f"SELECT tree_id, pos, is_open, {masks} FROM g"
    out["gen_chunks"] = _grown_sql(0.5) + (
        "SELECT tree_id, pos // (2 * n // CAST(ceil(n / 256.0) AS BIGINT) + 1) AS chunk_id,"
        " string_agg(CASE WHEN is_open THEN '1' ELSE '/' END, ' ' ORDER BY pos) AS line FROM g GROUP BY ALL"
    )
    out["gen_branching"] = """
WITH RECURSIVE r AS (
  SELECT 0 AS rnd, 5 AS depth, (SELECT count(*) FROM orders) AS size, (SELECT count(*) FROM orders) AS next_id
  UNION ALL
  SELECT rnd + 1, depth - 1, kept + made, next_id + made FROM (
    SELECT *, (size - kept + run - 1) // run AS made FROM (
      SELECT *, greatest((size - kept) // 8, 1) AS run FROM (SELECT *, CAST(floor(size * 0.25) AS BIGINT) AS kept FROM r)))
  WHERE depth > 2 AND size >= 8),
p AS (SELECT *, (size - kept + run - 1) // run AS made, depth > 2 AND size >= 8 AS active FROM (
    SELECT *, greatest((size - kept) // 8, 1) AS run FROM (SELECT *, CAST(floor(size * 0.25) AS BIGINT) AS kept FROM r))),
it AS (
  SELECT 0 AS rnd, unnest(range((SELECT count(*) FROM orders))) AS id, unnest(range((SELECT count(*) FROM orders))) AS spot
  UNION ALL
  SELECT it.rnd + 1, CASE WHEN spot < kept THEN id ELSE next_id + made - 1 - (spot - kept) // run END,
    CASE WHEN spot < kept THEN spot ELSE kept + made - 1 - (spot - kept) // run END
  FROM it JOIN p ON it.rnd = p.rnd WHERE active AND (spot < kept OR (spot - kept) % run = 0)),
e AS (
  SELECT CASE WHEN active THEN next_id + made - 1 - (spot - kept) // run ELSE next_id END AS parent_id,
    CASE WHEN active THEN (spot - kept) % run ELSE spot END AS place
  FROM it JOIN p ON it.rnd = p.rnd WHERE NOT active OR spot >= kept
  UNION ALL SELECT NULL, 0)
SELECT CAST(parent_id AS BIGINT) AS parent_id, count(*) AS n_children, CAST(min(place) AS BIGINT) AS first,
  CAST(max(place) AS BIGINT) AS last, count(*) AS total FROM e GROUP BY parent_id"""
    out["gen_trees_fold"] = _gen_sql("SELECT tree_id, n AS value FROM spec")
    return out
