"""The same queries as DuckDB SQL over the raw tables.

The texts are put together from parts: row sources, tree growing per level, k-means per
round. Nothing here is used by the operators.
"""

from __future__ import annotations

import math

from .queries import ASKED_SIZES, LINE_BLOCKS, LONG_LEAST, MINSUP, OFF_HALF, PLAN_SIZES, TAIL, TEXT_BLOCKS, VOTE

U_SPAN = 1 << 60
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1)) for n in range(6)]


def hexint(digest: str, start: int, length: int) -> str:
    return f"('0x' || substr({digest}, {start}, {length}))::BIGINT"


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr} + {OFF_HALF * 10.0**-digits!r}::DOUBLE, {digits})"


def h(prefix: str, *parts: str) -> str:
    return "md5(" + " || ':' || ".join([f"'{prefix}'", *[f"({p})::VARCHAR" for p in parts]]) + ")"


CHARGED = "l_extendedprice * (1 - l_discount) * (1 + l_tax) > 50000"
LINES = f"""
line_raw AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS row_key,
         CASE WHEN {CHARGED} THEN 1 ELSE 0 END AS label,
         [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 10] AS x
  FROM lineitem),
lines AS MATERIALIZED (
  SELECT row_key, ({hexint(h('42', 'row_key'), 1, 8)} % {LINE_BLOCKS})::INT AS block_id,
         {hexint(h('42', 'row_key'), 9, 15)} AS u, label, x
  FROM line_raw)"""

VECTORS = f"""
vectors AS MATERIALIZED (
  SELECT vec_id::VARCHAR AS row_key, ({hexint(h('42', 'vec_id'), 1, 8)} % 5)::INT AS block_id,
         {hexint(h('42', 'vec_id'), 9, 15)} AS u, label, embedding::DOUBLE[] AS x
  FROM embeddings)"""

TEXTS = f"""
texts AS MATERIALIZED (
  SELECT doc_id::VARCHAR AS row_key, ({hexint(h('42', 'doc_id'), 1, 8)} % {TEXT_BLOCKS})::INT AS block_id,
         {hexint(h('42', 'doc_id'), 9, 15)} AS u, quality AS label,
         [n_chars::DOUBLE / 1000, len(string_split(text, ' '))::DOUBLE / 100,
          len(list_distinct(string_split(text, chr(10))))::DOUBLE / len(string_split(text, chr(10)))] AS x
  FROM documents JOIN labels USING (doc_id))"""


def baskets(kind: str = "p_type") -> str:
    return f"""
item_names AS (SELECT {kind} AS name, row_number() OVER (ORDER BY {kind}) AS item
               FROM (SELECT DISTINCT {kind} FROM part)),
basket_items AS MATERIALIZED (
  SELECT DISTINCT l_orderkey AS tid, item::INT AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN item_names ON name = {kind}),
baskets AS MATERIALIZED (
  SELECT tid, ({hexint(h('42', 'tid'), 1, 8)} % {LINE_BLOCKS})::INT AS block_id, list(item ORDER BY item) AS items
  FROM basket_items GROUP BY tid)"""


def placed(key: str, n_blocks: int = LINE_BLOCKS) -> str:
    return f"({hexint(h('42', key), 1, 8)} % {n_blocks})::INT AS block_id, {hexint(h('42', key), 9, 15)} AS u"


def key_of(items: str) -> str:
    return f"'{{' || array_to_string({items}, ',') || '}}'"


def local_itemsets(source: str = "baskets", minsup: float = MINSUP, n_blocks: int = LINE_BLOCKS) -> str:
    """All subsets of every basket, counted per block."""
    return f"""
subsets(tid, block_id, items, members) AS (
  SELECT tid, block_id, items, []::INT[] FROM {source}
  UNION ALL
  SELECT tid, block_id, items, list_append(members, i)
  FROM (SELECT tid, block_id, items, members, unnest(items) AS i FROM subsets)
  WHERE len(members) = 0 OR i > members[len(members)]),
threshold AS (
  SELECT greatest(1, floor(count(*) * {minsup!r}::DOUBLE / {n_blocks})::BIGINT) AS least_n FROM {source}),
local AS MATERIALIZED (
  SELECT block_id, members, {key_of('members')} AS itemset, count(*) AS support
  FROM subsets WHERE len(members) > 0
  GROUP BY block_id, members HAVING count(*) >= (SELECT least_n FROM threshold))"""


def long_itemsets() -> str:
    """Pairs, triples and quadruples of parts that enough suppliers share, by joins on the supplier."""
    return f"""
WITH held AS MATERIALIZED (SELECT DISTINCT l_suppkey AS tid, l_partkey AS item FROM lineitem),
pairs AS MATERIALIZED (
  SELECT a.item AS a, b.item AS b, count(*) AS support
  FROM held a JOIN held b ON a.tid = b.tid AND a.item < b.item
  GROUP BY a.item, b.item HAVING count(*) >= {LONG_LEAST}),
pair_tids AS MATERIALIZED (
  SELECT a, b, x.tid FROM pairs JOIN held x ON x.item = a SEMI JOIN held y ON y.item = b AND y.tid = x.tid),
triple_tids AS MATERIALIZED (
  SELECT a, b, z.item AS c, p.tid FROM pair_tids p JOIN held z ON z.tid = p.tid AND z.item > b
  QUALIFY count(*) OVER (PARTITION BY a, b, z.item) >= {LONG_LEAST}),
quad_tids AS (
  SELECT a, b, c, z.item AS d, p.tid FROM triple_tids p JOIN held z ON z.tid = p.tid AND z.item > c
  QUALIFY count(*) OVER (PARTITION BY a, b, c, z.item) >= {LONG_LEAST})
SELECT {key_of('[a, b]')} AS itemset, support FROM pairs
UNION ALL SELECT {key_of('[a, b, c]')}, count(*) FROM triple_tids GROUP BY a, b, c
UNION ALL SELECT {key_of('[a, b, c, d]')}, count(*) FROM quad_tids GROUP BY a, b, c, d"""


def vote(n_blocks: int = LINE_BLOCKS) -> str:
    return f"""
SELECT itemset, count(*) AS votes, (sum(support) // count(*))::BIGINT AS support
FROM local WHERE len(members) > 1
GROUP BY itemset HAVING count(*) >= {n_blocks * VOTE!r}::DOUBLE"""


def recount(minsup: float) -> str:
    return f"""
SELECT {key_of('members')} AS itemset, count(*) AS support,
       {rnd('count(*) / (SELECT count(*) FROM baskets)')} AS share
FROM subsets SEMI JOIN (SELECT DISTINCT members FROM local) USING (members)
WHERE len(members) > 1
GROUP BY members HAVING count(*) / (SELECT count(*) FROM baskets) >= {minsup!r}::DOUBLE"""


def block_order(job: int) -> str:
    return (
        f"SELECT {job} AS job, block_id, row_number() OVER "
        f"(ORDER BY {h('42', str(job), 'block_id')}, block_id)::INT AS rank FROM (SELECT DISTINCT block_id FROM lines)"
    )


def holdout(source: str) -> str:
    return f"""
marked AS MATERIALIZED (
  SELECT *, (rank() OVER (PARTITION BY block_id ORDER BY u)
             <= floor(count(*) OVER (PARTITION BY block_id) * 0.9::DOUBLE)) AS is_train FROM {source})"""


# Trees: a chain of tables, one set per level.


def tree(source: str, depth: int, dim: int, min_leaf: int = 10, n_trees: int = 0, seed: int = 7) -> str:
    bins = 32
    m = max(1, int(math.sqrt(dim)))
    parts = [
        f"""
tall AS MATERIALIZED (
  SELECT row_key, block_id, f, v, row_number() OVER (PARTITION BY block_id, f ORDER BY v) AS place,
         count(*) OVER (PARTITION BY block_id, f) AS n
  FROM (SELECT row_key, block_id, f, x[f + 1] AS v
        FROM (SELECT row_key, block_id, x, unnest(range({dim}))::INT AS f FROM {source}))),
thresholds AS MATERIALIZED (
  SELECT block_id, f, (k - 1)::INT AS bin, v AS threshold
  FROM tall, (SELECT unnest(range(1, {bins})) AS k) WHERE place = ((k * n + {bins - 1}) // {bins})),
binned AS MATERIALIZED (
  SELECT row_key, block_id, f, (SELECT count(*) FROM thresholds t
    WHERE t.block_id = s.block_id AND t.f = s.f AND t.threshold < s.v)::INT AS bin
  FROM tall s)"""
    ]
    if n_trees:
        draw = f"substr({h(f'draw{seed}', 'tree // 8', 'u')}, 4 * (tree % 8) + 1, 4)"
        steps = " + ".join(f"(d >= '{int(p * (1 << 16)):04x}')::INT" for p in POISSON)
        parts.append(f"""
state0 AS MATERIALIZED (
  SELECT row_key, block_id, tree, 1 AS node, label, w
  FROM (SELECT *, {steps} AS w
        FROM (SELECT *, {draw} AS d
              FROM (SELECT row_key, block_id, u, label, unnest(range({n_trees}))::INT AS tree FROM {source})))
  WHERE w > 0)""")
    else:
        parts.append(f"""
state0 AS MATERIALIZED (SELECT row_key, block_id, 0 AS tree, 1 AS node, label, 1 AS w FROM {source})""")
    gain = "(l0 * l0 + l1 * l1) / nl + (r0 * r0 + r1 * r1) / nr - (t0 * t0 + t1 * t1) / nt"
    for level in range(depth):
        state = f"state{level}"
        chosen = ""
        if n_trees:
            chosen = f"""
picked{level} AS (
  SELECT block_id, tree, node, f
  FROM (SELECT block_id, tree, node, unnest(range({dim}))::INT AS f
        FROM (SELECT DISTINCT block_id, tree, node FROM {state}))
  QUALIFY row_number() OVER (PARTITION BY block_id, tree, node
                             ORDER BY {h(f'pick{seed}', 'block_id', 'tree', 'node', 'f')}, f) <= {m}),"""
        only = f"SEMI JOIN picked{level} USING (block_id, tree, node, f)" if n_trees else ""
        parts.append(f"""{chosen}
best{level} AS MATERIALIZED (
  WITH hist AS (
    SELECT block_id, tree, node, f, bin, sum(w) FILTER (label = 0) AS n0, sum(w) FILTER (label = 1) AS n1
    FROM {state} JOIN binned USING (row_key, block_id) GROUP BY ALL),
  sides AS (
    SELECT block_id, tree, node, f, bin,
           sum(coalesce(n0, 0)) OVER upto::DOUBLE AS l0, sum(coalesce(n1, 0)) OVER upto::DOUBLE AS l1,
           sum(coalesce(n0, 0)) OVER whole::DOUBLE AS t0, sum(coalesce(n1, 0)) OVER whole::DOUBLE AS t1
    FROM (SELECT * FROM hist {only})
    WINDOW upto AS (PARTITION BY block_id, tree, node, f ORDER BY bin),
           whole AS (PARTITION BY block_id, tree, node, f)),
  scored AS (
    SELECT *, round({gain}, 6) AS gain
    FROM (SELECT *, l0 + l1 AS nl, r0 + r1 AS nr, t0 + t1 AS nt
          FROM (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM sides))
    WHERE nl >= {min_leaf} AND nr >= {min_leaf})
  SELECT * FROM scored WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY block_id, tree, node ORDER BY gain DESC, f, bin) = 1)""")
        if level + 1 < depth:
            parts.append(f"""
state{level + 1} AS MATERIALIZED (
  SELECT s.row_key, s.block_id, s.tree, 2 * s.node + CASE WHEN g.bin <= b.bin THEN 0 ELSE 1 END AS node, s.label, s.w
  FROM {state} s JOIN best{level} b USING (block_id, tree, node)
  JOIN binned g ON g.row_key = s.row_key AND g.block_id = s.block_id AND g.f = b.f)""")
    every = " UNION ALL ".join(
        f"SELECT block_id, tree, node, f, bin, l0, l1, r0, r1 FROM best{i}" for i in range(depth)
    )
    parts.append(f"""
splits AS MATERIALIZED ({every}),
nodes AS MATERIALIZED (
  WITH known AS (
    SELECT block_id, tree, 1 AS node,
           CASE WHEN sum(w) FILTER (label = 1) > coalesce(sum(w) FILTER (label = 0), 0) THEN 1 ELSE 0 END AS label
    FROM state0 GROUP BY block_id, tree
    UNION ALL SELECT block_id, tree, 2 * node, CASE WHEN l1 > l0 THEN 1 ELSE 0 END FROM splits
    UNION ALL SELECT block_id, tree, 2 * node + 1, CASE WHEN r1 > r0 THEN 1 ELSE 0 END FROM splits)
  SELECT k.block_id, k.tree, k.node, coalesce(s.f, -1)::INT AS feature, coalesce(t.threshold, 0.0) AS threshold, k.label
  FROM known k LEFT JOIN splits s USING (block_id, tree, node)
  LEFT JOIN thresholds t ON t.block_id = s.block_id AND t.f = s.f AND t.bin = s.bin)""")
    return ",".join(parts)


TREE_DEPTH = 10


def walk(rows: str, models: str = "", own: bool = False) -> str:
    """said (row_key, model_block, said): every row through the tree of its own block, or through all trees."""
    pick = "t.block_id = m.block_id" if own else "true"
    return f"""
steps(row_key, model_block, x, node) AS (
  SELECT t.row_key, m.block_id, t.x, 1 FROM {rows} t JOIN (SELECT DISTINCT block_id FROM nodes {models}) m ON {pick}
  UNION ALL
  SELECT s.row_key, s.model_block, s.x, 2 * s.node + CASE WHEN s.x[n.feature + 1] <= n.threshold THEN 0 ELSE 1 END
  FROM steps s JOIN nodes n ON n.block_id = s.model_block AND n.node = s.node WHERE n.feature >= 0),
said AS MATERIALIZED (
  SELECT s.row_key, s.model_block, n.label AS said
  FROM steps s JOIN nodes n ON n.block_id = s.model_block AND n.node = s.node WHERE n.feature < 0)"""


TRIM = f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY accuracy) - 1 AS place, count(*) OVER () AS m FROM scored),
bounds AS (
  SELECT max(accuracy) FILTER (place = t) AS lo, max(accuracy) FILTER (place = m - t - 1) AS hi,
         bool_or(t > m - t - 1) AS keep_all
  FROM (SELECT *, greatest(1, floor(m * {TAIL!r}::DOUBLE)) AS t FROM ranked)),
trimmed AS MATERIALIZED (
  SELECT scored.* FROM scored, bounds WHERE keep_all OR accuracy BETWEEN lo AND hi)"""


def scored_trees(train: str) -> str:
    """Trees of the chosen blocks with their hold-out accuracy."""
    own = walk("marked", own=True).replace("steps", "own_steps").replace("said AS", "own_said AS", 1)
    return f"""{holdout(f"(SELECT * FROM lines WHERE {train})")},
fit_rows AS MATERIALIZED (SELECT * FROM marked WHERE is_train),
{tree('fit_rows', TREE_DEPTH, 4)},{own},
scored AS MATERIALIZED (
  SELECT block_id, count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test,
         avg((said = label)::INT) FILTER (NOT is_train) AS accuracy
  FROM marked JOIN own_said USING (row_key) GROUP BY block_id),
{TRIM}"""


def ensemble(train: str, predict: str, kept: str = "trimmed", weight: str = "1.0") -> str:
    return f"""{scored_trees(train)},{walk(f"(SELECT * FROM lines WHERE {predict})")},
answers AS (
  SELECT t.row_key, t.block_id, t.label, said, {weight} AS weight
  FROM said s JOIN lines t USING (row_key) JOIN {kept} k ON k.block_id = s.model_block),
voted AS MATERIALIZED (
  SELECT row_key, any_value(block_id) AS block_id, any_value(label) AS label, count(*) FILTER (said = 1) AS votes,
         CASE WHEN count(*) FILTER (said = 1) > count(*) FILTER (said = 0) THEN 1 ELSE 0 END AS majority,
         floor(sum(weight * said) / sum(weight) + 0.5)::INT AS weighted
  FROM answers GROUP BY row_key)"""


ACCURACY = f"SELECT count(*) AS n_test, {rnd('avg((majority = label)::INT)')} AS accuracy FROM voted"
FIRST, LAST = "block_id < 30", "block_id >= 30"


def draw(seed: str) -> str:
    return hexint(h(seed, "u"), 1, 15)


ENSEMBLE = f"WITH RECURSIVE {LINES},{ensemble(FIRST, LAST)}"


# k-means with two centres: one table of both centres per block, trial and round.


def start_order(trial: str) -> str:
    return f"CASE WHEN {trial} = 0 THEN u ELSE {hexint(h('start', trial, 'u'), 1, 15)} END"


def sq(a: str, b: str, dim: int) -> str:
    if dim > 8:
        return f"list_distance({a}, {b}) * list_distance({a}, {b})"
    return " + ".join(f"({a}[{j}] - {b}[{j}]) * ({a}[{j}] - {b}[{j}])" for j in range(1, dim + 1))


def two_means(source: str, dim: int, rounds: int, trials: int = 1, tol: float = 0.0, tag: str = "") -> str:
    parts = [f"""
work{tag} AS MATERIALIZED (
  SELECT block_id, trial, x, {start_order('trial')} AS o
  FROM (SELECT block_id, u, x, unnest(range({trials}))::INT AS trial FROM {source})),
lowest{tag} AS MATERIALIZED (SELECT block_id, trial, arg_min(x, o) AS c0 FROM work{tag} GROUP BY block_id, trial),
c{tag}0 AS MATERIALIZED (
  SELECT block_id, trial, c0, x AS c1, true AS moving
  FROM (SELECT *, {sq('x', 'c0', dim)} AS away FROM work{tag} JOIN lowest{tag} USING (block_id, trial))
  QUALIFY row_number() OVER (PARTITION BY block_id, trial ORDER BY away DESC, o) = 1)"""]
    for r in range(rounds):
        parts.append(f"""
c{tag}{r + 1} AS MATERIALIZED (
  WITH placed AS (
    SELECT block_id, trial, CASE WHEN {sq('x', 'c1', dim)} < {sq('x', 'c0', dim)} THEN 1 ELSE 0 END AS cid, x
    FROM work{tag} JOIN c{tag}{r} USING (block_id, trial) WHERE moving),
  means AS (
    SELECT block_id, trial, cid, j, avg(x[j]) AS v
    FROM (SELECT *, unnest(range(1, {dim + 1})) AS j FROM placed) GROUP BY block_id, trial, cid, j),
  lists AS (SELECT block_id, trial, cid, list(v ORDER BY j) AS c FROM means GROUP BY block_id, trial, cid)
  SELECT block_id, trial, n0 AS c0, n1 AS c1,
         moving AND greatest(list_distance(n0, c0), list_distance(n1, c1)) > {tol!r}::DOUBLE AS moving
  FROM (SELECT s.*, coalesce(a.c, s.c0) AS n0, coalesce(b.c, s.c1) AS n1
        FROM c{tag}{r} s LEFT JOIN lists a ON a.block_id = s.block_id AND a.trial = s.trial AND a.cid = 0
        LEFT JOIN lists b ON b.block_id = s.block_id AND b.trial = s.trial AND b.cid = 1))""")
    return ",".join(parts)


def long_centres(state: str, keep: str = "block_id, ", digits: int = 6) -> str:
    return f"""
SELECT {keep}centre_id, (j - 1)::INT AS j, {rnd('c[j]', digits)} AS v
FROM (SELECT *, unnest(range(1, len(c) + 1)) AS j
      FROM (SELECT {keep}0 AS centre_id, c0 AS c FROM {state} UNION ALL SELECT {keep}1, c1 FROM {state}))"""


def best_trial(rounds: int, tag: str, dim: int) -> str:
    state = f"c{tag}{rounds}"
    return f"""
sse{tag} AS (
  SELECT block_id, trial, sum(least({sq('x', 'c0', dim)}, {sq('x', 'c1', dim)})) AS sse
  FROM work{tag} JOIN {state} USING (block_id, trial) GROUP BY block_id, trial),
best{tag} AS MATERIALIZED (
  SELECT block_id, trial, c0, c1, sse FROM {state} JOIN sse{tag} USING (block_id, trial)
  QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY round(sse, 6), trial) = 1)"""


def pooled(state: str) -> str:
    return f"""
pooled AS MATERIALIZED (
  SELECT 0 AS block_id, {hexint(h('pool', 'block_id', 'centre_id'), 9, 15)} AS u, c AS x
  FROM (SELECT block_id, 0 AS centre_id, c0 AS c FROM {state} UNION ALL SELECT block_id, 1, c1 FROM {state}))"""


ROUNDS, TOL = 100, 1e-4  # of k-means: blocks that have settled before take no further part
TWO_STAGE = (
    f"WITH {LINES},{two_means(f'(SELECT * FROM lines WHERE {FIRST})', 4, ROUNDS, tol=TOL, tag='a')},"
    f"{pooled(f'ca{ROUNDS}')},{two_means('pooled', 4, ROUNDS, tol=TOL, tag='b')}"
)
LABEL_MEANS = """
means AS MATERIALIZED (
  SELECT label AS centre_id, list(v ORDER BY j) AS c
  FROM (SELECT label, j, avg(x[j]) AS v FROM (SELECT label, x, unnest(range(1, len(x) + 1)) AS j FROM {source})
        GROUP BY label, j) GROUP BY label)"""
LINE_MEANS = LABEL_MEANS.format(source="lines")
VECTOR_MEANS = LABEL_MEANS.format(source="vectors")
LINE_PLACED = f"""
placed AS MATERIALIZED (
  SELECT block_id, label, (SELECT arg_min(centre_id, {sq('x', 'c', 4)}) FROM means) AS cluster FROM lines)"""
FLIPPED = "greatest(avg((cluster = label)::INT), 1 - avg((cluster = label)::INT))"
VECTOR_NEAREST = """
SELECT row_key, label, arg_min(centre_id, list_distance(x, c)) AS cluster FROM vectors, means GROUP BY row_key, label"""


def plan_sql() -> str:
    listed = {s: [(i * 7 + s) % LINE_BLOCKS for i in range(s)] for s in PLAN_SIZES}
    rows = []
    for size in ASKED_SIZES:
        found = listed.get(size, list(range(size + 2)))
        rows += [f"({size}, {b}, {i + 1})" for i, b in enumerate(found)]
    return f"""
SELECT block_id, size, rank, count(*) AS n_rows
FROM (VALUES {', '.join(rows)}) plan(size, block_id, rank) JOIN lines USING (block_id) GROUP BY ALL"""


#: Means per label in each of the first 30 blocks, trimmed by hold-out accuracy; the rest vote for the nearest label.
CUSTOM = f"""WITH {LINES},{holdout(f'(SELECT * FROM lines WHERE {FIRST})')},
block_means AS MATERIALIZED (
  SELECT block_id, label AS centre_id, list(v ORDER BY j) AS c
  FROM (SELECT block_id, label, j, avg(x[j]) AS v
        FROM (SELECT block_id, label, x, unnest(range(1, 5)) AS j FROM marked WHERE is_train) GROUP BY ALL)
  GROUP BY block_id, label),
held AS (
  SELECT row_key, t.block_id, any_value(label) AS label, arg_min(centre_id, {sq('x', 'c', 4)}) AS said
  FROM marked t JOIN block_means m ON m.block_id = t.block_id WHERE NOT is_train GROUP BY row_key, t.block_id),
scored AS (SELECT block_id, avg((said = label)::INT) AS accuracy FROM held GROUP BY block_id),
{TRIM},
answers AS (
  SELECT row_key, any_value(label) AS label, k.block_id AS model, arg_min(centre_id, {sq('x', 'c', 4)}) AS said
  FROM lines t, block_means m JOIN trimmed k ON k.block_id = m.block_id WHERE t.{LAST} GROUP BY row_key, k.block_id),
voted AS (
  SELECT row_key, any_value(label) AS label, count(*) FILTER (said = 1)::INT AS votes,
         CASE WHEN count(*) FILTER (said = 1) > count(*) FILTER (said = 0) THEN 1 ELSE 0 END AS majority
  FROM answers GROUP BY row_key)"""


def halves(source: str, tag: str) -> str:
    """Per block the means of the rows up to the mean of the first feature (c0), and above it (c1)."""
    return f"""
cut{tag} AS (SELECT block_id, avg(x[1]) AS edge FROM {source} GROUP BY block_id),
c{tag} AS MATERIALIZED (
  SELECT block_id, list(v ORDER BY j) FILTER (side = 0) AS c0, list(v ORDER BY j) FILTER (side = 1) AS c1
  FROM (SELECT block_id, side, j, avg(x[j]) AS v
        FROM (SELECT s.block_id, (x[1] > edge)::INT AS side, x, unnest(range(1, 5)) AS j FROM {source} s JOIN cut{tag} USING (block_id))
        GROUP BY ALL) GROUP BY block_id)"""


def oracle_sql() -> dict[str, str]:
    lines = f"WITH {LINES} "
    bags, brands = f"WITH RECURSIVE {baskets()}", f"WITH RECURSIVE {baskets('p_brand')}"
    split_ids = f"SELECT block_id FROM ({block_order(50)})"
    sampled = 10
    chosen = f"(SELECT * FROM baskets WHERE block_id IN (SELECT block_id FROM taken))"
    taken = (
        f"taken AS (SELECT block_id FROM (SELECT unnest(range({LINE_BLOCKS}))::INT AS block_id) "
        f"ORDER BY {h('42', '200', 'block_id')}, block_id LIMIT {sampled})"
    )
    split_train = f"{hexint(h('43', 'block_id'), 1, 8)} < {int(0.8 * (1 << 32))}"
    random_train = f"block_id IN (SELECT block_id FROM ({block_order(LINE_BLOCKS)}) WHERE rank <= 30)"
    random_test = f"block_id IN (SELECT block_id FROM ({block_order(LINE_BLOCKS)}) WHERE rank BETWEEN 31 AND 40)"
    size = "p_size"
    tree_nodes = "SELECT block_id, node, feature, threshold, label FROM nodes"
    return {
        "block_assign": lines + "SELECT row_key, block_id, u FROM lines",
        "block_counts": lines + "SELECT block_id, count(*) AS n_rows FROM lines GROUP BY block_id",
        "block_select": lines + "SELECT row_key, block_id, label FROM lines WHERE block_id IN (3, 7)",
        "block_shuffle": lines + block_order(50) + " UNION ALL " + block_order(100),
        "block_select_n": lines + f"SELECT * FROM ({block_order(50)} UNION ALL {block_order(100)}) WHERE rank <= 10",
        "block_plan_lookup": lines + plan_sql(),
        "block_budget": f"""
SELECT DISTINCT {size} AS size, floor({size} * 2.5::DOUBLE * 0.5::DOUBLE)::BIGINT AS "full",
  floor({size} * 0.05::DOUBLE * 2.5::DOUBLE * 0.5::DOUBLE)::BIGINT AS full_sampled,
  floor({size} * 2.5::DOUBLE * 0.25::DOUBLE)::BIGINT AS classify,
  greatest(1, floor({size} * 2.5::DOUBLE * 0.25::DOUBLE)::BIGINT) AS cluster,
  ceil({size} * 0.05::DOUBLE)::BIGINT AS mine_vote,
  ceil(({size} // 5) * 10 * 0.05::DOUBLE)::BIGINT AS mine_recount, {size}::BIGINT AS mine_full
FROM part""",
        "block_roles": lines + f"""
SELECT job, block_id, rank, CASE WHEN rank <= 30 THEN 'train' WHEN rank <= 32 THEN 'predict' ELSE 'unused' END AS role,
       count(*) AS n_rows
FROM ({block_order(50)}) JOIN lines USING (block_id) GROUP BY ALL""",
        "predict_fraction": lines + f"""
SELECT row_key, block_id FROM lines
WHERE block_id IN ({split_ids} WHERE rank BETWEEN 31 AND 32) AND {draw('sample')} < {int(0.75 * U_SPAN)}""",
        "row_sample": lines + f"SELECT row_key, block_id FROM lines WHERE {draw('sample')} < {int(0.05 * U_SPAN)}",
        "row_split": lines
        + f"SELECT row_key, CASE WHEN {draw('split')} < {int(0.9 * U_SPAN)} THEN 'train' ELSE 'test' END AS part FROM lines",
        "sample_then_split": lines
        + f"SELECT row_key, CASE WHEN {draw('split')} < {int(0.9 * U_SPAN)} THEN 'train' ELSE 'test' END AS part FROM lines "
        f"WHERE {draw('sample')} < {U_SPAN // 2} AND {draw('again')} < {U_SPAN // 2}",
        "block_holdout": f"WITH {LINES},{holdout('lines')} SELECT row_key, block_id, is_train::INT AS is_train FROM marked",
        "block_subdivide": lines + "SELECT row_key, (block_id * 8 + u % 8)::INT AS block_id FROM lines",
        "block_split": lines + f"""
SELECT DISTINCT block_id, CASE WHEN {split_train} THEN 'train' ELSE 'test' END AS role FROM lines""",
        "labelled_vectors": lines
        + "SELECT row_key, label, x[1] AS x0, x[2] AS x1, x[3] AS x2, x[4] AS x3 FROM lines",
        "svm_labels": lines + "SELECT row_key, CASE WHEN label = 0 THEN -1 ELSE 1 END AS label FROM lines",
        "baskets_parse": f"{bags} SELECT {key_of('items')} AS itemset, count(*) AS n FROM baskets GROUP BY ALL",
        "baskets_identity": f"""{bags}, lines AS (
  SELECT md5(array_to_string(items, ' ')) || '-' || row_number() OVER (PARTITION BY items) AS row_key, items FROM baskets)
SELECT row_key, {placed('row_key')}, {key_of('items')} AS itemset FROM lines""",
        "vectors_plain": f"""
WITH once AS (SELECT (l_orderkey % 3)::INT AS label, l_quantity::DOUBLE AS x0, l_linenumber::DOUBLE AS x1 FROM lineitem),
twice AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE label = 0),
keyed AS (
  SELECT md5(label || '|' || x0 || ',' || x1) || '-' || row_number() OVER (PARTITION BY label, x0, x1) AS row_key, *
  FROM twice)
SELECT row_key, {placed('row_key')}, label, x0, x1 FROM keyed""",
        "baskets_to_text": f"{brands} SELECT array_to_string(items, ' ') AS value, count(*) AS n FROM baskets GROUP BY ALL",
        "itemset_key": f"{brands} SELECT {key_of('items')} AS itemset, count(*) AS n FROM baskets GROUP BY ALL",
        "itemset_text": f"{bags},{local_itemsets()} SELECT itemset || ': ' || support AS value FROM ({vote()})",
        "centres_read": f"""WITH {VECTORS},{VECTOR_MEANS}
SELECT 'vectors' AS name, centre_id, (j - 1)::INT AS j, {rnd('c[j]', 5)} AS v
FROM (SELECT *, unnest(range(1, 65)) AS j
      FROM (SELECT (row_number() OVER (ORDER BY centre_id) - 1)::INT AS centre_id, c FROM means))""",
        "itemset_local": f"{bags},{local_itemsets()} SELECT block_id, itemset, support FROM local",
        "itemset_candidates": f"{bags},{local_itemsets()} SELECT DISTINCT itemset FROM local WHERE len(members) > 1",
        "itemset_vote": f"{bags},{local_itemsets()} {vote()}",
        "itemset_vote_sampled": f"{bags},{taken},{local_itemsets(chosen, n_blocks=sampled)} {vote(sampled)}",
        "itemset_recount": f"{bags},{local_itemsets()} {recount(MINSUP)}",
        "itemset_recount_brands": f"{brands},{local_itemsets(minsup=0.02)} {recount(0.02)}",
        "itemset_long": long_itemsets(),
        "full_itemsets": f"""{bags},{local_itemsets()}
SELECT {key_of('members')} AS itemset, count(*) AS support FROM subsets WHERE len(members) > 1
GROUP BY members HAVING count(*) >= ceil(0.15::DOUBLE * (SELECT count(*) FROM baskets))""",
        "majority_vote": f"""
SELECT l_partkey AS row_key,
       CASE WHEN count(*) FILTER ({CHARGED}) > count(*) FILTER (NOT ({CHARGED})) THEN 1 ELSE 0 END AS prediction
FROM lineitem GROUP BY l_partkey""",
        "weighted_vote": f"""
SELECT l_partkey AS row_key,
       floor(sum(l_quantity * ({CHARGED})::INT) / sum(l_quantity) + 0.5)::INT AS prediction
FROM lineitem GROUP BY l_partkey""",
        "block_scores": f"WITH RECURSIVE {LINES},{scored_trees('true')} "
        f"SELECT block_id, n_train, n_test, {rnd('accuracy')} AS accuracy FROM scored",
        "tail_trim": f"WITH RECURSIVE {LINES},{scored_trees('true')} SELECT block_id, {rnd('accuracy')} AS accuracy FROM trimmed",
        "ensemble_predict": f"{ENSEMBLE} SELECT row_key, majority AS prediction, votes::INT AS votes FROM voted",
        "ensemble_weighted": f"WITH RECURSIVE {LINES},{ensemble(FIRST, LAST, weight='k.accuracy')} "
        "SELECT row_key, weighted AS prediction FROM voted",
        "ensemble_accuracy": f"{ENSEMBLE} {ACCURACY}",
        "ensemble_accuracy_all": f"WITH RECURSIVE {LINES},{ensemble(FIRST, LAST, kept='scored')} {ACCURACY}",
        "ensemble_random_blocks": f"WITH RECURSIVE {LINES},{ensemble(random_train, random_test)} "
        f"SELECT (SELECT count(*) FROM trimmed) AS n_models, * FROM ({ACCURACY})",
        "stored_metrics": f"""WITH RECURSIVE {LINES},{ensemble(random_train, random_test)},
stored AS (
  SELECT 'ensemble' AS run, 'DT' AS algo, 'models' AS metric, count(*)::DOUBLE AS value FROM scored
  UNION ALL SELECT 'ensemble', 'DT', 'kept_models', count(*) FROM trimmed
  UNION ALL SELECT 'ensemble', 'DT', 'cut_models', (SELECT count(*) FROM scored) - count(*) FROM trimmed
  UNION ALL SELECT 'ensemble', 'DT', 'score_low', min(accuracy) FROM trimmed
  UNION ALL SELECT 'ensemble', 'DT', 'score_high', max(accuracy) FROM trimmed
  UNION ALL SELECT 'ensemble', 'DT', 'n_test', count(*) FROM voted
  UNION ALL SELECT 'ensemble', 'DT', 'accuracy', avg((majority = label)::INT) FROM voted
  UNION ALL SELECT 'sample', 'none', 'sample_rows', count(*) FROM lines
            WHERE {random_train} AND {draw('sample')} < {int(0.05 * U_SPAN)})
SELECT run, algo, {LINE_BLOCKS} AS size, metric, {rnd('value')} AS value FROM stored""",
        "svm_ensemble_models": f"""WITH {LINES},
cut AS (SELECT row_key, (block_id * 8 + u % 8)::INT AS block_id, u FROM lines WHERE {FIRST}),{holdout('cut')}
SELECT block_id, count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test
FROM marked GROUP BY block_id HAVING count(*) FILTER (is_train) > 0""",
        "single_model_control": f"""WITH RECURSIVE {LINES},
one AS MATERIALIZED (SELECT row_key, 0 AS block_id, u, label, x, {draw('split')} < {int(0.9 * U_SPAN)} AS fits FROM lines),
fit_rows AS MATERIALIZED (SELECT * FROM one WHERE fits),
{tree('fit_rows', TREE_DEPTH, 4)},{walk('(SELECT * FROM one WHERE NOT fits)')}
SELECT count(*) AS n_test, {rnd("avg((said = label)::INT)")} AS accuracy FROM one JOIN said USING (row_key)""",
        "accuracy_matrix": f"""WITH RECURSIVE {LINES},
fit_rows AS MATERIALIZED (SELECT * FROM lines WHERE {split_train}),
{tree('fit_rows', TREE_DEPTH, 4)},{walk(f"(SELECT * FROM lines WHERE NOT ({split_train}))")}
SELECT model_block, block_id, count(*) AS n_test, {rnd("avg((said = label)::INT)")} AS accuracy
FROM lines JOIN said USING (row_key) GROUP BY model_block, block_id""",
        "label_auc": f"""{ENSEMBLE}
SELECT {rnd('auc')} AS auc, {rnd('auc')} AS auc_curve
FROM (SELECT (avg((majority = label)::INT) FILTER (label = 1) + avg((majority = label)::INT) FILTER (label = 0)) / 2 AS auc
      FROM voted)""",
        "block_stump": f"WITH {LINES},{tree('lines', 1, 4)} {tree_nodes}",
        "block_tree": f"WITH {LINES},{tree('lines', 10, 4)} {tree_nodes}",
        "block_forest": f"WITH {LINES},{tree('lines', 5, 4, min_leaf=5, n_trees=20)} "
        "SELECT block_id, tree, node, feature, threshold, label FROM nodes",
        "svm_other_labels": lines + "SELECT DISTINCT block_id, 1 AS same_weights, 1 AS answers_ok FROM lines",
        "logreg_classes": f"""WITH {VECTORS}
SELECT block_id, l.label, 65 AS n_weights, 1 AS settled
FROM (SELECT DISTINCT block_id FROM vectors), (SELECT DISTINCT label FROM vectors) l""",
        "skewed_tree": f"""WITH {LINES},
steep AS MATERIALIZED (SELECT row_key, block_id, u, label, [x[1], x[2] * x[2] * x[2] * x[2] * x[2] * x[2], x[3], x[4]] AS x FROM lines),
{tree('steep', 10, 4)} {tree_nodes}""",
        "text_tree": f"WITH {TEXTS},{tree('texts', 10, 3)} {tree_nodes}",
        "custom_block_fit": f"""WITH {LINES},{holdout('lines')},
block_means AS (
  SELECT block_id, label AS centre_id, list(v ORDER BY j) AS c
  FROM (SELECT block_id, label, j, avg(x[j]) AS v
        FROM (SELECT block_id, label, x, unnest(range(1, 5)) AS j FROM marked WHERE is_train) GROUP BY ALL)
  GROUP BY block_id, label),
said AS (
  SELECT row_key, t.block_id, any_value(label) AS label, arg_min(centre_id, {sq('x', 'c', 4)}) AS said
  FROM marked t JOIN block_means m ON m.block_id = t.block_id WHERE NOT is_train GROUP BY row_key, t.block_id)
SELECT block_id, (SELECT count(*) FROM marked k WHERE k.block_id = s.block_id AND is_train) AS n_train,
       count(*) AS n_test, {rnd('avg((said = label)::INT)')} AS accuracy
FROM said s GROUP BY block_id""",
        "custom_ensemble": f"{CUSTOM} SELECT row_key, majority AS prediction, votes FROM voted",
        "custom_ensemble_accuracy": f"{CUSTOM} {ACCURACY}",
        "custom_two_stage": f"""WITH {LINES},firsts AS (SELECT * FROM lines WHERE {FIRST}),{halves('firsts', 'a')},
{pooled('ca')},{halves('pooled', 'b')},{LINE_MEANS}
SELECT (SELECT {rnd('avg(purity)')} FROM (
          SELECT block_id, {FLIPPED} AS purity
          FROM (SELECT lines.block_id, label, CASE WHEN {sq('x', 'c1', 4)} < {sq('x', 'c0', 4)} THEN 1 ELSE 0 END AS cluster
                FROM lines, cb WHERE lines.{LAST}) GROUP BY block_id)) AS purity,
       (SELECT {rnd(f"sum(least({sq('c', 'c0', 4)}, {sq('c', 'c1', 4)}))")} FROM means, cb) AS distance""",
        "euclid": f"""WITH {VECTORS},{VECTOR_MEANS}
SELECT row_key, {rnd('list_distance(x, c)', 5)} AS away FROM vectors JOIN means ON centre_id = label""",
        "nearest_centre": f"WITH {VECTORS},{VECTOR_MEANS} SELECT row_key, cluster FROM ({VECTOR_NEAREST})",
        "vector_purity": f"""WITH {VECTORS},{VECTOR_MEANS}
SELECT {rnd('sum(best) / sum(n)')} AS purity
FROM (SELECT max(n) AS best, sum(n) AS n
      FROM (SELECT cluster, label, count(*) AS n FROM ({VECTOR_NEAREST}) GROUP BY ALL) GROUP BY cluster)""",
        "block_kmeans": f"WITH {LINES},{two_means('lines', 4, ROUNDS, tol=TOL)} {long_centres(f'c{ROUNDS}')}",
        "vector_kmeans": f"WITH {VECTORS},{two_means('vectors', 64, ROUNDS, tol=TOL)} {long_centres(f'c{ROUNDS}', digits=5)}",
        "block_bisect": f"WITH {LINES},{two_means('lines', 4, 5, 2, 1e-5, 'a')},{best_trial(5, 'a', 4)} "
        + long_centres("besta"),
        "bisect_best_trial": f"WITH {LINES},{two_means('lines', 4, 5, 2, 1e-5, 'a')},{best_trial(5, 'a', 4)} "
        f"SELECT block_id, trial, {rnd('sse', 4)} AS sse FROM besta",
        "block_sse": f"""WITH {LINES},{two_means('lines', 4, ROUNDS, tol=TOL)}
SELECT block_id, {rnd(f"sum(least({sq('x', 'c0', 4)}, {sq('x', 'c1', 4)}))", 4)} AS sse
FROM lines JOIN c{ROUNDS} USING (block_id) GROUP BY block_id""",
        "purity": f"WITH {LINES},{LINE_MEANS},{LINE_PLACED} SELECT {rnd(FLIPPED)} AS purity FROM placed",
        "purity_by_block": f"WITH {LINES},{LINE_MEANS},{LINE_PLACED} "
        f"SELECT block_id, count(*) AS n_rows, {rnd(FLIPPED)} AS purity FROM placed GROUP BY block_id",
        "two_stage_centres": f"{TWO_STAGE} {long_centres(f'cb{ROUNDS}', keep='')}",
        "two_stage_purity": f"""{TWO_STAGE}
SELECT {rnd('avg(purity)')} AS purity
FROM (SELECT block_id, {FLIPPED} AS purity
      FROM (SELECT lines.block_id, label, CASE WHEN {sq('x', 'c1', 4)} < {sq('x', 'c0', 4)} THEN 1 ELSE 0 END AS cluster
            FROM lines, cb{ROUNDS} WHERE lines.{LAST})
      GROUP BY block_id)""",
        "centre_distance": f"""{TWO_STAGE},{LINE_MEANS}
SELECT 'lines' AS name, {rnd(f"sum(least({sq('c', 'c0', 4)}, {sq('c', 'c1', 4)}))")} AS distance FROM means, cb{ROUNDS}""",
        "two_stage_bisect": f"WITH {LINES},"
        f"{two_means(f'(SELECT * FROM lines WHERE {FIRST})', 4, 5, 2, 1e-5, 'a')},{best_trial(5, 'a', 4)},"
        f"{pooled('besta')},{two_means('pooled', 4, 5, 2, 1e-5, 'b')},{best_trial(5, 'b', 4)} "
        + long_centres("bestb", keep=""),
    }
