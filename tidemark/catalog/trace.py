from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog import sql as S
from tidemark.config import DEFAULT
from tidemark.plans import sequence as SQ
from tidemark.plans import study as ST
from tidemark.session import materialize
from tidemark.sources import tables as T

BLOCK = 65_536
SMALL = replace(DEFAULT, cooccurrence_window=8)


def _pooled(s, d):
    return ST.pooled(T.trace(s, d))


def _blocks(s, d):
    return ST.to_blocks(_pooled(s, d), BLOCK)


QUERIES = {
    "mrc_residency_ceiling": lambda s, d: ST.resident_hits(ST.split_and_pooled(T.trace(s, d))),
    "mrc3_byte_sizing": lambda s, d: ST.byte_sizing(_pooled(s, d)),
    "mrc5_block_expansion": lambda s, d: _blocks(s, d).groupBy("op", "object_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ns").alias("last_ts")),
    "mrc6_working_set": lambda s, d: ST.summary(T.trace(s, d), pool=True),
    "adv13_sequence_structure": lambda s, d: SQ.predictability(_pooled(s, d), k=8).select("share").withColumn("structured", F.col("share") >= DEFAULT.structure_floor),
    "ts15_next_use": lambda s, d: ST.next_use(_pooled(s, d)),
    "seq1_transitions": lambda s, d: SQ.transitions(_pooled(s, d)),
    "seq2_order2_transitions": lambda s, d: SQ.transitions(_pooled(s, d), order=2).withColumn("context", F.translate("context", "\x1f", ">")),
    "seq3_cooccurrence": lambda s, d: SQ.cooccurrence(_pooled(s, d), SMALL),
    "seq4_sequential_runs": lambda s, d: SQ.sequential_runs(materialize(ST.block_ranges(_pooled(s, d), BLOCK), "ranges")),
    "seq5_hot_objects": lambda s, d: SQ.hot_objects(T.trace(s, d), 5, pool=True),
    "seq6_predictability": lambda s, d: SQ.predictability(_pooled(s, d), k=4),
}

_P = "(SELECT * EXCLUDE (app), '*' AS app, CAST(1 AS BIGINT) AS w8 FROM trace)"
_SPLIT = "(SELECT * EXCLUDE (app), CAST(app AS VARCHAR) AS app, CAST(1 AS BIGINT) AS w8 FROM trace UNION ALL SELECT * EXCLUDE (app), '*' AS app, CAST(1 AS BIGINT) AS w8 FROM trace)"
_SIZES = f"""osz AS (SELECT object_id, arg_max(size, ts_ns) FILTER (WHERE size IS NOT NULL) AS latest FROM trace WHERE op = 'get' AND status <> 206 GROUP BY 1),
zz AS (SELECT '*' AS app, count(*) AS objects, count(latest) AS sized, greatest({S.upper('latest')}, 1) AS fill, coalesce(sum(latest), 0) AS known FROM osz),
sz AS (SELECT app, objects, sized, fill, CAST(known + (objects - sized) * fill AS BIGINT) AS total_bytes FROM zz)"""
_G = S.TRACE + """,
rdx AS (SELECT object_id, ts_ns, op_id, row_number() OVER (ORDER BY ts_ns, op_id) AS i, lag(object_id, 1) OVER w AS p1, lag(object_id, 2) OVER w AS p2 FROM trace WHERE op = 'get' WINDOW w AS (ORDER BY ts_ns, op_id))"""


def _trans(ctx: str, cond: str) -> str:
    return f"""WITH {_G}, pr AS (SELECT {ctx} AS context, object_id AS nx, count(*) AS n FROM rdx WHERE {cond} GROUP BY 1, 2),
 rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY context ORDER BY n DESC, nx) AS INTEGER) AS rank, sum(n) OVER (PARTITION BY context) AS total FROM pr)
 SELECT '*' AS app, context, nx AS next, n, rank, n / total AS confidence, total >= 2 AS supported FROM rk WHERE rank <= 4"""


def _predict(k: int) -> str:
    return f"""WITH {_G}, stp AS (SELECT p1 AS c, object_id AS o, i FROM rdx WHERE p1 IS NOT NULL),
 bf AS (SELECT a.i, a.c, a.o, b.o AS cand, count(*) AS n FROM stp a JOIN stp b ON a.c = b.c AND b.i < a.i GROUP BY 1, 2, 3, 4),
 rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, cand) AS r FROM bf)
 SELECT '*' AS app, (SELECT count(*) FROM stp) AS steps, count(*) FILTER (WHERE cand = o AND r <= {k}) AS predicted, count(*) FILTER (WHERE cand = o AND r <= {k}) / (SELECT count(*) FROM stp) AS share FROM rk"""


_BLK = S.TRACE + f""",
bev AS (SELECT ts_ns, op_id, op, object_id, CASE WHEN size > 0 THEN (size - 1) // {BLOCK} ELSE 0 END AS b1,
  coalesce(sum(CASE WHEN op <> 'get' THEN 1 ELSE 0 END) OVER (PARTITION BY object_id ORDER BY ts_ns, op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM trace WHERE op IN ('get', 'put', 'delete')),
own AS (SELECT *, unnest(generate_series(0, b1)) AS block FROM bev),
blk AS (SELECT ts_ns, op_id, op, object_id AS base, block FROM own WHERE op = 'get' UNION ALL
  (SELECT ts_ns, op_id, op, object_id, block FROM own WHERE op <> 'get' UNION SELECT w.ts_ns, w.op_id, w.op, w.object_id, t.block FROM bev w JOIN own t ON w.object_id = t.object_id AND w.ep = t.ep AND t.op = 'get' WHERE w.op <> 'get'))"""

ORACLES = {
    "mrc_residency_ceiling": f"""WITH {S.TRACE}, z AS (SELECT app, op, lag(op) OVER (PARTITION BY app, object_id ORDER BY ts_ns, op_id) AS p FROM {_SPLIT} WHERE op IN ('get', 'put', 'delete'))
 SELECT app, count(*) FILTER (WHERE op = 'get') AS accesses, count(*) FILTER (WHERE op = 'get' AND p = 'get') AS resident_hits,
 count(*) FILTER (WHERE op = 'get' AND p = 'get') / nullif(count(*) FILTER (WHERE op = 'get'), 0) AS ceiling FROM z GROUP BY 1""",
    "mrc3_byte_sizing": f"WITH {S.TRACE}, {_SIZES} SELECT * FROM sz",
    "mrc5_block_expansion": f"WITH {_BLK} SELECT op, base || '#' || block AS object_id, count(*) AS n, max(ts_ns) AS last_ts FROM blk GROUP BY 1, 2",
    "mrc6_working_set": f"""WITH {S.TRACE} SELECT app, count(*) AS events, count(*) FILTER (WHERE op = 'get') AS gets, count(DISTINCT object_id) FILTER (WHERE op = 'get') AS objects,
 CAST(0 AS BIGINT) AS ranged_excluded, CAST(0 AS DOUBLE) AS ranged_frac, count(size) FILTER (WHERE op = 'get') / count(*) FILTER (WHERE op = 'get') AS size_coverage, min(ts_ns) AS ts_start, max(ts_ns) AS ts_end FROM {_SPLIT} GROUP BY 1""",
    "adv13_sequence_structure": f"SELECT share, share >= 0.1 AS structured FROM ({_predict(8)})",
    "ts15_next_use": f"""WITH {S.TRACE}, z AS (SELECT op, object_id, op_id, ts_ns, lead(op) OVER w AS no, lead(ts_ns) OVER w AS nt FROM trace WHERE op IN ('get', 'put', 'delete')
 WINDOW w AS (PARTITION BY object_id ORDER BY ts_ns, op_id)) SELECT '*' AS app, object_id, op_id, ts_ns, CASE WHEN no = 'get' THEN nt END AS next_use FROM z WHERE op = 'get'""",
    "seq1_transitions": _trans("p1", "p1 IS NOT NULL"),
    "seq2_order2_transitions": _trans("p2 || '>' || p1", "p2 IS NOT NULL"),
    "seq3_cooccurrence": f"""WITH {_G}, pr AS (SELECT DISTINCT x.i, x.object_id AS a, y.object_id AS b FROM rdx x JOIN rdx y ON y.i < x.i AND y.i >= x.i - 8 WHERE x.object_id <> y.object_id)
 SELECT '*' AS app, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM pr GROUP BY 2, 3""",
    "seq4_sequential_runs": f"""WITH {_BLK}, z AS (SELECT base, block, ts_ns, op_id, lag(block) OVER (PARTITION BY base ORDER BY ts_ns, op_id, block) AS pb FROM blk WHERE op = 'get'),
 y AS (SELECT *, sum(CASE WHEN pb IS NOT NULL AND block = pb + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY base ORDER BY ts_ns, op_id, block ROWS UNBOUNDED PRECEDING) AS r FROM z)
 SELECT '*' AS app, base, CAST(r AS BIGINT) AS run, count(*) AS length, min(block) AS first_block FROM y GROUP BY base, r""",
    "seq5_hot_objects": f"""WITH {S.TRACE}, c AS (SELECT app, object_id, count(*) AS n FROM {_SPLIT} WHERE op = 'get' GROUP BY 1, 2)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app ORDER BY n DESC, object_id) AS INTEGER) AS rank FROM c) WHERE rank <= 5""",
    "seq6_predictability": _predict(4),
}
