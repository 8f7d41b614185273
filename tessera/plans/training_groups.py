"""Training-group assembly over the driver's ``conversations`` table: a user
turn is the query, the assistant turn right after it the positive, and the
assistant turns of the next two conversations the negative pool (an equi
join on shifted conversation ids, not all pairs).  The task of a group is
taken from a fixed task list by ``conv_id % 4``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import groups as G
from ..session import table
from .registry import register

SEED = 42
N_PASSAGES = 4
PROMPT_PROB = 0.5
EPOCH = 1
TASKS = ["msmarco", "AllNLI", "nq", "quora_duplicates_triplets"]


def build_groups(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn(
        "pid", F.col("conv_id") * 1000 + F.col("turn"))
    psg = lambda c: F.struct(F.col(c).cast("string").alias("docid"),
                             F.lit(None).cast("string").alias("title"), F.col("text").alias("text"))
    q = t.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("pid").alias("query_id"), F.col("text").alias("query"),
        F.element_at(F.array(*[F.lit(x) for x in TASKS]),
                     (F.pmod(F.col("conv_id"), F.lit(len(TASKS))) + 1).cast("int")).alias("domain_name"))
    asst = t.where(F.col("role") == "assistant")
    pos = (q.join(asst.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"), "pid", "text"),
                  ["conv_id", "turn"])
           .groupBy("query_id").agg(F.collect_list(psg("pid")).alias("positive_passages")))
    negs = (q.select("query_id", F.explode(F.array(F.col("conv_id") + 1, F.col("conv_id") + 2))
                     .alias("conv_id"))
            .join(asst.select("conv_id", "turn", "pid", "text"), "conv_id")
            .groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", psg("pid").alias("p"))))
                 .alias("_n"))
            .select("query_id", F.transform("_n", lambda s: s["p"]).alias("negative_passages")))
    empty = F.array().cast("array<struct<docid:string,title:string,text:string>>")
    return (q.join(pos, "query_id")
            .join(negs, "query_id", "left")
            .withColumn("negative_passages", F.coalesce("negative_passages", empty))
            .select("query_id", "query", "domain_name", "positive_passages", "negative_passages"))


def _inst_values() -> str:
    rows = []
    for task in TASKS:
        arr = ", ".join("'" + s.replace("'", "''") + "'" for s in TX.E5_INSTRUCTIONS[task])
        rows.append(f"('{task}', [{arr}])")
    return ", ".join(rows)


def _h(expr: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5({expr}), 1, {digits}))::BIGINT"


_GROUPS_SQL = f"""
turns AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS pid FROM conversations),
q AS (SELECT conv_id, turn, pid AS query_id, text AS query,
             {[*TASKS]}[conv_id % {len(TASKS)} + 1] AS domain_name
      FROM turns WHERE role = 'user'),
pos AS (SELECT q.query_id, a.pid::VARCHAR AS docid, a.text
        FROM q JOIN turns a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'),
negs AS (SELECT q.query_id, a.pid::VARCHAR AS docid, a.text,
                row_number() OVER (PARTITION BY q.query_id ORDER BY a.conv_id, a.turn) - 1 AS i
         FROM q JOIN turns a ON a.role = 'assistant' AND a.conv_id IN (q.conv_id + 1, q.conv_id + 2)),
g AS (SELECT q.*, coalesce(ns.n, 0) AS nneg,
             (SELECT count(*) FROM pos p2 WHERE p2.query_id = q.query_id) AS npos
      FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM negs GROUP BY query_id) ns USING (query_id)
      WHERE q.query_id IN (SELECT query_id FROM pos))"""


def _neg_sql(need: int, mode: str) -> str:
    if mode == "sample":
        window = f"""SELECT query_id, position, docid, text FROM (
     SELECT n.query_id, n.docid, n.text,
            row_number() OVER (PARTITION BY n.query_id
              ORDER BY {_h("'" + str(SEED) + "|' || n.query_id::VARCHAR || '|perm|' || n.i::VARCHAR")}, n.i) AS position
     FROM negs n JOIN g USING (query_id) WHERE g.nneg >= {need}) WHERE position <= {need}"""
    else:  # epoch window over the doubled permutation
        window = f"""SELECT query_id, position, docid, text FROM (
     SELECT p.query_id, p.docid, p.text, p.r + p.nneg * c.copy - ({EPOCH * need} % p.nneg) AS position
     FROM (SELECT n.query_id, n.docid, n.text, g.nneg,
                  row_number() OVER (PARTITION BY n.query_id
                    ORDER BY {_h("'" + str(SEED) + "|' || n.query_id::VARCHAR || '|perm|' || n.i::VARCHAR")}, n.i) AS r
           FROM negs n JOIN g USING (query_id) WHERE g.nneg >= {need}) p,
          (SELECT unnest([0, 1]) AS copy) c)
   WHERE position BETWEEN 1 AND {need}"""
    return f"""
sel AS (
  SELECT g.query_id, 1 + r.j AS position, n.docid, n.text
  FROM g CROSS JOIN (SELECT unnest(range(0, {need})) AS j) r
  JOIN negs n ON n.query_id = g.query_id
   AND n.i = {_h("'" + str(SEED) + "|' || g.query_id::VARCHAR || '|neg|' || r.j::VARCHAR")} % g.nneg
  WHERE g.nneg > 0 AND g.nneg < {need}
  UNION ALL
  {window})"""


_PROMPT_SQL = f"""
ins AS (SELECT * FROM (VALUES {_inst_values()}) v(task, insts)),
pr AS (SELECT g.query_id,
              ({_h("'" + str(SEED) + "|' || g.query_id::VARCHAR || '|prompt'", 13)} / 4503599627370496.0) <= {PROMPT_PROB} AS keep,
              'Instruct: ' || CASE WHEN len(ins.insts) = 1 THEN ins.insts[1]
                   ELSE ins.insts[{_h("'" + str(SEED) + "|' || g.query_id::VARCHAR || '|inst'")} % len(ins.insts) + 1] END
                || chr(10) || 'Query: ' AS prompt,
              regexp_matches(g.domain_name, '{"|".join(TX.SYMMETRIC_MARKERS)}') AS sym
       FROM g JOIN ins ON ins.task = g.domain_name)"""


@register("sample_groups", ops=("M2", "M3", "M11", "F2", "F9", "F10", "F11", "F12", "J3"),
          oracle=f"""
WITH {_GROUPS_SQL},{_neg_sql(N_PASSAGES - 1, "sample")},{_PROMPT_SQL},
allp AS (SELECT query_id, 0 AS position, docid, text FROM pos UNION ALL SELECT * FROM sel)
SELECT a.query_id, a.position::BIGINT AS position, a.docid,
       CASE WHEN pr.keep THEN pr.prompt || g.query ELSE g.query END AS query_text,
       CASE WHEN pr.keep AND pr.sym THEN pr.prompt || a.text ELSE a.text END AS passage_text
FROM allp a JOIN g USING (query_id) JOIN pr USING (query_id)
""")
def sample_groups(spark, sf_dir):
    g = G.sample_groups(build_groups(spark, sf_dir), N_PASSAGES, SEED)
    g = G.add_prompts(g, TX.instruction_table(spark), SEED, PROMPT_PROB)
    return G.flatten(g).select("query_id", F.col("position").cast("long").alias("position"),
                               "docid", "query_text", "passage_text")


@register("epoch_groups", ops=("M4", "M5", "M11"), oracle=f"""
WITH {_GROUPS_SQL},{_neg_sql(N_PASSAGES - 1, "epoch")},
allp AS (SELECT query_id, 0 AS position, docid, text FROM pos UNION ALL SELECT * FROM sel)
SELECT a.query_id, a.position::BIGINT AS position, a.docid, g.query AS query_text, a.text AS passage_text
FROM allp a JOIN g USING (query_id)
""")
def epoch_groups(spark, sf_dir):
    g = build_groups(spark, sf_dir)
    g = (g.withColumn("positive_passages", F.array(G.epoch_positive(
            F.col("positive_passages"), F.col("query_id"), SEED, EPOCH)))
         .withColumn("negative_passages", G.epoch_negatives(
            F.col("negative_passages"), F.col("query_id"), N_PASSAGES, SEED, EPOCH)))
    return G.flatten(g).select("query_id", F.col("position").cast("long").alias("position"),
                               "docid", "query_text", "passage_text")
