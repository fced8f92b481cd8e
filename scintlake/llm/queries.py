"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scintlake.llm import bpe, digests, filter_audit, lines, minhash, mixing, passages, secrets, toxicity, url_filter, vectors, whitening
from scintlake.llm.words import word_count

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: weights 3, 1, 2: the first fades, the second grows, the third stays
SCHEDULES = [[(0.0, 4.0), (1.0, 2.0)], [(0.0, 0.5), (1.0, 1.5)], [(0.0, 2.0), (1.0, 2.0)]]

OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
      FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(rk % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS fill,
             (1.5::DOUBLE * sum(source_size) OVER ()
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size,
             coalesce(least(weight * (SELECT arg_min(level, (fill, rk)) FROM l WHERE level <= fill), cap), cap) AS target FROM l),
o AS (SELECT d.*, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(floor(target) - start, size), 0) + greatest(least(floor(target) - start - source_size, size), 0))::BIGINT AS taken
FROM o
"""


@query("op1_mixing", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mixing.placed(docs, SCHEDULES, budget=1.5, max_repeats=2.0, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda r: F.size(F.filter("strong", lambda x: x["rank"] == r)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                      F.sha2(secrets.as_text(F.col("strong")), 256).alias("base_sha256"),
                      secrets.as_text(F.col("spans")).alias("spans"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _op4_sql(depth: int = 4, support: int = 8, share: float = 0.02, z: float = 1.96, weight: float = 5.0, reject: float = 0.8) -> str:
    fits = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    out = f"""
WITH raw AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
page AS (SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) AS path FROM raw),
rules(rv, rule, rh, rp) AS (VALUES {fits}),
uniq AS (SELECT host, path, count(*) AS n FROM page GROUP BY ALL),
fit AS (SELECT host, path, n, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv
        FROM uniq LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
l0 AS (SELECT host, path, n, CASE WHEN rule IS NULL THEN 0 ELSE n END AS lab, CASE WHEN rv = 'block' THEN n ELSE 0 END AS bad,
              CASE WHEN path = '' THEN [] ELSE string_split(path, '/')[2:] END AS segs, '' AS template FROM fit)"""
    for d in range(depth):
        seg = f"segs[{d + 1}]" if d < depth - 1 else f"CASE WHEN len(segs) > {depth} THEN '**' ELSE segs[{depth}] END"
        out += f""",
s{d} AS (SELECT *, {seg} AS seg FROM l{d}),
c{d} AS (SELECT host, template, seg, sum(n) AS cn, sum(lab) AS cl, sum(bad) AS cb FROM s{d} WHERE seg IS NOT NULL GROUP BY ALL),
p{d} AS (SELECT host, template, sum(cn) AS pn, sum(cl) AS pl, sum(cb) AS pb FROM c{d} GROUP BY ALL),
k{d} AS (SELECT host, template, seg, true AS lit FROM c{d} JOIN p{d} USING (host, template)
         WHERE cn >= {support} AND cn >= {share}::DOUBLE * pn AND cl > 0 AND pl > cl
           AND pow(cb / cl - (pb - cb) / (pl - cl), 2) > {z}::DOUBLE * {z}::DOUBLE * (pb / pl) * (1 - pb / pl) * (1 / cl + 1 / (pl - cl))),
l{d + 1} AS (SELECT host, path, n, lab, bad, segs, CASE WHEN seg IS NULL THEN template WHEN lit THEN template || '/' || seg
                    ELSE template || '/*' END AS template FROM s{d} LEFT JOIN k{d} USING (host, template, seg))"""
    return out + f""",
leaf AS (SELECT host, template, sum(lab) AS lab, sum(bad) AS bad FROM l{depth} GROUP BY ALL),
hosts AS (SELECT host, sum(lab) AS hl, sum(bad) AS hb FROM leaf GROUP BY ALL),
world AS (SELECT coalesce(sum(hb) / nullif(sum(hl), 0), 0.0) AS g FROM hosts),
pure AS (SELECT host, template, (bad + {weight}::DOUBLE * ((hb + {weight}::DOUBLE * g) / (hl + {weight}::DOUBLE))) / (lab + {weight}::DOUBLE) AS purity
         FROM leaf JOIN hosts USING (host), world)
SELECT page_id, host, path, rule, template, round(purity, 9) AS purity,
       coalesce(rv, CASE WHEN purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict
FROM page JOIN fit USING (host, path) JOIN l{depth} USING (host, path) JOIN pure USING (host, template)"""


@query("op4_url_filter", _op4_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (url_filter.judged(read(spark, sf_dir, "pages").select("page_id", "url"), RULES)
            .withColumn("purity", F.round("purity", 9)))


@query("op2_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), path, back=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = (toxicity.held_out_remainder(F.col("doc_id")) == 1).alias("held_out")
    return toxicity.scored(docs, model, keep=["doc_id"]).select(
        "doc_id", held, F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


@query("op3_lines")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicated(docs).select("doc_id", "lines_removed", "text")


@query("op7_near_vectors")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row_number() OVER () AS qn, * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT qn, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op9_top_k", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, every=50)


@query("op5_passages")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS f
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
                || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS mask,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
a(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
p AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM a p, a q, a r, a s, a t
      WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
o AS (SELECT part, filter_order, step, filter_order[step] AS letter,
             sum(n) FILTER (translate(mask, left(filter_order, step), '') = mask) AS kept,
             sum(n) FILTER (gone) AS removed, sum(n) FILTER (contains(mask, filter_order[step]) AND NOT gone) AS redundant,
             sum(n) FILTER (mask = filter_order[step]) AS unique_fails, sum(good) FILTER (gone) AS good_lost, sum(toxic) FILTER (gone) AS toxic_lost
      FROM (SELECT *, contains(mask, filter_order[step]) AND translate(mask, left(filter_order, step - 1), '') = mask AS gone
            FROM c, p, (SELECT unnest(range(1, 6))::INT AS step)) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM o
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(read(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                                     read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


@query("op11_digests")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=32, scale=64, shift=1_000_000)
