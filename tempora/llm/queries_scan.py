"""op11 secret scan, op12 vector codes, op13 resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import resample, secret_scan, vector_codes
from tempora.llm.common import fingerprint, read


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner; its different texts are its repositories."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    found = secret_scan.scan(docs, ["doc_id"], F.col("source"), fingerprint(F.col("text")))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda name, value: F.size(F.filter("spans", lambda s: s[name] == value)).cast("long")
    return found.select(
        "row.doc_id",
        *[count("kind", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
        *[count("verdict", verdict).alias(f"n_{verdict}") for verdict in ("owned", "copied", "dull")],
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.encode(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), ["vec_id", "label"])
    rows = vector_codes.with_group_error(coded.rows, F.col("row.label"), "label_error")
    return rows.select("row.vec_id", "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    drawn = resample.resample(docs, read(spark, sf_dir, "benchmark", "text"), ["doc_id"])
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain integer k-means: every distance in every round."""
    steps = [
        f"""kept AS (SELECT vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c AS MATERIALIZED (SELECT vec_id, (i * {parts}) // n AS part, i % (n // {parts}) AS pos, floor(4096.0::DOUBLE * x)::BIGINT AS v
            FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM kept))""",
        f"""b0 AS MATERIALIZED (SELECT part, entry, pos, v FROM c
            JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}) USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM
            (SELECT c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM c JOIN b{r} b USING (part, pos) GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.v, b.v)::BIGINT AS v FROM b{r} b LEFT JOIN
                (SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS v
                 FROM (SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM a{r} JOIN c USING (vec_id, part) GROUP BY ALL)) m
                USING (part, entry, pos))"""
            )
    steps.append(
        f"""coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM a{rounds} GROUP BY vec_id)"""
    )
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,"
        f" (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256"
        " FROM coded JOIN kept USING (vec_id)"
    )


#: crc32 of UTF-8 bytes, word by word and pair by pair, over the different features alone.
_RESAMPLE_SQL = r"""
WITH crcs AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
texts AS MATERIALIZED (SELECT 0 AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
cut AS (SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, r, unnest(w) AS g FROM cut
  UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut),
counted AS MATERIALIZED (SELECT side, r, g, count(*) AS n FROM grams GROUP BY ALL),
named AS MATERIALIZED (SELECT g, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(encode(g))), 2), lambda i: ('0x' || substr(hex(encode(g)), i + 1, 2))::BIGINT)),
    lambda a, x: xor(a // 256, tab[(xor(a % 256, x) + 1)::BIGINT])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM counted), crcs),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t FROM counted JOIN named USING (g) GROUP BY 1),
sums AS (SELECT sum(s)::BIGINT AS ss, sum(t)::BIGINT AS tt FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS gain FROM buckets, sums),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
  FROM counted JOIN named USING (g) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM cut LEFT JOIN weights USING (r) WHERE side = 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, sum(able::INT) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM ordered
"""

PLANS = {f.__name__: f for f in (op11_secrets, op12_vector_codes, op13_resample)}
CHECKS: dict[str, str] = {"op12_vector_codes": _codes_sql(), "op13_resample": _RESAMPLE_SQL}
