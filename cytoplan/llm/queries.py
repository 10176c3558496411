"""The registered queries of this subpackage and the SQL that DuckDB can compare them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter as urls
from .byte_bpe import decode, encode, read_ranks
from .centroids import CLUSTERS, COMPONENTS, SCALE, SEED, cluster_vectors
from .centroids import ROUNDS as LLOYD_ROUNDS
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .lexical import TOP, ranked_search
from .line_dedup import MIN_WORDS, line_dedup
from .lm_scoring import score
from .near_dedup import near_duplicates
from .quality import classify_quality
from .sharding import PRIME, ROUNDS, feistel_shards, round_keys
from .simhash import simhash_components
from .toxicity import classify_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(_table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


def vocabulary() -> tuple[dict[bytes, int], str]:
    """The public vocabulary's ranks and pattern; the file stays where it is installed."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    out = decode(encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text"), ranks)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.array_max("hits.coverage").alias("coverage"),
        F.size("hits").alias("n_items"),
        F.array_join(F.col("hits.item_id").cast("array<string>"), ",").alias("item_ids"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(_table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_exact_dedup,
        op3_url_filter,
        op4_near_duplicates,
        op5_feistel_shards,
        op6_lm_scoring,
        op7_byte_bpe,
        op8_decontaminate,
        op9_quality,
        op10_toxicity,
        op11_centroid_clusters,
        op12_ranked_search,
        op13_simhash,
    )
}

_LINE_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS raw FROM parts),
t AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
h AS (SELECT doc_id, pos, md5(line) AS h, length(line) - length(replace(line, ' ', '')) + 1 AS w FROM t WHERE line <> ''),
a AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS ends FROM h),
b AS (SELECT *, ends - w AS begins FROM a),
f AS (SELECT *, max(ends) OVER (PARTITION BY doc_id) AS total,
  list(h) OVER ahead AS on_key, max(pos) OVER ahead AS on_last, list(h) OVER behind AS back_key, min(pos) OVER behind AS back_first, min(begins) OVER behind AS back_begins
  FROM b WINDOW ahead AS (PARTITION BY doc_id ORDER BY begins RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING),
    behind AS (PARTITION BY doc_id ORDER BY ends RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
runs AS (SELECT doc_id, pos AS x, on_last AS y, on_key AS k FROM f WHERE total - begins >= {MIN_WORDS}
  UNION ALL SELECT doc_id, back_first, pos, back_key FROM f WHERE begins - back_begins >= {MIN_WORDS}),
later AS (SELECT doc_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, x) AS times FROM runs) WHERE times > 1),
gone AS (SELECT DISTINCT r.doc_id, t.pos FROM (SELECT doc_id, unnest(range(x, y + 1)) AS pos FROM later) r JOIN t ON t.doc_id = r.doc_id AND t.pos = r.pos WHERE t.line <> ''),
kept AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.pos) AS left_text, count(*) AS n FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(parts.lines) END AS BIGINT) AS n_lines,
  CAST(len(parts.lines) - coalesce(kept.n, 0) AS BIGINT) AS n_deleted, sha256(coalesce(kept.left_text, '')) AS text_sha256
FROM documents d JOIN parts ON parts.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT_SQL = f"""
WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def _feistel_sql(shards: int = 24, seed: int = 20240229, walks: int = 8) -> str:
    """The permutation written out round by round; crc32 by its bitwise definition."""
    names = iter(range(10_000))
    last, out = "s", []
    for walk in range(walks):
        for i, (p, q, r) in enumerate(round_keys(seed)):
            name = f"s{next(names)}"
            v = "r" if i % 2 == 0 else "l"
            t = f"((((({v} + {p}) % {PRIME}) * {q} + {r}) % {PRIME}))"
            t = f"(({t} * {t} + {p}) % {PRIME})"
            done = "done" if i or not walk else "(done OR l * b + r < n)"
            move = f"(l + {t}) % a AS l, r" if i % 2 == 0 else f"l, (r + {t}) % b AS r"
            keep_or = (f"CASE WHEN {done} THEN l ELSE (l + {t}) % a END AS l, r" if i % 2 == 0 else f"l, CASE WHEN {done} THEN r ELSE (r + {t}) % b END AS r") if walk else move
            out.append(f"{name} AS (SELECT doc_id, size, text_crc32, n, a, b, {keep_or}, {done} AS done FROM {last})")
            last = name
    assert ROUNDS == len(round_keys(seed))
    return f"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
bytes AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17)::BIGINT) AS v FROM documents),
base AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
  xor(list_reduce([4294967295::BIGINT] || v, lambda c, x: xor(c >> 8, tab.tab[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM bytes, tab),
num AS (SELECT *, row_number() OVER (ORDER BY md5(concat(doc_id, ':', size, ':', text_crc32)), doc_id, size, text_crc32) - 1 AS x, count(*) OVER () AS n FROM base),
g1 AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM num),
g2 AS (SELECT *, CAST((n + a - 1) // a AS BIGINT) AS b FROM g1),
s AS (SELECT doc_id, size, text_crc32, n, a, b, x // b AS l, x % b AS r, false AS done FROM g2),
{", ".join(out)}
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST((l * b + r) % {shards} AS INTEGER) AS shard, CAST((l * b + r) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM {last}
"""


def _url_sql() -> str:
    """The vocabulary as one regular expression for a term."""

    def seen(term: str) -> str:
        return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INTEGER)"

    cases, says = [], []
    for text, verdict in sorted(urls.RULES, key=lambda r: -len(r[0])):
        name, _, rest = text.partition("/")
        fits = f"(host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{rest}')"
        cases.append(f"WHEN {fits} THEN '{text}'")
        says.append(f"WHEN {fits} THEN '{verdict}'")
    fold = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH r AS (SELECT page_id, translate(coalesce(url, ''), {fold}) AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), {fold}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT page_id, host, path, {" + ".join(map(seen, urls.STRICT))} AS strict_terms, {" + ".join(map(seen, urls.SOFT))} AS soft_terms FROM p)
SELECT page_id, host, path, CASE {" ".join(cases)} END AS rule,
  CASE {" ".join(says)} WHEN strict_terms >= 1 OR soft_terms >= {urls.SOFT_NEEDED} THEN 'block' ELSE 'allow' END AS verdict, strict_terms, soft_terms FROM v
"""


def _lloyd_sql() -> str:
    """Each round as two tables: the nearest centroid of every vector, and the floors of the means."""
    n = COMPONENTS
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS k, q FROM kept ORDER BY k LIMIT {CLUSTERS})",
    ]
    for i in range(LLOYD_ROUNDS + 1):
        apart = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT row, vec_id, any_value(v.q) AS q, min([{apart}, c.k]) AS near FROM kept v, c{i} c GROUP BY row, vec_id)")
        if i < LLOYD_ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, list(m ORDER BY j) AS q FROM (SELECT k, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
  FROM (SELECT near[2] AS k, j, sum(q[j]) AS s, count(*) AS n FROM a{i}, range(1, {n + 1}) t(j) GROUP BY 1, 2)) GROUP BY k
  UNION ALL SELECT k, q FROM c{i} WHERE k NOT IN (SELECT near[2] FROM a{i}))""")
    last = f"a{LLOYD_ROUNDS}"
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(near[2] AS INTEGER) AS cluster, near[1] AS distance, CAST(sum(near[1]) OVER (PARTITION BY near[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(near[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM {last} JOIN c{LLOYD_ROUNDS} c ON c.k = near[2]
"""


_TERMS = f"regexp_extract_all({_NORM}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS l FROM d),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
held AS (SELECT row, doc_id, size, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS size, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total),
score AS (SELECT item, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size * n) // l)))) AS BIGINT) AS score
  FROM held JOIN asked USING (term) JOIN weight USING (term), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0) WHERE rank <= {TOP}
"""


ORACLE_SQL = {
    "op1_line_dedup": _LINE_SQL,
    "op2_exact_dedup": _EXACT_SQL,
    "op3_url_filter": _url_sql(),
    "op5_feistel_shards": _feistel_sql(),
    "op11_centroid_clusters": _lloyd_sql(),
    "op12_ranked_search": _RANKED_SQL,
}
