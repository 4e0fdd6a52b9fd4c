"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from silkmill.llm.bpe import encode_decode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.langid import fit_packed, held_out, identify

    docs = _table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit_packed(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).taken()


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.pii import personal_data

    out = personal_data(_table(spark, sf_dir, "documents"), real=True)
    return out.select(*[c for c in out.columns if c != "sanitised"], F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.bit_sliced import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.lm_scoring import score_texts

    out = score_texts(_table(spark, sf_dir, "documents"))
    return out.withColumn("base_score", F.round("base_score", 9))  # sums in another order differ in the last digits


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silkmill.llm.fill_middle import fill_middle, restored

    out = fill_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Brute force over all pairs of a query and another row.
TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM t WHERE rank <= 10
"""


WORDS = r"[^\x20\x09-\x0D]+"


def quality_sql() -> str:
    """Base columns by lists of words and lines; the fixed sequence of binomial tests by logarithms of factorials."""
    from silkmill.llm import quality as q

    steps = ", ".join(
        f"CASE WHEN len(list_filter({list(cuts)}, lambda c: c >= f{n})) < {len(cuts)} THEN len(list_filter({list(cuts)}, lambda c: c >= f{n})) * {len(q.RULES)} + {n} END"
        for n, (_, cuts) in enumerate(q.RULES.values())
    )
    features = ", ".join(f"coalesce(CAST({x.split(' / ')[0]} AS DOUBLE) / nullif({x.split(' / ')[1]}, 0), 0.0) AS f{n}" for n, (x, _) in enumerate(q.RULES.values()))
    failed = ", ".join(f"CASE WHEN s[{n + 1}] <= last THEN '{r}' END" for n, r in enumerate(q.RULES))
    last, p = len(q.RULES) * max(len(c) for _, c in q.RULES.values()), q.MAX_FALSE_REJECTION
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM w),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY r),
base AS (SELECT w.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)),
stats AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
f AS (SELECT *, {features} FROM stats),
s AS (SELECT *, [{steps}] AS s FROM f),
good AS (SELECT lang, list_min(list_filter(s, lambda x: x IS NOT NULL)) AS step FROM s
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
n AS (SELECT lang, count(*) AS n, (SELECT count(DISTINCT coalesce(lang, '?')) FROM good) AS strata FROM good GROUP BY lang),
k AS (SELECT n.lang, n.n, strata, j, (SELECT count(*) FROM good g WHERE g.lang IS NOT DISTINCT FROM n.lang AND g.step <= j) AS k FROM n, (SELECT unnest(range({last})) AS j)),
tail AS (SELECT *, CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i:
  exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({p}) + (n - i) * ln(1 - {p})))) END AS tail FROM k),
limits AS (SELECT lang, max(j) AS last FROM tail WHERE tail <= {q.ERROR_LEVEL} / strata GROUP BY lang),
v AS (SELECT s.*, [{failed}] AS failed FROM s LEFT JOIN limits ON s.lang IS NOT DISTINCT FROM limits.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(list_filter(failed, lambda x: x IS NOT NULL)) = 0 AS kept, coalesce(array_to_string(failed, ','), '') AS failed_rules FROM v
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's ASCII bytes."""
    step = "CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: {step})"
    every = f"list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)))"
    return f"xor(list_reduce({every}, lambda c, b: {byte}), 4294967295)"


def score_sql() -> str:
    """The bigram model by joins of counts; a blank begins the marks of start and end."""
    from silkmill.llm import lm_model as m

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 10 = 0, false) AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}'), ' e') AS w FROM documents),
t AS (SELECT r, held_out, unnest(w) AS w, unnest(list_prepend(' s', w[1:len(w) - 1])) AS v FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
b AS (SELECT v, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY v, w),
x AS (SELECT v, sum(n) AS n FROM b GROUP BY v),
a AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
p AS (SELECT t.r, coalesce(c.c, 0) AS c, (coalesce(c.c, 0) + {m.SMOOTH}::DOUBLE) / (a.n + {m.SMOOTH}::DOUBLE * (a.v + 1)) AS p, coalesce(b.n, 0) AS n, coalesce(x.n, 0)::BIGINT AS x
  FROM t CROSS JOIN a LEFT JOIN c USING (w) LEFT JOIN b ON b.v = t.v AND b.w = t.w LEFT JOIN x ON x.v = t.v),
s AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, round(sum(log10(p)), 9) AS base_score,
  sum(CASE WHEN x = 0 THEN log10(p) ELSE -round(log10((n + {m.MU} * p) / (x + {m.MU})) * -{m.STEPS}) / {m.STEPS}.0::DOUBLE END) AS score FROM p GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, a.n AS train_tokens, base_score, score FROM s JOIN d USING (r) CROSS JOIN a
"""


def personal_data_sql() -> str:
    """Spans by what lies between the matches, terms by joins of counts, the sanitised text by pieces."""
    from silkmill.llm import pii as m

    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "term": r"[\p{L}\p{N}]+", "secret": "[A-Za-z0-9]+",
    }
    names = ", ".join(f"'{k}'" for k in kinds)
    found = " UNION ALL ".join(
        f"SELECT r, t, {n} AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for n, p in enumerate(kinds.values())
    )
    luhn = "list_sum(list_transform(range(length(c)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(c[length(c) - i] AS INT) ELSE (CAST(c[length(c) - i] AS INT) * 2 - 1) % 9 + 1 END)) % 10 = 0"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT r, t, kind, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS k FROM ({found}) WHERE len(m) > 0),
p AS (SELECT r, t, kind, m, k, regexp_replace(m, '[^0-9]', '', 'g') AS c, sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY k)::BIGINT AS z FROM f),
s AS (SELECT r, t, kind, m, c, k, z - length(m) AS a, z FROM p),
base AS (SELECT * FROM s WHERE kind = 0 OR kind = 1 AND list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255
  OR kind = 2 AND length(c) BETWEEN 14 AND 19 AND {luhn} OR kind = 3 AND length(c) BETWEEN 10 AND 15),
secret AS (SELECT * FROM s WHERE kind = 5 AND length(m) >= 20 AND len(regexp_extract_all(m, '[A-Za-z][0-9]|[0-9][A-Za-z]')) >= {m.SECRET_TURNS}
  AND NOT EXISTS (FROM base b WHERE b.r = s.r AND b.a < s.z AND s.a < b.z)),
sure AS (FROM base UNION ALL FROM secret),
entity AS (SELECT DISTINCT t, CASE WHEN kind >= 2 THEN c ELSE lower(m) END AS e FROM base),
w AS (SELECT r, t, k, lower(m) AS w, coalesce(lower(lag(m) OVER o), '') || ' ' || coalesce(lower(lead(m) OVER o), '') AS x FROM s WHERE kind = 4 WINDOW o AS (PARTITION BY r ORDER BY k)),
n AS (SELECT w, count(*) AS n FROM w GROUP BY w),
met AS (SELECT * FROM w WHERE r IN (SELECT r FROM base)),
pairs AS (SELECT e, w, count(DISTINCT x) AS contexts, count(*) AS n_both FROM met JOIN entity USING (t) WHERE NOT contains(e, w) GROUP BY e, w),
known AS (SELECT DISTINCT w FROM pairs JOIN n USING (w) JOIN (SELECT e, count(*) AS n_e FROM entity GROUP BY e) USING (e)
  WHERE contexts >= {m.MIN_CONTEXTS} AND n_both >= {m.MIN_SHARE} * n AND log2(n_both / n::DOUBLE * greatest((SELECT count(*) FROM d), 1) / n_e) >= {m.MIN_BITS}),
term AS (SELECT * FROM s WHERE kind = 4 AND lower(m) IN (FROM known) AND NOT EXISTS (FROM sure b WHERE b.r = s.r AND b.a < s.z AND s.a < b.z)),
every AS (FROM sure UNION ALL FROM term),
names AS (SELECT *, [{names}][kind + 1] AS name, coalesce(max(z) OVER (PARTITION BY r ORDER BY a, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM every),
out AS (SELECT r, string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) AS spans, string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (kind < 4) AS base,
  string_agg(CASE WHEN a >= before THEN t[before + 1:a] || '[' || upper(name) || ']' ELSE '' END, '' ORDER BY a, kind) AS pieces, max(z) AS z,
  {", ".join(f"count(*) FILTER (kind = {k}) AS n_{x}" for k, x in enumerate(kinds))} FROM names GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  sha256(coalesce(pieces, '') || t[coalesce(z, 0) + 1:]) AS sanitised_sha256 FROM d LEFT JOIN out USING (r)
"""


#: Every string of 100 bytes by itself: which ones also start earlier, and what they cover.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n FROM d),
s AS (SELECT r, doc_id, i, array_slice(b, i + 1, i + 100) AS s FROM (SELECT *, unnest(range(n - 99)) AS i FROM n WHERE n >= 100)),
t AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, i) AS k FROM s) WHERE k > 1),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM t)),
spans AS (SELECT r, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY r, g),
cut AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM spans GROUP BY r),
p AS (SELECT r, unnest(list_prepend(0, z)) AS begin, unnest(list_append(a, NULL)) AS stop, unnest(range(len(a) + 1)) AS k FROM cut),
kept AS (SELECT p.r, string_agg(hex(array_slice(b, begin + 1, coalesce(stop, n))), '' ORDER BY k) AS h FROM p JOIN n USING (r) WHERE begin < coalesce(stop, n) GROUP BY p.r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256 FROM n LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""


#: Every document with the letters of the filters that it fails, counted by part and letters, then for each order and step.
AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORDS}') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, doc_id, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
  CASE WHEN first IS NOT NULL AND coalesce(first < doc_id, true) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, string_split(fails, '') AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, f.fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, s, o[s] AS own, string_split(o[1:s - 1], '') AS earlier FROM o, (SELECT unnest(range(1, 6)) AS s)),
c AS (SELECT *, list_contains(fails, own) AS now, list_has_any(fails, list_filter(earlier, lambda y: y <> '')) AS gone FROM m, s),
r AS (SELECT part, o, s, own, sum(CASE WHEN now OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN now AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN now AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN now AND len(fails) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN now AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN now AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM c GROUP BY part, o, s, own)
SELECT part, o AS filter_order, CAST(s AS INT) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""


#: All pairs, and what each vector reaches step by step.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
fit AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM fit a JOIN fit b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(r, s) AS (SELECT r, r FROM v UNION SELECT reach.r, b FROM reach JOIN links ON s = a),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = s GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""


#: Lines by pattern, cuts by slices of their list.
FILL_MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^
]*
|[^
]+') AS l, list_transform(range(4), lambda k: CAST('0x' || h[1 + 8 * k:8 + 8 * k] AS BIGINT)) AS g FROM d),
n AS (SELECT *, len(l) AS n, g[1] % (len(l) + 1) AS x, g[2] % (len(l) + 1) AS y, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR g[3] % 100 >= 100 THEN 'plain'
  WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(l[1:least(x, y)], '') AS prefix, array_to_string(l[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(l[greatest(x, y) + 1:], '') AS suffix FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""
    return {"op4_topk": TOPK_SQL, "op5_lm_scoring": score_sql(), "op6_quality": quality_sql(), "op7_pii": personal_data_sql(), "op9_suffix_dedup": REPEATS_SQL,
            "op11_filter_audit": AUDIT_SQL, "op12_embedding_dedup": NEAR_VECTORS_SQL, "op13_fill_middle": FILL_MIDDLE_SQL}
