"""Registered queries of the corpus operators and, where SQL can express them,
their DuckDB text.  ``__spark_entry__`` adds both."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import pick, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLE_SQL[fn.__name__] = sql
    return fn


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def op7_line_dedup(spark, sf_dir):
    from .line_dedup import dedup_lines
    out = dedup_lines(pick(documents(spark, sf_dir), "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (h.key IS NOT NULL AND h.keep <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h.key IS NULL OR h.keep = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN hot h ON k.key = h.key
GROUP BY k.doc_id
"""
register(op7_line_dedup, OP7_SQL)


def op2_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeats
    out = remove_repeats(pick(documents(spark, sf_dir), "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


register(op2_suffix_dedup)


def op10_near_dedup(spark, sf_dir):
    from .near_dedup import near_duplicates
    return near_duplicates(pick(documents(spark, sf_dir), "doc_id", "text"))


register(op10_near_dedup)


def op1_quality_rules(spark, sf_dir):
    from .quality import score_quality
    return score_quality(pick(documents(spark, sf_dir), "doc_id", "text", "lang"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def quality_rules_loose(spark, sf_dir):
    """Operator 1 with looser risks, so that rules are certified from the few labels of a small table as well."""
    from .quality import score_quality
    return score_quality(pick(documents(spark, sf_dir), "doc_id", "text", "lang"), table(spark, sf_dir, "labels"), **LOOSE).select(
        "doc_id", "base_failed", "kept", "rejected_by")


LOOSE = {"alpha": 0.5, "delta": 0.2}


def _op1_sql(alpha: float, delta: float) -> str:
    from .quality import SIGNALS
    m = len(SIGNALS)
    a = alpha / m
    signals = ", ".join(f"CASE WHEN {den} > 0 THEN CAST(floor(1000 * {num} / {den}) AS BIGINT) ELSE 0 END AS {s}"
                        for s, (num, den, _) in SIGNALS.items())
    per_signal = "\nUNION ALL ".join(f"SELECT stratum, good, '{s}' AS signal, {s} AS v FROM labelled" for s in SIGNALS)
    grid = ", ".join(f"('{s}', {c})" for s, (_, _, g) in SIGNALS.items() for c in g)
    rejects = ", ".join(f"CASE WHEN {s} > (SELECT cutoff FROM cutoffs k WHERE k.stratum = j.stratum AND k.signal = '{s}') THEN '{s}' END"
                        for s in SIGNALS)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims,
         (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::BIGINT AS n_digits,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover c ON w.doc_id = c.doc_id),
counted AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {signals} FROM base),
one_label AS (
  SELECT doc_id, min(CASE WHEN quality > 0 THEN 1 ELSE 0 END) AS good FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
own AS (
  SELECT '=' || lang AS own FROM counted JOIN one_label USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL GROUP BY 1),
judged AS (SELECT counted.*, coalesce(own, 'other') AS stratum FROM counted LEFT JOIN own ON '=' || lang = own),
labelled AS (SELECT * FROM judged JOIN one_label USING (doc_id) WHERE NOT base_failed),
each AS ({per_signal}),
tested AS (
  SELECT stratum, e.signal, c AS cutoff, sum(good) AS n_good, sum(1 - good) AS n_bad,
         sum(CASE WHEN v > c THEN good ELSE 0 END) AS k_good, sum(CASE WHEN v > c THEN 1 - good ELSE 0 END) AS k_bad
  FROM each e JOIN (VALUES {grid}) g(signal, c) ON e.signal = g.signal GROUP BY ALL),
walked AS (
  SELECT *, bool_and(CASE WHEN n_good > 0 AND k_good <= {a!r} * n_good THEN list_sum(list_transform(range(0, k_good::BIGINT + 1), lambda i:
             exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({a!r}::DOUBLE) + (n_good - i) * ln(1 - {a!r}::DOUBLE))))
           ELSE 1 END <= {delta!r} / ((SELECT count(DISTINCT stratum) FROM labelled) * {m}))
           OVER (PARTITION BY stratum, signal ORDER BY cutoff DESC) AS ok,
         k_bad * n_good - k_good * n_bad AS gain
  FROM tested),
cutoffs AS (
  SELECT stratum, signal, cutoff FROM walked WHERE ok AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, signal ORDER BY gain DESC, cutoff DESC) = 1),
final AS (
  SELECT *, concat_ws(',', {rejects}) AS rejected_by FROM judged j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected_by = '' AS kept, rejected_by
FROM final
"""


def _register_op1():
    from .quality import ALPHA, DELTA
    register(op1_quality_rules, _op1_sql(ALPHA, DELTA))
    register(quality_rules_loose, f"SELECT doc_id, base_failed, kept, rejected_by FROM ({_op1_sql(**LOOSE)})")


_register_op1()


def op8_secret_scan(spark, sf_dir):
    from .secret_scan import joined, scan_secrets
    out = scan_secrets(pick(documents(spark, sf_dir), "doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                      joined(F.col("found")).alias("spans"))


register(op8_secret_scan)


def op6_language_id(spark, sf_dir):
    from .lang_id import held_out, identify
    out = identify(pick(documents(spark, sf_dir), "doc_id", "text", "lang"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


register(op6_language_id)


def op9_embedding_dedup(spark, sf_dir):
    from .embed_dedup import link_vectors
    return link_vectors(pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


register(op9_embedding_dedup)


def op5_source_mixing(spark, sf_dir):
    from .mixing import mix_sources
    return mix_sources(pick(documents(spark, sf_dir), "doc_id", "source"))


register(op5_source_mixing)


def op3_lm_scoring(spark, sf_dir):
    from .lm_score import score_documents
    return score_documents(pick(documents(spark, sf_dir), "doc_id", "text"), columns=["doc_id"]).select("doc_id", "n_tokens", "pll", "mean_pll")


register(op3_lm_scoring)


def op4_sentencepiece(spark, sf_dir):
    """Each sample as digests: its number of pieces and a hash of its ids."""
    from .sp_lattice import SAMPLES, sample_segmentations
    out = sample_segmentations(pick(documents(spark, sf_dir), "doc_id", "text"))
    # written out for each sample, as Spark compiles no function of an array's items
    each = [F.get("samples", F.lit(i)) for i in range(SAMPLES)]
    digest = F.slice(F.array(*[F.struct(
        F.size(s["ids"]).alias("pieces"), F.xxhash64(s["ids"]).alias("ids_hash"), s["logp"].alias("logp"),
        s["log_inclusion"].alias("log_inclusion")) for s in each]), 1, F.size("samples"))
    return out.select("doc_id", F.when(F.col("samples").isNotNull(), digest).alias("samples"), "exact")


register(op4_sentencepiece)


def op13_nearest_neighbours(spark, sf_dir):
    from .nn_search import nearest
    vectors = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
register(op13_nearest_neighbours, OP13_SQL)


def op12_conversation_repair(spark, sf_dir):
    from .conv_repair import damaged, repair_conversations, summary
    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return summary(turns, *repair_conversations(damaged(turns)))


register(op12_conversation_repair)


def op11_collocations(spark, sf_dir):
    from .collocations import collocations
    return collocations(pick(documents(spark, sf_dir), "text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, piece
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, list_slice(ws, i, i + k - 1) AS g
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, g, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (
  SELECT c.lang, c.k, c.g, c.n AS a, x.n AS l, y.n AS r, j,
         (1000000::HUGEINT * c.n * c.n // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.g = list_slice(c.g, 1, j)
  JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.g = list_slice(c.g, j + 1, c.k)),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
longer AS (
  SELECT lang, part, max(n) AS n FROM (
    SELECT lang, list_slice(g, 1, 2) AS part, n FROM f WHERE k = 3 UNION ALL SELECT lang, list_slice(g, 2, 3), n FROM f WHERE k = 3)
  GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank,
       array_to_string(g, ' ') AS phrase, a, l, r, t.n, score
FROM scored s JOIN totals t ON t.lang = s.lang LEFT JOIN longer o ON s.k = 2 AND o.lang = s.lang AND o.part = s.g
WHERE o.n IS NULL OR 100 * o.n < 50 * a
QUALIFY rank <= 2000
"""
register(op11_collocations, OP11_SQL)
