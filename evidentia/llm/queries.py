"""Queries of this subpackage, by name, and SQL that gives the same rows where SQL can express them.

Without SQL, for what it can't express: op1 (components of an exact join are too slow in SQL on whole tables), op2 (which documents share a sequence is
the method's choice), op3 and op7 (regular expressions with places), op5 (a fitted model), op9 (merging), op10 (a media format). Tests hold those
against brute force, the tokenizers library, exact round trips or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: (doc_id, n_shingles, component_id)."""
    from .ngram_join import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    import public_tokenizers

    from .packing import pack_documents

    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _digest(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: each distinct text is a blob, scanned into an empty ledger and joined back to all documents."""
    from .secrets import BASE, findings_by_path, scan_unseen

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings_by_path(docs, scan_unseen(docs))
    base = [r.kind for r in BASE]
    found = found.withColumn("base", F.filter("findings", lambda f: f["kind"].isin(base)))
    return found.select("doc_id", *[_count("base", k) for k in base], F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("findings").alias("spans"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page. A page's last path number is the document whose labels are its outcome: bad if of low quality or toxic."""
    from .url_filter import judge

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    shown = pages.select("page_id", F.regexp_extract("url", r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1).alias("doc")).filter("doc != ''")
    return judge(pages, shown.withColumn("doc", F.col("doc").cast("long")).join(labels, "doc").select("page_id", "bad"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels of two thirds of them."""
    from .quality_classifier import fit_on, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    model = fit_on(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    from .quality_rules import judge

    judged = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from .pii import KINDS, find_personal_data

    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    whole = found.withColumn("all", F.concat("spans", F.transform("more", lambda m: F.struct(F.concat(m["kind"], F.lit("_context")).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))))
    return whole.select("doc_id", *[_count("spans", k) for k in KINDS], F.sha2(_digest("spans"), 256).alias("base_sha256"), _digest("all").alias("spans"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one that imitates control strings, read back from its formatted text and its segments."""
    from .chat import format_conversations, read_back, unescape

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_conversations(rows.unionByName(odd))
    back = made.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text that they decode to."""
    import public_tokenizers

    from .bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = decode(encode(_table(spark, sf_dir, "documents"), path), path)
    return found.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a medium: stored once per digest, referred to twice before the page of its number, where there is one, and resolved through that
    page's sequence of texts and media; with the number of the page's items and the medium's caption there."""
    from .common import materialise
    from .media import interleave, store

    stored = materialise(store(_table(spark, sf_dir, "documents"), ["doc_id"]))
    page = _table(spark, sf_dir, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.min("html").alias("page"))
    shown = F.concat(F.lit('<article><p>Document</p><figure><img alt="A text" src="sha256:'), F.col("digest"), F.lit('"><figcaption>Its text as a picture</figcaption></figure><p>and again <img alt="a text" src="sha256:'), F.col("digest"), F.lit('"></article>'))
    rows = stored.select("doc_id", "n_bytes", "digest").join(page, "doc_id", "left").select("doc_id", "n_bytes", "digest", F.concat(shown, F.coalesce("page", F.lit(""))).alias("html"))
    whole = interleave(rows, stored.select("digest", "media"))
    medium = F.get(F.filter("items", lambda i: i["digest"] == F.col("digest")), F.lit(0))
    found = whole.select("doc_id", "n_bytes", medium.alias("m"), F.size("items").alias("n_items"))
    return found.select("doc_id", "n_bytes", "m.payload_bytes", "m.payload_sha256", "m.tail_crc32", "m.media_bytes", "m.media_sha256", "m.feature", "n_items", "m.caption")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_best_fit_packing,
        op3_secret_scan,
        op4_url_filter,
        op5_quality_classifier,
        op6_quality_rules,
        op7_pii,
        op8_chat_format,
        op9_bpe,
        op10_media_columns,
    )
}

_URL_SQL = r"""
WITH cut AS (
  SELECT page_id, url,
    translate(CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
bad AS (
  SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM cut JOIN labels ON doc_id = TRY_CAST(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{1,18})', 1) AS BIGINT) GROUP BY page_id),
sites AS (SELECT page_id, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS host FROM cut),
labels_of AS (
  SELECT *, string_split(host, '.') AS p, regexp_matches(host, '^[0-9.]+$') AS numbers, array_to_string(string_split(host, '.')[-2:], '.') IN
    ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'ne.jp', 'com.br', 'com.cn', 'co.in', 'co.za') AS two
  FROM (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM sites LEFT JOIN bad USING (page_id) GROUP BY host)),
hosts AS (
  SELECT host, n, k, CASE WHEN numbers THEN host WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
    CASE WHEN numbers THEN host WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
  FROM labels_of),
known AS (SELECT * FROM hosts WHERE n > 0),
total AS (SELECT sum(k) / sum(n)::DOUBLE AS mean FROM known),
l0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, (SELECT mean FROM total) AS p FROM known GROUP BY suffix),
l1 AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(sum(k)) OVER (PARTITION BY suffix) / sum(sum(n)) OVER (PARTITION BY suffix) AS p FROM known GROUP BY domain, suffix),
l2 AS (SELECT host, n::DOUBLE AS n, k::DOUBLE AS k, sum(k) OVER (PARTITION BY domain) / sum(n) OVER (PARTITION BY domain) AS p FROM known),
moments AS (
  SELECT level, sum(n * pow(k / n - p, 2)) AS s, sum(p * (1 - p)) AS v1, sum(n * p * (1 - p)) AS vn
  FROM (SELECT 0 AS level, n, k, p FROM l0 UNION ALL SELECT 1, n, k, p FROM l1 UNION ALL SELECT 2, n, k, p FROM l2) GROUP BY level),
strength AS (
  SELECT level, CASE WHEN vn - v1 <= 0 THEN 10.0 WHEN s <= v1 THEN 1000.0 ELSE least(1000.0, greatest(1.0, (vn - v1) / (s - v1) - 1)) END AS c FROM moments),
mu AS (SELECT coalesce((SELECT mean FROM total), 0.0) AS m, coalesce((SELECT c FROM strength WHERE level = 0), 10.0) AS c0, coalesce((SELECT c FROM strength WHERE level = 1), 10.0) AS c1, coalesce((SELECT c FROM strength WHERE level = 2), 10.0) AS c2),
of_suffix AS (SELECT suffix, (sum(k) + any_value(c0) * any_value(m)) / (sum(n) + any_value(c0)) AS ps FROM hosts, mu GROUP BY suffix),
of_domain AS (SELECT domain, (sum(k) + any_value(c1) * any_value(ps)) / (sum(n) + any_value(c1)) AS pd FROM hosts JOIN of_suffix USING (suffix), mu GROUP BY domain),
post AS (SELECT host, k + c2 * pd AS a, n - k + c2 * (1 - pd) AS b FROM hosts JOIN of_domain USING (domain), mu),
series AS (
  SELECT host, sum(exp(lgamma(a + b + i) - lgamma(a + b) + lgamma(a + 1) - lgamma(a + 1 + i) + i * ln(0.5))) AS s
  FROM post, range(0, 20000) AS t(i) WHERE a > 0 AND b > 0 GROUP BY host),
bound AS (
  SELECT host, CASE WHEN a <= 0 THEN 1.0 WHEN b <= 0 THEN 0.0 ELSE exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a + b) * ln(0.5)) / a * s END AS below
  FROM post LEFT JOIN series USING (host)),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT host AS fh, path AS fp, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM cut), rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN below < 0.05 THEN 'block' ELSE 'allow' END) AS verdict
FROM cut JOIN (SELECT DISTINCT host AS url_host, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS site FROM cut) ON url_host = host JOIN (SELECT host AS site, below FROM bound) USING (site) LEFT JOIN fit ON fh = host AND fp = path
"""

_RULES_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
s AS (
  SELECT t.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_own_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
v AS (
  SELECT *, n_lines - n_own_lines AS n_dup_lines, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbols, coalesce((n_lines - n_own_lines) * 1000 // nullif(n_lines, 0), 0) AS duplicate_lines,
    coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeats, coalesce(word_chars * 1000 // nullif(n_words, 0), 0) AS word_length
  FROM s),
known AS (SELECT doc_id, max(quality) AS label FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
lv AS (SELECT * FROM v JOIN known USING (doc_id)),
long AS (
  SELECT stratum, label, 'symbols' AS rule, symbols AS x, unnest([5, 10, 20, 30, 50, 80, 120, 200, 300, 500]) AS cutoff FROM lv
  UNION ALL SELECT stratum, label, 'duplicate_lines', duplicate_lines, unnest([50, 100, 150, 200, 300, 400, 500, 600, 700, 800]) FROM lv
  UNION ALL SELECT stratum, label, 'repeats', repeats, unnest([50, 100, 150, 200, 250, 300, 350, 400, 450, 500]) FROM lv
  UNION ALL SELECT stratum, label, 'word_length', word_length, unnest([6000, 7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000, 50000]) FROM lv),
counts AS (
  SELECT stratum, rule, cutoff, sum(label) AS n, sum(CASE WHEN label = 1 AND x > cutoff THEN 1 ELSE 0 END) AS k, sum(CASE WHEN label = 0 AND x > cutoff THEN 1 ELSE 0 END) AS bad
  FROM long GROUP BY stratum, rule, cutoff),
terms AS (SELECT stratum, rule, cutoff, n, k, bad, unnest(range(0, k::BIGINT + 1)) AS i FROM counts WHERE n > 0 AND bad > k AND k < n * 0.005),
tails AS (
  SELECT stratum, rule, cutoff, sum(exp(lgamma((n + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma((n - i + 1)::DOUBLE) + i * ln(0.005) + (n - i) * ln(0.995))) AS p
  FROM terms GROUP BY stratum, rule, cutoff),
certified AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE p <= 0.05 / ((SELECT count(DISTINCT stratum) FROM lv) * 40) GROUP BY stratum, rule),
lim AS (
  SELECT stratum, min(CASE WHEN rule = 'symbols' THEN cutoff END) AS c1, min(CASE WHEN rule = 'duplicate_lines' THEN cutoff END) AS c2,
    min(CASE WHEN rule = 'repeats' THEN cutoff END) AS c3, min(CASE WHEN rule = 'word_length' THEN cutoff END) AS c4
  FROM certified GROUP BY stratum)
"""
_RULES_ROWS = r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(symbols <= c1, true) AND coalesce(duplicate_lines <= c2, true) AND coalesce(repeats <= c3, true) AND coalesce(word_length <= c4, true) AS kept
FROM v LEFT JOIN lim USING (stratum)
"""

_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\k')) AS n, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\k')) AS r FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + r END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op4_url_filter": _URL_SQL, "op6_quality_rules": _RULES_SQL + _RULES_ROWS, "op8_chat_format": _CHAT_SQL}
