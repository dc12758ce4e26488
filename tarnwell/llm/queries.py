"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import Mining, collocations
from .decontaminate import Decontamination, benchmark_leaks
from .fingerprints import fingerprint_pairs
from .license_scan import license_notices
from .line_dedup import remove_repeated_lines
from .minhash_dedup import MinHash, near_duplicates
from .quality import quality
from .quality import train as train_quality
from .secret_scan import secrets
from .sentencepieces import encode_pieces
from .substring_dedup import Repeats, remove_repeats
from .token_files import tokens_round_trip
from .toxicity import toxicity, train
from .vector_codes import Coding, vector_codes, with_label_error


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, from the package that brings them; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words: doc_id, n_words, n_removed, kept_sha256."""
    out = remove_repeats(_table(spark, sf_dir, "documents"), Repeats(window=50))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with up to 20 % of their words edited: doc_id, item_id, edits, first_word, end_word."""
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Decontamination())


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(_table(spark, sf_dir, "documents"), MinHash(shingle=2))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three lines: doc_id, n_lines, n_removed, kept_sha256 (null for null texts)."""
    out = remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    out = secrets(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    return tokens_round_trip(_table(spark, sf_dir, "documents"), vocabulary or tokenizer_file("byte_bpe_50k.json"))


def op8_sentencepieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = encode_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), model or tokenizer_file("piece_bpe_32k.model"), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    out = fingerprint_pairs(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return license_notices(_table(spark, sf_dir, "documents")).drop("spans")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    found = vector_codes(_table(spark, sf_dir, "embeddings"), Coding())
    out = with_label_error(found.rows)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, feature."""
    docs = _table(spark, sf_dir, "documents")
    return quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return collocations(_table(spark, sf_dir, "documents"), Mining())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_files": op7_token_files,
    "op8_sentencepieces": op8_sentencepieces,
    "op9_fingerprints": op9_fingerprints,
    "op10_license_scan": op10_license_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality": op12_quality,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Codebooks and codes of op11, a round a pair of tables; squared distances are whole numbers below 2**53."""
    steps = [f"""WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, y, list_inner_product(y, y) AS yy
  FROM (SELECT vec_id, label, i AS part, x[i * (len(x) // {parts}) + 1:(i + 1) * (len(x) // {parts})] AS y FROM v, range({parts}) r(i))
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, y AS c FROM p QUALIFY e < {entries}
)"""]
    assign = "SELECT vec_id, label, p.part, any_value(y) AS y, min(CAST(yy - 2 * list_inner_product(y, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m FROM p JOIN b{0} b ON b.part = p.part GROUP BY 1, 2, 3"
    for k in range(rounds):
        steps.append(f""", a{k} AS MATERIALIZED ({assign.format(k)}), b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, e, list(f ORDER BY place) AS c FROM (
      SELECT part, m % 256 AS e, place, floor(sum(x) / count(*)) AS f FROM (SELECT part, m, unnest(y) AS x, unnest(range(len(y))) AS place FROM a{k}) GROUP BY 1, 2, 3
    ) GROUP BY 1, 2) n ON n.part = b.part AND n.e = b.e
)""")
    steps.append(f""", a AS MATERIALIZED ({assign.format(rounds)}), r AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a GROUP BY 1, 2
), s AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, place)) AS h FROM (SELECT part, e, unnest(c) AS x, unnest(range(len(c))) AS place FROM b{rounds})
) SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s.h AS codebooks_sha256 FROM r, s""")
    return "".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op13_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) r(k) WHERE len(ws) >= k)
  ) GROUP BY 1, 2, 3
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS first_, array_to_string(ws[j + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * cut.a // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first_ JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) r(m) WHERE m < k)),
kept AS (SELECT low.* FROM low LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY 1, 2) b USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
""",
    "op11_vector_codes": _codes_sql(),
    "op1_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], chr(32)) AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), least_ AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_ USING (t) WHERE d < doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, chr(32) ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN bad USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op3_minhash_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || chr(32) || ws[i + 1]) END) AS sh FROM w
), n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, link.b FROM reach JOIN link ON link.a = reach.r
), c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.d = n.doc_id
""",
    "op4_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
win AS (
  SELECT doc_id, i, ls[i:i + 2] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)
  WHERE trim(ls[i] || ls[i + 1] || ls[i + 2], ' ') <> ''
), ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM win),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM ranked WHERE k > 1),
pos AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM l),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN bad USING (doc_id, p) GROUP BY 1)
SELECT l.doc_id, coalesce(len(l.ls), 0) AS n_lines, coalesce(len(l.ls), 0) - coalesce(kept.n, 0) AS n_removed,
  CASE WHEN l.text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)
""",
}
