"""The registered queries of this package and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.llm.collocations import collocations
from declarium.llm.decontaminate import find_items
from declarium.llm.embedding_dedup import link_vectors
from declarium.llm.license_scan import scan
from declarium.llm.mixing import mixed
from declarium.llm.near_dedup import near_groups
from declarium.llm.packing import pack
from declarium.llm.periodic_runs import periodic_runs
from declarium.llm.quality import quality_scores
from declarium.llm.substring_dedup import remove_repeated
from declarium.llm.token_counts import context_limits, length_histogram
from declarium.llm.toxicity import toxicity_scores
from declarium.llm.training_order import materialise


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each embedding to others of its label, and its component."""
    return link_vectors(_read(spark, sf_dir, "embeddings"), 0.93)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of 10 words of the benchmark."""
    ids = F.array_sort(F.transform("hits.items", lambda i: i.cast("string")))
    return find_items(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), 10).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a smaller document has, removed from all documents."""
    return remove_repeated(_read(spark, sf_dir, "documents"), 13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources have tempered weights."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs, entropy=0.97, repetition=2.0).select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_tokens", "weight", "epochs", "copies")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and truncated totals for every context limit."""
    return context_limits(length_histogram(_read(spark, sf_dir, "documents")))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence lies in the shards, with a digest of its padded ids."""
    rows, _ = materialise(_read(spark, sf_dir, "documents"))
    return rows.select("slot", "shard", "doc_id", "seq_no", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of each document; its place is source, language and id, for want of paths."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = scan(docs.select("doc_id", "source", "lang", "text"), F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "path", "own_license", "own_score", "license", "inherited_from")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, _read(spark, sf_dir, "labels")).select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of each document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select(F.col("row.doc_id").alias("doc_id"), "class_id", "kept")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in sequences of 1,024 tokens."""
    import public_tokenizers

    pieces, _ = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def _with_blocks(docs: DataFrame) -> DataFrame:
    """The documents; every tenth, by a checksum of its id, goes on from some word in a block that repeats."""

    def repeated(number: int | None, text: str | None) -> str | None:
        h = zlib.crc32(str(number).encode())
        if number is None or h % 10 or not text or not text.encode().split():
            return text
        g, words = h // 10, text.encode().split()
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        block = words[a : a + p]
        return b" ".join(words[:a] + (block * -(-(n - a) // p))[: n - a]).decode()

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(map(repeated, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(through, "doc_id long, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document and what is left when their repeats go."""
    found = periodic_runs(_with_blocks(_read(spark, sf_dir, "documents")))
    first = F.element_at("runs", 1)
    # The greatest length / period, compared exactly; the runs are in order of start and period.
    rest = F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0)))
    most = F.when(F.size("runs") > 0, F.aggregate(rest, first, lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    best = found.select("row", "n_words", F.size("runs").cast("long").alias("n_runs"), most.alias("most"),
                        digest(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))).alias("runs_sha256"),
                        digest(F.col("kept")).alias("collapsed_sha256"))
    return best.select(
        F.col("row.doc_id").alias("doc_id"), "n_runs", F.col("most.start").alias("start"), F.col("most.length").alias("length"), F.col("most.period").alias("period"),
        F.expr("1000 * most.length div most.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language that stand together more often than their parts let expect."""
    return collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_quality": op1_quality,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_token_ids": op7_token_ids,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

#: Lower-case words of a text, as several of the operators read it.
_WORDS = (
    "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
)

ORACLE: dict[str, str] = {
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS g FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) >= 3),
f AS (SELECT lang, size, g, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, g, c AS a, string_split(g, ' ') AS p FROM f WHERE size >= 2 AND c >= 10),
cuts AS (
  SELECT lang, size, g, a, 1 AS k, p[1] AS x, array_to_string(p[2:], ' ') AS y FROM candidates
  UNION ALL SELECT lang, size, g, a, 2, p[1] || ' ' || p[2], p[3] FROM candidates WHERE size = 3),
scored AS (
  SELECT cuts.lang, cuts.size, cuts.g, a, k, l.c AS l, r.c AS r, ((1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = x JOIN f r ON r.lang = cuts.lang AND r.g = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, h, max(a) AS longest
  FROM (SELECT lang, a, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS h FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND h = g
  WHERE longest IS NULL OR 100 * longest < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
items AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
places AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.k, p.n, items.item_id FROM places p JOIN items ON p.g = items.g AND p.n = items.n),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(list_slice(w, k, k + 12), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT g, min(doc_id) AS lo FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM windows JOIN least_doc USING (g) WHERE lo < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT words.doc_id, count(*) FILTER (WHERE gone.i IS NOT NULL) AS n_removed,
    string_agg(x, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op10_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
sets AS (SELECT doc_id, g, count(*) AS n FROM grams GROUP BY doc_id, g),
idf AS (SELECT g, 1 + ln(1 / greatest(count(*) / (SELECT count(*) FROM documents), 0.1)) AS w FROM sets GROUP BY g),
weighed AS (SELECT doc_id, g, n, w FROM sets JOIN idf USING (g)),
totals AS (SELECT doc_id, sum(n * w) AS total FROM weighed GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n) * a.w) AS s FROM weighed a JOIN weighed b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN totals p ON p.doc_id = x JOIN totals q ON q.doc_id = y WHERE s >= 0.8 * (p.total + q.total - s) * (1 - 1e-12)),
beside AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN beside l ON r.other = l.x)
SELECT doc_id, min(other) AS class_id, min(other) = doc_id AS kept FROM reach GROUP BY doc_id
""",
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND list_sum([x * x FOR x IN e]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = c.vec_id
""",
}
