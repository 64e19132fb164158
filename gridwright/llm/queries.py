"""Queries of this subpackage over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bytepairs, lines, manifest, overlap, packing, passages, quality, rollups, shards, spans, spelling, toxicity, warc
from .frames import bounded, fresh_folder, stored

#: Folder of the public tokenizers and the split pattern of the byte-level ones.
TOKENIZER_FILE = "byte_bpe_50k.json"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


WORDS = r"list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS pat, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM p),
pos AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS pat
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
),
hit AS (SELECT doc_id, s, pos.n, item_id FROM pos JOIN p USING (pat, n)),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(OP1_SQL)
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.lookup_passages(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"),
        row_id="doc_id", column="text", lookup_id="item_id", lookup_column="text", window=10,
    )
    return found.select(
        F.col("row_id").alias("doc_id"), "n_words", "n_hit", F.size("lookup_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("lookup_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_cells(docs, public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN, row_id="doc_id", column="text", added_tokens=True)
    return pieces.select(
        F.col("row_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.col("cell_tokens").alias("doc_tokens"), F.col("window_id").alias("sequence_id"), "offset",
    )


@query()
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@query()
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = shards.shard_rows(table(spark, folder, "documents"), 8, row_id="doc_id", column="text")
    return rows.select(
        F.col("row_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
),
g AS (SELECT d, max(page_id) AS holder FROM p GROUP BY d),
b AS (
  SELECT page_id, n, d, CASE WHEN holder <> page_id THEN holder END AS refers_to,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(bits, 5 * i + 1, 5)::BIT::INTEGER, 1) FOR i IN range(32)], '') AS b32
  FROM (SELECT *, unhex(d)::BIT::VARCHAR AS bits FROM p JOIN g USING (d))
)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM b
"""


@query(OP9_SQL)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path, row_id="page_id", address="url", column="html", least_bytes=0)
    records = warc.read_archives(spark, path)
    return records.select(
        F.col("row_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    weights = toxicity.fit(docs, labels, row_id="doc_id", column="text", label_id="doc_id", label="toxic", where=remainder != 2)
    scores = toxicity.toxicity_scores(docs, weights, row_id="doc_id", column="text").withColumnRenamed("row_id", "doc_id")
    held_out = F.coalesce(remainder == 2, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with ``_trusted``: whether they are labelled good."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_good_id")).distinct()
    good = bounded(stored(good, "good-documents"), 16)
    joined = docs.join(good, docs.doc_id == good._good_id, "left")
    return joined.withColumn("_trusted", F.col("_good_id").isNotNull()).drop("_good_id")


@query()
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    marked = good_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    rows = quality.quality_rules(marked, "_trusted", row_id="doc_id", column="text")
    return rows.select(F.col("row_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query()
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    rows = overlap.similar_rows(table(spark, folder, "documents"), row_id="doc_id", column="text", size=5, similarity=80)
    return rows.select(F.col("row_id").alias("doc_id"), F.col("n_ngrams").alias("n_shingles"), "component_id")


@query()
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.repeated_lines(table(spark, folder, "documents"), row_id="doc_id", column="text", similarity=80, least_tokens=1)
    return rows.select(
        F.col("row_id").alias("doc_id"), "n_lines", F.size("removed_lines").cast("bigint").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = spans.repeated_spans(table(spark, folder, "documents"), row_id="doc_id", column="text", length=400)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        F.col("row_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, lang,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n1,
    len({WORDS.format('text')}) AS n2,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1 AS first
  FROM documents
),
c AS (
  SELECT source, lang, CASE WHEN n1 = n2 THEN 'space_words@1' ELSE 'words@2' END AS tokenizer_version,
    CASE WHEN n1 = n2 THEN n1 ELSE n2 END AS n
  FROM d WHERE first
)
SELECT source, lang, tokenizer_version, count(*) AS n_documents, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL
"""


@query(OP4_SQL)
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after four batches: all documents, later copies taken out (twice: the replay adds nothing), recounts.

    Counts are by white-space words first; documents that another word rule
    counts otherwise are revised to that rule's version.
    """
    keys = ["source", "lang", "tokenizer_version"]
    docs = table(spark, folder, "documents")
    counted = docs.select(
        "doc_id", "source", "lang", F.lit("space_words@1").alias("tokenizer_version"), F.lit("words@2").alias("new_version"),
        F.size(quality.words_of(F.coalesce("text", F.lit("")))).alias("tokens"), F.size(passages.words_of(F.col("text"))).alias("new_tokens"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
    )
    # Ids may be missing or repeated, so rows get marks; as the table is stored, they stay. Rows without an id come last.
    counted = stored(counted.withColumn("mark", F.monotonically_increasing_id()), "token-counts")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    first = counted.groupBy("digest").agg(F.min_by("mark", place).alias("first_mark"))
    marked = counted.join(first, "digest")
    path = fresh_folder(spark, "token-ledger")
    rollups.commit(rollups.inserts(counted, keys, "tokens"), path, "load", keys)
    later = rollups.deletes(marked.filter("mark <> first_mark"), keys, "tokens")
    for _ in range(2):
        rollups.commit(later, path, "copies out", keys)
    other = marked.filter("mark = first_mark and tokens <> new_tokens")
    recount = rollups.revisions(other, keys, "tokens", ["source", "lang", "new_version"], "new_tokens")
    rollups.commit(recount, path, "recount", keys)
    sums = rollups.totals(spark, path, ["load", "copies out", "recount"], keys)
    return sums.select(*keys, F.col("n_rows").alias("n_documents"), "n_tokens")


#: crc32 of a text of code points below U+0100, in SQL: bytes and, for each, eight steps over the bits.
CRC32 = (
    "xor(list_reduce(flatten([CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] "
    "ELSE [(192 + (ord(ch) >> 6))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1, (128 + (ord(ch) & 63))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] END "
    "FOR ch IN string_split({}, '')]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295), 4294967295)")

OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents
),
hashed AS (
  SELECT w, k, {CRC32.format("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h
  FROM (SELECT doc_id, w, count(*) AS k FROM runs GROUP BY ALL)
),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed
),
words AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, max(n) AS top, first(near ORDER BY n DESC, near) AS near FROM near GROUP BY word
),
forms AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * words.n THEN near END AS form, CASE WHEN top >= 5 * words.n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)
),
up AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT up.word, forms.form, step + 1 FROM up JOIN forms ON up.root = forms.word WHERE forms.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word) USING (word)
"""


@query(OP11_SQL)
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.column_words(table(spark, folder, "documents"), row_id="doc_id", column="text", slip=199)
    return spelling.spelling_variants(words, least_length=6, least_count=5, ratio=5)


@query()
def op12_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path(RANK_FILE)
    encoded = bytepairs.encode_cells(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, row_id="doc_id", column="text")
    rows = bytepairs.decode_cells(encoded, ranks, carry=True)
    written = F.array_join(F.transform("token_ids", lambda i: i.cast("string")), ",")
    return rows.select(
        F.col("row_id").alias("doc_id"), F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2("cell", 256).alias("decoded_sha256"))


def _framed(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


LOWER_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN changed THEN other ELSE leaf END AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, CASE WHEN changed THEN other END NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (
    SELECT doc_id, lang, coalesce({CRC32.format("doc_id::VARCHAR")} % 3 = 0, false) AS changed,
      sha256({' || '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
      sha256({' || '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars', LOWER_TEXT)))}) AS other
    FROM documents
  )
),
nodes AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, any_value(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, i // 8
),
subroots AS (SELECT lang, level, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, i, h, n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM upper_nodes WHERE n > 1 GROUP BY i // 8
),
runs AS (
  SELECT lang, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
),
upper_runs AS (SELECT level, i // 8 AS run, list(h ORDER BY i) AS hs FROM upper_nodes WHERE n > 1 GROUP BY ALL),
climb AS (
  SELECT leaves.doc_id, leaves.lang, leaves.i AS leaf_i, leaves.i, 0 AS level, other AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, climb.lang, leaf_i, climb.i // 8, climb.level + 1, sha256(array_to_string(list_concat(hs[:climb.i % 8], [climb.h], hs[climb.i % 8 + 2:]), '')),
    proof || array_to_string(list_concat(hs[:climb.i % 8], hs[climb.i % 8 + 2:]), '')
  FROM climb JOIN runs ON climb.lang IS NOT DISTINCT FROM runs.lang AND climb.level = runs.level AND climb.i // 8 = run
),
at_top AS (
  SELECT climb.doc_id, climb.lang, leaf_i, subroots.i, climb.h, proof, subroots.h AS subroot
  FROM climb JOIN subroots ON climb.lang IS NOT DISTINCT FROM subroots.lang AND climb.level = subroots.level
),
up AS (
  SELECT doc_id, lang, leaf_i, subroot, i, 0 AS level, h, proof FROM at_top
  UNION ALL
  SELECT doc_id, lang, leaf_i, subroot, up.i // 8, up.level + 1, sha256(array_to_string(list_concat(hs[:up.i % 8], [up.h], hs[up.i % 8 + 2:]), '')),
    proof || array_to_string(list_concat(hs[:up.i % 8], hs[up.i % 8 + 2:]), '')
  FROM up JOIN upper_runs ON up.level = upper_runs.level AND up.i // 8 = run
),
top AS (SELECT level, h AS root FROM upper_nodes WHERE n = 1)
SELECT up.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, up.h AS folded_root, up.h = root AS verified
FROM up JOIN top USING (level) JOIN leaves ON leaves.lang IS NOT DISTINCT FROM up.lang AND leaves.i = up.leaf_i
"""


@query(OP13_SQL)
def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest.sheet_manifest(
        table(spark, folder, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], row_id="doc_id", group="lang",
        edits={"text": lower}, edited=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    return rows.select(
        F.col("row_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256"),
        F.col("version_root").alias("folded_root"), "verified")
