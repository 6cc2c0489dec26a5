"""The registered queries of the operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, clustering, lexical, lm, media, mixing, neardup, pii, quality, records, sharding, toxicity, warc
from tracewell.llm.common import fold, saved, shared_dir, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text by the unigram baseline and by PPM, learned outside fold 1."""
    return lm.scores(table(spark, sf_dir, "documents"))


#: Key of the surrogates; whoever holds another key draws others.
PII_KEY = "tracewell-surrogates"


def op1_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an AVI file of motion JPEG, parsed, decoded and cut into shots."""
    read = media.analyse(media.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", media.feature(read).alias("feature"), "n_frames", F.size("clips").alias("n_shots"))


def op2_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; sources weigh 5, 2, 1 in turn and no document is taken over 3 times."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives, converted to WARC files, read back."""
    folder = shared_dir(spark, "warc")
    files = warc.write(warc.convert(warc.parse(warc.pack(table(spark, sf_dir, "pages"))).where("payload_start > 0")), folder)
    return warc.pages_of(saved(warc.read(files, folder), "warc-read"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the compression bands' verdict of every text."""
    return quality.verdict(quality.measure(table(spark, sf_dir, "documents")))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pii.replace(table(spark, sf_dir, "documents"), PII_KEY)


def op7_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the word vocabulary."""
    path = vocabulary("word_bpe_49k.json")
    both = bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"], decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as record files, read the files back."""
    folder = records.folder_in(spark)
    index = records.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder, end_id=2)
    return records.positions(saved(records.read(index, folder), "records-read"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from labelled rows outside fold 0, score every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of copies and of verified links of every document, at a similarity of 0.8 on five-word shingles."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op11_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of 16 centroids over all vectors, and the assignment to where these end."""
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each item, of all documents."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 40, its slot there, and its shard among 41."""
    placed = sharding.shards(table(spark, sf_dir, "documents"), sharding.layout(40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def hash_tree_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op13 does without the checksum of the texts, which SQL can't express."""
    return op13_hash_tree(spark, sf_dir).drop("text_crc32")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of op2 starts from: every document's size, its source's size and target."""
    measured = saved(mixing.sizes(table(spark, sf_dir, "documents")), "sizes")
    return measured.join(mixing.targets(measured), "k").select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op4 and what they reject, without the compression bands."""
    counts = quality.verdict(quality.measure(table(spark, sf_dir, "documents")))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_avi_mjpeg": op1_avi_mjpeg,
    "op2_entropy_balancing": op2_entropy_balancing,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_compression_bands": op4_compression_bands,
    "op5_ppm": op5_ppm,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_bpe_backtracking": op7_bpe_backtracking,
    "op8_binary_records": op8_binary_records,
    "op9_toxicity": op9_toxicity,
    "op10_probminhash": op10_probminhash,
    "op11_annulus": op11_annulus,
    "op12_bucket_search": op12_bucket_search,
    "op13_hash_tree": op13_hash_tree,
    "hash_tree_placement": hash_tree_placement,
    "mixing_targets": mixing_targets,
    "quality_base_counts": quality_base_counts,
}

#: Vectors, first centroids and rounds of op11 in SQL; an array is a list of 64-bit integers.
_NEAREST = """
    SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT p.vec_id, p.v, k.c, list_sum(list_transform(list_zip(p.v, k.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM p, {centroids} k
    ) GROUP BY vec_id, v"""
_MEANS = """
    SELECT k.c, coalesce(m.v, k.v) AS v FROM {centroids} k LEFT JOIN (
        SELECT c, list(s ORDER BY i) AS v FROM (
            SELECT c, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS s FROM {assigned}, range(1, 65) t(i) GROUP BY c, i
        ) GROUP BY c
    ) m USING (c)"""
ANNULUS_SQL = f"""
    WITH p AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    ),
    k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM p ORDER BY sha256('1:' || vec_id) LIMIT 16),
    a0 AS MATERIALIZED ({_NEAREST.format(centroids="k0")}),
    k1 AS MATERIALIZED ({_MEANS.format(centroids="k0", assigned="a0")}),
    a1 AS MATERIALIZED ({_NEAREST.format(centroids="k1")}),
    k2 AS MATERIALIZED ({_MEANS.format(centroids="k1", assigned="a1")}),
    a2 AS MATERIALIZED ({_NEAREST.format(centroids="k2")}),
    k3 AS MATERIALIZED ({_MEANS.format(centroids="k2", assigned="a2")}),
    a3 AS MATERIALIZED ({_NEAREST.format(centroids="k3")})
    SELECT a3.vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(k3.v, ',')) AS centroid_sha256
    FROM a3 JOIN k3 USING (c)
"""


def _draws(level: int, leaves: list[sharding.Leaf]) -> str:
    """SQL of the winner among the children of one node, as sharding.shard_of draws it."""
    names: dict[tuple[int, str], list[sharding.Leaf]] = {}
    for leaf in leaves:
        names.setdefault((leaf.layer, leaf.path[level]), []).append(leaf)
    below = [_draws(level + 1, own) if level < 2 else str(own[0].shard) for own in names.values()]
    if len(below) == 1:
        return below[0]
    draws = ", ".join(f"-ln((CAST('0x' || substr(md5(k || '|{name}|{layer}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {sum(x.weight for x in own)}" for (layer, name), own in names.items())
    cases = " ".join(f"WHEN {i} THEN {one}" for i, one in enumerate(below, 1))
    return f"(CASE list_position([{draws}], list_min([{draws}])) {cases} END)"


HASH_TREE_SQL = f"""
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
    FROM (SELECT *, {_draws(0, list(sharding.layout(40)))} AS shard, {_draws(0, list(sharding.grown(sharding.layout(40))))} AS grown_shard FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents))
"""

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_annulus": ANNULUS_SQL,
    "hash_tree_placement": HASH_TREE_SQL,
    "op12_bucket_search": r"""
        WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY ALL),
        n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
        m AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM n, s),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM d, s GROUP BY term),
        r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN d USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50
    """,
    "mixing_targets": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT *, 3 * source_size AS stop, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
        r AS (
            SELECT 0 AS i, CAST(0 AS DOUBLE) AS share
            UNION ALL
            SELECT r.i + 1, coalesce(CAST(sum(source_size) - coalesce(sum(stop) FILTER (weight * share > stop), 0) AS DOUBLE) / sum(weight) FILTER (NOT weight * share > stop), any_value(share)) FROM r, s WHERE r.i < 20 GROUP BY r.i
        )
        SELECT doc_id, size, source_size, round(least(weight * (SELECT max(share) FROM r), CAST(stop AS DOUBLE)), 3) AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source
    """,
    "quality_base_counts": r"""
        WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        g AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], chr(31)) AS gram FROM d, unnest(range(1, len(ws) - 6)) u(i)),
        m AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM m, range(0, 8) v(j) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) AS base_failed
        FROM d LEFT JOIN c USING (doc_id)
    """,
    "op3_arc_to_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
    """,
}
