"""Reads, references, consensus and scores as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.operators import sequences, tabular
from tracewell.plans.data_queries import READ, _reads

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ALIGNED = "(SELECT l_orderkey read, 'ref' || l_suppkey % 40 rname, l_suppkey % 40 AS ordinal, CAST(l_quantity AS INTEGER) * 4 % 128 flag, CAST(l_partkey % 90 AS VARCHAR) || 'M3I' || CAST(l_quantity AS INTEGER) || 'M' cigar, l_partkey % 90 a, CAST(l_quantity AS INTEGER) b FROM lineitem)"


def _aligned(spark, d):
    q, p, s = F.col("l_quantity").cast("int"), F.col("l_partkey") % 90, F.col("l_suppkey") % 40
    cigar = F.concat(p.cast("string"), F.lit("M3I"), q.cast("string"), F.lit("M"))
    return catalog.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.concat(F.lit("ref"), s.cast("string")).alias("rname"), s.alias("ordinal"), (q * 4 % 128).alias("flag"), cigar.alias("cigar"))


COUNTS = f"(SELECT rname, ordinal, count(*) AS count, count(*) FILTER (flag & 12 = 0 AND greatest(a, b) > 50) filtered_count FROM {ALIGNED} GROUP BY ALL)"


@query(f"SELECT rname, count, filtered_count FROM {COUNTS}")
def reference_counts(spark, d):
    """Reads of each reference, and the mapped and long ones among them."""
    return sequences.reference_counts(_aligned(spark, d), "rname", "flag", "cigar")


@query(f"SELECT grp AS \"group\", rname, filtered_count AS count FROM (SELECT ordinal % 7 AS grp, rname, filtered_count, row_number() OVER (PARTITION BY ordinal % 7 ORDER BY filtered_count DESC, ordinal) k FROM {COUNTS} WHERE filtered_count >= CASE WHEN rname IN ('ref3', 'ref4') THEN 1 ELSE 10 END) WHERE k = 1")
def best_references(spark, d):
    """The best reference of each group of seeds."""
    at = F.substring("rname", 4, 9).cast("long")
    counts = sequences.reference_counts(_aligned(spark, d), "rname", "flag", "cigar").withColumns({"ordinal": at, "group": at % 7})
    return sequences.best_references(counts, "rname", "group", "ordinal", 10, ("ref3", "ref4"))


#: Reads with gaps, unknown letters and insertions, made of digests.
GAPPED = "translate(md5(text), '0123456789abcdef', 'ACGTACGT-ACGTNn-')"
INSERT = "CASE doc_id % 4 WHEN 0 THEN 'ACG' WHEN 1 THEN 'AC' ELSE '' END"


def _gapped(spark, d):
    seq = F.translate(F.md5("text"), "0123456789abcdef", "ACGTACGT-ACGTNn-")
    extra = F.when(F.col("id") % 4 == 0, "ACG").when(F.col("id") % 4 == 1, "AC").otherwise("")
    return catalog.files(spark, d).select("id", "lang", seq.alias("seq"), F.create_map(F.lit(5), extra).alias("inserts"))


TOKENS = f"""(SELECT lang, CAST(i AS INTEGER) AS position, token, CASE token WHEN 'N' THEN -1 WHEN '-' THEN -2 ELSE count(*) END n FROM (
    SELECT lang, i, CASE WHEN c IN ('N', '-') THEN c WHEN i = 5 AND length(ins) % 3 = 0 THEN c || ins ELSE c END token FROM (
    SELECT lang, i, substr(s, i, 1) c, ins FROM (SELECT lang, {GAPPED} s, {INSERT} ins FROM documents), range(1, 33) t(i) WHERE i > length(regexp_extract(s, '^-*'))) WHERE c <> 'n') GROUP BY lang, i, token)"""


@query(f"SELECT lang, position, token, n FROM {TOKENS}")
def token_counts(spark, d):
    """Tokens at each position of merged reads, with insertions and noted gaps."""
    return sequences.token_counts(_gapped(spark, d), ["lang"])


@query(f"""WITH top AS (SELECT lang, position, arg_min(token, (-n, token)) token FROM {TOKENS} GROUP BY ALL),
    whole AS (SELECT l.lang, i AS position, coalesce(token, 'N') AS token FROM (SELECT lang, max(position) e FROM top GROUP BY lang) l, range(1, 33) t(i) LEFT JOIN top ON top.lang = l.lang AND top.position = i WHERE i <= e)
    SELECT lang, regexp_replace(regexp_replace(string_agg(token, '' ORDER BY position), '-+$', ''), '([^-])(---)+([^-])', '\\1\\3', 'g') AS sequence FROM whole GROUP BY lang""")
def assembled_consensus(spark, d):
    """The consensus of each group's reads."""
    return sequences.assembled(sequences.token_counts(_gapped(spark, d), ["lang"]), ["lang"])


@query(f"""SELECT lang, variant, n, index FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, variant DESC) - 1 AS index FROM (
    SELECT lang, variant, count(*) n FROM (SELECT lang, substr(repeat('-', CAST(doc_id % 3 AS INTEGER)) || substr({GAPPED}, 1, 5), 2, 5) variant FROM documents) WHERE length(replace(variant, '-', '')) > 2 GROUP BY lang, variant)) WHERE index < 4""")
def nucleotide_variants(spark, d):
    """The most frequent stretches of reads moved by their offsets."""
    reads = _gapped(spark, d).select("lang", F.substring("seq", 1, 5).alias("seq"), (F.col("id") % 3).alias("offset"), F.lit(1).alias("count"))
    out = sequences.nucleotide_variants(reads, ["lang"], 1, 6, 5, 4)
    return out.select("lang", "variant", "n", F.col("index").cast("long").alias("index"))


AMINO_AT = f"substr('{sequences.AMINO}', CAST((instr('TCAG', {{0}}[1]) - 1) * 16 + (instr('TCAG', {{0}}[2]) - 1) * 4 + instr('TCAG', {{0}}[3]) AS INTEGER), 1)"


@query(f"""SELECT lang, l + 1 AS "left", {AMINO_AT.format("part")} || {AMINO_AT.format("substr(part, 4, 3)")} AS insert, count(*) n FROM (
    SELECT lang, l, substr('-' || {READ}, CAST(l * 3 + 1 AS INTEGER), 6) part FROM documents, (VALUES (0), (3), (7)) v(l)) WHERE part NOT LIKE '%-%' GROUP BY ALL""")
def insertion_counts(spark, d):
    """Amino acids inserted in given ranges of codons, in the second reading frame."""
    ranges = catalog.files(spark, d).select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, (0, 3, 7)))).alias("left")).withColumn("right", F.col("left") + 2)
    return sequences.inserted(ranges, _reads(spark, d).withColumn("count", F.lit(1)), ["lang"], frame=1)


@query(f"""SELECT lang, CAST(f AS INTEGER) AS frame, CAST(p AS INTEGER) AS position, {", ".join(f"count(*) FILTER (a = '{a}') AS {'stop' if a == '*' else chr(34) + a + chr(34)}" for a in sequences.AMINO_COLUMNS)}
    FROM (SELECT lang, f, p, {AMINO_AT.format("codon")} a FROM (SELECT lang, f, p, substr({READ}, CAST(p * 3 + f + 1 AS INTEGER), 3) codon FROM documents, range(0, 3) x(f), range(0, 10) y(p)) WHERE length(codon) = 3) GROUP BY ALL""")
def amino_table(spark, d):
    """Amino acids at each codon position in a column for each letter."""
    counted = _reads(spark, d).groupBy("lang", "seq").agg(F.count("*").alias("count"))
    return sequences.amino_table(sequences.amino_counts(counted, ["lang"]), ["lang"])


LEFT, RIGHT = (f"translate(substr(md5({x}), 1, 12), '0123456789abcdef', 'ACGTACGTACGTA---')" for x in ("text", "'b' || text"))


@query(f"""WITH c AS (SELECT doc_id id, i, substr({LEFT}, i, 1) x, substr({RIGHT}, i, 1) y FROM documents, range(1, 13) t(i)),
    n AS (SELECT id, x, count(*) FILTER (x <> '-') OVER w - CASE WHEN x <> '-' THEN 1 ELSE 0 END a, count(*) FILTER (y <> '-') OVER w - CASE WHEN y <> '-' THEN 1 ELSE 0 END b FROM c WINDOW w AS (PARTITION BY id ORDER BY i))
    SELECT id, b b_index, max(a) a_index FROM n WHERE x <> '-' GROUP BY ALL""")
def aligned_map(spark, d):
    """Places of one aligned text in the other."""
    made = lambda c: F.translate(F.substring(F.md5(c), 1, 12), "0123456789abcdef", "ACGTACGTACGTA---")
    rows = catalog.files(spark, d).select("id", made(F.col("text")).alias("a"), made(F.concat(F.lit("b"), "text")).alias("b"))
    return sequences.aligned_map(rows, "id", "a", "b")


MIXED = "translate(md5(text), '0123456789abcdef', 'ACGTWRKYSMBDHVN-')"


@query(f"SELECT doc_id id, reverse(translate({MIXED}, 'ACGTWRKYSMBDHV', 'TGCASYMRWKVHDB')) AS turned FROM documents")
def reverse_complement_mixtures(spark, d):
    seq = F.translate(F.md5("text"), "0123456789abcdef", "ACGTWRKYSMBDHVN-")
    return catalog.files(spark, d).select("id", sequences.reverse_complement_iupac(seq).alias("turned"))


@query(f"""WITH s AS (SELECT doc_id id, i, substr({MIXED}, CAST(i * 3 + 1 AS INTEGER), 3) codon FROM documents, range(0, 10) t(i)),
    m(letter, bases) AS (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),{",".join(f"('{m}','{b}')" for b, m in sequences.MIXTURES.items())},('-','ACGT')),
    e AS (SELECT id, i, codon, list_sort(list_distinct(list({AMINO_AT.format("(x || y || z)")}))) AS aminos FROM s JOIN m a ON a.letter = codon[1] JOIN m b ON b.letter = codon[2] JOIN m c ON c.letter = codon[3], unnest(string_split(a.bases, '')) p(x), unnest(string_split(b.bases, '')) q(y), unnest(string_split(c.bases, '')) r(z) GROUP BY id, i, codon)
    SELECT id, string_agg(CASE WHEN codon = '---' THEN '-' WHEN len(aminos) = 1 THEN aminos[1] ELSE 'X' END, '' ORDER BY i) protein FROM e GROUP BY id""")
def translated_mixtures(spark, d):
    """Amino acids of sequences with mixtures and gaps."""
    seq = F.translate(F.md5("text"), "0123456789abcdef", "ACGTWRKYSMBDHVN-")
    return catalog.files(spark, d).select("id", sequences.translated(F.substring(seq, 1, 30), "X").alias("protein"))


@query(f"SELECT doc_id id, regexp_replace({GAPPED}, '([A-Z])(---)+([A-Z])', '\\1\\3', 'g') AS seq FROM documents")
def gaps_in_frame_removed(spark, d):
    return _gapped(spark, d).select("id", sequences.without_gaps_in_frame(F.col("seq")).alias("seq"))


@query("""WITH s AS (SELECT doc_id id, upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) p FROM documents)
    SELECT id, CASE WHEN length(regexp_replace(p, '[^N]', '', 'g')) > 0.5 * length(p) THEN 'low quality' WHEN length(p) % 3 <> 0 THEN 'notdiv3' WHEN length(p) = 0 THEN 'zerolength'
    WHEN p NOT LIKE 'T%' AND p NOT LIKE 'D%' OR p NOT LIKE '%E' AND p NOT LIKE '%N' THEN 'cysteines' WHEN id % 5 > 1 OR id % 3 > 2 THEN '> 2 ambiguous' WHEN length(p) < 32 OR length(p) > 2000 THEN 'length' END error FROM s""")
def loop_errors(spark, d):
    """Why texts, taken for reads, can't be scored: letters T and D stand for the first cysteine, E and N for the last."""
    seq = F.upper(F.regexp_replace("text", "[^a-zA-Z]", ""))
    bounded = F.concat(F.when(seq.startswith("T") | seq.startswith("D"), "C").otherwise("A"), F.lit("A" * 33), F.when(seq.endswith("E") | seq.endswith("N"), "C").otherwise("A"))
    protein = F.when((F.length(seq) >= 32) & (F.length(seq) <= 2000), bounded).otherwise(F.concat(F.substring(bounded, 1, 1), F.substring(bounded, 35, 1)))
    return catalog.files(spark, d).select("id", sequences.loop_error(seq, protein, F.col("id") % 5, F.col("id") % 3).alias("error"))


@query("""WITH o AS (SELECT event_id id, value / 100 a, user_id % 7 / 3.0 b, event_id % 3 = 0 two FROM events)
    SELECT id, round((1 / (1 + exp((1.33153 - a) * -2.31191 + 0.244784 - 0.5)) + CASE WHEN two THEN 1 / (1 + exp((1.33153 - b) * -2.31191 + 0.244784 - 0.5)) ELSE 0 END) / CASE WHEN two THEN 2 ELSE 1 END, 9) score FROM o""")
def logistic_scores(spark, d):
    """Mean logistic scores over one or two readings of a position."""
    rows = catalog.jobs(spark, d).select("id", (F.col("value") / 100).alias("a"), (F.col("actor") % 7 / 3.0).alias("b"))
    options = F.array(F.when(F.col("id") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A"))))
    matrix = F.create_map(F.lit("0:A"), F.col("a"), F.lit("0:B"), F.col("b"))
    return rows.where("a is not null").select("id", F.round(sequences.logistic_score(options, matrix), 9).alias("score"))


@query("""SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM (SELECT conv_id, turn, CASE WHEN length(text) % 3 = lag(length(text) % 3) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END new FROM conversations)""")
def adjacent_runs(spark, d):
    """Neighbouring turns of like lengths, numbered as runs."""
    rows = catalog.read(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 3).alias("k"))
    return sequences.adjacent_runs(rows, ["k"], "turn", ["conv_id"]).select("conv_id", "turn", "run")


@query(f"SELECT doc_id id, seed, levenshtein({READ}, (SELECT upper(n_name) FROM nation WHERE n_nationkey = doc_id % 25)) <= distance AS kept FROM (SELECT doc_id, n_name seed, levenshtein({READ}, upper(n_name)) AS distance, text, row_number() OVER (PARTITION BY doc_id ORDER BY levenshtein({READ}, upper(n_name)), n_name) k FROM documents, nation) WHERE k = 1")
def kept_seeds(spark, d):
    """The nearest seed of each read, and whether its own seed is as near."""
    seeds = catalog.read(spark, d, "nation").select(F.col("n_name").alias("seed"), F.upper("n_name").alias("seq"), F.col("n_nationkey").alias("key"))
    reads = _reads(spark, d).withColumn("key", F.col("id") % 25).join(seeds.select("key", F.col("seed").alias("own_seed")), "key").select("id", "seq", "own_seed")
    return sequences.closest_seed(reads, seeds.select("seed", "seq"), own="own_seed").select("id", "seed", "kept")


@query("SELECT p_partkey * 2 AS b, p_size AS a FROM part")
def swapped_scaled(spark, d):
    """(a, b) becomes (2 b, a)."""
    out = tabular.swapped(catalog.read(spark, d, "part"), "p_size", "p_partkey")
    return out.select(F.col("first").alias("b"), F.col("second").alias("a"))


@query("SELECT reverse(n_name) AS first, reverse(r_name) AS second FROM nation JOIN region ON r_regionkey = n_regionkey")
def reversed_swapped(spark, d):
    """Two columns of text turned round and exchanged."""
    rows = catalog.read(spark, d, "nation").join(catalog.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tabular.reversed_and_swapped(rows, "r_name", "n_name")


@query("SELECT event_id id, CASE WHEN lower(event_type) IN ('view', 'click') THEN 'hello' WHEN lower(event_type) IN ('purchase', 'signup') THEN 'goodbye' ELSE 'none' END regular, CASE WHEN lower(event_type) IN ('view', 'click') THEN 'goodbye' WHEN lower(event_type) IN ('purchase', 'signup') THEN 'hello' ELSE 'none' END opposite FROM events")
def salutations_both_ways(spark, d):
    regular, opposite = tabular.salutation(F.col("event_type"), ("view", "click"), ("purchase", "signup"))
    return catalog.read(spark, d, "events").select(F.col("event_id").alias("id"), regular.alias("regular"), opposite.alias("opposite"))
