"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.functions.binding import let
from reqlens.llm import bpe, collocations, cotraining, embedding_dedup, minhash_dedup, mixing, outliers, periodic_runs, preference, sentence_dedup, sharding
from reqlens.llm import suffix_dedup, token_counts
from reqlens.llm.common import WORD, table, text_or_empty


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file the queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Target weights of the mixing query; keys not named have weight 1.
MIX_WEIGHTS = {"domain": {"d0": 1, "d1": 3, "d2": 2, "d3": 4}, "lang": {"en": 5, "de": 3, "fr": 3, "es": 2}, "source": {"src0": 2}}
#: The source's number modulo four stands for its domain.
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 2, 7


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(source, '[0-9]+$', 0) as int)")
    return docs.withColumn("domain", F.concat(F.lit("d"), (number % 4).cast("string")))


def op1_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and with how many tokens of one more epoch, the mixture takes every document."""
    docs = with_domain(table(spark, sf_dir, "documents"))
    plan = mixing.mix(docs, MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    return plan.withColumn("taken_tokens", F.col("epochs") * F.col("n_tokens") + F.col("part_tokens"))


def op2_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector among those of its label."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and verdict of every document."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document along a curve through language, source, size and number."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        (F.octet_length(text_or_empty("text")) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
    )
    docs = sharding.range_cell(docs, "doc_id", "doc_cell")
    docs = docs.withColumn("size_cell", sharding.magnitude_cell(F.col("size")))
    docs = sharding.ordinal_cell(sharding.ordinal_cell(docs, "lang", "lang_cell"), "source", "source_cell")
    placed = sharding.hilbert_shards(docs, ["lang_cell", "source_cell", "size_cell", "doc_cell"], ["doc_id", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert_index",
    )


def op5_merged_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a document before it has too, and the digest of the rest."""
    cut = suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made from the conversations: each one against itself with another one's turns from some turn on.

    The turn is the conversation's number modulo its number of turns; the other one is the next in number.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = turns.join(sizes, "conv_id").withColumn("fork", F.expr("pmod(conv_id, n)"))
    chosen = own.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    forks = sizes.select(F.col("conv_id").alias("pair_id"), F.expr("pmod(conv_id, n)").alias("fork"))
    tail = turns.select((F.col("conv_id") - 1).alias("pair_id"), "turn", "role", "text").join(forks, "pair_id").where("turn >= fork")
    head = own.where("turn < fork").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return preference.preference_pairs(chosen, head.unionByName(tail.select("pair_id", "turn", "role", "text")))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of its language and source."""
    docs = outliers.base_statistics(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text")
    judged = outliers.outliers(docs)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source", "outlier_distance")


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views, and the verdict."""
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they stand for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the runs of sentences that a document before it has."""
    left = sentence_dedup.remove_repeated_spans(table(spark, sf_dir, "documents"), span=2, least_words=16, within=False)
    return left.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs.withColumn("n_bytes", F.octet_length(text_or_empty("text")).cast("long")), vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The texts; with the number's checksum divisible by ten, the words from some word on repeat with some period.

    A document without a number keeps its text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(words):
        n = F.size(words)
        return let((g % n).cast("int"), lambda a: let(
            (1 + F.floor((n - a) / (3 + g % 8))).cast("int"),
            lambda p: F.concat(F.slice(words, F.lit(1), a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p)))))

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    planted = let(words, lambda ws: F.when(F.size(ws) > 0, F.array_join(periodic(ws), " ")))
    return docs.withColumn("text", F.when(F.coalesce(h % 10 == 0, F.lit(False)), planted).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one, and digests of all runs and of the text without repeats."""
    docs = with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_l", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_l.s")).alias("start"), F.col("_l.length").alias("length"), (-F.col("_l.p")).alias("period"),
        F.expr("1000 * _l.length div -_l.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_COLLOCATIONS = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?
-
]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS ws FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k FROM starts, range(1, 6) r(k) WHERE i + k - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
inner_nodes AS (SELECT DISTINCT x.lang, x.phrase FROM f x JOIN f y ON x.lang = y.lang AND y.k > x.k AND y.c >= x.c
  AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') WHERE x.k > 1),
cuts AS (SELECT lang, phrase, c AS a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS p, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS q
  FROM f, range(1, 5) t(cut) WHERE cut < k AND NOT EXISTS (SELECT 1 FROM inner_nodes s WHERE s.lang = f.lang AND s.phrase = f.phrase)),
scored AS (SELECT cuts.lang, cuts.phrase, a, l.c AS l, r.c AS r, n, CAST((1000::HUGEINT * a * n) // (l.c::HUGEINT * r.c) AS BIGINT) AS score, cut FROM cuts
  JOIN f l ON l.lang = cuts.lang AND l.phrase = p JOIN f r ON r.lang = cuts.lang AND r.phrase = q JOIN sizes ON sizes.lang = cuts.lang),
lowest AS (SELECT * EXCLUDE (cut) FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest
QUALIFY rank <= 2000"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_mixing": op1_hierarchical_mixing,
    "op2_subspace_pigeonhole": op2_subspace_pigeonhole,
    "op3_bagminhash_dedup": op3_bagminhash_dedup,
    "op4_hilbert_sharding": op4_hilbert_sharding,
    "op5_merged_bwt_dedup": op5_merged_bwt_dedup,
    "op6_preference_pairs": op6_preference_pairs,
    "op7_robust_outliers": op7_robust_outliers,
    "op8_cotrained_quality": op8_cotrained_quality,
    "op9_segment_tree_bpe": op9_segment_tree_bpe,
    "op10_sentence_spans": op10_sentence_spans,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}
SQL: dict[str, str] = {"op13_collocations": OP13_COLLOCATIONS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
