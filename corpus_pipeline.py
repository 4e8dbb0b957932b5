"""The training-data pipeline: five stages over ``documents``, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents; the last adds the encoding's count and digests. The result can't be put in SQL
(classifier, tokenizer), so the stages are tested against brute force.

Defined results, for every stage: an empty table gives an empty table. Columns beside those of documents are dropped,
whatever their names. A null in lang, source or n_chars is kept as it is; sources that are null are one source. Texts
are taken whole, however long. What a stage does with null or empty texts, null or repeated ids, ties and repeated
rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import bpe, jaccard_join, mixing, quality_classifier, quality_rules
from strataform.llm.store import discard, new_path

ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good: score 0.3 or more, that limit included.

    Rows are judged each on their own, so equal texts share their fate, with or without an id. Null and empty texts have the
    score of a text without words. Without labels of both kinds every score is the same.
    """
    model = quality_classifier.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.classify(docs, model).filter("predicted = 1").select(COLUMNS)


def keep_unrepetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    Rows are judged each on their own. Null, empty and blank texts fail the base rule (fewer than ten words) and go; a share equal
    to its limit stays.
    """
    return quality_rules.quality_rules(docs).filter("kept").select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicate texts: the one with the smallest id (null ids last), then digest.

    Documents are told apart by id and text, so that different texts under one id, or under none, stand for themselves.
    Rows equal in both are one document, except those with neither an id nor a word. Of its rows the least source,
    language and length stay. Texts without words are linked with nothing: each distinct (id, text) stays. So every row
    that goes is a copy or near copy of one that stays, and neither the rows' order nor a rerun changes which.
    """
    members, links = jaccard_join.jaccard_groups(docs.select("doc_id", "text"))
    named = jaccard_join.named_components(members, links)
    discard(links)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("m"))
    kept = best.select("m.doc_id", "m.mark", F.lit(True).alias("words")).unionByName(members.filter("n = 0").select("doc_id", "mark", F.lit(False).alias("words")).distinct())
    rows = docs.select(*COLUMNS, jaccard_join.mark_of("text").alias("_mark"))
    on = F.col("d._mark").eqNullSafe(F.col("k.mark")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id"))
    met = rows.alias("d").join(kept.alias("k"), on).select("d.*", "k.words")
    blank = met.filter("doc_id IS NULL AND NOT words")
    rest = met.filter("doc_id IS NOT NULL OR words").groupBy("doc_id", "_mark").agg(F.first("text").alias("text"), F.min(F.struct("source", "lang", "n_chars")).alias("m"))
    return rest.select("doc_id", "text", "m.source", "m.lang", "m.n_chars").select(COLUMNS).unionByName(blank.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole times, and once more if it takes half of the next.

    A mix samples: documents that it takes less than half of are not in it, and neither are texts without words, of which
    it takes no words. Rows are taken each on their own, copies and rows without an id included; ties in the
    seeded order are settled by id, then text.
    """
    taken = mixing.mix_documents(docs)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return taken.filter(times > 0).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document: their number and digest, and the digest of what they decode to.

    A row a row: null and empty texts have no ids, repeated rows are encoded each.
    """
    return bpe.bpe_round_trip(docs, *bpe.vocabulary()).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("quality rules", keep_unrepetitive),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is a table in the shared folder, and the last one's is the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
