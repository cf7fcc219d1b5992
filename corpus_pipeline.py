"""The corpus pipeline: documents in, packed training sequences out, in five stages that each read a written table.

In every stage: columns beside doc_id, text, source, lang and n_chars are carried, whatever their names; an empty table
gives an empty result; very long texts are handled whole; rows that share an id, or have none, are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import minhash, quality_rules, substring, toxicity
from corvane.llm.queries import pack_documents, table, toxic_lexicon
from corvane.llm.rows import name
from corvane.scratch import dropped, stored

#: Near-duplicates of the corpus: percent of common shingles, words of a shingle. op6 has its own, of its contract.
LIMIT, SHINGLE = 80, 5
#: Words that a document needs; op1's contract has 50. Short documents are mostly sound, and a filter keeps sound ones.
MIN_WORDS = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does.

    Null and empty texts fail (too short); a null source is no host; repeated rows each count and share their verdict; a
    host whose shrunk rate is just the limit is rejected.
    """
    return quality_rules.quality_rules(docs, min_words=MIN_WORDS).where("kept").select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic by the lexicon, which is learned from the labelled ones among them.

    Null and empty texts have no hit; a score of just 0.5 is toxic; repeated rows are judged alike; rows without a label
    are judged like others; without a hit no document is rejected, so without labels of both kinds all stay.
    """
    lexicon = toxic_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, lexicon).where("predicted = 0 or n_hits = 0").select("row.*")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least id (null ids last), then the least row number.

    Texts without words (null, empty, white space) are alike to none, so all their rows stay; repeated rows are one group.
    """
    inside = F.struct(*[name(c) for c in docs.columns]).alias("doc")  # so no column can clash with `row`
    numbered = stored(docs.select(inside, F.monotonically_increasing_id().alias("row")), "numbered")  # written, so numbers stay
    texts = numbered.select("row", F.col("doc")["text"].alias("text"))
    near = minhash.near_duplicates(texts, key="row", limit=LIMIT, shingle=SHINGLE).select(F.col("doc_id").alias("row"), "component_id")
    rows = stored(near.join(numbered.select("row", F.col("doc")["doc_id"].alias("doc_id")), "row"), "grouped")
    kept = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("k")).select("k.row")
    out = stored(rows.join(kept, "row", "left_anti").select("row"), "copies")
    dropped(rows)
    if out.count() <= minhash.BROADCAST_ROWS:
        out = F.broadcast(out)
    return numbered.join(out, "row", "left_anti").select("doc.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that repeat; n_chars is that of what stays.

    A null text stays null, with null n_chars; every document stays, even where no word does; repeated rows repeat each
    other, so both lose passages long enough; white space between words becomes one space.
    """
    got = substring.substring_dedup(docs)
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    got = got.select(*[F.col("row")[c].alias(c) for c in rest], F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*[name(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed.

    Null and empty texts are the end id alone; repeated rows are packed each; equal lengths may trade places.
    """
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("toxicity", clean), ("near-duplicates", distinct_documents), ("substring dedup", without_repeats), ("best-fit packing", sequences)]
#: Learned scores and a genetic search can't be stated in SQL; tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k + 1}")
    return docs
