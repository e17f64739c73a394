"""A training corpus out of `documents`, in stages that each work on what the one before kept."""

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import catalog, jaccard_join, mixing, packing, secret_scan, toxicity
from pulsegrid.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; null texts count as empty, repeated rows go or stay together."""
    model = toxicity.learn(docs, catalog.table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one with the smallest id stays; rows without id all stay."""
    linked = jaccard_join.link_documents(docs, count_links=False, name_rows=True)
    return jaccard_join.keep_one(docs, stored(linked, "near-copies"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark; n_chars follows. Null texts stay null, repeated rows repeated."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take_mix(docs, stored(mixing.mix(docs), "mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary length, each of one document; a null text is its end mark alone, and
    repeated rows are packed each."""
    return packing.pack(docs, **catalog.byte_pieces())


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# No stage that fits, links or draws can be told in SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written as Parquet and read again."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
