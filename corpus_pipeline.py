"""A corpus from raw documents: language ID, near-duplicate removal, mixing, encoding.

``STAGES`` are applied in order; each function takes (spark, docs, sf_dir) and works on all that the
stage before kept. Between stages the rows are written to the shared folder and read again. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeframe.llm import bag_minhash, language_id, mixing, piece_lattice
from plumeframe.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language; a text without letters, or of which nothing is known in any language, goes.

    So do NULL and empty texts. Repeated rows are judged alike; ids and sources do not matter. An empty table stays empty.
    """
    model = language_id.fit_documents(docs)
    found = language_id.identify(docs, model, "_pred", "_score")
    # Without any evidence all languages share the score.
    even = 1.0 / len(model.languages) + 1e-9 if len(model.languages) > 1 else 0.0
    return found.filter((F.col("_pred") != language_id.UNDECIDED) & (F.col("_score") > even)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    NULL texts, texts without words and rows with a NULL id are no one's duplicates and stay. Rows that repeat id and text
    stay once. An empty table stays empty.
    """
    return bag_minhash.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document taken twice is two rows, one not taken is none.

    A text without words has size 0 and is not taken; a NULL source is a source of its own. Repeated rows are documents
    of their own. An empty table stays empty.
    """
    return mixing.mixture(mixing.planned_documents(docs)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of the mix as piece ids; ``round_trip`` says that decoding them gives its text back.

    A NULL text has NULL ids, an empty one none; texts of any length are encoded whole, repeated rows each.
    """
    encoded = piece_lattice.encode(docs.select(*COLUMNS), piece_lattice.load_pieces())
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("piece_encoding", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
