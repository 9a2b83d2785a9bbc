"""The corpus pipeline: language ID, near-duplicate removal, mixing, packing.

Each stage is written as Parquet and read again before the next. No SQL can
express language ID, so tests compare the stages with brute force.
"""

from pyspark.sql import functions as F

from pricelode.llm import language, mixing, near_copies, packing
from pricelode.llm.common import durable, reread

#: Texts whose language is told with less confidence than this are rejected; with two classes a level none is.
LEAST_SCORE = 0.2
#: Texts whose n-grams their language explains hardly better than noise are rejected: 1 is the language's average.
LEAST_EVIDENCE = 0.15
#: Texts with a smaller share of characters in plain words are rejected.
LEAST_WORDS = 0.25
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_language(spark, docs, sf_dir):
    """Keep texts in a recognised language, and set lang to it.

    Machines learn from the labelled rows of docs. Rejected are null texts, texts
    without a letter, and texts below LEAST_SCORE, LEAST_EVIDENCE or LEAST_WORDS:
    tokens, numbers, noise, other alphabets. Repeated rows are judged alike and
    stay as often as they come; an empty table gives an empty one, and further
    columns of docs are dropped.
    """
    rows = docs.select(*COLUMNS)
    model = language.fit_languages(rows, F.lit(True))
    judged = language.identify_languages(rows.withColumn("whole", F.col("text")), model, grounds=True)
    sure = (F.col("score") >= LEAST_SCORE) & (F.col("evidence") >= LEAST_EVIDENCE) & (F.col("word_share") >= LEAST_WORDS)
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN) & sure)
    return kept.select("doc_id", F.col("whole").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def row_key(columns=COLUMNS):
    """128 bits that tell rows apart unless all columns are equal; a null differs from every value."""
    given = F.concat(*[F.col(c).isNull().cast("string") for c in columns])
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), given, *columns)), 16, "0") for seed in (1, 2)])


def without_near_duplicates(spark, docs, sf_dir):
    """Keep one row of each group of near copies: of the smallest doc_id (null comes last) that with the smallest text.

    Near copies share 0.8 or more of their five-word shingles (near_copies). A
    doc_id may be null or repeat; of rows that are equal in all columns one
    stays. An empty table gives an empty one.
    """
    rows = docs.select(*COLUMNS, row_key().alias("key"))
    groups = near_copies.near_copies(rows)
    groups = durable(groups.distinct().join(rows.select("key", "doc_id").distinct(), "key"))
    heads = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("head"))
    heads = groups.join(heads, "component").where(F.col("doc_id").eqNullSafe(F.col("head.doc_id"))).select("key", "component")
    marked = F.struct(F.col("text").isNull(), "text", "lang", "source", "n_chars", "doc_id")
    return rows.join(heads, "key").groupBy("component").agg(F.min(marked).alias("row")).select(*[f"row.{c}" for c in COLUMNS])


def mixed(spark, docs, sf_dir):
    """Repeat and drop documents so that sources come near their target shares, each row by its own number of copies.

    A null source is one of its own; null and blank texts have no words, and in a
    source without words they are dropped. Equal rows are told apart by nothing
    and get copies one after the other; an empty table gives an empty one.
    """
    whole = F.struct(*COLUMNS)
    copies = mixing.mix_copies(docs.select(*COLUMNS, whole.alias("row")), keep=("row",)).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[f"row.{c}" for c in COLUMNS])


def packed(spark, docs, sf_dir):
    """Pack all documents, repeats included, into sequences of 2048 tokens.

    Returns the pieces of pack_documents. A null or empty text is one end token;
    a text of any length is cut into pieces; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", by_language), ("near-dedup, SimHash in vantage-point trees, MinHash for the rest", without_near_duplicates), ("mixing", mixed), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to documents, each to what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, reread(docs) if number else docs, sf_dir)
    return docs
