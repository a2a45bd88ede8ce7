"""A training corpus from raw documents, in stages that each call one operator of millrace.llm.

A stage gets all that its predecessor kept and, but for the last, returns the same columns. Rows are
addressed by ``doc_id`` and text: a decision holds for every row that has both, and for no other that
only shares the id. Null texts and ids and extra columns pass through; the mix, which is made of
words, has the rows with a null id but none without a word. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm import decontaminate, language, mixing, ngram_join, pii
from millrace.session import scratch_dir

ORACLE_SQL = None       # trained and hashed decisions; tests/llm compares with brute force instead


def _written(table: DataFrame) -> DataFrame:
    """A table whose size is known, so that Spark broadcasts it only if it is small."""
    folder = scratch_dir(table.sparkSession, "decision")
    table.write.parquet(folder)
    return table.sparkSession.read.parquet(folder)


def _address() -> Column:
    """(last, doc_id, text hash): in the order of ids, null after all others. Never null itself."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"),
                    F.xxhash64("text").alias("text_hash"))


def _spelled(address: Column) -> Column:
    """An address as one string."""
    return F.concat(F.coalesce(F.concat(F.lit("="), address["doc_id"].cast("string")), F.lit("-")), F.lit(":"),
                    address["text_hash"].cast("string"))


def _new(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    return name if name not in docs.columns else _new(docs, name + "_")


def _without(docs: DataFrame, addresses: DataFrame) -> DataFrame:
    """The rows whose spelled address is not among ``addresses`` (one column)."""
    name = _new(docs, "_gone")
    gone = _written(addresses.toDF(name).distinct())
    return docs.join(gone, _spelled(_address()) == F.col(name), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: no text, no letter, or an ambiguous code."""
    rows = docs.select(_spelled(_address()).alias("id"), "doc_id", "text", "lang")
    found = language.identify(rows, "id")
    return _without(docs, found.filter((F.col("lang_pred") == "und") | F.col("ambiguous")).select("id"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of every group connected by near-equal sets of five-word shingles
    (Jaccard similarity 0.8 or more; op2's own query has other values); of repeated rows, one."""
    groups = ngram_join.jaccard_join(docs.select(_address().alias("id"), "text"), "id", words=5, percent=80)
    at, later, several = (_new(docs, c) for c in ("_at", "_later", "_several"))
    decided = _written(groups.groupBy(_spelled(F.col("id")).alias(at)).agg(
        F.first(F.col("id") != F.col("component_id")).alias(later), (F.count("*") > 1).alias(several))
        .filter(F.col(later) | F.col(several)))
    # both decisions reach the texts in one join, planned alike at every size
    marked = docs.join(decided.hint("shuffle_merge"), _spelled(_address()) == F.col(at), "left")
    left = marked.filter(~F.coalesce(later, F.lit(False)))
    repeated = F.coalesce(F.col(several), F.lit(False))
    return left.filter(~repeated).unionByName(left.filter(repeated).dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(_spelled(_address()).alias("id"), "text")
    return _without(docs, decontaminate.overlaps(rows, items, "id").select("id"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; ``n_chars`` follows the text. Spans stay with
    their row, so no text is moved."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = pii.find_pii(docs.toDF(*names), *names, text_col=names[docs.columns.index("text")])
    hit = F.size("spans") > 0

    def column(name: str, own: str) -> Column:
        if name == "text":
            return F.when(hit, pii.redact(F.col(own), F.col("spans"))).otherwise(F.col(own)).alias(name)
        if name == "n_chars":
            length = F.length(pii.redact(F.col(text), F.col("spans"))).cast(kinds[name])
            return F.when(hit, length).otherwise(F.col(own)).alias(name)
        return F.col(own).alias(name)

    kinds, text = dict(docs.dtypes), names[docs.columns.index("text")]
    return found.select(*[column(n, own) for n, own in zip(docs.columns, names, strict=True)])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of text in shards, by the sources' target weights, in shuffled order by ``place``."""
    rows = docs.select(_address().alias("id"), "text", "source")
    sizes, aims = mixing.planned(rows, "id")
    blocks = mixing.mix(sizes, aims).drop("row")
    return mixing.block_texts(blocks, rows, "id").select(
        F.col("id.doc_id").alias("doc_id"), *(c for c in [*blocks.columns, "text"] if c != "id"))


STAGES = [("language", known_language), ("near duplicates", one_of_each_group),
          ("benchmark", without_benchmark), ("personal data", redacted), ("mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again by the next."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_dir(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
