"""Training-data pipeline over ``documents``: language, near copies, benchmark, mix, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and reread as the next one's ``docs``. All but the last return the columns of their input,
whatever else those hold. Decisions are made and applied row by row (:func:`keyed`), so rows
whose ``doc_id`` is null or repeated are judged like others, each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortscope.llm import common, language, mixing, near_dedup, phrase_index, token_files
from cohortscope.llm.catalog import table, tokenizer_file

SHARE_OF_MEDIAN = 0.25  # of the cosine that labelled texts of a length have: below it, no language
STEPS = 1000  # steps of a cosine in which medians are counted
ORACLE_SQL = None  # vectors, MinHash, scheduling and tokens have no SQL form; tests use brute force


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number that names a row in every reading of the stored table.

    It is made of the number in the row's file name and the row's place in the file, so it does
    not depend on how a job cuts the files. Where ``docs`` was not read from Parquet files with
    numbers of their own, it is written once.
    """
    return common.with_row_key(docs, "_row")


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` (keyed) whose key is not in ``dropped``, without the key."""
    gone = common.stored(dropped.select("_row"), name)
    return docs.join(gone, "_row", "left_anti").drop("_row")


def language_floors(judged: DataFrame) -> list[tuple[int, float]]:
    """(power of two of the letters, least cosine) from ``judged``: ``lang, letters, score``.

    Of the labelled texts with as many letters, up to a factor of two, the median cosine is
    taken; ``SHARE_OF_MEDIAN`` of it is the floor, and no floor is below that of shorter texts.
    At most 40 rows come to the driver. No labelled rows: no floors.
    """
    size = F.floor(F.log2(F.greatest("letters", F.lit(1)))).cast("int")
    counts = judged.filter("lang IS NOT NULL AND letters > 0").groupBy(
        size.alias("size"), F.floor(F.col("score") * STEPS).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy("size").orderBy("step"), Window.partitionBy("size")
    medians = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(whole)}) \
        .filter(F.col("upto") * 2 >= F.col("all")).groupBy("size").agg(F.min("step").alias("step"))
    floors, least = [], 0.0
    for r in sorted(medians.collect(), key=lambda r: r["size"]):
        least = max(least, SHARE_OF_MEDIAN * r["step"] / STEPS)
        floors.append((r["size"], least))
    return floors


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that resemble no language of the corpus.

    A text's floor depends on how many letters it has (:func:`language_floors`). Where no row
    names a language there is nothing to resemble: all texts with a letter stay.
    """
    common.prepare(spark)
    docs = keyed(docs)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long")
    profiles = language.train_profiles(docs)
    if not profiles.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).drop("_row")
    judged = common.stored(language.identify(docs, profiles, ["_row", "lang", letters.alias("letters")]), "judged")
    size = F.log2(F.greatest("letters", F.lit(1)))
    floor = F.lit(0.0)
    for least_size, least in language_floors(judged):
        floor = F.when(size >= least_size, F.lit(least)).otherwise(floor)
    strange = (F.col("lang_pred") == language.UNDETERMINED) | (F.col("score") < floor)
    return _without(docs, judged.filter(strange), "strange")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: five-word shingles, similarity 0.8.

    The row with the smallest id stays; ids that are null come last, and of rows that share
    the smallest id the first stored one stays.
    """
    common.prepare(spark)
    docs = keyed(docs)
    found = common.stored(near_dedup.near_duplicates(docs, id_col="_row").select(
        F.col("doc_id").alias("_row"), "component_id"), "components")
    sizes = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("component_id IS NOT NULL AND n > 1")
    # A class with a third of all rows is joined apart.
    members = common.join_hot(found, common.stored(sizes, "classes"), "component_id", "n", found.count()).filter("n IS NOT NULL")
    named = common.stored(members.drop("n").join(docs.select("_row", "doc_id"), "_row"), "members")
    stays = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")).select("first._row")
    return _without(docs, named.join(stays, "_row", "left_anti"), "near-copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or a shorter item."""
    docs = keyed(docs)
    rows = docs.select(F.col("_row").alias("doc_id"), "text")
    found = phrase_index.contamination(rows, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("n_hit > 0").select(F.col("doc_id").alias("_row")), "contaminated")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay all documents out in the order of the Pfair schedule; files keep that order.

    Rows are placed by source and key alone; whole rows move once, to their place.
    """
    docs = keyed(docs)
    placed = mixing.mix_sources(docs.select("_row", "doc_id", "source"), carry=["_row"], order=["_row"])
    placed = common.stored(placed.select("_row", F.col("position").alias("_position")), "places")
    whole = docs.join(placed, "_row").repartitionByRange("_position", "_row")
    return whole.sortWithinPartitions("_position", "_row").drop("_row", "_position")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files in the order of the mix; returns what the files hold, per document."""
    common.prepare(spark)
    path = common.run_path(spark, "corpus-tokens")
    made = token_files.write_tokens(
        docs, path, tokenizer_file(), order=token_files.stored_order(docs))
    return token_files.token_digest(made)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between stages the rows lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
