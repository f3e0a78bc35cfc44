"""Evaluation data sets and precision reports of audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialise
from .staleness import STALE


def context_documents(rows: DataFrame, text: str = "context", title: str = "title") -> DataFrame:
    """(title, text) of single-context rows, each once."""
    return rows.select(F.col(title).alias("title"), F.col(text).alias("text")).where("btrim(text) <> ''").distinct()


def supported_documents(rows: DataFrame) -> DataFrame:
    """(title, text) of the contexts, structs of title and sentences, whose title is among supporting_titles."""
    c = rows.select("supporting_titles", F.explode("contexts").alias("c"))
    return c.where(F.array_contains("supporting_titles", F.col("c.title"))).select("c.title", F.concat_ws(" ", "c.sentences").alias("text")).distinct()


def passage_documents(rows: DataFrame) -> DataFrame:
    """(title, text) of the parallel arrays passage_text and url."""
    return rows.select(F.explode(F.arrays_zip("passage_text", "url")).alias("p")).select(F.col("p.url").alias("title"), F.col("p.passage_text").alias("text")).where("btrim(text) <> ''").distinct()


def finalize(docs: DataFrame, name: str, key: str = "ordinal") -> tuple[DataFrame, int]:
    """(documents with a filename name-0001.txt each in order of key, once a text; number of rows left out)."""
    # ids in order over the whole table without sorting it in one task: each range counts on from those before it
    kept = docs.groupBy("text").agg(F.min_by(F.struct(*docs.columns), key).alias("d")).select("d.*")
    ranged = materialise(kept.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    sizes = local.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.sum("size").over(Window.orderBy("part")).alias("upto"), "size").select("part", (F.col("upto") - F.col("size")).alias("base"))
    out = local.join(F.broadcast(before), "part").withColumn("filename", F.format_string(f"{name}-%04d.txt", F.col("n") + F.col("base"))).drop("part", "n", "base")
    return out, docs.count() - kept.count()


def staleness_subcategory() -> Column:
    return F.when(F.col("meta_score").isNull() & F.col("text_score").isNull(), "freshness_unknown").when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "review").otherwise("fresh")


def flatten(duplicates: DataFrame, stale: DataFrame, contradictions: DataFrame, rot: DataFrame) -> DataFrame:
    """(category, subcategory, document_id) of all findings; 'outdated' is left out where the document has a stale finding."""
    dup = duplicates.select(F.lit("duplication").alias("category"), F.col("finding_type").alias("subcategory"), F.col("members")[0]["document_id"].alias("document_id"))
    age = stale.select(F.lit("staleness"), staleness_subcategory(), "document_id").toDF("category", "subcategory", "document_id")
    con = contradictions.select(F.lit("contradictions"), "severity", F.lit(None).cast("string")).toDF("category", "subcategory", "document_id")
    label = rot.select(F.lit("rot").alias("category"), F.explode("classifications").alias("subcategory"), "document_id").where("subcategory <> 'healthy'")
    known = stale.where(F.col("score") > STALE).select("document_id").distinct()
    label = label.where("subcategory <> 'outdated'").unionByName(label.where("subcategory = 'outdated'").join(known, "document_id", "left_anti"))
    return dup.unionByName(age).unionByName(con).unionByName(label)


def for_validation(flat: DataFrame, stale: DataFrame) -> DataFrame:
    """Distinct findings (category, subcategory, document_id, finding_id) to sample from, without 'outdated' labels of documents with a staleness finding."""
    known = stale.select("document_id").distinct().withColumn("known", F.lit(True))
    both = flat.join(known, "document_id", "left")
    return both.where(~((F.col("category") == "rot") & (F.col("subcategory") == "outdated") & F.coalesce("known", F.lit(False)))).drop("known").distinct()


def roll_up(audits: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    """One row over audits (dataset, documents, chunks, health, duplicates, contradictions, stale, rot): their number, sums, mean health and the precision of the validated samples.

    validated is a table of precision(); without a judged sample its figure is null.
    """
    kinds = ("duplicates", "contradictions", "stale", "rot")
    out = audits.agg(F.count("*").alias("datasets"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "chunks", *kinds)), F.round(F.avg("health"), 1).alias("mean_health"))
    out = out.withColumn("issues", sum((F.col(k) for k in kinds), F.lit(0)))
    if validated is None:
        return out.withColumns({"judged": F.lit(0).cast("long"), "precision": F.lit(None).cast("double")})
    overall = validated.where("category = 'overall'").agg(F.coalesce(F.max("judged"), F.lit(0)).alias("judged"), F.max("precision").alias("precision"))
    return out.crossJoin(F.broadcast(overall))


def markdown(audits: DataFrame, total: DataFrame) -> str:
    """A report of a roll-up: headline numbers, a row for each audit, and what validation says."""
    t = total.first()
    out = ["# Benchmark", "", f"{t['datasets']} data sets, {t['documents']} documents, {t['chunks']} chunks, {t['issues']} findings, mean health {t['mean_health']}.", "", "| data set | documents | health |", "|-|-|-|"]
    out += [f"| {r['dataset']} | {r['documents']} | {r['health']} |" for r in audits.orderBy("dataset").collect()]
    said = f"{t['judged']} findings were judged, {100 * t['precision']:.1f} % of them right." if t["judged"] and t["precision"] is not None else "No findings have been judged yet."
    return "\n".join([*out, "", said]) + "\n"


def precision(samples: DataFrame) -> DataFrame:
    """(category, judged, correct, precision) of samples (category, correct), with a row 'overall'; null where none is judged."""
    out = samples.rollup("category").agg(F.count("correct").alias("judged"), F.count_if("correct").alias("correct"))
    return out.select(F.coalesce("category", F.lit("overall")).alias("category"), "judged", "correct", F.round(F.try_divide("correct", "judged"), 3).alias("precision"))
