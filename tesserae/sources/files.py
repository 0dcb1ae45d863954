"""Readers and writers: text files with fingerprints, JSON lines, delimited files, and routed sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import evaluation


def text_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, skip_suffix: str = ".out.json") -> DataFrame:
    """(path, size, modified, sha256, content_type, text): files as documents; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    kind = F.when(F.lower("path").rlike(r"\.html?$"), "text/html").otherwise("text/plain")
    decoded = F.expr("try_validate_utf8(cast(content as string))")
    text = F.coalesce(decoded, F.expr("make_valid_utf8(cast(content as string))"))
    return files.where(~F.endswith("path", F.lit(skip_suffix))).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), kind.alias("content_type"), text.alias("text")
    )


def limited(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    return evaluation.prefix_limits(files, "path", "size", max_files, max_bytes)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines, with the line itself in ``corrupt`` where it could not be read."""
    return spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").csv(path)


def mapped(rows: DataFrame, columns: dict[str, str], defaults: dict[str, str], required: list[str]) -> DataFrame:
    """Source columns under their target names with defaults; ``reject_reason`` names missing required values."""
    out = rows.select(*(F.coalesce(F.nullif(F.trim(F.col(src).cast("string")), F.lit("")), F.lit(defaults.get(dst))).alias(dst) for dst, src in columns.items()))
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required)))
    return out.withColumn("reject_reason", F.nullif(F.array_join(missing, ","), F.lit("")))


def write_routes(rows: DataFrame, routes: list[tuple[str, Column]], otherwise: str, path: str) -> None:
    """One Parquet write, partitioned by route: every row lands in exactly one sink."""
    evaluation.routed(rows, routes, otherwise).write.partitionBy("route").parquet(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).csv(path)


def json_records(spark: SparkSession, path: str, schema: str, records: str) -> DataFrame:
    """The records of the array at a dotted path inside JSON documents, one row each."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode(F.col(records)).alias("r")).select("r.*")


def triples(spark: SparkSession, path: str, predicates: list[str] | None = None) -> DataFrame:
    """(subject, predicate, object): N-Triples lines whose three terms are addresses; codec by extension.

    Addresses are shortened to what follows the last slash or #. The predicate filter runs on the scanned lines.
    """
    term = r"<[^>]*?([^/#>]+)>"
    lines = spark.read.text(path).where(F.col("value").rlike(rf"^{term}\s+{term}\s+{term}\s*\.\s*$"))
    parts = lines.select(*(F.regexp_extract("value", rf"^{term}\s+{term}\s+{term}", i).alias(n) for i, n in enumerate(("subject", "predicate", "object"), 1)))
    return parts if predicates is None else parts.where(F.col("predicate").isin(*predicates))


def stanzas(spark: SparkSession, path: str, kind: str, single: list[str], repeated: list[str]) -> DataFrame:
    """One row a [kind] stanza of a tag-value file: the first value of each single tag, all of each repeated one.

    Records are split by the reader at the stanza header, so a long file is read by many tasks.
    """
    blocks = spark.read.option("lineSep", f"[{kind}]\n").text(path)
    own = F.regexp_replace("value", r"(?s)\n\[\w+\]\n.*", "\n")  # a stanza of another kind may follow
    found = lambda tag: F.regexp_extract_all(own, F.lit(rf"(?m)^{tag}:[ \t]*(.*?)[ \t]*$"), F.lit(1))
    rows = blocks.select(*(F.get(found(t), 0).alias(t) for t in single), *(found(t).alias(t) for t in repeated))
    return rows.where(F.col(single[0]).isNotNull())


def coalesced(rows: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Target columns from the first synonym header that the source has a non-blank value under."""
    at = {c.lower(): c for c in rows.columns}
    pick = lambda names: [F.nullif(F.trim(F.col(f"`{at[n.lower()]}`").cast("string")), F.lit("")) for n in names if n.lower() in at]
    return rows.select(*(F.coalesce(*pick(names), F.lit(None).cast("string")).alias(target) for target, names in synonyms.items()))


def flattened(records: DataFrame, parent: list[str], nested: str) -> DataFrame:
    """(parent columns, position, the columns of the nested structs): one row an element of an array of structs."""
    return records.select(*parent, F.posexplode(nested).alias("position", "__e")).select(*parent, "position", "__e.*")


def zip_members(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(path, name, text): members of archives whose name is among ``wanted`` (name); only those are unpacked.

    Names are listed first and joined; the archives are then opened once more for the members that matched. An archive is
    read by one task, as its format demands, and a member must fit in a task.
    """
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame({"path": p, "name": zipfile.ZipFile(io.BytesIO(content)).namelist()})

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content, chosen in zip(batch["path"], batch["content"], batch["names"], strict=True):
                archive = zipfile.ZipFile(io.BytesIO(content))
                for name in chosen:
                    yield pd.DataFrame({"path": [p], "name": [name], "text": [archive.read(name).decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    listed = files.mapInPandas(names, "path string, name string").join(wanted.select("name").distinct(), "name", "left_semi")
    chosen = listed.groupBy("path").agg(F.collect_set("name").alias("names"))
    return files.join(chosen, "path").mapInPandas(members, "path string, name string, text string")


def write_vectors(rows: DataFrame, path: str, id_col: str = "id") -> None:
    """Gzip JSON lines of (id, vector, payload), sorted by id over all files by a range partitioning."""
    rows.repartitionByRange(id_col).sortWithinPartitions(id_col).write.option("compression", "gzip").json(path)
