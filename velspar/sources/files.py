"""Readers and writers: canonical JSON lines, triples, label maps, notation records, embedding tables, graph exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line by an explicit schema; blank lines are skipped, a line that is no such object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def canonical_lines(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, line): compact JSON with sorted field names."""
    return records.select(F.col(key).alias("key"), F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}).alias("line"))


def write_jsonl(records: DataFrame, path: str, key: str = "id") -> None:
    """Canonical lines in order of the key, range-partitioned: the files in order of their names are the sorted whole."""
    canonical_lines(records, key).repartitionByRange("key").sortWithinPartitions("key", "line").select("line").write.text(path)


def manifest_digest(records: DataFrame, key: str = "id") -> str:
    """SHA-256 of the canonical lines in order; rows stream through the driver one partition at a time."""
    import hashlib

    h = hashlib.sha256()
    for r in canonical_lines(records, key).orderBy("key", "line").toLocalIterator():
        h.update(f"{r['line']}\n".encode())
    return h.hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_triples(spark: SparkSession, path: str, has_header: bool = False) -> DataFrame:
    """Tab-separated head, relation, tail; empty lines and comments (#) are skipped, as is, if the first row that is kept names the columns, that row alone. Another
    number of parts is an error."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    if has_header:
        first = lines.orderBy("at").limit(1).select("at", F.expr("value RLIKE '^\\\\s*head\\\\s*\\t\\\\s*relation\\\\s*\\t\\\\s*tail\\\\s*$'").alias("names")).collect()
        lines = lines.where(F.col("at") != first[0]["at"]) if first and first[0]["names"] else lines
    parts = lines.select(F.split("value", "\t").alias("p"))
    right = F.when(F.size("p") == 3, F.col("p")).otherwise(F.raise_error(F.lit("a triple has three parts")).cast("array<string>"))
    return parts.select(right.alias("p")).select(*[F.trim(F.col("p")[k]).alias(n) for k, n in enumerate(("head", "relation", "tail"))])


def write_triples(triples: DataFrame, path: str) -> None:
    rows = triples.select("head", "relation", "tail").distinct()
    rows.repartitionByRange("head", "relation", "tail").sortWithinPartitions("head", "relation", "tail").write.option("sep", "\t").csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("parent", "child").distinct().orderBy("parent", "child").write.option("header", True).csv(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(filename, labels) of a JSON object from file names to lists: labels trimmed, distinct and sorted."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})).alias("filename", "labels"))
    return whole.select("filename", F.array_sort(F.array_distinct(F.filter(F.transform("labels", lambda x: F.trim(x)), lambda x: x != ""))).alias("labels"))


def manifest_of(annotations: DataFrame, prefix: str) -> DataFrame:
    """One record for each file, its provenance unknown until it is found."""
    return annotations.select(F.concat(F.lit(f"{prefix}:"), "filename").alias("id"), "filename", "labels", *[F.lit(None).cast("string").alias(c) for c in ("group_id", "sha256", "split")])


def read_notations(spark: SparkSession, path: str) -> DataFrame:
    """(node, children) of records that end with a line `$`: `N` names the node, `C` starts its children and `;` goes on with the field before.

    A record's lines stay together, as `$` is the reader's line separator; a record without a node is an error.
    """
    records = spark.read.option("lineSep", "\n$").text(path).where(F.col("value").rlike(r"[^\s$]"))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    step = F.aggregate(
        lines, F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("node"), F.array().cast("array<string>").alias("children")),
        lambda s, x: F.struct(
            F.when(F.substring(x, 1, 1) == ";", s["field"]).otherwise(F.substring(x, 1, 1)).alias("field"),
            F.when(F.substring(x, 1, 1) == "N", F.trim(F.substring(x, 2, 10_000))).otherwise(s["node"]).alias("node"),
            F.when((F.substring(x, 1, 1) == "C") | ((F.substring(x, 1, 1) == ";") & (s["field"] == "C")), F.concat(s["children"], F.array(F.trim(F.substring(x, 2, 10_000))))).otherwise(s["children"]).alias("children"),
        ),
    )
    parsed = records.select(step.alias("r"))
    node = F.when(F.col("r.node").isNull(), F.raise_error(F.lit("a record has no node")).cast("string")).otherwise(F.col("r.node"))
    return parsed.select(node.alias("node"), F.col("r.children").alias("children"))


def edges_of(notations: DataFrame) -> DataFrame:
    return notations.select(F.col("node").alias("parent"), F.explode("children").alias("child")).distinct()


def save_embeddings(table: DataFrame, path: str, metadata: dict[str, str], normalise: bool = True) -> None:
    """Vectors as Parquet with a one-row table of metadata beside them; ids become strings and must be distinct."""
    from velspar.functions.vectors import normalise as unit

    rows = table.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids repeat")
    if normalise:
        rows = unit(rows)
    rows.select("id", F.col("vector").cast("array<float>").alias("vector")).write.parquet(f"{path}/vectors")
    rows.sparkSession.createDataFrame([(metadata,)], "metadata map<string,string>").write.json(f"{path}/metadata")


def load_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    metadata = spark.read.schema("metadata map<string,string>").json(f"{path}/metadata").first()
    if metadata is None:
        raise ValueError("the table has no metadata")
    return spark.read.schema("id string, vector array<float>").parquet(f"{path}/vectors"), metadata["metadata"]


def skos_triples(notations: DataFrame, base: str) -> DataFrame:
    """N-Triples lines of a taxonomy: type, notation and broader/narrower of every node."""
    uri = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(F.url_encode(c), r"\+", "%20"), F.lit(">"))
    skos = "http://www.w3.org/2004/02/skos/core#"
    own = notations.select(F.col("node"))
    literal = F.concat(F.lit('"'), F.regexp_replace("node", r'(["\\])', r"\\$1"), F.lit('"'))
    lines = own.select(F.concat_ws(" ", uri(F.col("node")), F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"), F.lit(f"<{skos}Concept> .")).alias("line"))
    lines = lines.union(own.select(F.concat_ws(" ", uri(F.col("node")), F.lit(f"<{skos}notation>"), literal, F.lit("."))))
    edges = edges_of(notations)
    for a, r, b in (("child", "broader", "parent"), ("parent", "narrower", "child")):
        lines = lines.union(edges.select(F.concat_ws(" ", uri(F.col(a)), F.lit(f"<{skos}{r}>"), uri(F.col(b)), F.lit("."))))
    return lines.distinct()
