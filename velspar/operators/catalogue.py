"""Reports, facets and selections over catalogue records; bibliographic fields of manifests."""

from __future__ import annotations

import hashlib
import html
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velspar.functions.text import slug_of, strip_all_keys


def label_coverage(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(collection, total, labelled, assignments, mean_labels): how much of each collection holds labels; an unknown or empty collection is `unknown`."""
    n = labels.groupBy("id").agg(F.count("*").alias("n"))
    name = F.coalesce(F.nullif("collection", F.lit("")), F.lit("unknown")).alias("collection")
    own = records.join(n, "id", "left").groupBy(name).agg(F.count("*").alias("total"), F.count("n").alias("labelled"), F.coalesce(F.sum("n"), F.lit(0)).alias("assignments"))
    return own.withColumn("mean_labels", F.coalesce(F.try_divide("assignments", "labelled"), F.lit(0.0)))


def facets(records: DataFrame, equal: dict[str, object], holds: dict[str, object], text: str = "", over: tuple[str, ...] = ()) -> DataFrame:
    """The records whose columns equal the given values, whose arrays hold them, and whose joined fields contain the text, letters of either case alike."""
    clauses = [F.col(c) == v for c, v in equal.items()] + [F.array_contains(c, v) for c, v in holds.items()]
    if text:
        clauses.append(F.contains(F.lower(F.concat_ws(" ", *over)), F.lit(text.lower())))
    return reduce(DataFrame.where, clauses, records)


def chips(neighbours: DataFrame, items: DataFrame, labels: DataFrame, attributes: tuple[str, ...], hub: int) -> DataFrame:
    """neighbours with same_<attribute> and other_<attribute> (an unknown value is neither), and `subject`: a label in common of at most `hub` items."""
    for side, key in (("a", "query_id"), ("b", "candidate_id")):
        neighbours = neighbours.join(items.select(F.col("id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in attributes]), key, "left")
    rare = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") <= hub).select("label")
    own = labels.join(rare, "label", "left_semi")
    both = neighbours.select("query_id", "candidate_id").join(own.withColumnRenamed("id", "query_id"), "query_id").join(own.withColumnRenamed("id", "candidate_id"), ["candidate_id", "label"])
    out = neighbours.join(both.select("query_id", "candidate_id", F.lit(True).alias("subject")).distinct(), ["query_id", "candidate_id"], "left").na.fill(False, ["subject"])
    flags = [F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False)).alias(f"same_{c}") for c in attributes] + [F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False)).alias(f"other_{c}") for c in attributes]
    return out.select("query_id", "candidate_id", "rank", "subject", *flags)


def vocabulary_join(notations: DataFrame, mapping: DataFrame) -> DataFrame:
    """(notation, target, how): the mapping's target of each notation, `exact`, else by the notation without keys, `normalised`, else null."""
    least = mapping.groupBy("notation").agg(F.min("target").alias("target"))
    rows = notations.select("notation").distinct().withColumn("plain", strip_all_keys(F.col("notation")))
    exact = rows.join(least.withColumnRenamed("target", "t1"), "notation", "left")
    both = exact.join(least.select(F.col("notation").alias("plain"), F.col("target").alias("t2")), "plain", "left")
    how = F.when(F.col("t1").isNotNull(), "exact").when(F.col("t2").isNotNull(), "normalised")
    return both.select("notation", F.coalesce("t1", "t2").alias("target"), how.alias("how"))


def support_filter(labels: DataFrame, least: int, most_share: float) -> DataFrame:
    """Labels held by at least `least` items and at most the share `most_share` of all labelled ones."""
    size = labels.agg(F.count_distinct("id").alias("size"))
    n = labels.groupBy("label").agg(F.count_distinct("id").alias("n")).crossJoin(F.broadcast(size))  # one row
    return n.where((F.col("n") >= least) & (F.col("n") <= most_share * F.col("size"))).select("label", "n")


def family_of(types: Column, families: dict[str, list[str]]) -> Column:
    """The first family that shares a member with the array, in the families' order; null if none does."""
    return reduce(lambda out, f: out.when(F.arrays_overlap(types, F.array(*map(F.lit, families[f]))), f), list(families)[1:], F.when(F.arrays_overlap(types, F.array(*map(F.lit, next(iter(families.values()))))), next(iter(families))))


def wanted(records: DataFrame, fields: list[str], known: DataFrame, pattern: str) -> DataFrame:
    """(id) of the distinct values in the fields that fit the pattern and are not known yet."""
    values = records.select(F.explode(F.array(*fields)).alias("id")).where(F.col("id").rlike(pattern)).distinct()
    return values.join(known.select("id"), "id", "left_anti")


def ids_digest(ids: DataFrame) -> str:
    """SHA-256 of the sorted distinct ids, a line feed between them; sorted by Spark, streamed a partition at a time."""
    h, first = hashlib.sha256(), True
    for r in ids.select(F.col("id").cast("string").alias("id")).distinct().orderBy("id").toLocalIterator():
        h.update((r["id"] if first else "\n" + r["id"]).encode())
        first = False
    return h.hexdigest()


def text_of(records: DataFrame, fields: list[str]) -> DataFrame:
    """(id, text): the fields that are not blank in their order, joined by spaces; records without any are left out."""
    parts = F.filter(F.array(*[F.trim(F.col(c).cast("string")) for c in fields]), lambda x: x != "")
    return records.select("id", F.array_join(parts, " ").alias("text")).where("text <> ''")


def with_context(counts: list[str]) -> Column:
    """log(1 + count) of each column, then each column's share of their sum."""
    total = reduce(lambda a, b: a + b, map(F.col, counts))
    return F.array(*[F.log1p(F.col(c)) for c in counts], *[F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in counts])


def shape_words(regions: DataFrame) -> DataFrame:
    """(sign, words): a phrase for the median look of each sign's regions (area, elongation, solidity, centroid_y, dark)."""
    m = regions.groupBy("sign").agg(*[F.median(c).alias(c) for c in ("area", "elongation", "solidity", "centroid_y")], F.avg(F.col("dark").cast("double")).alias("dark"))
    c = F.col
    # The bounds and words of the phrase.
    size = F.when(c("area") < 0.01, "minuscule").when(c("area") < 0.03, "petite").when(c("area") < 0.10, "moyenne").otherwise("grande")
    form = F.when(c("elongation") > 2.2, "très allongée").when(c("elongation") > 1.4, "allongée").otherwise("compacte")
    fill = F.when(c("solidity") > 0.6, "pleine").when(c("solidity") > 0.35, "découpée").otherwise("très découpée")
    tone = F.when(c("dark") > 0.6, "sombre").when(c("dark") < 0.4, "claire").otherwise("de ton variable")
    place = F.when(c("centroid_y") < 0.38, "en haut").when(c("centroid_y") > 0.62, "en bas").otherwise("au centre")
    return m.select("sign", F.concat(F.lit("tache "), size, F.lit(", "), form, F.lit(", "), fill, F.lit(", "), tone, F.lit(", plutôt "), place).alias("words"))


VOLUME = "volume_id string, title string, work_title string, place string, printer string, year int, language string, creator_gnds array<string>, creator_names array<string>"


def _raw(value: object) -> str | None:
    """A value of a manifest as text with its markup: a string, an object with @value, or a list of these, the English one first."""
    if isinstance(value, list):
        english = [x for x in value if isinstance(x, dict) and x.get("@language") == "en"]
        return _raw((english or value)[0]) if value else None
    if isinstance(value, dict):
        return _raw(value.get("@value"))
    return (value.strip() or None) if isinstance(value, str) else None


def _volume(volume: str, text: str | None) -> dict:
    fields: dict[str, list[str]] = {}
    for entry in json.loads(text or "{}").get("metadata") or []:
        label, value = _raw(entry.get("label")), _raw(entry.get("value"))
        if label and value:
            fields.setdefault(html.unescape(re.sub(r"<[^>]+>", " ", label)).strip(), []).append(value)
    first = lambda name: " ".join(re.sub(r"<[^>]+>", " ", fields[name][0]).split()) or None if name in fields else None
    place, _, printer = (first("Published") or "").partition(":")
    creators = fields.get("Creator", []) + fields.get("Contributor", [])
    found = re.search(r"\b(1[0-9]{3})\b", first("Date") or "")
    names = [slug_of(raw.split("--")[0].split(",")[0]) for raw in creators]
    return {
        "volume_id": volume, "title": first("Title"), "work_title": first("Work title"), "place": slug_of(place), "printer": slug_of(printer), "year": int(found[1]) if found else None,
        "language": slug_of(first("Language")), "creator_gnds": list(dict.fromkeys(g for raw in creators for g in re.findall(r"d-nb\.info/gnd/([0-9X-]+)", raw))), "creator_names": list(dict.fromkeys(n for n in names if n)),
    }


def parse_manifests(manifests: DataFrame) -> DataFrame:
    """The volume of each row (volume_id, payload) from the metadata of its manifest in JSON; a payload that is no JSON is an error."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([_volume(v, p) for v, p in zip(frame["volume_id"], frame["payload"], strict=True)], columns=[c.split()[0] for c in VOLUME.split(", ")]).astype({"year": "Int64"})

    return manifests.select("volume_id", "payload").mapInPandas(run, VOLUME)


def catalogue_volumes(rows: DataFrame) -> DataFrame:
    """The volume of each catalogue row (book_id, title, authors, place, date): surnames as creators, the first three words of the title as the work."""
    from velspar.functions.text import slug, year

    surnames = F.filter(F.transform("authors", lambda a: F.trim(F.get(F.split(a, ","), F.lit(0)))), lambda a: a != "")
    named = rows.select(F.col("book_id").cast("string").alias("volume_id"), "title", F.array_join(F.slice(F.split(F.trim("title"), r"\s+"), 1, 3), " ").alias("work_title"), slug(F.col("place")).alias("place"), year(F.col("date").cast("string")).alias("year"), F.posexplode_outer(surnames).alias("at", "name"))
    slugged = named.withColumn("name", slug(F.col("name")))
    return slugged.groupBy("volume_id", "title", "work_title", "place", "year").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("at", "name")))), lambda x: x["name"])).alias("creator_names"))
