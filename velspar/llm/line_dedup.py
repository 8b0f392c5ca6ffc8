"""Line dedup by content-defined chunks of lines. DataFrame functions only.

A text is cut at line feeds; a line of blanks, tabs and carriage returns alone is blank and counts with what lies around it. A rolling hash over the hashes
of WINDOW lines ends a chunk where it is 0 modulo DIVISOR and was not one line earlier, so chunks have two lines at least, boundaries depend on the lines
around them alone, and an insertion shifts none beyond it. Of a chunk that occurs again anywhere, the first occurrence (least doc_id, then place) stays.

A boundary at the end of a repeated passage depends on lines outside it. So the passage's ends are settled by the shortest chunks, two lines each,
the last of a chunk and the first of the next among them: those inside chunks that go already are left out, of the others the first occurrence stays too.
What goes in the end is therefore exactly every line that lies in a pair of neighbouring lines that occurred before: repeated passages of two lines or
more go whole (share of planted lines found in tests: 1.0 for blocks of 2 to 50 lines), passages inside one line stay.

Chunks and pairs are grouped by 64-bit hashes, counted before the shuffle. A key with at least 1 / HOT of all rows (HOT keys at most) is
joined by broadcast, so what a third of all documents hold never meets in one task. The bodies of what repeats are then compared by bytes with the first
occurrence's, which is sent to a key's salts, one for SALT rows. The texts are shuffled twice, by document: for the bodies, and to take lines out.

Defined results: null text stays null with 0 lines; an empty text is one blank line; a row is a document, rows with the same doc_id too (ordered by a
hash of their texts), and rows with a null doc_id come last in the order; different bodies with one hash stay both; removed lines leave the others in order;
very long texts are one row's work; columns of any name are carried along by remove_repeats().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velspar.session import materialise

WINDOW, DIVISOR = 3, 4
HOT, SALT = 2000, 64
BLANKS = " \t\r"


def identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(id, row, text): `id` tells the rows apart and gives their order; `row` holds all columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    if rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return rows
    numbered = rows.withColumn("number", F.monotonically_increasing_id()).orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"), "number")
    return materialise(spark, numbered.select(F.monotonically_increasing_id().alias("id"), "row", "text"), "line-rows")  # written, so the numbers stay the same


def body(first: str, last: str) -> str:
    return f"array_join(slice(lines, {first} + 1, {last} - {first} + 1), '\\n')"


def chunked(rows: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(id, first, last, key, inner, cross): chunks, the pairs of neighbouring lines inside each, and the pair with the next chunk's first line."""
    lines = rows.where("text is not null").select("id", F.split("text", "\n").alias("lines"))
    full = lines.select("id", "lines", F.expr(f"filter(sequence(0, size(lines) - 1), i -> trim(BOTH '{BLANKS}' FROM lines[i]) <> '')").alias("full"))
    hashed = full.select("id", "lines", "full", F.expr("transform(full, i -> xxhash64(lines[i]))").alias("hashes"))
    cut = f"(k >= {WINDOW - 1} AND pmod({' + '.join(f'{31**j} * shiftright(hashes[k - {j}], 20)' for j in range(WINDOW))}, {divisor}) = 0)"
    ends = f"filter(sequence(0, size(full) - 1), k -> k = size(full) - 1 OR ({cut} AND NOT {cut.replace('k >= ', 'k - 1 >= ').replace('hashes[k', 'hashes[k - 1')}))"
    # No filter by the number of lines: pushed below the split, it would split a text once for each of its lines.
    ended = hashed.select("id", "lines", "full", F.expr(f"if(size(full) < 2, cast(array() AS array<int>), {ends})").alias("ends"))
    pairs = "transform(sequence({a}, {b}), k -> struct(full[k] AS first, full[k + 1] AS last, xxhash64(" + body("full[k]", "full[k + 1]") + ") AS key))"
    none = "cast(array() AS array<struct<first:int,last:int,key:bigint>>)"
    begin = "if(n = 0, 0, ends[n - 1] + 1)"
    inner = f"if({begin} < e, {pairs.format(a=begin, b='e - 1')}, {none})"
    cross = f"if(e < size(full) - 1, {pairs.format(a='e', b='e')}, {none})"
    chunk = f"struct(full[{begin}] AS first, full[e] AS last, if({begin} < e, xxhash64({body(f'full[{begin}]', 'full[e]')}), NULL) AS key, {inner} AS inner, {cross} AS cross)"
    return ended.select("id", F.expr(f"inline(transform(ends, (e, n) -> {chunk}))"))


def with_keeper(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """The rows of refs (id, first, key, ...) with `n` and `keeper` (id, first), the number and the first of all rows of the key; null where it occurs once."""
    counted = refs.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "first")).alias("keeper")).where("n > 1")
    seen, least = materialise(spark, counted, "line-keys"), refs.count() / HOT
    some = refs.join(F.broadcast(seen.where(F.col("n") >= least)), "key", "left")  # HOT keys at most
    return some.where("keeper is not null").unionByName(some.where("keeper is null").drop("n", "keeper").join(seen.where(F.col("n") < least), "key", "left"))


def own() -> Column:
    return (F.col("keeper.id") == F.col("id")) & (F.col("keeper.first") == F.col("first"))


def repeats(spark: SparkSession, rows: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(id, first, last): the ranges of lines to remove, apart from one another."""
    chunks = materialise(spark, chunked(rows, divisor), "line-chunks")
    marked = materialise(spark, with_keeper(spark, chunks).withColumn("keeps", own()).drop("keeper"), "line-chunks-marked")
    pairs = marked.select("id", F.explode(F.when(~F.col("keeps"), F.col("cross")).otherwise(F.concat("inner", "cross"))).alias("pair")).select("id", "pair.*")
    own_columns = ["id", "first", "last", "key", "n", "keeps"]
    found = marked.select(*own_columns, F.lit(True).alias("chunk")).unionByName(with_keeper(spark, pairs).withColumn("keeps", own()).select(*own_columns, F.lit(False).alias("chunk")))
    by_id = found.where("keeps is not null").groupBy("id").agg(F.collect_list(F.struct(*own_columns[1:], "chunk")).alias("refs"))
    texts = rows.select("id", "text").join(by_id, "id").select("id", F.split("text", "\n").alias("lines"), "refs")
    bodies = texts.select("id", F.expr(f"inline(transform(refs, c -> struct(c.first AS first, c.last AS last, c.key AS key, c.n AS n, c.keeps AS keeps, c.chunk AS chunk, {body('c.first', 'c.last')} AS body)))"))
    bodies = materialise(spark, bodies, "line-bodies")
    salts = F.ceil(F.col("n") / SALT).cast("int")
    kept = bodies.where("keeps").select("key", "chunk", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("body").alias("kept_body"))
    others = bodies.where("not keeps").withColumn("salt", F.pmod(F.xxhash64("id", "first"), salts).cast("int"))
    same = others.join(kept, ["key", "chunk", "salt"]).where("body = kept_body").select("id", "first", "last")
    # Ranges of one document that overlap become one.
    before = Window.partitionBy("id").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = same.withColumn("fresh", F.coalesce(F.col("first") > F.max("last").over(before), F.lit(True)).cast("int"))
    island = fresh.withColumn("island", F.sum("fresh").over(Window.partitionBy("id").orderBy("first", "last")))
    return island.groupBy("id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


#: The lines of a text outside its sorted ranges `gone`: the slices before, between and after them.
KEPT = """array_join(flatten(transform(sequence(0, size(gone)), k -> slice(lines, if(k = 0, 0, gone[k - 1].last + 1) + 1,
    if(k = size(gone), size(lines), gone[k].first) - if(k = 0, 0, gone[k - 1].last + 1)))), '\\n')"""


def without(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows with `lines`, `gone` (null where nothing goes) and `left`, the text that stays."""
    gone = removed.groupBy(F.col("id").alias("gone_id")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone"))
    joined = rows.join(gone, F.col("id") == F.col("gone_id"), "left").withColumn("lines", F.split("text", "\n"))
    return joined.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr(KEPT)))


def line_dedup(spark: SparkSession, docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): each text without its repeated lines; see the module."""
    rows = identified(spark, docs.select("doc_id", "text")).select("id", F.col("row.doc_id").cast("bigint").alias("doc_id"), "text")
    n = F.aggregate("gone", F.lit(0), lambda s, g: s + g["last"] - g["first"] + 1)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    return without(rows, repeats(spark, rows, divisor)).select("doc_id", F.col("left").alias("text"), n_lines.alias("n_lines"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_removed"))


def remove_repeats(spark: SparkSession, docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The documents with repeated lines taken out of `text` and, where there is one, `n_chars` to match; other columns as they were. With `drop_emptied`
    documents go that lose all their text, which other documents keep."""
    rows = identified(spark, docs)
    new = without(rows, repeats(spark, rows))
    if drop_emptied:
        new = new.where(F.col("gone").isNull() | (F.expr(f"trim(BOTH '{BLANKS}\\n' FROM left)") != ""))
    kind = {f.name: f.dataType for f in docs.schema.fields}
    fields = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("left").cast(kind["text"])}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("gone").isNull(), fields["n_chars"]).otherwise(F.char_length("left").cast(kind["n_chars"]))
    return new.select(*[x.alias(c) for c, x in fields.items()])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def line_dedup_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of line_dedup() over a table of distinct, known doc_ids, from the definition: no hash and no chunk is in it."""
    blanks = "' ' || chr(9) || chr(13)"
    return f"""
    WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents} WHERE text IS NOT NULL),
    line AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS body FROM cut),
    pair AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM line WHERE trim(body, {blanks}) <> ''),
    ranked AS (
      SELECT p.doc_id, i, j, row_number() OVER (PARTITION BY array_to_string(l[i:j], chr(10)) ORDER BY p.doc_id, i) AS place
      FROM pair p JOIN cut c ON c.doc_id = p.doc_id WHERE j IS NOT NULL),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM ranked WHERE place > 1),
    result AS (
      SELECT n.doc_id, string_agg(n.body, chr(10) ORDER BY n.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
      FROM line n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed
    FROM {documents} d LEFT JOIN result r ON r.doc_id = d.doc_id"""
